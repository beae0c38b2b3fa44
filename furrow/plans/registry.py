"""Registry of the named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.scalars import half_up
from furrow.plans.base_sql import with_base

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB form over the base tables of :mod:`base_sql`."""
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: present(build(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_base(sql)
        return build

    return register


def present(df: DataFrame) -> DataFrame:
    """Output form: doubles to 6 digits, dates as ISO text, whole numbers as long."""
    out = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            column = half_up(column.cast("double"), 6, noise=5e-10)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        out.append(column.alias(field.name))
    return df.select(*out)

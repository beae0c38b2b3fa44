"""Table and document readers. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import schemas
from furrow.functions.scalars import first_present, nan_to_null


def read_indicator(spark: SparkSession, path: str, schema: T.StructType = schemas.OBSERVATION) -> DataFrame:
    """One indicator's observations; NaN is read as null."""
    return nan_to_null(spark.read.schema(schema).parquet(path))


def read_yields(spark: SparkSession, path: str) -> DataFrame:
    """Yield table from CSV, with the county code kept as text."""
    return spark.read.schema(schemas.YIELDS).option("header", True).csv(path)


def parse_yield_records(df: DataFrame, json: str = "record") -> DataFrame:
    """Yield rows from JSON records; a blank or non-numeric value becomes null."""
    r = F.from_json(F.col(json), schemas.YIELD_RECORD)
    parsed = df.select(r.alias("r")).select(
        F.col("r.year").try_cast("int").alias("year"),
        F.coalesce("r.state_name", F.lit("IOWA")).alias("state"),
        F.coalesce("r.state_fips_code", F.lit("19")).alias("state_fips"),
        F.coalesce("r.county_name", F.lit("")).alias("county"),
        F.coalesce("r.county_code", F.lit("")).alias("county_fips"),
        F.col("r.Value").try_cast("double").alias("yield_bu_per_acre"),
        F.coalesce("r.unit_desc", F.lit("BU / ACRE")).alias("unit"),
    )
    code = F.when(F.length("county_fips") >= 3, F.col("county_fips")).otherwise(
        F.lpad("county_fips", 3, "0"))
    return parsed.withColumn("fips", F.concat("state_fips", code))


def read_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Text and Markdown documents with the name and type of their file.

    One row per file; with ``separator`` a file holds many documents, each ended by it, and is read in splits.
    """
    name = F.col("_metadata.file_name")
    how = {"wholetext": True} if separator is None else {"lineSep": separator}
    return (
        spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}", **how)
        .select(name.alias("source"), F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("file_type"),
                F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def read_weekly(spark: SparkSession, path: str, baseline: str | None = None
                ) -> tuple[DataFrame, DataFrame | None]:
    """Weekly table and, where given, the baseline table; no baseline is not an error."""
    weekly = nan_to_null(spark.read.schema(schemas.WEEKLY).parquet(path))
    return weekly, None if baseline is None else spark.read.parquet(baseline)


def read_counties(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """County code and name from the features of GeoJSON collections.

    With ``multi_line`` each file is one collection; without, each line is one.
    """
    raw = spark.read.schema(schemas.GEO_COLLECTION).option("multiLine", multi_line).json(path)
    props = raw.select(F.explode("features.properties").alias("p"))
    keys = ("GEOID", "fips", "FIPS", "NAME", "name", "county_name")
    named = props.select(*[F.col("p")[key].alias(f"k{i}") for i, key in enumerate(keys)])
    return named.select(first_present("k0", "k1", "k2").alias("fips"),
                        first_present("k3", "k4", "k5").alias("county_name"))


def split_bad_rows(df: DataFrame, casts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose text columns all convert, converted, and the rejected rows as they came."""
    tried = {f"__{name}": F.col(name).try_cast(kind) for name, kind in casts.items()}
    marked = df.withColumns(tried)
    bad = F.lit(False)
    for name in casts:
        bad = bad | (F.col(name).isNotNull() & F.col(f"__{name}").isNull())
    good = marked.filter(~bad).withColumns({n: F.col(f"__{n}") for n in casts}).drop(*tried)
    return good, marked.filter(bad).drop(*tried)

"""The registered queries of this subpackage and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import collocations, cotraining, embeddings, linededup, maxent, packing, periodic, pieces, pii, quality_rules, sharding, simhash
from furrow.llm import toxicity as tox

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = tokenizers.path("byte_bpe_50k.json")
PIECES = tokenizers.path("piece_bpe_32k.model")
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_key AS key FROM (
    SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS lines FROM documents)))),
often AS (
  SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keep IS NOT NULL AND doc_id <> keep) AS n_dropped,
  sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (WHERE keep IS NULL OR doc_id = keep), '')) AS kept_sha256
FROM lines LEFT JOIN often USING (key) GROUP BY doc_id"""


@query("op9_line_dedup", LINES_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of all documents, through the line index."""
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by SimHash."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_min_bin_slack")
def op5_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of 1024."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    lexicon = tox.learn(docs, table(spark, sf_dir, "labels"))
    scored = tox.toxicity(docs, lexicon)
    return scored.select("doc_id", tox.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.spans(table(spark, sf_dir, "documents"))
    counts = [pii.count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.digest(F.col("spans")).alias("spans"))


RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d)),
win AS (
  SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
dup AS (
  SELECT r, i, length(w) AS c, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM win),
cov AS (
  SELECT r, c, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS rep
  FROM dup WINDOW o AS (PARTITION BY r ORDER BY i)),
per AS (SELECT r, count(*) AS n, sum(c) AS c, count(*) FILTER (WHERE rep) AS again FROM cov GROUP BY r),
line AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS again
  FROM (SELECT r, unnest(string_split(text, E'\n')) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY r),
m AS (
  SELECT d.doc_id, coalesce(per.n, 0) AS n_words, CAST(coalesce(per.c, 0) AS BIGINT) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(line.again, 0) AS n_dup_lines,
    coalesce(per.again, 0) AS n_repeat_words, coalesce(line.n, 0) AS n_lines,
    (length(text) - length(replace(text, '!!', ''))) // 2 AS n_shouted
  FROM d LEFT JOIN per USING (r) LEFT JOIN line USING (r)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END)
    + (CASE WHEN 2 * n_shouted > n_words THEN 128 ELSE 0 END) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM f"""


@query("op8_quality_rules", RULES_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents under the current policy."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
                       quality_rules.passes(quality_rules.CURRENT).alias("kept"), "failed")


@query("op3_feistel_shards")
def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 40 shards whose counts differ by one at most."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON a = vec_id"""


@query("op1_spherical_caps", VECTORS_SQL)
def op1_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors at a cosine of 0.9."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_cotraining")
def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by co-trained views."""
    docs = table(spark, sf_dir, "documents")
    scored = cotraining.score(docs, cotraining.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", tox.held_out(F.col("doc_id")).alias("held_out"), "content_score", "metadata_score", "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_sampled_pieces")
def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of all documents."""
    found = pieces.encode(table(spark, sf_dir, "documents"), PIECES)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
                        F.crc32("ids").alias("ids_crc32"), "lossless")


PHRASES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
f1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM p) GROUP BY ALL),
f2 AS (
  SELECT lang, g[1] AS w1, g[2] AS w2, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]])) AS g FROM p) GROUP BY ALL),
f3 AS (
  SELECT lang, g[1] AS w1, g[2] AS w2, g[3] AS w3, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS g FROM p)
  GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (
    SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cut AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 JOIN f1 x USING (lang) JOIN f1 y USING (lang) LEFT JOIN longer USING (lang, w1, w2)
  WHERE x.w = w1 AND y.w = w2 AND f2.f >= 10 AND (longer.f IS NULL OR 100 * longer.f < 50 * f2.f)
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.f, x.f, y.f, 1
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.f, x.f, y.f, 2
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w = w3),
scored AS (
  SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


@query("op13_collocations", PHRASES_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of every language in all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, one in ten of which repeats a part of itself."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), arrange=periodic.planted)
    best = periodic.most_repeated(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic.run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op12_hashed_maxent")
def op12_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of all documents by the maximum-entropy model, next to that of single tokens."""
    return maxent.score(table(spark, sf_dir, "documents"))

"""Queries over documents: chunks, rankings, chat context and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import forecast, joins, lexical_index, retrieval, rollup
from furrow.plans import domain as d
from furrow.plans.base_sql import half_up, r6
from furrow.plans.forecasting import LINEAR_UNC, POINT, STD, features_sql
from furrow.plans.registry import query
from furrow.session import materialise, new_path, spread
from furrow.sources import writers

# ---- chunks

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def cut_sql(x: str) -> str:
    """End of the sentence-aware window that starts at x, as the priority list demands."""
    window = f"substr(d.text, {x} + 1, 1000)"
    picks = " ".join(
        f"WHEN length({window}) - length(string_split({window}, {mark})[-1]) - 2 > 500 "
        f"THEN length({window}) - length(string_split({window}, {mark})[-1]) - 1"
        for mark in ("'. '", "'.' || chr(10)", "'! '", "'? '"))
    return f"{x} + CASE WHEN {x} + 1000 < length(d.text) THEN CASE {picks} ELSE 1000 END ELSE 1000 END"


SENTENCES = f"""-- recursive
cuts(doc_id, start, stop) AS (
  SELECT d.doc_id, 0, {cut_sql('0')} FROM documents d WHERE length(d.text) > 0
  UNION ALL
  SELECT d.doc_id, c.stop - 200, {cut_sql('(c.stop - 200)')} FROM cuts c JOIN documents d ON c.doc_id = d.doc_id
  WHERE c.stop - 200 < length(d.text)),
pieces AS (SELECT c.doc_id, c.start, trim(substr(d.text, c.start + 1, c.stop - c.start), {SPACES}) AS text
  FROM cuts c JOIN documents d ON c.doc_id = d.doc_id)"""

CHUNKS = SENTENCES + """,
chunked AS (SELECT p.doc_id, source, lang, 'guides-' || lang AS collection,
  row_number() OVER (PARTITION BY p.doc_id ORDER BY start) - 1 AS chunk_index, p.text
  FROM pieces p JOIN documents d ON p.doc_id = d.doc_id WHERE p.text <> '')"""


def documents(spark, sf):
    return spread(d.table(spark, sf, "documents").select("doc_id", "source", "lang", "text"))


def chunks(spark, sf):
    """Sentence-aware chunks of all documents, one collection per language."""
    return retrieval.chunk(retrieval.skip_empty_docs(documents(spark, sf))).withColumn(
        "collection", F.concat(F.lit("guides-"), "lang"))


@query("chunk_text", SENTENCES + """
--
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, length(text) AS characters,
  md5(text) AS digest FROM pieces WHERE text <> ''""")
def chunk_text(spark, sf):
    pieces = retrieval.chunk(documents(spark, sf).select("doc_id", "text"))
    return pieces.select("doc_id", "chunk_index", F.length("text").alias("characters"), F.md5("text").alias("digest"))


@query("chunk_metadata", CHUNKS + """
--
SELECT doc_id, source, '.txt' AS file_type, chunk_index, '2025-11-25 10:30:00' AS loaded_at, md5(text) AS digest FROM chunked""")
def chunk_metadata(spark, sf):
    named = chunks(spark, sf).withColumn("file_type", F.lit(".txt"))
    stamped = retrieval.with_chunk_metadata(named, F.lit("2025-11-25 10:30:00").cast("timestamp"))
    return stamped.select("doc_id", "source", "file_type", "chunk_index", "loaded_at", F.md5("text").alias("digest"))


@query("skip_empty_docs", """
SELECT doc_id, length(t) AS characters FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN repeat(' ', length(text))
  || chr(10) ELSE text END AS t FROM documents) WHERE regexp_matches(t, '\\S')""")
def skip_empty_docs(spark, sf):
    blanked = F.when(F.col("doc_id") % 9 == 0, F.concat(F.expr("repeat(' ', length(text))"), F.lit("\n")))
    docs = documents(spark, sf).withColumn("text", F.coalesce(blanked, F.col("text")))
    return retrieval.skip_empty_docs(docs).select("doc_id", F.length("text").alias("characters"))


@query("chunk_ids", CHUNKS + """
--
SELECT doc_id, chunk_index, sha256(concat_ws('#', source, doc_id, chunk_index)) AS id FROM chunked""")
def chunk_ids(spark, sf):
    return retrieval.with_chunk_id(chunks(spark, sf), "source", "doc_id").select("doc_id", "chunk_index", "id")


def _loaded(spark, sf):
    """Path of a chunk table with one collection per language, whatever the languages are."""
    path = new_path(spark, "chunks")
    writers.load_chunks(chunks(spark, sf), path, collection=None)
    return path


@query("load_chunks", CHUNKS + """
--
SELECT collection, doc_id, chunk_index, md5(text) AS digest FROM chunked""")
def load_chunks(spark, sf):
    return spark.read.parquet(_loaded(spark, sf)).select("collection", "doc_id", "chunk_index", F.md5("text").alias("digest"))


@query("collection_counts", CHUNKS + """
--
SELECT collection, count(*) AS chunks FROM chunked GROUP BY collection""")
def collection_counts(spark, sf):
    return rollup.collection_counts(chunks(spark, sf))


@query("delete_collection", CHUNKS + """
--
SELECT collection, doc_id, chunk_index FROM chunked WHERE collection <> 'guides-fr'""")
def delete_collection(spark, sf):
    path = _loaded(spark, sf)
    writers.delete_collection(spark, path, "guides-fr")
    return spark.read.parquet(path).select("collection", "doc_id", "chunk_index")


# ---- rankings


def vectors(spark, sf):
    return spread(d.table(spark, sf, "embeddings").select("vec_id", "label", "embedding"))


def nearest(spark, sf, k=5):
    """Stored vectors with an id divisible by 50 as queries against all of them."""
    v = vectors(spark, sf)
    asked = v.filter(F.col("vec_id") % 50 == 0)
    return retrieval.cosine_topk(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
                                 v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), k)


COSINE = """
sims AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, q.label AS query_label, c.label AS item_label,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sims)"""

# Hashed term vectors of the chunks, and of the texts that are asked, as (id, component, value).
EMBEDDED = CHUNKS + """,
items AS (SELECT doc_id || '#' || chunk_index AS id, doc_id, chunk_index, collection, text FROM chunked),
tfb AS (SELECT id, b, count(*) AS tf FROM (SELECT id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS b
  FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term
  FROM items)) GROUP BY ALL),
idf AS (SELECT b, ln(((SELECT count(*) FROM items) + 1) / (count(*) + 1e0)) AS idf FROM tfb GROUP BY b),
wt AS (SELECT id, b, tf, tf * idf AS w FROM tfb JOIN idf USING (b)),
vec AS (SELECT id, b, tf, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS v FROM wt)"""

ASKED = EMBEDDED + """,
asked AS (SELECT DISTINCT md5(text) AS query_id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
qtf AS (SELECT query_id, b, count(*) AS tf FROM (SELECT query_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS b
  FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term
  FROM asked)) GROUP BY ALL),
qwt AS (SELECT query_id, b, tf * coalesce(idf, ln((SELECT count(*) FROM items) + 1)) AS w FROM qtf LEFT JOIN idf USING (b)),
qvec AS (SELECT query_id, b, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS v FROM qwt),
msims AS (SELECT query_id, id AS item_id, round(sum(q.v * c.v), 9) AS score FROM qvec q JOIN vec c USING (b)
  WHERE id IN (SELECT id FROM items WHERE collection = 'guides-en') GROUP BY query_id, id),
mrank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM msims WHERE score > 0)"""


def embedded(spark, sf):
    """Chunk vectors and the weights of their terms."""
    found, weights = retrieval.embed(chunks(spark, sf))
    return found.withColumn("item_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))), weights


def answered(spark, sf, k=5):
    """Best chunks of the English guides for every different message, and the chunks."""
    items, weights = embedded(spark, sf)
    asked = d.table(spark, sf, "conversations").filter("role = 'user' AND text IS NOT NULL").select(
        F.md5("text").alias("query_id"), "text").distinct()
    queries, _ = retrieval.embed(asked, weights=weights)
    hits = retrieval.cosine_topk(queries.withColumnRenamed("embedding", "vector"), items.withColumnRenamed("embedding", "vector"),
                                 retrieval.check_k(k), collection="guides-en", matching=True)
    return hits, items


@query("cosine_topk", ASKED + f"\n--\nSELECT query_id, item_id, {r6('score')} AS score, rank FROM mrank WHERE rank <= 5")
def cosine_topk(spark, sf):
    return answered(spark, sf)[0]


@query("retrieval_rank", COSINE + "\n--\nSELECT query_id, item_id, rank FROM ranked WHERE rank <= 20")
def retrieval_rank(spark, sf):
    return nearest(spark, sf, 20).select("query_id", "item_id", "rank")


@query("query_result", ASKED + f"""
--
SELECT query_id, item_id, md5(text) AS text, {r6('score')} AS score, rank, total_found
FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total_found FROM mrank WHERE rank <= 5) JOIN items ON id = item_id""")
def query_result(spark, sf):
    hits, items = answered(spark, sf)
    return retrieval.query_result(hits, items.select("item_id", "text")).withColumn("text", F.md5("text"))


@query("retrieval_eval", COSINE + f"""
--
SELECT query_type, count(*) AS queries, {r6('avg(share)')} AS mean_relevance FROM (
  SELECT query_label AS query_type, query_id, avg(CAST(query_label = item_label AS INTEGER)) AS share FROM ranked
  WHERE rank <= 5 GROUP BY query_label, query_id) GROUP BY query_type""")
def retrieval_eval(spark, sf):
    v = vectors(spark, sf)
    hits = nearest(spark, sf)
    judged = hits.join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_type")), "query_id").join(
        v.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_type")), "item_id").select(
        "query_id", "query_type", (F.col("query_type") == F.col("item_type")).cast("int").alias("relevant"))
    return retrieval.retrieval_eval(judged)


def bm25_sql(items: str) -> str:
    """Okapi scores of the benchmark texts over items(item_id, text)."""
    words = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
toks AS (SELECT item_id, {words} AS w FROM {items}),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
tf AS (SELECT item_id, term, count(*) AS tf, any_value(dl) AS dl FROM (
  SELECT item_id, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY item_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ask AS (SELECT DISTINCT item_id AS query_id, unnest({words}) AS term FROM benchmark),
bm AS (SELECT query_id, tf.item_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0
    / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 9) AS score
  FROM ask JOIN df ON ask.term = df.term JOIN tf ON tf.term = ask.term CROSS JOIN size GROUP BY query_id, tf.item_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM bm)"""


def benchmark(spark, sf):
    return d.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


CHUNK_ITEMS = CHUNKS + ",\nitems AS (SELECT doc_id || '#' || chunk_index AS item_id, text FROM chunked),"
BM25_RANK = CHUNK_ITEMS + bm25_sql("items") + f"""
--
SELECT query_id, item_id, {r6('score')} AS score, rank FROM bmr WHERE rank <= 5"""


def chunk_items(spark, sf):
    key = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return chunks(spark, sf).select(key.alias("item_id"), "text")


def chunk_index(spark, sf):
    """Inverted index of all chunks."""
    return lexical_index.build_index(materialise(chunk_items(spark, sf), "chunks"))


@query("bm25_rank", BM25_RANK)
def bm25_rank(spark, sf):
    return retrieval.bm25(benchmark(spark, sf), chunk_items(spark, sf), 5)


@query("bm25_search", BM25_RANK)
def bm25_search(spark, sf):
    """The rows of ``bm25_rank`` from an index that is searched with exact bounds."""
    return lexical_index.search(chunk_index(spark, sf), benchmark(spark, sf), 5)


@query("bm25_terms", CHUNK_ITEMS + bm25_sql("items") + f"""
--
SELECT md5(term) AS term, any_value(df) AS df, {r6('ln(1 + (any_value(n) - any_value(df) + 0.5e0) / (any_value(df) + 0.5e0))')} AS idf,
  {r6('max(tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)))')} AS top
FROM tf JOIN df USING (term) CROSS JOIN size GROUP BY term""")
def bm25_terms(spark, sf):
    """Terms of the index: in how many chunks, weight, largest impact."""
    return chunk_index(spark, sf).terms.withColumn("term", F.md5("term"))


ASKED_TWICE = COSINE.replace("q.vec_id % 50 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)")


@query("rrf_fuse", "items AS (SELECT doc_id AS item_id, text FROM documents)," + bm25_sql("items") + "," + ASKED_TWICE + f"""
--
SELECT query_id, item_id, {r6('sum(1e0 / (60 + rank))')} AS rrf_score FROM (
  SELECT query_id, item_id, rank FROM bmr WHERE rank <= 20 AND query_id IN (SELECT vec_id FROM embeddings)
  UNION ALL SELECT query_id, item_id, rank FROM ranked WHERE rank <= 20)
GROUP BY query_id, item_id""")
def rrf_fuse(spark, sf):
    """Both lists are asked for the same queries: the benchmark items that have a stored vector."""
    docs = documents(spark, sf).select(F.col("doc_id").alias("item_id"), "text")
    queries, v = benchmark(spark, sf), vectors(spark, sf).withColumnsRenamed({"vec_id": "item_id", "embedding": "vector"})
    both = queries.join(v.select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    asked = v.withColumnRenamed("item_id", "query_id").join(queries, "query_id", "left_semi").select("query_id", "vector")
    lexical = retrieval.bm25(both, docs, 20)
    return retrieval.rrf(lexical, retrieval.cosine_topk(asked, v.select("item_id", "vector"), 20))


@query("embed_chunks", EMBEDDED + f"""
--
SELECT i.doc_id, i.chunk_index, 256 AS dim, count(b) AS parts, {r6('coalesce(sum(v), 0e0)')} AS total,
  {r6('coalesce(max(v), 0e0)')} AS largest, {r6('coalesce(sum(v * b), 0e0)')} AS moment
FROM items i LEFT JOIN vec USING (id) GROUP BY i.doc_id, i.chunk_index""")
def embed_chunks(spark, sf):
    """Unit vectors of all chunks, shown by how many components they have, their sum, maximum and first moment."""
    found, _ = embedded(spark, sf)
    v = F.col("embedding")
    zero = F.lit(0.0)
    return found.select(
        "doc_id", "chunk_index", F.size(v).alias("dim"), F.size(F.filter(v, lambda x: x != 0)).alias("parts"),
        F.aggregate(v, zero, lambda a, x: a + x).alias("total"), F.array_max(v).alias("largest"),
        F.aggregate(F.transform(v, lambda x, i: x * i), zero, lambda a, x: a + x).alias("moment"))


# ---- chat

REQ = """
req AS (SELECT conv_id || '#' || turn AS request_id, text AS message,
  CASE WHEN conv_id % 11 <> 10 THEN CAST(19000 + conv_id % (SELECT count(*) FROM supplier) AS VARCHAR) END AS fips,
  CASE WHEN turn % 4 <> 3 THEN (conv_id * 7 + turn * 3) % 31 END AS week, conv_id % 7 <> 6 AS live,
  CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id % 100 AS DOUBLE) END AS c_overall,
  CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN CAST(conv_id % 90 AS DOUBLE) END AS c_water,
  CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id % 5 * 40 AS DOUBLE) END AS c_yield,
  CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id % 4 * 3 AS DOUBLE) END AS c_spread FROM conversations WHERE role = 'user')"""

NEAR = STD + "," + REQ + """,
near AS (SELECT * FROM (SELECT r.request_id, t.*, row_number() OVER (PARTITION BY r.request_id ORDER BY
    CASE WHEN coalesce(r.week, 0) = 0 THEN -t.week_of_season ELSE abs(t.week_of_season - r.week) END, t.week_start) AS pick
  FROM req r JOIN tail t ON r.fips = t.fips) WHERE pick = 1)"""


@query("nearest_week", NEAR + """
--
SELECT r.request_id, r.fips, r.week, n.week_of_season, CAST(n.week_start AS VARCHAR) AS week_start, n.overall_stress_index
FROM req r LEFT JOIN near n ON r.request_id = n.request_id""")
def nearest_week(spark, sf):
    return joins.nearest_week(d.requests(spark, sf).select("request_id", "fips", "week"), d.recent_scores(spark, sf)).select(
        "request_id", "fips", "week", "week_of_season", "week_start", "overall_stress_index")


CONTEXT = NEAR + f""",
seen AS (SELECT r.request_id, coalesce(nullif(r.week, 0), c.current_week) AS current_week, s.* EXCLUDE (fips)
  FROM req r JOIN cur c ON r.fips = c.fips JOIN std s ON s.fips = r.fips
  AND s.week <= coalesce(nullif(r.week, 0), c.current_week)),
feat AS ({features_sql('request_id, current_week', 'seen')}),
fc AS (SELECT request_id, {POINT} AS raw, {LINEAR_UNC} AS u FROM feat),
ctx AS (SELECT r.request_id, r.message, r.fips, r.live AND r.fips IS NOT NULL AS on_, n.county_name, n.week_start,
  coalesce(n.week_of_season, r.week) AS week_of_season,
  coalesce(c_overall, n.overall_stress_index) AS overall_stress, coalesce(c_water, n.water_value) AS water_stress,
  n.heat_value AS heat_stress, n.vegetation_value AS vegetation_health, n.atmosphere_value AS atmospheric_stress,
  n.i_ndvi AS ndvi_raw, n.i_lst AS lst_raw, n.i_vpd AS vpd_raw, n.i_deficit AS water_raw,
  coalesce(nullif(c_yield, 0), greatest(50e0, least(300e0, raw))) AS predicted_yield,
  coalesce(nullif(c_spread, 0), u) AS yield_uncertainty, greatest(50e0, raw - u) AS lo, least(300e0, raw + u) AS hi
  FROM req r LEFT JOIN near n ON r.request_id = n.request_id LEFT JOIN fc ON r.request_id = fc.request_id)"""


def contexts(spark, sf):
    # both the week lookup and the forecast read the counties' last weeks, so they are written once
    requests, scores = d.requests(spark, sf), materialise(d.recent_scores(spark, sf), "recent")
    nearest = joins.nearest_week(requests.select("request_id", "fips", "week"), scores)
    records = forecast.season_to_date(scores)
    features = forecast.running_features(records, last_week=27).withColumnRenamed("current_week", "__w")
    newest = records.groupBy("fips").agg(F.max("week").alias("newest"))
    wanted = requests.select("request_id", "fips", "week").join(newest, "fips").withColumn(
        "current_week", F.coalesce(F.nullif("week", F.lit(0)), "newest"))
    matched = wanted.withColumn("__w", joins.target_week(F.col("current_week"))).join(features, ["fips", "__w"])
    answers = forecast.forecast(matched).withColumn("confidence_interval", F.col("forecast_uncertainty"))
    response = answers.select(
        "request_id", F.col("yield_forecast_bu_acre").alias("predicted_yield"), "confidence_interval",
        F.col("confidence_interval_lower").alias("confidence_lower"),
        F.col("confidence_interval_upper").alias("confidence_upper"), "primary_driver")
    return retrieval.chat_context(requests, nearest, response)


def _live(names) -> str:
    return ", ".join(f"CASE WHEN on_ THEN {r6(n)} END AS {n}" for n in names)


@query("chat_context", CONTEXT + f"""
--
SELECT request_id, fips, on_ AS has_stress, on_ AS has_yield, CASE WHEN on_ THEN coalesce(county_name, fips) END AS county_name,
  CASE WHEN on_ THEN CAST(week_start AS VARCHAR) END AS week_start, CASE WHEN on_ THEN week_of_season END AS week_of_season,
  {_live(('overall_stress', 'water_stress', 'heat_stress', 'vegetation_health', 'atmospheric_stress', 'ndvi_raw',
          'lst_raw', 'vpd_raw', 'water_raw', 'predicted_yield', 'yield_uncertainty'))},
  CASE WHEN on_ THEN {r6('lo')} END AS confidence_lower, CASE WHEN on_ THEN {r6('hi')} END AS confidence_upper,
  CASE WHEN on_ THEN 'Mixed stress factors' END AS primary_driver FROM ctx""")
def chat_context(spark, sf):
    return contexts(spark, sf).drop("message")


def _shown(name: str, digits: int) -> str:
    return f"coalesce(CAST({half_up(name, digits)} AS VARCHAR), 'N/A')"


PROMPTS = ASKED + "," + CONTEXT + f""",
docs AS (SELECT query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c,
  count(*) AS sources FROM mrank JOIN items ON id = item_id WHERE rank <= 5 GROUP BY query_id),
p AS (SELECT request_id, on_ AS has_live_data, coalesce(sources, 0) AS sources_used,
  concat_ws(chr(10), 'User Question: ' || message || chr(10),
  CASE WHEN on_ THEN concat(chr(10), 'LIVE STRESS DATA (Current Conditions):', chr(10), 'County: ', county_name, chr(10),
    'Date: ', CAST(week_start AS VARCHAR), chr(10), 'Week of Season: ', week_of_season, chr(10), chr(10),
    'Stress Indices (0-100 scale, higher = more stress):', chr(10),
    '- Overall Stress Index: ', {_shown('overall_stress', 2)}, chr(10), '- Water Stress: ', {_shown('water_stress', 2)}, chr(10),
    '- Heat Stress: ', {_shown('heat_stress', 2)}, chr(10), '- Vegetation Health: ', {_shown('vegetation_health', 2)}, chr(10),
    '- Atmospheric Stress: ', {_shown('atmospheric_stress', 2)}, chr(10), chr(10),
    'Raw Sensor Values (for reference):', chr(10), '- NDVI: ', {_shown('ndvi_raw', 3)}, chr(10), '- LST: ', {_shown('lst_raw', 3)},
    chr(10), '- VPD: ', {_shown('vpd_raw', 3)}, chr(10), '- Water Index: ', {_shown('water_raw', 3)}, chr(10)) END,
  CASE WHEN on_ THEN concat(chr(10), 'LIVE YIELD FORECAST:', chr(10), 'County: ', county_name, chr(10), 'Predicted Yield: ',
    {_shown('predicted_yield', 2)}, ' bu/acre', chr(10), 'Confidence: [', {_shown('lo', 2)}, ', ', {_shown('hi', 2)}, ']', chr(10),
    'Primary Driver: Mixed stress factors', chr(10)) END,
  CASE WHEN c IS NULL THEN chr(10) || 'No relevant documents found in knowledge base.'
    ELSE chr(10) || 'DOCUMENT CONTEXT (Retrieved from knowledge base):' || chr(10)
      || CASE WHEN length(c) > 3000 THEN substr(c, 1, 3000) || chr(10) || '... (truncated)' ELSE c END || chr(10) END,
  chr(10) || 'Please answer the user''s question using the information above.' || chr(10)
    || 'Prioritize live data for current conditions and use document context for background information.' || chr(10)) AS prompt
  FROM ctx LEFT JOIN docs ON query_id = md5(message))"""


def prompts(spark, sf):
    """Prompt of every request: its message finds the chunks, its county and week the live data."""
    hits, items = answered(spark, sf)
    texts = hits.join(items.select("item_id", "text"), "item_id").select("query_id", "rank", "text")
    asked = d.requests(spark, sf).select("request_id", F.md5("message").alias("query_id"))
    found = asked.join(texts, "query_id").select("request_id", "rank", "text")
    return retrieval.assemble_prompts(contexts(spark, sf), found)


@query("prompt_assembly", PROMPTS + """
--
SELECT request_id, md5(prompt) AS prompt, length(prompt) AS characters, has_live_data, sources_used FROM p""")
def prompt_assembly(spark, sf):
    return prompts(spark, sf).select(
        "request_id", F.md5("prompt").alias("prompt"), F.length("prompt").alias("characters"), "has_live_data", "sources_used")


@query("token_estimate", PROMPTS + """
--
SELECT request_id, length(prompt) // 4 AS tokens FROM p""")
def token_estimate(spark, sf):
    return prompts(spark, sf).select("request_id", retrieval.token_estimate(F.col("prompt")).alias("tokens"))

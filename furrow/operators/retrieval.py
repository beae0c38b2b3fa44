"""Document chunks, vectors, rankings and prompt assembly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.config import CHUNKING, PROMPT, Bm25, Chunking, PromptLayout
from furrow.functions.scalars import half_up
from furrow.functions.text import fixed_chunks, sentence_chunks, words
from furrow.operators.topk import SMALL_BYTES, best_k, blockwise_topk
from furrow.session import materialise


def skip_empty_docs(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.col(text).rlike(r"\S"))


def chunk(df: DataFrame, setting: Chunking = CHUNKING, sentence: bool = True, text: str = "text") -> DataFrame:
    """One row per chunk with its index; the document's other columns are kept."""
    pieces = sentence_chunks(F.col(text), setting) if sentence else fixed_chunks(F.col(text), setting)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(pieces).alias("chunk_index", "text"))


def with_chunk_metadata(chunks: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Source, file type, index and load time of every chunk, as one struct as well as columns."""
    loaded = F.current_timestamp() if loaded_at is None else loaded_at
    return chunks.withColumn("loaded_at", loaded)


def with_chunk_id(chunks: DataFrame, *keys: str) -> DataFrame:
    """Repeatable id from the source key and the chunk index."""
    parts = [F.col(k).cast("string") for k in (*keys, "chunk_index")]
    return chunks.withColumn("id", F.sha2(F.concat_ws("#", *parts), 256))


def term_bucket(term: str, dim: int) -> int:
    """Component of a term: the first eight hexadecimal digits of its MD5, modulo the length."""
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim


def _hashed_counts(tokens: Column, dim: int) -> Column:
    @F.pandas_udf("array<float>")
    def count(rows: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def one(words_of_row) -> np.ndarray:
            places = []
            for term in words_of_row:
                if term not in known:
                    known[term] = term_bucket(term, dim)
                places.append(known[term])
            return np.bincount(np.array(places, np.int64), minlength=dim).astype(np.float32)

        return rows.map(one)

    return count(tokens)


def _rows_by_component(counted: DataFrame) -> tuple[int, dict[int, int]]:
    """How many rows there are, and how many have each component; added up where the rows are read."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = 0, None
        for batch in batches:
            if batch.num_rows:
                counts = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                rows += batch.num_rows
                seen = (counts > 0).sum(axis=0) + (0 if seen is None else seen)
        if rows:
            places = np.append(-1, np.arange(len(seen)))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.append(rows, seen))], ["b", "n"])

    found = counted.select("embedding").mapInArrow(add, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    seen = {r["b"]: r["n"] for r in found.collect()}
    return seen.pop(-1, 0), seen


def embed(chunks: DataFrame, dim: int = 256, weights: Sequence[float] | None = None, text: str = "text"
          ) -> tuple[DataFrame, list[float]]:
    """Unit-length hashed term vectors weighted by inverse document frequency, and the weights.

    Weight of a component: ln((m + 1) / (df + 1)) over the m rows, of which df have it; queries are embedded with the
    weights of the corpus. The ``dim`` weights are all that comes to the driver. A text without a word is the zero vector.
    A corpus is counted once and written with its counts.
    """
    counted = chunks.withColumn("embedding", _hashed_counts(words(F.col(text)), dim))
    if weights is None:
        counted = materialise(counted, "counted")
        m, seen = _rows_by_component(counted)
        weights = [math.log((m + 1) / (seen.get(b, 0) + 1)) for b in range(dim)]
    scale = F.array(*[F.lit(float(w)) for w in weights])
    weighted = counted.withColumn("embedding", F.zip_with("embedding", scale, lambda n, w: n.cast("double") * w))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    unit = weighted.withColumn("__norm", norm)
    return unit.withColumn("embedding", F.transform("embedding", lambda x: F.when(F.col("__norm") > 0, x / F.col("__norm")).otherwise(
        0.0))).drop("__norm"), list(weights)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of unit length; a zero vector stays zero."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(flat), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


class _NearestSoFar:
    """The k items of highest cosine for each of a block of queries, among the items seen so far.

    Cosines are made in single precision first, whose error is bounded; only those that can still pass the k-th best are made
    in double precision, so the hits are those of double precision throughout.
    """

    def __init__(self, queries: pa.Table, k: int, matching: bool):
        self.ids, self.k, self.matching = queries["query_id"].combine_chunks(), k, matching
        self.exact = _matrix(queries["vector"])
        known = np.isfinite(self.exact).all(axis=1)
        if matching:
            known &= self.exact.any(axis=1)
        self.exact[~known] = 0.0
        self.quick = self.exact.astype(np.float32)
        # of a sum of products of unit vectors, and of the ninth digit that scores are rounded to
        self.error = (self.exact.shape[1] + 16) * 2.0 ** -24 + 2e-9
        self.floors = np.where(known, -np.inf, np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, items: pa.Table) -> None:
        exact = _matrix(items["vector"])
        known = np.isfinite(exact).all(axis=1)
        names = items["item_id"].combine_chunks()
        if not known.all():
            exact, names = exact[known], names.filter(pa.array(known))
        if not len(exact) or not len(self.exact):
            return
        quick = self.quick @ exact.astype(np.float32).T
        least = self.floors.copy()
        new = np.flatnonzero(np.isneginf(least))
        if len(exact) > self.k and len(new):
            least[new] = np.partition(quick[new], len(exact) - self.k, axis=1)[:, len(exact) - self.k] - self.error
        least = (least - self.error).astype(np.float32)
        rows = np.flatnonzero(quick.max(axis=1) >= least)
        near, columns = np.nonzero(quick[rows] >= least[rows, None])
        rows = rows[near]
        if not len(rows):
            return
        if len(rows) > len(exact) * len(self.exact) // 16:
            scores = (self.exact @ exact.T)[rows, columns]
        else:
            scores = np.concatenate([np.einsum("ij,ij->i", self.exact[rows[at:at + 20_000]], exact[columns[at:at + 20_000]])
                                     for at in range(0, len(rows), 20_000)])
        scores = np.round(scores, 9)
        kept = scores >= self.floors[rows]
        if self.matching:
            kept &= scores > 0
        rows = rows[kept]
        self.found.append((rows, scores[kept], names.take(pa.array(columns[kept]))))
        # floors are set as soon as there are any; later, a few hits at a time are not worth a sort
        if np.isneginf(self.floors[rows]).any() or sum(len(x[0]) for x in self.found) > 2 * self.k * len(self.exact):
            self._settle()

    def _settle(self) -> None:
        """Keep the best k of every query, ties by item, and note the k-th score."""
        rows, scores = (np.concatenate([x[at] for x in self.found]) for at in (0, 1))
        items = pa.concat_arrays([x[2] for x in self.found])
        place = np.argsort(np.argsort(items.to_numpy(zero_copy_only=False), kind="stable"))
        order = np.lexsort((place, -scores, rows))
        nth = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        last = order[nth == self.k - 1]
        self.floors[rows[last]] = scores[last]
        order = order[nth < self.k]
        self.found = [(rows[order], scores[order], items.take(pa.array(order)))]

    def best(self) -> pa.Table | None:
        if not self.found:
            return None
        self._settle()
        rows, scores, items = self.found[0]
        return pa.table({"query_id": self.ids.take(pa.array(rows)), "item_id": items, "score": pa.array(scores, pa.float64())})


@dataclass(frozen=True)
class _CosineKernel:
    matching: bool

    def running(self, queries: pa.Table, k: int) -> _NearestSoFar:
        return _NearestSoFar(queries, k, self.matching)


def check_k(k: int) -> int:
    """The number of hits a request may ask for."""
    if not 1 <= k <= 20:
        raise ValueError("k must lie between 1 and 20")
    return k


def in_collection(items: DataFrame, collection: str | None) -> DataFrame:
    """Items of a named collection, or all; with the table partitioned by it, a partition filter."""
    return items if collection is None else items.filter(F.col("collection") == collection)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, collection: str | None = None, matching: bool = False,
                **layout) -> DataFrame:
    """k nearest items by cosine; queries hold (query_id, vector), the corpus (item_id, vector).

    ``collection`` limits the search to one collection of the corpus; with ``matching`` only items with a cosine above
    zero are hits.
    """
    size = 8 * F.size("vector")
    return blockwise_topk(queries.select("query_id", "vector"), in_collection(corpus, collection).select("item_id", "vector"),
                          _CosineKernel(matching), k, size, size, **layout)


def query_result(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """Text, score and rank per hit with the number of hits of the query.

    Hits carry at most k rows per query, so the count runs over a bounded window.
    """
    found = ranked.groupBy("query_id").agg(F.count("*").alias("total_found"))
    return (ranked.join(texts.select("item_id", "text"), "item_id").join(found, "query_id")
            .select("query_id", "item_id", "text", "score", "rank", "total_found"))


def query_terms(queries: DataFrame, corpus_tokens: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Distinct terms per query with the inverse document frequency in the corpus, and its mean length.

    One pass over the corpus: only terms some query asks for are counted, once per
    document, and the empty term stands for the document itself, carrying its
    length. Terms of up to ``small_bytes`` travel to the tasks as the filter; beyond that all
    terms are counted first and the counts filtered. Either way the map tasks
    reduce before anything is shuffled, so frequent terms do not pile up. The
    counts, a row per asked term, are written out.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    whole = F.lit("")
    vocabulary = asked.select("term").unionByName(queries.select(whole.alias("term"))).distinct()
    present = corpus_tokens.select(
        F.size("tokens").alias("length"),
        F.explode(F.array_append(F.array_distinct("tokens"), whole)).alias("term"))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("term").agg(F.count("*").alias("df"), F.avg("length").alias("avgdl"))

    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    if size <= small_bytes:
        counts = counted(present.join(F.broadcast(vocabulary), "term", "left_semi"))
    else:
        counts = counted(present).join(vocabulary, "term", "left_semi")
    counts = materialise(counts, "term-counts")
    size = counts.filter(F.col("term") == "").select(F.struct(F.col("df").alias("n"), "avgdl").alias("s")).scalar()
    idf = F.log(F.lit(1.0) + (size["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = counts.select("term", idf.alias("idf"), size["avgdl"].alias("mean_length"))
    return (asked.join(weighted, "term").groupBy("query_id")
            .agg(F.collect_list(F.struct("term", "idf")).alias("t"), F.max("mean_length").alias("avgdl"))
            .select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf"), "avgdl"))


TERMS_AT_ONCE = 20_000
CELLS_AT_ONCE = 4_000_000


def _bm25_kernel(setting: Bm25):
    def kernel(queries: pa.Table, items: pa.Table, k: int) -> pa.Table:
        tokens = items["tokens"].combine_chunks()
        lengths = tokens.value_lengths().to_numpy()
        norm = setting.k1 * (1 - setting.b + setting.b * lengths / queries["avgdl"][0].as_py())
        per_query = queries["terms"].combine_chunks().value_lengths().to_numpy()
        # query groups of a bounded vocabulary keep the dense blocks small
        group = np.cumsum(per_query) // TERMS_AT_ONCE
        parts = [scored(queries.filter(pa.array(group == g)), tokens, lengths, norm, items["item_id"].combine_chunks(), k)
                 for g in np.unique(group)]
        return pa.concat_tables(parts)

    def scored(queries: pa.Table, tokens, lengths, norm, item_ids, k: int) -> pa.Table:
        terms = queries["terms"].combine_chunks()
        asked = terms.flatten()
        vocabulary = asked.unique()
        weights = np.zeros((len(terms), len(vocabulary)))
        owner = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy())
        weights[owner, pc.index_in(asked, vocabulary).to_numpy()] = queries["idf"].combine_chunks().flatten().to_numpy()
        codes = pc.index_in(tokens.flatten(), vocabulary)
        hit = codes.is_valid().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(tokens)), lengths)[hit]
        codes = codes.drop_null().to_numpy().astype(np.int64)
        step = max(1, CELLS_AT_ONCE // len(vocabulary))
        out = np.empty((len(terms), len(tokens)))
        for first in range(0, len(tokens), step):
            last = min(first + step, len(tokens))
            lo, hi = np.searchsorted(rows, (first, last))
            cells = (rows[lo:hi] - first) * len(vocabulary) + codes[lo:hi]
            tf = np.bincount(cells, minlength=(last - first) * len(vocabulary)).reshape(last - first, -1)
            saturated = tf * (setting.k1 + 1) / (tf + norm[first:last, None])
            out[:, first:last] = weights @ saturated.T
        out[out <= 0] = -np.inf
        return best_k(out, queries["query_id"].combine_chunks(), item_ids, k)

    return kernel


def bm25(queries: DataFrame, corpus: DataFrame, k: int = 5, setting: Bm25 = Bm25(), collection: str | None = None,
         **layout) -> DataFrame:
    """k best items by Okapi BM25; queries hold (query_id, text), the corpus (item_id, text).

    ``collection`` limits corpus and statistics to one collection. The tokens are written once and read twice.
    """
    tokens = in_collection(corpus, collection).select("item_id", words(F.col("text")).alias("tokens"))
    tokens = materialise(tokens, "tokens")
    terms = query_terms(queries, tokens, layout.get("small_bytes", SMALL_BYTES))

    def size(tokens_of: str) -> Column:
        return F.aggregate(tokens_of, F.lit(0), lambda s, t: s + F.octet_length(t) + 12)

    return blockwise_topk(terms, tokens, _bm25_kernel(setting), k, size("terms"), size("tokens"), **layout)


def rrf(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query_id, item_id, rank)."""
    both = None
    for ranking in rankings:
        part = ranking.select("query_id", "item_id", (F.lit(1.0) / (F.col("rank") + k)).alias("share"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("query_id", "item_id").agg(F.sum("share").alias("rrf_score"))


def retrieval_eval(judged: DataFrame, by: str = "query_type") -> DataFrame:
    """Mean share of relevant hits per query type, from (query_id, query_type, relevant)."""
    per_query = judged.groupBy(by, "query_id").agg(F.avg(F.col("relevant").cast("double")).alias("share"))
    return per_query.groupBy(by).agg(F.count("*").alias("queries"), F.avg("share").alias("mean_relevance"))


# Prompt texts.
STRESS_BLOCK = """
LIVE STRESS DATA (Current Conditions):
County: %s
Date: %s
Week of Season: %s

Stress Indices (0-100 scale, higher = more stress):
- Overall Stress Index: %s
- Water Stress: %s
- Heat Stress: %s
- Vegetation Health: %s
- Atmospheric Stress: %s

Raw Sensor Values (for reference):
- NDVI: %s
- LST: %s
- VPD: %s
- Water Index: %s
"""
YIELD_BLOCK = """
LIVE YIELD FORECAST:
County: %s
Predicted Yield: %s bu/acre
Confidence: [%s, %s]
Primary Driver: %s
"""
NO_DOCUMENTS = "\nNo relevant documents found in knowledge base."
CLOSING = """
Please answer the user's question using the information above.
Prioritize live data for current conditions and use document context for background information.
"""


def _filled(template: str, *values: Column) -> Column:
    texts = [F.coalesce(v.cast("string"), F.lit("N/A")) for v in values]
    return F.format_string(template, *texts)


def _shown(names: tuple[str, ...], digits: int) -> list[Column]:
    return [half_up(F.col(n), digits) for n in names]


def gathered_chunks(hits: DataFrame, layout: PromptLayout = PROMPT) -> DataFrame:
    """Chunk texts of each request in rank order, joined and cut; at most k texts per request."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    joined = hits.groupBy("request_id").agg(F.concat_ws(layout.separator, texts).alias("context"),
                                            F.count("*").alias("sources_used"))
    cut = F.concat(F.substring("context", 1, layout.limit), F.lit(layout.marker))
    return joined.withColumn("context", F.when(F.length("context") > layout.limit, cut).otherwise(F.col("context")))


def assemble_prompts(contexts: DataFrame, hits: DataFrame, layout: PromptLayout = PROMPT) -> DataFrame:
    """Prompt per request from its chat context and its ranked chunks.

    ``contexts`` comes from :func:`chat_context`; ``hits`` holds (request_id, rank, text).
    """
    c = contexts.join(gathered_chunks(hits, layout), "request_id", "left")
    county = F.coalesce("county_name", "fips", F.lit("Unknown"))
    live_stress = F.when(F.col("has_stress"), _filled(
        STRESS_BLOCK, county, F.col("week_start"), F.col("week_of_season"), *_shown(tuple(CLIENT_INDICES), 2),
        *_shown(("ndvi_raw", "lst_raw", "vpd_raw", "water_raw"), 3)))
    live_yield = F.when(F.col("has_yield"), _filled(
        YIELD_BLOCK, county, *_shown(("predicted_yield", "confidence_lower", "confidence_upper"), 2),
        F.col("primary_driver")))
    documents = F.when(F.length("context") > 0, F.concat(
        F.lit("\nDOCUMENT CONTEXT (Retrieved from knowledge base):\n"), F.col("context"), F.lit("\n"))
    ).otherwise(NO_DOCUMENTS)
    question = F.concat(F.lit("User Question: "), F.col("message"), F.lit("\n"))
    prompt = F.concat_ws("\n", question, live_stress, live_yield, documents, F.lit(CLOSING))
    return c.select("request_id", prompt.alias("prompt"),
                    (F.col("has_stress") | F.col("has_yield")).alias("has_live_data"),
                    F.coalesce("sources_used", F.lit(0)).alias("sources_used"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


# Client value -> sub-index of the score used where the client sends none.
CLIENT_INDICES = {
    "overall_stress": "overall_stress_index", "water_stress": "water_stress_index.value",
    "heat_stress": "heat_stress_index.value", "vegetation_health": "vegetation_health_index.value",
    "atmospheric_stress": "atmospheric_stress_index.value",
}


def chat_context(requests: DataFrame, nearest: DataFrame, forecasts: DataFrame, client_only: bool = False) -> DataFrame:
    """Live data of each request.

    ``nearest`` is the week row per request_id, ``forecasts`` the forecast per
    request_id. Index values of the client come first; where there are none the
    computed scores are used, unless ``client_only``. A client forecast of 0 counts
    as absent. Requests without a county or with live data switched off get none.
    """
    week = nearest.select(
        "request_id", "county_name", "week_start", "week_of_season",
        F.col("indicators")["ndvi_mean"].alias("ndvi_raw"), F.col("indicators")["lst_mean"].alias("lst_raw"),
        F.col("indicators")["vpd_mean"].alias("vpd_raw"),
        F.col("indicators")["water_deficit_mean"].alias("water_raw"),
        *[F.col(source).alias(f"__{name}") for name, source in CLIENT_INDICES.items()])
    yields = forecasts.select(
        "request_id", F.col("predicted_yield").alias("__yield"), F.col("confidence_interval").alias("__spread"),
        "confidence_lower", "confidence_upper", "primary_driver")
    joined = requests.join(week, "request_id", "left").join(yields, "request_id", "left")
    live = F.col("include_live_data") & F.col("fips").isNotNull()
    sent = F.lit(False)
    for name in (*CLIENT_INDICES, "predicted_yield", "yield_uncertainty"):
        sent = sent | F.col(name).isNotNull()
    known = F.col("week_of_season").isNotNull()

    def truthy(name: str, other: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit(0.0)), F.col(other))

    indices = {name: F.when(live, F.col(name) if client_only else F.coalesce(F.col(name), F.col(f"__{name}")))
               for name in CLIENT_INDICES}
    from_client = F.nullif(F.col("predicted_yield"), F.lit(0.0)).isNotNull()
    return joined.select(
        "request_id", "message", "fips",
        (live & (known | sent)).alias("has_stress"),
        (live & (F.col("__yield").isNotNull() | from_client)).alias("has_yield"),
        F.when(live, F.coalesce("county_name", "fips")).alias("county_name"),
        F.when(live, F.col("week_start")).alias("week_start"),
        F.when(live, F.coalesce("week_of_season", "week")).alias("week_of_season"),
        *[c.alias(n) for n, c in indices.items()],
        *[F.when(live, F.col(c)).alias(c) for c in ("ndvi_raw", "lst_raw", "vpd_raw", "water_raw")],
        F.when(live, truthy("predicted_yield", "__yield")).alias("predicted_yield"),
        F.when(live, truthy("yield_uncertainty", "__spread")).alias("yield_uncertainty"),
        *[F.when(live, F.col(c)).alias(c) for c in ("confidence_lower", "confidence_upper", "primary_driver")])

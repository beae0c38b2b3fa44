"""Personal data: four base kinds by rule, and further identifiers by bootstrapped contextual extraction.

DataFrame functions only. Positions are code points; the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import materialise

KINDS = ("email", "ip", "card", "phone", "secret")
# The published patterns, written so that a long run is scanned once: a match starts at a run's start (or where the
# last match ended), and repetition is possessive wherever giving back could not help.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SIGNS = r"._!@#$%^&*+/~-"
# What can fill a slot: a run of letters, digits and signs that ends in a letter or digit. It holds a digit among or after its
# first 64 characters, or follows "=" or ":" (and a quote) and holds a sign inside.
VALUE = (rf"(?:(?<![A-Za-z0-9])(?<![A-Za-z0-9][{SIGNS}])(?=[A-Za-z{SIGNS}]{{0,64}}+[0-9])"
         rf"|(?<=[:=]\x20{{0,2}}[\"']?)(?=[A-Za-z]++[{SIGNS}]++[A-Za-z]))"
         rf"[A-Za-z0-9]++(?:[{SIGNS}]++[A-Za-z0-9]++)*+")
# What stands between a name and its value.
SLOT = r"[A-Za-z0-9_][\"']?\s{0,2}[:=]\x20{0,2}[\"']?$"
# Names whose assigned value is a seed.
SEED_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is a multiple of ten."""
    def step(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


BLOCK = 256


def _lengths(name: str) -> Column:
    """Code points of every match and of what lies before it, added up."""
    return F.zip_with(F.slice(f"{name}_gaps", F.lit(1), F.size(f"{name}_found")), F.col(f"{name}_found"),
                      lambda gap, match: F.length(gap) + F.length(match))


def _total(steps: Column, first: Column, n: Column) -> Column:
    return F.aggregate(F.slice(steps, first, n), F.lit(0), lambda s, x: s + x)


def _blocks(name: str) -> Column:
    """Sums of the steps in blocks, so that a position costs a block and the number of blocks."""
    steps = F.col(f"{name}_steps")
    firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps)), F.lit(BLOCK))
    return F.transform(firsts, lambda first: _total(steps, first, F.lit(BLOCK)))


def _spans(name: str, valid) -> Column:
    """Array of (start, end, value, left, right) of the matches that pass; ``left`` and ``right`` reach to the next match."""
    steps, blocks, gaps = (F.col(f"{name}_{part}") for part in ("steps", "blocks", "gaps"))

    def span(m: Column) -> Column:
        block = ((m["at"] - m["at"] % BLOCK) / BLOCK).cast("int")
        before = _total(blocks, F.lit(1), block) + _total(steps, block * BLOCK + 1, m["at"] % BLOCK)
        left = F.get(gaps, m["at"])
        start = before + F.length(left)
        return F.struct(start.alias("start"), (start + F.length(m["value"])).alias("end"), m["value"].alias("value"),
                        F.substring(left, -64, 64).alias("left"), F.substring(F.get(gaps, m["at"] + 1), 1, 64).alias("right"))

    marked = F.transform(f"{name}_found", lambda m, i: F.struct(m.alias("value"), i.alias("at")))
    return F.transform(F.filter(marked, lambda m: valid(m["value"])), span)


def _passes_luhn(value: Column) -> Column:
    digits = _digits(value)
    return F.when(_between(F.length(digits), 14, 19), _luhn(digits)).otherwise(False)


#: Name, pattern, what a text must hold to be searched, test of a match.
SEARCHES = (
    ("email", EMAIL, ("@",), lambda v: F.lit(True)),
    ("ip", IP, (".",), lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
    ("card", CARD, (), _passes_luhn),
    ("phone", PHONE, ("+",), lambda v: _between(F.length(_digits(v)), 10, 15)),
    ("values", VALUE, None, lambda v: F.length(v) >= 4),
)


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, tid, base, candidates), one per row of ``docs``; ``tid`` hashes the whole text.

    ``base``: array of (start, kind, end, value, left, right), sorted; ``kind`` indexes :data:`KINDS`. ``candidates``: values
    outside the base spans that an identifier's context could hold: assigned to a name, of four characters or more; or
    anywhere, of six or more with a letter and a digit, or with nine digits. A null text
    is empty; an empty text has no spans. Matches that fail their test are dropped and not tried again. The steps are
    columns of their own, so that a text is searched once however many matches it has.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", text.rlike("[0-9]").alias("digit"))
    none, found = F.array().cast("array<string>"), []
    for name, pattern, needs, _ in SEARCHES:
        near = F.lit(True) if name == "email" or needs is None else F.col("digit")
        for sign in needs or ():
            near = near & F.contains(text, F.lit(sign))
        found.append(F.when(near, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{name}_found"))
    rows = rows.select("doc_id", "text", *found)
    names = [name for name, *_ in SEARCHES]
    gaps = [F.when(F.size(f"{name}_found") > 0, F.split(text, pattern, -1)).otherwise(none).alias(f"{name}_gaps")
            for name, pattern, *_ in SEARCHES]
    rows = rows.select("doc_id", F.xxhash64("text").alias("tid"), *[f"{n}_found" for n in names], *gaps)
    rows = rows.withColumns({f"{n}_steps": _lengths(n) for n in names}).withColumns({f"{n}_blocks": _blocks(n) for n in names})
    spans = rows.select("doc_id", "tid", *[_spans(name, valid).alias(name) for name, _, _, valid in SEARCHES])

    def of(kind: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"),
                                  *[s[c].alias(c) for c in ("value", "left", "right")])

    parts = [F.transform(F.col(name), of(kind)) for kind, name in enumerate(KINDS[:4])]
    spans = spans.select("doc_id", "tid", F.array_sort(F.concat(*parts)).alias("base"), "values")
    free = F.filter("values", lambda t: _fills(t) & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return spans.select("doc_id", "tid", "base", free.alias("candidates"))


def _fills(t: Column) -> Column:
    value, n_digits = t["value"], F.length(_digits(t["value"]))
    mixed = (n_digits > 0) & value.rlike("[A-Za-z]") & (F.length(value) >= 6)
    return t["left"].rlike(SLOT) | mixed | (n_digits >= 9)


def _contexts(left: Column, right: Column) -> Column:
    """Lexical patterns round an instance: the word before it, two and three words before it, the words on both sides.

    Blanks round "=" and ":" and quotes do not count, case neither. A text's beginning is no pattern.
    """
    before = F.regexp_replace(F.regexp_replace(F.lower(left), "[\"']", ""), r"\s*([:=])\s*", "$1 ")
    before = F.trim(F.regexp_replace(before, r"\s+", " "))
    after = F.regexp_extract(F.lower(right), r"^[\"']?\s*([^\s\"']+)", 1)
    one = F.regexp_extract(before, r"(\S+)$", 1)

    def words(n: int) -> Column:
        return F.regexp_extract(before, rf"((?:\S+ ){{{n - 1}}}\S+)$", 1)

    named = [("1 ", one), ("2 ", words(2)), ("3 ", words(3))]
    sided = F.when((one != "") & (after != ""), F.concat(F.lit("b "), one, F.lit(" _ "), after))
    return F.array(*[F.when(w != "", F.concat(F.lit(mark), w)) for mark, w in named], sided)


def discover(found: DataFrame, rounds: int = 4, threshold: float = 0.6, prior: float = 1.0,
             seed_names: tuple[str, ...] = SEED_NAMES) -> DataFrame:
    """Rows (value): candidates that score ``threshold`` or more in the pattern-instance graph.

    Instances are distinct values, so copies of a document add nothing. Seeds are the base entities and values
    assigned to a name of ``seed_names``; they score 1. In a round a pattern's confidence is the sum of its instances'
    scores over their number plus ``prior``, and a candidate scores the confidence of its best pattern: patterns of one
    place hold each other, so they are no independent evidence. All patterns are contexts; the look of a value counts
    for nothing, so a hash is taken only where the words round it stand round secrets. Patterns and scores are aggregates with
    map-side combine and an equi join that adaptive execution can split at a hot pattern. Only the graph is written; the
    rounds are one plan that grows by two joins a round. No candidate, or no base entity, is an empty side of the graph.
    """
    named = rf"(?i)(?<![a-z])(?:[a-z0-9]+[_-])?(?:{'|'.join(seed_names)})[\"']?\s*[=:]\s*[\"']?$"
    base = found.select(F.explode("base").alias("s")).select(
        F.concat(F.col("s.kind").cast("string"), F.lit(" "), F.col("s.value")).alias("value"),
        F.lit(True).alias("seed"), _contexts(F.col("s.left"), F.col("s.right")).alias("patterns"))
    values = found.select(F.explode("candidates").alias("s")).select(
        F.concat(F.lit("4 "), F.col("s.value")).alias("value"), F.col("s.left").rlike(named).alias("seed"),
        _contexts(F.col("s.left"), F.col("s.right")).alias("patterns"))
    edges = base.unionByName(values).select("value", "seed", F.explode("patterns").alias("pattern")).filter("pattern IS NOT NULL")
    edges = materialise(edges.groupBy("value", "pattern").agg(F.max("seed").alias("seed")), "edges")
    scores = edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(rounds):
        rated = edges.select("value", "pattern").join(scores, "value")
        confidence = rated.groupBy("pattern").agg((F.sum("score") / (F.count("*") + prior)).alias("confidence"))
        joined = edges.join(confidence, "pattern")
        scores = joined.groupBy("value").agg(F.when(F.max("seed"), 1.0).otherwise(F.max("confidence")).alias("score"))
    kept = scores.filter((F.col("score") >= threshold) & F.startswith("value", F.lit("4 ")))
    return kept.select(F.substring("value", 3, 1 << 30).alias("value"))


def spans(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, tid, base, spans), one per row of ``docs``; ``spans`` holds the base spans and those discovered.

    Both are sorted arrays of (start, kind, end). Rows that agree in doc_id and text get the same spans.
    """
    found = materialise(scan(docs), "pii")
    accepted = discover(found, **options)
    more = found.select(F.col("doc_id").alias("_id"), F.col("tid").alias("_tid"), F.explode("candidates").alias("c")).distinct()
    more = more.join(accepted, F.col("c.value") == F.col("value"), "left_semi").groupBy("_id", "_tid").agg(
        F.collect_list(F.struct(F.col("c.start").alias("start"), F.lit(4).alias("kind"), F.col("c.end").alias("end"))).alias("more"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    joined = found.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tid") == F.col("_tid")), "left")
    return joined.select("doc_id", "tid", plain.alias("base"), "more").select(
        "doc_id", "tid", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(
            F.array_sort(F.concat("base", "more"))).alias("spans"))


def digest(found: Column) -> Column:
    """Spans as text: kind:start:end by start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind.

    All rows and columns stay; ``n_chars``, where there is one, is counted anew. Texts without a span are unchanged,
    null texts stay null.
    """
    found = spans(docs, **options).filter(F.size("spans") > 0).select(
        F.col("doc_id").alias("_id"), F.col("tid").alias("_tid"), F.col("spans").alias("_spans")).distinct()
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text")
    joined = given.join(found, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_tid")), "left")

    def cut(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], gap, F.get(marks, s["kind"]))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_spans", start, cut, lambda s: F.concat(
        s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    clean = F.when(F.col("_spans").isNull(), text).otherwise(clean)
    out = joined.select("row", clean.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[new.get(c, F.col(f"row.`{c}`")) for c in docs.columns])

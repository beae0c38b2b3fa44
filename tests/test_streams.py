"""Streams over several arrivals, against the batch result."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from furrow.plans import all_queries
from furrow.plans.registry import QUERIES
from furrow.session import new_path
from furrow.sources.increments import keep_last
from furrow.streaming import alerts, streams, tiers

all_queries()
OBS = ("ts timestamp, fips string, county_name string, ndvi_mean double, lst_mean double, vpd_mean double, "
       "eto_mean double, pr_mean double, water_deficit_mean double, seq long")


def rows(spark, days, seq=0, value=30.0):
    start = dt.datetime(2024, 5, 1)
    return spark.createDataFrame(
        [(start + dt.timedelta(d), "1", "A", 0.5, value, 1.0, 4.0, 1.0, 3.0, seq + i) for i, d in enumerate(days)], OBS)


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_upsert_log_is_idempotent_and_keeps_last(spark):
    source, target, checkpoint = (new_path(spark, n) for n in ("src", "tgt", "chk"))
    keys, order = ["ts", "fips"], ["seq"]
    for seq, value in ((0, 30.0), (10, 31.0)):
        land(rows(spark, [0, 1, 1], seq, value), source)
        stream = spark.readStream.schema(OBS).parquet(source)
        streams.stream_upsert(stream, target, checkpoint, keys, order).awaitTermination()
    got = streams.read_upserted(spark, target, keys, order)
    batch = keep_last(spark.read.schema(OBS).parquet(source), keys, order)
    assert got.count() == 2 and got.select(*batch.columns).exceptAll(batch).count() == 0
    into = new_path(spark, "compact")
    streams.compact_upserted(spark, target, into, keys, order)
    assert streams.read_upserted(spark, into, keys, order).exceptAll(got).count() == 0
    # a second run without new files changes nothing
    stream = spark.readStream.schema(OBS).parquet(source)
    streams.stream_upsert(stream, target, checkpoint, keys, order).awaitTermination()
    assert streams.read_upserted(spark, target, keys, order).count() == 2


def arrive(spark, start, parts, one_by_one=True):
    """Log of a stream whose files arrive one after the other, or lie there at once."""
    source, target, checkpoint = (new_path(spark, n) for n in ("src", "tgt", "chk"))
    for part in parts:
        land(part, source)
        if one_by_one:
            start(spark.readStream.schema(OBS).parquet(source), target, checkpoint).awaitTermination()
    start(spark.readStream.schema(OBS).parquet(source), target, checkpoint).awaitTermination()
    return target


def parts_of(spark):
    """Days out of order, a repeat, and rows of a week that was passed long ago."""
    return [rows(spark, [0, 15, 3]), rows(spark, [8, 8], 10, 36.0), rows(spark, [2, 0], 20, 99.0), rows(spark, [], 30)]


def results(df):
    return sorted(map(repr, df.collect()))


def test_results_do_not_depend_on_the_split(spark):
    keys = ["ts", "fips"]
    runs = {
        "upsert": (lambda s, t, c: streams.stream_upsert(s, t, c, keys, ["seq"]),
                   lambda t: streams.read_upserted(spark, t, keys, ["seq"], by_arrival=False)),
        "dedup": (lambda s, t, c: streams.stream_dedup(s, t, c, keys), lambda t: streams.read_distinct(spark, t)),
        "weekly": (streams.stream_weekly, lambda t: streams.read_weekly(spark, t)),
        "freshness": (streams.stream_freshness, lambda t: streams.read_freshness(spark, t)),
    }
    for name, (start, read) in runs.items():
        parts = parts_of(spark)
        split = results(read(arrive(spark, start, parts)))
        backward = results(read(arrive(spark, start, parts[::-1])))
        together = results(read(arrive(spark, start, parts, one_by_one=False)))
        assert split == backward == together and split, name


def test_late_rows_count_and_the_open_week_is_marked(spark):
    got = {r["week_of_season"]: r for r in streams.read_weekly(spark, arrive(
        spark, streams.stream_weekly, parts_of(spark))).collect()}
    assert {w: r["lst_mean"] for w, r in got.items()} == {1: (30 + 30 + 99 + 99) / 4, 2: 36.0, 3: 30.0}
    assert {w: r["open"] for w, r in got.items()} == {1: False, 2: False, 3: True}


def test_scores_of_weeks(spark):
    target = arrive(spark, streams.stream_weekly, [rows(spark, [0, 3]), rows(spark, [9])])
    names = spark.createDataFrame([("1", "A")], "fips string, county_name string")
    r = {x["week_of_season"]: x for x in streams.read_scores(spark, target, names).collect()}
    assert set(r) == {1, 2} and r[1]["vegetation_health_index"]["value"] == 30.0 and r[1]["county_name"] == "A"


def test_freshness(spark):
    target = arrive(spark, streams.stream_freshness, [rows(spark, [0]), rows(spark, [9]).withColumn("fips", F.lit("2"))])
    got = {r["fips"]: r["stale"] for r in streams.read_freshness(spark, target).collect()}
    assert got == {"1": True, "2": False}


def test_tables_that_are_directories(spark, tmp_path):
    """The registered streams over a table of one file and over the same rows in three files."""
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    for name in ("events", "lineitem", "supplier"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        df.coalesce(1).write.parquet(str(whole / f"{name}.parquet"))
        df.repartition(3).write.parquet(str(parts / f"{name}.parquet"))
    for name in ("stream_upsert", "stream_dedup", "stream_weekly", "stream_score", "stream_freshness"):
        one, three = (results(QUERIES[name](spark, str(f))) for f in (whole, parts))
        assert one == three and one, name
        assert one == results(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def arrivals(spark, start, parts):
    """Run a stream after each arrival; its last progress after each one that had data."""
    source, target, checkpoint = (new_path(spark, n) for n in ("src", "tgt", "chk"))
    seen = []
    for part in parts:
        land(part, source)
        query = start(spark.readStream.schema(OBS).parquet(source), target, checkpoint)
        query.awaitTermination()
        seen.append(query.lastProgress)
    return target, seen


def gaps(days, limit, now):
    """Alerts and returns of one county, from its sorted days."""
    days, out = [d for d in days if d <= now], []
    for a, b in zip(days, days[1:]):
        if b - a > limit:
            out += [("silent", a, a + limit + 1), ("back", a, b)]
    return out + ([("silent", days[-1], days[-1] + limit + 1)] if days and now - days[-1] > limit else [])


def test_alerts_come_out_of_the_stream(spark):
    """Out of order within the delay, gaps inside and between arrivals, a return, and restarts that repeat nothing."""
    days = {"1": [[0, 1], [4, 3], [20, 19], [21], [22]], "2": [[0], [2], [], [21, 20], []], "3": [[1], [], [], [], [40]]}
    parts = []
    for k in range(5):
        per = [rows(spark, own[k]).withColumn("fips", F.lit(f)) for f, own in days.items()]
        parts.append(per[0].unionByName(per[1]).unionByName(per[2]))
    start = lambda s, t, c: alerts.stream_alerts(s, t, c, limit_days=5, delay="3 days")
    parts.append(rows(spark, []))
    target, _ = arrivals(spark, start, parts)
    base = dt.date(2024, 5, 1)
    got = sorted((r["fips"], r["event"], (r["last_seen"] - base).days, (r["day"] - base).days)
                 for r in spark.read.parquet(target).collect())
    want = sorted((f, *g) for f, own in days.items() for g in gaps(sorted(sum(own, [])), 5, 37))
    assert got == want and len(want) == 7


def test_weeks_close_in_the_stream_and_late_rows_are_counted(spark):
    """Twenty arrivals: state stays bounded, and closed weeks, late rows and the open rest add up to the batch result."""
    parts = [rows(spark, [3 * k, 3 * k + 1], 10 * k, 20.0 + k) for k in range(20)]
    parts[10] = parts[10].unionByName(rows(spark, [0, 2, 29], 500, 99.0))
    target, progress = arrivals(spark, streams.stream_weekly, parts)
    assert len(progress) == 20
    whole = streams._totals(streams.with_season_week(parts[0].unionByName(parts[0].limit(0))), streams.WEEK)
    for part in parts[1:]:
        whole = whole.unionByName(streams._totals(streams.with_season_week(part), streams.WEEK))
    want = {r["week_of_season"]: (r["rows"], r["lst_mean_sum"]) for r in whole.groupBy("week_of_season").agg(
        F.sum("rows").alias("rows"), F.sum("lst_sum").alias("lst_mean_sum")).collect()}
    closed = {r["week_of_season"]: r for r in streams._closed(spark, target).collect()}
    late = {r["week_of_season"]: r for r in streams.read_late(spark, target).collect()}
    assert sorted(closed) == list(range(1, 9)) and {w: r["rows"] for w, r in late.items()} == {1: 2}
    rest = {r["week_of_season"]: r for r in streams.read_rest(spark, target).filter("NOT late").collect()}
    for week, (number, total) in want.items():
        found = [x[week] for x in (closed, late, rest) if week in x]
        assert sum(r["rows"] for r in found) == number and abs(sum(r["lst_sum"] for r in found) - total) < 1e-9
    assert {r["week_of_season"] for r in streams.read_closed(spark, target).collect()} == set(closed)


def test_state_of_open_weeks_is_bounded(spark):
    source, target, checkpoint = (new_path(spark, n) for n in ("src", "tgt", "chk"))
    sizes = []
    for k in range(20):
        land(rows(spark, [7 * k, 7 * k + 6], 10 * k), source)
        query = (streams.closed_weeks(spark.readStream.schema(OBS).parquet(source)).writeStream.format("parquet")
                 .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        sizes.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert max(sizes) <= 2 and spark.read.parquet(target).count() == 19


def test_weeks_are_scored_in_the_stream(spark):
    names = spark.createDataFrame([("1", "A")], "fips string, county_name string")
    start = lambda s, t, c: streams.stream_score(s, t, c, names)
    parts = [rows(spark, [0, 3]), rows(spark, [9]), rows(spark, [16], value=40.0)]
    target, _ = arrivals(spark, start, parts)
    got = {r["week_of_season"]: r for r in spark.read.parquet(target).collect()}
    weekly, _ = arrivals(spark, streams.stream_weekly, parts)
    want = {r["week_of_season"]: r for r in streams.read_scores(spark, weekly, names).collect()}
    assert set(got) == {1, 2} and all(got[w] == want[w] for w in got)


def test_repeats_are_forgotten_after_the_horizon(spark):
    start = lambda s, t, c: streams.stream_dedup(s, t, c, ["ts", "fips"], "10 days")
    parts = [rows(spark, list(range(8))), rows(spark, [5, 6, 7, 8]), rows(spark, [8]), rows(spark, [60, 60]), rows(spark, [1, 60, 61])]
    target, progress = arrivals(spark, start, parts)
    base = dt.datetime(2024, 5, 1)
    got = sorted((r["ts"] - base).days for r in streams.read_distinct(spark, target).collect())
    assert got == [*range(9), 60, 61]  # day 1 of the last arrival is older than the watermark
    assert progress[1].stateOperators[0].numRowsTotal == 9 and progress[-1].stateOperators[0].numRowsTotal == 2


def test_tiers(spark):
    assert [tiers.tier((0, n - 1), 4) for n in (1, 2, 4, 5, 16, 17)] == [0, 1, 1, 2, 2, 3]
    assert tiers.live_runs([(0, 0), (1, 1), (0, 1), (2, 2), (4, 4)]) == [(0, 1), (2, 2), (4, 4)]


def test_runs_are_merged_and_one_bucket_answers_a_lookup(spark):
    target, keys, order = new_path(spark, "tiers"), ["k"], ["seq"]
    want, by_seq = {}, {}
    runs = []
    for batch in range(24):
        part = [(k, (batch * 7 + k * 5) % 11, batch * 100 + k) for k in {(batch * 3 + j) % 20 for j in range(4)}]
        for k, seq, v in part:
            want[k] = v
            if (seq, batch) >= by_seq.get(k, ((-1, -1), 0))[0]:
                by_seq[k] = ((seq, batch), v)
        tiers.add_batch(spark.createDataFrame(part, "k long, seq long, v long"), batch, target, keys, order, 4, 3)
        runs.append(len(tiers.live_runs(tiers.written_runs(spark, target))))
    assert max(runs) <= 2 * 4  # below three runs in each of four tiers
    read = lambda **more: {r["k"]: r["v"] for r in tiers.read_current(spark, target, keys, order, buckets=4, **more).collect()}
    assert read() == want and read(by_arrival=False) == {k: v for k, (_, v) in by_seq.items()}
    found = tiers.read_current(spark, target, keys, order, buckets=4, where={"k": 7})
    assert [r["v"] for r in found.collect()] == [want[7]]
    live = len(tiers.live_runs(tiers.written_runs(spark, target)))
    files = {f for f in found.inputFiles()}
    assert len(files) <= 4 * live  # listing; the plan reads one bucket of each
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().toString()
    # a merge that died half way counts for nothing, and a batch that is run again changes nothing
    half = spark.createDataFrame([(7, 99, -1, 0, 0)], "k long, seq long, v long, batch long, bucket int")
    half.write.partitionBy("bucket").parquet(f"{target}/run=0_99")
    jvm, path = tiers._files(spark, f"{target}/run=0_99/_SUCCESS")
    jvm.delete(path, False)
    assert read() == want
    tiers.add_batch(spark.createDataFrame(part, "k long, seq long, v long"), 23, target, keys, order, 4, 3)
    assert read() == want
    assert tiers.drop_replaced(spark, target) > 0 and read() == want


class KeptState:
    """Value and list state, and the timers, of one county."""

    def __init__(self):
        self.held, self.timers, self.registered = {}, set(), 0

    def getValueState(self, name, schema):
        return _Held(self.held, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.registered += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.now


class _Held:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return self.name in self.held

    def get(self):
        return self.held[self.name]

    def put(self, value):
        self.held[self.name] = value

    update = put

    def clear(self):
        del self.held[self.name]


def test_a_county_has_one_timer_for_all_its_open_days():
    state = KeptState()
    watch = alerts.SilenceWatch(2)
    watch.init(state)

    def arrive(*days):
        list(watch.handleInputRows(("a",), iter([pd.DataFrame({"day": pd.to_datetime([f"2024-05-{d:02}" for d in days])})]), state))

    def pass_to(day):
        state.now, told = int(pd.Timestamp(f"2024-05-{day:02}").timestamp() * 1000), []
        for at in sorted(t for t in state.timers if t <= state.now):
            state.timers.discard(at)
            told += [tuple(r) for part in watch.handleExpiredTimer(("a",), state, None) for r in part[["event", "day"]].values]
        return [(event, day.day) for event, day in told]

    arrive(8, *range(12, 22))
    assert state.registered == 1
    arrive(5)  # an earlier day moves the timer
    assert pass_to(13) == [("silent", 8), ("back", 8), ("silent", 11), ("back", 12)]
    assert pass_to(18) == [] and pass_to(21) == []
    assert pass_to(24) == [("silent", 24)]
    assert state.registered < 10 and not state.timers

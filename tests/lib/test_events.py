"""Event time, keyed state, as-of joins and summaries."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.operators import asof, summary
from lodestar.sources import files
from lodestar.streaming import events

START = datetime(2024, 1, 1)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, START + timedelta(seconds=s), u, "view", v, None) for i, s, u, v in rows], events.EVENTS)


def drop(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_rows_behind_the_watermark_are_dropped_and_windows_come_once(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    of = lambda: events.windowed(events.read_events(spark, source), events.tumbling("ts", "1 minute"), "ts", ["event_type"], "30 seconds", F.count("*").alias("n"))
    drop(rows_of(spark, [(0, 10, 1, 1.0), (1, 50, 1, 1.0), (2, 70, 1, 1.0)]), source)
    events.written(of(), out, check)
    drop(rows_of(spark, [(3, 55, 1, 1.0), (4, 200, 1, 1.0)]), source)  # 55 is in time: the watermark is at 40
    events.written(of(), out, check)
    drop(rows_of(spark, [(5, 30, 1, 1.0), (6, 65, 1, 1.0), (7, 400, 1, 1.0)]), source)  # 30 and 65 are late: it is at 170
    events.written(of(), out, check)
    got = sorted(((r.start - START).seconds, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(0, 3), (60, 1), (180, 1)]


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    of = lambda: events.user_sessions(events.read_events(spark, source), 60, "2 minutes")
    drop(rows_of(spark, [(0, 0, 1, 1.0), (1, 30, 1, None), (2, 0, 2, 5.0)]), source)
    events.written(of(), out, check)
    drop(rows_of(spark, [(3, 130, 1, 2.0), (4, 85, 1, 3.0), (5, 300, 2, 1.0)]), source)  # 85 joins 30 and 130 to one session
    events.written(of(), out, check)
    events.written(of(), out, check)
    drop(rows_of(spark, [(6, 2000, 9, 0.0)]), source)
    events.written(of(), out, check)
    got = sorted((r.user_id, (r.first - START).seconds, (r["last"] - START).seconds, r.n, r.total, r.first_event, r.last_event) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, 130, 4, 6.0, 0, 3), (2, 0, 0, 1, 5.0, 2, 2), (2, 300, 300, 1, 1.0, 5, 5)]


@pytest.mark.parametrize("piece", [7, 1000])
def test_as_of_equals_a_walk_and_cuts_a_hot_key(spark, piece):
    draw = random.Random(2)
    user = lambda: draw.choice([1, 1, 1, 1, 2, 3, None])
    time = lambda: None if draw.random() < 0.05 else START + timedelta(seconds=draw.randint(0, 400))
    left, right = [(i, user(), time()) for i in range(150)], [(i, user(), time()) for i in range(120)]
    a, b = spark.createDataFrame(left, "id long, u long, t timestamp"), spark.createDataFrame(right, "id long, u long, t timestamp")
    got = {r.id: (r.id_then, r.t_then) for r in asof.as_of_join(a, b, ["u"], "t", "20 seconds", "id", piece=piece).collect()}
    want = {}
    for i, u, t in left:
        fits = [(rt, ri) for ri, ru, rt in right if u is not None and t is not None and ru == u and rt is not None and rt <= t]
        best = max(fits, default=None)
        want[i] = (best[1], best[0]) if best and best[0] >= t - timedelta(seconds=20) else (None, None)
    assert got == want
    if piece == 7:
        rows = a.select(F.col("t").alias("_time")).filter("_time is not null")
        assert rows.select(asof.pieces_of(rows, "_time", 7).alias("p")).distinct().count() > 10
    assert asof.as_of_join(a, b.limit(0), ["u"], "t").filter("id_then is not null").count() == 0
    assert asof.as_of_join(a.limit(0), b, ["u"], "t").count() == 0


def test_past_of_each_row(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice("ab"), None if i == 7 else START + timedelta(seconds=draw.randint(0, 90)), float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, k string, t timestamp, v double")
    got = {r.i: (r.n, r.s) for r in summary.over_past(df, ["k"], "t", 10, n=F.count("*"), s=F.sum("v")).collect()}
    for i, k, t, _ in rows:
        past = [v for _, k2, t2, v in rows if k2 == k and t and t2 and timedelta(0) < t - t2 <= timedelta(seconds=10)]
        assert got[i] == ((len(past), sum(past) if past else None) if t else (None, None))


def test_percentile_of_the_past_equals_sparks(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(["a", "b", None]), None if i == 7 else START + timedelta(seconds=draw.randint(0, 90)), None if i % 9 == 0 else draw.choice([float("nan"), -1.5, i / 7])) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k string, t timestamp, v double")
    for piece in (None, 35):
        want = summary.over_past(df, ["k"], "t", 10, piece, n=F.count("*"), percentile=F.percentile("v", 0.95)).select("i", "n", "percentile")
        assert sorted(map(str, summary.percentile_of_past(df, ["k"], "t", "v", 10, 0.95, piece).select("i", "n", "percentile").collect())) == sorted(map(str, want.collect()))


def test_percentile_of_the_past_costs_no_frames(spark):
    """200,000 rows within an hour, whose frames hold 20 thousand million rows."""
    rows = spark.range(200_000).select(F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 18_000).alias("t"), F.lit("a").alias("k"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    found = summary.percentile_of_past(rows, ["k"], "t", "v", 3600, 0.95)
    assert found.agg(F.max("n"), F.sum("n")).first()[:] == (199_999, 200_000 * 199_999 // 2)
    last = found.orderBy(F.desc("n")).first().percentile
    want = sorted(i * 7919 % 200_003 for i in range(199_999))
    at = 199_998 * 0.95
    assert last == pytest.approx(want[int(at)] + (at - int(at)) * (want[int(at) + 1] - want[int(at)]), abs=1e-6)


def test_changes_of_versions_equal_multiset_operations(spark):
    before = spark.createDataFrame([("x", 1)] * 3 + [("y", None)] * 2 + [("z", 2)], "a string, b int")
    after = spark.createDataFrame([("x", 1)] * 5 + [("y", None)] + [("w", 2)], "a string, b int")
    found = {(r.a, r.b): (r.was, r.now) for r in summary.changes(before, after).collect()}
    assert found == {("x", 1): (3, 5), ("y", None): (2, 1), ("z", 2): (1, 0), ("w", 2): (0, 1)}
    more = sorted(map(str, after.exceptAll(before).collect()))
    told = summary.changes(before, after).filter("now > was").select("a", "b", F.explode(F.sequence(F.lit(1), (F.col("now") - F.col("was")).cast("int")))).select("a", "b")
    assert sorted(map(str, told.collect())) == more
    assert sorted(map(str, summary.common(before, after).select("a", "b", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("a", "b").collect())) == sorted(map(str, before.intersectAll(after).collect()))


def test_sketches_of_days_merge_to_those_of_weeks(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("d"), F.col("id").cast("double").alias("v"), (F.col("id") % 900).alias("u"))
    daily = summary.sketched(df, ["d"], "v", "u")
    got = summary.estimated(summary.merged(daily, []), {"p50": 0.5, "p95": 0.95}).first()
    errors = summary.Errors()
    assert got.n == 20_000 and abs(got.p50 / 20_000 - 0.5) < 3 * errors.rank and abs(got.p95 / 20_000 - 0.95) < 3 * errors.rank
    assert abs(got.distinct_names - 900) < 3 * errors.distinct * 900


def test_a_file_too_long_to_show_is_refused(spark):
    rows = spark.createDataFrame([("a", "x\n" * 5), ("b", "x\ny")], "path string, text string")
    assert files.file_lines(rows, "b", 4).count() == 2
    with pytest.raises(Exception, match="too many lines"):
        files.file_lines(rows, "a", 4).collect()

"""Queries over the event stream and over versions of tables, and the SQL they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import asof, inverted, lexical, summary
from ..sources import store
from ..streaming import events
from . import oracle
from .queries import _BM25, TOP, docs, query, questions, table

HOUR, LATE = 3600, "10 minutes"


def streamed(spark, sf_dir, of) -> tuple:
    """What a stream over the events table gives, run to its end: ``of`` makes the stream that is written."""
    root = f"{store.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = of(events.read_events(spark, f"{sf_dir}/events.parquet", 1_000_000, table(spark, sf_dir, "events").schema))
    events.written(stream, f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def told(time: str):
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(time)


# what the watermark has passed when the stream has read all events
_PASSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
_SESSIONS = """o AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o)"""


@query(
    f"""WITH {_SESSIONS}, t AS (SELECT 'tumbling' AS kind, NULL::BIGINT AS user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, sum(value) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL),
l AS (SELECT 'sliding' AS kind, NULL::BIGINT AS user_id, event_type, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 15 MINUTE AS start, count(*) AS n, sum(value) AS total FROM events, range(4) r(k) WHERE ts IS NOT NULL GROUP BY ALL),
s AS (SELECT 'session' AS kind, user_id, NULL::VARCHAR AS event_type, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, sum(value) AS total FROM u GROUP BY user_id, s),
a AS (SELECT kind, user_id, event_type, start, start + INTERVAL 1 HOUR AS stop, n, total FROM t UNION ALL SELECT kind, user_id, event_type, start, start + INTERVAL 1 HOUR, n, total FROM l UNION ALL SELECT * FROM s)
SELECT kind, user_id, event_type, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(stop, '%Y-%m-%d %H:%M:%S.%f') AS stop, n, round(total, 4) AS total FROM a WHERE stop <= date_trunc('millisecond', {_PASSED})"""
)
def event_windows(spark, sf_dir):
    """Tumbling, sliding and session windows over the stream of events, each once, when the watermark has passed it."""
    measures = [F.count("*").alias("n"), F.sum("value").alias("total")]
    kinds = {
        "tumbling": lambda e: events.windowed(e, events.tumbling("ts", "1 hour"), "ts", ["event_type"], LATE, *measures),
        "sliding": lambda e: events.windowed(e, events.sliding("ts", "1 hour", "15 minutes"), "ts", ["event_type"], LATE, *measures),
        "session": lambda e: events.windowed(e.filter("user_id IS NOT NULL"), events.sessions("ts", "30 minutes"), "ts", ["user_id"], LATE, *measures),
    }
    rows = None
    for kind, of in kinds.items():
        part = streamed(spark, sf_dir, of)
        part = part.withColumns({c: F.lit(None).cast(t) for c, t in (("user_id", "long"), ("event_type", "string")) if c not in part.columns})
        part = part.select(F.lit(kind).alias("kind"), "user_id", "event_type", told("start"), told("stop"), "n", F.round("total", 4).alias("total"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(
    f"""WITH {_SESSIONS} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n, round(sum(value), 4) AS total, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event
FROM u GROUP BY user_id, s HAVING epoch_ms(max(ts) + INTERVAL 30 MINUTE) + 1 <= epoch_ms({_PASSED})"""
)
def user_sessions(spark, sf_dir):
    """Sessions of users as keyed state with a timer: those that the watermark has passed."""
    rows = streamed(spark, sf_dir, lambda e: events.user_sessions(e, 1800, LATE))
    return rows.select("user_id", told("first"), told("last"), "n", F.round("total", 4).alias("total"), "first_event", "last_event")


@query(
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'),
j AS (SELECT p.event_id, p.user_id, v.event_id AS seen, v.value, p.ts - v.ts AS gap FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts)
SELECT event_id, user_id, CASE WHEN gap <= INTERVAL 1 HOUR THEN seen END AS seen, CASE WHEN gap <= INTERVAL 1 HOUR THEN value END AS seen_value FROM j"""
)
def events_as_of(spark, sf_dir):
    """Every purchase with the latest view of the same user in the hour before it."""
    rows = table(spark, sf_dir, "events")
    views = rows.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"), F.col("value").alias("seen_value"))
    found = asof.as_of_join(rows.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "1 hour", "seen")
    return found.select("event_id", "user_id", "seen", "seen_value")


@query(
    """WITH e AS (SELECT *, date_trunc('week', ts)::DATE AS week FROM events)
SELECT week::VARCHAR AS week, event_type, count(*) AS n, true AS p50_fits, true AS p95_fits, true AS users_fit FROM e GROUP BY ALL"""
)
def event_sketches(spark, sf_dir):
    """p50, p95 and users of each week and type from sketches stored by day, held against exact ranks and counts: both within three
    times the stated error."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    daily = store.settle(summary.sketched(rows, ["day", "event_type"], "value", "user_id"))
    week = F.date_trunc("week", F.col("day")).cast("date").alias("week")
    told = summary.estimated(summary.merged(daily, [week, "event_type"]), {"p50": 0.5, "p95": 0.95}, "users")
    each = rows.select(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type", "value", "user_id").join(told, ["week", "event_type"])
    share = lambda p, q: F.abs(F.count_if(F.col("value") <= F.col(p)) / F.count("value") - q)
    errors = summary.Errors()
    # a rank is known to one row at best
    fits = lambda p, q: share(p, q) <= 3 * errors.rank + 1 / F.count("value")
    users = F.countDistinct("user_id")
    found = each.groupBy("week", "event_type").agg(F.count("*").alias("n"), fits("p50", 0.5).alias("p50_fits"), fits("p95", 0.95).alias("p95_fits"), (F.abs(F.max("users") - users) <= 3 * errors.distinct * users + 1).alias("users_fit"))
    return found.withColumn("week", F.col("week").cast("string"))


@query(
    """SELECT grouping(event_type, day, big) AS grouping, event_type, day::VARCHAR AS day, big, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT event_type, ts::DATE AS day, value >= 50 AS big, value FROM events) GROUP BY GROUPING SETS ((event_type, day), (event_type, big), (day), ())"""
)
def event_grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), (F.col("value") >= 50).alias("big"), "value")
    found = summary.grouping_sets(rows, [["event_type", "day"], ["event_type", "big"], ["day"], []], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("grouping").cast("long").alias("grouping"), "event_type", "day", "big", "n", "total")


@query(
    """SELECT grouping(lang, source, long) AS grouping, lang, source, long, count(*) AS n, sum(n_chars)::BIGINT AS chars
FROM (SELECT lang, source, n_chars >= 1000 AS long, n_chars FROM documents) GROUP BY CUBE (lang, source, long)"""
)
def document_cube(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "source", (F.col("n_chars") >= 1000).alias("long"), "n_chars")
    found = summary.cube(rows, ["lang", "source", "long"], F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return found.select(F.col("grouping").cast("long").alias("grouping"), "lang", "source", "long", "n", "chars")


@query(
    """SELECT event_id, count(*) OVER w AS n, quantile_cont(value, 0.95) OVER w AS p95 FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)"""
)
def p95_of_the_hour_before(spark, sf_dir):
    """Of each event, how many of its type came in the hour before, and the 95th percentile of their values."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    found = summary.percentile_of_past(rows, ["event_type"], "ts", "value", HOUR, 0.95, 4 * HOUR)
    return found.select("event_id", "n", F.col("percentile").alias("p95"))


@query(
    """WITH b AS (SELECT md5(text) AS text, lang FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT md5(CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END) AS text, lang FROM documents WHERE doc_id % 11 <> 0),
c AS (SELECT text, lang, sum(w)::BIGINT AS was, sum(n)::BIGINT AS now FROM (SELECT *, 1 AS w, 0 AS n FROM b UNION ALL SELECT *, 0, 1 FROM a) GROUP BY text, lang)
SELECT text, lang, was, now, least(was, now) AS both FROM c WHERE was <> now"""
)
def version_changes(spark, sf_dir):
    """What changed between two versions of the documents, repeated texts counted."""
    rows = table(spark, sf_dir, "documents")
    digest = lambda text: F.md5(text.cast("binary")).alias("text")
    before = rows.filter("doc_id % 7 <> 0").select(digest(F.col("text")), "lang")
    after = rows.filter("doc_id % 11 <> 0").select(digest(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))), "lang")
    return summary.changes(before, after).withColumn("both", F.least("was", "now"))


@query(f"WITH {_BM25}, {oracle.top('h', 's', TOP)} SELECT qid, doc, rank, round(score, 6) AS score FROM h")
def bm25_after_changes(spark, sf_dir):
    """BM25 over an inverted index of older documents, of which some were edited, some deleted and some added since: what changed is all
    that is read, and hits are those of the documents as they are now."""
    now = docs(spark, sf_dir)
    edited = F.pmod("doc", F.lit(10)) == 0
    older = now.filter(F.pmod("doc", F.lit(7)) != 0).withColumn("text", F.when(edited, F.concat(F.coalesce("text", F.lit("")), F.lit("\nan old last line"))).otherwise(F.col("text")))
    deleted = now.filter(F.pmod("doc", F.lit(13)) == 0).withColumn("doc", -1 - F.col("doc"))
    before = older.unionByName(deleted)
    lost, added = before.filter((F.col("doc") < 0) | edited), now.filter((F.pmod("doc", F.lit(7)) == 0) | edited)
    # the old counts of what is lost are worked out again, which is less than to keep those of all documents
    index = inverted.update(inverted.invert(lexical.uncounted(before)), lexical.uncounted(lost), lexical.uncounted(added))
    return inverted.top_k(index, lexical.query_terms(questions(spark, sf_dir)), TOP).select("qid", "doc", "rank", F.round("score", 6).alias("score"))

"""Retrieval, trace and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import few

ALL = "(all)"


def gold_targets(gold: DataFrame) -> DataFrame:
    """(qid, type, n, path, line): one row for each target of ``gold`` (qid, type, targets)."""
    return gold.select("qid", "type", F.posexplode("targets").alias("n", "t")).select("qid", "type", "n", "t.path", "t.line")


def first_ranks(gold: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, type, rank): place of the first hit that holds a gold line, null for a miss."""
    placed = chunks.select("doc", "path", "start_line", "end_line").join(few(hits.select("qid", "pos", "doc")), "doc")
    met = gold_targets(gold).join(placed, ["qid", "path"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return gold.select("qid", "type").join(met.groupBy("qid").agg(F.min("pos").alias("rank")), "qid", "left")


def by_type(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates for each type and, as type "(all)", for all rows."""
    total = F.when(F.grouping("type") == 1, F.lit(ALL)).otherwise(F.col("type"))
    return rows.rollup("type").agg(*aggregates, total.alias("_type")).drop("type").withColumnRenamed("_type", "type")


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """(type, n, recall, mrr, hit1) from (type, rank)."""
    n = F.count("*")
    mean = lambda c: F.round(F.sum(c) / n, 6)
    found = F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)
    return by_type(
        ranks, n.alias("n"), mean(found).alias("recall"), mean(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), mean(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("hit1")
    )


def latency(rows: DataFrame, value: str, by: list[str], accuracy: int = 10_000) -> DataFrame:
    """(by, n, p50, p95): values at places n // 2 and min(n - 1, int(0.95 n)) of the sorted group, from 0.

    Exact selection without sorting a group: approximate percentiles bound each place from both sides, values below the bound are
    counted, and only the few in between (about 8 in ``accuracy``; all of a group of up to ``accuracy`` rows) are ranked.
    """
    held = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    margin = 4 / accuracy
    shares = {"p50": 0.5, "p95": 0.95}
    ends = [max(0.0, min(1.0, p + side * margin)) for p in shares.values() for side in (-1, 1)]
    bounds = held.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", ends, accuracy).alias("_q"))
    small = F.col("n") <= accuracy
    targets = F.array(
        *(
            F.struct(F.lit(name).alias("name"), place.alias("place"), F.get("_q", F.lit(2 * i)).alias("low"), F.get("_q", F.lit(2 * i + 1)).alias("high"))
            for i, (name, place) in enumerate({"p50": F.floor(F.col("n") / 2), "p95": F.least(F.col("n") - 1, F.floor(F.lit(0.95) * F.col("n")))}.items())
        )
    )
    keyed = held.join(bounds.select(*by, "n", targets.alias("_t")), by)
    below = keyed.select(*by, F.inline("_t"), "n", "_v").filter((F.col("_v") < F.col("low")) & ~small).groupBy(*by, "name").agg(F.count("*").alias("_below"))
    near = keyed.select(*by, F.inline("_t"), "n", "_v").filter(small | F.col("_v").between(F.col("low"), F.col("high")))
    near = near.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "name").orderBy("_v")) - 1).join(below, [*by, "name"], "left")
    hit = near.filter(F.col("_i") + F.coalesce("_below", F.lit(0)) == F.col("place"))
    return hit.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in shares))


def covered(gold: DataFrame, hits: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """(qid, name): share of a question's targets that lie in one of its hits."""
    targets = gold_targets(gold)
    placed = chunks.select("doc", "path", "start_line", "end_line").join(few(hits.select("qid", "doc").distinct()), "doc").select("qid", "path", "start_line", "end_line")
    met = targets.join(placed, ["qid", "path"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("qid", "n").distinct().withColumn("met", F.lit(1))
    return targets.join(met, ["qid", "n"], "left").groupBy("qid").agg((F.count("met") / F.count("*")).alias(name))


def trace_metrics(gold: DataFrame, chunks: DataFrame, hits: DataFrame, baseline: DataFrame, expanded: DataFrame) -> DataFrame:
    """(type, n, mean_added, and for topk, baseline and expand the mean share of targets and the share of questions with all).

    hits: the top k. expanded: hits and what the graph added. baseline: as many hits as expanded has, without the graph.
    """
    added = expanded.groupBy("qid").agg(F.countDistinct("doc").alias("_e")).join(hits.groupBy("qid").agg(F.countDistinct("doc").alias("_h")), "qid", "left")
    rows = gold.select("qid", "type").join(added.select("qid", (F.col("_e") - F.coalesce("_h", F.lit(0))).alias("added")), "qid", "left")
    aggregates = [F.count("*").alias("n"), F.round(F.avg(F.coalesce("added", F.lit(0))), 6).alias("mean_added")]
    for name, found in (("topk", hits), ("baseline", baseline), ("expand", expanded)):
        rows = rows.join(covered(gold, found, chunks, name), "qid", "left")
        aggregates += [F.round(F.avg(name), 6).alias(f"{name}_recall"), F.round(F.avg(F.when(F.col(name) == 1, 1.0).otherwise(0.0)), 6).alias(f"{name}_all")]
    return by_type(rows, *aggregates)


def answer_metrics(gold: DataFrame, answers: DataFrame, reports: DataFrame) -> DataFrame:
    """One row over ``answers`` (qid, text, repaired) with their ``reports``.

    gold_cited: a valid citation holds a gold line. valid_rate: citations that are not invalid (invalid ranges count once an answer).
    claims_cited: claims with a citation. unsupported_per_answer, mean_width (mean of the answers' means), repaired: a count.
    """
    cites = answers.join(reports.select("qid", "invalid"), "qid").select("qid", "invalid", F.explode(T.citations("text")).alias("c")).select("qid", "invalid", "c.*")
    spelled = F.concat(F.col("path"), F.lit(":"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    valid = cites.filter(~F.array_contains("invalid", spelled)).select("qid", "path", "first", "last")
    met = gold_targets(gold).join(valid, ["qid", "path"]).filter("first <= line and line <= last").select("qid").distinct().withColumn("hit", F.lit(1.0))
    rows = answers.select("qid", "repaired").join(reports, "qid").join(met, "qid", "left")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = F.count("*")
    return rows.agg(
        n.alias("n"), F.round(ratio(F.sum(F.coalesce("hit", F.lit(0.0))), n), 6).alias("gold_cited"),
        F.round(ratio(F.sum("n_citations") - F.sum(F.size("invalid")), F.sum("n_citations")), 6).alias("valid_rate"),
        F.round(ratio(F.sum("cited_claims"), F.sum("n_claims")), 6).alias("claims_cited"),
        F.round(ratio(F.sum(F.size("unsupported")), n), 6).alias("unsupported_per_answer"),
        F.round(F.avg("mean_width"), 6).alias("mean_width"), F.count_if("repaired").alias("repaired"),
    )


def validate_gold(gold: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, problem) for targets whose file is missing or whose line is out of range or blank."""
    known = files.select("path", T.lines("text").alias("_lines"), F.lit(True).alias("_known"))
    rows = gold_targets(gold).join(known, "path", "left")
    line = F.try_element_at("_lines", F.col("line").cast("int"))
    missing = F.when(F.col("_known").isNull(), F.concat(F.lit("missing file "), F.col("path")))
    bad = F.when((F.col("line") < 1) | line.isNull() | (T.strip(line) == ""), F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" is out of range or blank")))
    return rows.select("qid", F.coalesce(missing, bad).alias("problem")).filter("problem is not null")


def is_trace(gold: DataFrame) -> bool:
    """Whether a gold set asks for several targets a question."""
    return not gold.filter(F.size("targets") > 1).isEmpty()


def stored(metrics: DataFrame, kind: str) -> DataFrame:
    """Metrics of one kind in the columns of stored results."""
    if kind == "retrieval":
        whole = metrics.filter(F.col("type") == ALL).drop("type")
        one = F.struct("n", "recall", "mrr", "hit1")
        types = metrics.filter(F.col("type") != ALL).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", one.alias("m")))))).alias("by_type"))
        return whole.crossJoin(F.broadcast(types))
    if kind == "trace":
        whole = metrics.filter(F.col("type") == ALL)
        variants = [F.struct(F.lit(v).alias("variant"), F.col(f"{v}_recall").alias("target_recall"), F.col(f"{v}_all").alias("all_found")) for v in ("topk", "baseline", "expand")]
        return whole.select("n", "mean_added", F.inline(F.array(*variants)))
    if kind == "answers":
        return metrics
    raise ValueError(f"no results of kind {kind!r}")


def report(results: DataFrame, kind: str, gold: str | None = None) -> DataFrame:
    """Stored results of one kind (retrieval, trace, answers), of one gold set if it is named; rows without a kind are retrieval."""
    rows = results.filter(F.coalesce("kind", F.lit("retrieval")) == kind)
    return rows.filter(T.gold_name("gold") == gold) if gold else rows

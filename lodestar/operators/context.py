"""Excerpts and the packing of a context under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import few
from .chunk import citation

BUDGET = 6000


def with_line_numbers(text: Column, first: Column) -> Column:
    """Each line after its number, right-aligned to five places (longer numbers are kept whole)."""

    def one(line: Column, i: Column) -> Column:
        n = (first + i).cast("string")
        return F.concat(F.when(F.length(n) < 5, F.lpad(n, 5, " ")).otherwise(n), F.lit("| "), line)

    return F.array_join(F.transform(T.lines(text), one), "\n")


def excerpt(path: Column, start: Column, end: Column, text: Column, kind: Column, symbol: Column, reason: Column, line_numbers: bool = False) -> Column:
    label = F.when(symbol != "", F.concat(F.lit("  ("), kind, F.lit(": "), symbol, F.lit(")"))).otherwise("")
    label = F.concat(label, F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("  [related: "), reason, F.lit("]"))).otherwise(""))
    body = with_line_numbers(text, start) if line_numbers else text
    return F.concat(F.lit("### "), citation(path, start, end), label, F.lit("\n```python\n"), body, F.lit("\n```"))


def greedy_fit(costs: Column, budget: int) -> Column:
    """Places (from 1) of the costs that fit when each is taken in turn if it still fits; the first is always taken."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("used"), F.lit(0).alias("at"))

    def step(acc: Column, cost: Column) -> Column:
        at = acc["at"] + 1
        fits = (acc["total"] + cost <= budget) | (F.size(acc["used"]) == 0)
        return F.struct(
            F.when(fits, acc["total"] + cost).otherwise(acc["total"]).alias("total"), F.when(fits, F.array_append(acc["used"], at)).otherwise(acc["used"]).cast("array<int>").alias("used"), at.alias("at")
        )

    return F.aggregate(costs, start, step, lambda acc: acc["used"])


def assemble(hits: DataFrame, chunks: DataFrame, budget: int = BUDGET, line_numbers: bool = False) -> DataFrame:
    """(qid, context, used) for ``hits`` (qid, pos, doc, reason): excerpts in order of pos that fit the budget; used: their docs.

    A query's list is as long as its hits, a dozen or so, so it is folded in one row.
    """
    rows = chunks.select("doc", "path", "start_line", "end_line", "text", "kind", "symbol").join(few(hits), "doc")
    block = excerpt(*(F.col(c) for c in ("path", "start_line", "end_line", "text", "kind", "symbol", "reason")), line_numbers)
    rows = rows.select("qid", F.struct("pos", "doc", block.alias("block")).alias("b"))
    lists = rows.groupBy("qid").agg(F.sort_array(F.collect_list("b")).alias("b"))
    used = T.let(greedy_fit(F.transform("b", lambda b: T.approx_tokens(b["block"])), budget), lambda u: F.filter("b", lambda b, i: F.array_contains(u, i + 1)))
    lists = lists.select("qid", used.alias("b"))
    return lists.select("qid", F.array_join(F.transform("b", lambda b: b["block"]), "\n\n").alias("context"), F.transform("b", lambda b: b["doc"]).alias("used"))

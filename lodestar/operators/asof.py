"""As-of join: each row of one table with the latest row of another at or before it.

One sort instead of a pair of tables: both sides are put together, and the last value of the other side is carried to each row. A key
may hold a third of all rows, so a key's rows are cut into pieces of time: pieces are sorted and carried apart, each piece
hands its last value on, and pieces, which are few, carry those over in turn. No task needs the rows of a whole key.

Defined results: rows of the left side without a match have null in the other side's columns; of several rows at one time the one with
the largest ``order`` counts; rows of the right side with a null key or time match nothing, and rows of the left side with one keep
nulls; repeated rows are rows of their own; column names of the other side that clash get the ``suffix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key in one piece of time, on average.
PIECE = 100_000


def micros(time: str) -> Column:
    """A time, with or without a zone, in microseconds."""
    return F.unix_micros(F.col(time).cast("timestamp"))


def pieces_of(rows: DataFrame, time: str, each: int) -> Column:
    """The piece of time of a row: equal spans, as many as give ``each`` rows to a span on average."""
    found = rows.agg(F.count("*").alias("n"), F.min(micros(time)).alias("first"), F.max(micros(time)).alias("last")).first()
    if not found.n or found.first is None:
        return F.lit(0)
    spans = -(-found.n // each)
    return F.floor((micros(time) - found.first) * spans / (found.last - found.first + 1)).cast("int")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], time: str, tolerance: str | None = None, order: str | None = None, suffix: str = "_then", piece: int = PIECE) -> DataFrame:
    """All rows of ``left``, each with the columns of the latest row of ``right`` with equal ``on`` and a ``time`` at or before its own.

    tolerance: how much earlier it may be at most, as an interval ("1 hour"); earlier ones are no match.
    order: a column of ``right`` that tells rows of one time apart, the largest first.
    """
    more = [c for c in right.columns if c not in on]
    named = {c: c + suffix if c in left.columns else c for c in more}
    then = F.struct(*(F.col(c).alias(named[c]) for c in more))
    kept = right.filter(F.col(time).isNotNull()).dropna(subset=on)
    own = F.struct(*left.columns)
    # at one time the other side's rows come first, so that "at or before" holds
    rows = kept.select(*on, F.col(time).alias("_time"), F.lit(0).alias("_side"), (F.col(order) if order else F.lit(0)).alias("_order"), then.alias("_then"), F.lit(None).cast(left.select(own.alias("x")).schema[0].dataType).alias("_own"))
    nothing = F.lit(None).cast(rows.schema["_then"].dataType)
    asked = left.select(*on, F.col(time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(rows.schema["_order"].dataType).alias("_order"), nothing.alias("_then"), own.alias("_own"))
    rows = rows.unionByName(asked)
    at = F.coalesce(pieces_of(rows, "_time", piece), F.lit(-1))
    rows = rows.withColumn("_piece", at)
    inside = Window.partitionBy(*on, "_piece").orderBy(F.asc_nulls_first("_time"), "_side", F.asc_nulls_first("_order")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.last("_then", ignorenulls=True).over(inside))
    # what each piece hands on: the last row of the other side in it, and from there over the pieces of its key
    ends = rows.filter("_side = 0").groupBy(*on, "_piece").agg(F.max_by("_then", F.struct("_time", "_order")).alias("_end"))
    keys = rows.select(*on, "_piece").distinct().join(ends, [*on, "_piece"], "left")
    before = Window.partitionBy(*on).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    found = rows.filter("_side = 1").join(keys, [*on, "_piece"], "left")
    found = found.withColumn("_then", F.coalesce("_last", "_before"))
    if tolerance is not None:
        found = found.withColumn("_then", F.when(F.col(f"_then.{named[time]}") + F.expr(f"INTERVAL {tolerance}") >= F.col("_time"), F.col("_then")))
    return found.select("_own.*", *(F.col(f"_then.{n}").alias(n) for n in named.values()))

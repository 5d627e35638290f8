"""Summaries that merge: sketches of quantiles and distinct values, cubes, and range frames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of a quantile sketch, and the base-two logarithm of a distinct-count sketch's buckets.
KLL, HLL = 1024, 14


@dataclass(frozen=True)
class Errors:
    """Stated errors at these sizes: of a quantile's rank (at 99 % confidence), and of a distinct count (one standard deviation)."""

    rank: float = 0.0034
    distinct: float = 1.04 / (1 << (HLL // 2))


def sketched(rows: DataFrame, keys: list[str | Column], number: str, name: str, k: int = KLL, lg: int = HLL) -> DataFrame:
    """(keys, n, quantiles binary, distinct binary): a sketch of ``number``'s values and one of the different ``name``s of each group.

    Groups are summed up in tasks first, so that what is shuffled are sketches. Nulls count in ``n`` alone.
    """
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(number).cast("double"), F.lit(k)).alias("quantiles"), F.hll_sketch_agg(name, F.lit(lg)).alias("distinct"))


def merged(sketches: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Sketches of larger groups from stored ones; the error stays that of one sketch."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def quantile(share: float) -> Column:
    return F.kll_sketch_get_quantile_double("quantiles", F.lit(share))


def estimated(sketches: DataFrame, shares: dict[str, float], distinct: str = "distinct_names") -> DataFrame:
    """The sketches' quantiles, one column for each of ``shares``, and the estimated number of different names."""
    keys = [c for c in sketches.columns if c not in ("quantiles", "distinct")]
    return sketches.select(*keys, *(quantile(s).alias(n) for n, s in shares.items()), F.hll_sketch_estimate("distinct").alias(distinct))


def grouping_sets(rows: DataFrame, sets: list[list[str]], *measures: Column) -> DataFrame:
    """Measures of every set of columns in ``sets``, in one pass; ``grouping`` tells sets apart: a bit for each column that is left out,
    the first column's the highest. Columns left out are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    named = [F.col(c) for c in columns]
    found = rows.groupingSets([[F.col(c) for c in s] for s in sets], *named)
    return found.agg(F.grouping_id(*named).alias("grouping"), *measures)


def cube(rows: DataFrame, columns: list[str], *measures: Column) -> DataFrame:
    """Measures of all sets of ``columns``, with ``grouping`` as in :func:`grouping_sets`."""
    return rows.cube(*columns).agg(F.grouping_id().alias("grouping"), *measures)


def _with_past(rows: DataFrame, time: str, interval_seconds: float, piece_seconds: float | None) -> tuple[DataFrame, int]:
    """``rows`` with their time in microseconds and their piece of time, and ``_copy``: those of the interval before a piece once more; the
    interval's length."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    length = round(interval_seconds * 1_000_000)
    piece = max(length, round((piece_seconds or interval_seconds) * 1_000_000))
    own = rows.withColumns({"_t": micros, "_piece": F.floor(micros / piece), "_copy": F.lit(False)})
    again = own.withColumn("_next", F.floor((F.col("_t") + length) / piece)).filter(F.col("_next") > F.col("_piece"))
    again = again.withColumns({"_piece": F.col("_next"), "_copy": F.lit(True)}).drop("_next")
    return own.unionByName(again), length


def over_past(rows: DataFrame, keys: list[str], time: str, interval_seconds: float, piece_seconds: float | None = None, **measures: Column) -> DataFrame:
    """``rows`` with ``measures`` over the rows of equal ``keys`` in the interval before each, the row's own time left out.

    measures: functions of an array ``_past`` or plain aggregates over the frame. A key's rows are cut into pieces of time (as long as the
    interval unless told otherwise) and each piece gets a copy of the interval before it, so that a key which holds a third of all
    rows is many groups. Rows without a time get nulls. Spark works out each frame by itself, which costs as much as the frames hold; where
    they overlap a lot, :func:`percentile_of_past` does not.
    """
    found, length = _with_past(rows, time, interval_seconds, piece_seconds)
    frame = Window.partitionBy(*keys, "_piece").orderBy("_t").rangeBetween(-length, -1)
    found = found.withColumns({name: F.when(F.col("_t").isNotNull(), measure.over(frame)) for name, measure in measures.items()})
    return found.filter(~F.col("_copy")).drop("_t", "_piece", "_copy")


def kth_smallest(values: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of each ``values[low:high]``: a wavelet tree of the values' ranks, all ranges at once.

    Each bit of the ranks is one step for all ranges, however long they are or how much they overlap.
    """
    different, ranks = np.unique(values, return_inverse=True)
    found = np.zeros(len(k), np.int64)
    for bit in reversed(range(max(len(different) - 1, 0).bit_length())):
        one = (ranks >> bit & 1).astype(bool)
        zeros = np.r_[0, np.cumsum(~one)]
        from_, to = zeros[low], zeros[high]
        up = k >= to - from_
        k = np.where(up, k - (to - from_), k)
        low, high = np.where(up, zeros[-1] + low - from_, from_), np.where(up, zeros[-1] + high - to, to)
        found += up.astype(np.int64) << bit
        ranks = np.concatenate([ranks[~one], ranks[one]])
    return different[found]


def percentile_of_past(rows: DataFrame, keys: list[str], time: str, value: str, interval_seconds: float, share: float, piece_seconds: float | None = None) -> DataFrame:
    """``rows`` with ``n``, the number of rows of equal ``keys`` in the interval before each, and ``percentile``, the exact one of their
    values, between neighbours in proportion; nulls count in ``n`` alone.

    Pieces as in :func:`over_past`; a row costs the logarithm of its piece's rows and not the rows of its frame. Rows without a time get nulls.
    """

    def run(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("_t")
        times, values = piece.column("_t").to_numpy(), piece.column("_v").to_numpy()
        held = piece.column("_v").is_valid().to_numpy()
        own = ~piece.column("_copy").to_numpy()
        first, last = np.searchsorted(times, times[own] - length), np.searchsorted(times, times[own])
        before = np.r_[0, np.cumsum(held)]
        low, high = before[first], before[last]
        some = high > low
        low, high = low[some], high[some]
        place = (high - low - 1) * share
        lower, upper = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
        at = kth_smallest(values[held], np.r_[low, low], np.r_[high, high], np.r_[lower, upper])
        less, more = at[: len(low)], at[len(low) :]
        with np.errstate(invalid="ignore"):
            between = np.where((lower == upper) | (less == more), less, (upper - place) * less + (place - lower) * more)
        found = np.zeros(len(some))
        found[some] = between
        kept = piece.select(names).filter(pa.array(own))
        return kept.append_column("n", pa.array(last - first, pa.int64())).append_column("percentile", pa.array(found, pa.float64(), mask=~some))

    parts, length = _with_past(rows.filter(F.col(time).isNotNull()), time, interval_seconds, piece_seconds)
    parts, names = parts.withColumn("_v", F.col(value).cast("double")), rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", n long, percentile double"
    none = rows.filter(F.col(time).isNull()).withColumns({"n": F.lit(None).cast("long"), "percentile": F.lit(None).cast("double")})
    return parts.groupBy(*keys, "_piece").applyInArrow(run, schema).unionByName(none)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(columns, was, now): rows that two tables hold differently often, repeated rows counted; equal counts are left out.

    Both sides are counted before they meet, as one union and one aggregation: a row that fills a third of a table is one number a task.
    """
    columns = before.columns
    both = before.withColumn("_d", F.lit(False)).unionByName(after.select(*columns).withColumn("_d", F.lit(True)))
    counted = both.groupBy(*columns).agg(F.count_if(~F.col("_d")).alias("was"), F.count_if("_d").alias("now"))
    return counted.filter("was <> now")


def common(before: DataFrame, after: DataFrame) -> DataFrame:
    """(columns, n): rows of both tables, as often as in the one that has fewer."""
    columns = before.columns
    both = before.withColumn("_d", F.lit(False)).unionByName(after.select(*columns).withColumn("_d", F.lit(True)))
    counted = both.groupBy(*columns).agg(F.count_if(~F.col("_d")).alias("_was"), F.count_if("_d").alias("_now"))
    return counted.select(*columns, F.least("_was", "_now").alias("n")).filter("n > 0")

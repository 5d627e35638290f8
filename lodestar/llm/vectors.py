"""Operators 3 and 4: exact top-k by a pivot table, and approximate neighbours by multiprobe p-stable hashing.

Both search classes of equal vectors. A class keeps its k + 1 first rows, which is all that ties to the smaller id can ask
for, so a vector that fills a third of the table is compared once; map-side group limits keep it from meeting in one task.
Vectors of different lengths are searched apart.

Exact search. Distances from every vector to ``PIVOTS`` pivots and to zero are worked out once and kept as the pivot table.
Pivots are vectors far from each other: each next one has the largest part outside of what those before it span. For a query
q and a candidate x all distances together bound d(q,x) from below: they place both above the span of the pivots, at heights
hq and hx, and d(q,x)^2 >= |q' - x'|^2 + (hq - hx)^2, which is at least the square of |d(q,p) - d(x,p)| for every pivot p. So the
inner product is at most q' . x' + hq hx.

* Blocks. Rows are dealt by nearest pivot into blocks of ``ROW_BLOCK``; a block's centre and radius in the pivot table bound all its
  rows. Each query is first compared with the block whose centre promises most, which gives it a k-th score to beat.
* Cells. A query then meets exactly the blocks whose bound reaches that score; a task holds one block and ``QUERY_BLOCK`` queries.
* Candidates whose bound reaches the score are evaluated in the order of the bound until it falls below the k-th score found.

Products are whole numbers and are summed exactly: in doubles while every sum stays below 2^53, else in 64-bit integers.

Approximate search. Each table hashes ``M`` p-stable projections into cells of ``WIDTH``; M follows the number of vectors, as far as
a query's neighbours are found in ``PROBES`` buckets on average: beyond that buckets grow into blocks, which are read faster than
buckets are named. A query visits its own bucket and then perturbed ones in the order of the estimated probability that a
neighbour fell there, until that probability adds up to the table's share of ``GOAL``. Index rows meet probes by
bucket; large buckets are salted and their probes copied to every part. Each task merges the candidates
that its buckets give a query and ranks them by exact inner products. Queries whose buckets hold too few rows for a full
list are compared with all rows, on a grid of blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, partitions_for, table

PIVOTS, QUERY_BLOCK, ROW_BLOCK, CHUNK, SUMMARY_BLOCK = 48, 2048, 8192, 128, 4096
SPREAD_SHARE = 0.75
TABLES, WIDTH, GOAL, PER_BUCKET, PROBES, BUCKET_ROWS, LARGE_BUCKETS, SAMPLE, SEED = 6, 3.0, 0.95, 64, 256, 512, 20_000, 2000, 4

#: A class hit: qid and rep name classes by the number of a row in them, id is the class's smallest vec_id.
FOUND = "qid long, rep long, id long, score {}"


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """(rid, vec_id, v) for rows with an id and a vector of finite components; ``rid`` numbers rows, so repeated ones stay apart.

    ``zero``: whether vectors of zeros take part.
    """
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)))
    if not zero:
        rows = rows.filter(F.exists(v, lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v")


def by_length(rows: DataFrame) -> list[tuple[int, DataFrame]]:
    """The rows of each length of vectors, shorter ones first."""
    sizes = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    return [(size, rows if len(sizes) == 1 else rows.filter(F.size("v") == size)) for size in sizes]


def equal_classes(rows: DataFrame, k: int) -> DataFrame:
    """(rep, id, v, members): one row for each different vector with its k + 1 first rows (vec_id, rid); rep and id are the first's."""
    first = Window.partitionBy("v").orderBy("vec_id", "rid")
    few = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    few = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "rid"))).alias("members"))
    return few.select(F.get("members", 0)["rid"].alias("rep"), F.get("members", 0)["vec_id"].alias("id"), "v", "members")


def query_classes(rows: DataFrame) -> DataFrame:
    """(qid, v): one row for each different vector among the queries."""
    return rows.groupBy("v").agg(F.min("rid").alias("qid")).select("qid", "v")


def top_classes(found: DataFrame, k: int) -> DataFrame:
    """(qid, rep, id, score): each query's k + 1 best class hits, repeated hits once."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "rep")
    once = found.groupBy("qid", "rep", "id").agg(F.max("score").alias("score"))
    return once.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")


def ranked(found: DataFrame, classes: DataFrame, queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from class hits: ties to the smaller id, a query's own row left out.

    Classes and queries that many rows share are large keys of plain joins, whose sides adaptive execution splits.
    """
    top = cut_lineage(top_classes(found, k))
    members = top.join(classes.select("rep", "members"), "rep").select("qid", "score", F.inline("members"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")
    members = members.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    lists = members.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "rid", "score"))).alias("hits"))
    lists = cut_lineage(lists.join(queries, "qid").select("v", "hits"))
    # every query row: by its vector to the class that was searched for it
    mine = asked.select("rid", F.col("vec_id").alias("query_id"), "v").join(lists, "v")
    others = F.slice(F.filter("hits", lambda h: h["rid"] != F.col("rid")), 1, k)
    rows = mine.select("query_id", F.posexplode(others).alias("p", "h"))
    return rows.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1) if n else np.zeros((0, 0))


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def _hits(found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], kind=np.float64) -> pa.RecordBatch:
    """A batch of class hits from (qid, reps, ids, scores) of some queries."""
    join = lambda parts, dtype: pa.array(np.concatenate([np.zeros(0, dtype), *parts]).astype(dtype))
    qids = [np.full(len(reps), qid, np.int64) for qid, reps, _, _ in found]
    return pa.RecordBatch.from_arrays([join(qids, np.int64), join([f[1] for f in found], np.int64), join([f[2] for f in found], np.int64), join([f[3] for f in found], kind)], names=["qid", "rep", "id", "score"])


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _each(blocks: int):
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


# ---- exact ----


class PivotTable:
    """Pivots, and what the distances to them say about a vector."""

    def __init__(self, sample: np.ndarray, most: int = PIVOTS):
        """Pivots from a sample: each next one has the largest part outside the span of those before it."""
        rest, chosen = sample.astype(np.float64), []
        largest = float((rest**2).sum(1).max(initial=0.0))
        for _ in range(min(most, rest.shape[1])):
            outside = (rest**2).sum(1)
            if not len(rest) or outside.max() <= 1e-4 * largest:
                break
            chosen.append(int(outside.argmax()))
            line = rest[chosen[-1]] / math.sqrt(outside.max())
            rest = rest - np.outer(rest @ line, line)
        self.pivots = sample[chosen].astype(np.float64)
        self.squares = (self.pivots**2).sum(1)
        self.lower = np.linalg.cholesky(self.pivots @ self.pivots.T) if chosen else np.zeros((0, 0))
        self.thin = float(np.diag(self.lower).min(initial=math.inf))

    def rounding(self, largest: float) -> float:
        """How far rounding may move inner products of places, for squared lengths up to ``largest``; far more than it does."""
        return largest * max(1e-9, 1e-12 * math.sqrt(largest) / self.thin)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances to zero and to every pivot."""
        norms = (x**2).sum(1)
        return np.sqrt(np.maximum(0, np.c_[norms, norms[:, None] + self.squares - 2 * x @ self.pivots.T]))

    def places(self, gaps: np.ndarray) -> np.ndarray:
        """Coordinates above the span of zero and the pivots, the height last; inner products of these bound those of vectors.

        Heights are taken a little too large, so that rounding never makes a bound too small.
        """
        norms = gaps[:, 0] ** 2
        if not len(self.pivots):
            return gaps[:, :1]
        flat = np.linalg.solve(self.lower, ((norms[:, None] + self.squares - gaps[:, 1:] ** 2) / 2).T).T
        largest = max(float(norms.max(initial=0.0)), float(self.squares.max()))
        return np.c_[flat, np.sqrt(np.maximum(0, norms - (flat**2).sum(1)) + self.rounding(largest))]


def pivot_search(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, reps: np.ndarray, bounds: np.ndarray, k: int, beat: float = -math.inf, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k largest inner products (ties to the smaller id) that reach ``beat``, and how many rows were evaluated.

    Rows are evaluated in the order of their bounds until these fall below the k-th score found; ``slack``: how much too small
    rounding may have made a bound.
    """
    near = np.flatnonzero(bounds + slack >= beat)
    order = near[np.argsort(-bounds[near], kind="stable")]
    scores, at, done = np.zeros(0, rows.dtype), np.zeros(0, np.int64), 0
    while done < len(order):
        if len(scores) >= k and bounds[order[done]] + slack < scores[k - 1]:
            break
        part = order[done : done + CHUNK]
        done += len(part)
        scores, at = np.r_[scores, rows[part] @ query], np.r_[at, part]
        best = np.lexsort((reps[at], ids[at], -scores))[:k]
        scores, at = scores[best], at[best]
    return at, scores, done


def _exact_kind(largest: float, size: int):
    """The number type in which inner products of vectors with squared lengths up to ``largest`` are exact."""
    if largest * (1 + 1e-9 * size) >= 2.0**63:
        raise OverflowError("inner products of these vectors may exceed 64-bit integers")
    return np.float64 if largest * (1 + 1e-9 * size) < 2.0**53 else np.int64


def exact_top_k(vectors: DataFrame, every: int, k: int, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of the whole-number vectors floor(scale * x).

    Queries are rows whose id is divisible by ``every``; candidates are all other rows, repeated ones each by itself, with vectors
    of the same length. Vectors null, empty or with null or non-finite components take no part, and
    neither do rows without an id. Empty tables give no rows. Ties go to the smaller id. Other columns are ignored. Vectors whose
    products may not fit into 64-bit integers are an OverflowError.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, zero=True)
    rows = cut_lineage(rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))))
    parts = [_exact(part, size, every, k, pivots) for size, part in by_length(rows)]
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for part in parts:
        found = found.unionByName(part)
    return found if len(parts) != 1 else parts[0]


def _exact(rows: DataFrame, size: int, every: int, k: int, most: int) -> DataFrame:
    spark = rows.sparkSession
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    classes, queries = cut_lineage(equal_classes(rows, k)), cut_lineage(query_classes(asked))
    n, largest = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    nq = queries.count()
    kind = _exact_kind(largest, size)
    number = "double" if kind == np.float64 else "long"
    pivots = PivotTable(np.array([r.v for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()], np.float64), most)
    slack = pivots.rounding(largest)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = pivots.distances(_matrix(batch.column("v")))
                near = gaps[:, 1:].argmin(1) if gaps.shape[1] > 1 else np.zeros(len(gaps), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(gaps) + 1) * gaps.shape[1], pa.int32()), pa.array(gaps.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "gaps", "near"])

    measure = lambda df, schema: df.mapInArrow(measured, f"{schema}, v array<double>, gaps array<double>, near int")
    held = cut_lineage(measure(classes.select("rep", "id", "v"), "rep long, id long"))
    # one row a pivot: pivots of few rows share a block, those of many have several; every task has one, if they are worth it
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_each = ROW_BLOCK if n <= ROW_BLOCK // 2 else min(ROW_BLOCK, max(ROW_BLOCK // 8, -(-n // tasks)))
    starts, blocks, room = {}, 0, 0
    for near, size_of in sorted((r.near, r["count"]) for r in held.groupBy("near").count().collect()):
        if size_of <= room:
            starts[near], room = (blocks - 1, 1), room - size_of
        else:
            parts = -(-size_of // rows_each)
            starts[near], blocks, room = (blocks, parts), blocks + parts, rows_each - size_of if parts == 1 else 0
    starts = spark.createDataFrame([(near, *x) for near, x in starts.items()], "near int, first int, parts int")
    held = held.join(F.broadcast(starts), "near").select("rep", "id", "v", "gaps", (F.col("first") + F.pmod(F.xxhash64("rep"), "parts")).cast("int").alias("block"))
    held = cut_lineage(held.repartition(max(1, blocks), "block"))
    asks = partitions_for(nq, QUERY_BLOCK, 1)
    wanted = cut_lineage(measure(queries.select("qid", "v"), "qid long").select("qid", "v", "gaps", _block("qid", asks).alias("a")))

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _gather(batches)) is None:
            return
        block, places = got.column("block").to_numpy(), pivots.places(_matrix(got.column("gaps")))
        for b in np.unique(block):
            x = places[block == b]
            centre = x.mean(0)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([centre], pa.list_(pa.float64())), pa.array([float(np.sqrt(((x - centre) ** 2).sum(1).max()))])], names=["block", "centre", "radius"])

    summary = cut_lineage(held.select("block", "gaps").mapInArrow(summarised, "block int, centre array<double>, radius double"))
    summary = summary.select("block", "centre", "radius", F.floor(F.col("block") / SUMMARY_BLOCK).cast("int").alias("s"))
    groups = -(-blocks // SUMMARY_BLOCK)

    def bounds(beat: bool) -> Callable:
        """Pairs (qid, block): the block whose centre promises most, or all that reach the query's score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if (got := _gather(batches)) is None:
                return
            is_block = got.column("block").is_valid().to_numpy()
            b, q = got.filter(pa.array(is_block)), got.filter(pa.array(~is_block))
            if not len(b) or not len(q):
                return
            centres, radii, places = _matrix(b.column("centre")), b.column("radius").to_numpy(), pivots.places(_matrix(q.column("gaps")))
            promise = places @ centres.T
            if beat:
                least = q.column("beat").to_numpy()[:, None]
                own = q.column("first").to_numpy()[:, None] == b.column("block").to_numpy()
                bound = promise + np.sqrt((places**2).sum(1))[:, None] * radii
                at, to = np.nonzero((bound + slack + 1e-9 * np.abs(bound) >= least) & ~own)
            else:
                at, to = np.arange(len(q)), promise.argmax(1)
            yield pa.RecordBatch.from_arrays([q.column("qid").combine_chunks().take(pa.array(at)), b.column("block").combine_chunks().take(pa.array(to)), pa.array(promise[at, to])], names=["qid", "block", "promise"])

        return run

    def pairs(asking: DataFrame, beat: bool) -> DataFrame:
        none = lambda t: F.lit(None).cast(t)
        left = summary.select("block", "centre", "radius", none("long").alias("qid"), none("array<double>").alias("gaps"), none("double").alias("beat"), none("int").alias("first"), "s", _each(asks).alias("a"))
        right = asking.select(none("int").alias("block"), none("array<double>").alias("centre"), none("double").alias("radius"), "qid", "gaps", "beat", "first", _each(groups).alias("s"), "a")
        cells = left.unionByName(right).withColumn("cell", F.col("s") * asks + F.col("a"))
        return _one_cell_each(cells, groups * asks).mapInArrow(bounds(beat), "qid long, block int, promise double")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _gather(batches)) is None:
            return
        cell, is_row = got.column("cell").to_numpy(), got.column("rep").is_valid().to_numpy()
        for c in np.unique(cell):
            x, q = got.filter(pa.array((cell == c) & is_row)), got.filter(pa.array((cell == c) & ~is_row))
            if not len(x) or not len(q):
                continue
            v, reps, ids = _matrix(x.column("v")).astype(kind), x.column("rep").to_numpy(), x.column("id").to_numpy()
            limits, questions = pivots.places(_matrix(q.column("gaps"))) @ pivots.places(_matrix(x.column("gaps"))).T, _matrix(q.column("v")).astype(kind)
            beats, found = q.column("beat").to_numpy(), []
            for i, qid in enumerate(q.column("qid").to_numpy()):
                at, scores, _ = pivot_search(questions[i], v, ids, reps, limits[i], k + 1, beats[i], slack)
                found.append((qid, reps[at], ids[at], scores))
            yield _hits(found, kind)

    def compare(met: DataFrame, asking: DataFrame) -> DataFrame:
        """Class hits of pairs (qid, block)."""
        none = lambda t: F.lit(None).cast(t)
        right = met.select("qid", "block").join(asking, "qid").select(none("long").alias("rep"), none("long").alias("id"), "v", "gaps", "qid", "beat", "block", "a")
        left = held.select("rep", "id", "v", "gaps", none("long").alias("qid"), none("double").alias("beat"), "block", _each(asks).alias("a"))
        cells = left.unionByName(right).withColumn("cell", F.col("block") * asks + F.col("a"))
        return _one_cell_each(cells, blocks * asks).mapInArrow(search, FOUND.format(number))

    if blocks <= 1:
        found = compare(wanted.select("qid", F.lit(0).alias("block")), wanted.withColumn("beat", F.lit(-math.inf)))
        return ranked(found, classes, queries, asked, k).withColumn("score", F.col("score").cast("long"))
    first = pairs(wanted.select("*", F.lit(None).cast("double").alias("beat"), F.lit(None).cast("int").alias("first")), False)
    first = cut_lineage(first.groupBy("qid").agg(F.max_by("block", F.struct("promise", "block")).alias("block")))
    begun = cut_lineage(compare(first, wanted.withColumn("beat", F.lit(-math.inf))))
    kth = begun.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).select("qid", F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(-math.inf)).alias("beat"))
    told = cut_lineage(wanted.join(first.select("qid", F.col("block").alias("first")), "qid").join(kth, "qid"))
    rest = compare(pairs(told, True), told)
    return ranked(begun.unionByName(rest), classes, queries, asked, k).withColumn("score", F.col("score").cast("long"))


def _one_cell_each(cells: DataFrame, n: int) -> DataFrame:
    """``cells`` dealt by their number, with a few times more partitions than cells, so that few tasks hold two."""
    return cells.repartition(n if n == 1 else 2 * n, "cell")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


OP3_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows q JOIN rows c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM best WHERE r <= 10
"""


# ---- approximate ----


def probes(chances: np.ndarray, goal: float, most: float = math.inf) -> list[tuple]:
    """Sets of (dimension, step) in the order of their probability until it adds up to ``goal``; the first is the bucket itself.

    most: where to stop counting, for who only asks whether they are few.

    chances: for each dimension the probability that a neighbour lies in the cell below, the same cell, the cell above.
    """
    chances = np.maximum(chances, 1e-12)
    here = float(chances[:, 1].prod())
    found, mass = [()], here
    cost = sorted((math.log(chances[i, 1] / chances[i, 1 + step]), i, step) for i in range(len(chances)) for step in (-1, 1))
    heap = [(cost[0][0], (0,))] if cost else []
    while heap and mass < goal and len(found) <= most:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(cost):
            heapq.heappush(heap, (total - cost[last][0] + cost[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1][0], (*chosen, last + 1)))
        if len({cost[c][1] for c in chosen}) == len(chosen):
            found.append(tuple((cost[c][1], cost[c][2]) for c in chosen))
            mass += here * math.exp(-total)
    return found


class Hashes:
    """p-stable hash tables over vectors that are scaled by the largest length and given one more component, so that the
    nearest in distance are the largest inner products."""

    def __init__(self, size: int, bits: int, longest: float, spread: float, tables: int = TABLES, width: float = WIDTH, goal: float = GOAL):
        draw = np.random.default_rng(SEED)
        self.lines, self.shift = draw.normal(size=(tables, bits, size + 1)), draw.uniform(0, width, size=(tables, bits))
        self.mixers = draw.integers(1, 2**62, size=(tables, bits + 1), dtype=np.int64) | 1
        self.longest, self.spread, self.width, self.share = longest, spread, width, 1 - (1 - goal) ** (1 / tables)

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        lengths = np.sqrt((x**2).sum(1))
        if query:
            return np.c_[x / lengths[:, None], np.zeros(len(x))]
        return np.c_[x / self.longest, np.sqrt(np.maximum(0, 1 - (lengths / self.longest) ** 2))]

    def cells(self, lifted: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        at = lifted @ self.lines[t].T + self.shift[t]
        cell = np.floor(at / self.width)
        return cell.astype(np.int64), at - cell * self.width

    def keys(self, cells: np.ndarray, t: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (cells * self.mixers[t, :-1]).sum(1) + self.mixers[t, -1]
            mixed ^= mixed >> 29
            return mixed * np.int64(-4658895280553007687)

    def probe_keys(self, x: np.ndarray, most: float = math.inf) -> list[np.ndarray]:
        """For each query the keys of all buckets that it visits."""
        lifted, out = self.lift(x, True), [[] for _ in x]
        normal = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))), otypes=[float])
        for t in range(len(self.lines)):
            cells, inside = self.cells(lifted, t)
            edges = np.stack([-self.width - inside, -inside, self.width - inside, 2 * self.width - inside], 2) / self.spread
            chances = np.diff(normal(edges), axis=2) if edges.size else np.zeros((len(x), 0, 3))
            for i in range(len(x)):
                sets = probes(chances[i], self.share, most)
                visited = np.repeat(cells[i : i + 1], len(sets), 0)
                for j, steps in enumerate(sets):
                    for dimension, step in steps:
                        visited[j, dimension] += step
                out[i].append(self.keys(visited, t))
        return [np.unique(np.concatenate(keys)) for keys in out]


def fit_hashes(sample: np.ndarray, n: int, longest: float, k: int) -> Hashes:
    """Hash tables for ``n`` vectors like those of the sample, the longest of length ``longest``.

    Bits follow the number of vectors, but end where a sampled query would visit more than ``PROBES`` buckets a table on average.
    """
    bits, spread = max(0, round(math.log2(n / PER_BUCKET))), 1.0
    make = lambda bits: Hashes(sample.shape[1], bits, longest, spread)
    hashes = make(0)
    gaps = np.sqrt(np.maximum(0, 2 - 2 * hashes.lift(sample[:200], True) @ hashes.lift(sample, False).T))
    # each sampled query's distance to its k-th neighbour, leaving itself out; most queries lie below the upper quartile
    own = np.arange(len(gaps))[:, None] == np.arange(len(sample))
    gaps = gaps[~own].reshape(len(gaps), -1)
    if gaps.size:
        spread = max(1e-3, float(np.quantile(np.quantile(gaps, min(1.0, k / n), axis=1), SPREAD_SHARE)))
    while bits and not _named_by_few(make(bits), sample[:16]):
        bits -= 1
    return make(bits)


def _named_by_few(hashes: Hashes, sample: np.ndarray) -> bool:
    return np.mean([len(keys) for keys in hashes.probe_keys(sample, 4 * PROBES)]) <= PROBES * TABLES


def _fit(classes: DataFrame, k: int) -> tuple[Hashes, int]:
    """Hash tables for these vectors: from their number, the largest length and a sample of ``SAMPLE`` rows."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, longest = classes.agg(F.count("*"), F.max(length)).first()
    sample = np.array([r.v for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()], np.float64)
    return fit_hashes(sample, n, float(longest), k), n


def all_compared(classes: DataFrame, queries: DataFrame, k: int, n: int, n_queries: int) -> DataFrame:
    """Class hits: the k + 1 best, from each block of classes, of ``queries`` compared with all classes."""
    blocks, asks = partitions_for(n, ROW_BLOCK, 1), partitions_for(n_queries, QUERY_BLOCK, 1)
    none = F.lit(None).cast("long")
    left = classes.select(F.lit(False).alias("ask"), "rep", "id", none.alias("qid"), "v", _block("rep", blocks).alias("b"), _each(asks).alias("a"))
    right = queries.select(F.lit(True).alias("ask"), none.alias("rep"), none.alias("id"), "qid", "v", _each(blocks).alias("b"), _block("qid", asks).alias("a"))
    cells = left.unionByName(right).select("ask", "rep", "id", "qid", "v", (F.col("b") * asks + F.col("a")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _gather(batches)) is None:
            return
        cell, ask = got.column("cell").to_numpy(), got.column("ask").to_numpy().astype(bool)
        for c in np.unique(cell):
            x, q = got.filter(pa.array((cell == c) & ~ask)), got.filter(pa.array((cell == c) & ask))
            if len(x) and len(q):
                reps, ids, v = x.column("rep").to_numpy(), x.column("id").to_numpy(), _matrix(x.column("v"))
                questions = _matrix(q.column("v"))
                yield _hits([(qid, *_best(v, ids, reps, questions[i], k + 1)) for i, qid in enumerate(q.column("qid").to_numpy())])

    return _one_cell_each(cells, blocks * asks).mapInArrow(run, FOUND.format("double"))


def _best(rows: np.ndarray, ids: np.ndarray, reps: np.ndarray, query: np.ndarray, k: int, rough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reps, ids and scores of the k largest inner products, ties to the smaller id; scores are sums in component order."""
    near, rough = np.arange(len(rows)), rows @ query if rough is None else rough
    if len(near) > k:
        least = np.partition(rough, -k)[-k]
        near = near[rough >= least - 1e-9 * max(1.0, abs(least))]
    scores = np.cumsum(rows[near] * query, axis=1)[:, -1]
    best = np.lexsort((reps[near], ids[near], -scores))[:k]
    return reps[near[best]], ids[near[best]], scores[best]


def _mixed(*numbers: np.ndarray) -> np.ndarray:
    """One well-mixed number for each row of ``numbers``."""
    with np.errstate(over="ignore"):
        x = np.int64(SEED)
        for n in numbers:
            x = (x ^ (x >> 31)) * np.int64(-4658895280553007687) + n
            x = (x ^ (x >> 29)) * np.int64(-7723592293110705685)
    return x ^ (x >> 32)


def nearest(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by inner product for rows whose id is divisible by ``every``.

    Every usable row is indexed, repeated ones each by itself. A query has fewer than k rows only if there are fewer other rows with
    vectors of the same length. Vectors null, empty, zero or with null or non-finite components take no part, and neither do rows
    without an id. Tables of up to about 90 different vectors have a single bucket and are searched whole. Empty tables give no
    rows. Ties go to the smaller id. Other columns are ignored. Scores are sums in component order, in double precision.
    """
    rows = cut_lineage(usable(vectors, zero=False))
    parts = [_nearest(part, every, k) for _, part in by_length(rows)]
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for part in parts:
        found = found.unionByName(part)
    return found if len(parts) != 1 else parts[0]


def _nearest(rows: DataFrame, every: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    classes, queries = cut_lineage(equal_classes(rows, k)), cut_lineage(query_classes(asked))
    hashes, n = _fit(classes, k)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_tasks = partitions_for(n * TABLES, 50_000, tasks)
    most = max(BUCKET_ROWS, n * TABLES // min(4 * n_tasks, LARGE_BUCKETS))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lifted = hashes.lift(_matrix(batch.column("v")), False)
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.keys(hashes.cells(lifted, t)[0], t))], names=["key"])

    # buckets of more than ``most`` rows: LARGE_BUCKETS of them at most, as all hold n * TABLES rows together
    sizes = classes.select("v").mapInArrow(keyed, "key long").groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > most).collect()
    large = np.array(sorted((r.key, -(-r.rows // most)) for r in sizes), np.int64).reshape(-1, 2)

    def parts_of(keys: np.ndarray) -> np.ndarray:
        if not len(large):
            return np.ones(len(keys), np.int64)
        at = np.minimum(np.searchsorted(large[:, 0], keys), len(large) - 1)
        return np.where(large[at, 0] == keys, large[at, 1], 1)

    def task_of(keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
        return (_mixed(keys, salts) % n_tasks).astype(np.int32)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lifted, reps = hashes.lift(_matrix(batch.column("v")), False), batch.column("rep").to_numpy()
                for t in range(TABLES):
                    keys = hashes.keys(hashes.cells(lifted, t)[0], t)
                    at = task_of(keys, _mixed(reps) % parts_of(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(keys), *(batch.column(c) for c in ("rep", "id", "v"))], names=["task", "key", "rep", "id", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(task, qid, v, keys): for each task the buckets there that a query visits."""
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                at, task, lists = [], [], []
                for i, keys in enumerate(hashes.probe_keys(_matrix(part.column("v")))):
                    copies = parts_of(keys)
                    keys, salts = np.repeat(keys, copies), np.concatenate([np.arange(c) for c in copies.tolist()])
                    to = task_of(keys, salts)
                    order = np.argsort(to, kind="stable")
                    names, firsts = np.unique(to[order], return_index=True)
                    at += [i] * len(names)
                    task += names.tolist()
                    lists += np.split(keys[order], firsts[1:])
                rows = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), rows.column("qid"), rows.column("v"), pa.array(lists, pa.list_(pa.int64()))], names=["task", "qid", "v", "keys"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _gather(batches)) is None:
            return
        is_row = got.column("rep").is_valid().to_numpy()
        x, q = got.filter(pa.array(is_row)), got.filter(pa.array(~is_row))
        if not len(x) or not len(q):
            return
        row_keys = x.column("key").to_numpy()
        order = np.argsort(row_keys, kind="stable")
        row_keys, v, reps, ids = row_keys[order], _matrix(x.column("v"))[order], x.column("rep").to_numpy()[order], x.column("id").to_numpy()[order]
        questions, lists, found = _matrix(q.column("v")), q.column("keys"), []
        for i, qid in enumerate(q.column("qid").to_numpy()):
            wanted = lists[i].values.to_numpy()
            begin, end = np.searchsorted(row_keys, wanted, "left"), np.searchsorted(row_keys, wanted, "right")
            begin, end = begin[end > begin], end[end > begin]
            if not len(begin):
                continue
            # buckets are runs of rows: one product each, and a row can occur once in every table
            sizes = end - begin
            stops = np.cumsum(sizes)
            scores = np.empty(stops[-1])
            for a, b, stop in zip(begin.tolist(), end.tolist(), stops.tolist(), strict=True):
                np.dot(v[a:b], questions[i], out=scores[stop - b + a : stop])
            near = np.repeat(begin - stops + sizes, sizes) + np.arange(stops[-1])
            most_rows = TABLES * (k + 1)
            if len(near) > most_rows:
                least = np.partition(scores, -most_rows)[-most_rows]
                near = near[scores >= least - 1e-9 * max(1.0, abs(least))]
            near = near[np.unique(reps[near], return_index=True)[1]]
            found.append((qid, *_best(v[near], ids[near], reps[near], questions[i], k + 1)))
        yield _hits(found)

    none = lambda t: F.lit(None).cast(t)
    left = classes.select("rep", "id", "v").mapInArrow(index, "task int, key long, rep long, id long, v array<double>")
    left = left.select("*", none("long").alias("qid"), none("array<long>").alias("keys"))
    nq = queries.count()
    right = queries.repartition(partitions_for(nq, 256, tasks)).mapInArrow(visit, "task int, qid long, v array<double>, keys array<long>")
    right = right.select("task", none("long").alias("key"), none("long").alias("rep"), none("long").alias("id"), "v", "qid", "keys")
    found = left.unionByName(right).repartition(n_tasks, "task").mapInArrow(rank, FOUND.format("double"))
    found = cut_lineage(top_classes(found, k))
    # queries whose classes have fewer rows than a full list and the query's own row
    rows_found = found.join(classes.select("rep", F.size("members").alias("rows")), "rep").groupBy("qid").agg(F.sum("rows").alias("rows"))
    short = queries.join(rows_found, "qid", "left").filter(F.coalesce("rows", F.lit(0)) < min(k + 1, rows.count())).select("qid", "v")
    short = cut_lineage(short)
    if n_short := short.count():
        found = found.unionByName(all_compared(classes, short, k, n, n_short))
    return ranked(found, classes, queries, asked, k)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)

"""Operator 12: centroid clustering in exact whole numbers.

Vectors become whole numbers floor(scale * x) and lie in blocks of ``BLOCK`` rows, written once to the shared folder. A round reads the
blocks, finds each row's nearest centroid and sums rows by centroid; ``treeAggregate`` combines the sums of the tasks over a tree, so
that the driver meets one array of clusters x components, whatever the number of vectors.

Squared distances are |x|^2 - 2 x.c + |c|^2 in one matrix product a block. Rows and centroids whose components are at most
``limit`` go through BLAS in doubles: every number on the way is then a whole number below 2^53, so nothing is rounded. Other rows,
and other centroids, are compared in 64-bit integers while those hold the result, else in Python's integers. A centroid so far away
that any plain one is nearer to every plain row is left out for those rows.

Defined results: rows whose vector is null, of another length, or holds null or non-finite components are left out; rows with a null
vec_id are vectors like any other, but start a centroid only after all rows with an id; repeated rows count as often as they occur, and
rows with one id are ordered by their components; with fewer vectors than clusters there are as many centroids as vectors; an
empty table gives no rows; distances and inertias that 64 bits don't hold are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, spread_table

LENGTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
BLOCK, TREE = 4096, 3
LONG = (1 << 63) - 1


def limit(length: int) -> int:
    """The largest component for which length * (component + component)^2, and so every step of a distance, stays below 2^53."""
    return math.isqrt(((1 << 53) - 1) // length) // 2


def kept(vectors: DataFrame, length: int) -> DataFrame:
    """(vec_id, v): the rows of ``vectors`` (vec_id, embedding) that take part."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(v.isNotNull() & (F.size(v) == length) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)))


def to_blocks(rows: DataFrame) -> DataFrame:
    """(ids array<long>, v binary): up to ``BLOCK`` rows a block, their components as doubles one after the other."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(0).combine_chunks())
        data = whole.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([ids, pa.array([data.tobytes()], pa.binary())], names=["ids", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if held and size + part.num_rows > BLOCK:
                    yield block(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield block(held)

    return rows.mapInArrow(run, "ids array<long>, v binary")


def whole(row, scale: int) -> list[int]:
    """floor(scale * x) of each component, in integers."""
    return [n * scale // d for n, d in (float(x).as_integer_ratio() for x in row)]


def squared(rows: np.ndarray, centres: list[list[int]]) -> np.ndarray:
    """Squared distances of rows (numpy integers or Python's) to centroids, in 64-bit integers if they hold them, else in Python's."""
    reach = max(int(np.abs(rows).max()), max(abs(x) for c in centres for x in c))
    kind = np.int64 if rows.shape[1] * (2 * reach) ** 2 <= LONG else object
    rows, columns = rows.astype(kind), np.array(centres, dtype=object).astype(kind)
    return (rows * rows).sum(1)[:, None] - 2 * rows.dot(columns.T) + (columns * columns).sum(1)


class Nearest:
    """From a block of components to each row's nearest centroid, ties to the smaller number, in exact arithmetic."""

    def __init__(self, centres: list[list[int]], scale: int):
        self.centres, self.scale, self.length = centres, scale, len(centres[0])
        self.most = limit(self.length)
        reach = [max(map(abs, c)) for c in centres]
        self.plain = [j for j, r in enumerate(reach) if r <= self.most]
        # a row below ``most`` lies within 2^26.5 of a plain centroid, and farther than that from a centroid beyond this reach
        self.odd = [j for j, r in enumerate(reach) if r > self.most and (not self.plain or r <= self.most + (1 << 27))]
        self.c = np.array([centres[j] for j in self.plain], np.float64).reshape(-1, self.length)
        self.cc = (self.c * self.c).sum(1)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, components): distances and components are 64-bit where all fit, else Python's integers."""
        x = np.frombuffer(data, np.float64).reshape(-1, self.length)
        with np.errstate(over="ignore"):
            y = np.floor(self.scale * x)
        low = np.abs(y).max(1) <= self.most
        number, distance = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
        if low.any() and self.plain:
            rows = y[low]
            d = (rows * rows).sum(1)[:, None] - 2 * (rows @ self.c.T) + self.cc
            best = d.argmin(1)
            number[low], distance[low] = np.array(self.plain)[best], d[np.arange(len(d)), best].astype(np.int64)
        if low.all() and not self.odd:
            return number, distance, y.astype(np.int64)
        distance = distance.astype(object)
        values = y.astype(np.int64).astype(object) if low.all() else np.array([[int(z) for z in row] if ok else whole(r, self.scale) for row, ok, r in zip(y, low, x, strict=True)], dtype=object)
        if low.any() and self.odd:
            d = squared(values[low], [self.centres[j] for j in self.odd]).astype(object)
            best = d.argmin(1)
            found, other = d[np.arange(len(d)), best], np.array(self.odd)[best]
            if self.plain:
                nearer = (found < distance[low]) | ((found == distance[low]) & (other < number[low]))
                found, other = np.where(nearer, found, distance[low]), np.where(nearer, other, number[low])
            number[low], distance[low] = other, found
        if not low.all():
            d = squared(values[~low], self.centres).astype(object)
            best = d.argmin(1)
            number[~low], distance[~low] = best, d[np.arange(len(d)), best]
        return number, distance, values


def by_cluster(number: np.ndarray, values: np.ndarray, clusters: int) -> np.ndarray:
    """Sums of values (rows x columns) by number, as Python's integers."""
    if values.dtype == np.int64 and len(values) * int(np.abs(values).max(initial=0)) < 1 << 53:
        member = (number == np.arange(clusters)[:, None]).astype(np.float64)
        return (member @ values.astype(np.float64)).astype(np.int64).astype(object)
    sums = np.zeros((clusters, values.shape[1]), dtype=object)
    np.add.at(sums, number, values.astype(object))
    return sums


def combined(blocks: DataFrame, of: Callable[[bytes], np.ndarray]) -> np.ndarray | None:
    """The sum of an array of Python's integers over all blocks, over a tree of tasks."""
    return blocks.select("v").rdd.treeAggregate(None, lambda acc, r: of(r.v) if acc is None else acc + of(r.v), lambda a, b: b if a is None else a if b is None else a + b, TREE)


def first_centres(rows: DataFrame, clusters: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids, in that order."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.select(code.alias("code"), "v").orderBy(F.asc_nulls_last("code"), "v").limit(clusters).collect()
    return [whole(r.v, scale) for r in found]


def cluster(vectors: DataFrame, length: int = LENGTH, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for ``vectors`` (vec_id, embedding), and the centroids."""
    rows = kept(vectors, length)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centres = first_centres(rows, clusters, seed, scale)
    if not centres:
        return vectors.sparkSession.createDataFrame([], schema), centres
    blocks, n = cut_lineage(to_blocks(rows)), len(centres)
    for _ in range(rounds):
        nearest = Nearest(centres, scale)

        def sums(data: bytes, nearest: Nearest = nearest) -> np.ndarray:
            number, _, values = nearest(data)
            return np.hstack([np.bincount(number, minlength=n).astype(object)[:, None], by_cluster(number, values, n)])

        total = combined(blocks, sums)
        centres = [[int(s) // int(t[0]) for s in t[1:]] if t[0] else c for t, c in zip(total, centres, strict=True)]
    nearest = Nearest(centres, scale)

    def spread(data: bytes) -> np.ndarray:
        number, distance, _ = nearest(data)
        return by_cluster(number, distance[:, None], n)

    inertia = [int(x) for x in combined(blocks, spread)[:, 0]]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    fits = lambda x: int(x) if x <= LONG else None
    each, total = pa.array([fits(x) for x in inertia], pa.int64()), fits(sum(inertia))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, distance, _ = nearest(batch.column(1)[i].as_py())
                ids, at = batch.column(0)[i].values, pa.array(number)
                far = pa.array(distance if distance.dtype == np.int64 else [fits(x) for x in distance], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), far, each.take(at), pa.array([total] * len(ids), pa.int64()), pa.array(names).take(at)], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, schema), centres


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spread_table(spark, sf_dir, "embeddings"))[0]


def _sql() -> str:
    """Distances of whole numbers below 2^53 in doubles, which DuckDB's inner product sums without rounding."""
    step = lambda r: f"""a{r} AS MATERIALIZED (SELECT rid, vec_id, min({{'d': list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v), 'c': c.cluster}}) AS n
  FROM k, c{r} c GROUP BY rid, vec_id)"""  # noqa: E731
    move = lambda r: f"""m{r} AS (SELECT cluster, list(CASE WHEN x >= 0 THEN x // n ELSE -((-x + n - 1) // n) END::DOUBLE ORDER BY p) AS v FROM
  (SELECT n.c AS cluster, p, sum(k.v[p]::HUGEINT) AS x, count(*) AS n FROM a{r} a JOIN k USING (rid), range(1, {LENGTH + 1}) t(p) GROUP BY n.c, p) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))"""  # noqa: E731
    parts = [f"""k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
h AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM k), c0 AS MATERIALIZED (SELECT cluster, v FROM h WHERE cluster < {CLUSTERS})"""]
    for r in range(ROUNDS):
        parts += [step(r), move(r)]
    parts += [step(ROUNDS)]
    return f"""WITH {", ".join(parts)}
SELECT vec_id, n.c::INTEGER AS cluster, n.d::BIGINT AS distance, (sum(n.d::BIGINT) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(n.d::BIGINT) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = n.c"""


OP12_SQL = _sql()

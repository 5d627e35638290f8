"""Search by scanning: rows and queries meet in blocks, and a task returns its k best rows of each query.

Queries are dealt into blocks of ``CHUNK`` and rows into blocks of ``ROWS``, as Arrow data in one value each. Where all blocks of
queries are small they are broadcast, and rows stay where they are; else every block of rows is dealt to each block of
queries, over as many parts as there are partitions to fill. The driver sees neither. Behind that nothing is shuffled but k rows
for each query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.store import settle

CHUNK, ROWS, BROADCAST = 2048, 512, 32 << 20
#: Query blocks whose scorers a task holds at a time.
SCORERS = 4

#: From some queries, what scores an Arrow batch of rows: a matrix rows x queries, minus infinity for what is no hit.
Scorer = Callable[[pa.RecordBatch], np.ndarray]


@dataclass(frozen=True)
class Dealt:
    """Rows (doc, ...) that lie in blocks already: ``data`` has one column of that name, each value what :func:`packed` makes of some rows, and
    ``doc`` is the type of their ids."""

    data: DataFrame
    doc: str


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0]


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(part, data): the rows of each task, at most ``size`` in one value; part is the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                data = packed(whole.slice(at, size))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([data], pa.binary())], names=["part", "data"])

    return rows.mapInArrow(run, "part long, data binary")


def meet(rows: DataFrame | Dealt, queries: DataFrame) -> DataFrame:
    """(part, asked, data): every block of ``rows`` beside every block of ``queries``; part names the queries' block."""
    spark = queries.sparkSession
    queries = settle(queries)
    n = -(-queries.count() // CHUNK)
    if not n:
        return spark.createDataFrame([], "part long, asked binary, data binary")
    asked = blocks(queries.repartition(n), 1 << 31).select("part", F.col("data").alias("asked"))
    asked = settle(asked)
    data = rows.data if isinstance(rows, Dealt) else blocks(rows, ROWS * 8).select("data")
    if asked.agg(F.sum(F.octet_length("asked"))).first()[0] <= BROADCAST:
        return data.crossJoin(F.broadcast(asked)).select("part", "asked", "data")
    each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n)
    dealt = data.select("data", F.floor(F.rand(1) * each).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).cast("long").alias("part"))
    copies = asked.select("part", "asked", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).cast("long").alias("salt"))
    return dealt.join(copies, ["part", "salt"]).select("part", "asked", "data")


class Best:
    """The k best rows of each query so far, ties to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, max(100_000, 4 * queries * k)

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        row, query = np.nonzero((scores >= self.least) & (scores > -np.inf))
        if len(row):
            self.held.append((query, keys[row], scores[row, query]))
            self.size += len(row)
            if self.size > self.limit:
                self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, keys, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((keys, -scores, query))
        query, keys, scores = query[order], keys[order], scores[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        kept = place < self.k
        self.held, self.size = [(query[kept], keys[kept], scores[kept])], int(kept.sum())
        full = place == self.k - 1
        self.least[query[full]] = scores[full]
        return self.held[0]


def top_k(rows: DataFrame | Dealt, queries: DataFrame, k: int, scorer: Callable[[list[Row]], Scorer]) -> DataFrame:
    """(qid, doc, score, rank): the k best rows of ``rows`` (doc, ...) for each of ``queries`` (qid, ...), ties to the smaller doc.

    scorer: from a block of queries, in their order, to the function that scores a batch of rows. It runs in the tasks.
    """
    types = [dict(queries.dtypes)["qid"], rows.doc if isinstance(rows, Dealt) else dict(rows.dtypes)["doc"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers: dict[int, Scorer] = {}
        best: dict[int, tuple[pa.Array, Best]] = {}
        names = None
        for batch in batches:
            for part, asked, data in zip(*batch.columns, strict=True):
                part = part.as_py()
                if part not in scorers:
                    block = _read(asked.as_py())
                    if len(scorers) >= SCORERS:
                        scorers.clear()
                    scorers[part] = scorer([Row(**r) for r in block.to_pylist()])
                    best.setdefault(part, (block.column("qid"), Best(block.num_rows, k)))
                whole = _read(data.as_py())
                names = whole.schema.field("doc").type
                for at in range(0, whole.num_rows, ROWS):
                    some = whole.slice(at, ROWS)
                    best[part][1].add(some.column("doc").to_numpy(zero_copy_only=False), scorers[part](some))
        for qids, found in best.values():
            query, keys, scores = found.reduce()
            if len(query):
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(query)), pa.array(keys, names), pa.array(scores)], names=["qid", "doc", "score"])
        pa.default_memory_pool().release_unused()

    found = meet(rows, queries).mapInArrow(run, f"qid {types[0]}, doc {types[1]}, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def sharing(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, doc) of ``texts`` (doc, text) that hold a passage (qid, text) literally; empty passages take no part.

    All passages of a block are looked for in one pass over each text.
    """
    asked = passages.select("qid", F.col("text").cast("string").alias("passage")).filter("passage <> ''")
    rows = texts.select("doc", F.col("text").cast("string").alias("text")).filter("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders: dict[int, tuple[pa.Array, Callable[[str], set[int]]]] = {}
        for batch in batches:
            for part, held, data in zip(*batch.columns, strict=True):
                part = part.as_py()
                if part not in finders:
                    block = _read(held.as_py())
                    if len(finders) >= SCORERS:
                        finders.clear()
                    finders[part] = block.column("qid"), finder(block.column("passage").to_pylist())
                (qids, find), some = finders[part], _read(data.as_py())
                met = [(q, d) for d, text in enumerate(some.column("text").to_pylist()) for q in find(text)]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array([q for q, _ in met], pa.int64())), some.column("doc").take(pa.array([d for _, d in met], pa.int64()))], names=["qid", "doc"])

    return meet(rows, asked).mapInArrow(run, f"qid {dict(passages.dtypes)['qid']}, doc {dict(texts.dtypes)['doc']}").distinct()


def finder(passages: list[str]) -> Callable[[str], set[int]]:
    """From a text to the numbers of the passages in it: an automaton over all of them, or one by one where there is none."""
    try:
        from ahocorasick import Automaton
    except ImportError:
        return lambda text: {i for i, p in enumerate(passages) if p in text}
    same: dict[str, list[int]] = {}
    for i, p in enumerate(passages):
        same.setdefault(p, []).append(i)
    automaton = Automaton()
    for p, numbers in same.items():
        automaton.add_word(p, numbers)
    automaton.make_automaton()
    return lambda text: {i for _, numbers in automaton.iter(text) for i in numbers}

"""Operator 6: SimHash near-duplicate classes by pigeonhole blocks.

1. Each whole text gives a 64-bit fingerprint of its word shingles (one pass, no shuffle).
2. Equal fingerprints collapse to one row, so exact copies and empty texts never meet in a bucket.
3. Fingerprints are split into ``b`` blocks. Two of them at ``max_bits`` = t or fewer bits agree on at least b - t
   whole blocks, so every choice of b - t blocks is a table and the agreeing bits are its key. ``b`` follows the number
   of fingerprints so that a key has about as many bits as that number; every b gives the same links.
4. Rows meet by (table, key). A bucket over ``BUCKET_ROWS`` is cut into salted parts and every pair of parts becomes a
   task of its own, so that no task grows with a bucket. Inside a task keys are sorted, neighbours at distance 1, 2, ...
   in the same bucket are verified by Hamming distance, and only a spanning forest of the links leaves the task.
5. Components of the forest: minimum labels with pointer jumping; each round is cut by a checkpoint. A label is the smallest doc_id
   with its fingerprint, so components are never grouped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, partitions_for, small_side, spread_table

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
BUCKET_ROWS, TASK_ROWS = 4096, 1_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the text's shingles; without any word, zero."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_each:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            bits = np.fromiter((fingerprint(texts[i].as_py(), words_each) for i in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(count: int, max_bits: int) -> list[int]:
    """Masks of the tables: as many key bits as it takes to number ``count`` fingerprints, with the fewest blocks."""
    need = math.log2(max(2, count))
    blocks = next((b for b in range(max_bits + 1, 10) if (b - max_bits) * (64 // b) >= need), 10)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(choice) for choice in combinations(parts, blocks - max_bits)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _roots(left: np.ndarray, right: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each class) after the pairs left-right are joined."""
    while True:
        low = np.minimum(labels[left], labels[right])
        np.minimum.at(labels, labels[left], low)
        np.minimum.at(labels, labels[right], low)
        while not np.array_equal(labels, labels[labels]):
            labels = labels[labels]
        if np.array_equal(labels[left], labels[right]):
            return labels


def spanning_forest(cells: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of the same cell. Each class becomes a binary tree: no node has over three edges.

    fps: rows of one or more 64-bit words.
    """
    order = np.lexsort((*fps.T, cells))
    cells, fps = cells[order], np.ascontiguousarray(fps[order])
    rows = fps.view(np.dtype((np.void, fps.itemsize * fps.shape[1]))).ravel() if fps.shape[1] > 1 else fps.ravel()
    values, index = np.unique(rows, return_inverse=True)
    labels = np.arange(len(values))
    at, step = np.arange(len(fps) - 1), 1
    held: list[np.ndarray] = []
    size = 0
    while len(at):
        at = at[at + step < len(fps)]
        at = at[cells[at] == cells[at + step]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]).sum(1, dtype=np.int64) <= max_bits]
        if len(near):
            held.append(np.stack([index[near], index[near + step]]))
            size += len(near)
        if size > 500_000:
            pairs = np.concatenate(held, axis=1)
            labels, held, size = _roots(pairs[0], pairs[1], labels), [], 0
        step += 1
    if held:
        pairs = np.concatenate(held, axis=1)
        labels = _roots(pairs[0], pairs[1], labels)
    order = np.argsort(labels, kind="stable")
    ranked = labels[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.r_[starts, len(ranked)])
    place = np.arange(len(ranked)) - np.repeat(starts, sizes)
    child = np.flatnonzero(place > 0)
    parent = np.repeat(starts, sizes)[child] + (place[child] - 1) // 2
    words = values.view(np.uint64).reshape(-1, fps.shape[1])
    return words[order[child]], words[order[parent]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): a forest that joins the same fingerprints as all pairs of ``distinct.fp`` at ``max_bits`` or fewer bits do.

    ``distinct`` holds each fingerprint once and should be cheap to read again (a checkpoint): it is counted first.
    """
    spark = distinct.sparkSession
    count = distinct.count()
    masks = block_masks(count, max_bits)
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks))))
    rows = distinct.select("fp", tables.alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("t", "key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts"))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    salted = rows.join(small_side(large), ["t", "key"], "left").select("fp", "t", "key", parts.alias("parts"), F.pmod(F.xxhash64("fp", "t"), parts).cast("int").alias("p"))
    pairs = salted.select("fp", "t", "key", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    cells = pairs.select("fp", F.xxhash64("t", "key", F.least("p", "q"), F.greatest("p", "q")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if got:
            fps = np.concatenate([x for x, _ in got]).view(np.uint64)
            cell = np.concatenate([x for _, x in got])
            a, b = spanning_forest(cell, fps.reshape(-1, 1), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64).ravel()), pa.array(b.view(np.int64).ravel())], names=["a", "b"])

    n = partitions_for(count * len(masks), TASK_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartition(n, "cell").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest (rank, node) of the connected component.

    ranks: (node, rank) of all nodes. Each round takes the smallest label among the neighbours, then the label of that label. It
    ends when no label changes. Labels carry what is asked of a component, so nothing is ever grouped by component; the joins by
    label have large keys on one side alone, which adaptive execution splits.
    """
    both = cut_lineage(edges.filter(F.col("a") != F.col("b")).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    labels = cut_lineage(ranks.join(both.select(F.col("a").alias("node")).distinct(), "node").select("node", F.struct("rank", "node").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        over = labels.select(F.col("node").alias("at"), F.col("label").alias("over"))
        new = F.least("low", "over")
        step = cut_lineage(low.join(over, F.col("low.node") == F.col("at")).select("node", new.alias("label"), (new != F.col("label")).alias("moved")))
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, words_each: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero. Repeated doc_ids keep their rows; a null doc_id is carried, and a component whose
    doc_ids are all null has a null id. An empty table gives no rows. Other columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs, words_each))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    ranks = distinct.select(F.col("fp").alias("node"), F.struct(F.col("first").isNull().alias("none"), "first").alias("rank"))
    found = components(links(distinct, max_bits), ranks)
    member = cut_lineage(distinct.join(found, distinct.fp == found.node, "left").select("fp", F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("label.rank.first")).alias("component_id")))
    return prints.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread_table(spark, sf_dir, "documents"))

"""SimHash classes at a shingle similarity, for the pipeline: five-word shingles, Jaccard similarity of about 0.8 or more.

64 bits and a few differing ones catch about a quarter of such pairs, so this works with 256 bits: two texts whose sets
of shingles have Jaccard similarity j differ in a share acos(2j / (1 + j)) / pi of them on average. The fingerprints are
split into blocks under several fixed orders of their bits; pairs that share a block meet and are candidates by their
Hamming distance. Beyond some distance no number of blocks can guarantee a shared one; there are so many of them that a
pair at the threshold similarity shares one with probability ``HIT``, and a closer pair all but surely.

An estimate from bits has an error, so candidates are verified: a task returns the forest of its closest pairs, each of them a real
pair, and the shingles of both texts are compared. Texts of up to ``SKETCH`` different shingles are compared by all of them, longer
ones by their ``SKETCH`` smallest hashes (a standard error of 0.0125 at the threshold). Only pairs of ``SIMILARITY`` or more link.

Blocks have as many bits as leave ``PER_KEY`` unrelated fingerprints to a key, 14 at least. Large
buckets are cut into pairs of parts as in :mod:`.simhash`, sized from an eighth of the fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, partitions_for, small_side
from .simhash import BUCKET_ROWS, LOWER, SEED, _roots, components

BITS, SHINGLE_WORDS, SIMILARITY, HIT, LEAST_KEY, PER_KEY = 256, 5, 0.8, 0.98, 14, 16
WIDE_TASK_ROWS, HELD_PAIRS, SKETCH = 300_000, 500_000, 1024
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def differing(similarity: float) -> float:
    """Expected share of bits in which two texts of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


#: The expected distance at the threshold and two standard deviations more: what candidates may differ in.
MAX_BITS = round(BITS * differing(SIMILARITY) + 2 * math.sqrt(BITS * differing(SIMILARITY) * (1 - differing(SIMILARITY))))


def shingle_hashes(text: str | None, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the text's different shingles (fewer words: of the whole sequence); none without any word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=False)], np.uint64))


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> bytes:
    """SimHash of the text's different shingles as ``BITS`` bits; without any word, zeros."""
    different = shingle_hashes(text, words_each)
    if not len(different):
        return bytes(BITS // 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(different), 16_384):
        with np.errstate(over="ignore"):
            mixed = different[at : at + 16_384, None] * _LANES
            mixed ^= mixed >> np.uint64(32)
            mixed *= _LANES[3]
            mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(different), bitorder="little").tobytes()


def sketch(text: str | None, words_each: int = SHINGLE_WORDS) -> bytes:
    """The ``SKETCH`` smallest of the different shingles' hashes, cut to 32 bits."""
    return np.unique((shingle_hashes(text, words_each) >> np.uint64(32)).astype("<u4"))[:SKETCH].tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity from two sketches: exact where neither is cut, else of the hashes that both know of. Empty sets: 0."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    known = min((int(z[-1]) for z in (x, y) if len(z) == SKETCH), default=1 << 32)
    x, y = x[x <= known], y[y <= known]
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, body, fp): body is the hash of the text, fp its fingerprint. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            prints = [fingerprint(texts[i].as_py(), words_each) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary())], names=["doc_id", "body", "fp"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, body long, fp binary")


def block_plan(count: int) -> list[np.ndarray]:
    """Places of the bits of each block, for ``count`` fingerprints."""
    width = max(LEAST_KEY, math.ceil(math.log2(max(2, count / PER_KEY))))
    tables = math.ceil(math.log(1 - HIT) / math.log(1 - (1 - differing(SIMILARITY)) ** width))
    draw, blocks = np.random.default_rng(SEED), []
    while len(blocks) < tables:
        order = draw.permutation(BITS)
        blocks += [order[i : i + width] for i in range(0, BITS - width + 1, width)]
    return blocks[:tables]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): a forest over ``distinct.fp`` that joins fingerprints at ``max_bits`` or fewer bits that share a block.

    ``distinct`` holds each fingerprint once and should be cheap to read again (a checkpoint): it is counted first.
    """
    spark = distinct.sparkSession
    count = distinct.count()
    blocks = block_plan(count)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [np.left_shift(np.uint64(1), np.arange(len(b), dtype=np.uint64)) for b in blocks]
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                prints = whole.column(0)[at : at + 2048]
                bits = np.unpackbits(_bytes(prints), axis=1, bitorder="little")
                for t, (block, weight) in enumerate(zip(blocks, weights, strict=True)):
                    key = (bits[:, block] * weight).sum(1, dtype=np.uint64) * np.uint64(len(blocks)) + np.uint64(t)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), prints], names=["key", "fp"])

    rows = distinct.select("fp").mapInArrow(keyed, "key long, fp binary")
    eighth = distinct.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(8)) == 0).mapInArrow(keyed, "key long, fp binary")
    large = eighth.groupBy("key").agg((8 * F.count("*")).alias("n")).filter(F.col("n") > bucket_rows).select("key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts"))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    salted = rows.join(small_side(large), "key", "left").select("fp", "key", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("p"))
    pairs = salted.select("fp", "key", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    cells = pairs.select("fp", F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(_bytes(b.column(0)).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if got:
            a, b = closest_forest(np.concatenate([c for _, c in got]), np.concatenate([f for f, _ in got]), max_bits)
            spell = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([spell(a), spell(b)], names=["a", "b"])

    # a task joins what all its cells link, so fewer and larger tasks return fewer edges of a class that many cells hold
    n = partitions_for(count * len(blocks), WIDE_TASK_ROWS, spark.sparkContext.defaultParallelism)
    return cells.repartition(n, "cell").coalesce(n).mapInArrow(run, "a binary, b binary")


def minimum_forest(a: np.ndarray, b: np.ndarray, length: np.ndarray, nodes: int) -> np.ndarray:
    """Which of the edges a-b make a spanning forest of least length: every class takes its shortest edge to another, until none has any."""
    order = np.lexsort((b, a, length))
    a, b = a[order], b[order]
    labels, chosen = np.arange(nodes), []
    left = np.arange(len(a))
    while len(left := left[labels[a[left]] != labels[b[left]]]):
        best = np.full(nodes, len(a))
        np.minimum.at(best, labels[a[left]], left)
        np.minimum.at(best, labels[b[left]], left)
        chosen.append(np.unique(best[best < len(a)]))
        labels = _roots(a[chosen[-1]], b[chosen[-1]], labels)
    return order[np.concatenate(chosen)] if chosen else order[:0]


def closest_forest(cells: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the closest pairs among rows of the same cell that differ in at most ``max_bits`` bits; fps: rows of 64-bit words."""
    order = np.lexsort((*fps.T, cells))
    cells, fps = cells[order], np.ascontiguousarray(fps[order])
    rows = fps.view(np.dtype((np.void, fps.itemsize * fps.shape[1]))).ravel()
    values, index = np.unique(rows, return_inverse=True)
    held, size = np.zeros((3, 0), np.int64), 0
    fresh_pairs: list[np.ndarray] = []
    at, step = np.arange(len(fps) - 1), 1

    def reduced() -> np.ndarray:
        pairs = np.concatenate([held, *fresh_pairs], axis=1)
        return pairs[:, minimum_forest(pairs[0], pairs[1], pairs[2], len(values))]

    while len(at):
        at = at[at + step < len(fps)]
        at = at[cells[at] == cells[at + step]]
        bits = np.bitwise_count(fps[at] ^ fps[at + step]).sum(1, dtype=np.int64)
        near = (bits <= max_bits) & (bits > 0)
        if near.any():
            fresh_pairs.append(np.stack([index[at[near]], index[at[near] + step], bits[near]]))
            size += int(near.sum())
        if size > HELD_PAIRS:
            held, size = reduced(), 0
            fresh_pairs.clear()
        step += 1
    held = reduced()
    words = values.view(np.uint64).reshape(-1, fps.shape[1])
    return words[held[0]], words[held[1]]


def _bytes(prints: pa.Array) -> np.ndarray:
    """Fingerprints as a matrix of bytes."""
    size, (_, ends, data) = BITS // 8, prints.buffers()
    first = np.frombuffer(ends, np.int32)[prints.offset]
    return np.frombuffer(data, np.uint8, count=size * len(prints), offset=int(first)).reshape(-1, size).copy()


def verified(docs: DataFrame, distinct: DataFrame, edges: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """Those of ``edges`` (a, b) whose texts have a shingle similarity of ``SIMILARITY`` or more.

    distinct: (fp, first) with first = (none, doc_id, body), the row whose text stands for a fingerprint. Only texts that an edge
    names are sketched; a sketch has a fixed size, whatever the text's, so a text with many edges costs no more than they.
    """
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    named = edges.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(distinct, "fp").select("fp", "first.doc_id", "first.body")
    named = small_side(named.select("fp", F.col("doc_id").alias("_id"), F.col("body").alias("_body")))
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))
    texts = texts.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body"))).select("fp", "text")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(column[i].as_py(), words_each) for i in range(batch.num_rows)], pa.binary())], names=["fp", "sketch"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2), batch.column(3)
            near = [similarity(one[i].as_py(), two[i].as_py()) >= SIMILARITY - 1e-9 for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    sketches = cut_lineage(texts.mapInArrow(sketched, "fp binary, sketch binary").groupBy("fp").agg(F.min("sketch").alias("sketch")))
    of = lambda side: sketches.select(F.col("fp").alias(side), F.col("sketch").alias(f"s{side}"))
    return edges.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(compared, "a binary, b binary")


def keep_one(docs: DataFrame, words_each: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component, its columns as they are: the row with the smallest doc_id.

    Null and empty texts form one component. Of rows that share the smallest id, one with the smallest text hash stays. A
    component stays by a row with a null doc_id only where it has no other. An empty table gives no rows. Texts move once,
    by id and text hash, and those that a candidate names once more.
    """
    prints = fingerprints(docs, words_each)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("first")
    distinct = cut_lineage(prints.groupBy("fp").agg(first))
    linked = verified(docs, distinct, links(distinct, max_bits), words_each)
    found = components(linked, distinct.select(F.col("fp").alias("node"), F.col("first").alias("rank")))
    own, held, no, hashed = (fresh(docs, name) for name in ("_id", "_kept", "_row", "_body"))
    kept = distinct.join(found, distinct.fp == found.node, "left").filter(F.col("node").isNull() | (F.col("label.node") == F.col("fp")))
    kept = kept.select(F.col("first.doc_id").alias(own), F.col("first.body").alias(held))
    rows = docs.withColumn(hashed, F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept[own]) & (rows[hashed] == kept[held]), "left_semi")
    same = Window.partitionBy("doc_id", hashed).orderBy(F.length("text"))
    return rows.withColumn(no, F.row_number().over(same)).filter(F.col(no) == 1).drop(no, hashed)

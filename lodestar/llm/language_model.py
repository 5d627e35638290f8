"""Operator 11: scores of a smoothed n-gram model, by a weighted backoff automaton.

The model. Words are the contract's, and each text ends in one end token. With c(.) counted in the training texts, N tokens and V
different ones, p(w) = (c(w) + 1) / (N + V + 1), and for a history h of one word or more
p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m), h' being h without its first word and m the order's ``PRIOR``; unseen histories give
p(w | h'). Each p(. | h) adds up to one over the known words and one unknown word.

The automaton. Its states are the empty history and the n-grams, shorter than the order, that training texts hold. An n-gram h w that they
hold is an arc from h, of weight log p(w | h), to its longest end that is a state. A state's failure arc leads to h', with weight
log(m / (c(h) + m)). The empty state has an arc for each word. A text is one walk from left to right: the state is carried along, failure
arcs are followed until an arc has the next word, and weights add up.

Scale. The model grows with the corpus and fits nowhere whole, so each slice of texts (``SLICE`` tokens) walks on the part of it that its
own n-grams name. A slice is written once, as numbers of its words. It sends its different n-grams with their counts in training texts,
as sorted 56-bit fingerprints (single words as they are), packed, to the parts that own them; a part adds up what all slices sent and
answers each with totals in the order it asked. So n-grams are merged before the shuffle, a frequent one is a number a slice, and no
part depends on a key. Totals come back to the slice, which builds its automaton and walks all its texts at once, one step for each place.
Of 10^8 different n-grams 0.07 pairs are expected to share a fingerprint, of 10^11 one in a million has a partner; such two add up
their counts. What was sent to the parts is let go before their answers are dealt, so that both never lie on the disks at once.

Defined results: null texts are empty, which have the end token alone; rows with a null doc_id train and are not held out; repeated rows count
as often as they occur; without training texts N and V are 0 and every token has probability 1; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, let_go, partitions_for, spread_table, written

ORDER, PRIOR, SLICE, PART_TOKENS = 3, {2: 300.0, 3: 30.0}, 1_500_000, 2_000_000
#: Bits of a fingerprint.
PRINT = 56
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The end token; no word is empty. Its number is 0 in every slice.
END = b""

SLICES = "slice long, order int, part int, ids array<long>, train array<boolean>, sizes array<int>, words binary, data binary"


def packed(numbers: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}").reshape(-1, 1).view(np.uint8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd"), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def listed(words) -> bytes:
    """Words, none of which holds a line end, compressed."""
    data = b"\n".join(words)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unlisted(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b"\n")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    """Rows of ``SLICES``; columns that a row lacks are null."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in SLICES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(names, kinds, strict=True)], names=names)


def to_slices(docs: DataFrame, size: int = SLICE) -> DataFrame:
    """Texts dealt into slices: ids and training marks of the rows, tokens of each text, different words, and each token's word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("train", ~held_out())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 24, 0
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids, train, parts, total = [], [], [], 0

        def whole(name: int) -> pa.RecordBatch:
            return batch_of([{"slice": name, "order": 0, "ids": ids, "train": train, "sizes": list(map(len, parts)), "words": listed(number), "data": packed(np.concatenate(parts), 4)}])

        for batch in batches:
            for doc, text, learnt in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("train").to_pylist(), strict=True):
                if not ids:
                    number.clear()
                    number[END]
                words = text.as_py().translate(_LOWER).split()
                words.append(END)
                ids.append(doc)
                train.append(learnt)
                parts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                total += len(words)
                if total >= size:
                    yield whole(base + made)
                    ids, train, parts, total, made = [], [], [], 0, made + 1
        if ids:
            yield whole(base + made)

    return cut_lineage(rows.mapInArrow(run, SLICES))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Slice:
    """A slice's tokens and its different n-grams of each order, in an order that asking and answering share."""

    def __init__(self, sizes: list[int], train: list[bool], words: list[bytes], data: bytes, order: int, parts: int):
        self.sizes, self.words = np.array(sizes, np.int64), words
        self.x = unpacked(data, 4).astype(np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(np.array(train, bool), self.sizes)
        place = np.arange(len(self.x), dtype=np.int32) - np.repeat(self.starts, self.sizes).astype(np.int32)
        owner = np.array([zlib.crc32(w) for w in words], np.uint64) * np.uint64(parts) >> np.uint64(32)
        #: Words by the part that owns them, and where each part begins.
        self.by_part = np.argsort(owner, kind="stable")
        self.word_cuts = np.searchsorted(owner[self.by_part], np.arange(parts + 1))
        self.word_counts = np.bincount(self.x[self.train], minlength=len(words))
        #: Of each longer order: different fingerprints, counts in training texts, places in the text, and each place's n-gram.
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        prints = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[self.x]
        keys = prints
        for k in range(2, order + 1):
            keys = mixed(np.r_[np.uint64(0), keys[:-1]] * np.uint64(3) + prints)
            at = np.flatnonzero(place >= k - 1).astype(np.int32)
            found, number = np.unique(keys[at] >> np.uint64(64 - PRINT), return_inverse=True)
            counts = np.bincount(number, self.train[at], len(found)).astype(np.int64)
            self.grams[k] = found, counts, at, number.astype(np.int32)
        self.parts = parts

    def cuts(self, k: int) -> np.ndarray:
        """Where each part's fingerprints begin: parts are ranges of them."""
        return np.searchsorted((self.grams[k][0] >> np.uint64(PRINT - 32)) * np.uint64(self.parts) >> np.uint64(32), np.arange(self.parts + 1))


def ranges(cuts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of the parts that hold something."""
    full = np.flatnonzero(np.diff(cuts))
    return zip(full.tolist(), cuts[full].tolist(), cuts[full + 1].tolist(), strict=True)


def asked(slices: DataFrame, order: int, parts: int) -> DataFrame:
    """What each slice sends to each part: words or fingerprints, and their counts in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                s, name = Slice(r["sizes"], r["train"], unlisted(r["words"]), r["data"], order, parts), r["slice"]
                rows = []
                for part, start, end in ranges(s.word_cuts):
                    mine = s.by_part[start:end]
                    rows.append({"slice": name, "order": 1, "part": part, "words": listed(s.words[i] for i in mine.tolist()), "data": packed(s.word_counts[mine], 4)})
                for k in range(2, order + 1):
                    found, counts = s.grams[k][:2]
                    for part, start, end in ranges(s.cuts(k)):
                        gaps = packed(np.diff(found[start:end], prepend=np.uint64(0)), 8)
                        rows.append({"slice": name, "order": k, "part": part, "data": len(gaps).to_bytes(8, "little") + gaps + packed(counts[start:end], 4)})
                yield batch_of(rows)

    return slices.mapInArrow(run, SLICES)


def answered(requests: DataFrame, parts: int) -> DataFrame:
    """Each request's totals over all slices, in its own order; from each part also a row of order -1 with its number of known words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, list[tuple[int, int, int]]] = {}
        keys: dict[int, list[np.ndarray]] = {}
        counts: dict[int, list[np.ndarray]] = {}
        number = defaultdict(int)
        number.default_factory = number.__len__
        for batch in batches:
            for r in batch.select(["slice", "order", "part", "words", "data"]).to_pylist():
                k, data = r["order"], r["data"]
                if k == 1:
                    n = unpacked(data, 4)
                    found = np.fromiter(map(number.__getitem__, unlisted(r["words"])), np.int64, len(n))
                else:
                    end = 8 + int.from_bytes(data[:8], "little")
                    found, n = np.cumsum(unpacked(data[8:end], 8), dtype=np.uint64), unpacked(data[end:], 4)
                heads.setdefault(k, []).append((r["slice"], r["part"], len(found)))
                keys.setdefault(k, []).append(found)
                counts.setdefault(k, []).append(n)
        known = 0
        for k, asked_ in heads.items():
            all_keys, n = np.concatenate(keys.pop(k)), np.concatenate(counts.pop(k))
            place = all_keys if k == 1 else np.unique(all_keys, return_inverse=True)[1]
            del all_keys
            total = np.bincount(place, n).astype(np.int64)
            if k == 1:
                known = int((total > 0).sum())
            of, at = total[place], 0
            for name, part, size in asked_:
                yield batch_of([{"slice": name, "order": k, "part": part, "data": packed(of[at : at + size], 8)}])
                at += size
        if known:
            yield batch_of([{"order": -1, "sizes": [known]}])

    return written(requests.repartition(parts, "part").mapInArrow(run, SLICES))


class Automaton:
    """States, arcs and failure arcs of the n-grams of a slice; state 0 is the empty history.

    A state of k words has at most one arc that reads the word at a place: the n-gram of k + 1 words that ends there. So arcs are found
    by place: ``arcs[k + 1]`` names, for each place, the arc that a state of k words takes there, or none.
    """

    def __init__(self, s: Slice, totals: dict[int, np.ndarray], n: int, v: int, priors: dict[int, float]):
        words, top = len(s.words), max(totals)
        empty = (totals[1] + 1.0) / (n + v + 1.0)
        self.first = np.log10(empty)
        # a state for each word but the end, and for each longer n-gram below the order, that training texts hold
        state = {1: np.where((totals[1] > 0) & (np.arange(words) > 0), np.arange(words), 0)}
        size = words
        for k in range(2, top):
            state[k] = np.where(totals[k] > 0, size + np.arange(len(totals[k])), 0)
            size += len(totals[k])
        self.enter = state[1] if top > 1 else np.zeros(words, np.int64)
        self.fail, self.fall, self.length = np.zeros(size, np.int64), np.zeros(size), np.zeros(size, np.int8)
        if top > 1:
            self.fall[:words], self.length[1:words] = np.log10(priors[2] / (totals[1] + priors[2])), 1
        self.arcs, self.weights, self.targets = {}, {}, {}
        # of the (k-1)-gram that ends at each place: the probability of its last word, its state and its count
        chance, held, count = empty[s.x], state[1][s.x], totals[1][s.x]
        for k in range(2, top + 1):
            found, _, at, number = s.grams[k]
            some = np.zeros(len(found), np.int64)
            some[number] = at  # a place of each n-gram
            seen = np.flatnonzero(totals[k] > 0)
            here, before = some[seen], some[seen] - 1
            p = (totals[k][seen] + priors[k] * chance[here]) / (count[before] + priors[k])
            self.weights[k], self.targets[k] = np.zeros(len(found)), np.zeros(len(found), np.int64)
            self.weights[k][seen], self.targets[k][seen] = np.log10(p), state[k][seen] if k < top else held[here]
            self.arcs[k] = np.full(len(s.x), -1, np.int32)
            self.arcs[k][at] = np.where(totals[k] > 0, np.arange(len(found)), -1)[number]
            if k < top:
                own = state[k][seen]
                self.fail[own], self.length[own] = held[here], k
                self.fall[own] = np.log10(priors[k + 1] / (totals[k][seen] + priors[k + 1]))
                each = np.zeros(len(found))
                each[seen] = p
                chance, held, count = np.zeros(len(s.x)), np.zeros(len(s.x), np.int64), np.zeros(len(s.x), np.int64)
                chance[at], held[at], count[at] = each[number], state[k][number], totals[k][number]

    def walk(self, s: Slice) -> np.ndarray:
        """The log10 probability of each text: all texts advance together, each from the state that it has reached."""
        order = np.argsort(-s.sizes, kind="stable")
        starts, sizes = s.starts[order], s.sizes[order]
        score, state = np.zeros(len(order)), np.zeros(len(order), np.int64)
        alive = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        for step, n in enumerate(alive.tolist()):
            place = starts[:n] + step
            left = np.arange(n)
            for k in sorted(self.arcs, reverse=True):
                mine = self.length[state[left]] == k - 1
                if not mine.any():
                    continue
                at = left[mine]
                arc = self.arcs[k][place[at]]
                hit = arc >= 0
                taken, arc = at[hit], arc[hit]
                score[taken] += self.weights[k][arc]
                state[taken] = self.targets[k][arc]
                missed = at[~hit]
                score[missed] += self.fall[state[missed]]
                state[missed] = self.fail[state[missed]]
                left = np.concatenate([left[~mine], missed])
            word = s.x[place[left]]
            score[left] += self.first[word]
            state[left] = self.enter[word]
        out = np.zeros(len(order))
        out[order] = score
        return out


def score_documents(docs: DataFrame, order: int = ORDER, priors: dict[int, float] | None = None, slice_tokens: int = SLICE, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs`` (doc_id, text)."""
    priors = priors or PRIOR
    spark, slices = docs.sparkSession, to_slices(docs, slice_tokens)
    sizes = slices.select(F.explode(F.arrays_zip("train", "sizes")).alias("t"))
    sums = sizes.agg(F.sum("t.sizes"), F.sum(F.when(F.col("t.train"), F.col("t.sizes")))).first()
    total, n = sums[0] or 0, sums[1] or 0
    parts = partitions_for(total, part_tokens, spark.sparkContext.defaultParallelism)
    answers = answered(asked(slices, order, parts), parts)
    let_go(spark)
    v = answers.filter(F.col("order") == -1).agg(F.sum(F.get("sizes", 0))).first()[0] or 0

    def run(rows: pa.Table) -> pa.Table:
        held, heads = {}, None
        for r in rows.to_pylist():
            if r["order"] == 0:
                heads = r
            else:
                held.setdefault(r["order"], []).append((r["part"], r["data"]))
        s = Slice(heads["sizes"], heads["train"], unlisted(heads["words"]), heads["data"], order, parts)
        totals = {k: np.concatenate([unpacked(data, 8) for _, data in sorted(held[k])]).astype(np.int64) if k in held else np.zeros(0, np.int64) for k in range(1, order + 1)}
        by_word = np.zeros(len(s.words), np.int64)
        by_word[s.by_part] = totals[1]
        totals[1] = by_word
        base = np.add.reduceat(np.log10((by_word + 1.0) / (n + v + 1.0))[s.x], s.starts)
        known = np.add.reduceat((by_word > 0)[s.x].astype(np.int64), s.starts)
        score = Automaton(s, totals, n, v, priors).walk(s)
        held_ = ~np.array(heads["train"], bool)
        columns = [pa.array(heads["ids"], pa.int64()), pa.array(held_), pa.array(s.sizes), pa.array(known), pa.array(np.full(len(held_), n)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return slices.unionByName(answers.filter(F.col("order") > 0)).groupBy("slice").applyInArrow(run, schema)


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spread_table(spark, sf_dir, "documents"))

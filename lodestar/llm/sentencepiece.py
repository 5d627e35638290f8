"""Operator 7: SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are escaped as the model's normaliser does (a dummy space first, spaces as U+2581) and cut before runs of spaces; no
piece crosses such a cut, so the best segmentation of a text is that of its words. New words of equal length form one
matrix of code points: rolling hashes of all their substrings of one length are looked up at once in that length's
sorted piece hashes (and compared with the piece itself), and all words advance together from left to right, vectorised
maxima of score sums storing the length of the last piece. Ties go to the longer last piece. A character that no piece
covers scores below everything and becomes its UTF-8 bytes' pieces (or the unknown id without byte pieces).

The segmentation is the one with the largest score sum, which is what unigram models define. For a model that was made
by pair merges it can differ from the merge order's; it decodes to the same text either way.

Words of more than ``LONG`` characters (scripts without spaces, encoded data) are looked up in the same way in slices of
places, and their sums are carried from place to place over the pieces found there, so time and memory stay in proportion
to the text.

Supported are models that add a dummy space and change nothing else about a text; others raise a ValueError.

Scale: one pass, no shuffle. Between batches a worker keeps at most ``CACHE_BYTES`` of words of at most ``CACHE_LENGTH`` characters with
their ids; matrices have about ``CELLS`` cells at most.
"""

from __future__ import annotations

import math
import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_table

SPACE, CACHE_BYTES, ENTRY_BYTES, CACHE_LENGTH, CELLS, LONG, UNKNOWN_PENALTY = "▁", 48 << 20, 104, 64, 100_000, 512, 10.0
FILTER_BITS = 18
#: Texts that normalisers change: repeated and outer spaces, wide letters, ligatures, other white space.
PROBES = ("a  b", " a", "a ", "Ａ ﬁ", "a\tb\nc", "É e\u0301")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, MULTIPLIER)])


def _prefix_hashes(points: np.ndarray) -> np.ndarray:
    """h[i]: for each column the sum of (code point + 1) * multiplier ** position over the first i characters."""
    length, n = points.shape
    with np.errstate(over="ignore"):
        steps = (points.astype(np.uint64) + np.uint64(1)) * _powers(max(0, length - 1))[:length, None]
        return np.concatenate([np.zeros((1, n), np.uint64), np.add.accumulate(steps, axis=0, dtype=np.uint64)])


class Pieces:
    """A SentencePiece model's pieces and scores, and Viterbi over them."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece

        if proto is None and path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_proto=proto) if proto else sentencepiece.SentencePieceProcessor(model_file=path)
        if any(model.normalize(t) != SPACE + t.replace(" ", SPACE) for t in PROBES):
            raise ValueError("this model normalises texts, which is not supported")
        self.unknown = model.unk_id()
        self.text: list[bytes] = []
        self.bytes = np.full(256, self.unknown, np.int64)
        usable: dict[int, list[int]] = defaultdict(list)
        names, scores = [], []
        for i in range(model.vocab_size()):
            name = model.id_to_piece(i)
            names.append(name)
            scores.append(model.get_score(i))
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.bytes[value] = i
                self.text.append(bytes([value]))
            elif model.is_control(i):
                self.text.append(b"")
            elif i == self.unknown:
                self.text.append(" ⁇ ".encode())
            else:
                self.text.append(name.replace(SPACE, " ").encode())
                if not model.is_unused(i):
                    usable[len(name)].append(i)
        self.scores = np.array(scores, np.float64)
        self.sizes = [len(name) for name in names]
        self.lowest = min(self.scores[i] for ids in usable.values() for i in ids) - UNKNOWN_PENALTY
        self.longest = max(usable)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, ids in usable.items():
            points = np.ascontiguousarray(_points([names[i] for i in ids], length).T)
            hashes = _prefix_hashes(points)[-1]
            order = np.argsort(hashes, kind="stable")
            maybe = np.zeros(1 << FILTER_BITS, bool)
            maybe[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.by_length[length] = hashes[order], np.array(ids, np.int32)[order], points[:, order], maybe
        inner = any(SPACE in names[i].lstrip(SPACE) for ids in usable.values() for i in ids)
        self.words = re.compile("(?s).+" if inner else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _lookup(self, points: np.ndarray, prefix: np.ndarray, powers: np.ndarray, length: int) -> np.ndarray:
        """Ids of the substrings of one length by place and word, -1 where there is no such piece."""
        places = len(points) - length + 1
        found = np.full((places, points.shape[1]), -1, np.int32)
        if length not in self.by_length:
            return found
        hashes, ids, spelled, maybe = self.by_length[length]
        with np.errstate(over="ignore"):
            # the pieces' hashes start at power 0: take the place's power off by its inverse
            wanted = (prefix[length:] - prefix[:places]) * powers[:places, None]
        place, word = np.nonzero(maybe[wanted >> np.uint64(64 - FILTER_BITS)])
        wanted = wanted[place, word]
        at = np.searchsorted(hashes, wanted)
        at[at == len(hashes)] = 0
        same = hashes[at] == wanted
        place, word, at = place[same], word[same], at[same]
        same = np.ones(len(place), bool)
        for k in range(length):
            same &= points[place + k, word] == spelled[k, at]
        found[place[same], word[same]] = ids[at[same]]
        return found

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids, as int32 bytes, of words of one length."""
        length, n_words = len(words[0]), len(words)
        points = np.ascontiguousarray(_points(words, length).T)
        prefix = _prefix_hashes(points)
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(length, np.uint64(pow(int(MULTIPLIER), -1, 1 << 64)))])
        sizes = [n for n in range(min(length, self.longest), 0, -1) if n in self.by_length or n == 1]
        ids = np.full((len(sizes), length, n_words), -1, np.int32)
        for i, n in enumerate(sizes):
            ids[i, : length - n + 1] = self._lookup(points, prefix, powers, n)
        gains = np.where(ids >= 0, self.scores[ids], -np.inf)
        np.copyto(gains[-1], self.lowest, where=ids[-1] < 0)
        best = np.full((length + 1, n_words), -np.inf)
        best[0] = 0
        last = np.zeros((length + 1, n_words), np.int8)  # the last piece's place in sizes
        for end in range(1, length + 1):
            for i, n in enumerate(sizes):
                if n <= end:
                    score = best[end - n] + gains[i, end - n]
                    better = score > best[end]
                    np.copyto(best[end], score, where=better)
                    np.copyto(last[end], np.int8(i), where=better)
        step_of, column = np.array(sizes), np.arange(n_words)
        end, steps = np.full(n_words, length), []
        while (end > 0).any():
            way = last[end, column]
            begin = end - step_of[way]
            steps.append(np.where(end > 0, ids[way, begin, column], -2))
            end = np.where(end > 0, begin, 0)
        table = np.ascontiguousarray(np.array(steps[::-1], np.int32).T)
        count = (table != -2).sum(1)
        width, spelled = table.shape[1], table.tobytes()
        out = [spelled[4 * (w * width + width - c) : 4 * (w + 1) * width] for w, c in enumerate(count.tolist())]
        for w in np.flatnonzero((table == -1).any(1)):
            out[w] = self._with_bytes(words[w], table[w, width - count[w] :].tolist())
        return out

    def segment_long(self, word: str) -> bytes:
        """Ids, as int32 bytes, of one long word, with the same sums and ties as in :meth:`segment`."""
        points = _points([word], len(word)).T
        sizes = [n for n in range(min(len(word), self.longest), 0, -1) if n in self.by_length or n == 1]
        best, last, piece = [-math.inf] * (len(word) + 1), [0] * (len(word) + 1), [-1] * (len(word) + 1)
        best[0] = 0.0
        step = max(1, CELLS // len(sizes))
        for start in range(0, len(word), step):
            part = np.ascontiguousarray(points[start : start + step + self.longest - 1])
            prefix, here = _prefix_hashes(part), min(step, len(word) - start)
            with np.errstate(over="ignore"):
                powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(part), np.uint64(pow(int(MULTIPLIER), -1, 1 << 64)))])
            ids = np.full((len(sizes), here), -1, np.int32)
            for i, n in enumerate(sizes):
                if n <= len(part):
                    found = self._lookup(part, prefix, powers, n)[:here, 0]
                    ids[i, : len(found)] = found
            known = ids >= 0
            known[-1] = True
            # places in order, at each the longer pieces first
            place, way = np.nonzero(known.T)
            found = ids[way, place]
            gains = np.where(found >= 0, self.scores[found], self.lowest)
            ends = place + start + np.array(sizes)[way]
            for begin, end, gain, i, name in zip((place + start).tolist(), ends.tolist(), gains.tolist(), way.tolist(), found.tolist(), strict=True):
                score = best[begin] + gain
                if score > best[end]:
                    best[end], last[end], piece[end] = score, sizes[i], name
        out, end = [], len(word)
        while end:
            out.append(piece[end])
            end -= last[end]
        out.reverse()
        return self._with_bytes(word, out) if -1 in out else np.array(out, np.int32).tobytes()

    def _with_bytes(self, word: str, pieces: list[int]) -> bytes:
        """The ids of a word in which some characters (-1) have no piece."""
        full, at = array("i"), 0
        for i in pieces:
            if i >= 0:
                full.append(i)
                at += self.sizes[i]
            else:
                full.extend(self.bytes[list(word[at].encode("utf-8", "surrogatepass"))].tolist())
                at += 1
        return full.tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not in the cache."""
        groups: dict[int, list[str]] = defaultdict(list)
        for word in words:
            groups[len(word)].append(word)
        found: dict[str, bytes] = {}
        for length, group in groups.items():
            if length > LONG:
                found.update((word, self.segment_long(word)) for word in group)
                continue
            step = max(1, CELLS // length)
            for i in range(0, len(group), step):
                found.update(zip(group[i : i + step], self.segment(group[i : i + step]), strict=True))
        return found

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.cache)
        if new:
            self.cache.update(self.learn(new))
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]
        for word in new:
            if len(word) > CACHE_LENGTH:
                del self.cache[word]
            else:
                self.held += sys.getsizeof(word) + sys.getsizeof(get(word)) + ENTRY_BYTES
        if self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0
        return out

    def decode(self, ids) -> str:
        text, n = self.text, len(self.text)
        if ids and (None in ids or not 0 <= min(ids) <= max(ids) < n):
            ids = [i for i in ids if i is not None and 0 <= i < n]
        joined = b"".join([text[i] for i in ids]).decode("utf-8", "replace")
        return joined[1:] if joined.startswith(" ") else joined


ROWS = 1024


@lru_cache(maxsize=2)
def pieces_of(path: str | None) -> Pieces:
    """The model at ``path``, kept with its words for the worker's next tasks."""
    return Pieces(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text). Null and empty texts have no ids.

    Null and repeated doc_ids keep their rows. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = pieces.encode_batch(batch.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) for rows (doc_id, ids). Null ids are an empty text; null and unknown elements are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = batch.column(1).fill_null([])
                flat = ids.flatten()
                flat = flat.to_pylist() if flat.null_count else flat.to_numpy().tolist()
                ends = np.cumsum([0, *pc.list_value_length(ids).to_pylist()]).tolist()
                texts = [pieces.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, and the checksum of the text that they decode to."""
    back = decode(encode(spread_table(spark, sf_dir, "documents")))
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))

"""The tokens of :mod:`.text` for whole tables: texts are counted in Arrow batches, and every different word is worked out once a task.

A column expression takes each word of each text apart again; texts repeat their words, so a memo of words is some twenty
times faster. Search tokens are cut and counted as arrays, a batch at a time. Both give the same tokens (tests compare them on the tables).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Words that a task remembers, and the longest of them.
MEMO, LONGEST = 200_000, 64
#: Texts that are counted at a time.
ROWS = 512
_WORD, _PART = re.compile(T.IDENTIFIER), re.compile(T.PARTS)
_STOP = frozenset(T.STOP_WORDS)


#: The letters that the table's endings end in.
_LAST = "sgde"
_ENDINGS = [(re.compile(ending), "".join(f"\\{x}" if x.isdigit() else x for x in kept)) for ending, kept in T.ENDINGS]


def stem(token: str) -> str:
    """:func:`.text.stem` of one token, by the same table of endings."""
    if token[-1:] not in _LAST:
        return token
    return reduce(lambda word, rule: rule[0].sub(rule[1], word), _ENDINGS, token)


def pieces(word: str) -> Iterator[str]:
    """An identifier in lower case, and behind it the words that it is made of, if they are others."""
    whole = word.lower()
    yield whole
    inner = list(map(str.lower, _PART.findall(word)))
    if "_" in word or len(inner) > 1:
        yield from filter(whole.__ne__, inner)


def search_tokens(word: str, drop_stop_words: bool = False) -> tuple[str, ...]:
    """What one identifier adds to :func:`.text.tokens`."""
    if word.isalpha() and word[1:].islower():
        whole = word.lower()
        return () if drop_stop_words and whole in _STOP else (stem(whole),)
    dropped = _STOP if drop_stop_words else ()
    return tuple(map(stem, (t for t in pieces(word) if t[1:] and t not in dropped)))


def hashing_tokens(word: str) -> tuple[str, ...]:
    """What one identifier adds to :func:`.text.hashing_tokens`."""
    return (word.lower(), *(p.lower() for p in _PART.findall(word) if len(p) > 1))


class Memo(dict):
    """A function of a word that remembers a bounded number of short words."""

    def __init__(self, function: Callable):
        super().__init__()
        self.function = function

    def __missing__(self, word: str):
        value = self.function(word)
        if len(word) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value


def counts(text: str | None, tokens: Memo) -> Counter:
    """How often each token of a text occurs."""
    found: Counter = Counter()
    for word, n in Counter(_WORD.findall(text or "")).items():
        for token in tokens[word]:
            found[token] += n
    return found


def lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes, dtype=np.int64)], pa.int32()), values)


def codes(terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of ``terms`` in their order, and the term of each number."""
    coded = terms.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(order)


#: Bytes of letters, digits and underscores.
_HELD = np.isin(np.arange(256), np.frombuffer(b"_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))


def word_runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, run): the runs of letters, digits and underscores in ``texts``. A run holds one identifier, behind its first digits."""
    texts = texts.cast(pa.string()).fill_null("")
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    borders = ends[1:] - ends[0]
    held = _HELD[data]
    first = held.copy()
    first[1:] &= ~held[:-1]
    inner = borders[borders < len(data)]
    first[inner] = held[inner]
    starts = np.flatnonzero(first)
    sizes = np.add.reduceat(held, starts, dtype=np.int64) if len(starts) else starts
    places = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return np.searchsorted(borders, starts, "right"), pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[held]))


def tokens_of_run(run: str) -> tuple[str, ...]:
    word = run.lstrip("0123456789")
    return search_tokens(word) if word else ()


def counted_terms(rows: DataFrame, key: str, boost: int = 0) -> DataFrame:
    """(key, dl, terms): the number of search tokens of ``text``, and array<struct<term, tf>> in the order of terms.

    With a ``symbol`` column, its tokens count ``boost`` times more.
    """
    source, run = counting(rows, key, boost)
    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, dl int, terms array<struct<term:string,tf:int>>")


def counting(rows: DataFrame, key: str, boost: int = 0) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """The rows that are counted, and what makes batches of :func:`counted_terms` from their batches in a task."""
    symbol = F.col("symbol").cast("string") if boost and "symbol" in rows.columns else F.lit(None).cast("string")
    source = rows.select(key, F.col("text").cast("string").alias("text"), symbol.alias("symbol"))

    def counted(batch: pa.RecordBatch, tokens: Memo) -> pa.RecordBatch:
        row, runs = word_runs(batch.column(1))
        if boost:
            more, named = word_runs(batch.column(2))
            row, runs = np.concatenate([row, *[more] * boost]), pa.concat_arrays([runs, *[named] * boost])
        coded = runs.dictionary_encode()
        each = [tokens[w] for w in coded.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in each], np.int64)
        starts, held = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        number, names = codes(pa.array(chain.from_iterable(each), pa.string()))
        # every run's tokens, one after the other
        copies = sizes[held]
        which = np.repeat(np.arange(len(held)), copies)
        term = number[starts[held][which] + np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)]
        row = row[which]
        found, tf = np.unique(row * max(1, len(names)) + term, return_counts=True)
        owner, term = np.divmod(found, max(1, len(names)))
        column = lists(pa.StructArray.from_arrays([names.take(pa.array(term)), pa.array(tf, pa.int32())], names=["term", "tf"]), np.bincount(owner, minlength=batch.num_rows))
        dl = np.bincount(row, minlength=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int32()), column], names=[key, "dl", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Memo(tokens_of_run)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                yield counted(whole.slice(at, ROWS), tokens)
            # a worker that later tasks use again gives back what it does not hold
            pa.default_memory_pool().release_unused()

    return source, run


def hashed(tokens: tuple[str, ...], dimensions: int) -> tuple[tuple[int, int], ...]:
    """(bucket, sign) of each token: its MD5 modulo the dimensions, and bit 64 of it."""
    codes = [int.from_bytes(md5(t.encode()).digest(), "big") for t in tokens]
    return tuple((code % dimensions, 1 if code >> 64 & 1 else -1) for code in codes)


def hashing_vectors(rows: DataFrame, key: str, dimensions: int) -> DataFrame:
    """(key, bucket, w): the hashing embedder's non-zero entries of ``text``, as two arrays a row: signed counts, damped by the
    logarithm and scaled to length one."""
    source = rows.select(key, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Memo(lambda word: hashed(hashing_tokens(word), dimensions))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                buckets, weights, sizes = [], [], []
                for text in batch.column(1).to_pylist():
                    sums: dict[int, int] = {}
                    for word, n in Counter(_WORD.findall(text or "")).items():
                        for bucket, sign in places[word]:
                            sums[bucket] = sums.get(bucket, 0) + sign * n
                    found = sorted((b, math.copysign(math.log1p(abs(v)), v)) for b, v in sums.items() if v)
                    length = math.sqrt(math.fsum(w * w for _, w in found))
                    buckets += [b for b, _ in found]
                    weights += [w / length for _, w in found]
                    sizes.append(len(found))
                columns = [batch.column(0), lists(pa.array(buckets, pa.int32()), sizes), lists(pa.array(weights, pa.float64()), sizes)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "bucket", "w"])

    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, bucket array<int>, w array<double>")

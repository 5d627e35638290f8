"""Operator 13: phrase collocation mining by pivot partitioning.

Words are counted first. Then every occurrence of a word that may be frequent becomes a pivot: the text around it is rewritten to a
fragment that keeps the neighbours, at most two on each side, up to the first word that is rarer than the pivot, or equal to it and
before it. An occurrence of a phrase lies whole in exactly one fragment in which it holds the pivot: that of its rarest word. Fragments
are routed by their pivot to parts, where phrases that hold the pivot are counted, longer ones only where their
shorter ones in that part are frequent, and no phrase is counted anywhere else.

Order of words. The ``TABLE`` most frequent words are numbered by frequency and broadcast, which is a fixed bound. If that are all words
frequent enough, other words are blanks. Else other words count as rarer than those of the table, and are ordered by
their bytes; they travel as words, beside the numbers of the table's.

Scale. Fragments are made, merged where equal and packed by part in slices of text, so that a slice sends one row to a part. A pivot that
occurs more than ``HOT`` times is dealt over several parts by the rest of the fragment; its counts are then partial and are added up
in one more aggregation, and its phrases are not pruned by shorter ones. Parts follow the number of words. Texts are read twice.
Each language's best phrases are taken first from as many groups as there are partitions.

Defined results: a null lang is ``und``; null, empty and unbroken texts count like any other; repeated rows count as often as they occur; an
empty table gives no rows. A piece of text between separators has to fit into a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, partitions_for, spread_table

LEAST, TOP, COVER, SCORE = 10, 2000, 50, 1_000_000
SLICE, HELD, TABLE, PART_WORDS, HOT = 8 << 20, 400_000, 1 << 19, 2_000_000, 500_000

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS + b"\t", bytes(range(97, 123)) + b"\n" * len(_SEPARATORS) + b" ")
_CUT = re.compile(b"[" + re.escape(_SEPARATORS) + b"]")
#: Stands between pieces; no word is one.
BREAK = b"."


def tokens(data: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case, with ``BREAK`` between pieces."""
    return data.translate(_FOLD).replace(b"\n", b" . ").split()


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[tuple[bytes, bytes]]:
    """(lang, texts joined by line ends) of about ``size`` bytes; longer texts are cut at separators."""
    held: dict[bytes, list[bytes]] = {}
    total: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            at = 0
            while at < len(text):
                cut = _CUT.search(text, at + size) if len(text) - at > size else None
                end = cut.end() if cut else len(text)
                held.setdefault(lang, []).append(text[at:end])
                total[lang] += end - at
                at = end
                if total[lang] >= size or sum(total.values()) >= 2 * size:
                    lang = lang if total[lang] >= size else max(total, key=total.get)
                    yield lang, b"\n".join(held.pop(lang))
                    del total[lang]
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def texts_of(docs: DataFrame) -> DataFrame:
    """(lang, text) in bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"), text.cast("binary").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f): how often each word occurs; counted in slices, in bounded counters, before the shuffle."""

    def rows(lang: bytes, found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.binary()), pa.array(found, pa.binary()), pa.array(found.values(), pa.int64())], names=["lang", "word", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = {}
        for lang, data in slices(batches):
            counts = held.setdefault(lang, Counter())
            counts.update(tokens(data))
            del counts[BREAK]
            if sum(map(len, held.values())) > HELD:
                yield from (rows(x, c) for x, c in held.items())
                held = {}
        yield from (rows(x, c) for x, c in held.items())

    counted = texts.mapInArrow(run, "lang binary, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return cut_lineage(counted)


@dataclass(frozen=True)
class Words:
    """The most frequent words, numbered from 1 by frequency; ``whole``: all others are infrequent."""

    langs: list[bytes]
    lang: np.ndarray
    words: list[bytes]
    counts: np.ndarray
    whole: bool

    def numbers(self) -> dict[bytes, dict[bytes, int]]:
        found: dict[bytes, dict[bytes, int]] = {}
        for i, (at, word) in enumerate(zip(self.lang.tolist(), self.words, strict=True), 1):
            found.setdefault(self.langs[at], {})[word] = i
        return found

    def shares(self, hot: int) -> np.ndarray:
        """Over how many parts each number's fragments are dealt; 1 at place 0."""
        return np.r_[1, -(-self.counts // hot)].astype(np.int64)


def frequent_words(counts: DataFrame, least: int, most: int) -> Words:
    """At most ``most`` words of ``counts``: all that are at least as frequent as the least level of frequency that fits."""
    found = counts.filter(F.col("f") >= least).withColumn("level", F.floor(F.log2("f") * 64))
    levels = sorted(((r.level, r.n) for r in found.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
    total, cut = 0, None
    for level, n in levels:
        if total + n > most:
            break
        total, cut = total + n, level
    if cut is None:
        return Words([], np.zeros(0, np.int64), [], np.zeros(0, np.int64), not levels)
    rows = found.filter(F.col("level") >= cut).select("lang", "word", "f").toArrow().sort_by([("f", "descending"), ("lang", "ascending"), ("word", "ascending")])
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    return Words(langs.dictionary.to_pylist(), langs.indices.to_numpy(), rows.column("word").to_pylist(), rows.column("f").to_numpy(), total == sum(n for _, n in levels))


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype("<u4").reshape(-1, 1).view(np.uint8).T)
    return len(planes.tobytes()).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd"), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def fragments(x: np.ndarray) -> np.ndarray:
    """Rows (second and first word before, pivot, first and second word after), 0 for none, of the numbers of a text's words.

    Smaller numbers are more frequent words, 0 is a blank. Before the pivot words are more frequent, after it at least as frequent.
    """
    near = np.zeros((5, len(x)), np.int64)
    near[2] = x
    for at, step in ((1, 1), (0, 2)):
        near[at, step:] = x[: len(x) - step]
        near[at][near[at] >= x] = 0
    for at, step in ((3, 1), (4, 2)):
        near[at, : len(x) - step] = x[step:]
        near[at][near[at] > x] = 0
    near[0][near[1] == 0] = 0
    near[4][near[3] == 0] = 0
    return near[:, (x > 0) & ((near[1] > 0) | (near[3] > 0))]


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def merged(rows: np.ndarray, part: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, their parts, how often each occurs): columns of ``rows`` by part, equal ones once."""
    order = np.argsort((part.astype(np.uint64) << np.uint64(40)) | (code >> np.uint64(24)))
    rows, part = rows[:, order], part[order]
    first = np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)] if rows.shape[1] else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    return rows[:, starts], part[starts], np.diff(np.r_[starts, rows.shape[1]])


def routed(texts: DataFrame, table, parts: int, hot: int) -> DataFrame:
    """(part, fragments, words): each slice's fragments by part, packed; words are those beyond the table, with their lang before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Words = table.value
        numbers, n = known.numbers(), len(known.words)
        shares = known.shares(hot)
        home = (mixed(np.arange(n + 1)) % np.uint64(parts)).astype(np.int64)
        for lang, data in slices(batches):
            words = tokens(data)
            x = np.fromiter(map(numbers.get(lang, {}).get, words, repeat(0)), np.int64, len(words))
            others: list[bytes] = []
            if not known.whole:
                blank = [i for i in np.flatnonzero(x == 0).tolist() if words[i] != BREAK]
                others = sorted({words[i] for i in blank})
                number = {w: n + 1 + i for i, w in enumerate(others)}
                x[blank] = [number[words[i]] for i in blank]
            del words
            rows = fragments(x)
            crc = np.array([zlib.crc32(lang + b" " + w) % parts for w in others], np.int64)
            code = np.zeros(rows.shape[1], np.uint64)
            for column in rows:
                code = mixed(code + column.astype(np.uint64))
            pivot = rows[2]
            share = np.r_[shares, np.ones(len(others), np.int64)][pivot]
            part = (np.r_[home, crc][pivot] + (code % share.astype(np.uint64)).astype(np.int64)) % parts
            rows, part, count = merged(rows, part, code)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            found: list[tuple[int, bytes, list[bytes]]] = []
            for start, end in zip(starts.tolist(), np.r_[starts, len(part)][1:].tolist(), strict=True):
                some = rows[:, start:end]
                extra = np.unique(some[some > n])
                if len(extra):
                    some = np.where(some > n, n + 1 + np.searchsorted(extra, some), some)
                block = packed(np.concatenate([some.ravel(), count[start:end]]))
                named = [lang + b" " + others[i - n - 1] for i in extra.tolist()]
                found.append((int(part[start]), block, named))
            kinds = [pa.int32(), pa.binary(), pa.list_(pa.binary())]
            if not found:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], names=["part", "fragments", "words"])

    return texts.mapInArrow(run, "part int, fragments binary, words array<binary>")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the sums of their counts, and each key's place among them."""
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64), place


def mined(rows: np.ndarray, counts: np.ndarray, partial: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrases as columns of three numbers, 0 for no third word, and their counts) that hold the pivot, from fragments.

    partial: fragments whose pivot has others elsewhere, so that every count is told. Of other pivots phrases of at least ``least``.
    """
    two, one, pivot, next_, after = rows.astype(np.uint64)
    far = np.uint64(32)
    before, behind = np.flatnonzero(one), np.flatnonzero(next_)
    pairs, total, place = summed(np.r_[(one << far | pivot)[before], (pivot << far | next_)[behind]], np.r_[counts[before], counts[behind]])
    told = np.zeros(len(pairs), bool)
    told[place] = np.r_[partial[before], partial[behind]]
    good = told | (total >= least)
    low = np.uint64((1 << 32) - 1)
    found = [np.array([pairs[good] >> far, pairs[good] & low, np.zeros(int(good.sum()), np.uint64)])]
    sums = [total[good]]
    left, right = np.full(len(pivot), -1, np.int64), np.full(len(pivot), -1, np.int64)
    left[before], right[behind] = place[: len(before)], place[len(before) :]
    fine_left, fine_right = (left >= 0) & good[left] if len(good) else left > 0, (right >= 0) & good[right] if len(good) else right > 0
    # (mask, the pair that is held, the third word, whether it stands before the pair)
    for mask, pair, third, ahead in ((fine_left & (two > 0), left, two, True), (fine_left & fine_right, left, next_, False), (fine_right & (after > 0), right, after, False)):
        at = np.flatnonzero(mask)
        keys, total, place = summed(pair[at].astype(np.uint64) << far | third[at], counts[at])
        told = np.zeros(len(keys), bool)
        told[place] = partial[at]
        keys, total = keys[told | (total >= least)], total[told | (total >= least)]
        held, third = pairs[(keys >> far).astype(np.int64)], keys & low
        found.append(np.array([third, held >> far, held & low] if ahead else [held >> far, held & low, third]))
        sums.append(total)
    return np.hstack(found), np.concatenate(sums)


def phrases(routes: DataFrame, table, parts: int, hot: int, least: int) -> DataFrame:
    """(lang, phrase, a): phrases of two and three words that occur at least ``least`` times, from ``routes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Words = table.value
        n = len(known.words)
        others: dict[bytes, int] = {}
        rows, counts = [], []
        for batch in batches:
            for data, words in zip(batch.column("fragments"), batch.column("words"), strict=True):
                block = unpacked(data.as_py()).reshape(6, -1)
                some = block[:5].astype(np.int64)
                if len(words):
                    number = np.array([others.setdefault(w, n + 1 + len(others)) for w in words.as_py()])
                    some = np.where(some > n, number[np.maximum(some - (n + 1), 0)], some)
                rows.append(some)
                counts.append(block[5])
        if not rows:
            return
        rows, counts = np.hstack(rows), np.concatenate(counts)
        shares = known.shares(hot)
        partial = np.r_[shares, 1][np.minimum(rows[2], n + 1)] > 1
        found, sums = mined(rows, counts, partial, least)
        more = [w.split(b" ", 1) for w in others]
        for at in range(0, len(sums), 50_000):
            first, *rest = (x.tolist() for x in found[:, at : at + 50_000])
            word = lambda i: known.words[i - 1] if i <= n else more[i - n - 1][1]
            lang = [known.langs[known.lang[i - 1]] if i <= n else more[i - n - 1][0] for i in first]
            text = [b" ".join(word(i) for i in p if i) for p in zip(first, *rest, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.binary()), pa.array(text, pa.binary()), pa.array(sums[at : at + 50_000])], names=["lang", "phrase", "a"])

    found = routes.repartition(parts, "part").mapInArrow(run, "lang binary, phrase binary, a long")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): each phrase with its lowest-scoring cut, ties to the earliest."""
    parts = words.select("lang", F.col("word").alias("part"), "f").unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    w = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(w, 1, F.col("k")), " "), "right": F.array_join(F.slice(w, F.col("k") + 1, F.size(w)), " ")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    exact = {c: f"CAST({c} AS decimal(16,0))" for c in "alr"}
    cuts = cuts.withColumn("score", F.expr(f"({SCORE} * {exact['a']} * {exact['a']}) div ({exact['l']} * {exact['r']})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    return best.select("lang", "phrase", "a", "s.l", "s.r", "s.score")


def standing_alone(found: DataFrame, cover: int) -> DataFrame:
    """(lang, phrase) of those not covered by a longer phrase that holds them at least ``cover`` in a hundred times."""
    w = F.split("phrase", " ")
    longer = found.filter(F.size(w) > 2).select("lang", "a", F.explode(F.array(F.array_join(F.slice(w, 1, F.size(w) - 1), " "), F.array_join(F.slice(w, 2, F.size(w) - 1), " "))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return found.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < cover * F.col("a"), F.lit(True))).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, most_words: int = TABLE, part_words: int = PART_WORDS, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each lang of ``docs`` (text, lang)."""
    spark, texts = docs.sparkSession, texts_of(docs)
    counts = word_counts(texts)
    known = frequent_words(counts, least, most_words)
    sizes = cut_lineage(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = partitions_for(total, part_words, spark.sparkContext.defaultParallelism)
    table = spark.sparkContext.broadcast(known)
    found = cut_lineage(phrases(routed(texts, table, parts, hot), table, parts, hot, least))
    text = lambda df, *names: df.withColumns({c: F.col(c).cast("string") for c in names})
    found, words = text(found, "lang", "phrase"), text(counts.filter(F.col("f") >= least), "lang", "word")
    rows = scored(found, words).join(standing_alone(found, cover), ["lang", "phrase"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = rows.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    some = some.withColumn("p", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).filter(F.col("p") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(text(sizes, "lang"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spread_table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, 1 AS m, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(ws, ws[2:], true), lambda p: p[1] || ' ' || p[2])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(ws, ws[2:], ws[3:], true), lambda p: p[1] || ' ' || p[2] || ' ' || p[3])) FROM w),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT *, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM c, range(1, 3) t(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, ({SCORE}::HUGEINT * k.a * k.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.tail),
b AS (SELECT lang, phrase, a, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS s FROM s GROUP BY ALL),
o AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM c WHERE m = 3) GROUP BY ALL),
r AS (SELECT b.lang, b.phrase, b.a, s.l AS l, s.r AS r, s.score AS score, row_number() OVER (PARTITION BY b.lang ORDER BY s.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE most IS NULL OR 100 * most < {COVER} * b.a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= {TOP}
"""

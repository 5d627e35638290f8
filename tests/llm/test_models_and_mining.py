"""Language model scores, centroid clustering and collocations against plain versions of their definitions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import clusters, collocation, language_model

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- language model ----


def plain_scores(rows, order, priors):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) from the interpolated formula, without any automaton."""
    texts = [[w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOWER)) if w] + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c, n = Counter(), 0
    for words, out in zip(texts, held, strict=True):
        if not out:
            n += len(words)
            c.update(tuple(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1))
    v = sum(len(g) == 1 for g in c)
    found = []
    for (doc, _), words, out in zip(rows, texts, held, strict=True):
        base = score = 0.0
        for i, w in enumerate(words):
            p = (c[(w,)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, min(order, i + 1) + 1):
                h = tuple(words[i - k + 1 : i])
                if c[h]:
                    p = (c[(*h, w)] + priors[k] * p) / (c[h] + priors[k])
            score += math.log10(p)
        found.append((doc, out, len(words), sum(c[(w,)] > 0 for w in words), n, base, score))
    return found


def key(r):
    return tuple(round(x, 6) if isinstance(x, float) else -1 if x is None else x for x in r)


@pytest.mark.parametrize(("order", "slice_tokens", "part_tokens"), [(1, 50, 50), (2, 1_000_000, 1_000_000), (3, 40, 30), (3, 1_000_000, 1_000_000)])
def test_walks_equal_the_formula(spark, order, slice_tokens, part_tokens):
    draw = random.Random(order)
    vocabulary = [*"abcdefgh", "É", "X", "x", "<s>"]
    rows = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 30)))) for i in range(60)]
    rows += [(None, "a b c"), (7, None), (7, "a\x0bb\xa0c \t"), (8, ""), (61, "never seen words"), (61, "never seen words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"slice": F.lit("x"), "order": F.lit(1), "train": F.lit(0)})
    priors = {2: 3.0, 3: 0.7}
    got = sorted(key(r) for r in language_model.score_documents(docs, order, priors, slice_tokens, part_tokens).collect())
    assert got == sorted(key(r) for r in plain_scores(rows, order, priors))


def test_probabilities_of_a_state_add_up_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b a c", "b a", "a a b c"]) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = [[*t.split(), None] for _, t in rows]
    c = Counter(tuple(t[i : i + k]) for t in texts for k in (1, 2, 3) for i in range(len(t) - k + 1))
    priors, n = {2: 2.0, 3: 5.0}, sum(map(len, texts))
    words, v = ["a", "b", "c", None, "unknown"], 4
    for h in ((), ("a",), ("b",), ("a", "b"), ("b", "a")):
        total = 0.0
        for w in words:
            p = (c[(w,)] + 1) / (n + v + 1)
            for k in range(2, len(h) + 2):
                if c[h[-k + 1 :]]:
                    p = (c[(*h[-k + 1 :], w)] + priors[k] * p) / (c[h[-k + 1 :]] + priors[k])
            total += p
        assert total == pytest.approx(1)


def test_scores_of_held_out_texts_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = language_model.score_documents(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def test_language_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score_documents(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = language_model.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert tuple(r) == (held, True, 3, 0, 0, 0.0, 0.0)


# ---- clusters ----


def plain_clusters(rows, length, k, rounds, scale, seed):
    kept = [(i, [math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in v], v) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    code = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[2])
    centres = [r[1] for r in sorted(kept, key=code)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        to = [nearest(v)[1] for _, v, _ in kept]
        for j in range(len(centres)):
            if own := [v for t, (_, v, _) in zip(to, kept, strict=True) if t == j]:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v, _ in kept]
    fits = lambda x: x if x < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    return [(i, c, fits(d), fits(sums[c]), fits(sum(sums.values())), names[c]) for i, c, d in found]


@pytest.mark.parametrize("spread", [1.0, 1e6, 1e12, 1e300])
def test_clusters_equal_whole_number_arithmetic(spark, spread, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 16)
    draw = random.Random(5)
    rows = [(i, [draw.choice([0.0, draw.gauss(0, 1), draw.gauss(3, 1) * (spread if draw.random() < 0.1 else 1)]) for _ in range(4)]) for i in range(90)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0]), (200, None), (201, [1.0]), (202, [1.0, None, 1.0, 1.0]), (203, [math.nan] * 4), (204, [math.inf, 0.0, 0.0, 0.0]), (205, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "ids": F.lit(2)})
    got, _ = clusters.cluster(df, 4, 7, 3, 256, 2)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_clusters(rows, 4, 7, 3, 256, 2)))


def test_clusters_of_few_and_no_vectors(spark):
    one = spark.createDataFrame([(1, [1.5, 2.0]), (2, [1.5, 2.0])], "vec_id long, embedding array<float>")
    got, centres = clusters.cluster(one, 2, 5, 2)
    assert sorted((r.vec_id, r.cluster, r.distance, r.inertia) for r in got.collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)] and len(centres) == 2
    assert clusters.cluster(one.limit(0), 2)[0].count() == 0
    assert clusters.cluster(one, 3)[0].count() == 0


def test_no_step_of_the_product_passes_the_exact_range():
    for length in (1, 4, 64, 1000):
        assert length * (2 * clusters.limit(length)) ** 2 < 1 << 53


# ---- collocations ----


def plain_collocations(rows, least, top, cover):
    f = {}
    for text, lang in rows:
        c = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            c.update(tuple(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        good = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in good.items():
            if any(len(o) > len(g) and 100 * b >= cover * a and any(o[i : i + len(g)] == g for i in range(len(o))) for o, b in good.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), a, c[g[:k]], c[g[k:]], n, score))
        out += [(lang, i + 1, p.decode(), *rest) for i, (_, _, p, *rest) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("table", "hot", "part"), [(1 << 19, 500_000, 2_000_000), (3, 500_000, 100), (0, 20, 100), (5, 20, 300)])
def test_collocations_equal_counting_all_phrases(spark, table, hot, part, monkeypatch):
    monkeypatch.setattr(collocation, "SLICE", 500)
    draw = random.Random(9)
    words = ["the", "The", "new", "york", "city", "a", "É", "é", "z|z", "-", "a", "in"]
    texts = [("".join(draw.choice(words) + draw.choice([" ", " ", "\t", "  ", ". ", "\n"]) for _ in range(draw.randint(0, 60))), draw.choice(["en", "fr", None])) for _ in range(150)]
    texts += [("new york city " * 40, "en"), ("a a a a a a", None), (None, None), ("", "en"), ("x y", "one"), ("the end. the end, THE END", None), ("long piece " * 300, "fr")] * 2
    df = spark.createDataFrame(texts, "text string, lang string").withColumns({"word": F.lit("x"), "part": F.lit(1), "phrase": F.lit("y"), "f": F.lit(0)})
    got = collocation.collocations(df, 5, 20, 50, table, part, hot)
    assert sorted(map(tuple, got.collect())) == plain_collocations(texts, 5, 20, 50)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocation.collocations(df).count() == 0
    assert collocation.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_counts_beyond_64_bits_stay_exact(spark):
    big = 3_000_000_000_000
    found = spark.createDataFrame([("en", "p q", big)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", "p", big + 1), ("en", "q", big + 7)], "lang string, word string, f long")
    assert collocation.scored(found, words).first().score == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_every_phrase_lies_in_one_fragment_with_its_pivot():
    draw = np.random.default_rng(3)
    for _ in range(50):
        x = draw.integers(0, 5, size=40)
        want = Counter(tuple(x[i : i + m].tolist()) for m in (2, 3) for i in range(len(x) - m + 1) if x[i : i + m].all())
        rows = collocation.fragments(x)
        found, sums = collocation.mined(rows, np.ones(rows.shape[1]), np.zeros(rows.shape[1], bool), 1)
        got = Counter()
        for a, b, c, n in zip(*found.tolist(), sums.tolist(), strict=True):
            got[(a, b, c) if c else (a, b)] += n
        assert got == want

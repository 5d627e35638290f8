"""Operator 5: personal data by candidate gradient boosting, in DataFrame functions only.

1. Base detectors: four patterns, leftmost and without overlaps per kind, then checks (octets, Luhn, digit counts).
2. High-recall generators propose more spans, which may overlap each other and the base ones: runs of letters and
   digits (keys, tokens, passwords), long digit groups, and addresses whose signs are spelt out.
3. Each candidate gets features of its format and of its context. Boosted trees, written as CASE expressions, turn
   them into a probability. Thresholds are calibrated for each generator on rows that the trees have not seen; a
   candidate over its threshold that touches no base span becomes a span of kind secret, number or address. So does, at
   any score, one that is a known credential format or follows words that name a credential.

The trees are trained on the driver from at most ``TRAIN_ROWS`` candidates of all documents: for each generator and label
an equal share, chosen by hash, so that rare positives are not lost; copies count once. There are no hand-made labels. Positive
are candidates of the documents that are base spans, known credential formats or named as credentials, and ``PLANTED`` keys, numbers
and addresses of many formats in sentences that name them in other words or not at all: their labels come from the planting, not
from any feature. Positives that their format gives away are shown once more with their context hidden. Thresholds weigh
the shares by what they stand for. A generator with too few positives to calibrate asks for a probability of ``PRECISION``. Base
spans are never dropped.

Scale: two passes over the texts for training, which shuffle the chosen candidates alone, and a projection; every text is read whole. Patterns are possessive or anchored at run starts, so that
they are linear in the text and need no stack on long runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_table

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS, PLANTED, ROUNDS, RATE, PRECISION = 20_000, 1_500, 30, 0.3, 0.99

# What a match may start with: the end of the match before, or a place where no run is under way. A start inside a
# run shares the run's tail, so it can match only if the run's own start does.
_WORD = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
PATTERNS = {
    "email": _WORD + "@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?+[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "secret": "(?<![A-Za-z0-9_])[A-Za-z0-9_]{12,}+",
    "number": "(?<![A-Za-z0-9.])[+(]?[0-9](?:[\\x20().-]{0,2}+[0-9]){6,}+(?![A-Za-z0-9])",
    "address": _WORD + "\\x20?(?:@|\\(at\\)|\\[at\\])\\x20?[A-Za-z0-9-]++(?:\\x20?(?:\\.|\\(dot\\)|\\[dot\\])\\x20?[A-Za-z0-9-]++)++",
}
_NAMED = "(?i)(?:passw(?:or)?d|pwd|token|secret|api[_ -]?key|access[_ -]?key)[^A-Za-z0-9]{0,6}$"
_ABOUT = "(?i)(?:phone|tel|call|mobile|fax|mail|contact|card|account|iban|ssn)[^A-Za-z0-9]{0,8}$"
_FORMAT = "^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_]{20,})$"
FEATURES = ("source", "size", "digits", "upper", "lower", "other", "distinct", "turns", "plus", "hex", "luhn", "octets", "named", "about", "quoted")
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, text>> of all matches, in code points, end exclusive.

    The pieces between matches give the positions; they are summed in chunks, so that the work stays near linear.
    """
    spans = "array<struct<start:int,stop:int,text:string>>"

    def place(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("text")))

        def chunked(step: Column) -> Column:
            def inner(at: Column, c: Column) -> Column:
                return F.aggregate(
                    F.slice(step, c * CHUNK + 1, F.lit(CHUNK)),
                    F.struct(at.alias("at"), F.array().cast(spans).alias("spans")),
                    lambda b, x: F.struct(
                        (b["at"] + x["gap"] + F.length(x["text"])).alias("at"),
                        F.array_append(b["spans"], F.struct((b["at"] + x["gap"]).alias("start"), (b["at"] + x["gap"] + F.length(x["text"])).alias("stop"), x["text"].alias("text"))).cast(spans).alias("spans"),
                    ),
                )

            return F.aggregate(
                F.sequence(F.lit(0), F.floor((F.size(step) - 1) / CHUNK).cast("int")),
                F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans")),
                lambda acc, c: let(inner(acc["at"], c), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["spans"], x["spans"]).cast(spans).alias("spans"))),
            )["spans"]

        return F.when(F.size(found) == 0, F.array().cast(spans)).otherwise(let(steps, chunked))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _octets(text: Column) -> Column:
    parts = F.transform(F.split(text, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.cast("int") <= 255).otherwise(False))


def _luhn(text: Column) -> Column:
    digits = _digits(text)
    return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)


_CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda t: F.length(_digits(t)).between(10, 15),
}
_HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike("[0-9]\\.[0-9]"),
    "card": lambda t: t.rlike("[0-9][\\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike("[0-9]"),
    "number": lambda t: t.rlike("[0-9]"),
    "address": lambda t: t.contains("@") | t.contains("at)") | t.contains("at]"),
}
_SPANS = "array<struct<start:int,place:int,stop:int,kind:string>>"


def _base(text: Column) -> Column:
    """All base spans as structs (start, place of the kind, stop, kind), sorted."""
    found = []
    for place, kind in enumerate(KINDS):
        kept = F.filter(find(text, PATTERNS[kind]), lambda s: _CHECKS[kind](s["text"]))  # noqa: B023
        spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))  # noqa: B023
        found.append(F.when(_HINTS[kind](text), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS)))
    return F.sort_array(F.concat(*found))


def _candidates(text: Column) -> Column:
    """Candidates of all generators with their features."""
    found = []
    for source, kind in enumerate(GENERATORS):
        def row(s: Column) -> Column:
            t = s["text"]
            before = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
            size, digits = F.length(t), F.length(_digits(t))
            upper, lower = F.length(F.regexp_replace(t, "[^A-Z]+", "")), F.length(F.regexp_replace(t, "[^a-z]+", ""))
            flag = lambda c: c.cast("double")
            values = (
                F.lit(float(source)), flag(size), flag(digits), flag(upper), flag(lower), flag(size - digits - upper - lower),
                F.size(F.array_distinct(F.split(F.substring(t, 1, 64), ""))) / F.least(size, F.lit(64)),
                flag(F.size(F.split(t, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", -1)) - 1),
                flag(t.startswith("+")), flag(t.rlike("^[0-9a-f]+$")), flag(_luhn(t)), flag(_octets(t)), flag(before.rlike(_NAMED)), flag(before.rlike(_ABOUT)),
                flag(before.rlike("[\"'=:]\\x20?$")),
            )
            return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), t.rlike(_FORMAT).alias("known"), *(v.alias(n) for v, n in zip(values, FEATURES, strict=True)))

        usable = F.filter(find(text, GENERATORS[kind]), lambda s: s["text"].rlike("[0-9]") | F.lit(kind == "address"))  # noqa: B023
        found.append(F.when(_HINTS[kind](text), F.transform(usable, row)))
    kind = f"array<struct<start:int,stop:int,kind:string,known:boolean,{','.join(f'{f}:double' for f in FEATURES)}>>"
    return F.concat(*(F.coalesce(x.cast(kind), F.array().cast(kind)) for x in found))


def _touches(base: Column, c: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))


def _certain(c: Column) -> Column:
    """Known credential formats, and what follows words that name a credential."""
    return c["known"] | (c["named"] > 0)


@dataclass(frozen=True)
class Trees:
    """Depth-two trees (feature, cut, (feature, cut, below, above) below, the same above) on a log-odds scale."""

    bias: float
    trees: tuple
    thresholds: dict[str, float]

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.bias)
        for f, cut, left, right in self.trees:
            low = rows[:, f] < cut
            for side, (g, at, below, above) in ((low, left), (~low, right)):
                total[side] += np.where(rows[side, g] < at, below, above)
        return total

    def expression(self, c: Column) -> Column:
        total = F.lit(self.bias)
        for f, cut, left, right in self.trees:
            leaf = lambda x: F.when(c[FEATURES[x[0]]] < x[1], F.lit(x[2])).otherwise(F.lit(x[3]))
            total = total + F.when(c[FEATURES[f]] < cut, leaf(left)).otherwise(leaf(right))
        return total


def _best_cut(rows: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> tuple[float, int, float, float, float]:
    """The cut with the largest gain: (gain, feature, cut, value below, value above)."""
    value = lambda g, h: -g / (h + 1.0)
    all_g, all_h = slope.sum(), bend.sum()
    best = (0.0, 0, -math.inf, 0.0, float(value(all_g, all_h)))
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x = rows[order, f]
        edge = np.flatnonzero(x[1:] > x[:-1])
        if not len(edge):
            continue
        g, h = np.cumsum(slope[order])[edge], np.cumsum(bend[order])[edge]
        gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
        i = int(np.argmax(gain))
        if gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), f, float((x[edge[i]] + x[edge[i] + 1]) / 2), float(value(g[i], h[i])), float(value(all_g - g[i], all_h - h[i])))
    return best


def boost(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, weights: np.ndarray | None = None) -> Trees | None:
    """Second-order gradient boosting on two thirds of the rows of each generator and label, thresholds on the last third, where
    ``weights`` say for how many candidates a row stands. None unless both labels occur."""
    last = np.zeros(len(rows), bool)
    for i in range(len(GENERATORS)):
        for label in (0, 1):
            last[np.flatnonzero((rows[:, 0] == i) & (labels == label))[2::3]] = True
    x, y = rows[~last], labels[~last].astype(float)
    if not 0 < y.sum() < len(y):
        return None
    context = [FEATURES.index(f) for f in ("named", "about", "quoted")]
    hidden = x[(y == 1) & (x[:, context[0]] == 0)]
    hidden[:, context] = 0
    x, y = np.concatenate([x, hidden]), np.concatenate([y, np.ones(len(hidden))])
    bias = math.log(y.mean() / (1 - y.mean()))
    total, trees = np.full(len(x), bias), []
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = chance - y, chance * (1 - chance)
        _, f, cut, *_ = _best_cut(x, slope, bend)
        low, sides = x[:, f] < cut, []
        for side in (low, ~low):
            _, g, at, below, above = _best_cut(x[side], slope[side], bend[side]) if side.any() else (0, 0, -math.inf, 0.0, 0.0)
            sides.append((g, max(at, -1e9), rate * below, rate * above))
            total[side] += np.where(x[side, g] < at, rate * below, rate * above)
        trees.append((f, max(cut, -1e9), *sides))
    found = Trees(bias, tuple(trees), {})
    score, truth, source = found.log_odds(rows[last]), labels[last], rows[last, 0]
    stands = np.ones(len(score)) if weights is None else weights[last]
    unsure = math.log(PRECISION / (1 - PRECISION))
    for i, kind in enumerate(GENERATORS):
        mine = source == i
        order = np.argsort(-score[mine])
        s, hits, w = score[mine][order], truth[mine][order], stands[mine][order]
        right = np.cumsum(hits * w) / np.cumsum(w)
        good = np.flatnonzero((right >= PRECISION) & np.r_[s[1:] < s[:-1], np.ones(min(1, len(s)), bool)])
        if hits.sum() < 5:
            found.thresholds[kind] = unsure
        elif len(good):
            found.thresholds[kind] = max(0.0, float(s[good[-1]]))
        else:  # negatives among the best: above all of them
            found.thresholds[kind] = max(unsure, float(np.nextafter(s[hits == 0].max(), math.inf)))
    return found


def training_rows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of candidates of all ``docs``: of each generator and label at most an equal share of ``TRAIN_ROWS``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9]") | F.col("text").contains("@") | F.col("text").contains("at)") | F.col("text").contains("at]"))
    rows = source.select(F.xxhash64("text").alias("t"), _base(F.col("text")).alias("base"), _candidates(F.col("text")).alias("c"))
    rows = rows.select("t", F.explode(F.transform("c", lambda c: F.struct(c.alias("c"), (_touches(F.col("base"), c) | _certain(c)).alias("label")))).alias("x"))
    rows = rows.select(F.xxhash64("t", "x.c.start").alias("o"), F.col("x.label").cast("int").alias("label"), *(f"x.c.{f}" for f in FEATURES))
    sizes = {(int(r.source), r.label): max(1, r.n) for r in rows.groupBy("source", "label").agg(F.approx_count_distinct("o", 0.02).alias("n")).collect()}
    share = TRAIN_ROWS // (2 * len(GENERATORS))
    part = F.lit(1.0)
    for (i, label), n in sizes.items():
        part = F.when((F.col("source") == i) & (F.col("label") == label), F.lit(min(1.0, share / n))).otherwise(part)
    some = rows.withColumn("u", (F.col("o") / F.lit(2.0**64) + 0.5) / part).filter("u <= 1")
    got = some.groupBy("source", "label", "o", "u").agg(*(F.first(f).alias(f) for f in FEATURES[1:])).orderBy("u", "o", "source", "label").limit(2 * TRAIN_ROWS).collect()
    taken: dict[tuple[int, int], list] = {}
    for r in got:
        taken.setdefault((int(r.source), r.label), []).append([r[f] for f in FEATURES])
    taken = {at: mine[:share] for at, mine in sorted(taken.items())}
    x = np.array([r for mine in taken.values() for r in mine]).reshape(-1, len(FEATURES))
    labels = np.array([at[1] for at, mine in taken.items() for _ in mine], int)
    return x, labels, np.array([max(1.0, sizes[at] / len(mine)) for at, mine in taken.items() for _ in mine])


#: What planted keys, numbers and addresses stand after, and what may follow; the last contexts name nothing.
CONTEXTS = {
    "secret": ("key", "auth", "bearer", "credential", "private key id", "client", "signature", "session", "login with", "set", "use", "with"),
    "number": ("account", "reach me at", "phone", "ssn", "IBAN", "fax", "customer no", "call", "write to", "see", "and", "of"),
    "address": ("mail", "write to", "contact", "reach me at", "from", "reply to", "by", "and"),
}
TAILS = ("", ".", ", please", " and then", "\n", ' "', ") is mine")


def planted(n: int, seed: int = 5, contexts: dict[str, tuple[str, ...]] | None = None) -> list[tuple[int, str, str, int]]:
    """(number, text, kind, start of the planted value) of ``n`` sentences."""
    import random

    draw, letters, found = random.Random(seed), "abcdefghijklmnopqrstuvwxyz", []
    some = lambda alphabet, size: "".join(draw.choice(alphabet) for _ in range(size))
    digits = lambda size: some("0123456789", size)
    makers = {
        "secret": [
            lambda: some("0123456789abcdef", draw.choice((32, 40, 64))), lambda: some(letters + letters.upper() + "0123456789", draw.randint(20, 44)),
            lambda: some(letters, 2) + "_" + draw.choice(("live", "test", "prod")) + "_" + some(letters + "0123456789", draw.randint(16, 32)), lambda: some(letters.upper() + "0123456789", draw.randint(16, 32)),
        ],
        "number": [
            lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"0{digits(3)} {digits(3)} {digits(4)}", lambda: " ".join(digits(4) for _ in range(draw.randint(3, 5))),
        ],
        "address": [
            lambda: f"{some(letters, 5)}.{some(letters, 6)} (at) {some(letters, 7)} (dot) org", lambda: f"{some(letters, 6)}[at]{some(letters, 8)}[dot]com", lambda: f"{some(letters, 7)} @ {some(letters, 6)}.net",
        ],
    }
    kinds = list(GENERATORS)
    for i in range(n):
        kind = kinds[i % len(kinds)]
        before = f"{some(letters, draw.randint(2, 9))} {draw.choice((contexts or CONTEXTS)[kind])}{draw.choice((': ', '=', ' ', ' = ', ' '))}"
        found.append((i, before + draw.choice(makers[kind])() + draw.choice(TAILS), kind, len(before)))
    return found


def planted_rows(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in ``PLANTED`` sentences: positive is what lies where a value was planted."""
    rows = spark.createDataFrame(planted(PLANTED), "n long, text string, kind string, start int")
    got = rows.select("kind", "start", F.explode(_candidates(F.col("text"))).alias("c")).select((F.col("c.start") == F.col("start")).alias("hit"), *(f"c.{f}" for f in FEATURES)).collect()
    return np.array([[r[f] for f in FEATURES] for r in got]).reshape(-1, len(FEATURES)), np.array([int(r.hit) for r in got], int)


def train(docs: DataFrame) -> Trees | None:
    """Trees from a bounded sample of the candidates of ``docs`` (doc_id, text) and planted ones; None for a table without candidates."""
    rows, labels, weights = training_rows(docs)
    if not len(rows):
        return None
    more, more_labels = planted_rows(docs.sparkSession)
    return boost(np.concatenate([rows, more]), np.concatenate([labels, more_labels]), weights=np.concatenate([weights, np.ones(len(more))]))


def find_spans(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """``docs`` with two more columns: ``base_spans`` and ``all_spans``, arrays of (start, place, stop, kind) by start, then kind.

    Without trees, only certain candidates join the base spans. Null text: no span. Empty arrays where nothing is found. Any other column is kept; one of these two names is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(_SPANS)
    rows = docs.withColumn("base_spans", F.when(text.rlike("[0-9@]"), _base(text)).otherwise(none))
    places = {k: len(KINDS) + i for i, k in enumerate(GENERATORS)}

    def more(c: Column) -> Column:
        chosen = _certain(c)
        if trees is not None:
            least = F.lit(math.inf)
            for kind, at in trees.thresholds.items():
                least = F.when(c["kind"] == kind, F.lit(at)).otherwise(least)
            chosen = chosen | (trees.expression(c) >= least)
        return chosen & ~_touches(F.col("base_spans"), c)

    def span(c: Column) -> Column:
        place = F.lit(len(KINDS))
        for kind, p in places.items():
            place = F.when(c["kind"] == kind, F.lit(p)).otherwise(place)
        return F.struct(c["start"].alias("start"), place.alias("place"), c["stop"].alias("stop"), c["kind"].alias("kind"))

    extra = F.when(text.rlike("[0-9]") | text.contains("@") | text.contains("at)") | text.contains("at]"), F.transform(F.filter(_candidates(text), more), span).cast(_SPANS)).otherwise(none)
    return rows.withColumn("all_spans", F.sort_array(F.concat("base_spans", extra)))


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span, overlapping ones together, replaced by the first one's kind in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        done = F.when(s["start"] >= acc["at"], F.array_append(acc["out"], piece)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), done.cast("array<string>").alias("out"))

    folded = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(folded)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, train(docs))
    counts = [F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base_spans")), 256).alias("base_sha256"), spelled(F.col("all_spans")).alias("spans"))

"""Dense vectors: the hashing embedder, cosine and exact top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words
from . import scan

DIMENSIONS, DIGITS = 1024, 6
# Fixed value: what questions begin with for this family of models.
QUESTION_PREFIX = "Represent this sentence for searching relevant passages: "


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """A vector of length one; zeros stay as they are."""
    return T.let(F.sqrt(dot(v, v)), lambda n: F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / n)))


def hashing_entries(rows: DataFrame, key: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, bucket, w): the hashing embedder's vectors of ``rows`` (key, text), one row each with the arrays of their non-zero entries."""
    return words.hashing_vectors(rows, key, dimensions)


def vector_entries(vectors: DataFrame, key: str) -> DataFrame:
    """(key, bucket, w) of dense ``vectors`` (key, vec), scaled to length one, so that any model's vectors can be searched."""
    rows = vectors.filter("vec is not null").select(key, normalized(F.col("vec")).alias("v"))
    places = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("bucket"), x.alias("w"))), lambda e: e["w"] != 0)
    return rows.select(key, places.alias("e")).select(key, F.col("e.bucket").alias("bucket"), F.col("e.w").alias("w"))


def _dense(rows: int, size: int, owner: np.ndarray, bucket: np.ndarray, w: np.ndarray) -> np.ndarray:
    matrix = np.zeros((rows, size))
    matrix[owner, bucket] = w
    return matrix


def cosine_top_k(entries: DataFrame, queries: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """(qid, doc, score, rank): the k nearest of ``entries`` (doc, bucket, w) for each of ``queries`` (qid, bucket, w) that share a bucket."""

    def scorer(asked: list[Row]) -> scan.Scorer:
        size = max((max(r.bucket) + 1 for r in asked if r.bucket), default=1)
        owner = np.repeat(np.arange(len(asked)), [len(r.bucket) for r in asked])
        q = _dense(len(asked), size, owner, np.array([b for r in asked for b in r.bucket], np.int64), np.array([w for r in asked for w in r.w]))
        held = (q != 0).astype(np.float32)

        def score(batch: pa.RecordBatch) -> np.ndarray:
            bucket, w = batch.column("bucket"), batch.column("w")
            at, value = bucket.flatten().to_numpy(), w.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), bucket.value_lengths().to_numpy())
            known = at < size
            d = _dense(batch.num_rows, size, owner[known], at[known], value[known])
            shares = (d != 0).astype(np.float32) @ held.T > 0
            return np.where(shares, np.round(d @ q.T, digits), -np.inf)

        return score

    return scan.top_k(entries, queries, k, scorer)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """(qid, doc, score, rank): the k largest inner products of ``queries`` (qid, vec) with all ``vectors`` (doc, vec).

    Rows without an id or a vector take no part; a query meets vectors of its own length.
    """
    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec")).filter("qid is not null and vec is not null")
    rows = vectors.select("doc", F.col("vec").cast("array<double>").alias("vec")).filter("doc is not null and vec is not null")

    def scorer(chunk: list[Row]) -> scan.Scorer:
        sizes = np.array([len(r.vec) for r in chunk])
        matrices = {n: np.array([r.vec for r in chunk if len(r.vec) == n], np.float64) for n in set(sizes.tolist())}

        def score(batch: pa.RecordBatch) -> np.ndarray:
            lengths, out = batch.column("vec").value_lengths().to_numpy(), np.full((batch.num_rows, len(chunk)), -np.inf)
            for n, matrix in matrices.items():
                of = np.flatnonzero(lengths == n)
                if len(of):
                    v = batch.column("vec").take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), n)
                    out[np.ix_(of, sizes == n)] = np.round(v @ matrix.T, digits)
            return out

        return score

    return scan.top_k(rows, asked, k, scorer)


@dataclass(frozen=True)
class Embedder:
    """A model of texts: what turns documents and questions (key, text) into vectors (key, bucket, w), given the key's name."""

    name: str
    documents: Callable[[DataFrame, str], DataFrame]
    questions: Callable[[DataFrame, str], DataFrame]


def hashing(dimensions: int = DIMENSIONS) -> Embedder:
    embed = partial(hashing_entries, dimensions=dimensions)
    return Embedder(f"hashing-{dimensions}", embed, embed)


def sentence_encoder(model: str, prefix: str | None = None) -> Embedder:
    """A sentence encoder by its path; prefix: what its questions begin with (the models that need one have it by default)."""
    if prefix is None:
        prefix = QUESTION_PREFIX if model.startswith("BAAI/bge") else ""
    embed = lambda before: lambda rows, key: vector_entries(encoded(rows, key, model, before), key)
    return Embedder(model, embed(""), embed(prefix))


def embedder(name: str) -> Embedder:
    """The embedder that a setting or an index names: "hashing-<dimensions>", or the path of a sentence encoder."""
    return hashing(int(name.removeprefix("hashing-"))) if name.startswith("hashing-") else sentence_encoder(name)


def encoded(rows: DataFrame, key: str, model: str, prefix: str = "", batch: int = 64) -> DataFrame:
    """(key, vec) of ``rows`` (key, text) by a sentence encoder that is loaded from ``model`` once a task; prefix: put before every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentence_transformers import SentenceTransformer

        encoder = SentenceTransformer(model)
        for part in batches:
            texts = [prefix + (t or "") for t in part.column(1).to_pylist()]
            vectors = encoder.encode(texts, batch_size=batch, normalize_embeddings=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))], names=[key, "vec"])

    source = rows.select(key, F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, vec array<float>")

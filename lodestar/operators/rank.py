"""Rank fusion, multi-query expansion, symbol pins, reranking and the retrieval plan over a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import few, settle
from . import dense, inverted, lexical
from .chunk import embed_text

RRF_K, DEPTH, RERANK_DEPTH, PINS, TOP_K = 60, 50, 30, 3, 8


def rank_within(rows: DataFrame, by: list[str], *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rrf(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, doc, score, rank) fused from ``rankings`` (qid, list_no, doc, rank, and weight if it has one).

    score: the sum of weight / (k + rank). Ties keep the order in which the lists name the documents first.
    """
    weight = F.col("weight") if "weight" in rankings.columns else F.lit(1)
    fused = rankings.groupBy("qid", "doc").agg(F.sum(weight / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    fused = fused.withColumn("score", F.round("score", 12))
    return rank_within(fused, ["qid"], F.desc("score"), "seen", "doc").drop("seen")


#: Scores candidates (qid, doc, question) of a corpus: the same rows with ``score``.
Reranker = Callable[["DataFrame", "Corpus"], DataFrame]


def by_overlap(rows: DataFrame, source: Corpus) -> DataFrame:
    """Share of a question's different tokens that a chunk has, from the terms that the index holds."""
    rows = few(rows)
    held = source.terms.select("doc", F.transform("terms", lambda t: t["term"]).alias("_held"))
    wanted = rows.select("qid", "question").distinct().select("qid", F.array_distinct(T.tokens("question", drop_stop_words=True)).alias("_wanted"))
    both = held.join(rows, "doc").join(few(wanted), "qid")
    share = F.size(F.array_intersect("_wanted", "_held")) / F.greatest(F.size("_wanted"), F.lit(1))
    return both.withColumn("score", share).drop("_held", "_wanted")


def by_columns(score: Callable[[Column, Column], Column]) -> Reranker:
    """A reranker from a function of two text columns, the question and what is indexed of the chunk."""

    def run(rows: DataFrame, source: Corpus) -> DataFrame:
        return source.chunks.select("doc", "embedded").join(few(rows), "doc").withColumn("score", score(F.col("question"), F.col("embedded"))).drop("embedded")

    return run


def cross_encoder(model: str, batch: int = 32) -> Reranker:
    """A reranker by a cross-encoder that is loaded from ``model`` once a task and scores pairs in Arrow batches."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from sentence_transformers import CrossEncoder

        encoder = CrossEncoder(model)
        for questions, texts in pairs:
            yield pd.Series(encoder.predict(list(zip(questions, texts, strict=True)), batch_size=batch)).astype(float)

    return by_columns(score)


@dataclass(frozen=True)
class Corpus:
    """What retrieval reads. chunks: doc, path, start_line, end_line, text, symbol, kind (embedded: what is indexed).

    nodes: graph nodes with name, qual, kind, doc, id, or None. entries: vectors (doc, bucket, w) that ``embedder`` made, or None.
    postings: the inverted index of ``terms``, or None: a search then scans the terms.
    """

    chunks: DataFrame
    terms: DataFrame
    entries: DataFrame | None = None
    nodes: DataFrame | None = None
    embedder: dense.Embedder = dense.hashing()
    postings: inverted.Inverted | None = None


def embedded(chunks: DataFrame) -> DataFrame:
    """``chunks`` with what is indexed of each."""
    return chunks.withColumn("embedded", embed_text(F.col("path"), F.col("kind"), F.col("symbol"), F.col("context"), F.col("text")))


def corpus(chunks: DataFrame, nodes: DataFrame | None = None, with_dense: bool = True, embedder: dense.Embedder | None = None) -> Corpus:
    """Index ``chunks``: term counts, and vectors unless only words are wanted."""
    embedder, whole = embedder or dense.hashing(), embedded(chunks)
    indexed = whole.select("doc", "symbol", F.col("embedded").alias("text"))
    return Corpus(whole, lexical.documents_terms(indexed), embedder.documents(indexed, "doc") if with_dense else None, nodes, embedder)


def first_stage(source: Corpus, queries: DataFrame, mode: str, depth: int, k: int = RRF_K) -> tuple[DataFrame, DataFrame]:
    """Fused ranking (qid, doc, score, rank) of ``queries`` (qid, text) and the retrievers' own (qid, retriever, list_no, doc, rank).

    mode: dense, bm25 or hybrid. A missing part is a RuntimeError, another mode a ValueError.
    """
    if mode not in ("dense", "bm25", "hybrid"):
        raise ValueError(f"unknown retrieval mode {mode!r}")
    lists = []
    if mode != "bm25":
        if source.entries is None:
            raise RuntimeError(f"retrieval mode {mode!r} needs vectors")
        near = dense.cosine_top_k(source.entries, source.embedder.questions(queries, "qid"), depth)
        lists.append(near.withColumns({"retriever": F.lit("dense"), "list_no": F.lit(0)}))
    if mode != "dense":
        lists.append(lexical.bm25_top_k(source.postings or source.terms, queries, depth).withColumns({"retriever": F.lit("bm25"), "list_no": F.lit(1)}))
    # a few rows a query, read again and again by what follows
    lists = [settle(part.select("qid", "retriever", "list_no", "doc", "rank")) for part in lists]
    rankings = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    return rrf(rankings, k), rankings


def symbol_table(chunks: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """(key, doc, ord): lower-case names, whole and short, of what chunks define; graph nodes fill the gaps after them."""
    both = lambda n: F.array_distinct(F.array(F.lower(n), F.lower(F.element_at(F.split(n, "\\.", -1), -1))))
    own = chunks.filter(~F.col("kind").isin("window", "module", "class_body") & (F.col("symbol") != ""))
    own = own.select("doc", F.posexplode(F.split("symbol", ", ", -1)).alias("at", "name")).select("doc", F.explode(both(F.col("name"))).alias("key"), F.lit(0).alias("src"), F.col("doc").alias("pos"), "at")
    if nodes is not None:
        names = F.array_distinct(F.array(F.lower("qual"), F.lower("name")))
        more = nodes.filter((F.col("kind") != "module") & (F.col("doc") >= 0)).select("doc", F.explode(names).alias("key"), F.lit(1).alias("src"), F.col("id").cast("long").alias("pos"), F.lit(0).alias("at"))
        # a name that a chunk has under the same key already is no gap
        own = own.unionByName(more.join(own.select("key", "doc").distinct(), ["key", "doc"], "left_anti").dropDuplicates(["key", "doc", "src"]))
    order = Window.partitionBy("key").orderBy("src", "pos", "at")
    return own.withColumn("ord", F.row_number().over(order)).select("key", "doc", "ord")


def symbol_pins(questions: DataFrame, table: DataFrame, most: int = PINS) -> DataFrame:
    """(qid, doc, pin): definitions that a question (qid, text) names. The first ``most`` of each term by name, ``most`` in all."""
    terms = questions.select("qid", F.posexplode(T.identifier_terms("text")).alias("t", "key"))
    hits = terms.join(table.filter(F.col("ord") <= most), "key").groupBy("qid", "doc").agg(F.min(F.struct("t", "ord")).alias("at"))
    return rank_within(hits, ["qid"], "at").filter(F.col("rank") <= most).select("qid", "doc", F.col("rank").alias("pin"))


def retrieve(
    source: Corpus, questions: DataFrame, k: int = TOP_K, mode: str = "hybrid", rewrites: DataFrame | None = None, rerank: Reranker | None = None,
    pins: bool = True, depth: int = DEPTH, rerank_depth: int = RERANK_DEPTH, rrf_k: int = RRF_K, all_ranks: bool = False,
) -> DataFrame:
    """Hits (qid, pos, doc, score, detail) for a batch of ``questions`` (qid, text, and k if each has its own).

    rewrites: (qid, pos, text), each ranked by itself and fused with the question's own ranking, which counts twice. rerank:
    scores the first ``rerank_depth`` places. Pinned definitions come
    first (not in dense mode). detail: ranks of the question itself in each retriever (null if absent), whether it is a
    pin, its reranked place. ``all_ranks`` keeps every place, numbered by ``pos``.
    """
    depth = max(k, depth, rerank_depth if rerank else 0)
    fused, rankings = first_stage(source, questions.select("qid", "text"), mode, depth, rrf_k)
    if rewrites is not None:
        again = rewrites.select(F.concat_ws(":", "qid", "pos").alias("qid"), F.col("qid").alias("of"), "pos", "text")
        lists, _ = first_stage(source, again.select("qid", "text"), mode, depth, rrf_k)
        lists = lists.join(again.select("qid", "of", "pos"), "qid").select(F.col("of").alias("qid"), (F.col("pos") + 1).alias("list_no"), "doc", "rank", F.lit(1).alias("weight"))
        own = fused.select("qid", F.lit(0).cast("long").alias("list_no"), "doc", "rank", F.lit(2).alias("weight"))
        fused = rrf(own.unionByName(lists.withColumn("list_no", F.col("list_no").cast("long"))), rrf_k)
    schema = "qid long, doc long, pin int"
    pinned = settle(symbol_pins(questions, symbol_table(source.chunks, source.nodes))) if pins and mode != "dense" else source.chunks.sparkSession.createDataFrame([], schema)
    rest = fused.join(pinned.select("qid", "doc"), ["qid", "doc"], "left_anti")
    rest = settle(rank_within(rest.withColumnRenamed("rank", "_r"), ["qid"], "_r").drop("_r"))
    if rerank is not None:
        count = pinned.groupBy("qid").agg(F.count("*").alias("pins"))
        rest = rest.join(count, "qid", "left").withColumn("near", F.col("rank") <= F.lit(rerank_depth) - F.coalesce("pins", F.lit(0)))
        near = rest.filter("near").select("qid", "doc", F.col("rank").alias("_r")).join(questions.select("qid", F.col("text").alias("question")), "qid")
        near = rerank(near, source).select("qid", "doc", F.round("score", 12).alias("score"), "_r")
        near = rank_within(near, ["qid"], F.desc("score"), "_r").withColumn("reranked", F.col("rank")).drop("_r")
        tail = rest.filter("not near").select("qid", "doc", "score", "rank", F.lit(None).cast("int").alias("reranked"))
        rest = near.select("qid", "doc", "score", "rank", "reranked").unionByName(tail)
    else:
        rest = rest.select("qid", "doc", "score", "rank", F.lit(None).cast("int").alias("reranked"))
    top = rest.filter("rank = 1").select("qid", (F.col("score") + 1).alias("top"))
    first = pinned.join(top, "qid", "left").select("qid", "doc", F.coalesce("top", F.lit(1.0)).alias("score"), F.col("pin").alias("rank"), F.lit(None).cast("int").alias("reranked"), F.lit(0).alias("part"))
    ordered = rank_within(first.unionByName(rest.withColumn("part", F.lit(1))), ["qid"], "part", "rank").withColumnRenamed("rank", "pos")
    if not all_ranks:
        if "k" in questions.columns:
            ordered = ordered.join(questions.select("qid", F.col("k").alias("_k")), "qid").filter("pos <= _k").drop("_k")
        else:
            ordered = ordered.filter(F.col("pos") <= k)
    of = lambda name: rankings.filter(F.col("retriever") == name).select("qid", "doc", F.col("rank").alias(name))
    hits = ordered.join(of("dense"), ["qid", "doc"], "left").join(of("bm25"), ["qid", "doc"], "left")
    detail = F.struct("dense", "bm25", (F.col("part") == 0).alias("symbol"), F.col("reranked").alias("rerank"), F.lit(None).cast("string").alias("graph"))
    return hits.select("qid", "pos", "doc", "score", detail.alias("detail"))

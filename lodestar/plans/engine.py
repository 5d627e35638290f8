"""The engine as a user meets it: settings, index, search, answers, graph questions and evaluation over batches of questions."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, cite, context, dense, evaluate, graph, inverted, lexical, rank, syntax
from ..sources import files, store
from . import prompts

PREFIX = "LODESTAR_"
#: Bounds on what a question may ask for: hits, and characters of its text.
MOST_HITS, LONGEST = 20, 1000
#: Where a repair stands among an answer's events, behind all tokens.
REPAIR = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Every value that changes results. :meth:`from_environment` reads LODESTAR_<NAME>."""

    chunker: str = "syntax"
    chunk_lines: int = 60
    chunk_overlap: int = 15
    max_lines: int = syntax.MAX_LINES
    min_lines: int = syntax.MIN_LINES
    exclude: tuple[str, ...] = ()
    mode: str = "hybrid"
    depth: int = rank.DEPTH
    rrf_k: int = rank.RRF_K
    pins: bool = True
    top_k: int = rank.TOP_K
    rerank: bool = False
    rerank_depth: int = rank.RERANK_DEPTH
    rewrite: bool = True
    expand: bool = True
    seeds: int = graph.SEEDS
    extra: int = graph.EXTRA
    impact_depth: int = graph.DEPTH
    budget: int = context.BUDGET
    line_numbers: bool = True
    strict: bool = True
    broad_lines: int = cite.BROAD
    model: str = "hashing-1024"
    answer_prompt: str = "answer_v1"
    rewrite_prompt: str = "rewrite_v1"
    repair_prompt: str = "repair_v1"

    @classmethod
    def from_environment(cls, **given) -> Settings:
        read = {bool: lambda v: v.lower() in ("1", "true", "yes", "on"), int: int, tuple: lambda v: tuple(x for x in v.split(",") if x), str: str}
        found = {}
        for f in fields(cls):
            if (value := os.environ.get(PREFIX + f.name.upper())) is not None:
                found[f.name] = read[type(f.default)](value)
        return replace(cls(), **found | given)


class Generator(Protocol):
    """A language model over a batch: (qid, system, user) in, (qid, text) out; a question without a row had a failed call."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


def canned(answers: DataFrame) -> Generator:
    """A generator that looks its answers up in a table (qid, text)."""
    return lambda requests: answers.join(requests.select("qid"), "qid", "left_semi")


def cached(generator: Generator, cache: DataFrame, model: str, temperature: float = 0.1, seed: int = 42, size: int = 10_240) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """A generator that asks only what ``cache`` (key, text) lacks. It returns the answers and the cache's new rows."""

    def run(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        messages = F.struct("system", "user")
        key = T.cache_key(F.lit("batch"), F.lit(model), F.lit(temperature), F.lit(seed), F.lit(size), messages)
        keyed = requests.withColumn("key", key)
        known, missing = store.cached_answers(keyed, cache)
        new = generator(missing.select("qid", "system", "user")).join(missing.select("qid", "key"), "qid")
        return known.select("qid", "text").unionByName(new.select("qid", "text")), new.select("key", "text").dropDuplicates(["key"])

    return run


@dataclass(frozen=True)
class Index:
    """What questions are asked of. vectors: (id, model, bucket, w), one row a chunk, or None; reused: how many of them an earlier
    index had. parsed: what one parse of each file gave, and imported: the names that files import, both None without a graph."""

    sources: DataFrame
    chunks: DataFrame
    corpus: rank.Corpus
    nodes: DataFrame | None
    edges: DataFrame | None
    stats: DataFrame
    vectors: DataFrame | None = None
    reused: int = 0
    parsed: DataFrame | None = None
    imported: DataFrame | None = None

    def save(self, folder: str, settings: Settings) -> None:
        """Write the index as the newest version in ``folder``; the mark of completeness comes last."""
        meta = {"model": self.corpus.embedder.name, "chunker": settings.chunker, "chunk_lines": settings.chunk_lines, "chunk_overlap": settings.chunk_overlap, "max_lines": settings.max_lines}
        meta |= self.stats.first().asDict() | {"n_embedded": self.vectors.count() - self.reused if self.vectors is not None else 0, "built_at": datetime.now(UTC).isoformat(timespec="seconds")}
        postings = inverted.compact(self.corpus.postings or inverted.invert(self.corpus.terms))
        more = {"blocks": postings.blocks, "block_stats": inverted.told(postings), "parsed": self.parsed, "imported": self.imported}
        store.save_index(folder, meta, sources=self.sources, chunks=self.chunks, terms=self.corpus.terms, vectors=self.vectors, nodes=self.nodes, edges=self.edges, **more)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, embedder: dense.Embedder | None = None) -> Index:
        """The newest version in ``folder``. Questions are embedded by the model that made the vectors, which the index names; another
        ``embedder`` is a ValueError."""
        t = store.load_index(spark, folder)
        model = t["meta"].first()["model"]
        embedder = embedder or dense.embedder(model)
        if embedder.name != model:
            raise ValueError(f"the index was built with {model!r}, not with {embedder.name!r}")
        vectors = t.get("vectors")
        postings = inverted.loaded(t["blocks"], t["block_stats"]) if "blocks" in t else None
        corpus = rank.Corpus(rank.embedded(t["chunks"]), t["terms"], _entries(t["chunks"], vectors), t.get("nodes"), embedder, postings)
        return cls(t["sources"], t["chunks"], corpus, t.get("nodes"), t.get("edges"), chunk.index_stats(t["chunks"]), vectors, 0, t.get("parsed"), t.get("imported"))


def _entries(chunks: DataFrame, vectors: DataFrame | None) -> DataFrame | None:
    return None if vectors is None else chunks.select("id", "doc").join(vectors.select("id", "bucket", "w"), "id").select("doc", "bucket", "w")


def embed_chunks(chunks: DataFrame, previous: Index | None, embedder: dense.Embedder) -> tuple[DataFrame, int]:
    """(id, model, bucket, w) for ``chunks``, and how many are the previous index's: only chunks whose id it lacks, or all if another
    model made its vectors, are embedded."""
    new, known = store.stale(rank.embedded(chunks), previous.vectors if previous else None, embedder.name)
    columns = ["id", F.lit(embedder.name).alias("model"), "bucket", "w"]
    made = embedder.documents(new.select("id", F.col("embedded").alias("text")).dropDuplicates(["id"]), "id").select(*columns)
    made = store.settle(made)
    if known is None:
        return made, 0
    known = store.settle(known.select("id", "model", "bucket", "w"))
    return made.unionByName(known), known.count()


def build_index(sources: DataFrame, settings: Settings | None = None, previous: Index | None = None, embedder: dense.Embedder | None = None) -> Index:
    """Index ``sources`` (path, file_ord, text): one parse a file gives chunks, definitions and references.

    previous: an index whose vectors are used again for chunks that did not change. embedder: else the one that ``settings.model`` names.
    """
    settings = settings or Settings()
    embedder = embedder or dense.embedder(settings.model)
    parsed = None
    if settings.chunker == "syntax":
        python = sources.filter(F.col("path").endswith(".py") | F.col("path").endswith(".ipynb"))
        parsed = store.settle(syntax.parse_files(python, settings.max_lines, settings.min_lines))
    whole = sources if parsed is not None else sources.repartitionByRange("file_ord")
    chunks = syntax.numbered(syntax.chunk_files(whole, parsed, settings.chunk_lines, settings.chunk_overlap), ranged=parsed is None)
    if chunks.isEmpty():
        raise ValueError("nothing to index: no source has any text")
    nodes = edges = vectors = imported = None
    reused = 0
    if parsed is not None:
        imported = store.settle(syntax.imports(sources))
        nodes, edges = resolved(parsed, chunks, imported)
    if settings.mode != "bm25":
        vectors, reused = embed_chunks(chunks, previous, embedder)
    corpus = replace(rank.corpus(chunks, nodes, False, embedder), entries=_entries(chunks, vectors))
    if settings.mode != "dense":
        terms = store.settle(corpus.terms)
        corpus = replace(corpus, terms=terms, postings=inverted.invert(terms))
    return Index(sources, chunks, corpus, nodes, edges, chunk.index_stats(chunks), vectors, reused, parsed, imported)


def resolved(parsed: DataFrame, chunks: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph, from what the parses of files gave."""
    nodes = syntax.definitions(parsed, chunks)
    edges, _ = graph.resolve(nodes, syntax.references(parsed, nodes), syntax.bases(nodes), imported)
    return nodes, store.settle(edges)


def update_index(index: Index, changed: DataFrame, settings: Settings | None = None) -> Index:
    """``index`` after a change of some sources, ``changed`` (path, file_ord, text): new and edited ones, and with null text deleted ones.

    Only changed texts are read: they are chunked, parsed, counted and embedded. Terms change by signed differences
    (:func:`inverted.update`); names are resolved again from the stored parses, as a changed file may change what others mean.
    Hits, graph and counts equal those of an index built anew, but for chunk numbers: new chunks are numbered behind the older ones.
    """
    settings, embedder = settings or Settings(), index.corpus.embedder
    changed = store.settle(changed)
    paths, present = changed.select("path").distinct(), changed.filter("text is not null")
    without = lambda rows: rows.join(paths, "path", "left_anti")
    sources = without(index.sources).unionByName(present.select(*index.sources.columns))
    parsed = fresh = imported = nodes = edges = None
    if index.parsed is not None:
        python = present.filter(F.col("path").endswith(".py") | F.col("path").endswith(".ipynb"))
        fresh = store.settle(syntax.parse_files(python, settings.max_lines, settings.min_lines))
        parsed = store.settle(without(index.parsed).unionByName(fresh))
        imported = store.settle(without(index.imported).unionByName(syntax.imports(present)))
    after = (index.chunks.agg(F.max("doc")).first()[0] or 0) + 1
    made = syntax.numbered(syntax.chunk_files(present, fresh, settings.chunk_lines, settings.chunk_overlap))
    made = store.settle(made.withColumn("doc", F.col("doc") + after).select(*index.chunks.columns))
    gone = store.settle(index.chunks.join(paths, "path", "left_semi").select("doc"))
    chunks = store.settle(without(index.chunks).unionByName(made))
    if parsed is not None:
        nodes, edges = resolved(parsed, chunks, imported)
    terms, postings = index.corpus.terms, index.corpus.postings
    added = lexical.documents_terms(rank.embedded(made).select("doc", "symbol", F.col("embedded").alias("text")))
    if postings is not None:
        added = store.settle(added)
        postings = inverted.update(postings, store.settle(terms.join(gone, "doc", "left_semi")), added)
    terms = terms.join(gone, "doc", "left_anti").unionByName(added)
    vectors, reused = (None, 0) if index.vectors is None else embed_chunks(chunks, index, embedder)
    corpus = rank.Corpus(rank.embedded(chunks), terms, _entries(chunks, vectors), nodes, embedder, postings)
    return Index(sources, chunks, corpus, nodes, edges, chunk.index_stats(chunks), vectors, reused, parsed, imported)


def index_tree(spark: SparkSession, root: str, settings: Settings | None = None, previous: Index | None = None, embedder: dense.Embedder | None = None) -> Index:
    settings = settings or Settings()
    return build_index(files.read_tree(spark, root, list(settings.exclude)), settings, previous, embedder)


def askable(questions: DataFrame) -> DataFrame:
    """``questions`` (qid, text) that can be asked: trimmed, not empty, of at most ``LONGEST`` characters."""
    rows = questions.withColumn("text", T.strip(F.coalesce("text", F.lit(""))))
    return rows.filter((F.col("text") != "") & (F.length("text") <= LONGEST))


def rewrite(questions: DataFrame, generator: Generator, settings: Settings | None = None) -> DataFrame:
    """(qid, pos, text): search queries that a model writes for each question."""
    asked = prompts.requests(questions, (settings or Settings()).rewrite_prompt, question=F.col("text"))
    return generator(asked).select("qid", F.posexplode(T.rewrites("text")).alias("pos", "text"))


def search(index: Index, questions: DataFrame, settings: Settings | None = None, rewrites: DataFrame | None = None, rerank: rank.Reranker | None = None, all_ranks: bool = False) -> DataFrame:
    """Hits (qid, pos, doc, score, detail) of ``questions`` (qid, text), 1 to ``MOST_HITS`` each."""
    s = settings or Settings()
    s = replace(s, top_k=min(max(s.top_k, 1), MOST_HITS))
    scorer = (rerank or rank.by_overlap) if s.rerank or rerank else None
    return rank.retrieve(index.corpus, questions, s.top_k, s.mode, rewrites if s.rewrite else None, scorer, s.pins, s.depth, s.rerank_depth, s.rrf_k, all_ranks)


def gather(index: Index, questions: DataFrame, settings: Settings | None = None, rewrites: DataFrame | None = None, rerank: rank.Reranker | None = None) -> DataFrame:
    """(qid, pos, doc, score, detail, reason): hits, and behind them what the graph adds."""
    s = settings or Settings()
    ranked = store.settle(search(index, questions, s, rewrites, rerank, all_ranks=True))
    hits = ranked.filter(F.col("pos") <= s.top_k).withColumn("reason", F.lit(""))
    if not s.expand or index.edges is None:
        return hits
    more = graph.expand(questions, ranked, index.chunks, index.nodes, index.edges, s.top_k, s.extra, s.seeds)
    none = F.lit(None)
    detail = F.struct(none.cast("int").alias("dense"), none.cast("int").alias("bm25"), F.lit(False).alias("symbol"), none.cast("int").alias("rerank"), F.col("reason").alias("graph"))
    more = more.select("qid", (F.col("pos") + s.top_k).alias("pos"), "doc", "score", detail.alias("detail"), "reason")
    return hits.unionByName(more)


#: What is told about a batch of answers while they are made: an event's name, its place, and rows (qid, body).
Watcher = Callable[[str, int, DataFrame], None]


def answer(
    index: Index, questions: DataFrame, generator: Generator, settings: Settings | None = None, rewrites: DataFrame | None = None, repairer: Generator | None = None, watch: Watcher | None = None
) -> DataFrame:
    """Answers (qid, question, text, repaired, draft, used, report, draft_report) checked against what was shown.

    A draft that fails the check is repaired once by ``repairer`` (the same generator if none is given) and replaced if the
    revision is better. Questions that cannot be asked have no answer. prompt_id and prompt_hash name the draft's prompt; t_retrieve,
    t_generate and t_total are the batch's seconds a question. watch: told the sources before the model is asked, what is wrong with drafts before they
    are repaired, and the answers at last.
    """
    s = settings or Settings()
    tell = watch or (lambda event, place, rows: None)
    questions = store.settle(askable(questions))
    began, n = time.monotonic(), max(1, questions.count())
    hits = store.settle(gather(index, questions, s, rewrites))
    found = time.monotonic()
    packed = context.assemble(hits, index.chunks, s.budget, s.line_numbers)
    shown = packed.select("qid", F.posexplode("used").alias("pos", "doc")).join(index.chunks, "doc")
    first = shown.filter("pos = 0").select("qid", chunk.citation(F.col("path"), F.col("start_line"), F.least(F.col("start_line") + 2, F.col("end_line"))).alias("example"))
    ready = questions.select("qid", F.col("text").alias("question")).join(packed, "qid", "left").join(first, "qid", "left")
    asked = prompts.requests(ready, s.answer_prompt, question=F.col("question"), context=F.coalesce("context", F.lit("")), example=F.coalesce("example", F.lit("path:start-end")))
    tell("sources", 0, packed.select("qid", F.to_json("used").alias("body")))
    drafts = store.settle(generator(asked).select("qid", T.normalize_citations("text").alias("text")))
    written = time.monotonic()
    reports = store.settle(cite.check_answers(drafts, shown, s.broad_lines))
    final, final_reports = drafts.withColumn("repaired", F.lit(False)), reports
    if s.strict:
        bad = reports.filter("not ok")
        told = cite.problems(bad).select("qid", F.array_join(F.transform("problems", lambda p: F.concat(F.lit("- "), p)), "\n").alias("problems"))
        paths = shown.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_set("path")), ", ").alias("paths"))
        told = told.join(bad.select("qid", (F.size("invalid") > 0).alias("astray")), "qid").join(paths, "qid", "left")
        told = told.select("qid", F.when(F.col("astray"), F.concat("problems", F.lit("\n- These files alone can be cited: "), F.coalesce("paths", F.lit("none")))).otherwise(F.col("problems")).alias("problems"))
        tell("repair", REPAIR, told.select("qid", F.col("problems").alias("body")))
        again = told.join(drafts.select("qid", F.col("text").alias("draft")), "qid")
        again = prompts.requests(again, s.repair_prompt, problems=F.col("problems"), draft=F.col("draft"))
        revised = store.settle((repairer or generator)(again).select("qid", T.normalize_citations("text").alias("text")))
        revised_reports = cite.check_answers(revised, shown, s.broad_lines)
        chosen = store.settle(cite.choose_repairs(reports, revised_reports))
        better = revised.join(chosen.filter("repaired"), "qid").select("qid", "text", "repaired")
        final = drafts.join(better.select("qid"), "qid", "left_anti").withColumn("repaired", F.lit(False)).unionByName(better)
        final_reports = reports.join(better.select("qid"), "qid", "left_anti").unionByName(revised_reports.join(better.select("qid"), "qid", "left_semi"))
    packs = lambda r, name: r.select("qid", F.struct(*[c for c in r.columns if c != "qid"]).alias(name))
    rows = questions.select("qid", F.col("text").alias("question")).join(final, "qid").join(drafts.select("qid", F.col("text").alias("draft")), "qid")
    rows = rows.join(packed.select("qid", "used"), "qid", "left").join(packs(final_reports, "report"), "qid").join(packs(reports, "draft_report"), "qid")
    prompt = prompts.load(s.answer_prompt)
    rows = store.settle(rows.select("*", F.lit(prompt.id).alias("prompt_id"), F.lit(prompt.hash).alias("prompt_hash")))
    tell("done", REPAIR + 1, rows.select("qid", F.col("text").alias("body")))
    each = {"t_retrieve": found - began, "t_generate": written - found, "t_total": time.monotonic() - began}
    return rows.select("*", *(F.lit(round(seconds / n, 6)).alias(name) for name, seconds in each.items()))


def events(answers: DataFrame) -> DataFrame:
    """(qid, seq, event, body): an answer as the series of events that a page shows."""
    body = lambda name, value: F.struct(F.lit(name).alias("event"), value.cast("string").alias("body"))
    series = F.filter(
        F.array(body("sources", F.to_json("used")), body("draft", F.col("draft")), F.when(~F.col("draft_report.ok"), body("repair", F.to_json("draft_report"))), body("done", F.col("text"))),
        lambda e: e.isNotNull(),
    )
    return answers.select("qid", F.posexplode(series).alias("seq", "e")).select("qid", "seq", "e.*")


def run_log(answers: DataFrame, settings: Settings, folder: str) -> None:
    """Append answers to the run log, with their prompts, citations and times."""
    rows = answers.select(
        F.current_timestamp().alias("ts"), "qid", "question", F.lit(settings.model).alias("model"), "prompt_id", "prompt_hash", F.coalesce(F.size("used"), F.lit(0)).alias("n_used"),
        F.col("report.n_citations").alias("n_citations"), F.size("report.invalid").alias("invalid"), "repaired", "t_retrieve", "t_generate", "t_total",
    )
    store.append_log(rows, folder)


def who_calls(index: Index, symbols: DataFrame) -> DataFrame:
    """Edges into the definitions of ``symbols`` (qid, symbol), by path and line."""
    found = graph.find(index.nodes, symbols).select("qid", "id")
    return graph.callers(index.edges, found).join(index.nodes.select(F.col("id").alias("src"), "qual", "path"), "src").orderBy("qid", "path", "line")


def calls_of(index: Index, symbols: DataFrame) -> DataFrame:
    """Edges out of the definitions of ``symbols``, by line."""
    found = graph.find(index.nodes, symbols).select("qid", "id")
    return graph.callees(index.edges, found).join(index.nodes.select(F.col("id").alias("dst"), "qual", "path"), "dst").orderBy("qid", "line")


def impact_of(index: Index, symbols: DataFrame, depth: int | None = None) -> DataFrame:
    """What depends on the definitions of ``symbols``, by distance and path."""
    found = graph.find(index.nodes, symbols).select("qid", "id")
    hit = graph.impact_edges(index.edges, index.nodes, found, depth or graph.DEPTH)
    return hit.join(index.nodes.select("id", "qual", "path"), "id").orderBy("qid", "hop", "path")


def suggested_questions(index: Index, most: int = 3) -> DataFrame:
    """(pos, text): questions to begin with, two about each of the ``most`` definitions with most callers; one about all of it without any."""
    spark = index.chunks.sparkSession
    overview = spark.createDataFrame([(0, "Which parts is this code made of, and how do they work together?")], "pos int, text string")
    if index.edges is None:
        return overview
    top = graph.suggestions(index.nodes, index.edges, most)
    asked = F.array(F.concat(F.lit("How does `"), "qual", F.lit("` work?")), F.concat(F.lit("Who calls `"), "qual", F.lit("`, and with what?")))
    rows = top.select("pos", F.posexplode(asked).alias("n", "text"))
    return overview.unionByName(rows.select((2 * F.col("pos") + F.col("n") - 1).cast("int").alias("pos"), "text"))


def evaluate_retrieval(index: Index, gold: DataFrame, settings: Settings | None = None, rewrites: DataFrame | None = None) -> DataFrame:
    """Recall, MRR and hit@1 by type for ``gold`` (qid, question, type, targets)."""
    hits = search(index, gold.select("qid", F.col("question").alias("text")), settings, rewrites)
    return evaluate.retrieval_metrics(evaluate.first_ranks(gold, hits, index.chunks))


def evaluate_trace(index: Index, gold: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Shares of targets found by the top k, by as many hits as the graph gives, and with the graph."""
    s = settings or Settings()
    asked = gold.select("qid", F.col("question").alias("text"))
    ranked = store.settle(search(index, asked, s, all_ranks=True))
    hits = ranked.filter(F.col("pos") <= s.top_k).select("qid", "doc")
    more = store.settle(graph.expand(asked, ranked, index.chunks, index.nodes, index.edges, s.top_k, s.extra, s.seeds).select("qid", "doc"))
    size = more.groupBy("qid").agg(F.count("*").alias("n"))
    base = ranked.join(size, "qid", "left").filter(F.col("pos") <= s.top_k + F.coalesce("n", F.lit(0))).select("qid", "doc")
    return evaluate.trace_metrics(gold, index.chunks, hits, base, hits.unionByName(more))


def evaluate_any(index: Index, gold: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Trace metrics for gold with several targets a question, retrieval metrics for any other."""
    return evaluate_trace(index, gold, settings) if evaluate.is_trace(gold) else evaluate_retrieval(index, gold, settings)


def evaluate_answers(index: Index, gold: DataFrame, generator: Generator, settings: Settings | None = None, rewrites: DataFrame | None = None) -> DataFrame:
    """One row of answer metrics: the engine answers the questions of ``gold`` (qid, question, type, targets) and checks what it cites."""
    answers = answer(index, gold.select("qid", F.col("question").alias("text")), generator, settings, rewrites)
    return evaluate.answer_metrics(gold, answers.select("qid", "text", "repaired"), answers.select("qid", "report.*"))


def result_rows(metrics: DataFrame, kind: str, gold: str, settings: Settings | None = None, label: str = "") -> DataFrame:
    """Metrics as rows that :func:`keep_results` appends and :func:`lodestar.sources.files.read_results` reads: one of kind retrieval (types as JSON) or
    answers, one for each variant of kind trace."""
    s = settings or Settings()
    head = {"ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "label": F.lit(label), "kind": F.lit(kind), "gold": F.lit(gold), "k": F.lit(s.top_k), "chunker": F.lit(s.chunker)}
    head |= {"mode": F.lit(s.mode), "symbol_pin": F.lit(s.pins), "rerank": F.lit(s.rerank), "rewrite": F.lit(s.rewrite)}
    return evaluate.stored(metrics, kind).select(*(c.alias(n) for n, c in head.items()), "*")


def keep_results(rows: DataFrame, folder: str) -> None:
    """Append :func:`result_rows` to the results in ``folder``."""
    store.append_log(rows, folder)


def report(results: DataFrame, gold: str | None = None) -> dict[str, DataFrame]:
    """Stored results as three tables, by kind, oldest first; of one gold set if it is named."""
    head = ["ts", "label", "gold", "k", "chunker", "mode", "symbol_pin", "rerank", "rewrite"]
    columns = {
        "retrieval": ["n", "recall", "mrr", "hit1", "by_type"],
        "trace": ["variant", "n", "mean_added", "target_recall", "all_found"],
        "answers": ["n", "gold_cited", "valid_rate", "claims_cited", "unsupported_per_answer", "mean_width", "repaired"],
    }
    return {kind: evaluate.report(results, kind, gold).select(*head, *names).orderBy("ts", *(["variant"] if kind == "trace" else [])) for kind, names in columns.items()}


def graph_view(index: Index, symbols: DataFrame, depth: int | None = None, most: int = 5) -> DataFrame:
    """(qid, symbol, pos, qual, path, line, callers, callees, n_nodes, n_files, similar): the first ``most`` definitions of each of
    ``symbols`` (qid, symbol) with what calls it, what it calls and how much depends on it; a symbol without any has one row
    with names like it."""
    found = graph.find(index.nodes, symbols).join(index.nodes.select("id", "qual", "path", "line"), "id")
    found = rank.rank_within(found, ["qid"], "path", "line").filter(F.col("rank") <= most).withColumnRenamed("rank", "pos")
    keyed = store.settle(found.select(F.monotonically_increasing_id().alias("at"), "*"))
    starts = keyed.select(F.col("at").alias("qid"), "id")
    name = lambda side: index.nodes.select(F.col("id").alias(side), "qual")
    listed = lambda edges, side, to: edges.join(name(side), side).groupBy("qid").agg(F.sort_array(F.collect_set("qual")).alias(to))
    parts = [listed(graph.callers(index.edges, starts), "src", "callers"), listed(graph.callees(index.edges, starts), "dst", "callees"), graph.affected(graph.impact(index.edges, starts, depth or graph.DEPTH), index.nodes)]
    rows = keyed.drop("id", "tier")
    for part in parts:
        rows = rows.join(part.withColumnRenamed("qid", "at"), "at", "left")
    lost = symbols.join(found.select("qid").distinct(), "qid", "left_anti")
    names = graph.similar(index.nodes, lost).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("s")).select("qid", F.col("s.name").alias("similar"))
    none = F.array().cast("array<string>")
    rows = symbols.join(rows.drop("at"), "qid", "left").join(names, "qid", "left")
    lists = {c: F.coalesce(c, none) for c in ("callers", "callees", "similar")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_nodes", "n_files")}
    return rows.withColumns(lists).select("qid", "symbol", "pos", "qual", "path", "line", "callers", "callees", "n_nodes", "n_files", "similar").orderBy("qid", "pos")

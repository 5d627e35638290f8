"""Small inputs for what tables cannot exercise, against results worked out by hand."""

import pytest
import samples
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import cite, evaluate, graph, rank, syntax
from lodestar.sources import files, store

CASES = {}


def gives(columns, rows):
    """A function of a session, and the rows that it has to give."""

    def add(function):
        CASES[function.__name__] = (function, columns, rows)
        return function

    return add


def sample_graph(spark):
    """The sample sources as files, chunks, nodes and edges."""
    sources = spark.createDataFrame(samples.FILES, "path string, text string").withColumn("file_ord", files.walk_order(F.col("path")))
    parsed = syntax.parse_files(sources)
    chunks = syntax.numbered(syntax.chunk_files(sources, parsed))
    nodes = syntax.definitions(parsed, chunks)
    edges, counts = graph.resolve(nodes, syntax.references(parsed, nodes), syntax.bases(nodes), syntax.imports(sources))
    return sources, chunks, nodes, store.settle(edges), counts


@gives("src, dst, kind, line, how", samples.EDGES)
def call_graph_edges(spark):
    _, _, nodes, edges, _ = sample_graph(spark)
    name = lambda side: nodes.select(F.col("id").alias(side), F.col("qual").alias(f"{side}_name"))
    return edges.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "kind", "line", "how")


@gives("qual, pos, base", samples.ANCESTORS)
def class_ancestry(spark):
    _, _, nodes, _, _ = sample_graph(spark)
    return graph.ancestry(syntax.bases(nodes), nodes.filter("kind = 'class'").select("qual", "name"))


@gives("path, start_line, end_line, symbol, kind", samples.CHUNKS)
def syntax_chunks(spark):
    return sample_graph(spark)[1].select("path", "start_line", "end_line", "symbol", "kind")


@gives("symbol, qual, tier", samples.FOUND)
def symbol_find(spark):
    nodes = sample_graph(spark)[2]
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(samples.SYMBOLS)], "qid long, symbol string")
    found = graph.find(nodes, asked).join(nodes.select("id", "qual"), "id").join(asked, "qid")
    return found.select("symbol", "qual", "tier")


@gives("symbol, pos, name", samples.SIMILAR)
def similar_names(spark):
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(samples.MISSPELT)], "qid long, symbol string")
    return graph.similar(sample_graph(spark)[2], asked).join(asked, "qid").select("symbol", "pos", "name")


def sample_questions(spark):
    return spark.createDataFrame(samples.QUESTIONS, "qid long, text string")


@gives("qid, pin, symbol", samples.PINS)
def symbol_pins(spark):
    _, chunks, nodes, _, _ = sample_graph(spark)
    pins = rank.symbol_pins(sample_questions(spark), rank.symbol_table(chunks, nodes))
    return pins.join(chunks.select("doc", "symbol"), "doc").select("qid", "pin", "symbol")


def sample_search(spark, **more):
    sources, chunks, nodes, edges, _ = sample_graph(spark)
    source = rank.corpus(chunks, nodes)
    return sources, chunks, nodes, edges, source, store.settle(rank.retrieve(source, sample_questions(spark), all_ranks=True, **more))


@gives("qid, pos, symbol, reason", samples.EXPANDED)
def graph_expand(spark):
    _, chunks, nodes, edges, _, ranked = sample_search(spark)
    more = graph.expand(sample_questions(spark), ranked, chunks, nodes, edges, k=2)
    return more.join(chunks.select("doc", "symbol"), "doc").select("qid", "pos", "symbol", "reason")


@gives("qid, node, hop, via, line", samples.IMPACT)
def impact_first_edges(spark):
    _, _, nodes, edges, _ = sample_graph(spark)
    asked = spark.createDataFrame([(0, "resolve_host")], "qid long, symbol string")
    found = graph.impact_edges(edges, nodes, graph.find(nodes, asked).select("qid", "id"))
    name = lambda c, to: nodes.select(F.col("id").alias(c), F.col("qual").alias(to))
    return found.join(name("id", "node"), "id").join(name("via", "via_name"), "via").select("qid", "node", "hop", F.col("via_name").alias("via"), "line")


@gives("message, clean", [(m, c) for m, c in samples.SECRETS])
def secret_scrub(spark):
    return spark.createDataFrame([(m,) for m, _ in samples.SECRETS], "message string").select("message", T.scrub_keys("message").alias("clean"))


@gives("qid, pos, rewrite", samples.REWRITES)
def parse_rewrites(spark):
    rows = spark.createDataFrame([(0, samples.REWRITE_ANSWER)], "qid long, text string")
    return rows.select("qid", F.posexplode(T.rewrites("text")).alias("pos", "rewrite"))


@gives("line_no, line", samples.NOTEBOOK_LINES)
def notebook_view(spark):
    rows = spark.createDataFrame([(samples.NOTEBOOK,)], "raw string").select(F.posexplode(T.lines(files.notebook_text("raw"))).alias("i", "line"))
    return rows.select((F.col("i") + 1).alias("line_no"), "line")


def sample_answers(spark):
    shown = spark.createDataFrame(samples.SHOWN, "qid long, pos int, path string, start_line long, end_line long, text string, symbol string")
    return spark.createDataFrame(samples.ANSWERS, "qid long, text string"), shown


@gives("qid, path, first, last", samples.CITED)
def citation_parse(spark):
    answers, _ = sample_answers(spark)
    return answers.select("qid", F.explode(T.citations(T.normalize_citations("text"))).alias("c")).select("qid", "c.*")


_REPORT = ["qid", "n_citations", "invalid", "n_claims", "cited_claims", "unsupported", "uncited", "broad", "refusal", "penalty", "ok"]


@gives(", ".join(_REPORT), samples.REPORTS)
def citation_strict(spark):
    reports = cite.check_answers(*sample_answers(spark))
    joined = {c: F.array_join(c, "; ") for c in ("invalid", "unsupported", "uncited", "broad")}
    return reports.withColumns(joined).select(*_REPORT)


@gives("qid, n_citations, invalid", samples.RANGES)
def citation_ranges(spark):
    return cite.check_ranges(*sample_answers(spark)).select("qid", "n_citations", F.array_join("invalid", "; ").alias("invalid"))


@gives("qid, repaired", samples.REPAIRED)
def repair_choice(spark):
    drafts, shown = sample_answers(spark)
    revisions = spark.createDataFrame(samples.REVISIONS, "qid long, text string")
    return cite.choose_repairs(cite.check_answers(drafts, shown), cite.check_answers(revisions, shown))


@gives("type, n, mean_added, topk_recall, topk_all, baseline_recall, baseline_all, expand_recall, expand_all", samples.TRACE)
def trace_eval(spark):
    _, chunks, nodes, edges, source, ranked = sample_search(spark)
    gold = spark.createDataFrame(samples.TRACE_GOLD, "qid long, type string, targets array<struct<path:string,line:int>>")
    k = 2
    hits = ranked.filter(F.col("pos") <= k).select("qid", "doc")
    more = graph.expand(sample_questions(spark), ranked, chunks, nodes, edges, k=k).select("qid", "doc")
    size = more.groupBy("qid").agg(F.count("*").alias("n"))
    base = ranked.join(size, "qid", "left").filter(F.col("pos") <= k + F.coalesce("n", F.lit(0))).select("qid", "doc")
    return evaluate.trace_metrics(gold, chunks, hits, base, hits.unionByName(more))


@gives("n, gold_cited, valid_rate, claims_cited, unsupported_per_answer, mean_width, repaired", samples.ANSWER_METRICS)
def answer_eval(spark):
    answers, shown = sample_answers(spark)
    gold = spark.createDataFrame(samples.ANSWER_GOLD, "qid long, type string, targets array<struct<path:string,line:int>>")
    return evaluate.answer_metrics(gold, answers.withColumn("repaired", F.col("qid") == 1), cite.check_answers(answers, shown))


@gives("qid, problem", samples.GOLD_PROBLEMS)
def gold_validation(spark):
    gold = spark.createDataFrame(samples.GOLD_TO_CHECK, "qid long, type string, targets array<struct<path:string,line:int>>")
    return evaluate.validate_gold(gold, spark.createDataFrame(samples.FILES, "path string, text string"))


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(CASES))
def test_sample(spark, name):
    function, columns, rows = CASES[name]
    got = [tuple(plain(v) for v in r) for r in function(spark).select(*columns.split(", ")).collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(plain(v) for v in r)) for r in rows)

"""``python -m lodestar``: the engine from a command line. Settings come from LODESTAR_<NAME> and from options."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import engine, models, prompts
from .sources import files, store

KINDS = ("retrieval", "trace", "answers")


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestar", description="Search source code, answer questions about it and evaluate both.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *words: str, index: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about)
        if index:
            c.add_argument("folder", help="folder of the index")
        for word in words:
            c.add_argument(word, nargs="+" if word in ("question", "symbol") else None)
        c.add_argument("-k", type=int, dest="top_k", help="hits a question")
        c.add_argument("-m", dest="mode", choices=("dense", "bm25", "hybrid"))
        c.add_argument("--rerank", action="store_const", const=True)
        return c

    c = command("index", "index a source tree", "tree")
    c.add_argument("-x", dest="exclude", action="append", metavar="GLOB")
    c.add_argument("-c", dest="chunker", choices=("syntax", "fixed"))
    c.add_argument("--model", help="hashing-<dimensions> or the path of a sentence encoder")
    c.add_argument("--fresh", action="store_true", help="use no vectors of the index that is there")
    command("search", "the best chunks for a question", "question")
    for name, about in (("ask", "an answer with checked citations"), ("eval-answers", "citations of answers to a gold set")):
        c = command(name, about, "question" if name == "ask" else "gold")
        c.add_argument("--url", default=os.environ.get("LODESTAR_URL"), help="address of the language model")
        c.add_argument("--llm", default=os.environ.get("LODESTAR_LLM", ""), help="its name")
        c.add_argument("--provider", default="openai", choices=("openai", "ollama"))
        c.add_argument("--log", help="folder of the run log")
        c.add_argument("--save", metavar="RESULTS")
        c.add_argument("-n", type=int, help="the first questions alone")
    c = command("eval", "recall of a gold set; of its targets where a question has several", "gold")
    c.add_argument("--save", metavar="RESULTS")
    c.add_argument("--label", default="")
    for name, about in (("callers", "what calls a symbol"), ("callees", "what a symbol calls"), ("impact", "what depends on a symbol"), ("show", "a symbol with its callers, callees and reach")):
        command(name, about, "symbol").add_argument("-d", dest="depth", type=int)
    command("check-gold", "targets of a gold set that are missing or blank", "gold")
    command("report", "stored results", "results", index=False).add_argument("--gold", dest="gold_set")
    command("indexes", "the indexes in a folder", "root", index=False)
    command("prompts", "the prompts and their hashes", index=False)
    return top


def _settings(given: argparse.Namespace) -> engine.Settings:
    named = {n: v for n in ("top_k", "mode", "rerank", "chunker", "model") if (v := getattr(given, n, None)) is not None}
    if getattr(given, "exclude", None):
        named["exclude"] = tuple(given.exclude)
    return engine.Settings.from_environment(**named)


def _ask(spark: SparkSession, words: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(0, " ".join(words))], f"qid long, {name} string")


def run(spark: SparkSession, arguments: list[str], show=lambda df: df.show(50, 100)) -> int:
    """One command; tables go to ``show``."""
    given = _arguments().parse_args(arguments)
    settings = _settings(given)
    name = given.command
    if name == "prompts":
        show(spark.createDataFrame([(p, prompts.load(p).hash) for p in prompts.names()], "prompt string, hash string"))
        return 0
    if name == "indexes":
        show(store.workspace(spark, given.root))
        return 0
    if name == "report":
        for table in engine.report(files.read_results(spark, given.results), given.gold_set).values():
            show(table)
        return 0
    if name == "index":
        try:
            previous = None if given.fresh else engine.Index.load(spark, given.folder)
        except FileNotFoundError:
            previous = None
        index = engine.index_tree(spark, given.tree, settings, previous)
        index.save(given.folder, settings)
        show(index.stats.withColumn("reused", F.lit(index.reused)))
        return 0
    index = engine.Index.load(spark, given.folder)
    chunks = index.chunks.select("doc", "path", "start_line", "end_line", "kind", "symbol")
    if name == "search":
        hits = engine.search(index, engine.askable(_ask(spark, given.question, "text")), settings)
        show(hits.join(chunks, "doc").orderBy("pos").select("pos", "score", "path", "start_line", "end_line", "kind", "symbol"))
    elif name in ("ask", "eval-answers"):
        if not given.url:
            print("name a language model: --url and --llm, or LODESTAR_URL and LODESTAR_LLM", file=sys.stderr)
            return 2
        model = models.generator(models.Model(given.url, given.llm, given.provider, os.environ.get("LODESTAR_KEY", "")), show)
        if name == "ask":
            answers = engine.answer(index, _ask(spark, given.question, "text"), model, settings)
            show(answers.select("text", "repaired", "report.n_citations", "report.invalid", "report.unsupported", "report.uncited", "t_total"))
            if given.log:
                engine.run_log(answers, settings, given.log)
        else:
            gold = files.read_gold(spark, given.gold)
            metrics = engine.evaluate_answers(index, gold.orderBy("qid").limit(given.n) if given.n else gold, model, settings)
            _keep(metrics, "answers", given, settings, show)
    elif name == "eval":
        gold = files.read_gold(spark, given.gold)
        kind = "trace" if engine.evaluate.is_trace(gold) else "retrieval"
        _keep(engine.evaluate_any(index, gold, settings), kind, given, settings, show)
    elif name == "check-gold":
        problems = engine.evaluate.validate_gold(files.read_gold(spark, given.gold), index.sources)
        show(problems)
        return int(not problems.isEmpty())
    else:
        symbols = _ask(spark, given.symbol, "symbol")
        tables = {"callers": engine.who_calls, "callees": engine.calls_of}
        if name in tables:
            show(tables[name](index, symbols))
        else:
            show((engine.impact_of if name == "impact" else engine.graph_view)(index, symbols, given.depth))
    return 0


def _keep(metrics: DataFrame, kind: str, given: argparse.Namespace, settings: engine.Settings, show) -> None:
    metrics = store.settle(metrics)
    show(metrics)
    if given.save:
        engine.keep_results(engine.result_rows(metrics, kind, given.gold, settings, getattr(given, "label", "")), given.save)


def main() -> None:
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()

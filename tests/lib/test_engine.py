"""Index, search, answers and stores end to end on the sample sources."""

import pytest
import samples
from pyspark.sql import functions as F

from lodestar.operators import chunk, context, dense, evaluate, graph, lexical, rank, scan, syntax
from lodestar.plans import engine, prompts
from lodestar.sources import files, store
from lodestar.streaming import logs


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in [*samples.FILES, (".venv/junk.py", "x = 1"), ("nb.ipynb", samples.NOTEBOOK), ("bad.ipynb", "{no"), ("notes.txt", "x"), ("tests/test_a.py", "def test(): pass")]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "latin.py").write_bytes(b"x = '\xe9'")
    return str(root)


@pytest.fixture(scope="module")
def index(spark, tree):
    return engine.index_tree(spark, tree, engine.Settings(exclude=("tests/*",)))


def test_tree(spark, tree):
    got = [r.path for r in files.read_tree(spark, tree, ["tests/*"]).orderBy("file_ord").collect()]
    assert got == ["app.py", "nb.ipynb", "pkg/base.py", "pkg/net.py"]


def test_fixed_windows(spark):
    rows = spark.createDataFrame([("a", "step\n" * 97), ("b", ""), ("c", "\n \n"), ("d", None), ("e", "one")], "path string, text string")
    got = sorted((r.path, r.start_line, r.end_line) for r in chunk.fixed_windows(rows, 40, 10).collect())
    assert got == [("a", 1, 40), ("a", 31, 70), ("a", 61, 97), ("e", 1, 1)]
    with pytest.raises(ValueError, match="overlap"):
        chunk.fixed_windows(rows, 5, 5)


def parse(spark, text, **more):
    rows = spark.createDataFrame([("m.py", "0m.py", text)], "path string, file_ord string, text string")
    parsed = syntax.parse_files(rows, **more)
    return [(r.start_line, r.end_line, r.symbol, r.kind, r.parent, r.context) for r in syntax.chunk_files(rows, parsed).orderBy("chunk_no").collect()]


def test_big_class_is_a_header_and_linked_methods(spark):
    verbs = ["open", "read", "seek", "write", "flush", "close"]
    method = lambda v: f"\n    async def {v}_all(self, *items):\n        for item in items:\n" + "            await item\n" * 7
    text = "class Store(dict):\n    size: int = 1 << 20\n" + "".join(map(method, verbs))
    got = parse(spark, text, max_lines=30)
    assert got[0][2:5] == ("Store", "class_header", "") and got[0][5] == "# methods: " + ", ".join(f"{v}_all" for v in verbs)
    assert [g[2:5] for g in got[1:]] == [(f"Store.{v}_all", "method", "Store") for v in verbs]


def test_long_function_is_split_between_statements(spark):
    text = "def report(rows):\n" + "".join(f"    with section({i}):\n        rows.send({i})\n" for i in range(20)) + "    return rows\n"
    got = parse(spark, text, max_lines=16)
    assert [g[:2] for g in got] == [(1, 15), (16, 31), (32, 42)] and {g[3] for g in got} == {"function_part"}
    assert [g[5] for g in got] == ["", "# part 2 of 3", "# part 3 of 3"]


def test_overloads_comments_and_groups(spark):
    text = "import x\n\n\n# why\n@overload\ndef f(a: int): ...\n@overload\ndef f(a: str): ...\ndef f(a):\n    return a\n\n\ndef g():\n    pass\n\n\n# only a comment\n"
    # the stubs join the definition, which is seven lines long with them and the comment
    assert parse(spark, text) == [(1, 1, "m", "module", "", ""), (4, 10, "f", "function", "", ""), (13, 14, "g", "function", "", "")]


def test_source_that_does_not_parse_becomes_windows(spark):
    assert [g[:4] for g in parse(spark, "def (:\n  x\n")] == [(1, 2, "", "window")]


def test_faults_cost_only_their_statement(spark):
    text = "x = 1\n\n\ndef f():\n    return (\n\n\nclass A:\n    def g(self):\n        y = = 2\n        return y\n\n    def h(self):\n        return f()\n\n\nprint 'old'\n"
    rows = [(1, 1, "m", "module"), (4, 5, "f", "function"), (8, 14, "A", "class"), (17, 17, "m", "module")]
    assert [(g[0], g[1], g[2], g[3]) for g in parse(spark, text)] == rows
    files = spark.createDataFrame([("m.py", "0m.py", text)], "path string, file_ord string, text string")
    defs = syntax.parse_files(files).selectExpr("inline(defs)").select("qual").collect()
    assert [r.qual for r in defs] == ["m", "f", "A", "A.g", "A.h"]


def test_many_faults_are_read_in_linear_time():
    import time

    began = time.time()
    assert syntax.parsed_as_far_as_possible("print 'x' 'y' z\n" * 20_000 + "def f(): pass\n").body[-1].name == "f"
    assert time.time() - began < 60


def test_units_cover_a_file_like_a_plain_reading(spark):
    """Every line with code lies in a unit, and units of definitions begin with their comments and stubs."""
    import inspect

    from lodestar.functions import text as module

    source = inspect.getsource(module)
    lines = source.split("\n")
    rows = syntax.syntax_chunks(__import__("ast").parse(source), lines, "m", 40, 6)
    held = {i for a, b, *_ in rows for i in range(a, b + 1)}
    assert all(not x.strip() or x.lstrip().startswith("#") or i in held for i, x in enumerate(lines, 1))


def test_rrf_example(spark):
    rows = spark.createDataFrame([(0, 0, d, r) for r, d in enumerate([1, 2, 3], 1)] + [(0, 1, d, r) for r, d in enumerate([3, 1, 2], 1)], "qid long, list_no int, doc long, rank int")
    got = rank.rrf(rows).orderBy("rank").collect()
    assert [r.doc for r in got] == [1, 3, 2] and abs(got[0].score - (1 / 61 + 1 / 62)) < 1e-9


def test_search_and_modes(spark, index):
    asked = spark.createDataFrame([(0, "resolve_host before the link address")], "qid long, text string")
    hits = engine.search(index, asked).orderBy("pos").collect()
    assert hits[0].detail.symbol and [h.pos for h in hits] == list(range(1, len(hits) + 1))
    assert hits[0].score == pytest.approx(hits[1].score + 1)
    dense_only = engine.search(index, asked, engine.Settings(mode="dense")).orderBy("pos").collect()
    assert not any(h.detail.symbol for h in dense_only) and all(h.detail.bm25 is None for h in dense_only)
    reranked = engine.search(index, asked, engine.Settings(rerank=True)).collect()
    assert any(h.detail.rerank == 1 for h in reranked)
    with pytest.raises(ValueError, match="unknown"):
        engine.search(index, asked, engine.Settings(mode="none"))
    words = rank.corpus(index.chunks, with_dense=False)
    with pytest.raises(RuntimeError, match="vectors"):
        rank.retrieve(words, asked)


def test_rewrites_add_hits(spark, index):
    asked = spark.createDataFrame([(0, "zzz unknown words")], "qid long, text string")
    more = spark.createDataFrame([(0, 0, "look a host up")], "qid long, pos int, text string")
    settings = engine.Settings(mode="bm25")
    assert engine.search(index, asked, settings).count() == 0
    assert engine.search(index, asked, settings, more).count() > 0


def test_answer_with_repair(spark, index, tmp_path):
    asked = spark.createDataFrame([(0, "What calls resolve_host?"), (1, "How is a link opened?")], "qid long, text string")
    drafts = spark.createDataFrame([(0, "`resolve_host` is called by `connect` 【pkg/net.py:14-15】."), (1, "It uses `open_link` [no.py:1-2].")], "qid long, text string")
    fixes = spark.createDataFrame([(1, "It uses `open_link` [pkg/net.py:18-19].")], "qid long, text string")
    got = {r.qid: r for r in engine.answer(index, asked, engine.canned(drafts), repairer=engine.canned(fixes)).collect()}
    assert got[0].report.ok and not got[0].repaired and "[pkg/net.py:14-15]" in got[0].text
    assert got[0].t_total >= got[0].t_retrieve > 0 and got[0].prompt_id == "answer_v1" and len(got[0].prompt_hash) == 10
    engine.run_log(engine.answer(index, asked, engine.canned(drafts), repairer=engine.canned(fixes)), engine.Settings(), f"{tmp_path}/log")
    logged = spark.read.schema(logs.RUN_SCHEMA).json(f"{tmp_path}/log")
    row = logs.run_metrics(logged).first()
    assert (row.n, row.repaired) == (2, 1) and row.mean_s > 0 and logged.filter("n_used > 0 and prompt_hash is not null").count() == 2
    assert got[1].repaired and got[1].report.ok and not got[1].draft_report.ok and got[1].draft_report.invalid == ["no.py:1-2"]


def test_events_follow_an_answer(spark, index):
    asked = spark.createDataFrame([(0, "What calls resolve_host?")], "qid long, text string")
    drafts = spark.createDataFrame([(0, "Nothing.")], "qid long, text string")
    rows = engine.answer(index, asked, engine.canned(drafts), repairer=engine.canned(drafts.filter("1 = 0")))
    assert [r.event for r in engine.events(rows).orderBy("seq").collect()] == ["sources", "draft", "repair", "done"]


def test_graph_questions(spark, index):
    asked = spark.createDataFrame([(0, "connect")], "qid long, symbol string")
    assert [(r.qual, r.line) for r in engine.who_calls(index, asked).collect()] == [("main", 7), ("Link.dial", 28)]
    assert {r.qual for r in engine.calls_of(index, asked).collect()} == {"open_link", "resolve_host"}
    assert [(r.qual, r.hop) for r in engine.impact_of(index, asked).collect()] == [("main", 1), ("Link.dial", 1), ("app", 2)]
    first = engine.suggested_questions(index, 2).orderBy("pos").collect()
    assert [r.pos for r in first] == [0, 1, 2, 3, 4] and first[1].text.startswith("How does `") and first[2].text.startswith("Who calls `")
    assert engine.suggested_questions(engine.replace(index, edges=None)).count() == 1


def test_expansion_follows_the_question(spark, index):
    asked = spark.createDataFrame([(0, "What calls resolve_host?")], "qid long, text string")
    rows = engine.gather(index, asked, engine.Settings(top_k=1)).orderBy("pos").join(index.chunks.select("doc", "symbol"), "doc").collect()
    assert {r.reason for r in rows if r.pos > 1} == {"main calls connect (line 7)", "Link.dial calls connect (line 28)"}


def test_save_and_load(spark, index, tmp_path):
    index.save(f"{tmp_path}/i", engine.Settings())
    again = engine.Index.load(spark, f"{tmp_path}/i")
    assert again.chunks.count() == index.chunks.count() and again.edges.count() == index.edges.count()
    with pytest.raises(FileNotFoundError):
        engine.Index.load(spark, f"{tmp_path}/none")


def test_a_loaded_index_can_be_saved_over_itself(spark, index, tmp_path):
    folder, settings = f"{tmp_path}/i", engine.Settings()
    index.save(folder, settings)
    for _ in range(3):
        engine.Index.load(spark, folder).save(folder, settings)
    again = engine.Index.load(spark, folder)
    asked = spark.createDataFrame([(0, "resolve_host before the link address")], "qid long, text string")
    assert [tuple(r) for r in engine.search(again, asked).collect()] == [tuple(r) for r in engine.search(index, asked).collect()]
    assert len(list((tmp_path / "i" / "versions").iterdir())) == 2
    with pytest.raises(ValueError, match="hashing-1024"):
        engine.Index.load(spark, folder, dense.hashing(64))


def test_a_save_that_fails_leaves_the_older_index(spark, index, tmp_path):
    folder = f"{tmp_path}/i"
    index.save(folder, engine.Settings())
    broken = index.chunks.withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.save_index(folder, {"model": "x"}, sources=index.sources, chunks=broken)
    assert engine.Index.load(spark, folder).chunks.count() == index.chunks.count()


def test_only_changed_chunks_are_embedded_again(spark, tmp_path):
    plain, seen = dense.hashing(64), []

    def counting(rows, key):
        seen.append(rows.count())
        return plain.documents(rows, key)

    counted = dense.Embedder("hashing-64", counting, plain.questions)
    files_of = lambda edit: spark.createDataFrame([(f"f{i}.py", f"{i}", f"def name{i}():\n    return {i}\n" + (edit if i == 3 else "")) for i in range(6)], "path string, file_ord string, text string")
    settings = engine.Settings(model="hashing-64")
    first = engine.build_index(files_of(""), settings, embedder=counted)
    first.save(f"{tmp_path}/i", settings)
    loaded = engine.Index.load(spark, f"{tmp_path}/i")
    again = engine.build_index(files_of("\n\ndef more():\n    return name1()\n"), settings, loaded, counted)
    assert seen == [6, 1] and again.reused == 6 - 1 + (again.chunks.count() - 6) * 0
    other = engine.build_index(files_of(""), settings, again, dense.Embedder("hashing-64b", counting, plain.questions))
    assert other.reused == 0 and seen == [6, 1, 6]
    plainly = dense.hashing_entries(rank.embedded(again.chunks).select("doc", F.col("embedded").alias("text")), "doc", 64)
    assert sorted(map(tuple, again.corpus.entries.collect())) == sorted(map(tuple, plainly.collect()))


def test_workspace(spark, index, tmp_path):
    for name in ("one", "One"):
        index.save(f"{tmp_path}/{name}", engine.Settings())
    (tmp_path / "half").mkdir()
    rows = store.workspace(spark, str(tmp_path)).orderBy("folder").collect()
    assert [(r.id, r.name, r.model) for r in rows] == [("one", "One", "hashing-1024"), ("one-2", "one", "hashing-1024")] and rows[0].n_chunks == index.chunks.count()


def test_metrics(spark, index):
    gold = spark.createDataFrame([(0, "resolve_host", "name", [("pkg/net.py", 9)]), (1, "zzzz", "other", [("app.py", 4)])], "qid long, question string, type string, targets array<struct<path:string,line:int>>")
    got = {r.type: r for r in engine.evaluate_any(index, gold, engine.Settings(mode="bm25")).collect()}
    assert got["name"].hit1 == 1.0 and got["other"].recall == 0.0 and got[evaluate.ALL].n == 2 and got[evaluate.ALL].mrr == 0.5
    trace = spark.createDataFrame([(0, "What calls resolve_host?", "callers", [("app.py", 7), ("pkg/net.py", 28)])], "qid long, question string, type string, targets array<struct<path:string,line:int>>")
    row = engine.evaluate_any(index, trace, engine.Settings(top_k=1)).filter(F.col("type") == evaluate.ALL).first()
    assert row.expand_recall == 1.0 and row.topk_recall == 0.0


def test_gold_file(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('// note\n\n{"question": "a", "path": "p", "line": 3}\n{"question": "b", "type": "t", "targets": [{"path": "q", "line": 1}]}\n')
    got = sorted((r.question, r.type, [tuple(t) for t in r.targets]) for r in files.read_gold(spark, str(tmp_path / "g.jsonl")).collect())
    assert got == [("a", "semantic", [("p", 3)]), ("b", "t", [("q", 1)])]


def test_equal_gold_lines_are_questions_of_their_own(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"question": "a", "path": "p", "line": 3}\n' * 3)
    assert len({r.qid for r in files.read_gold(spark, str(tmp_path / "g.jsonl")).collect()}) == 3


def test_results_are_kept_and_reported(spark, index, tmp_path):
    gold = spark.createDataFrame([(0, "resolve_host", "name", [("pkg/net.py", 9)]), (1, "zzzz", "other", [("app.py", 4)])], "qid long, question string, type string, targets array<struct<path:string,line:int>>")
    settings = engine.Settings(mode="bm25", top_k=2)
    engine.keep_results(engine.result_rows(engine.evaluate_any(index, gold, settings), "retrieval", "eval/a.jsonl", settings, "first"), f"{tmp_path}/r")
    trace = gold.withColumn("targets", F.concat("targets", "targets")).withColumn("question", F.lit("What calls resolve_host?"))
    engine.keep_results(engine.result_rows(engine.evaluate_any(index, trace, settings), "trace", "eval/b.jsonl", settings), f"{tmp_path}/r")
    answers = engine.canned(spark.createDataFrame([(0, "`resolve_host` looks it up [pkg/net.py:9-11]."), (1, "Nothing.")], "qid long, text string"))
    engine.keep_results(engine.result_rows(engine.evaluate_answers(index, gold, answers, settings), "answers", "eval/a.jsonl", settings), f"{tmp_path}/r")
    tables = engine.report(files.read_results(spark, f"{tmp_path}/r"))
    kept = tables["retrieval"].first()
    assert (kept.label, kept.k, kept["mode"], kept.n, kept.recall) == ("first", 2, "bm25", 2, 0.5) and '"name":{"n":1' in kept.by_type
    assert [r.variant for r in tables["trace"].collect()] == ["baseline", "expand", "topk"]
    assert tables["answers"].first().gold_cited == 0.5 and tables["answers"].first().n == 2
    assert engine.report(files.read_results(spark, f"{tmp_path}/r"), "b")["retrieval"].count() == 0


def test_a_model_behind_an_address(spark):
    """Both wire formats, a request that is put off, one that fails, and a key that does not leak."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from lodestar.plans import models

    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            user = body["messages"][1]["content"]
            seen.append((self.path, user))
            if user == "later" and seen.count((self.path, user)) == 1:
                self.send_response(429)
                self.send_header("Retry-After", "0.1s")
                self.end_headers()
                return
            if user == "bad":
                self.send_response(400)
                self.end_headers()
                self.wfile.write(b"wrong key sk-abcdefgh12345 or secret-key")
                return
            self.send_response(200)
            self.end_headers()
            for word in ("re: ", user):
                chat = {"message": {"content": word}} if self.path == "/api/chat" else {"choices": [{"delta": {"content": word}}]}
                self.wfile.write((json.dumps(chat) if self.path == "/api/chat" else "data: " + json.dumps(chat)).encode() + b"\n\n")
            self.wfile.write(b"" if self.path == "/api/chat" else b"data: [DONE]\n")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        rows = spark.createDataFrame([(0, "s", "now"), (1, "s", "later"), (2, "s", "bad")], "qid long, system string, user string")
        for provider in ("openai", "ollama"):
            seen.clear()
            lost = []
            ask = models.generator(models.Model(url, "m", provider, "secret-key", tasks=2), lambda f: lost.extend(f.collect()))
            assert {r.qid: r.text for r in ask(rows).collect()} == {0: "re: now", 1: "re: later"}
            assert [(r.qid, r.status) for r in lost] == [(2, 400)] and "secret" not in lost[0].message and "sk-" not in lost[0].message
            assert len(seen) == 4
        gone = models.generator(models.Model("http://127.0.0.1:1", "m", seconds=1), lambda f: lost.extend(f.collect()))
        assert gone(rows).count() == 0 and lost[-1].status == 0
    finally:
        server.shutdown()


def test_command_line(spark, tree, tmp_path, capsys):
    from lodestar.__main__ import run

    tables = []
    call = lambda *words: run(spark, [*map(str, words)], lambda df: tables.append(df.collect()))
    folder = tmp_path / "i"
    assert call("index", folder, tree, "-x", "tests/*") == 0 and tables[-1][0].reused == 0
    assert call("index", folder, tree, "-x", "tests/*") == 0 and tables[-1][0].reused == tables[-1][0].n_chunks
    call("search", folder, "where", "is", "resolve_host", "-k", "2")
    assert 1 <= len(tables[-1]) <= 2 and tables[-1][0].path == "pkg/net.py"
    call("callers", folder, "connect")
    assert [r.qual for r in tables[-1]] == ["main", "Link.dial"]
    call("impact", folder, "connect", "-d", "1")
    assert {r.qual for r in tables[-1]} == {"main", "Link.dial"}
    call("show", folder, "reset")
    assert [(r.qual, r.n_nodes) for r in tables[-1]] == [("Root.reset", 4), ("Base.reset", 0)]
    call("show", folder, "resolv_host")
    assert tables[-1][0].qual is None and tables[-1][0].similar == ["resolve_host"]
    (tmp_path / "g.jsonl").write_text('{"question": "resolve_host", "path": "pkg/net.py", "line": 9}\n')
    call("eval", folder, tmp_path / "g.jsonl", "--save", tmp_path / "r", "--label", "x")
    call("report", tmp_path / "r")
    assert tables[-3][0].label == "x" and tables[-2] == tables[-1] == []
    assert call("check-gold", folder, tmp_path / "g.jsonl") == 0
    call("indexes", tmp_path)
    assert tables[-1][0].name == "i"
    call("prompts")
    assert {"answer_v1", "answer_v4", "repair_v1"} <= {r.prompt for r in tables[-1]}
    assert call("ask", folder, "why") == 2


def test_questions_that_cannot_be_asked(spark, index):
    rows = spark.createDataFrame([(0, " where "), (1, " "), (2, None), (3, "x" * 1001)], "qid long, text string")
    assert [tuple(r) for r in engine.askable(rows).collect()] == [(0, "where")]
    many = engine.search(index, rows.limit(1), engine.Settings(top_k=500, mode="dense"))
    assert many.count() <= engine.MOST_HITS


def test_prompt_files(tmp_path):
    raw = "---\nid: p\n---\n[system]\nBe {kind}.\n\n[user]\nAsk\n{question}\n"
    (tmp_path / "p.md").write_text(raw)
    p = prompts.load("p", tmp_path)
    assert (p.system, p.user) == ("Be {kind}.", "Ask\n{question}") and prompts.parse("p", raw + " ").hash != p.hash
    with pytest.raises(ValueError, match="section"):
        prompts.parse("q", "[system]\nx")


def test_similar_names_equal_difflib(spark):
    import difflib
    import random

    draw = random.Random(3)
    names = sorted({"".join(draw.choice("abcde_") for _ in range(draw.randint(1, 9))) for _ in range(300)})
    asked = [draw.choice(names)[:-1] + draw.choice("xyab") for _ in range(60)] + ["a", "abc", "abcd", "zzzzz"]
    nodes = spark.createDataFrame([(n, "function") for n in names], "name string, kind string")
    got = {}
    for r in graph.similar(nodes, spark.createDataFrame(list(enumerate(asked)), "qid long, symbol string")).collect():
        got.setdefault(r.qid, {})[r.pos] = r.name
    for i, s in enumerate(asked):
        near = difflib.get_close_matches(s, names, 300, 0.6)
        inside = [n for n in names if n not in near and len(s) >= 4 and (s in n or n in s)]
        assert [got.get(i, {}).get(p) for p in range(1, 1 + len((near + inside)[:5]))] == (near + inside)[:5], s


def test_ancestry_of_a_deep_chain(spark):
    bases = spark.createDataFrame([(f"C{i}", 0, f"C{i + 1}") for i in range(40)], "qual string, n int, base string")
    classes = spark.createDataFrame([(f"C{i}", f"C{i}") for i in range(41)], "qual string, name string")
    got = [r.base for r in graph.ancestry(bases, classes).filter("qual = 'C0'").orderBy("pos").collect()]
    assert got == [f"C{i}" for i in range(1, 41)]


def test_greedy_fit_takes_the_first_and_skips(spark):
    fit = lambda costs: spark.range(1).select(context.greedy_fit(F.array(*map(F.lit, costs)).cast("array<long>"), 10).alias("v")).first().v
    assert fit([20, 5, 6]) == [1] and fit([4, 7, 6]) == [1, 3] and fit([10, 1]) == [1]


def test_line_numbers(spark):
    got = spark.range(1).select(context.with_line_numbers(F.lit("a\nb"), F.lit(99999)).alias("v")).first().v
    assert got == "99999| a\n100000| b"


def test_dense_search_with_more_queries_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 3)
    monkeypatch.setattr(scan, "ROWS", 4)
    rows = spark.createDataFrame([(i, [float(i % 5), float(i)]) for i in range(20)] + [(99, None), (98, [1.0])], "doc long, vec array<float>")
    got = dense.exact_top_k(rows, rows.filter("doc < 8").withColumnRenamed("doc", "qid"), 2).collect()
    assert len(got) == 16 and {r.doc for r in got if r["rank"] == 1 and r.qid == 7} == {19}
    named = rows.withColumn("doc", F.concat(F.lit("n"), F.lpad("doc", 2, "0")))
    asked = named.filter("doc < 'n08'").withColumnRenamed("doc", "qid")
    assert sorted((int(r.qid[1:]), int(r.doc[1:]), r["rank"], r.score) for r in dense.exact_top_k(named, asked, 2).collect()) == sorted((r.qid, r.doc, r["rank"], r.score) for r in got)


def test_tasks_keep_the_best_of_each_query(spark, monkeypatch):
    draw = __import__("numpy").random.default_rng(1)
    for _ in range(20):
        best = scan.Best(5, 3)
        best.limit = 7
        scores = draw.integers(0, 6, size=(40, 5)).astype(float)
        scores[draw.random((40, 5)) < 0.3] = -float("inf")
        for at in range(0, 40, 6):
            best.add(draw.permutation(40)[:0], scores[:0])
            best.add(__import__("numpy").arange(at, min(at + 6, 40)), scores[at : at + 6])
        got = sorted(zip(*(x.tolist() for x in best.reduce()), strict=True))
        want = sorted((q, d, scores[d, q]) for q in range(5) for d in sorted((d for d in range(40) if scores[d, q] >= 0), key=lambda d, q=q: (-scores[d, q], d))[:3])
        assert got == want


def test_passages_in_texts(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 2)
    passages = spark.createDataFrame([(0, "b c"), (1, "é"), (2, ""), (3, None), (4, "b c"), (5, "abc")], "qid long, text string")
    texts = spark.createDataFrame([("x", "a b c d"), ("y", "café b c"), ("z", None), ("w", "ab c")], "doc string, text string")
    want = {(0, "x"), (4, "x"), (0, "y"), (4, "y"), (1, "y"), (0, "w"), (4, "w")}
    assert {tuple(r) for r in scan.sharing(passages, texts).collect()} == want
    for find in (scan.finder(["b c", "é", "b c"]),):
        assert find("xb cé") == {0, 1, 2} and find("none") == set()


def test_words_of_tables_equal_the_column_functions(spark):
    from lodestar.functions import text as T
    from lodestar.functions import words

    odd = [("HTTPServer parseURLs __init__ x1Y2 caches decoding Used classes _ a A9b snake_case_Names", "MyClass.run"), (None, None), ("", ""), ("é ties flies ing's being", "x")]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(odd)], "doc long, text string, symbol string")
    rows = rows.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 100).alias("doc"), "text", F.lit("parseURL_of").alias("symbol")))
    tokens = F.concat(T.tokens("text"), F.flatten(F.array_repeat(T.tokens("symbol"), 3)))
    want = {r.doc: sorted(r.t) for r in rows.select("doc", tokens.alias("t")).collect()}
    got = {r.doc: (r.dl, [t.term for t in r.terms for _ in range(t.tf)]) for r in lexical.documents_terms(rows).collect()}
    assert got == {d: (len(t), t) for d, t in want.items()}
    plain = {r.doc: sorted(r.t) for r in rows.select("doc", T.hashing_tokens("text").alias("t")).collect()}
    for r in rows.collect():
        found = words.counts(r.text, words.Memo(words.hashing_tokens))
        assert sorted(found.elements()) == plain[r.doc]


def test_ancestry_survives_cycles(spark):
    bases = spark.createDataFrame([("A", 0, "B"), ("B", 0, "A"), ("B", 1, "C")], "qual string, n int, base string")
    classes = spark.createDataFrame([("A", "A"), ("B", "B")], "qual string, name string")
    got = sorted((r.qual, r.pos, r.base) for r in graph.ancestry(bases, classes).collect())
    assert got == [("A", 1, "B"), ("A", 2, "A"), ("A", 3, "C"), ("B", 1, "A"), ("B", 2, "C"), ("B", 3, "B")]


def test_catalog_names(spark):
    rows = spark.createDataFrame([("A b", "x"), ("a-b", "y"), ("c", "z")], "name string, folder string")
    assert sorted(r.id for r in store.catalog(rows).collect()) == ["a-b", "a-b-2", "c"]


def test_cache_asks_only_what_is_missing(spark):
    requests = prompts.requests(spark.createDataFrame([(0, "a"), (1, "b")], "qid long, text string"), "rewrite_v1", question=F.col("text"))
    seen = []

    def generator(rows):
        seen.append(sorted(r.qid for r in rows.collect()))
        return rows.select("qid", F.upper("user").alias("text"))

    none = spark.createDataFrame([], "key string, text string")
    first, new = engine.cached(generator, none, "m")(requests)
    second, more = engine.cached(generator, new, "m")(requests)
    assert first.count() == second.count() == 2 and seen == [[0, 1], []] and more.count() == 0


def test_unknown_prompt():
    with pytest.raises(KeyError, match="answer_v1"):
        prompts.load("none")


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("LODESTAR_TOP_K", "3")
    monkeypatch.setenv("LODESTAR_RERANK", "true")
    monkeypatch.setenv("LODESTAR_EXCLUDE", "a,b")
    s = engine.Settings.from_environment(mode="bm25")
    assert (s.top_k, s.rerank, s.exclude, s.mode) == (3, True, ("a", "b"), "bm25")


def test_run_log_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m", 2, False, 1.0), (2, "m", 0, True, 3.0)], "qid long, model string, n_citations int, repaired boolean, t_total double")
    store.append_log(rows, f"{tmp_path}/log")
    query = logs.follow(logs.read_runs(spark, f"{tmp_path}/log"), "runs_seen", f"{tmp_path}/c")
    query.processAllAvailable()
    store.append_log(rows.limit(1), f"{tmp_path}/log")
    query.processAllAvailable()
    query.stop()
    row = spark.sql("select * from runs_seen").first()
    assert (row.n, row.repaired, row.model) == (3, 1, "m")


def test_stream_embeds_each_chunk_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    rows.write.json(f"{tmp_path}/in")
    embed = lambda df: df.withColumn("vec", F.array(F.length("text").cast("float")))
    for more in (None, [("b", "y"), ("c", "z")]):
        if more:
            spark.createDataFrame(more, "id string, text string").write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema("id string, text string").json(f"{tmp_path}/in")
        logs.keep_vectors(stream, f"{tmp_path}/out", embed, f"{tmp_path}/c", "m").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_another_embedder(spark, index):
    """Vectors of any model: here the numbers of three letters."""

    def letters(rows, key):
        count = lambda c: F.length(F.regexp_replace(F.lower("text"), f"[^{c}]", "")).cast("double")
        return dense.vector_entries(rows.select(key, F.array(*map(count, "aol")).alias("vec")), key)

    source = rank.corpus(index.chunks, embedder=dense.Embedder("letters", letters, letters))
    asked = spark.createDataFrame([(0, "all")], "qid long, text string")
    rows = rank.retrieve(source, asked, mode="dense").join(source.chunks.select("doc", F.col("embedded").alias("text")), "doc").orderBy("pos").collect()
    share = lambda t: (t.lower().count("a") + 2 * t.lower().count("l")) / max(1e-9, sum(t.lower().count(c) ** 2 for c in "aol") ** 0.5)
    assert [round(share(r.text), 6) for r in rows] == sorted((round(share(r.text), 6) for r in rows), reverse=True)


def test_percentiles_by_selection(spark):
    rows = spark.range(5000).selectExpr("id % 3 as g", "double((id * 7919) % 501) as v").unionByName(spark.createDataFrame([(0, None), (9, 1.5)], "g long, v double"))
    want = {}
    for r in rows.filter("v is not null").collect():
        want.setdefault(r.g, []).append(r.v)
    for accuracy in (100, 10_000):
        got = {r.g: (r.n, r.p50, r.p95) for r in evaluate.latency(rows, "v", ["g"], accuracy).collect()}
        assert got == {g: (len(v), sorted(v)[len(v) // 2], sorted(v)[min(len(v) - 1, int(0.95 * len(v)))]) for g, v in want.items()}


def test_resolution_rules(spark):
    text = """
from other import helper, Twice
class Twice:
    pass
class A:
    def run(self): helper(); self.get(); get(); thing.get(); A.run(); unknown()
    def get(self): return Twice()
class B(A):
    def go(self): self.run(); super().get(); cls.nothing()
def get(): pass
def outer():
    def inner(): outer()
    inner()
"""
    rows = spark.createDataFrame([("m.py", "0m.py", text), ("other.py", "0other.py", "def helper(): pass\nclass Twice: pass\n")], "path string, file_ord string, text string")
    index = engine.build_index(rows)
    name = lambda side: index.nodes.select(F.col("id").alias(side), F.concat("path", F.lit(":"), "qual").alias(f"{side}_name"))
    got = {(r.src_name[5:], r.dst_name, r.kind, r.how) for r in index.edges.join(name("src"), "src").join(name("dst"), "dst").collect()}
    assert got == {
        ("A.run", "other.py:helper", "call", "import"), ("A.run", "m.py:A.get", "call", "self"), ("A.run", "m.py:get", "call", "local"), ("A.get", "m.py:Twice", "instantiate", "local"),
        ("B", "m.py:A", "inherit", "local"), ("B.go", "m.py:A.run", "call", "base"), ("B.go", "m.py:A.get", "call", "base"),
        ("outer.inner", "m.py:outer", "call", "local"), ("outer", "m.py:outer.inner", "call", "local"),
    }

"""Answers that are told while the model still writes."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
import samples
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.plans import engine, live, models
from lodestar.sources import files

GO_ON = threading.Event()


class Server(BaseHTTPRequestHandler):
    """Writes one token, and the others when it is told to."""

    def do_POST(self):  # noqa: N802
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        repair = "cites" in asked["messages"][-1]["content"] and "draft" in asked["messages"][-1]["content"].lower()
        self.send_response(200)
        self.end_headers()
        tokens = ["`main` ", "starts it ", "[app.py:4-7]."] if repair else ["`main` ", "starts ", "it."]
        for i, token in enumerate(tokens):
            self.wfile.write(("data: " + json.dumps({"choices": [{"delta": {"content": token}}]}) + "\n\n").encode())
            self.wfile.flush()
            if not i:
                GO_ON.wait(60)
        self.wfile.write(b"data: [DONE]\n\n")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    held = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}"
    held.shutdown()


def test_the_first_token_is_told_before_the_answer_ends(spark, server, tmp_path):
    sources = spark.createDataFrame(samples.FILES, "path string, text string").withColumn("file_ord", files.walk_order(F.col("path")))
    settings = engine.Settings(mode="bm25")
    index = engine.build_index(sources, settings)
    questions = spark.createDataFrame([(0, "What does main do?"), (1, "Who calls connect?")], "qid long, text string")
    folder, got = f"file://{tmp_path}/live", {}

    def ask():
        got["answers"] = live.answer(index, questions, models.Model(server, "m", tasks=2), folder, settings).collect()

    GO_ON.clear()
    asking = threading.Thread(target=ask)
    asking.start()
    for _ in range(600):
        found = [json.loads(line) for f in (tmp_path / "live/token").glob("*.json") for line in f.read_text().splitlines()] if (tmp_path / "live/token").exists() else []
        if len(found) == 2 or not asking.is_alive():
            break
        asking.join(0.2)
    assert asking.is_alive() and [e["body"] for e in found] == ["`main` "] * 2
    told = {(r.qid, r.event) for r in live.read(spark, folder).collect()}
    assert told == {(q, e) for q in (0, 1) for e in ("sources", "token")}
    GO_ON.set()
    asking.join(120)
    assert {r.qid for r in got["answers"]} == {0, 1}
    for qid in (0, 1):
        rows = live.read(spark, folder).filter(F.col("qid") == qid).orderBy("seq").collect()
        names = [r.event for r in rows]
        assert names[0] == "sources" and names[1:4] == ["token"] * 3 and names[-1] == "done" and set(names[4:-1]) <= {"repair"} and "repair" in names
        assert "".join(r.body for r in rows if r.event == "token") == "`main` starts it."
        assert rows[-1].body == next(r.text for r in got["answers"] if r.qid == qid)


def test_tokens_of_lines_equal_the_column_function(spark):
    lines = ['data: {"choices":[{"delta":{"content":"a b"}}]}', "data: [DONE]", "", ": ping", '{"message":{"content":"x"}}', '{"done":true}', "data: {", 'data: {"choices":[]}']
    rows = spark.createDataFrame([(x, p) for x in lines for p in ("openai", "ollama")], "x string, p string")
    for r in rows.select("x", "p", T.stream_token("x", F.col("p")).alias("t")).collect():
        assert models.token_of(r.x, r.p) == r.t

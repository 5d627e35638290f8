"""Language models behind an address, as generators over a batch of requests: two wire formats, waiting on rate limits, streamed lines."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import store

#: Answers that are asked for again: too many requests, and a server that is not ready.
AGAIN = (429, 502, 503, 504)


@dataclass(frozen=True)
class Model:
    """A model at ``url``. provider: "ollama" (JSON lines) or "openai" (server-sent events), whose streams the answers are read from."""

    url: str
    name: str
    provider: str = "openai"
    key: str = ""
    temperature: float = 0.1
    seed: int = 42
    size: int = 10_240
    seconds: float = 120.0
    tries: int = 5
    tasks: int = 4

    def request(self, system: str, user: str) -> tuple[str, dict]:
        """Path and body of one call."""
        said = {"model": self.name, "stream": True, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if self.provider == "ollama":
            return "/api/chat", said | {"options": {"temperature": self.temperature, "seed": self.seed, "num_ctx": self.size}}
        return "/chat/completions", said | {"temperature": self.temperature, "seed": self.seed}


def token_of(line: str, provider: str) -> str:
    """:func:`.text.stream_token` of one line, in a task that reads it as it comes."""
    try:
        if provider == "ollama":
            return json.loads(line)["message"]["content"] or ""
        return json.loads(line.removeprefix("data:"))["choices"][0]["delta"]["content"] or "" if line.startswith("data:") else ""
    except (ValueError, KeyError, IndexError, TypeError):
        return ""


class Telling:
    """One question's events as lines of JSON in a file of its own, each written out at once; without a folder nothing is written."""

    def __init__(self, folder: str | None, qid):
        self.qid, self.seq, self.out = qid, 0, None
        if folder:
            from pyarrow import fs

            files, place = fs.FileSystem.from_uri(folder)
            files.create_dir(place, recursive=True)
            self.out = files.open_output_stream(f"{place}/{qid}-{uuid.uuid4().hex}.json", compression=None, buffer_size=None)

    def __enter__(self) -> Telling:
        return self

    def __exit__(self, *fault) -> None:
        if self.out is not None:
            self.out.close()

    def token(self, body: str) -> None:
        if self.out is not None and body:
            self.seq += 1
            self.out.write(json.dumps({"qid": self.qid, "seq": self.seq, "event": "token", "body": body}).encode() + b"\n")
            self.out.flush()


def _calls(model: Model, live: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls of a task's requests; with ``live``, a folder, their tokens are told there as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import urllib.error
        import urllib.request

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {model.key}"} if model.key else {})
        for batch in batches:
            rows = []
            for qid, system, user in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, body = model.request(system, user)
                try:
                    call = urllib.request.Request(model.url.rstrip("/") + path, json.dumps(body).encode(), head)
                    with urllib.request.urlopen(call, timeout=model.seconds) as reply, Telling(live, qid) as tell:
                        lines = []
                        for raw in reply:
                            lines.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                            tell.token(token_of(lines[-1], model.provider))
                        rows.append((reply.status, "", lines, ""))
                except urllib.error.HTTPError as fault:
                    rows.append((fault.code, fault.headers.get("Retry-After", ""), [], fault.read().decode("utf-8", "replace")[:500]))
                except OSError as fault:
                    rows.append((0, "", [], str(fault)))
            kinds = (pa.int32(), pa.string(), pa.list_(pa.string()), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["qid", "status", "wait", "lines", "fault"])

    return run


def generator(model: Model, failures: Callable[[DataFrame], None] | None = None, live: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A generator: (qid, system, user) in, (qid, text) out. Requests that the server puts off are asked again after the longest time that it
    names, up to ``tries`` times in all; those that fail have no row, and ``failures`` gets (qid, status, message) with keys hidden.
    live: a folder where tokens are told while the model writes (:func:`.live.read`)."""

    def run(requests: DataFrame) -> DataFrame:
        left = store.settle(requests.select("qid", "system", "user"))
        kind = dict(left.dtypes)["qid"]
        done = None
        for turn in range(model.tries):
            replies = left.repartition(model.tasks).mapInArrow(_calls(model, live), f"qid {kind}, status int, wait string, lines array<string>, fault string")
            replies = store.settle(replies)
            text = F.array_join(F.transform("lines", lambda x: T.stream_token(x, F.lit(model.provider))), "")
            good = replies.filter("status = 200").select("qid", text.alias("text"))
            done = good if done is None else done.unionByName(good)
            again = replies.filter(F.col("status").isin(*AGAIN))
            waits = again.agg(F.count("*").alias("n"), F.max(T.retry_after("wait")).alias("wait")).first()
            last = not waits.n or turn + 1 == model.tries
            lost = replies.filter((F.col("status") != 200) & (F.lit(last) | ~F.col("status").isin(*AGAIN)))
            if failures:
                failures(lost.select("qid", "status", T.scrub_keys("fault", F.lit(model.key)).alias("message")))
            if last:
                break
            time.sleep(min(60.0, waits.wait if waits.wait is not None else 2.0**turn))
            left = store.settle(left.join(again.select("qid"), "qid", "left_semi"))
        return done

    return run

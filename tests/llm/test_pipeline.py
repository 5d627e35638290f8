"""Every stage of the pipeline against a plain version of it, on the whole small tables."""

import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import packing, pii, quality, simhash_wide

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, found[-1], FOLDER).write.parquet(f"{root}/{name}")
        found.append(spark.read.parquet(f"{root}/{name}"))
    return found


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[:-1])


def test_rejected_documents_go(spark, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in stages[0].collect() if model.score(quality.features(r.text)[None])[0] >= 0.7}
    assert {r.doc_id for r in stages[1].collect()} == want
    bad = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 0").collect()}
    assert not bad & want and len(want) > 0.7 * stages[0].count()


def test_one_of_each_group_stays(stages):
    """All pairs by the similarity of their five-word shingles: whatever goes is linked to what stays, and few links are missed."""
    rows = {r.doc_id: set(simhash_wide.shingle_hashes(r.text).tolist()) for r in stages[1].collect()}
    holds, shared = {}, {}
    for i, held in rows.items():
        for h in held:
            holds.setdefault(h, []).append(i)
    for ids in holds.values():
        for pair in itertools.combinations(sorted(ids), 2):
            shared[pair] = shared.get(pair, 0) + 1

    def first_of_each(least):
        root = {i: i for i in rows}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        empty = sorted(i for i in rows if not rows[i])
        for a, b in [*zip(empty, empty[1:], strict=False), *(p for p, n in shared.items() if n >= least * (len(rows[p[0]]) + len(rows[p[1]]) - n))]:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {i for i in rows if find(i) == i}

    got = {r.doc_id for r in stages[2].collect()}
    assert first_of_each(0.77) <= got and len(got - first_of_each(0.8)) <= 0.005 * len(rows)


def test_spans_are_replaced(stages):
    trees = pii.train(stages[2])
    spans = {r.doc_id: (r.text, r.s) for r in pii.find_spans(stages[2], trees).select("doc_id", "text", pii.spelled(F.col("all_spans")).alias("s")).collect()}
    for r in stages[3].collect():
        text, found = spans[r.doc_id]
        at, out = 0, ""
        for kind, a, b in (s.split(":") for s in found.split(",") if s):
            if int(a) >= at:
                out += text[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert r.text == out + text[at:] and r.n_chars == len(r.text)
    assert stages[3].count() == stages[2].count() and stages[3].filter("text like '%[EMAIL]%'").count() > 0


def test_everything_is_packed(stages):
    bpe = packing.ByteBpe()
    pieces = stages[4].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {r.doc_id: len(bpe.encode(r.text)) + 1 for r in stages[3].collect()}


def test_run_gives_the_last_stage(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == stages[4].columns and rows.groupBy("doc_id").agg(F.sum("length").alias("n")).exceptAll(stages[4].groupBy("doc_id").agg(F.sum("length").alias("n"))).isEmpty()
    assert set(key) <= set(rows.columns)

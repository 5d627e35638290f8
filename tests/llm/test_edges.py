"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import chat, html, packing, pii, quality, sentencepiece, simhash, simhash_wide, vectors, warc

CLASH = "fp score length start ids base_spans all_spans held_out component_id root offset file record host rank key v rep _row _fp _kept".split()


def clashing(df, *more):
    return df.withColumns({c: F.lit("x") for c in [*CLASH, *more] if c not in df.columns})


LONG = "word " * 60_000 + "mail me at a.b@example.com now"
ROWS = [(1, "one two three four five"), (2, None), (3, ""), (4, LONG), (5, "one two three four five"), (5, "one two three four five"), (None, "no id here at all"), (None, None), (6, " \t\n"), (7, "€ 日本 🦜 <|endoftext|> x")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return clashing(rows.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}))


def empty(df):
    return df.filter("1 = 0")


def test_packing(docs):
    rows = packing.with_digest(packing.pack_documents(docs)).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sum(r.length for r in by_doc[2]) == 1 and sum(r.length for r in by_doc[3]) == 1
    assert sum(r.length for r in by_doc[4]) == by_doc[4][0].doc_tokens > 60_000
    assert len(by_doc[5]) >= 2 and len(by_doc[None]) == 2
    assert packing.with_digest(packing.pack_documents(empty(docs))).count() == 0


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    of = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert {i for (i, f), c in of.items() if f == "0" * 16 and c == 2} == {2, 3, 6, None}
    assert {c for (i, f), c in of.items() if i in (1, 5)} == {1}
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_keep_one(docs):
    kept = simhash_wide.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 7] and ids.count(None) == 1
    assert simhash_wide.keep_one(empty(docs)).count() == 0


def test_pii(docs):
    found = pii.find_spans(docs, pii.train(docs)).select("doc_id", pii.spelled(F.col("base_spans")).alias("s"), pii.redact(F.coalesce("text", F.lit("")), F.col("base_spans")).alias("t")).collect()
    spans = {r.doc_id: r.s for r in found if r.s}
    at = LONG.index("a.b@")
    assert spans == {4: f"email:{at}:{at + len('a.b@example.com')}"}
    assert next(r.t for r in found if r.doc_id == 4).endswith("mail me at [EMAIL] now")
    assert pii.find_spans(empty(docs), pii.train(empty(docs))).count() == 0


def test_quality(spark, docs):
    labels = clashing(spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, None), (5, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int"))
    rows = quality.score_documents(docs, quality.train(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out is not None for r in rows)
    no_model = quality.score_documents(docs, quality.train(docs, empty(labels)))
    assert {(r.score, r.predicted) for r in no_model.collect()} == {(0.7, 1)}
    assert quality.score_documents(empty(docs), None).count() == 0
    assert quality.keep_good(docs, quality.train(docs, labels)).columns == docs.columns


def test_sentencepiece(docs):
    rows = sentencepiece.decode(sentencepiece.encode(docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == sorted((i or 0, t or "") for i, t in ROWS)
    assert sentencepiece.decode(sentencepiece.encode(empty(docs))).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (100, [0.0, 2.0]), (9, [1.0])]
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in vectors.nearest(table, every=20, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    # both rows of the repeated id are queries and candidates
    assert sorted(got[0]) == [(1, 0, 1.0), (1, 0, 1.0), (2, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0), (3, 2, 1.0)]
    assert sorted(got[20]) == [(1, 0, 1.0), (2, 0, 1.0), (3, 1, 1.0)]
    assert sorted(got[100])[0] == (1, 8, 1.0) and set(got) == {0, 20, 100}
    exact = {}
    for r in vectors.exact_top_k(table, every=100, k=2).collect():
        exact.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(exact[0]) == [(1, 0, 1024 * 1024)] * 2 + [(2, 1, 1024 * 1024)] * 2 and set(exact) == {0, 100}
    assert vectors.nearest(empty(table), 20, 3).count() == 0 and vectors.exact_top_k(empty(table), 100, 3).count() == 0
    lone = table.filter("vec_id = 100")
    assert vectors.nearest(lone, 20, 3).count() == 0 and vectors.exact_top_k(lone, 100, 3).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (1, None, "system", "be kind"), (None, 0, "user", "x"), (2, 0, "system", "alone"), (1, 2, " ", "z")]
    table = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "perspective", "speaker", "segment")
    got = chat.rotate_perspectives(table).collect()
    one = [r for r in got if r.conv_id == 1]
    assert {r.perspective for r in one} == {"user", "unknown"} and len(one) == 2 * 5
    for who in ("user", "unknown"):
        mine = sorted((r.start, r) for r in one if r.perspective == who)
        assert "".join(r.segment for _, r in mine)[mine[1][0] :].startswith(mine[1][1].segment)
        assert [a for a, _ in mine] == [sum(len(r.segment) for _, r in mine[:i]) for i in range(len(mine))]
    assert [(r.perspective, r.loss_start) for r in got if r.conv_id == 2] == [(None, None)]
    assert chat.rotate_perspectives(empty(table)).count() == 0


def plain_findings(one, two):
    """(file, page_id, start, stop, record, copies, state) by counting records, and by adding up lengths in the order of ids."""
    import hashlib
    from collections import Counter

    sides = []
    for rows in (one, two):
        size = Counter()
        for file, page, record in rows:
            size[file, page % warc.FILE_PAGES] += len(record)
        starts, at = {}, Counter()
        for file, slot in sorted(size):
            starts[file, slot] = at[file]
            at[file] += size[file, slot]
        sides.append((Counter((f, p, hashlib.sha256(r).hexdigest()) for f, p, r in rows), {k: (v, v + size[k]) for k, v in starts.items()}))
    (a, at_a), (b, at_b) = sides
    lost = {(f, p, *at_a[f, p % warc.FILE_PAGES], d, n, "lost") for (f, p, d), n in (a - b).items()}
    return lost | {(f, p, *at_b[f, p % warc.FILE_PAGES], d, n, "added") for (f, p, d), n in (b - a).items()}


def test_audit_locates_what_was_lost_added_and_changed(spark):
    one = [(f, 256 * f + i, f"record {i} of {f}".encode()) for f in range(4) for i in range(200)] + [(1, 256 + 7, b"again")] * 3 + [(9, 256 * 9, b"alone")]
    two = [r for r in one if r[1] != 256 + 20 and r[0] != 9]  # one record among 200 lost, and a file
    two.remove((1, 256 + 7, b"again"))
    two = [(f, p, r + b"!" if p in (512, 512 + 199, 77) else r) for f, p, r in two] + [(2, 512 + 255, b"new"), (8, 256 * 8 + 3, b"new file")]
    frames = [spark.createDataFrame(rows, "file long, page_id long, record binary") for rows in (one, two)]
    rows = warc.audit(*frames).collect()
    assert {(r.file, r.page_id, r.start, r.stop, r.record, r.copies, r.state) for r in rows if r.state != "intact"} == plain_findings(one, two)
    assert [(r.file, r.page_id, r.root_a == r.root_b, r.compared) for r in rows if r.state == "intact"] == [(3, None, True, 1)]
    by_file = {r.file: r for r in rows}
    assert (by_file[1].records_a, by_file[1].records_b, by_file[9].root_b, by_file[8].root_a) == (203, 201, None, None)
    # one bad branch in each of three levels, not everything behind the lost record
    assert by_file[0].compared < 30 and len(rows) == 1 + len(plain_findings(one, two))


def test_files_of_many_records_with_one_id(spark):
    n = 5_000
    big = spark.range(n).selectExpr("0L AS file", "0L AS page_id", "encode(lpad(id, 8, '0'), 'utf-8') AS record")
    small = spark.range(3).selectExpr("1L AS file", "id AS page_id", "encode('x' || id, 'utf-8') AS record")
    one = big.unionByName(small)
    two = big.filter("record <> encode('00000042', 'utf-8')").unionByName(small.withColumn("record", F.when(F.col("page_id") == 2, F.encode(F.lit("y2"), "utf-8")).otherwise(F.col("record"))))
    rows = sorted(warc.audit(one, two).collect(), key=lambda r: (r.file, r.state))
    assert [(r.file, r.records_a, r.records_b, r.start, r.stop, r.copies, r.state) for r in rows] == [(0, n, n - 1, 0, 8 * n, 1, "lost"), (1, 3, 3, 4, 6, 1, "added"), (1, 3, 3, 4, 6, 1, "lost")]
    # another file's size changes nothing
    alone = sorted(warc.audit(small, two.filter("file = 1")).collect(), key=lambda r: r.state)
    assert [r for r in rows if r.file == 1] == alone
    assert warc.audit(one, one).filter("root_a = root_b AND compared = 1 AND state = 'intact' AND start IS NULL").count() == 2


def test_html(spark):
    rows = [(1, "http://a.com/x", "<p>One</p>"), (2, None, None), (3, "no url", ""), (4, "http://a.com/y", "<article>T" + "<p>x</p>" * 3000), (None, "http://a.com/x", "<p>One</p>"), (1, "http://a.com/x", "<p>One</p>")]
    table = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "text", "n_chars")
    got = html.extract(table).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert next(r for r in got if r.page_id == 4).text == "T" + "\n\nx" * 3000 and all(r.n_chars == len(r.text) for r in got)
    assert html.extract(empty(table)).count() == 0


def test_warc(spark):
    rows = [(1, "http://a.com/x", "<p>One</p>"), (2, None, None), (300, "u", ""), (None, "v", "w"), (2, None, None)]
    table = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "digest", "place")
    records = warc.to_records(table)
    same = warc.audit(records, records).collect()
    assert len(same) == 3 and all(r.state == "intact" and r.root_a == r.root_b for r in same)
    lost = warc.audit(records, warc.to_records(table.filter("page_id = 300"))).collect()
    assert {r.file for r in lost if r.root_b is None} == {r.file for r in lost if r.state == "lost"} and sum(r.copies or 0 for r in lost) == 4
    assert warc.audit(empty(records), empty(records)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for source in (docs, empty(docs)):
        rows = source
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, folder)
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
            rows = spark.read.parquet(f"{folder}/{name}")
            if name != "packing":
                assert rows.columns == corpus_pipeline.COLUMNS
        assert (rows.count() > 0) == (source is docs)

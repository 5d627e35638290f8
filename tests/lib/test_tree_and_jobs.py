"""The data source of source trees, table functions, and work that can be stopped."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lodestar.functions import tables
from lodestar.plans import jobs
from lodestar.sources import store, tree


@pytest.fixture(scope="module")
def registered(spark):
    tree.register(spark)
    tables.register(spark)
    return spark


def write(root, name, data, age=10):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    moment = time.time() - age
    os.utime(path, (moment, moment))


def test_a_tree_is_read_and_filters_choose_before_content_is(registered, tmp_path):
    for name, data in (("a.py", b"x = 1"), ("pkg/b.py", b"y" * 100), ("n.ipynb", b"{}"), ("c.txt", b"no"), (".git/d.py", b"no"), ("big.py", b"z" * 600)):
        write(tmp_path, name, data)
    rows = registered.read.format("sources").option("path", str(tmp_path)).option("maxBytes", 500).option("partitionBytes", 50).load()
    assert {(r.path, r.length, bytes(r.content)) for r in rows.collect()} == {("a.py", 5, b"x = 1"), ("pkg/b.py", 100, b"y" * 100), ("n.ipynb", 2, b"{}")}
    assert rows.rdd.getNumPartitions() == 2
    some = rows.filter(F.col("path").endswith(".py") & (F.col("length") < 50))
    assert [r.path for r in some.collect()] == ["a.py"]
    reader = tree.TreeReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([tree.StringEndsWith(("path",), ".ipynb"), tree.EqualTo(("modified",), 0)]))
    assert len(left) == 1 and [f.path for p in reader.partitions() for f in p.held] == ["n.ipynb"]
    assert registered.read.format("sources").option("path", str(tmp_path / "none")).load().count() == 0


def test_a_stream_reads_each_file_once_over_restarts(registered, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        rows = registered.readStream.format("sources").option("path", str(root)).load()
        query = rows.select("path", F.col("content").cast("string").alias("text")).writeStream.format("parquet").option("checkpointLocation", check).start(out)
        query.processAllAvailable()
        query.stop()

    write(root, "a.py", b"one", 30)
    write(root, "b.py", b"two", 20)
    run()
    write(root, "a.py", b"again", 10)
    write(root, "young.py", b"not yet", -60)
    run()
    run()
    assert sorted((r.path, r.text) for r in registered.read.parquet(out).collect()) == [("a.py", "again"), ("a.py", "one"), ("b.py", "two")]


def test_table_functions_check_their_arguments(registered):
    registered.createDataFrame([("p", "a\nb\n\nc\n"), ("q", None), ("r", " \n")], "path string, text string").createOrReplaceTempView("given")
    got = registered.sql("SELECT path, chunk_no, start_line, end_line FROM line_windows(TABLE(SELECT * FROM given), 2, 1)").collect()
    assert sorted(map(tuple, got)) == [("p", 0, 1, 2), ("p", 1, 2, 3), ("p", 2, 3, 4)]
    for bad in ("TABLE(SELECT path FROM given), 2, 1", "TABLE(SELECT * FROM given), 2, 2", "1, 2, 1"):
        with pytest.raises(Exception, match="no column|overlap|table"):
            registered.sql(f"SELECT * FROM line_windows({bad})").collect()


def test_work_tells_its_progress_and_its_result(spark):
    work = jobs.Work(spark, lambda: spark.range(1000).repartition(3).count(), "counting").start()
    assert work.wait(60) == 1000
    status = work.status()
    assert status.state == "done" and status.jobs >= 1 and status.tasks_done >= 3
    failing = jobs.Work(spark, lambda: spark.range(1).select(F.raise_error(F.lit("no"))).collect()).start()
    with pytest.raises(Exception, match="no"):
        failing.wait(60)
    assert failing.status().state == "failed"


def test_a_stopped_build_leaves_the_older_version(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    store.save_index(folder, {"model": "m"}, chunks=spark.range(5).withColumnRenamed("id", "doc"))
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    work = jobs.Work(spark, lambda: store.save_index(folder, {"model": "m"}, chunks=spark.range(4000).repartition(4).select(slow("id").alias("doc"))), "index").start()
    for _ in range(200):
        if work.status().jobs:
            break
        time.sleep(0.1)
    assert work.status().state == "running"
    work.stop()
    with pytest.raises(Exception):  # noqa: B017, PT011
        work.wait(60)
    assert work.status().state == "stopped"
    assert store.load_index(spark, folder)["chunks"].count() == 5

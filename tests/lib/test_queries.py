"""The library's queries against their SQL."""

import pytest
from pyspark.sql import functions as F
from oracle import compare

from lodestar.operators import syntax
from lodestar.plans import event_queries, queries, table_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.001")


def test_entry_without_a_driver(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sources_of_one_small_file_are_parsed_by_all_cores(spark):
    parsed = queries.table_graph(spark, "/root/testdata/sf0.01")[3]
    sizes = sorted(r["count"] for r in parsed.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == spark.sparkContext.defaultParallelism and sizes[-1] < 2 * sizes[0]


def test_files_are_cut_once(spark):
    """A range partitioning reads its rows twice: files are dealt by range before they are cut, and lines wait until then."""
    from lodestar.sources import files as f

    source = f.spread(spark.createDataFrame([("a", "a", "x\ny\nz"), ("b", "b", ""), ("c", "c", None), ("d", "d", "w")], "path string, file_ord string, text string")).repartitionByRange("file_ord")
    made = syntax.numbered(syntax.chunk_files(source, None, 2, 1), ranged=True)
    assert [(r.doc, r.path, r.text) for r in made.orderBy("doc").collect()] == [(0, "a", "x\ny"), (1, "a", "y\nz"), (2, "d", "w")]
    plan = syntax.chunk_files(source, None, 2, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("split") < plan.index("RepartitionByExpression") and "split" not in plan[plan.index("RepartitionByExpression") :]

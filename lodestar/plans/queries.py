"""The library's queries over the driver's tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, cite, context, dense, evaluate, graph, lexical, rank, scan, syntax
from ..sources import files, store
from ..streaming import logs
from . import engine, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SIZE, OVERLAP, TOP, DEPTH = 20, 5, 10, 50


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' term counts, worked out once and kept: what BM25 searches."""
    return store.settle(lexical.documents_terms(docs(spark, sf_dir)))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks, each defining the symbol that its source and id make."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.concat_ws("_", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string")).alias("symbol"))
    return rows.select("*", F.concat(F.lit("doc/"), F.col("doc").cast("string")).alias("path"), F.lit(1).alias("start_line"), F.size(T.lines("text")).alias("end_line"), F.lit("function").alias("kind"), F.lit("").alias("context"))


def doc_corpus(spark: SparkSession, sf_dir: str) -> rank.Corpus:
    """The documents as a corpus that BM25 searches by their text alone."""
    return rank.Corpus(doc_chunks(spark, sf_dir).withColumn("embedded", F.col("text")), doc_terms(spark, sf_dir))


DOCS, ASKED = "d AS (SELECT doc_id AS doc, text FROM documents)", "q AS (SELECT item_id AS qid, text FROM benchmark)"
DOC_TOKENS, QUERY_TOKENS = oracle.tokens("dt", "d", "doc", "text"), oracle.tokens("qt", "q", "qid", "text", stop=True)

# ---- chunks ----

_LINES = "l AS (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS ls FROM documents WHERE text <> '')"
_WINDOWS = f"""{_LINES}, w AS (SELECT doc_id, ls, len(ls) AS n, unnest(range(0, greatest(0, ceil((len(ls) - {SIZE}) / {SIZE - OVERLAP}.0))::BIGINT + 1)) AS chunk_no FROM l),
c AS (SELECT doc_id, chunk_no::INTEGER AS chunk_no, (chunk_no * {SIZE - OVERLAP} + 1)::INTEGER AS start_line, least(chunk_no * {SIZE - OVERLAP} + {SIZE}, n)::INTEGER AS end_line,
  array_to_string(ls[chunk_no * {SIZE - OVERLAP} + 1 : chunk_no * {SIZE - OVERLAP} + {SIZE}], chr(10)) AS text, 'doc/' || doc_id AS path FROM w)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = files.spread(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text"))
    return chunk.fixed_windows(source, SIZE, OVERLAP)


@query(f"WITH {_WINDOWS} SELECT doc_id, chunk_no, start_line, end_line, substr(sha1(path || ':' || start_line || '-' || end_line || ':' || text), 1, 16) AS id FROM c WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def fixed_window_chunks(spark, sf_dir):
    return windows(spark, sf_dir).select("doc_id", "chunk_no", "start_line", "end_line", "id")


@query(
    f"WITH {_WINDOWS}, k AS (SELECT path, end_line - start_line + 1 AS n FROM c WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') "
    "SELECT count(*) AS n_chunks, count(DISTINCT path) AS n_files, round(avg(n), 6) AS mean_lines, median(n) AS median_lines FROM k"
)
def chunk_stats(spark, sf_dir):
    return chunk.index_stats(windows(spark, sf_dir)).withColumn("mean_lines", F.round("mean_lines", 6))


# ---- words ----


@query(f"WITH {DOCS}, {DOC_TOKENS} SELECT term, count(*) AS tf, count(DISTINCT doc) AS df FROM dt GROUP BY term")
def token_frequencies(spark, sf_dir):
    rows = lexical.postings(lexical.documents_terms(docs(spark, sf_dir)))
    return rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(f"WITH {DOCS}, {DOC_TOKENS} SELECT d.doc, count(term) AS dl FROM d LEFT JOIN dt ON dt.doc = d.doc GROUP BY d.doc")
def doc_lengths(spark, sf_dir):
    return lexical.documents_terms(docs(spark, sf_dir)).select("doc", F.col("dl").cast("long").alias("dl"))


@query(
    f"WITH {DOCS}, {DOC_TOKENS}, n AS (SELECT count(*) AS n FROM d), f AS (SELECT term, count(DISTINCT doc) AS df FROM dt GROUP BY term) "
    "SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM f CROSS JOIN n"
)
def term_idf(spark, sf_dir):
    terms = doc_terms(spark, sf_dir)
    rows = lexical.postings(terms).groupBy("term").agg(F.count("*").alias("df"))
    return rows.crossJoin(F.broadcast(lexical.corpus_stats(terms))).select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 9).alias("idf"))


_BM25 = f"{DOCS}, {ASKED}, {DOC_TOKENS}, {QUERY_TOKENS}, {oracle.bm25('s', 'dt', 'qt', 'd')}"


def bm25_hits(spark, sf_dir, k=TOP):
    return lexical.bm25_top_k(doc_terms(spark, sf_dir), questions(spark, sf_dir), k)


@query(f"WITH {_BM25}, {oracle.top('h', 's', TOP)} SELECT qid, doc, rank, round(score, 6) AS score FROM h")
def bm25_topk(spark, sf_dir):
    return bm25_hits(spark, sf_dir).select("qid", "doc", "rank", F.round("score", 6).alias("score"))


_GOLD = "g AS (SELECT q.qid, d.doc FROM q JOIN d ON contains(d.text, q.text))"
_METRICS = """r AS (SELECT g.qid, min(h.rank) AS rank FROM g LEFT JOIN h ON h.qid = g.qid AND h.doc = g.doc GROUP BY g.qid)
SELECT '{name}' AS system, count(*) AS n, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) AS mrr,
  round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1 FROM r"""


def scored(name: str, hits: DataFrame, gold: DataFrame) -> DataFrame:
    ranks = gold.join(hits.select("qid", "doc", "rank"), ["qid", "doc"], "left").groupBy("qid").agg(F.min("rank").alias("rank")).withColumn("type", F.lit("passage"))
    rows = evaluate.retrieval_metrics(ranks).filter(F.col("type") == evaluate.ALL)
    return rows.select(F.lit(name).alias("system"), "n", "recall", "mrr", "hit1")


@query(f"WITH {_BM25}, {oracle.top('h', 's', TOP)}, {_GOLD}, {_METRICS.format(name='bm25')}")
def bm25_recall(spark, sf_dir):
    return scored("bm25", bm25_hits(spark, sf_dir), scan.sharing(questions(spark, sf_dir), docs(spark, sf_dir)))


# ---- vectors ----

_DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS qid, b.vec_id AS doc, a.label AS asked, b.label, round(list_inner_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE a.vec_id % 20 = 0)"""


def dense_hits(spark, sf_dir, k=TOP):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"))
    return dense.exact_top_k(v, v.filter(F.pmod("doc", F.lit(20)) == 0).select(F.col("doc").alias("qid"), "vec"), k)


@query(f"WITH {_DENSE}, {oracle.top('h', 's', TOP)} SELECT qid, doc, rank, score FROM h")
def dense_topk(spark, sf_dir):
    return dense_hits(spark, sf_dir).select("qid", "doc", "rank", "score")


@query(f"WITH {_DENSE}, o AS (SELECT * FROM s WHERE qid <> doc), {oracle.top('h', 'o', TOP)} SELECT asked AS label, count(*) AS n, round(avg((asked = label)::INTEGER), 6) AS hit_rate FROM h GROUP BY asked")
def knn_label_hit_rate(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    others = dense_hits(spark, sf_dir, TOP + 1).filter("qid <> doc").select("qid", "doc", "score")
    hits = rank.rank_within(others, ["qid"], F.desc("score"), "doc").filter(F.col("rank") <= TOP).join(labels, "doc").join(labels.select(F.col("doc").alias("qid"), F.col("label").alias("asked")), "qid")
    return hits.groupBy(F.col("asked").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("asked") == hits.label).cast("int")), 6).alias("hit_rate"))


@query(f"WITH {DOCS}, {oracle.hashing('e', 'd', 'doc', 'text')} SELECT doc, bucket, round(w, 6) AS w FROM e")
def hashing_vectors(spark, sf_dir):
    rows = dense.hashing_entries(docs(spark, sf_dir), "doc").select("doc", F.inline(F.arrays_zip("bucket", "w")))
    return rows.select("doc", F.col("bucket"), F.round("w", 6).alias("w"))


_COSINE = f"{oracle.hashing('de', 'd', 'doc', 'text')}, {oracle.hashing('qe', 'q', 'qid', 'text')}, cs AS (SELECT qid, doc, round(sum(de.w * qe.w), 6) AS score FROM qe JOIN de USING (bucket) GROUP BY ALL)"


def cosine_hits(spark, sf_dir, k=TOP):
    return dense.cosine_top_k(dense.hashing_entries(docs(spark, sf_dir), "doc"), dense.hashing_entries(questions(spark, sf_dir), "qid"), k)


@query(f"WITH {DOCS}, {ASKED}, {_COSINE}, {oracle.top('h', 'cs', TOP)} SELECT qid, doc, rank, score FROM h")
def hashing_cosine_topk(spark, sf_dir):
    return cosine_hits(spark, sf_dir).select("qid", "doc", "rank", "score")


# ---- fusion ----

_TWO = f"""{_BM25}, {_COSINE}, {oracle.top('b', 's', DEPTH)}, {oracle.top('v', 'cs', DEPTH)},
two AS (SELECT qid, 0 AS list_no, doc, rank, 1 AS weight FROM v UNION ALL SELECT qid, 1, doc, rank, 1 FROM b), {oracle.rrf('f', 'two')}"""


def two_lists(spark, sf_dir):
    near = cosine_hits(spark, sf_dir, DEPTH).select("qid", F.lit(0).alias("list_no"), "doc", "rank")
    return near.unionByName(bm25_hits(spark, sf_dir, DEPTH).select("qid", F.lit(1).alias("list_no"), "doc", "rank"))


@query(f"WITH {_TWO} SELECT qid, doc, rank, round(score, 9) AS score FROM f WHERE rank <= {TOP}")
def hybrid_rrf(spark, sf_dir):
    return rank.rrf(two_lists(spark, sf_dir)).filter(F.col("rank") <= TOP).select("qid", "doc", "rank", F.round("score", 9).alias("score"))


def halves(spark, sf_dir):
    """Two rewrites of each passage: its first and its second half."""
    q = questions(spark, sf_dir)
    half = F.floor(F.length("text") / 2).cast("int")
    pieces = F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")))
    return q.select("qid", F.posexplode(pieces).alias("pos", "text"))


_MULTI = f"""{_BM25}, {oracle.top('b', 's', DEPTH)}, rw AS (SELECT qid * 2 AS qid, text[:length(text) // 2] AS text FROM q UNION ALL SELECT qid * 2 + 1, text[length(text) // 2 + 1:] FROM q),
{oracle.tokens('rt', 'rw', 'qid', 'text', stop=True)}, {oracle.bm25('rs', 'dt', 'rt', 'd')}, {oracle.top('rb', 'rs', DEPTH)},
lists AS (SELECT qid, 0 AS list_no, doc, rank, 2 AS weight FROM b UNION ALL SELECT qid // 2, 1 + qid % 2, doc, rank, 1 FROM rb), {oracle.rrf('f', 'lists')}"""


@query(f"WITH {_MULTI} SELECT qid, doc, rank, round(score, 9) AS score FROM f WHERE rank <= {TOP}")
def multi_query_rrf(spark, sf_dir):
    hits = rank.retrieve(doc_corpus(spark, sf_dir), questions(spark, sf_dir), TOP, "bm25", halves(spark, sf_dir), pins=False)
    return hits.select("qid", "doc", F.col("pos").alias("rank"), F.round("score", 9).alias("score"))


@query(
    f"""WITH {_BM25}, {oracle.top('b', 's', 30)}, qs AS (SELECT qid, list(DISTINCT term) AS ts FROM qt GROUP BY qid), ds AS (SELECT doc, list(DISTINCT term) AS ts FROM dt GROUP BY doc),
o AS (SELECT b.qid, b.doc, b.rank AS first, round(len(list_intersect(qs.ts, ds.ts)) / greatest(len(qs.ts), 1)::DOUBLE, 12) AS score FROM b JOIN qs USING (qid) JOIN ds USING (doc)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM o) SELECT qid, doc, rank, round(score, 9) AS score FROM r WHERE rank <= {TOP}"""
)
def overlap_rerank(spark, sf_dir):
    hits = rank.retrieve(doc_corpus(spark, sf_dir), questions(spark, sf_dir), TOP, "bm25", rerank=rank.by_overlap, pins=False)
    return hits.select("qid", "doc", F.col("pos").alias("rank"), F.round("score", 9).alias("score"))


_SYMBOLS = "sy AS (SELECT doc_id AS doc, coalesce(source, 'none') || '_' || doc_id AS text FROM documents)"
_BOOSTED = f"""{DOCS}, {ASKED}, {_SYMBOLS}, {DOC_TOKENS}, {QUERY_TOKENS}, {oracle.tokens('st', 'sy', 'doc', 'text')},
bt AS (SELECT doc, term FROM dt UNION ALL SELECT doc, term FROM st CROSS JOIN range({lexical.SYMBOL_BOOST})), {oracle.bm25('s', 'bt', 'qt', 'd')}"""


@query(f"WITH {_BOOSTED}, {oracle.top('h', 's', TOP)} SELECT qid, doc, rank, round(score, 6) AS score FROM h")
def bm25_symbols(spark, sf_dir):
    """BM25 over documents with symbols, whose tokens count threefold."""
    terms = store.settle(lexical.documents_terms(doc_chunks(spark, sf_dir)))
    return lexical.bm25_top_k(terms, questions(spark, sf_dir), TOP).select("qid", "doc", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH {DOCS}, {_SYMBOLS}, {DOC_TOKENS}, q AS (SELECT item_id AS qid, b.text || ' ' || sy.text AS text, sy.doc AS pin FROM benchmark b JOIN sy ON sy.doc = item_id), {QUERY_TOKENS}, {oracle.bm25('s', 'dt', 'qt', 'd')}, {oracle.top('b', 's', DEPTH)},
fr AS (SELECT b.qid, b.doc, row_number() OVER (PARTITION BY b.qid ORDER BY b.rank) AS first FROM b JOIN q USING (qid) WHERE b.doc <> q.pin),
qs AS (SELECT qid, list(DISTINCT term) AS ts FROM qt GROUP BY qid), ds AS (SELECT doc, list(DISTINCT term) AS ts FROM dt GROUP BY doc),
o AS (SELECT fr.*, round(len(list_intersect(qs.ts, ds.ts)) / greatest(len(qs.ts), 1)::DOUBLE, 12) AS score FROM fr JOIN qs USING (qid) JOIN ds USING (doc) WHERE first <= {rank.RERANK_DEPTH - 1}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS re FROM o), best AS (SELECT qid, max(score) FILTER (re = 1) AS top FROM r GROUP BY qid)
SELECT qid, 1 AS pos, pin AS doc, true AS symbol, NULL::INTEGER AS rerank, round(coalesce(top + 1, 1.0), 9) AS score FROM q LEFT JOIN best USING (qid)
UNION ALL SELECT qid, re + 1, doc, false, re, round(score, 9) FROM r WHERE re < {TOP}"""
)
def pinned_rerank(spark, sf_dir):
    """Passages that also name one document's symbol: it is pinned, and the other hits are reranked behind it."""
    source = doc_corpus(spark, sf_dir)
    named = questions(spark, sf_dir).join(source.chunks.select(F.col("doc").alias("qid"), "symbol"), "qid").select("qid", F.concat_ws(" ", "text", "symbol").alias("text"))
    hits = rank.retrieve(source, named, TOP, "bm25", rerank=rank.by_overlap)
    return hits.select("qid", "pos", "doc", F.col("detail.symbol").alias("symbol"), F.col("detail.rerank").alias("rerank"), F.round("score", 9).alias("score"))


BUDGET = 1500


@query(
    f"""WITH RECURSIVE {_BM25}, {oracle.top('h', 's', TOP)}, blocks AS (
  SELECT qid, rank, doc, length('### doc/' || doc || ':1-' || greatest(1, len(string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)))) || chr(10) || '```python' || chr(10) || text || chr(10) || '```') // 4 + 1 AS cost FROM h JOIN d USING (doc)),
fold AS (SELECT qid, 0::BIGINT AS pos, 0::BIGINT AS total, 0::BIGINT AS used, ''::VARCHAR AS docs FROM (SELECT DISTINCT qid FROM blocks)
  UNION ALL SELECT f.qid, f.pos + 1, CASE WHEN f.total + b.cost <= {BUDGET} OR f.used = 0 THEN f.total + b.cost ELSE f.total END, CASE WHEN f.total + b.cost <= {BUDGET} OR f.used = 0 THEN f.used + 1 ELSE f.used END,
    CASE WHEN f.total + b.cost <= {BUDGET} OR f.used = 0 THEN f.docs || ' ' || b.doc ELSE f.docs END FROM fold f JOIN blocks b ON b.qid = f.qid AND b.rank = f.pos + 1)
SELECT qid, arg_max(total, pos) AS tokens, arg_max(used, pos) AS n_used, trim(arg_max(docs, pos)) AS docs FROM fold GROUP BY qid"""
)
def context_pack(spark, sf_dir):
    hits = bm25_hits(spark, sf_dir).select("qid", F.col("rank").alias("pos"), "doc", F.lit("").alias("reason"))
    source = docs(spark, sf_dir)
    rows = source.select("doc", F.concat(F.lit("doc/"), F.col("doc").cast("string")).alias("path"), F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.size(T.lines("text"))).alias("end_line"), "text", F.lit("window").alias("kind"), F.lit("").alias("symbol"))
    packed = context.assemble(hits, rows, BUDGET)
    tokens = F.aggregate(F.transform(F.split("context", "\n\n(?=### doc/[0-9]+:1-)", -1), lambda b: T.approx_tokens(b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return packed.select("qid", tokens.alias("tokens"), F.size("used").cast("long").alias("n_used"), F.array_join(F.transform("used", lambda d: d.cast("string")), " ").alias("docs"))


# ---- graphs ----

_FK = """e AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""


def foreign_keys(spark, sf_dir) -> DataFrame:
    """The foreign keys as edges: a row depends on the row that it names."""
    rows = None
    for name, kind, key, to, ref in (("nation", "nation", "n_nationkey", "region", "n_regionkey"), ("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), ("orders", "order", "o_orderkey", "customer", "o_custkey")):
        of = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))
        part = table(spark, sf_dir, name).select(of(kind, key).alias("src"), of(to, ref).alias("dst"), F.lit("call").alias("kind"), F.lit(1).alias("line"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def regions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))


@query(f"WITH {_FK} SELECT r_regionkey AS qid, src, dst FROM region JOIN e ON dst = 'region:' || r_regionkey")
def fk_callers(spark, sf_dir):
    return graph.callers(foreign_keys(spark, sf_dir), regions(spark, sf_dir)).select("qid", "src", "dst")


@query(f"WITH {_FK} SELECT c_custkey AS qid, src, dst FROM customer JOIN e ON src = 'customer:' || c_custkey")
def fk_callees(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return graph.callees(foreign_keys(spark, sf_dir), asked).select("qid", "src", "dst")


@query(
    f"""WITH RECURSIVE {_FK}, w AS (SELECT r_regionkey AS qid, 'region:' || r_regionkey AS id, 0 AS hop FROM region UNION ALL SELECT w.qid, e.src, w.hop + 1 FROM w JOIN e ON e.dst = w.id WHERE w.hop < 3)
SELECT qid, id, min(hop) AS hop FROM w WHERE hop > 0 GROUP BY qid, id"""
)
def fk_impact(spark, sf_dir):
    return graph.impact(foreign_keys(spark, sf_dir), regions(spark, sf_dir), 3)


_LINKS = "a AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS hs FROM pages), links AS (SELECT page_id AS src, unnest(hs) AS dst, unnest(range(1, len(hs) + 1)) AS line FROM a)"


def links(spark, sf_dir) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), F.posexplode(found).alias("i", "dst")).select("src", "dst", F.lit("link").alias("kind"), (F.col("i") + 1).cast("long").alias("line"))


@query(f"WITH {_LINKS} SELECT dst, count(DISTINCT src) AS n FROM links GROUP BY dst")
def in_degree_suggestions(spark, sf_dir):
    return graph.in_degrees(graph.first_edges(links(spark, sf_dir)))


@query(f"WITH {_LINKS} SELECT src, dst, min(line)::BIGINT AS line FROM links GROUP BY src, dst")
def edge_dedup_first(spark, sf_dir):
    return graph.first_edges(links(spark, sf_dir)).select("src", "dst", "line")


@query(
    """SELECT 'order:' || o_orderkey AS qual, p.pos, CASE p.pos WHEN 1 THEN 'customer:' || o_custkey WHEN 2 THEN 'nation:' || c_nationkey ELSE 'region:' || n_regionkey END AS base
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey CROSS JOIN (VALUES (1), (2), (3)) p(pos)"""
)
def fk_ancestry(spark, sf_dir):
    """What every order descends from, through customer and nation to region."""
    edges = foreign_keys(spark, sf_dir).filter(~F.col("src").startswith("supplier:"))
    bases = edges.select(F.col("src").alias("qual"), F.lit(0).alias("n"), F.col("dst").alias("base"))
    names = edges.select(F.col("dst").alias("qual")).distinct().select("qual", F.col("qual").alias("name"))
    return graph.ancestry(bases, names).filter(F.col("qual").startswith("order:")).select("qual", "pos", "base")


def table_sources(spark, sf_dir) -> DataFrame:
    """Python files that the tables make: a class for each region, a class and a maker for each nation, a function for each customer."""
    of = lambda name: table(spark, sf_dir, name)
    text = lambda pattern, *cols: F.format_string(pattern, *cols)
    region = of("region").select(text("region_%d.py", "r_regionkey").alias("path"), text("class R%d:\n    def run(self):\n        return self.rest()\n\n    def rest(self):\n        return 1\n", "r_regionkey").alias("text"))
    nation = of("nation").select(
        text("nation_%d.py", "n_nationkey").alias("path"),
        text("from region_%d import R%d\n\n\nclass N%d(R%d):\n    def go(self):\n        return self.run()\n\n\ndef make_%d():\n    return N%d()\n", *["n_regionkey"] * 2, "n_nationkey", "n_regionkey", *["n_nationkey"] * 2).alias("text"),
    )
    customer = of("customer").select(text("customer_%d.py", "c_custkey").alias("path"), text("from nation_%d import make_%d\n\n\ndef of_%d():\n    return make_%d().go()\n", "c_nationkey", "c_nationkey", "c_custkey", "c_nationkey").alias("text"))
    rows = region.unionByName(nation).unionByName(customer)
    return files.spread(rows).withColumn("file_ord", files.walk_order(F.col("path")))


def table_graph(spark, sf_dir):
    sources = table_sources(spark, sf_dir)
    parsed = store.settle(syntax.parse_files(sources))
    chunks = syntax.numbered(syntax.chunk_files(sources, parsed))
    nodes = syntax.definitions(parsed, chunks)
    return sources, chunks, nodes, parsed


@query(
    """SELECT 'R' || r_regionkey || '.run' AS src, 'R' || r_regionkey || '.rest' AS dst, 'call' AS kind, 3 AS line, 'self' AS how FROM region
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'inherit', 4, 'import' FROM nation
UNION ALL SELECT 'N' || n_nationkey || '.go', 'R' || n_regionkey || '.run', 'call', 6, 'base' FROM nation
UNION ALL SELECT 'make_' || n_nationkey, 'N' || n_nationkey, 'instantiate', 10, 'local' FROM nation
UNION ALL SELECT 'of_' || c_custkey, 'make_' || c_nationkey, 'call', 5, 'import' FROM customer"""
)
def table_call_graph(spark, sf_dir):
    """References of files that the tables make: ``make().go()`` has many definitions of go, so that call is dropped."""
    sources, _, nodes, parsed = table_graph(spark, sf_dir)
    edges, _ = graph.resolve(nodes, syntax.references(parsed, nodes), syntax.bases(nodes), syntax.imports(sources))
    name = lambda side: nodes.select(F.col("id").alias(side), F.col("qual").alias(f"{side}_name"))
    return edges.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "kind", "line", "how")


@query(
    """SELECT 'region_' || r_regionkey || '.py' AS path, 1 AS start_line, 6 AS end_line, 'R' || r_regionkey AS symbol, 'class' AS kind FROM region
UNION ALL SELECT 'nation_' || n_nationkey || '.py', p.a, p.b, p.s || CASE WHEN p.a > 1 THEN n_nationkey::VARCHAR ELSE 'nation_' || n_nationkey END, p.k FROM nation CROSS JOIN (VALUES (1, 1, '', 'module'), (4, 6, 'N', 'class'), (9, 10, 'make_', 'function')) p(a, b, s, k)
UNION ALL SELECT 'customer_' || c_custkey || '.py', p.a, p.b, p.s || CASE WHEN p.a > 1 THEN c_custkey::VARCHAR ELSE 'customer_' || c_custkey END, p.k FROM customer CROSS JOIN (VALUES (1, 1, '', 'module'), (4, 5, 'of_', 'function')) p(a, b, s, k)"""
)
def table_syntax_chunks(spark, sf_dir):
    return table_graph(spark, sf_dir)[1].select("path", "start_line", "end_line", "symbol", "kind")


# ---- text ----


@query(
    "SELECT CASE WHEN regexp_matches(text, '\\bdoes\\b.*\\b(call|calls|use|uses|invoke|depend|depends|rely)\\b', 'i') THEN 'callees' "
    "WHEN regexp_matches(text, '\\b(calls?|called|callers?|uses?|used|usages?|invok\\w*|depend\\w*|breaks?|impact\\w*|affect\\w*|referenc\\w*|protected|wrapped|decorated|subclass\\w*|inherit\\w*)\\b', 'i') "
    "THEN 'callers' ELSE 'related' END AS intent, role, count(*) AS n FROM conversations GROUP BY ALL"
)
def intent_histogram(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(T.intent("text").alias("intent"), "role").agg(F.count("*").alias("n"))


@query("SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(lower(url), '[^a-z0-9_-]+', '-', 'g'), '-'), 1, 60), ''), 'repo') AS slug FROM pages")
def slug_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug("url").alias("slug"))


@query("SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '(?s)^https://m\\..*$') OR regexp_matches(url, '(?s)^.*\\.org/.*$'))")
def glob_exclude(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(~T.matches_any("url", ["https://m.*", "*.org/*"])).select("page_id", "url")


@query(
    "WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), s AS (SELECT page_id, path, string_split(path, '/') AS parts FROM p) "
    "SELECT page_id, length(path) < 240 AND len(list_filter(parts, lambda x: x = '' OR regexp_matches(x, '[<>:\"|?*\\\\\\x00-\\x1f]') OR regexp_matches(x, '(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\\..*)?$') OR regexp_matches(x, '[ .]$'))) = 0 AS safe FROM s"
)
def windows_safe_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.windows_safe(F.regexp_replace("url", "^https?://", "")).alias("safe"))


# ---- citations ----


_CITED = f"""{_WINDOWS}, shown AS (SELECT doc_id AS qid, chunk_no, path || '.txt' AS path, start_line AS a, end_line AS b FROM c WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
said AS (SELECT doc_id AS qid, doc_id % 7 + 1 AS first, doc_id % 7 + 1 + doc_id % 31 AS last, ls, CASE WHEN doc_id % 3 = 0 THEN 'absent_name' ELSE regexp_extract(array_to_string(ls, chr(10)), '[A-Za-z_][A-Za-z0-9_]{{2,}}') END AS name FROM l),
inside AS (SELECT said.qid, max((a <= first AND last <= b)::INTEGER) AS one, count(*) FILTER (b >= first AND a <= last) AS n_over, min(a) FILTER (b >= first AND a <= last) AS low, max(b) FILTER (b >= first AND a <= last) AS high
  FROM said JOIN shown USING (qid) GROUP BY said.qid)"""


def cited_documents(spark, sf_dir):
    """An answer about each document, which names a word and cites lines, and all windows of the document as what it was shown."""
    rows = windows(spark, sf_dir).select(F.col("doc_id").alias("qid"), F.col("chunk_no").alias("pos"), F.concat("path", F.lit(".txt")).alias("path"), "start_line", "end_line", "text", F.lit("").alias("symbol"))
    d = table(spark, sf_dir, "documents").filter("text <> ''")
    first = F.col("doc_id") % 7 + 1
    name = F.when(F.col("doc_id") % 3 == 0, F.lit("absent_name")).otherwise(F.regexp_extract(F.array_join(T.lines("text"), "\n"), "[A-Za-z_][A-Za-z0-9_]{2,}", 0))
    text = F.format_string("`%s` is in [doc/%d.txt:%d-%d].", name, "doc_id", first, first + F.col("doc_id") % 31)
    return d.select(F.col("doc_id").alias("qid"), text.alias("text")), rows


@query(f"WITH {_CITED} SELECT qid, 1 AS n_citations, CASE WHEN coalesce(one, 0) = 1 THEN '' ELSE 'doc/' || qid || '.txt:' || first || '-' || last END AS invalid FROM said LEFT JOIN inside USING (qid)")
def citation_ranges_documents(spark, sf_dir):
    return cite.check_ranges(*cited_documents(spark, sf_dir)).select("qid", "n_citations", F.array_join("invalid", "; ").alias("invalid"))


@query(
    f"""WITH {_CITED}, v AS (SELECT said.*, coalesce(one, 0) = 1 OR (coalesce(n_over, 0) > 0 AND low <= first + {cite.GAP} AND greatest(first, high + 1) + {cite.GAP} > last) AS ok,
  array_to_string(ls[greatest(first, coalesce(low, first)) : least(last, CASE WHEN one = 1 THEN last ELSE coalesce(high, last) END)], chr(10)) AS body FROM said LEFT JOIN inside USING (qid)),
t AS (SELECT qid, ok, length(name) >= 3 AND name NOT IN ({', '.join(f"'{w}'" for w in T.NOT_NAMES)}) AS claim, contains(body, name) AS held FROM v)
SELECT qid, (NOT ok)::INTEGER AS n_invalid, claim::INTEGER AS n_claims, (claim AND ok AND NOT held)::INTEGER AS n_unsupported, 3 * (NOT ok)::INTEGER + 2 * (claim AND ok AND NOT held)::INTEGER AS penalty FROM t"""
)
def citation_strict_documents(spark, sf_dir):
    reports = cite.check_answers(*cited_documents(spark, sf_dir))
    return reports.select("qid", F.size("invalid").alias("n_invalid"), "n_claims", F.size("unsupported").alias("n_unsupported"), "penalty")


# ---- evaluation ----


@query(
    f"""WITH {_BM25}, {oracle.top('h', 's', TOP)}, {_GOLD}, r AS (SELECT q.qid, min(h.rank) AS rank FROM q LEFT JOIN g USING (qid) LEFT JOIN h ON h.qid = g.qid AND h.doc = g.doc GROUP BY q.qid)
SELECT CASE WHEN GROUPING(t) = 1 THEN '(all)' ELSE t END AS type, count(*) AS n, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) AS mrr,
  round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1 FROM (SELECT *, CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS t FROM r) GROUP BY ROLLUP (t)"""
)
def first_hit_metrics(spark, sf_dir):
    """Gold targets are the first lines of the documents that hold a passage."""
    held = passage_gold(spark, sf_dir)
    hits = bm25_hits(spark, sf_dir).select("qid", F.col("rank").alias("pos"), "doc")
    return evaluate.retrieval_metrics(evaluate.first_ranks(held, hits, doc_chunks(spark, sf_dir)))


def passage_gold(spark, sf_dir) -> DataFrame:
    """(qid, type, targets) of all passages; a passage that no document holds has no target."""
    held = scan.sharing(questions(spark, sf_dir), docs(spark, sf_dir))
    target = F.struct(F.concat(F.lit("doc/"), F.col("doc").cast("string")).alias("path"), F.lit(1).alias("line"))
    held = held.groupBy("qid").agg(F.collect_list(target).alias("targets"))
    none = F.array().cast("array<struct<path:string,line:int>>")
    return questions(spark, sf_dir).join(held, "qid", "left").select("qid", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd").alias("type"), F.coalesce("targets", none).alias("targets"))


@query(
    f"""WITH {_BM25}, {oracle.top('h', 's', 8)}, {_GOLD}, t AS (SELECT g.qid, count(*) AS n, count(*) FILTER (h.rank <= 4) AS topk, count(h.rank) AS baseline, count(*) FILTER (h.rank <= 4 OR h.doc % 2 = 0) AS expand
  FROM g LEFT JOIN h ON h.qid = g.qid AND h.doc = g.doc GROUP BY g.qid),
a AS (SELECT qid, count(*) FILTER (rank > 4 AND doc % 2 = 0) AS added FROM h GROUP BY qid), r AS (SELECT * FROM t LEFT JOIN a USING (qid))
SELECT 'passage' AS type, count(*) AS n, round(avg(coalesce(added, 0)), 6) AS mean_added, {', '.join(f"round(avg({v} / n), 6) AS {v}_recall, round(avg((n = {v})::INTEGER), 6) AS {v}_all" for v in ('topk', 'baseline', 'expand'))} FROM r"""
)
def trace_documents(spark, sf_dir):
    """Trace metrics where an expansion adds the even ones of the next four documents."""
    gold = passage_gold(spark, sf_dir).filter(F.size("targets") > 0).withColumn("type", F.lit("passage"))
    ranked = store.settle(bm25_hits(spark, sf_dir, 8))
    hits = ranked.filter(F.col("rank") <= 4)
    more = ranked.filter((F.col("rank") <= 4) | (F.col("doc") % 2 == 0))
    return evaluate.trace_metrics(gold, doc_chunks(spark, sf_dir), hits, ranked, more).filter(F.col("type") != evaluate.ALL)


@query(
    f"""WITH {_LINES}, t AS (SELECT doc_id, doc_id % 60 AS line, 'doc/' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '/gone' ELSE '' END AS path, ls FROM documents LEFT JOIN l USING (doc_id))
SELECT doc_id AS qid, CASE WHEN doc_id % 11 = 0 THEN 'missing file ' || path ELSE path || ':' || line || ' is out of range or blank' END AS problem FROM t
WHERE doc_id % 11 = 0 OR line < 1 OR ls IS NULL OR line > len(ls) OR regexp_matches(ls[line], '^[\\s\x1c-\x1f\x85\xA0]*$')"""
)
def gold_validation_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    target = F.struct(F.concat(path, F.when(F.col("doc_id") % 11 == 0, F.lit("/gone")).otherwise("")).alias("path"), (F.col("doc_id") % 60).cast("int").alias("line"))
    return evaluate.validate_gold(rows.select(F.col("doc_id").alias("qid"), F.lit("why").alias("type"), F.array(target).alias("targets")), rows.select(path.alias("path"), "text"))


@query(
    f"""WITH {_BM25}, {oracle.top('h', 's', TOP)}, {_GOLD}, r AS (SELECT g.qid, coalesce(max(documents.lang), 'none') AS type, min(h.rank) AS rank FROM g JOIN documents ON doc_id = g.doc LEFT JOIN h ON h.qid = g.qid AND h.doc = g.doc GROUP BY g.qid)
SELECT coalesce(type, '(all)') AS type, count(*) AS n, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) AS mrr,
  round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1 FROM r GROUP BY ROLLUP (type)"""
)
def eval_by_type(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang")
    gold = scan.sharing(questions(spark, sf_dir), docs(spark, sf_dir)).join(langs, "doc")
    ranks = gold.join(bm25_hits(spark, sf_dir).select("qid", "doc", "rank"), ["qid", "doc"], "left").groupBy("qid").agg(F.coalesce(F.max("lang"), F.lit("none")).alias("type"), F.min("rank").alias("rank"))
    return evaluate.retrieval_metrics(ranks)


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) "
       "SELECT event_type, max(n) AS n, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = least(n - 1, floor(0.95 * n)::BIGINT)) AS p95 FROM r GROUP BY event_type")  # fmt: skip
def latency_p50_p95(spark, sf_dir):
    return evaluate.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


# ---- stores and streams ----


_BEFORE = _WINDOWS.replace("FROM documents WHERE text <> ''", "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || 'an old last line' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0) WHERE text <> ''")
_IDS = "SELECT substr(sha1(path || ':' || start_line || '-' || end_line || ':' || text), 1, 16) AS id FROM c WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''"


@query(f"SELECT CASE WHEN b.id IS NULL THEN 'embed' ELSE 'reuse' END AS action, count(*) AS n FROM (WITH {_WINDOWS} {_IDS}) n LEFT JOIN (SELECT DISTINCT id FROM (WITH {_BEFORE} {_IDS})) b ON b.id = n.id GROUP BY 1")
def incremental_reindex(spark, sf_dir):
    """The previous index has every tenth document with another last line and lacks every seventh; changed and new chunks are embedded."""
    rows = files.spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file_ord"), F.coalesce("text", F.lit("")).alias("text"))
    older = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\nan old last line"))).otherwise(F.col("text"))
    settings = engine.Settings(chunker="fixed", chunk_lines=SIZE, chunk_overlap=OVERLAP, mode="dense")
    before = engine.build_index(rows.filter("doc_id % 7 <> 0").withColumn("text", older).drop("doc_id"), settings)
    now = engine.build_index(rows.drop("doc_id"), settings, before)
    actions = [("reuse", now.reused), ("embed", now.vectors.count() - now.reused)]
    return spark.createDataFrame([a for a in actions if a[1]], "action string, n long")


@query("SELECT event_type AS model, count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS repaired, sum(event_id % 5) AS citations, round(avg(value), 6) AS mean_s FROM events GROUP BY event_type")
def run_log_metrics(spark, sf_dir):
    """Run-log metrics over the events as if they were logged runs."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 7 == 0).alias("repaired"), (F.col("event_id") % 5).alias("n_citations"), F.col("value").alias("t_total"))
    return logs.run_metrics(runs)



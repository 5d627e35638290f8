"""Queries over sources, answers and notebooks that the tables make, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as T
from ..operators import cite, evaluate, graph, syntax
from ..sources import files, store
from .queries import _CITED, _WINDOWS, OVERLAP, SIZE, SQL, cited_documents, query, table, table_graph, windows


def resolved(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, nodes and edges of the sources that the tables make."""
    sources, chunks, nodes, parsed = table_graph(spark, sf_dir)
    edges, _ = graph.resolve(nodes, syntax.references(parsed, nodes), syntax.bases(nodes), syntax.imports(sources))
    return chunks, nodes, store.settle(edges)


# ---- symbols ----


@query(
    """SELECT 'of_' || c_custkey AS symbol, 'of_' || c_custkey AS qual, 0 AS tier FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'OF_' || c_custkey, 'of_' || c_custkey, 2 FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT '`of_' || c_custkey || '()`', 'of_' || c_custkey, 0 FROM customer WHERE c_custkey % 4 = 2
UNION ALL SELECT 'N' || n_nationkey || '.go', 'N' || n_nationkey || '.go', 0 FROM nation
UNION ALL SELECT 'rest', 'R' || b.r_regionkey || '.rest', 1 FROM region a, region b"""
)
def symbol_find(spark, sf_dir):
    """Every customer's function by its name, in capitals, as code, or under a name that nothing has; methods whole and by their last part."""
    key = F.col("c_custkey")
    name = F.format_string("of_%d", key)
    spelled = F.when(key % 4 == 0, name).when(key % 4 == 1, F.upper(name)).when(key % 4 == 2, F.concat(F.lit("`"), name, F.lit("()`"))).otherwise(F.concat(F.lit("missing_"), name))
    asked = table(spark, sf_dir, "customer").select(key.cast("long").alias("qid"), spelled.alias("symbol"))
    asked = asked.unionByName(table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("qid"), F.format_string("N%d.go", "n_nationkey").alias("symbol")))
    asked = asked.unionByName(table(spark, sf_dir, "region").select((-1_000_000 - F.col("r_regionkey")).cast("long").alias("qid"), F.lit("rest").alias("symbol")))
    nodes = table_graph(spark, sf_dir)[2]
    return graph.find(nodes, asked).join(nodes.select("id", "qual"), "id").join(asked, "qid").select("symbol", "qual", "tier")


@query()
def similar_names(spark, sf_dir):
    """The makers of all nations, misspelt: the names that look most like them (by a ratio that SQL does not have; tests compare difflib)."""
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.format_string("mkae_%d", "n_nationkey").alias("symbol"))
    return graph.similar(table_graph(spark, sf_dir)[2], asked).join(asked, "qid").select("symbol", "pos", "name")


@query(
    """SELECT r_regionkey AS qid, 'N' || n_nationkey AS node, 1 AS hop, 'R' || r_regionkey AS via, 4 AS line FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT n_regionkey, 'make_' || n_nationkey, 2, 'N' || n_nationkey, 10 FROM nation
UNION ALL SELECT n_regionkey, 'of_' || c_custkey, 3, 'make_' || n_nationkey, 5 FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT -1 - r_regionkey, 'R' || r_regionkey || '.run', 1, 'R' || r_regionkey || '.rest', 3 FROM region
UNION ALL SELECT -1 - n_regionkey, 'N' || n_nationkey || '.go', 2, 'R' || n_regionkey || '.run', 6 FROM nation"""
)
def impact_first_edges(spark, sf_dir):
    """What a change of each region's class, and of its inner method, reaches within three edges, and over which edge first."""
    _, nodes, edges = resolved(spark, sf_dir)
    region = table(spark, sf_dir, "region")
    asked = region.select(F.col("r_regionkey").cast("long").alias("qid"), F.format_string("R%d", "r_regionkey").alias("symbol"))
    asked = asked.unionByName(region.select((-1 - F.col("r_regionkey")).cast("long").alias("qid"), F.format_string("R%d.rest", "r_regionkey").alias("symbol")))
    found = graph.impact_edges(edges, nodes, graph.find(nodes, asked).select("qid", "id"))
    name = lambda c, to: nodes.select(F.col("id").alias(c), F.col("qual").alias(to))
    return found.join(name("id", "node"), "id").join(name("via", "via_name"), "via").select("qid", "node", "hop", F.col("via_name").alias("via"), "line")


@query(
    f"""WITH o AS (SELECT c_nationkey AS qid, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY 'customer_' || c_custkey || '.py') AS pos FROM customer)
SELECT qid, pos, 'of_' || c_custkey AS symbol, 'of_' || c_custkey || ' calls make_' || qid || ' (line 5)' AS reason FROM o WHERE pos <= {2 * graph.EXTRA}
UNION ALL SELECT -1 - n_nationkey, 1, 'R' || n_regionkey, 'inherit of N' || n_nationkey FROM nation"""
)
def graph_expand(spark, sf_dir):
    """Hits on each nation's maker, asked for its callers, and on its class, asked for what it calls: the chunks that the graph adds."""
    chunks, nodes, edges = resolved(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").withColumn("n", F.col("n_nationkey").cast("long"))
    questions = nation.select("n", F.posexplode(F.array(F.format_string("What calls make_%d?", "n"), F.format_string("What does N%d.go call?", "n"))).alias("side", "text"))
    questions = questions.select(F.when(F.col("side") == 0, F.col("n")).otherwise(-1 - F.col("n")).alias("qid"), "text", F.when(F.col("side") == 0, F.format_string("make_%d", "n")).otherwise(F.format_string("N%d", "n")).alias("symbol"))
    detail = F.struct(F.lit(True).alias("symbol"))
    ranked = questions.join(chunks.select("doc", "symbol"), "symbol").select("qid", F.lit(1).alias("pos"), "doc", detail.alias("detail"))
    more = graph.expand(questions.select("qid", "text"), store.settle(ranked), chunks, nodes, edges, k=1)
    return more.join(chunks.select("doc", "symbol"), "doc").select("qid", "pos", "symbol", "reason")


# ---- text ----


@query("SELECT doc_id, md5(regexp_replace('key gsk_' || md5(text)[:9] || ' ' || text, 'gsk_[A-Za-z0-9]{8,}|sk-[A-Za-z0-9_-]{8,}', '[API key hidden]', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def secret_scrub(spark, sf_dir):
    """All texts behind a key of their own, with keys hidden."""
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    said = F.concat(F.lit("key gsk_"), F.substring(F.md5(F.col("text").cast("binary")), 1, 9), F.lit(" "), F.col("text"))
    return rows.select("doc_id", F.md5(T.scrub_keys(said).cast("binary")).alias("digest"))


@query(
    r"""WITH t AS (SELECT conv_id, string_agg(CASE turn % 3 WHEN 0 THEN (turn + 1) || '. "' || text || '"' WHEN 1 THEN '- `' || text || '`' ELSE 'line ' || turn || ': ' || upper(text) END, chr(10) ORDER BY turn) || chr(10) || 'no' || chr(10) || '* ' || min(text) AS said
  FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
l AS (SELECT conv_id, i, string_split(said, chr(10))[i] AS x FROM t, range(1, 1000) r(i) WHERE i <= len(string_split(said, chr(10)))),
c AS (SELECT conv_id, i, trim(regexp_replace(regexp_replace(trim(regexp_replace(x, '^\s*(?:[-*•]|[0-9]+[.):]|line\s*[0-9]+\s*:)\s*', '', 'i')), '^"+|"+$', '', 'g'), '^`+|`+$', '', 'g')) AS q FROM l),
u AS (SELECT conv_id, i, q, row_number() OVER (PARTITION BY conv_id, lower(q) ORDER BY i) AS copy FROM c WHERE length(q) >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS pos FROM u WHERE copy = 1) SELECT conv_id, pos, q AS rewrite FROM k WHERE pos < 3"""
)
def parse_rewrites(spark, sf_dir):
    """The turns of each conversation as a model's list of searches, with numbers, bullets, quotes and repeats: the first three."""
    rows = table(spark, sf_dir, "conversations").filter("text is not null")
    one = F.when(F.col("turn") % 3 == 0, F.concat((F.col("turn") + 1).cast("string"), F.lit('. "'), "text", F.lit('"'))).when(F.col("turn") % 3 == 1, F.concat(F.lit("- `"), "text", F.lit("`"))).otherwise(F.concat(F.lit("line "), F.col("turn").cast("string"), F.lit(": "), T.capitals("text")))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", one.alias("x")))), lambda r: r["x"]), "\n")
    said = rows.groupBy("conv_id").agg(F.concat(listed, F.lit("\nno\n* "), F.min("text")).alias("said"))
    return said.select("conv_id", F.posexplode(T.rewrites("said")).alias("pos", "rewrite"))


@query(
    r"""WITH t AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
c AS (SELECT *, role = 'assistant' AS code, CASE WHEN i % 2 = 0 THEN '%time' || chr(10) ELSE '' END || text AS body FROM t),
l AS (SELECT conv_id, i, code, string_split(body, chr(10)) AS ls FROM c WHERE trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
r AS (SELECT conv_id, i, 0 AS k, CASE WHEN code THEN '# %% cell ' || i ELSE '# %% [markdown] cell ' || i END AS line FROM l
  UNION ALL SELECT conv_id, i, k, CASE WHEN NOT code THEN rtrim('# ' || ls[k]) WHEN regexp_matches(ls[k], '^\s*[%!]') THEN '# ' || ls[k] ELSE ls[k] END FROM l, range(1, 500) x(k) WHERE k <= len(ls)
  UNION ALL SELECT conv_id, i, -1, '' FROM l WHERE i > (SELECT min(i) FROM l m WHERE m.conv_id = l.conv_id))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i, k) AS line_no, line FROM r"""
)
def notebook_view(spark, sf_dir):
    """Each conversation as a notebook: prose of the user, code of the assistant, every second cell behind a magic."""
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    cells = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    source = lambda c, i: F.concat(F.when(i % 2 == 1, F.lit("%time\n")).otherwise(F.lit("")), c["text"])
    cell = lambda c, i: F.struct(F.when(c["role"] == "assistant", "code").otherwise("markdown").alias("cell_type"), source(c, i).alias("source"))
    books = rows.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(cells, cell).alias("cells"))).alias("raw"))
    return books.select("conv_id", F.posexplode(T.lines(files.notebook_text("raw"))).alias("i", "line")).select("conv_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


# ---- answers ----


@query(
    """SELECT doc_id AS qid, 'doc/' || doc_id || '.txt' AS path, doc_id % 50 + 1 AS first, doc_id % 50 + 9 AS last FROM documents
UNION ALL SELECT doc_id, 'src/m' || doc_id % 9 || '.py', doc_id % 7 + 3, doc_id % 7 + 3 FROM documents"""
)
def citation_parse(spark, sf_dir):
    """Answers that cite a range in full-width brackets and a line in backticks, among brackets that are none."""
    d = table(spark, sf_dir, "documents")
    text = F.format_string("See [1] and 【doc/%d.txt:%d-%d】, not [here] or `name`; also `src/m%d.py:%d`.", "doc_id", F.col("doc_id") % 50 + 1, F.col("doc_id") % 50 + 9, F.col("doc_id") % 9, F.col("doc_id") % 7 + 3)
    return d.select(F.col("doc_id").alias("qid"), F.explode(T.citations(T.normalize_citations(text))).alias("c")).select("qid", "c.*")


def drafts_and_revisions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers about documents and their revisions, and the windows of the documents as what was shown.

    A draft cites nothing, a line that exists, one that doesn't, or both; a revision cites a line that exists, gives up, or is missing.
    """
    d = table(spark, sf_dir, "documents").filter("text <> ''").select(F.col("doc_id").alias("qid"))
    good, bad = F.format_string("[doc/%d.txt:1-1]", "qid"), F.format_string("[doc/%d.txt:900001-900002]", "qid")
    kind = F.col("qid") % 4
    draft = F.when(kind == 0, F.lit("It is so.")).when(kind == 1, F.concat(F.lit("It is so "), good)).when(kind == 2, F.concat(F.lit("It is so "), bad)).otherwise(F.concat(F.lit("It is so "), good, F.lit(" and "), bad))
    drafts = d.select("qid", F.concat(draft, F.lit(".")).alias("text"))
    revisions = d.filter("qid % 3 <> 2").select("qid", F.when(F.col("qid") % 3 == 0, F.concat(F.lit("It is so "), good)).otherwise(F.lit("I could not find this in the text.")).alias("text"))
    shown = windows(spark, sf_dir).select(F.col("doc_id").alias("qid"), F.col("chunk_no").alias("pos"), F.concat("path", F.lit(".txt")).alias("path"), "start_line", "end_line", "text", F.lit("").alias("symbol"))
    return drafts, revisions, shown


_DRAFTS = f"""{_WINDOWS}, one AS (SELECT doc_id AS qid, max((chunk_no = 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')::INTEGER) AS held FROM c GROUP BY doc_id),
a AS (SELECT doc_id AS qid, doc_id % 4 AS kind, doc_id % 3 AS nxt, coalesce(held, 0) = 1 AS held FROM documents LEFT JOIN one ON qid = doc_id WHERE text <> ''),
p AS (SELECT *, CASE kind WHEN 0 THEN 3 WHEN 1 THEN 3 * (NOT held)::INTEGER WHEN 2 THEN 3 ELSE 3 + 3 * (NOT held)::INTEGER END AS old, CASE nxt WHEN 0 THEN 3 * (NOT held)::INTEGER WHEN 1 THEN 0 END AS new, kind IN (1, 3) AND held AS had FROM a)"""


@query(f"WITH {_DRAFTS} SELECT qid, nxt <> 2 AND NOT (nxt = 1 AND had) AND new < old AS repaired FROM p")
def repair_choice(spark, sf_dir):
    """Which drafts are replaced by their revisions."""
    drafts, revisions, shown = drafts_and_revisions(spark, sf_dir)
    return cite.choose_repairs(cite.check_answers(drafts, shown), cite.check_answers(revisions, shown))


@query(
    f"""WITH {_DRAFTS}, m AS (SELECT *, kind IN (1, 3) AND held AND qid % 5 < 2 AS hit, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS cites,
  CASE kind WHEN 0 THEN 0 WHEN 1 THEN (NOT held)::INTEGER WHEN 2 THEN 1 ELSE 1 + (NOT held)::INTEGER END AS wrong, CASE kind WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 1.5 END AS width FROM p)
SELECT count(*) AS n, round(avg(hit::INTEGER), 6) AS gold_cited, round(coalesce((sum(cites) - sum(wrong)) / nullif(sum(cites), 0), 0), 6) AS valid_rate, 0.0 AS claims_cited, 0.0 AS unsupported_per_answer,
  round(avg(width), 6) AS mean_width, count(*) FILTER (qid % 6 = 0) AS repaired FROM m"""
)
def answer_eval(spark, sf_dir):
    """Answer metrics of all drafts; gold is the first line of two documents in five, the second line of the others."""
    drafts, _, shown = drafts_and_revisions(spark, sf_dir)
    target = F.struct(F.format_string("doc/%d.txt", "qid").alias("path"), F.when(F.col("qid") % 5 < 2, 1).otherwise(2).alias("line"))
    gold = drafts.select("qid", F.lit("why").alias("type"), F.array(target).alias("targets"))
    return evaluate.answer_metrics(gold, drafts.withColumn("repaired", F.col("qid") % 6 == 0), cite.check_answers(drafts, shown))


# ---- table functions ----


@query(SQL["fixed_window_chunks"])
def sql_line_windows(spark, sf_dir):
    """The documents' windows by a table function in SQL."""
    tables.register(spark)
    files.spread(table(spark, sf_dir, "documents")).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text").createOrReplaceTempView("lodestar_files")
    rows = spark.sql(f"SELECT * FROM line_windows(TABLE(SELECT path, text FROM lodestar_files), {SIZE}, {OVERLAP})")
    return rows.select(F.substring("path", 5, 40).cast("long").alias("doc_id"), "chunk_no", "start_line", "end_line", "id")


@query(f"WITH {_CITED} SELECT qid, 1 AS n_citations, CASE WHEN coalesce(one, 0) = 1 THEN '' ELSE 'doc/' || qid || '.txt:' || first || '-' || last END AS invalid FROM said LEFT JOIN inside USING (qid)")
def sql_citation_check(spark, sf_dir):
    """Citations of the answers about documents, checked by a table function in SQL that meets each question's rows together."""
    tables.register(spark)
    answers, shown = cited_documents(spark, sf_dir)
    answers.createOrReplaceTempView("lodestar_answers")
    shown.createOrReplaceTempView("lodestar_shown")
    return spark.sql("""WITH asked AS (SELECT a.qid, a.text AS answer, s.path, s.start_line, s.end_line FROM lodestar_answers a LEFT JOIN lodestar_shown s ON s.qid = a.qid)
SELECT * FROM citation_check(TABLE(asked) PARTITION BY qid)""")

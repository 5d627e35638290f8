"""Operator 10: Merkle fixity audit of WARC replicas.

Records are keyed by file and id; each one's SHA-256 is a leaf. The records of an id form a slot, ``FANOUT`` neighbouring slots a
node, and so on up to one root a file. A node's digest covers its children's places, digests and the lengths of their offset
ranges in order, so a record that is lost or added changes its own branch and no other, although everything behind it moves.
Two replicas are compared by their roots; only below roots that differ the children are compared, level by level, down to the
records that are corrupt, lost or added. Offsets follow on the way down, from the lengths of the siblings before.

Scale: record bytes are hashed where they are read and never move; what is shuffled is one digest a record, kept in the
shared checkpoint folder, so that replicas are read once. A slot's digest is the hash of sums over its leaves' digests, which
combine before the shuffle, so an id that a third of all records share is no large group; every level above groups
``FANOUT`` nodes. Both replicas go up the tree together, and findings are rows of their own, so nothing grows with a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

FANOUT, LEVELS, FILE_PAGES = 8, 3, 256
#: Hex digits of a digest that are summed as one number, and how many such numbers there are.
DIGITS, PARTS = 15, 4


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.0 response record as binary. Null url and html count as empty."""
    body = F.coalesce(html.cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def to_records(pages: DataFrame) -> DataFrame:
    """(file, page_id, record) for ``pages`` (page_id, url, html): ``FILE_PAGES`` consecutive ids a file.

    Rows without an id go to files with negative numbers by hash of their content. Repeated rows are records of their own.
    """
    page = F.col("page_id").cast("long")
    lost = -1 - F.pmod(F.xxhash64(F.col("url").cast("string"), F.col("html").cast("string")), F.lit(1 << 20))
    return pages.select(F.coalesce(F.floor(page / FILE_PAGES), lost).alias("file"), page.alias("page_id"), record_bytes(page, F.col("url"), F.col("html")).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """(file, slot, page_id, digest, size, copies): equal records with one id are one leaf with its copies.

    A slot is the id's place in its file; records without an id take one by their digest.
    """
    hashed = records.select("file", "page_id", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("digest"))
    hashed = hashed.withColumn("slot", F.pmod(F.coalesce("page_id", F.xxhash64("digest")), F.lit(FILE_PAGES)))
    return hashed.groupBy("file", "slot", "page_id", "digest", "size").agg(F.count("*").alias("copies"))


def slots(found: DataFrame) -> DataFrame:
    """(file, node, a, b) of leaves with their replica (``side``): size, records and digest of each slot in either, null where it has none."""
    copies = F.col("copies")
    number = lambda i: F.conv(F.substring("digest", 1 + DIGITS * i, DIGITS), 16, 10).cast("long").cast("decimal(38,0)")
    sums = [F.sum(number(i) * copies).cast("decimal(38,0)").cast("string") for i in range(PARTS)]
    records, size = F.sum(copies), F.sum(F.col("size") * copies)
    digest = F.sha2(F.concat_ws(":", *sums, records.cast("string"), size.cast("string")), 256)
    each = found.groupBy("file", F.col("slot").alias("node"), "side").agg(F.struct(size.alias("size"), records.alias("records"), digest.alias("digest")).alias("n"))
    return each.groupBy("file", "node").agg(*(F.max(F.when(F.col("side") == side, F.col("n"))).alias(side) for side in "ab"))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above ``nodes`` (file, node, a, b)."""

    def joined(side: str) -> Column:
        n = F.col(side)
        child = F.when(n.isNotNull(), F.struct("node", F.concat_ws(":", F.col("node").cast("string"), n["size"].cast("string"), n["digest"]).alias("d")))
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: c["d"]), ",")
        found = F.struct(F.sum(n["size"]).alias("size"), F.sum(n["records"]).alias("records"), F.sha2(listed, 256).alias("digest"))
        return F.when(F.count(n) > 0, found).alias(side)

    return nodes.groupBy("file", F.floor(F.col("node") / FANOUT).alias("above")).agg(joined("a"), joined("b")).withColumnRenamed("above", "node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Compare replicas (file, page_id, record): one row for each finding, and one for each file without any.

    Columns: file, root_a, root_b (null where a replica lacks the file), records_a, records_b, compared (pairs of nodes and leaves looked
    at), and of a finding page_id, start, stop (the offset range of that id's records in the replica that has it), record (its
    SHA-256), copies (how many more that replica has) and state: "lost" if the first replica has it, "added" if the second has.
    A changed record is both under one id. State is "intact" on the row of a file without findings. Records are
    ordered by id in a file; equal records count by their number. Empty tables give no rows.
    """
    sides = [leaves(side).withColumn("side", F.lit(name)) for side, name in ((primary, "a"), (replica, "b"))]
    found = cut_lineage(sides[0].unionByName(sides[1]))
    levels = [cut_lineage(slots(found))]
    for _ in range(LEVELS):
        levels.append(cut_lineage(parents(levels[-1])))
    differs = ~F.col("a.digest").eqNullSafe(F.col("b.digest"))
    zero = F.lit(0).cast("long")
    looked, bad = [levels[-1].select("file")], levels[-1].filter(differs).select("file", "node", zero.alias("start_a"), zero.alias("start_b"))
    for level in reversed(levels[:-1]):
        above = bad.withColumnsRenamed({"node": "above", "start_a": "from_a", "start_b": "from_b"})
        below = level.withColumn("above", F.floor(F.col("node") / FANOUT)).join(above, ["file", "above"])
        before = Window.partitionBy("file", "above").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        starts = [(F.col(f"from_{s}") + F.coalesce(F.sum(F.col(s)["size"]).over(before), zero)).alias(f"start_{s}") for s in "ab"]
        below = cut_lineage(below.select("file", "node", "a", "b", *starts))
        looked.append(below.select("file"))
        bad = below.filter(differs)
        if level is not levels[0]:
            bad = bad.select("file", "node", "start_a", "start_b")
    ranges = bad.select("file", F.col("node").alias("slot"), *(F.struct(F.col(f"start_{s}").alias("start"), (F.col(f"start_{s}") + F.col(s)["size"]).alias("stop")).alias(s) for s in "ab"))
    more = F.sum(F.when(F.col("side") == "a", F.col("copies")).otherwise(-F.col("copies")))
    pairs = found.join(ranges.select("file", "slot"), ["file", "slot"], "left_semi").groupBy("file", "slot", "page_id", "digest").agg(more.alias("more"))
    pairs = cut_lineage(pairs)
    looked.append(pairs.select("file"))
    lost = F.col("more") > 0
    range_of = F.when(lost, F.col("a")).otherwise(F.col("b"))
    findings = pairs.filter("more <> 0").join(ranges, ["file", "slot"]).select(
        "file", "page_id", range_of["start"].alias("start"), range_of["stop"].alias("stop"), F.col("digest").alias("record"),
        F.abs("more").alias("copies"), F.when(lost, F.lit("lost")).otherwise(F.lit("added")).alias("state"),
    )
    compared = reduce(DataFrame.unionByName, looked).groupBy("file").agg(F.count("*").alias("compared"))
    count = lambda side: F.coalesce(F.col(side)["records"], zero).alias(f"records_{side}")
    files = levels[-1].select("file", F.col("a.digest").alias("root_a"), F.col("b.digest").alias("root_b"), count("a"), count("b"))
    files = cut_lineage(files.join(compared, "file"))
    intact = files.filter("root_a <=> root_b").withColumn("state", F.lit("intact"))
    return files.join(findings, "file").unionByName(intact, allowMissingColumns=True)


def flip_byte(record: Column, fault: Column) -> Column:
    """A replica's copy: where ``fault`` holds, the record's last byte is another one."""
    kept = F.substring(record, 1, F.octet_length(record) - 1)
    return F.when(fault, F.concat(kept, F.lit("\t").cast("binary"))).otherwise(record)


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit all pages, as WARC records, against a replica in which records with some ids carry one other byte, some are lost and
    some are there twice."""
    primary = to_records(table(spark, sf_dir, "pages"))
    code = F.coalesce(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2), F.lit(""))
    kept = primary.filter(code != "0b").withColumn("record", flip_byte(F.col("record"), code == "0a"))
    return audit(primary, kept.unionByName(primary.filter(code == "0c")))


def _sql() -> str:
    record = "'WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nWARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>\r\nContent-Length: ' || strlen(coalesce(html, '')) || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n'"
    sums = " || ':' || ".join(f"sum(('0x' || substr(digest, {1 + DIGITS * i}, {DIGITS}))::BIGINT::HUGEINT * copies)::VARCHAR" for i in range(PARTS))
    leaf = lambda s, rows: f"""{s}l AS (SELECT file, page_id % {FILE_PAGES} AS slot, page_id, sha256(r) AS digest, strlen(r) AS size, count(*) AS copies FROM ({rows}) GROUP BY ALL),
{s}0 AS (SELECT file, slot AS node, sum(size * copies)::BIGINT AS size, sum(copies)::BIGINT AS records,
  sha256({sums} || ':' || sum(copies)::BIGINT || ':' || sum(size * copies)::BIGINT) AS digest FROM {s}l GROUP BY file, slot)"""  # noqa: E731
    above = lambda s, k: f"""{s}{k} AS (SELECT file, node // {FANOUT} AS node, sum(size)::BIGINT AS size, sum(records)::BIGINT AS records,
  sha256(string_agg(node || ':' || size || ':' || digest, ',' ORDER BY node)) AS digest FROM {s}{k - 1} GROUP BY file, node // {FANOUT})"""  # noqa: E731
    pair = lambda k: f"""c{k} AS (SELECT file, node, a.digest AS da, b.digest AS db, a.size AS za, b.size AS zb, a.records AS na, b.records AS nb,
  a.digest IS DISTINCT FROM b.digest AS bad FROM a{k} a FULL JOIN b{k} b USING (file, node))"""  # noqa: E731
    start = lambda s: f"(u.s{s} + coalesce(sum(c.z{s}) OVER w, 0))::BIGINT AS s{s}"
    down = lambda k: f"""d{k} AS (SELECT c.*, {start('a')}, {start('b')} FROM c{k} c JOIN d{k + 1} u ON u.bad AND c.file = u.file AND c.node // {FANOUT} = u.node
  WINDOW w AS (PARTITION BY c.file, c.node // {FANOUT} ORDER BY c.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""  # noqa: E731
    parts = [f"records AS (SELECT floor(page_id / {FILE_PAGES})::BIGINT AS file, page_id, {record} AS r, substr(md5(page_id::VARCHAR), 1, 2) AS code FROM pages)"]
    parts += [leaf("a", "SELECT file, page_id, r FROM records")]
    parts += [leaf("b", "SELECT file, page_id, CASE WHEN code = '0a' THEN left(r, length(r) - 1) || chr(9) ELSE r END AS r FROM records WHERE code <> '0b' UNION ALL SELECT file, page_id, r FROM records WHERE code = '0c'")]
    parts += [above(s, k) for s in "ab" for k in range(1, LEVELS + 1)] + [pair(k) for k in range(LEVELS + 1)]
    parts += [f"d{LEVELS} AS (SELECT *, 0::BIGINT AS sa, 0::BIGINT AS sb FROM c{LEVELS})"] + [down(k) for k in reversed(range(LEVELS))]
    parts += ["""met AS (SELECT file, slot, page_id, digest, sum(copies)::BIGINT AS more FROM (SELECT * EXCLUDE (copies), copies FROM al UNION ALL SELECT * EXCLUDE (copies), -copies FROM bl)
  SEMI JOIN (SELECT file, node AS slot FROM d0 WHERE bad) USING (file, slot) GROUP BY ALL)"""]
    looked = " UNION ALL ".join([*(f"SELECT file FROM d{k}" for k in range(LEVELS + 1)), "SELECT file FROM met"])
    return f"""WITH {", ".join(parts)}, looked AS (SELECT file, count(*) AS compared FROM ({looked}) GROUP BY file),
finding AS (SELECT x.file, page_id, CASE WHEN more > 0 THEN sa ELSE sb END AS start, CASE WHEN more > 0 THEN sa + za ELSE sb + zb END AS stop, digest AS record, abs(more) AS copies,
  CASE WHEN more > 0 THEN 'lost' ELSE 'added' END AS state FROM met x JOIN d0 d ON d.bad AND x.file = d.file AND x.slot = d.node WHERE more <> 0)
SELECT r.file, r.da AS root_a, r.db AS root_b, coalesce(r.na, 0) AS records_a, coalesce(r.nb, 0) AS records_b, compared, page_id, start, stop, record, copies, coalesce(state, 'intact') AS state
FROM d{LEVELS} r JOIN looked USING (file) LEFT JOIN finding f ON f.file = r.file"""


OP10_SQL = _sql()

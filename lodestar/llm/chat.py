"""Operator 2: multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and everybody else
as a named user; system turns stay system turns. The result has one row for each (conversation, perspective, turn):
the rendered segment, where it lies in that rendering, and the part of it that carries loss (the assistant's own words
and the end mark). Concatenating the segments of a perspective by ``start`` gives its text.

Scale: where a segment begins follows from lengths alone, so positions are worked out on rows without texts, and texts meet them
once. Rows are dealt by ranges of their order, which cuts a conversation of any size into pieces of a task's size; sums run
inside pieces and over the pieces of a conversation. In a rendering all other speakers' segments have the same lengths
as in any other, so a position is the sum of those lengths and, for the assistant's own segments before it, of the
difference that the shorter head makes. No task holds a whole conversation, nor all rows of one turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

SYSTEM, UNKNOWN = "system", "unknown"
END = "<|im_end|>\n"


def _head(role: Column, name: Column | None = None) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("") if name is None else F.concat(F.lit(" name="), name), F.lit("\n"))


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, seq, role, name, segment, start, loss_start, loss_end) for ``turns`` (conv_id, turn, role, text).

    Order within a conversation: turn (nulls first), role, MD5 of the text; repeated rows stay, ``seq`` numbers the equal ones from 0. A null or
    blank role is the speaker "unknown"; null text is empty. Rows with a null conv_id form one conversation. A conversation
    of system turns alone has one rendering with a null perspective. ``start`` and the loss bounds count code points from the
    rendering's first character; segments of other speakers have null loss bounds. An empty table gives no rows.
    Other columns are ignored.
    """
    role = F.lower(F.trim(F.col("role").cast("string")))
    conv = F.col("conv_id").cast("long")
    rows = turns.select(
        conv.isNull().alias("nameless"),
        F.coalesce(conv, F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(role.isNull() | (role == ""), F.lit(UNKNOWN)).otherwise(role).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.groupBy("nameless", "conv", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
    rows = cut_lineage(rows.withColumn("id", F.monotonically_increasing_id()))
    by_system, by_assistant, by_user = _head(F.lit(SYSTEM)), _head(F.lit("assistant")), lambda c: _head(F.lit("user"), F.col(c))
    head = F.when(F.col("speaker") == SYSTEM, by_system).otherwise(by_user("speaker"))
    size = (F.length(head) + F.length("text") + len(END)).cast("long")
    party, order = ["nameless", "conv"], ["nameless", "conv", F.asc_nulls_first("turn"), "speaker", "hash"]
    sized = rows.select("id", *party, "turn", "speaker", F.md5(F.col("text").cast("binary")).alias("hash"), "copies", size.alias("size"))
    placed = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = cut_lineage(placed.select("id", *party, "speaker", "copies", "size", "at")).withColumn("piece", F.shiftright("at", 33))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    pieces = placed.groupBy(*party, "piece").agg(F.sum(F.col("size") * F.col("copies")).alias("total"))
    pieces = pieces.select(*party, "piece", before("total", earlier(*party).orderBy("piece")).alias("base"))
    said = placed.filter(F.col("speaker") != SYSTEM).groupBy(*party, "piece", F.col("speaker").alias("perspective")).agg(F.sum("copies").alias("n"))
    seats = pieces.join(said.select(*party, "perspective").distinct(), party, "left").join(said, [*party, "piece", "perspective"], "left")
    own_base = before(F.coalesce("n", F.lit(0)), earlier(*party, "perspective").orderBy("piece"))
    seats = cut_lineage(seats.select(*party, "piece", "perspective", "base", own_base.alias("own_base")))
    shift = F.coalesce(F.length(by_assistant) - F.length(by_user("perspective")), F.lit(0))
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    within = earlier(*party, "piece", "perspective").orderBy("at")
    own_before = F.col("own_base") + before(F.when(own, F.col("copies")).otherwise(0), within)
    start = F.col("base") + before(F.col("size") * F.col("copies"), within) + shift * own_before
    seen = placed.join(seats, [*party, "piece"]).select("id", "perspective", start.alias("first"))
    seen = rows.join(seen, "id").withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    head = F.when(F.col("speaker") == SYSTEM, by_system).when(own, by_assistant).otherwise(by_user("speaker"))
    segment = F.concat("head", "text", F.lit(END))
    seen = seen.withColumn("head", head).withColumn("segment", segment).withColumn("start", F.col("first") + F.col("seq") * F.length("segment"))
    return seen.select(
        F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"), "perspective", "turn", "seq",
        F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.when((F.col("speaker") != SYSTEM) & ~own, F.col("speaker")).alias("name"), "segment", "start",
        F.when(own, F.col("start") + F.length("head")).alias("loss_start"), F.when(own, F.col("start") + F.length("segment")).alias("loss_end"),
    )


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH rows AS (
  SELECT conv_id, turn, CASE WHEN role IS NULL OR trim(role) = '' THEN 'unknown' ELSE lower(trim(role)) END AS speaker, coalesce(text, '') AS text
  FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, speaker, text) - 1 AS seq FROM rows),
seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker <> 'system'),
seen AS (
  SELECT n.*, s.perspective,
    CASE WHEN n.speaker = 'system' THEN 'system' WHEN n.speaker = s.perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN n.speaker <> 'system' AND n.speaker IS DISTINCT FROM s.perspective THEN n.speaker END AS name
  FROM numbered n LEFT JOIN seats s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
headed AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM seen),
cut AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(text), seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM cut)
SELECT conv_id, perspective, turn, seq, role, name, segment, start,
  CASE WHEN role = 'assistant' THEN start + length(head) END AS loss_start,
  CASE WHEN role = 'assistant' THEN start + length(segment) END AS loss_end
FROM placed
"""

"""Line windows, chunk ids and index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def embed_text(path: Column, kind: Column, symbol: Column, context: Column, body: Column) -> Column:
    """What is indexed of a chunk: its text, under a header with file, kind and symbol if it has a symbol."""
    head = F.concat(F.lit("# file: "), path, F.lit("\n# "), kind, F.lit(": "), symbol, F.lit("\n"))
    more = F.when(context != "", F.concat(context, F.lit("\n"))).otherwise("")
    return F.when(symbol == "", body).otherwise(F.concat(head, more, body))


def chunk_id(path: Column, start: Column, end: Column, embedded: Column) -> Column:
    return F.substring(F.sha1(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), embedded)), 1, 16)


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def fixed_windows(files: DataFrame, size: int = 60, overlap: int = 15) -> DataFrame:
    """Chunks of ``files`` (path, text): windows of ``size`` lines that share ``overlap`` lines with the one before.

    Blank windows are left out, and none begins after one has reached the end. Other columns of ``files`` are kept.
    A projection and a generator: no shuffle.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    step = size - overlap
    # no text, no line; a filter on the lines would work them out once more, below the shuffle that deals the files
    rows = files.filter(F.coalesce(F.col("text"), F.lit("")) != "").withColumn("_lines", T.lines("text")).withColumn("_n", F.size("_lines"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_no") * step
    body = F.slice("_lines", start + 1, F.lit(size))
    rows = rows.withColumn("text", F.array_join(body, "\n")).withColumn("start_line", start + 1).withColumn("end_line", F.least(start + size, F.col("_n")))
    rows = rows.filter(T.strip(F.col("text")) != "").drop("_lines", "_n")
    none = F.lit("")
    rows = rows.withColumns({"symbol": none, "kind": F.lit("window"), "parent": none, "context": none})
    return rows.withColumn("id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")))


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, files, mean and median of chunk lines."""
    n = F.col("end_line") - F.col("start_line") + 1
    return chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("path").alias("n_files"), F.avg(n).alias("mean_lines"), F.median(n).alias("median_lines"))

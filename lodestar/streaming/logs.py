"""Streams over append-only logs, and micro-batches that keep an index up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RUN_SCHEMA = (
    "ts timestamp, qid long, question string, model string, prompt_id string, prompt_hash string, n_used int, n_citations int, invalid int, repaired boolean, "
    "t_retrieve double, t_generate double, t_total double"
)


def read_runs(spark: SparkSession, folder: str, files_each: int = 64) -> DataFrame:
    """A stream of run-log records that appear in ``folder`` as JSON lines."""
    return spark.readStream.schema(RUN_SCHEMA).option("maxFilesPerTrigger", files_each).json(folder)


def run_metrics(runs: DataFrame) -> DataFrame:
    """Answers, repairs and the mean time for each model; the same for a stream and a table."""
    return runs.groupBy("model").agg(F.count("*").alias("n"), F.count_if("repaired").alias("repaired"), F.sum("n_citations").alias("citations"), F.round(F.avg("t_total"), 6).alias("mean_s"))


def follow(runs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep :func:`run_metrics` of a stream in the memory table ``table``."""
    return run_metrics(runs).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()


def keep_vectors(chunks: DataFrame, store: str, embed, checkpoint: str, model: str) -> StreamingQuery:
    """Embed the chunks (id, text) of a stream that ``store`` lacks and append their vectors (id, model, vec).

    Each batch is written to a folder of its own number, so that a batch that runs again replaces itself.
    """
    from pyspark.errors import AnalysisException

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = rows.dropDuplicates(["id"])
        try:
            known = spark.read.parquet(store).filter((F.col("model") == model) & (F.col("batch") < number))
            new = new.join(known.select("id"), "id", "left_anti")
        except AnalysisException:
            pass  # the first batch: there is no store yet
        embed(new).withColumn("model", F.lit(model)).select("id", "model", "vec").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

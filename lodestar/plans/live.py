"""Answers while they are made: events as lines of JSON (qid, seq, event, body) in a folder, which a table or a stream reads.

The order of an answer's events is sources, token, token, ..., repair, done. Tokens are written one by one by the task that hears them, in a
file a question, so whoever follows the folder sees the first one before the model has written the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine, models

EVENTS = "qid long, seq long, event string, body string"


def watcher(folder: str) -> Callable[[str, int, DataFrame], None]:
    """What :func:`.engine.answer` tells, appended to ``folder``."""

    def tell(event: str, place: int, rows: DataFrame) -> None:
        rows.select("qid", F.lit(place).cast("long").alias("seq"), F.lit(event).alias("event"), "body").write.mode("append").json(f"{folder}/{event}")

    return tell


def answer(index: engine.Index, questions: DataFrame, model: models.Model, folder: str, settings: engine.Settings | None = None, **more) -> DataFrame:
    """:func:`.engine.answer` by ``model``, told in ``folder`` while it goes on."""
    drafts, repairs = models.generator(model, live=f"{folder}/token"), models.generator(model)
    return engine.answer(index, questions, drafts, settings, repairer=repairs, watch=watcher(folder), **more)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What is told so far, a line that is half written left out."""
    rows = spark.read.schema(EVENTS).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(folder)
    return rows.filter("event is not null")


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """Events of finished files as a stream."""
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).json(folder)

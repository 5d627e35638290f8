"""Where indexes, logs and cached answers live, and what changed since the last index."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """``df`` written into the cluster's shared checkpoint folder and read from there, so that ids given once stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written into the cluster's shared folder as Parquet and read from there: a large table takes a small part of what :func:`settle`
    writes, and a reader of some columns reads no others. It stays, as what is settled does."""
    folder = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows of a table that are broadcast to a larger one.
FEW = 500_000


def few(rows: DataFrame) -> DataFrame:
    """``rows`` settled, and broadcast unless they are many: a table that meets a few hits or words is then not shuffled. Spark does not know
    the size of what was settled."""
    rows = settle(rows)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a session on this machine alone gets one of its own."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or _local_folder(context.master))
    return named or context.getCheckpointDir()


def _local_folder(master: str) -> str:
    """A folder of this machine, which only a session on this machine can share."""
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="lodestar-checkpoint-")


def by_shelf(rows: DataFrame) -> DataFrameWriter:
    """A writer of ``rows`` (shelf, ...) in one folder a shelf, sorted in their files by the columns that follow, so that a reader of some
    shelves reads no others, and skips what the statistics of a file rule out."""
    first = [c for c in rows.columns if c != "shelf"][:2]
    return rows.repartition("shelf").sortWithinPartitions("shelf", *first).write.partitionBy("shelf")


class _Folder:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.path)) if self.files.exists(self.path) else []

    def delete(self) -> None:
        self.files.delete(self.path, True)


def is_file(spark: SparkSession, path: str) -> bool:
    place = _Folder(spark, path)
    return place.files.exists(place.path) and place.files.getFileStatus(place.path).isFile()


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the complete versions of an index, the newest last: those whose mark is written."""
    return [n for n in _Folder(spark, f"{folder}/marks").names() if n.startswith("v") and "_SUCCESS" in _Folder(spark, f"{folder}/marks/{n}").names()]


def save_index(folder: str, meta: dict, **tables: DataFrame | None) -> None:
    """Write an index as a new version beside the one that is there: its tables first, its mark with ``meta`` last.

    Until the mark is written the older version is the index, so a save that fails loses nothing, and an index can be saved where it
    was loaded from. The version before stays for its readers; those before that are deleted.
    """
    spark = next(t for t in tables.values() if t is not None).sparkSession
    older = _versions(spark, folder)
    number = int(older[-1][1:9]) + 1 if older else 1
    name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
    for table, rows in tables.items():
        if rows is not None:
            (by_shelf(rows) if "shelf" in rows.columns else rows.write).parquet(f"{folder}/versions/{name}/{table}")
    spark.createDataFrame([{k: str(v) for k, v in meta.items()}]).coalesce(1).write.json(f"{folder}/marks/{name}")
    for kind in ("marks", "versions"):
        for old in _Folder(spark, f"{folder}/{kind}").names():
            if old not in (name, *older[-1:]) and old[:9] < name[:9]:
                _Folder(spark, f"{folder}/{kind}/{old}").delete()


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of the newest complete version of an index and its ``meta``; without any a FileNotFoundError."""
    found = _versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"no complete index in {folder}")
    tables = _Folder(spark, f"{folder}/versions/{found[-1]}").names()
    return {"meta": spark.read.json(f"{folder}/marks/{found[-1]}")} | {name: spark.read.parquet(f"{folder}/versions/{found[-1]}/{name}") for name in tables}


def workspace(spark: SparkSession, root: str) -> DataFrame:
    """(id, name, folder, model, n_chunks, built_at) of the complete indexes in the folders of ``root``: their marks are read at once."""
    newest = {f"{root}/{name}/marks/{found[-1]}": (name, f"{root}/{name}") for name in _Folder(spark, root).names() if (found := _versions(spark, f"{root}/{name}"))}
    places = spark.createDataFrame([(name, folder, mark.rsplit("/", 1)[1]) for mark, (name, folder) in newest.items()], "name string, folder string, at string")
    if not newest:
        return catalog(places).select("id", "name", "folder", F.lit(None).cast("string").alias("model"), F.lit(0).cast("long").alias("n_chunks"), F.lit(None).cast("string").alias("built_at"))
    marks = spark.read.schema("model string, n_chunks string, built_at string").json(list(newest))
    marks = marks.select(F.regexp_extract(F.col("_metadata.file_path"), "/marks/([^/]+)/[^/]*$", 1).alias("at"), "model", F.coalesce(F.col("n_chunks").cast("long"), F.lit(0)).alias("n_chunks"), "built_at")
    return catalog(places.join(marks, "at")).select("id", "name", "folder", "model", "n_chunks", "built_at")


def append_log(rows: DataFrame, folder: str) -> None:
    """Append records to a JSON-lines log, one file a task."""
    rows.write.mode("append").json(folder)


def stale(chunks: DataFrame, previous: DataFrame | None, model: str) -> tuple[DataFrame, DataFrame | None]:
    """Chunks to embed, and vectors (id, model, ...) of the previous index that can be used again: equal id and model."""
    if previous is None:
        return chunks, None
    known = previous.filter(F.col("model") == model)
    return chunks.join(known.select("id"), "id", "left_anti"), known.join(chunks.select("id").distinct(), "id", "left_semi")


def cached_answers(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers that the cache (key, answer) holds for ``requests`` (qid, key, ...), and the requests it misses."""
    return requests.join(cache, "key"), requests.join(cache.select("key"), "key", "left_anti")


def catalog(folders: DataFrame) -> DataFrame:
    """(id, name, folder, has_meta) with ids from names; repeated ids get -2, -3, ... in the order of folders."""
    from pyspark.sql import Window

    from ..functions.text import slug

    rows = folders.withColumn("_id", slug("name"))
    n = F.row_number().over(Window.partitionBy("_id").orderBy("folder"))
    return rows.withColumn("id", F.when(n == 1, F.col("_id")).otherwise(F.concat("_id", F.lit("-"), n.cast("string")))).drop("_id")

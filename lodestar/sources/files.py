"""Source trees, notebooks, gold sets and result logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import store

# Folders that hold no sources.
EXCLUDED_DIRS = (".git", "__pycache__", ".venv", "venv", "node_modules", "build", "dist", ".tox", ".mypy_cache")
SUFFIXES, MAX_BYTES, MAX_NOTEBOOK_BYTES, ROW_GROUP = (".py", ".ipynb"), 500_000, 20_000_000, 128 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose rows take long to work on: a small one in fewer files than there are cores is dealt over them, as a file may be
    one row group, which one task reads whatever its splits."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(cores) if size < cores * ROW_GROUP and len(scan.inputFiles()) < cores else scan


def walk_order(path: Column) -> Column:
    """A sort key: the files of a folder by name, before those of its folders."""
    steps = F.split(path, "/", -1)
    dirs = F.transform(F.slice(steps, 1, F.size(steps) - 1), lambda d: F.concat(F.lit("1"), d))
    return F.array_join(F.concat(dirs, F.array(F.concat(F.lit("0"), F.element_at(steps, -1)))), "\u0001")


def select_sources(files: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Rows of ``files`` (path, length, ...) that are sources: by suffix, size, folders (excluded and hidden ones out) and globs."""
    path = F.col("path")
    dirs = F.slice(F.split(path, "/", -1), 1, F.size(F.split(path, "/", -1)) - 1)
    hidden = F.exists(dirs, lambda d: d.isin(*EXCLUDED_DIRS) | d.startswith("."))
    suffix = path.endswith(".py") | path.endswith(".ipynb")
    most = F.when(path.endswith(".ipynb"), MAX_NOTEBOOK_BYTES).otherwise(MAX_BYTES)
    return files.filter(suffix & (F.col("length") <= most) & ~hidden & ~T.matches_any(path, exclude or []))


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, file_ord, text) of the sources under ``root``; paths are relative. Files that are no UTF-8 or no notebook are left out.

    The suffix filters the listing and the length the scan, before any content is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,ipynb}").load(root)
    base = F.lit(root.rstrip("/").removeprefix("file:").rstrip("/") + "/")
    full = F.regexp_replace("path", "^file:/*", "/")
    relative = F.when(full.startswith(base), F.substring(full, F.length(base) + 1, F.length(full))).otherwise(F.col("path"))
    return as_sources(select_sources(found.withColumn("path", relative), exclude))


def as_sources(files: DataFrame) -> DataFrame:
    """(path, file_ord, text) from raw ``files`` (path, content)."""
    rows = files.withColumn("raw", F.try_validate_utf8(F.col("content").cast("string"))).filter("raw is not null")
    text = F.when(F.col("path").endswith(".ipynb"), notebook_text("raw")).otherwise(F.regexp_replace("raw", "\r\n?", "\n"))
    rows = rows.select("path", walk_order(F.col("path")).alias("file_ord"), text.alias("text"))
    return rows.filter(F.col("text").isNotNull() & (F.length("text") <= MAX_BYTES))


def notebook_text(raw: str | Column) -> Column:
    """A notebook as a script: cells numbered from 1 under ``# %%`` lines, magics and prose as comments, blank cells and outputs
    left out. Null for what is no notebook."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    cell = "struct<cell_type:string,source:string,input:string>"
    book = F.from_json(raw, f"struct<cells:array<{cell}>,worksheets:array<struct<cells:array<{cell}>>>>")

    def body(c: Column) -> Column:
        src = F.coalesce(c["source"], c["input"], F.lit(""))
        joined = F.array_join(F.from_json(src, "array<string>"), "")
        return T.lines(F.when(src.startswith("["), F.coalesce(joined, src)).otherwise(src))

    def shown(c: Column, i: Column) -> Column:
        def rows(lines: Column) -> Column:
            code = F.coalesce(c["cell_type"], F.lit("code")) == "code"
            n = (i + 1).cast("string")
            head = F.when(code, F.concat(F.lit("# %% cell "), n)).otherwise(F.concat(F.lit("# %% ["), c["cell_type"], F.lit("] cell "), n))
            magic = F.transform(lines, lambda x: F.when(x.rlike("^\\s*[%!]"), F.concat(F.lit("# "), x)).otherwise(x))
            prose = F.transform(lines, lambda x: F.regexp_replace(F.concat(F.lit("# "), x), "(?U)\\s+$", ""))
            return F.when(F.exists(lines, lambda x: T.strip(x) != ""), F.array_join(F.concat(F.array(head), F.when(code, magic).otherwise(prose)), "\n"))

        return T.let(body(c), rows)

    def view(b: Column) -> Column:
        cells = F.coalesce(b["cells"], F.flatten(F.transform(b["worksheets"], lambda w: F.coalesce(w["cells"], F.array().cast(f"array<{cell}>")))), F.array().cast(f"array<{cell}>"))
        return F.concat(F.array_join(F.filter(F.transform(cells, shown), lambda x: x.isNotNull()), "\n\n"), F.lit("\n"))

    return F.when(F.json_object_keys(raw).isNotNull(), T.let(book, view))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, type, targets) from JSON lines; blank lines and // comments are skipped, single targets become lists.

    Lines are numbered in their order, so equal lines are questions of their own.
    """
    lines = spark.read.text(path).withColumn("qid", F.monotonically_increasing_id()).filter((T.strip(F.col("value")) != "") & ~F.ltrim("value").startswith("//"))
    schema = "question string, type string, path string, line int, targets array<struct<path:string,line:int>>"
    got = store.settle(lines.select(F.from_json("value", schema).alias("g"), "qid").select("qid", "g.*"))
    single = F.array(F.struct("path", "line"))
    return got.select("qid", "question", F.coalesce("type", F.lit("semantic")).alias("type"), F.coalesce("targets", single).alias("targets"))


RESULTS = (
    "ts string, label string, kind string, gold string, k int, chunker string, mode string, symbol_pin boolean, rerank boolean, rewrite boolean, recall double, mrr double, hit1 double, "
    "n int, latency_ms struct<p50:double,p95:double>, by_type string, variant string, mean_added double, target_recall double, all_found double, gold_cited double, valid_rate double, "
    "claims_cited double, unsupported_per_answer double, mean_width double, repaired int"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored evaluation results; ``by_type`` holds numbers in old rows and objects in new ones, so it stays JSON text."""
    return spark.read.schema(RESULTS).json(path)


def file_lines(files: DataFrame, path: str, most: int = 20_000) -> DataFrame:
    """(line_no, line) of one file; a file of more than ``most`` lines is an error when it is read."""
    lines = T.lines("text")
    shown = F.when(F.size(lines) > most, F.raise_error(F.concat(F.lit("too many lines to show: "), F.col("path")))).otherwise(lines)
    rows = files.filter(F.col("path") == path).select(F.posexplode(shown).alias("i", "line"))
    return rows.select((F.col("i") + 1).alias("line_no"), "line")

"""Table functions for SQL: line windows of each row, and citations checked for each question.

``register(spark)`` makes them known; then

    SELECT * FROM line_windows(TABLE(SELECT path, text FROM files), 60, 15)
    SELECT * FROM citation_check(TABLE(asked) PARTITION BY qid ORDER BY pos)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from . import text as T

# What ends a line, and what is white space.
_ENDS = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def _column(argument: AnalyzeArgument, *names: str):
    if not argument.isTable:
        raise ValueError("the first argument has to be a table")
    for name in names:
        if name not in argument.dataType.names:
            raise ValueError(f"the table has no column {name!r}")


class LineWindows:
    """Windows of ``size`` lines that share ``overlap`` lines with the one before, of each row's ``text``; ``path`` names the row."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _column(rows, "path", "text")
        if size.value is None or overlap.value is None or not 0 <= overlap.value < size.value:
            raise ValueError("overlap must be a constant smaller than the window")
        schema = StructType().add("path", StringType()).add("chunk_no", IntegerType()).add("start_line", IntegerType()).add("end_line", IntegerType()).add("id", StringType())
        return AnalyzeResult(schema)

    def eval(self, row, size: int, overlap: int) -> Iterator[tuple]:
        text = row["text"]
        if not text:
            return
        lines = _ENDS.split(text)
        if lines[-1] == "" and _ENDS.search(text[-1]):
            lines.pop()
        for number, start in enumerate(range(0, max(1, len(lines) - overlap), size - overlap)):
            part = lines[start : start + size]
            body, end = "\n".join(part), start + len(part)
            if body.strip():
                yield row["path"], number, start + 1, end, hashlib.sha1(f"{row['path']}:{start + 1}-{end}:{body}".encode()).hexdigest()[:16]


class CitationCheck:
    """Of each question's rows (qid, answer, path, start_line, end_line): how many [path:a-b] its answer cites, and those that lie in no row."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        _column(rows, "qid", "answer", "path", "start_line", "end_line")
        return AnalyzeResult(StructType().add("qid", LongType()).add("n_citations", IntegerType()).add("invalid", StringType()))

    def __init__(self):
        self.qid, self.cites, self.shown = None, [], []

    def eval(self, row) -> None:
        if self.qid is None:
            self.qid = row["qid"]
            self.cites = [(m[1], int(m[2]), int(m[3] or m[2])) for m in re.finditer(T.RANGE_CITATION, row["answer"] or "")]
        if row["path"] is not None and any(row["path"] == path for path, _, _ in self.cites):
            self.shown.append((row["path"], row["start_line"], row["end_line"]))

    def terminate(self) -> Iterator[tuple]:
        if self.qid is not None:
            bad = [f"{p}:{a}-{b}" for p, a, b in self.cites if not any(p == path and start <= a and b <= end for path, start, end in self.shown)]
            yield self.qid, len(self.cites), "; ".join(bad)


def register(spark: SparkSession) -> None:
    spark.udtf.register("line_windows", udtf(LineWindows))
    spark.udtf.register("citation_check", udtf(CitationCheck))

"""Text files, JSON sets and report sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charsets import detect

# Endings that are taken, and the largest file.
ENDINGS = ("txt", "pdf", "epub", "mobi")
LARGEST = 50 << 20


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, length, encoding and text of the files under ``path`` that may be taken and are plain text; undecodable ones have a null encoding."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    taken = files.filter(accepted(F.col("path"), F.col("length")) & F.lower(F.col("path")).endswith(".txt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [detect(raw) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in done], pa.string()), pa.array([t for _, t in done], pa.string())], ["path", "length", "encoding", "text"])

    return taken.select("path", "length", "content").mapInArrow(run, "path string, length long, encoding string, text string")


def accepted(path, length):
    """Whether a file's ending and size allow it."""
    return F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1).isin(*ENDINGS) & (length <= LARGEST)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of JSON sets {books, questions: [...]}, one row each."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("questions").alias("q")).select("q.*")


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object a line."""
    df.write.mode(mode).json(path)


def report(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A Markdown table of a small result: at most ``limit`` rows, and a line that says so where there are more."""
    rows = df.limit(limit + 1).collect()
    more = ["", f"Only the first {limit} rows are shown."] if len(rows) > limit else []
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:limit]), *more]) + "\n"

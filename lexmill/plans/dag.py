"""Level by level execution of named steps, and chapter map-reduce with a pluggable writer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import Sizes, chunk_documents

DIRECT = 15_000  # characters up to which a chapter is written about in one piece
PIECES = Sizes(6000, 9000, 300)


def run_levels(steps: dict[str, tuple[list[str], Callable[[dict], object]]]) -> dict[str, object]:
    """Results of steps {name: (needs, function of the results so far)}; a step that fails yields {"error": ...}, a cycle is an error."""
    done: dict[str, object] = {}
    while len(done) < len(steps):
        ready = [n for n, (needs, _) in steps.items() if n not in done and all(d in done for d in needs)]
        if not ready:
            raise ValueError(f"cycle or unknown step among {sorted(set(steps) - set(done))}")
        for name in ready:
            try:
                done[name] = steps[name][1](done)
            except Exception as e:  # noqa: BLE001
                done[name] = {"error": str(e)}
    return done


def chapter_notes(docs: DataFrame, write: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """doc_id, chapter_ordinal, note: pieces of long chapters are noted first, then the notes of a chapter together."""
    noted = F.pandas_udf(write, "string")
    pieces = chunk_documents(docs, PIECES)
    size = pieces.groupBy("doc_id", "chapter_ordinal").agg(F.sum(F.col("end") - F.col("start")).alias("size"))
    rows = pieces.join(size, ["doc_id", "chapter_ordinal"]).withColumn("note", F.when(F.col("size") <= DIRECT, F.col("text")).otherwise(noted("text")))
    whole = rows.groupBy("doc_id", "chapter_ordinal").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "note"))).alias("n"))
    return whole.select("doc_id", "chapter_ordinal", noted(F.array_join(F.transform("n", lambda x: x["note"]), "\n")).alias("note"))

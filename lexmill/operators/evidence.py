"""Evidence: deduplication, numbering, verification; adjacent-range expansion of hits."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .chunks import BLANKS, chapters, units
from .conversation import merge_ranges


def assign_evidence(candidates: DataFrame) -> DataFrame:
    """Candidates (request_id, ordinal, kind, book_id, hash, start, end, text, book_hash), the first of equal ones, numbered E1, E2, ...

    Equal: the same kind, book, hash and range, or without a range the same text.  verified: a range whose hash is the book's.
    """
    same = Window.partitionBy("request_id", "kind", "book_id", "hash", "start", "end", F.when(F.col("start").isNull(), F.col("text"))).orderBy("ordinal")
    first = candidates.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    number = F.row_number().over(Window.partitionBy("request_id").orderBy("ordinal"))
    verified = F.coalesce(F.col("start").isNotNull() & (F.col("hash") == F.col("book_hash")), F.lit(False))
    return first.withColumn("evidence_id", F.concat(F.lit("E"), number)).withColumn("verified", verified)


def paragraph(lines: list[tuple[int, int, bool]], text: str, lo: int, hi: int, floor: int, ceil: int) -> tuple[int, int]:
    """The stretch without blank lines around [lo, hi) within [floor, ceil): ``lines`` are (start, end, blank) of the text's lines."""
    starts = [a for a, _, _ in lines]
    first = bisect_right(starts, lo) - 1
    while first > 0 and starts[first] > floor and not lines[first - 1][2]:
        first -= 1
    last = bisect_right(starts, hi) - 1
    if not text[hi : min(lines[last][1], ceil)].strip(BLANKS) and lines[last][1] < ceil:
        return max(floor, starts[first]), hi
    last += 1
    while last < len(lines) and starts[last] < ceil and not (lines[last][2] and lines[last][1] < ceil):
        last += 1
    return max(floor, starts[first]), min(ceil, starts[last]) if last < len(lines) else ceil


EXPANDED = "request_id long, doc_id long, chapter int, start int, end int"


def expand_hits(docs: DataFrame, hits: DataFrame, cap: int = 1500) -> DataFrame:
    """request_id, doc_id, start, end, n, chunk_ids and text of the hits (request_id, doc_id, chunk_id, start, end) widened to their paragraphs.

    A hit stays within the chapter that holds it; a paragraph longer than ``cap`` code units is cut around the hit's
    middle; what overlaps or touches in a chapter is merged, with the chunk ids in order.  No surrogate pair is split.
    Null texts have no hits.  An equi-join on the document, once for the bounds and once for the texts.
    """
    columns = [f.split()[0] for f in EXPANDED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for request, doc, start, end, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, lines, pos = units(text), [], 0
                for line in text.split("\n"):
                    lines.append((pos, pos + len(line), not line.strip(BLANKS)))
                    pos += len(line) + 1
                inside = [(n, a, b) for n, (_, a, b) in enumerate(chapters(text), 1) if at[a] <= start and end <= at[b]]
                chapter, floor, ceil = inside[0] if inside else (0, 0, len(text))
                lo, hi = bisect_left(at, start), bisect_left(at, end)
                s, e = (at[x] for x in paragraph(lines, text, lo, hi, floor, ceil))
                if e - s > cap:
                    s = max(at[floor], (start + end) // 2 - cap // 2)
                    e = min(at[ceil], s + cap)
                    s = max(at[floor], e - cap)
                rows.append((request, doc, chapter, at[bisect_left(at, s)], at[bisect_left(at, e)]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], columns)

    texts = docs.select("doc_id", normalize_text(F.col("text")).alias("text"))
    wide = hits.select("request_id", "doc_id", "start", "end").join(texts, "doc_id").select("request_id", "doc_id", "start", "end", "text").mapInArrow(run, EXPANDED)
    key = F.struct("request_id", "doc_id", "chapter").alias("key")
    merged = merge_ranges(wide.select(key, "start", "end"), "key", "start", "end").select("key.request_id", "key.doc_id", "start", "end", "n")
    own = hits.select("request_id", "doc_id", "chunk_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    held = merged.join(own, ["request_id", "doc_id"]).filter((F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start")))
    ids = held.groupBy("request_id", "doc_id", "start", "end", "n").agg(F.transform(F.sort_array(F.collect_set(F.struct("_s", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    part = F.substring(F.encode("text", "UTF-16BE"), 2 * F.col("start") + 1, 2 * (F.col("end") - F.col("start")))
    return ids.join(texts, "doc_id").select("request_id", "doc_id", "start", "end", "n", "chunk_ids", F.decode(part, "UTF-16BE").alias("text"))

"""Chapters and chunks of documents.  Offsets are half-open ranges of UTF-16 code units of the normalised text.

A document is one row and its chunks depend on nothing else, so the work is one Arrow map without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

# What counts as a chapter heading at the start of a trimmed line, names for parts without one, and white space.
HEADING = re.compile(r"(第[一二三四五六七八九十零百千万]+[章节回部篇集]|[第0-9]+[章节回部篇集]|[一二三四五六七八九十零]+[、.]|[0-9]+[、.]|Chapter\s*[0-9]+)", re.IGNORECASE)
WHOLE, PREFACE = "全文", "前言"
BLANKS = "\t\n\x0b\x0c\r                  　﻿"
_BREAK = re.compile(rf"\n(?:[{BLANKS.replace(chr(10), '')}]*\n)+(?=[^\n]*[^{BLANKS}])")


@dataclass(frozen=True)
class Sizes:
    """Target length, length up to which a stretch stays whole, and overlap of the windows of longer ones."""

    target: int = 1200
    whole: int = 1800
    overlap: int = 240

    def __post_init__(self) -> None:
        if not (self.target > 0 and self.whole >= self.target and 0 <= self.overlap < self.target):
            raise ValueError("sizes: target > 0, whole >= target and 0 <= overlap < target")


SMALL = Sizes(500, 750, 100)


def units(text: str) -> list[int] | range:
    """The UTF-16 offset of every character, and of the end."""
    if text.isascii() or max(text, default="") < "\U00010000":
        return range(len(text) + 1)
    wide = np.frombuffer(text.encode("utf-32-le"), "<u4") > 0xFFFF
    return np.concatenate([[0], np.cumsum(1 + wide)]).tolist()


def chapters(text: str) -> list[tuple[str, int, int]]:
    """(title, start, end) in characters; a text without visible characters has none."""
    if not text.strip(BLANKS):
        return []
    heads = []
    for line in re.finditer(r"[^\n]+", text):
        title = line[0].strip(BLANKS)
        if title and HEADING.match(title):
            heads.append((title, line.start()))
    if not heads:
        return [(WHOLE, 0, len(text))]
    first = heads[0][1]
    out = [(PREFACE, 0, first)] if text[:first].strip(BLANKS) else []
    stops = [at for _, at in heads[1:]] + [len(text)]
    return out + [(title, at, stop) for (title, at), stop in zip(heads, stops, strict=True)]


def stretches(text: str, start: int, end: int, at: list[int] | range, target: int) -> Iterator[tuple[int, int]]:
    """Whole paragraphs gathered until they reach the target length; blank lines belong to the paragraph before them."""
    if not text[start:end].strip(BLANKS):
        return
    begin = start
    body = text[start:end]
    lead = start + len(body) - len(body.lstrip(BLANKS))
    for gap in _BREAK.finditer(text, lead, end):
        if at[gap.end()] - at[begin] >= target:
            yield begin, gap.end()
            begin = gap.end()
    yield begin, end


def chunk(text: str, sizes: Sizes = Sizes()) -> Iterator[tuple[int, str, int, int, str]]:  # noqa: B008
    """(chapter number, title, start, end, text) of the chunks of a normalised text."""
    at = units(text)
    exact = isinstance(at, range)

    def char(unit: int) -> int:
        """The character at a unit offset; an offset within a pair moves past it."""
        return unit if exact else bisect_left(at, unit)

    for number, (title, lo, hi) in enumerate(chapters(text), 1):
        for a, b in stretches(text, lo, hi, at, sizes.target):
            if at[b] - at[a] <= sizes.whole:
                spans = [(a, b)]
            else:
                spans, pos = [], a
                while True:
                    stop = min(b, char(min(at[pos] + sizes.target, at[b])))
                    spans.append((pos, stop))
                    if stop >= b:
                        break
                    pos = max(pos + 1, char(at[stop] - sizes.overlap))
            for s, e in spans:
                part = text[s:e]
                if part.strip(BLANKS):
                    yield number, title, at[s], at[e], part


def windows(n: int, sizes: Sizes = Sizes()) -> Iterator[tuple[int, int]]:  # noqa: B008
    """(start, end) of the chunks of one stretch of ``n`` characters."""
    if n <= sizes.whole:
        if n:
            yield 0, n
        return
    step = sizes.target - sizes.overlap
    for start in range(0, n - sizes.overlap, step):
        yield start, min(start + sizes.target, n)


CHUNK = "doc_id long, chunk_index int, chapter_id string, chapter_ordinal int, chapter_title string, start int, end int, text string"


def chunk_documents(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """The chunks of every row of ``docs`` (doc_id, text).  Null, empty and blank texts have none; text equals the slice at its offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CHUNK.split(", ")]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, rows = batch.slice(k, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    at, starts = units(text), {}
                    for number, (_, lo, _hi) in enumerate(chapters(text), 1):
                        starts[number] = at[lo]
                    rows += [(doc_id, n, f"ch-{c}-{starts[c]}", c, title, s, e, t) for n, (c, title, s, e, t) in enumerate(chunk(text, sizes))]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalize_text(F.col("text")).alias("text")).mapInArrow(run, CHUNK)


def chunk_plain(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """doc_id, chunk_index, start, end and text of the chunks of every row of ``docs`` (doc_id, text), each text one stretch as it stands.

    No normal form, chapters or paragraphs; offsets are characters.  Null and empty texts have none; text equals the slice at its offsets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, rows = batch.slice(k, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows += [(doc_id, n, s, e, text[s:e]) for n, (s, e) in enumerate(windows(len(text or ""), sizes))]
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "chunk_index", "start", "end", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, chunk_index int, start int, end int, text string")


def chapter_table(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, title, start, end (units) of every chapter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = units(text)
                rows += [(doc_id, n, title, at[s], at[e]) for n, (title, s, e) in enumerate(chapters(text), 1)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "ordinal", "title", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalize_text(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, ordinal int, title string, start int, end int")


def corpus_profile(docs: DataFrame) -> DataFrame:
    """doc_id, bytes, chars, lines, chapters, median (upper middle) and longest chapter, and chapters over 5000, of every document."""
    text = normalize_text(F.col("text"))
    base = docs.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("chars"), F.size(F.split(text, "\n")).cast("long").alias("lines"))
    size = F.col("end") - F.col("start")
    lengths = F.sort_array(F.collect_list(size))
    by_doc = chapter_table(docs).groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("chapters"), F.element_at(lengths, F.floor(F.count("*") / 2).cast("int") + 1).cast("long").alias("median_chapter"), F.max(size).cast("long").alias("longest_chapter"), F.count_if(size > 5000).alias("over_5000"))
    return base.join(by_doc, F.col("doc_id") == F.col("_d"), "left").drop("_d").fillna(0, ["chapters", "over_5000"])

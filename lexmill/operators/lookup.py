"""Looking things up in documents: chapters by id, number or title, places of a name, and what is handed on of long results."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, utf16_length
from .chunks import chapters, units
from .retrieval import top

PREVIEW = 1500
MENTION = "ask_id long, doc_id long, rank int, at int, start int, end int, chapter_ordinal int, text string"


def _table(rows: list[tuple], kinds: tuple[pa.DataType, ...], schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])


def chapter_texts(docs: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """Chapters of ``docs`` (doc_id, text) with their ids and whole texts, and where a preview of ``preview`` code units ends.

    A preview never splits a surrogate pair: its end moves past it.
    """
    schema = "doc_id long, chapter_id string, ordinal int, title string, start int, end int, preview_end int, text string"
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = units(text)
                rows = [(doc_id, f"ch-{n}-{at[s]}", n, title, at[s], at[e], at[bisect_left(at, min(at[s] + preview, at[e]))], text[s:e]) for n, (title, s, e) in enumerate(chapters(text), 1)]
                yield _table(rows, kinds, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalize_text(F.col("text")).alias("text")).mapInArrow(run, schema)


def find_chapters(docs: DataFrame, asks: DataFrame) -> DataFrame:
    """The chapter that each of ``asks`` (ask_id, doc_id, chapter_id, chapter_index, title) means.

    An id counts first, then a number from 1, then a part of the title; a title part that several
    chapters have is ambiguous and lists them; one that none has finds the first chapter
    whose text contains it.  ask_id, status (ok, ambiguous, empty), n_chapters, matches, chapter_id,
    ordinal, title, start, end and text of the preview, length and truncated.
    """
    every = chapter_texts(docs.join(asks.select("doc_id").distinct(), "doc_id", "left_semi"))
    want = asks.select("ask_id", F.col("doc_id").alias("a_doc"), F.col("chapter_id").alias("a_id"), F.col("chapter_index").alias("a_index"), F.col("title").alias("a_title"))
    both = want.join(every, F.col("a_doc") == F.col("doc_id"), "left")
    titled = F.coalesce(F.contains("title", "a_title"), F.lit(False))
    first = lambda fits: F.min(F.when(fits, F.col("ordinal")))
    found = both.groupBy("ask_id", "a_doc", "a_id", "a_index", "a_title").agg(
        F.count("ordinal").alias("n_chapters"),
        first(F.col("chapter_id") == F.col("a_id")).alias("by_id"),
        first(F.col("ordinal") == F.col("a_index")).alias("by_index"),
        first(F.contains("text", "a_title")).alias("by_text"),
        F.sort_array(F.collect_list(F.when(titled, F.struct("ordinal", "chapter_id", "title")))).alias("hits"),
    )
    by_title = F.coalesce(F.when(F.size("hits") == 1, F.col("hits")[0]["ordinal"]), F.when(F.size("hits") == 0, F.col("by_text")))
    chosen = F.when(F.col("a_id").isNotNull(), F.col("by_id")).when(F.col("a_index").isNotNull(), F.col("by_index")).otherwise(by_title)
    several = F.col("a_id").isNull() & F.col("a_index").isNull() & (F.size("hits") > 1)
    status = F.when(several, "ambiguous").when(chosen.isNotNull(), "ok").otherwise("empty")
    judged = found.select("ask_id", F.col("a_doc").alias("doc_id"), status.alias("status"), "n_chapters", F.when(several, F.col("hits")).alias("matches"), chosen.alias("ordinal"))
    size = F.col("end") - F.col("start")
    # A preview holds at most as many characters as code units, and fewer where pairs are in it.
    shown = F.substring(F.col("text"), F.lit(1), F.col("preview_end") - F.col("start"))
    over = utf16_length(shown) - (F.col("preview_end") - F.col("start"))
    text = F.when(over <= 0, shown).otherwise(F.decode(F.substring(F.encode("text", "UTF-16BE"), F.lit(1), 2 * (F.col("preview_end") - F.col("start"))), "UTF-16BE"))
    return judged.join(every, ["doc_id", "ordinal"], "left").select("ask_id", "status", "n_chapters", "matches", "chapter_id", "ordinal", "title", "start", F.col("preview_end").alias("end"), text.alias("text"), size.alias("length"), (size > F.col("preview_end") - F.col("start")).alias("truncated"))


def places(text: str, name: str, before: int = 80, after: int = 120, most: int = 6, chapter_of_start: bool = False) -> Iterator[tuple]:
    """(rank, at, start, end, chapter_ordinal, text) of the first ``most`` places of ``name``, from left to right without overlap."""
    place, rank = text.find(name), 0
    if place < 0:
        return
    at, parts = units(text), chapters(text)
    starts = [at[s] for _, s, _ in parts]
    while place >= 0 and rank < most:
        rank += 1
        lo = bisect_left(at, max(0, at[place] - before))
        hi = bisect_left(at, min(at[-1], at[place + len(name)] + after))
        number = bisect_left(starts, (at[lo] if chapter_of_start else at[place]) + 1)
        yield rank, at[place], at[lo], at[hi], number or None, text[lo:hi]
        place = text.find(name, place + len(name))


def mentions(docs: DataFrame, asks: DataFrame, before: int = 80, after: int = 120, most: int = 6, chapter_of_start: bool = False) -> DataFrame:
    """The first ``most`` places of the name of each of ``asks`` (ask_id, doc_id, name), from left to right without overlap.

    rank, at (its offset), start and end of the text around it, and the number of the chapter at the
    name or, with ``chapter_of_start``, at the start of that text.  Blank names and null texts are found nowhere.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ask_id, doc_id, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.extend((ask_id, doc_id, *found) for found in places(text, name, before, after, most, chapter_of_start))
            yield _table(rows, kinds, MENTION)

    wanted = asks.filter(F.length(F.trim("name")) > 0).select(F.col("ask_id").cast("long").alias("ask_id"), "doc_id", "name")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalize_text(F.col("text")).alias("text"))
    return wanted.join(texts, "doc_id").select("ask_id", "doc_id", "name", "text").mapInArrow(run, MENTION)


def with_fallback(hits: DataFrame, docs: DataFrame, asks: DataFrame) -> DataFrame:
    """``hits`` (ask_id, doc_id, rank, start, end, text, method), and for asks without any the places of their words in the text.

    Queries of one character or none are not looked for.
    """
    left = asks.join(hits.select("ask_id"), "ask_id", "left_anti").withColumn("name", F.trim("name")).filter(F.length("name") >= 2)
    found = mentions(docs, left, 200, 600, 3, chapter_of_start=True)
    return hits.select("ask_id", "doc_id", "rank", "start", "end", "text", "method").unionByName(found.select("ask_id", "doc_id", "rank", "start", "end", "text", F.lit("fulltext").alias("method")))


def trim_hits(hits: DataFrame, key: str, rank: str = "rank", size: int = 600, most: int = 10, characters: bool = False) -> DataFrame:
    """The first ``most`` hits (text, start, end) of each key, texts cut at ``size`` code units, ends moved with them; truncated says which.

    ``characters``: sizes and offsets are characters.
    """
    length = F.length if characters else utf16_length
    short = F.substring("text", 1, size)
    sizes = F.sequence(F.lit((size + 1) // 2), F.lit(size))
    fits = F.element_at(F.filter(sizes, lambda n: utf16_length(F.substring(F.col("text"), F.lit(1), n)) >= size), 1)
    cut = F.when(length(short) <= size, short).otherwise(F.substring(F.col("text"), F.lit(1), fits))
    long = length(F.col("text")) > size
    rows = top(hits.withColumnRenamed(rank, "_rank"), key, F.col("_rank"), k=most).drop("rank").withColumnRenamed("_rank", rank)
    rows = rows.withColumn("truncated", long).withColumn("_cut", F.when(long, cut).otherwise(F.col("text")))
    return rows.withColumn("end", F.when(F.col("truncated"), F.col("start") + length(F.col("_cut"))).otherwise(F.col("end"))).withColumn("text", F.col("_cut")).drop("_cut")


def fit_budget(rows: DataFrame, key: str, order: str, size: Column, room: int = 12_000) -> DataFrame:
    """The first rows of each key whose sizes, and a comma after each, fit ``room`` together.

    Only the longest beginning that fits stays: nothing is taken after a row that did not fit.
    """
    so_far = F.sum(size + 1).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_used", so_far).filter(F.col("_used") <= room).drop("_used")


def call_limits(calls: DataFrame, keys: list[str], order: list[str], most: int = 5) -> DataFrame:
    """``calls`` with blocked: whether ``most`` calls of the same keys came before.

    The last allowed call of a key comes from a ranking that Spark limits in every task, so no window holds a whole key.
    """
    last = F.struct(*order)
    ranked = top(calls.select(F.struct(*keys).alias("_key"), last.alias("_at")), "_key", F.col("_at"), k=most).groupBy("_key").agg(F.max("_at").alias("_last"))
    marks = ranked.select(F.col("_key").alias("_marked"), "_last")
    same = F.struct(*keys).eqNullSafe(F.col("_marked"))  # rows whose keys are null have a limit too
    return calls.join(marks, same).withColumn("blocked", last > F.col("_last")).drop("_marked", "_last")


def assemble_calls(deltas: DataFrame) -> DataFrame:
    """Calls put together from pieces (response_id, seq, call_index, id, name, arguments): texts joined in order, the last id that is not empty."""
    given = F.when(F.length("id") > 0, F.col("seq"))
    grouped = deltas.groupBy("response_id", F.coalesce("call_index", F.lit(0)).alias("call_index")).agg(F.max_by("id", given).alias("id"), F.sort_array(F.collect_list(F.struct("seq", "name", "arguments"))).alias("p"))
    joined = lambda f: F.array_join(F.transform("p", lambda x: F.coalesce(x[f], F.lit(""))), "")
    return grouped.select("response_id", "call_index", F.coalesce("id", F.lit("")).alias("id"), joined("name").alias("name"), joined("arguments").alias("arguments"))


def judge_requests(known: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` requests (user_id, request_id, fingerprint) with verdict: new, replay, running, or conflict where the known one differs.

    ``known`` has user_id, request_id, fingerprint and status.
    """
    old = known.select("user_id", "request_id", F.col("fingerprint").alias("_fp"), F.col("status").alias("_status"))
    ended = F.col("_status").isin("completed", "failed", "cancelled", "interrupted")
    verdict = F.when(F.col("_status").isNull(), "new").when(~F.col("_fp").eqNullSafe(F.col("fingerprint")), "conflict").when(ended, "replay").otherwise("running")
    return new.join(old, ["user_id", "request_id"], "left").withColumn("verdict", verdict).drop("_fp", "_status")

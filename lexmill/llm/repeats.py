"""Removal of passages that repeat across documents: seed on winnowed anchors, extend, cut.

A passage is ``LENGTH`` consecutive words.  Anchors are hashes of GRAM words, winnowed so that every
passage holds one and equal passages hold the same ones (Schleimer et al., 2003: the rightmost
minimum of each WINDOW of them).  Consecutive anchors overlap.

1. Each anchor's leader is its occurrence in the smallest document.  Occurrences are joined with
   their leader alone, so a passage that n documents share gives n rows.
2. Neighbouring anchors on one diagonal form a chain.  Both ends are extended word by word, by
   the common prefixes of the words beside the chain in either document; these flanks are fetched
   once for each place, however many chains ask for it.  Matches of LENGTH words or more stay.
3. A passage can also equal one of a document that does not lead its anchor, or of a leader that has the
   anchor twice.  What has no verdict yet and has its own minimum shared is compared by hashes of
   whole passages, which settles every such case.
4. The words of all matches are removed.

The documents are written once, bucketed by their key, so that the three joins with the texts
move the small side only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import discard, mark, materialize, new_path
from .words import Words, mix, ragged, slices, utf8

LENGTH, GRAM = 50, 26
WINDOW = LENGTH - GRAM + 1
FLANK = LENGTH - GRAM
BUCKET_BYTES = 128 << 20
_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
KEY = ["doc", "sig", "tie"]  # the id, and 128 bits of the text
LEADER = ["f", "f_sig", "f_tie"]


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` consecutive items, from runs of powers of two; too near the end they are meaningless."""

    def beside(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
        moved = np.zeros_like(b)
        moved[: max(0, len(b) - by)] = b[by:]
        return mix(a * _STEP + moved)

    power, done, out = h, 0, None
    size = 1
    while True:
        if length & size:
            out, done = (power, size) if out is None else (beside(out, power, done), done + size)
        if done == length:
            return out
        power = beside(power, power, size)
        size *= 2


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """For each start, the position of the rightmost minimum of ``window`` values; meaningless too near the end."""
    at, value, size = np.arange(len(h)), h, 1

    def join(by: int) -> tuple[np.ndarray, np.ndarray]:
        right, where = np.full_like(value, np.iinfo(np.uint64).max), np.full_like(at, len(h))
        right[: max(0, len(h) - by)], where[: max(0, len(h) - by)] = value[by:], at[by:]
        take = right <= value
        return np.where(take, where, at), np.where(take, right, value)

    while 2 * size <= window:
        at, value = join(size)
        size *= 2
    return join(window - size)[0] if size < window else at


def anchors_of(w: Words) -> tuple[np.ndarray, ...]:
    """Anchors of the rows of ``w``: row, ordinal, position, hash, the passages whose own minimum it is, and whether the row has the hash again.

    Those passages start at ``before`` words ahead of the anchor and at the ``starts`` - 1 words that follow.
    """
    n = np.diff(w.first)
    grams = mix(run_hashes(w.hashes(), GRAM))
    least = winnow(grams, WINDOW)
    windows = np.maximum(n - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(n)), windows)
    begin = ragged(w.first[:-1], windows)
    place = least[begin]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    starts = np.diff(np.append(np.flatnonzero(new), len(new)))
    row, place, begin = row[new], place[new], begin[new]
    at, before = place - w.first[row], place - begin
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    heads = np.flatnonzero(head)
    ordinal = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
    own = mix(grams[place] ^ mix(row.astype(np.uint64) + _U(1)))
    _, back, count = np.unique(own, return_inverse=True, return_counts=True)
    return row, ordinal, at, grams[place], before, starts, count[back] > 1


def _by_slice(work: Callable[[pa.RecordBatch, Words], pa.RecordBatch], text: int, limit: int = 1 << 20) -> Callable:
    """A mapInArrow function that hands ``work`` slices of rows with the words of their texts (column number ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for i, j in slices(offsets, limit):
                yield work(batch.slice(i, j - i), Words(data, offsets[i : j + 1]))

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and flat values of a list column without nulls."""
    at = column.offsets.to_numpy()
    return (at - at[0]).astype(np.int64), column.flatten()


def _anchor_rows(part: pa.RecordBatch, w: Words) -> pa.RecordBatch:
    row, ordinal, at, gram, before, starts, again = anchors_of(w)
    keys = [part.column(k).take(pa.array(row)) for k in (0, 1, 2)]
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array(ordinal.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(before.astype(np.int8)), pa.array(starts.astype(np.int8)), pa.array(again)],
        ["doc", "sig", "tie", "ordinal", "at", "gram", "before", "starts", "again"],
    )


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of each document's seeds: neighbouring anchors with one leader on one diagonal."""
    for batch in batches:
        bounds, seeds = _lists(batch.column(3))
        s = {f: seeds.field(f).to_numpy(zero_copy_only=False) for f in ("ordinal", "at", "f", "f_sig", "f_tie", "f_at")}
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        order = np.lexsort((s["ordinal"], row))
        row, s = row[order], {k: v[order] for k, v in s.items()}
        other = s["f"] != batch.column(0).to_numpy(zero_copy_only=False)[row]
        row, s = row[other], {k: v[other] for k, v in s.items()}
        head = np.ones(len(row), bool)
        head[1:] = (np.diff(row) != 0) | (np.diff(s["ordinal"]) != 1) | (np.diff(s["f"]) != 0) | (s["f_sig"][1:] != s["f_sig"][:-1]) | (s["f_tie"][1:] != s["f_tie"][:-1]) | (np.diff(s["f_at"] - s["at"]) != 0)
        a = np.flatnonzero(head)
        z = np.append(a[1:], len(row))[: len(a)] - 1
        keys = [batch.column(k).take(pa.array(row[a])) for k in (0, 1, 2)]
        ints = [s["at"][a], s["at"][z] + GRAM, s["f_at"][a], s["f_at"][z] + GRAM]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(s["f"][a]), pa.array(s["f_sig"][a]), pa.array(s["f_tie"][a]), *(pa.array(x.astype(np.int32)) for x in ints)], ["doc", "sig", "tie", "f", "f_sig", "f_tie", "start", "stop", "f_start", "f_stop"])


CHAINS = "doc long, sig long, tie long, f long, f_sig long, f_tie long, start int, stop int, f_start int, f_stop int"


def _flank_rows(part: pa.RecordBatch, w: Words) -> pa.RecordBatch:
    """The hashes of up to FLANK words outward from each wanted place (2 * position + side), nearest first."""
    bounds, want = _lists(part.column(3))
    want = want.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
    at, right = w.first[row] + want // 2, want % 2
    size = np.minimum(FLANK, np.where(right == 1, w.first[row + 1] - at, at - w.first[row]))
    h = w.hashes()
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    way = np.repeat(right, size)
    flat = h[np.repeat(at, size) + np.where(way == 1, step, -1 - step)].astype("<u8").tobytes()
    ends = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    return pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in (0, 1, 2)), pa.array(want.astype(np.int32)), words], ["doc", "sig", "tie", "want", "words"])


def common_prefix(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The number of leading 8-byte items that each two have in common."""
    width = 8 * FLANK
    x = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in a), "<u8").reshape(-1, FLANK)
    y = np.frombuffer(b"".join(v.ljust(width, b"\1") for v in b), "<u8").reshape(-1, FLANK)
    most = np.minimum([len(v) for v in a], [len(v) for v in b]) // 8 if a else np.zeros(0, np.int64)
    return np.minimum(np.logical_and.accumulate(x == y, axis=1).sum(axis=1), most)


def _extend_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            part = batch.slice(at, 5000)
            by = common_prefix(part.column(6).to_pylist(), part.column(7).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(6)), pa.array(by.astype(np.int32))], ["doc", "sig", "tie", "start", "stop", "side", "by"])


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of passage starts without verdict: the passage's own minimum is shared, not led by the document alone, and no match lies over it."""
    for batch in batches:
        bounds, seeds = _lists(batch.column(3))
        s = {f: seeds.field(f).to_numpy(zero_copy_only=False) for f in ("at", "f", "f_again", "before", "starts")}
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        mine = (s["f"] == batch.column(0).to_numpy(zero_copy_only=False)[row]) & ~s["f_again"].astype(bool)
        row, s = row[~mine], {k: v[~mine].astype(np.int64) for k, v in s.items()}
        at, before, starts = s["at"], s["before"], s["starts"]
        last = np.zeros(batch.num_rows, np.int64)
        np.maximum.at(last, row, at + 2)
        base = np.concatenate([[0], np.cumsum(last + 1)])
        size = int(base[-1])

        def spread(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.ndarray = base, last: np.ndarray = last, size: int = size) -> np.ndarray:
            """Which starts lie in a range [lo, hi) of their row."""
            lo, hi = np.clip(lo, 0, last[owner]), np.clip(hi, 0, last[owner])
            edge = np.bincount(base[owner] + lo, minlength=size + 1) - np.bincount(base[owner] + np.maximum(lo, hi), minlength=size + 1)
            return np.cumsum(edge)[:size] > 0

        open_ = spread(row, at - before, at - before + starts)
        m_bounds, matches = _lists(batch.column(4))
        m_row = np.repeat(np.arange(batch.num_rows), np.diff(m_bounds))
        if len(m_row):
            lo, hi = (matches.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "hi"))
            open_ &= ~spread(m_row, lo, hi - LENGTH + 1)
        edge = np.diff(np.concatenate([[0], open_.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(base, lo, "right") - 1
        keys = [batch.column(k).take(pa.array(owner)) for k in (0, 1, 2)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array((lo - base[owner]).astype(np.int32)), pa.array((hi - base[owner]).astype(np.int32))], ["doc", "sig", "tie", "lo", "hi"])


def _passage_rows(part: pa.RecordBatch, w: Words) -> pa.RecordBatch:
    """Two hashes, 128 bits together, for each passage that starts in the ranges of its row."""
    bounds, ranges = _lists(part.column(3))
    lo, hi = (ranges.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "hi"))
    owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
    hi = np.minimum(hi, np.diff(w.first)[owner] - LENGTH + 1)
    size = np.maximum(hi - lo, 0)
    at, row = ragged(lo, size), np.repeat(owner, size)
    words = w.hashes()
    h = [run_hashes(x, LENGTH)[at + w.first[row]] for x in (words, mix(words ^ _U(0x9FB21C651E98DF25)))]
    return pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in (0, 1, 2)), pa.array(at.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in h)], ["doc", "sig", "tie", "lo", "passage", "also"])


def _kept_rows(part: pa.RecordBatch, w: Words) -> pa.RecordBatch:
    """Column 0 as it is, the number of words, of removed ones, and the kept words joined by a space."""
    bounds, cuts = _lists(part.column(2))
    owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
    total = len(w.start)
    if len(owner):
        lo, hi = (cuts.field(f).to_numpy(zero_copy_only=False) + w.first[owner] for f in ("lo", "hi"))
        gone = np.cumsum(np.bincount(lo, minlength=total + 1) - np.bincount(hi, minlength=total + 1))[:total] > 0
    else:
        gone = np.zeros(total, bool)
    stay = np.flatnonzero(~gone)
    first = np.searchsorted(stay, w.first)
    size = w.stop[stay] - w.start[stay] + 1
    flat = w.buf[ragged(w.start[stay], size)]
    ends = np.concatenate([[0], np.cumsum(size)])
    flat[ends[1:] - 1] = 0x20
    raw, at = flat.tobytes(), ends[first]
    kept = [raw[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    n = np.diff(w.first)
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n - np.diff(first)), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept"])


def _bucketed(df: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """``df`` as a table bucketed by ``keys``, one file a bucket: joins on them leave it where it is.

    ``size`` says how many bytes a row has; the buckets hold BUCKET_BYTES each, or fill the shuffle partitions.  The
    table's name leaves the catalog at once: its plan has what it needs.
    """
    spark = df.sparkSession
    held = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
    path = new_path(spark, "texts")
    name = f"lexmill_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, *keys).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return table


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as a struct ``row``, n_words, n_removed and kept (the words left, joined by a space).

    A word goes if a passage over it also starts in a document with a smaller id; the passages of
    the input count, whatever is removed.  Null texts have no words.  Rows with a null id lose
    nothing and no other row loses anything to them.  Rows that share an id never lose words to each other;
    each is judged by its own text.  An empty table gives an empty result.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    whole = docs.select(F.col(id_col).cast("long").alias("doc"), half(1).alias("sig"), half(17).alias("tie"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    spark, since = docs.sparkSession, mark()
    said = F.col("row").getField(text_col).alias("text")
    texts = _bucketed(whole, KEY, F.octet_length(said))
    text = texts.select(*KEY, said)

    anchors = text.filter("doc IS NOT NULL").mapInArrow(_by_slice(_anchor_rows, 3), "doc long, sig long, tie long, ordinal int, at int, gram long, before byte, starts byte, again boolean")
    anchors = materialize(anchors, "anchors")
    # Numbers only, so that the minima aggregate in hash maps; the four are those of one row, the first with the least id.
    place = (2 * F.col("at").cast("long") + F.col("again").cast("long")).alias("place")
    leaders = anchors.select("gram", "doc", "sig", "tie", place).groupBy("gram").agg(F.min("doc").alias("f"), F.max("doc").alias("most"), *(F.min_by(c, "doc").alias(f"f_{c}") for c in ("sig", "tie", "place"))).filter("f < most")
    leaders = leaders.select("gram", "f", "f_sig", "f_tie", F.expr("cast(f_place div 2 as int)").alias("f_at"), (F.col("f_place") % 2 == 1).alias("f_again"))
    leaders = materialize(leaders, "leaders")
    seeds = anchors.join(leaders, "gram").groupBy(*KEY).agg(F.collect_set(F.struct("ordinal", "at", "before", "starts", "f", "f_sig", "f_tie", "f_at", "f_again")).alias("seeds"))
    seeds = materialize(seeds, "seeds")
    discard(spark, since, keep=("texts", "seeds"))

    chains = materialize(seeds.mapInArrow(_chain_rows, CHAINS), "chains")
    ask = lambda of, at, side: F.struct(*(F.col(of[k]).alias(KEY[k]) for k in range(3)), (2 * F.col(at) + side).alias("want"))
    asked = chains.select(F.explode(F.array(ask(KEY, "start", 0), ask(KEY, "stop", 1), ask(LEADER, "f_start", 0), ask(LEADER, "f_stop", 1))).alias("q")).select("q.*").distinct()
    wanted = asked.groupBy(*KEY).agg(F.collect_list("want").alias("want"))
    flanks = text.join(wanted, KEY).select(*KEY, "want", "text").mapInArrow(_by_slice(_flank_rows, 4), "doc long, sig long, tie long, want int, words binary")
    # Repeated rows give each flank once.  Done before the joins, so that a leader whom many ask for can be split there.
    flanks = materialize(flanks.dropDuplicates([*KEY, "want"]), "flanks")
    end = lambda side, at, f_at: F.struct(F.lit(side).alias("side"), (2 * F.col(at) + side).alias("want"), (2 * F.col(f_at) + side).alias("f_want"))
    ends = chains.select(*KEY, *LEADER, "start", "stop", F.explode(F.array(end(0, "start", "f_start"), end(1, "stop", "f_stop"))).alias("e")).select(*KEY, *LEADER, "start", "stop", "e.*")
    ours = flanks.withColumnRenamed("words", "ours")
    theirs = flanks.select(F.col("doc").alias("f"), F.col("sig").alias("f_sig"), F.col("tie").alias("f_tie"), F.col("want").alias("f_want"), F.col("words").alias("theirs"))
    beside = ends.join(ours, [*KEY, "want"]).join(theirs, [*LEADER, "f_want"]).select(*KEY, "start", "stop", "side", "ours", "theirs")
    by = beside.mapInArrow(_extend_rows, "doc long, sig long, tie long, start int, stop int, side int, by int")
    grown = by.groupBy(*KEY, "start", "stop").agg(F.sum(F.when(F.col("side") == 0, F.col("by")).otherwise(0)).alias("left"), F.sum(F.when(F.col("side") == 1, F.col("by")).otherwise(0)).alias("right"))
    matches = grown.select(*KEY, (F.col("start") - F.col("left")).cast("int").alias("lo"), (F.col("stop") + F.col("right")).cast("int").alias("hi"))
    matches = materialize(matches.filter(F.col("hi") - F.col("lo") >= LENGTH), "matches")
    discard(spark, since, keep=("texts", "seeds", "matches"))

    ranges = "array<struct<lo: int, hi: int>>"
    by_doc = matches.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("matches"))
    none = F.array().cast(ranges)
    undecided = seeds.join(by_doc, KEY, "left").select(*KEY, "seeds", F.coalesce("matches", none).alias("matches")).mapInArrow(_open_rows, "doc long, sig long, tie long, lo int, hi int")
    undecided = undecided.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    passages = text.join(undecided, KEY).select(*KEY, "ranges", "text").mapInArrow(_by_slice(_passage_rows, 4), "doc long, sig long, tie long, lo int, passage long, also long")
    passages = materialize(passages, "passages")
    least = passages.groupBy("passage", "also").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("passage", "also", "least")
    discard(spark, since, keep=("texts", "matches", "passages"))
    late = passages.join(materialize(least, "shared-passages"), ["passage", "also"]).filter("doc > least").select(*KEY, "lo", (F.col("lo") + LENGTH).alias("hi"))

    cuts = matches.unionByName(late).groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).cast(ranges).alias("cuts"))
    kinds = T.StructType([texts.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    judged = texts.join(cuts, KEY, "left").select("row", said, F.coalesce("cuts", none).alias("cuts"))
    return judged.mapInArrow(_by_slice(_kept_rows, 1), kinds)


def cut_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) without the repeated passages; a document that loses every word goes."""
    rows = remove_repeats(docs)
    left = rows.filter("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return left.select(*(text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))

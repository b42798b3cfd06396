"""Names in documents: all of them in one pass over a text, where each stands first, and which stand together.

One automaton holds up to NAMES names, so a text is read once however many there are; a longer list is cut into
blocks of that size, with one pass for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .chunks import chapters, units

NAMES = 100_000  # names of one automaton
BEFORE, AFTER = 100, 600
FOUND = "doc_id long, chapter int, name_id long, n long, first long"


def mentions_of(automaton: ahocorasick.Automaton, text: str) -> dict[int, tuple[int, int]]:
    """name -> (mentions, place of the first), for every name in a text; mentions of one name do not overlap, those of two may."""
    found: dict[int, list[int]] = {}
    for last, (name, size) in automaton.iter(text):
        own = found.get(name)
        if own is None:
            found[name] = [1, last - size + 1, last]
        elif last - size + 1 > own[2]:
            own[0], own[2] = own[0] + 1, last
    return {name: (n, first) for name, (n, first, _) in found.items()}


def name_mentions(docs: DataFrame, names: DataFrame, by_chapter: bool = True) -> DataFrame:
    """doc_id, chapter, name_id, n (mentions without overlap) and first (UTF-16 offset in the document) of every name that occurs.

    ``names`` has rows (name_id, name); blank names are found nowhere, equal names of several ids are found for each.
    Without ``by_chapter`` a document is one chapter, number 1.  Texts are read in normal form; null ones have no mentions.
    """
    asked = names.filter(F.length(F.trim("name")) > 0).select(F.col("name_id").cast("long").alias("name_id"), "name").orderBy("name_id", "name")
    texts, out, block = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalize_text(F.col("text")).alias("text")), None, []

    def scan(block: list) -> DataFrame:
        by_name: dict[str, list[int]] = {}
        for name_id, name in block:
            by_name.setdefault(name, []).append(name_id)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, ids = ahocorasick.Automaton(), list(by_name.values())
            for k, name in enumerate(by_name):
                automaton.add_word(name, (k, len(name)))
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    parts = [(s, e) for _, s, e in chapters(text)] if by_chapter else [(0, len(text or ""))]
                    at = None
                    for number, (start, end) in enumerate(parts if text else []):
                        for k, (n, first) in mentions_of(automaton, text[start:end]).items():
                            at = units(text) if at is None else at
                            rows += [(doc_id, number + 1, name_id, n, at[start + first]) for name_id in ids[k]]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "chapter", "name_id", "n", "first"])

        return texts.mapInArrow(run, FOUND)

    for r in asked.toLocalIterator():
        block.append((r["name_id"], r["name"]))
        if len(block) == NAMES:
            out, block = scan(block) if out is None else out.unionByName(scan(block)), []
    return (scan(block) if out is None else out.unionByName(scan(block))) if block else (texts.sparkSession.createDataFrame([], FOUND) if out is None else out)


def first_snippets(mentioned: DataFrame, docs: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """doc_id, name_id, n (in the whole document), first, and the text from ``before`` ahead of the first mention to ``after`` behind its start.

    Offsets are UTF-16 units; a pair of units at an edge is not split.
    """
    whole = mentioned.groupBy("doc_id", "name_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    # A document's names travel with it, so its text is encoded once and copied to no name.
    by_doc = whole.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("name_id", "n", "first"))).alias("names"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(normalize_text(F.col("text")), "UTF-16BE").alias("t"))
    low = lambda f: F.greatest(f - before, F.lit(0)).cast("int")

    def cut(x):
        raw = F.substring(F.col("t"), 2 * low(x["first"]) + 1, 2 * (x["first"].cast("int") + after - low(x["first"])))
        return F.struct(x["name_id"].alias("name_id"), x["n"].alias("n"), x["first"].alias("first"), F.hex(raw).alias("raw"))

    rows = by_doc.join(texts, "doc_id").select("doc_id", F.explode(F.transform("names", cut)).alias("x")).select("doc_id", "x.*")
    # Half of a pair at the beginning (DC00-DFFF) or at the end (D800-DBFF) goes.
    clean = F.regexp_replace(F.regexp_replace("raw", "^D[C-F]..", ""), "^((?:....)*)D[89AB]..$", "$1")
    return rows.select("doc_id", "name_id", "n", "first", F.decode(F.unhex(clean), "UTF-16BE").alias("snippet"))


def co_mentions(mentioned: DataFrame) -> DataFrame:
    """first_id, second_id (the larger) and the number of chapters that mention both.

    A task counts the pairs of its chapters, so what is shuffled are distinct pairs of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, ids = batch.column(0).offsets.to_numpy(), batch.column(0).flatten().to_numpy()
            left, right = [], []
            for a, b in zip(edges[:-1] - edges[0], edges[1:] - edges[0], strict=True):
                one = np.unique(ids[a:b])
                i, j = np.triu_indices(len(one), 1)
                left.append(one[i])
                right.append(one[j])
            pairs, n = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n.astype(np.int64))], ["first_id", "second_id", "n"])

    together = mentioned.groupBy("doc_id", "chapter").agg(F.collect_set("name_id").alias("names")).filter(F.size("names") > 1)
    return together.select("names").mapInArrow(run, "first_id long, second_id long, n long").groupBy("first_id", "second_id").agg(F.sum("n").alias("chapters"))

"""Near-duplicate documents by SetSketch registers, with exact confirmation.

1. Every document's set of word shingles is sketched (Ertl, SetSketch, 2021): register i keeps
   floor(1 - log_b of the smallest of the elements' exponential hashes), truncated to 16 bits.
   Registers of a union are the maxima of the parts' registers.
2. Equal sets form a class; from here on one row stands for all of them.
3. Bands of register values are the buckets.  Each bucket links its members to one leader, and
   leaders differ from band to band.  What these links leave apart is compared with the bucket's
   other components, so every two sets that share a bucket are in one component or have
   been compared: the members outside a bucket's largest component against all of it, pair by
   pair in small buckets and otherwise block by block (BLOCK sets a side) as products of
   incidence matrices, of which only links leave a task, one for each two components.
4. For each candidate pair the registers' comparison counts give the likelihood of the
   similarity given the two set sizes; pairs for which the threshold is far less likely than the best
   estimate leave.  The rest is confirmed on the full sets.  Both hold for every pair, whatever its bucket.
5. Confirmed links are joined to components.

Classes, links and components are those of sets; ids come in at the end, so rows that share an id keep
their own sets.

With 32 bands of 5 registers a pair at similarity 0.8 shares no bucket with probability 3e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, mark, materialize
from .components import components, compose, relabel
from .shingles import shingle_sets
from .words import mix, slices, utf8

BANDS, ROWS = 32, 5
BASE, RATE = 1.02, 20.0
SMALL, BLOCK = 16, 256
DOUBT = 25.0  # natural log of the likelihood ratio beyond which a pair leaves
KEY = ["k1", "k2", "n_shingles"]
_U = np.uint64


def _registers(s: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """(rows, m) SetSketch registers; 0 for an empty row."""
    regs = np.zeros((len(bounds) - 1, m), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return regs
    seeds = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    lowest = np.empty((len(full), m), np.uint64)
    at = bounds[full]
    for i in range(m):
        v = s ^ seeds[i]
        v *= seeds[m + i] | _U(1)
        lowest[:, i] = np.minimum.reduceat(v, at)
    h = -np.log1p(-(lowest.astype(np.float64) + 1.0) / 2.0**64 * (1 - 2.0**-53)) / RATE
    regs[full] = np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, 65535).astype(np.uint16)
    return regs


def _set_keys(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's hashed shingles: equal for equal sets, 0 for empty ones."""
    h, empty = mix(s), np.diff(bounds) == 0
    one, two = (np.add.reduceat(np.append(x, _U(0)), bounds[:-1]) for x in (h, mix(h ^ _U(0x5851F42D4C957F2D))))
    one[empty], two[empty] = 0, 0
    return one.view(np.int64), two.view(np.int64)


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str, m: int = BANDS * ROWS) -> DataFrame:
    """doc_id, a hash of the text (tie), n_shingles, a 128-bit key of the set (k1, k2) and the registers of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in slices(offsets, 1 << 19):
                s, bounds = shingle_sets(data, offsets[i : j + 1], k)
                one, two = _set_keys(s, bounds)
                regs = [r.tobytes() for r in _registers(s, bounds, m).astype("<u2")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(one), pa.array(two), pa.array(regs, pa.binary())],
                    ["doc_id", "tie", "n_shingles", "k1", "k2", "regs"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(sketch, "doc_id long, tie long, n_shingles long, k1 long, k2 long, regs binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, the key of the set and its sorted shingle hashes, of rows (doc_id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                s, bounds = shingle_sets(data, offsets[i : j + 1], k)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, _set_keys(s, bounds)), pa.array(np.diff(bounds)), lists], ["doc_id", *KEY, "shingles"])

    return rows.select("doc_id", "text").mapInArrow(sets, "doc_id long, k1 long, k2 long, n_shingles long, shingles array<long>")


def likelihood_gap(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, steps: int = 100) -> np.ndarray:
    """By how much (natural log) the best similarity beats the best one from ``threshold`` on; 0 if it is there."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    j = np.linspace(0, 1, steps + 1)[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / math.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    score = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1))
    score[j > np.minimum(u / v, v / u) + 1 / steps] = -np.inf
    high = np.where(j >= threshold - 1 / steps, score, -np.inf).max(axis=1)
    return score.max(axis=1) - high


def _register_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _screen(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs whose sizes and registers do not speak against the threshold."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                gap = likelihood_gap(*(_register_matrix(part.column(c)) for c in (4, 5)), part.column(2).to_numpy(), part.column(3).to_numpy(), threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(gap)], ["a", "b", "gap"])

    left = nodes.select(F.col("cid").alias("a"), F.col("n_shingles").alias("n_a"), F.col("regs").alias("r_a"))
    right = nodes.select(F.col("cid").alias("b"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("r_b"))
    both = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    judged = both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(judge, "a long, b long, gap double")
    return judged.filter(F.col("gap") <= DOUBT).select("a", "b")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("s_a") + F.size("s_b")).alias("n"), both.alias("both"))
    return sized.filter(100 * F.col("both") >= percent * (F.col("n") - F.col("both"))).select("a", "b")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The sizes of the intersections of two lists of sets, as products of incidence matrices."""
    size = np.array([len(x) for x in (*left, *right)], np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    _, item, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = count[item] > 1
    owner, item = owner[use], shared[item[use]]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(item[-1]) + 1 if len(item) else 0, width):
        a, b = np.searchsorted(item, [low, low + width])
        m = np.zeros((len(size), width), np.float32)
        m[owner[a:b], item[a:b] - low] = 1
        both += m[: len(left)] @ m[len(left) :].T
    return both


def block_links(group: dict[str, np.ndarray], regs: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A link for each two components of a block that have one: between rows with ``left`` and rows without."""
    x, y = np.flatnonzero(group["left"]), np.flatnonzero(~group["left"])
    size, component = np.array([len(s) for s in sets], np.int64), group["component"]
    both = shared_counts([sets[k] for k in x], [sets[k] for k in y])
    a, b = np.nonzero((100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)) & (component[x][:, None] != component[y][None, :]))
    a, b = x[a], y[b]
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 2000):
        u, v = a[at : at + 2000], b[at : at + 2000]
        keep[at : at + 2000] = likelihood_gap(regs[u], regs[v], size[u], size[v], percent / 100) <= DOUBT
    a, b = a[keep], b[keep]
    low, high = np.minimum(component[a], component[b]), np.maximum(component[a], component[b])
    _, first = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)
    return group["cid"][a[first]], group["cid"][b[first]]


def _blockwise(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within buckets (bucket, cid, component, n, n_other, other): blocks of the rows with ``other`` against blocks of all."""

    def compare(table: pa.Table) -> pa.Table:
        at = table.column("shingles").combine_chunks()
        flat, ends = at.flatten().to_numpy(zero_copy_only=False), at.offsets.to_numpy() - at.offsets[0].as_py()
        rows = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        group = {c: table.column(c).to_numpy() for c in ("cid", "component", "left")}
        if group["left"].all() or not group["left"].any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = block_links(group, _register_matrix(table.column("regs").combine_chunks()), rows, percent)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "cid"), blocks(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    right = apart.select("bucket", "cid", "component", own("n", 1).alias("j"), F.lit(False).alias("left"), every("n_other").alias("i"))
    left = apart.filter("other").select("bucket", "cid", "component", own("n_other", 0).alias("i"), F.lit(True).alias("left"), every("n").alias("j"))
    full = right.unionByName(left).join(sets.select("cid", "regs", "shingles"), "cid")
    return full.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


class SetComponents:
    """The classes of equal shingle sets, and the components that near-duplicate links make of them.

    ``sig`` has every row; ``member`` (doc_id, tie, n_shingles, cid, rep, copies) the rows with shingles and
    an id: their class, its smallest id and its number of rows; ``labels`` (node, component)
    the classes that have links.
    """

    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> None:
        since = mark()
        self.sig = materialize(sketches(docs, k, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "sketches")
        linked = self.sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        # Written first: a join with the output of an aggregate could not be split where many copies share a key.
        classes = materialize(linked.groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.min_by("rid", "doc_id").alias("cid"), F.count("*").alias("copies")), "representatives")
        regs = F.when(F.col("rid") == F.col("cid"), F.col("regs")).alias("regs")
        self.member = materialize(linked.join(classes, KEY).select("doc_id", "tie", *KEY, "cid", "rep", "copies", regs), "members")
        nodes = self.member.filter("regs IS NOT NULL")

        width = 2 * ROWS
        keys = F.array(*(F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(BANDS)))
        buckets = nodes.select("cid", F.xxhash64(*KEY).alias("key"), F.explode(keys).alias("bucket"))
        first = F.xxhash64("bucket", "key")  # by the set alone, so that reruns choose alike
        leaders = buckets.groupBy("bucket").agg(F.min_by("cid", first).alias("leader"), F.count("*").alias("n")).filter("n > 1")
        shared = materialize(buckets.join(leaders.select("bucket", "leader"), "bucket").select("bucket", "cid", "leader"), "buckets")
        pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
        stars = materialize(shared.filter("cid <> leader").select(F.col("cid").alias("x"), F.col("leader").alias("y")).select(*pair).distinct(), "stars")

        candidates = shared.select("cid").distinct().join(nodes.select("cid", "doc_id", *KEY, "regs"), "cid")
        texts = _rows(docs, id_col, text_col).join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
        sets = materialize(_sets(texts, k).join(candidates, ["doc_id", *KEY]).select("cid", "n_shingles", "regs", "shingles").dropDuplicates(["cid"]), "sets")
        threshold = percent / 100
        edges = materialize(_confirm(_screen(stars, sets, threshold), sets, percent), "links")
        found = components(edges)

        # What is still apart within a bucket: the members outside its largest component, against all.
        label = shared.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").select("bucket", "cid", F.coalesce("component", "cid").alias("component"))
        parts = label.groupBy("bucket", "component").agg(F.count("*").alias("c"))
        split = parts.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("n_other")).filter("n_other > 0")
        apart = materialize(label.join(split, "bucket").withColumn("other", F.col("component") != F.col("largest")), "apart")
        few = apart.filter(F.col("n") <= SMALL)
        left, right = few.filter("other").select("bucket", F.col("cid").alias("x"), F.col("component").alias("cx")), few.select("bucket", F.col("cid").alias("y"), F.col("component").alias("cy"))
        rest = left.join(right, "bucket").filter("cx <> cy").select(*pair).distinct()
        rest = materialize(rest.join(stars, ["a", "b"], "left_anti"), "rest")
        more = _confirm(_screen(rest, sets, threshold), sets, percent).unionByName(_blockwise(apart.filter(F.col("n") > SMALL), sets, percent))
        more = materialize(more, "links")
        self.labels = merge(found, more)
        discard(docs.sparkSession, since, keep=("sketches", "members", "labels"))


def merge(found: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) with further links (a, b) taken in."""
    if links.limit(1).count():
        merged = components(relabel(links, found))
        alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
        found = compose(found.unionByName(alone), merged)
    return materialize(found, "labels")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row.

    Two rows are linked if their sets of ``k``-word shingles have a Jaccard similarity of at
    least ``percent`` / 100, or if they have the same id.  Rows without words are linked with nothing.  Each row
    that repeats an id has its own n_shingles and the component of its id.  A null id takes part in no link: its
    component is null and the row is kept.  Other columns are not carried.
    """
    c = SetComponents(docs, k, percent, id_col, text_col)
    member = c.member.select("doc_id", "n_shingles", "cid", "rep")
    several = member.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("_most")).filter("a < _most").select("doc_id", "a")
    same_id = member.join(several, "doc_id").filter("a <> cid").select("a", F.col("cid").alias("b")).distinct()
    labels = merge(c.labels, materialize(same_id, "same-ids"))
    named = materialize(labels.join(member.select(F.col("cid").alias("node"), "rep").distinct(), "node"), "named")
    least = materialize(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
    names = materialize(named.join(least, "component").select(F.col("node").alias("cid"), "least"), "names")
    by_doc = member.join(names, "cid", "left").select("doc_id", "n_shingles", F.coalesce("least", "rep").alias("component_id"))
    alone = c.sig.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return by_doc.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def unique_documents(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, of which one of each group of near duplicates stays.

    Groups are made of texts, whatever their ids: the row with the smallest id stays, of several with it the one with the
    smallest hash of its text, of several with both the first in the order of their JSON.  A row whose text has
    no near duplicate stays even where its id is repeated, and so do rows without an id or without words.
    """
    c = SetComponents(docs, k, percent, id_col, text_col)
    label = c.labels.select(F.col("node").alias("cid"), "component")
    row = F.struct("doc_id", "tie")
    grouped = c.member.select("doc_id", "tie", "cid", "copies").join(label, "cid", "left").filter("copies > 1 OR component IS NOT NULL")
    grouped = materialize(grouped.select("doc_id", "tie", F.coalesce("component", "cid").alias("component")), "groups")
    winners = materialize(grouped.groupBy("component").agg(F.min(row).alias("first")), "winners")
    fate = grouped.join(winners, "component").groupBy("doc_id", "tie").agg(F.bool_or(row == F.col("first")).alias("stays"), F.count("*").alias("n"))
    fate = materialize(fate.filter("NOT stays OR n > 1").select(F.col("doc_id").alias("_f_id"), F.col("tie").alias("_f_tie"), "stays"), "fate")

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(whole, F.col(id_col).cast("long").alias("_d"), F.xxhash64(F.col(text_col).cast("string")).alias("_t"))
    same = (F.col("_d") == F.col("_f_id")) & (F.col("_t") == F.col("_f_tie"))
    kept = rows.join(fate, same, "left_anti").select("_row")
    if fate.filter("stays").limit(1).count():
        repeated = rows.join(fate.filter("stays"), same, "left_semi")
        one = repeated.groupBy("_d", "_t").agg(F.min_by("_row", F.to_json(F.struct("_row"))).alias("_row"))
        kept = kept.unionByName(one.select("_row"))
    return kept.select("_row.*")

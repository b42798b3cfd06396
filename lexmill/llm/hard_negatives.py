"""Hard negatives by one-dimensional distance keys.

The largest inner product becomes the nearest neighbour: with M the largest norm, a row x is stored as
(x, sqrt(M² - |x|²)) and an anchor q asked as (q, 0); their squared distance is |q|² + M² - 2 q·x.  A row's key is
its nearest pivot and the distance from it, and the table is written sorted by that key, in blocks of at most BLOCK
rows of one pivot.  A row within R of an anchor at distance D from a pivot has a key in [D - R, D + R], so a
search reads key intervals:

1. the anchor's own block gives each search a first k-th score, so a radius (where it has fewer than k rows
   that count, the radius begins at a quarter of the largest distance and doubles);
2. the blocks whose interval meets the annulus of that radius, and have not been read, are read;
3. a search is certified when its k-th score is at a distance within its radius, or its radius holds every score
   that counts.  What is not certified goes on with a larger radius.

Anchors travel in groups of at most GROUP, so that a group and a block make one matrix product.  The blocks that one
task has written are a bin: a group is sent once to each bin in which it asks for blocks, and meets them there.  A block's tile is
left out for anchors whose annulus misses it.  Scores are integers: float64 products are exact below 2^53, int64 ones
are taken above; vectors whose inner products no long can hold are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .whitening import integer_vectors, matrix

SCALE, BUCKETS = 256, 10
POSITIVES, NEGATIVES, EVERY = 5, 10, 100
PIVOTS, SAMPLE = 64, 4096  # pivots, and the rows they are fitted on (those with the smallest hashes)
BLOCK, GROUP, TILE = 4096, 2048, 1 << 21  # rows, anchors, scores held at once
FOUND = "anchor long, slot int, score long, id long, row long"


def fit_pivots(sample: np.ndarray, count: int, turns: int = 8) -> np.ndarray:
    """Centres of at most ``count`` clusters of the sample: farthest points first, then Lloyd's turns."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    at, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(at) < min(count, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    centres = sample[at].copy()
    for _ in range(turns):
        own = (sample**2).sum(axis=1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(axis=1)
        own = own.argmin(axis=1)
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(axis=0)
    return centres


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(points, pivots) distances; off by less than 1e-6 of the largest norm, which the intervals allow for."""
    square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class DistanceIndex:
    """Integer vectors (row, id, label, x) sorted by (pivot, distance from it) in written blocks.

    ``blocks``: bin, block, pivot, lo, hi, ids, labels, rows, x (all rows' components in one array); ``where``: row, its block (own), its bin, pivot and lo.
    """

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK) -> None:
        norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
        n, top = vectors.agg(F.count("*"), F.max(norm)).first()
        self.n, self.top = n, float(top or 0) * (1 + 1e-12)
        if self.top >= 2.0**63:
            raise OverflowError("an inner product of these vectors exceeds a long")
        self.exact = self.top < 2.0**53
        chosen = np.array([r["x"] for r in self._lowest(vectors, sample).select("x").collect()], np.float64) if n else np.zeros((0, 1))
        self.dims = chosen.shape[1]
        self.pivots = fit_pivots(augmented(chosen, self.top), pivots)
        self.reach = 2 * np.sqrt(self.top) + 1  # no distance is larger
        self.slack = 1e-6 * np.sqrt(self.top) + 1e-6
        tasks = max(1, min(-(-n // block), 256), n // 65536)
        keyed = vectors.select("row", "id", "label", "x").mapInArrow(self._keys(), "row long, id long, label int, x array<long>, pivot int, dist double")
        placed = keyed.repartitionByRange(tasks, "pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row")
        spec = "bin long, block long, pivot int, lo double, hi double, ids array<long>, labels array<int>, rows array<long>, x array<long>"
        # A block is one row, so a file's row groups are kept small enough to be read by different tasks.
        self.blocks = materialize(placed.mapInArrow(self._cut(block), spec), "key-blocks", codec="zstd")
        self.where = self.blocks.select(F.col("block").alias("own"), "bin", "pivot", "lo", F.explode("rows").alias("row"))

    def _lowest(self, vectors: DataFrame, sample: int) -> DataFrame:
        """The ``sample`` rows with the smallest hashes.

        Each task sends the driver its own first rows to merge, so only hashes below a bound that about twice as many
        rows of the table meet take part: what is sent doesn't grow with the tasks.  Row numbers keep equal rows apart.
        """
        hashed = vectors.withColumn("_hash", F.xxhash64("id", "x", "row"))
        if (few := 2 * sample + 64) < self.n:
            hashed = hashed.filter(F.col("_hash") < (few << 64) // self.n - (1 << 63))
        return hashed.orderBy("_hash", "row").limit(sample)

    def _keys(self):
        pivots, top, dims = self.pivots, self.top, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = distances(augmented(matrix(batch.column(3), dims), top), pivots) if batch.num_rows else np.zeros((0, 1))
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], [*batch.schema.names, "pivot", "dist"])

        return run

    def _cut(self, block: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            bins: list[int] = []

            def rows() -> Iterator[pa.RecordBatch]:
                whole = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                row, at = whole["row"].to_numpy(), whole["dist"].to_numpy()
                lists = [pa.array([c.to_numpy(zero_copy_only=False)], pa.list_(t)) for c, t in ((whole["id"].combine_chunks().fill_null(NO_ID), pa.int64()), (whole["label"].combine_chunks(), pa.int32()), (whole["row"].combine_chunks(), pa.int64()), (whole["x"].combine_chunks().flatten(), pa.int64()))]
                bins[:] = bins or [row[0]]
                one = [pa.array(bins, pa.int64()), pa.array([row[0]]), pa.array([whole["pivot"][0].as_py()], pa.int32()), pa.array([at[0]]), pa.array([at[-1]])]
                yield pa.RecordBatch.from_arrays([*one, *lists], ["bin", "block", "pivot", "lo", "hi", "ids", "labels", "rows", "x"])

            size, pivot = 0, None
            for batch in batches:
                p = batch.column("pivot").to_numpy()
                edges = np.concatenate([np.flatnonzero(np.diff(p)) + 1, [len(p)]]) if len(p) else np.zeros(0, int)
                at = 0
                for edge in edges:
                    while at < edge:
                        if held and (p[at] != pivot or size == block):
                            yield from rows()
                            size = 0
                        take = min(int(edge) - at, block - size)
                        held.append(batch.slice(at, take))
                        size, at, pivot = size + take, at + take, p[at]
            if held:
                yield from rows()

        return run

    def _windows(self):
        """Key intervals of a group: one row a pivot that the annulus of some anchor of it reaches."""
        pivots, top, dims, slack = self.pivots, self.top, self.dims, self.slack

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in range(batch.num_rows):
                    a = batch.column(1)[g].values
                    d = distances(np.pad(matrix(a.field("x"), dims).astype(np.float64), ((0, 0), (0, 1))), pivots)
                    r = a.field("radius").to_numpy()[:, None] + slack
                    lo, hi = (d - r).min(axis=0), (d + r).max(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[g].as_py()] * len(lo), pa.int64()), pa.array(np.arange(len(lo), dtype=np.int32)), pa.array(lo), pa.array(hi)], ["grp", "pivot", "w_lo", "w_hi"])

        return run

    def _tiles(self, same: bool, seed: bool, k: int):
        pivots, dims, slack, top, exact = self.pivots, self.dims, self.slack, self.top, self.exact

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in range(batch.num_rows):
                    block, pivot, lo, hi = (batch.column(c)[g].as_py() for c in ("block", "pivot", "lo", "hi"))
                    ids, labels, rows = (batch.column(c)[g].values.to_numpy() for c in ("ids", "labels", "rows"))
                    x = batch.column("x")[g].values.to_numpy().reshape(-1, dims)
                    a = batch.column("anchors")[g].values
                    q = matrix(a.field("x"), dims)
                    own = a.field("own").to_numpy() == block
                    if seed:
                        use = np.flatnonzero(own)
                    else:
                        d = distances(np.pad(q.astype(np.float64), ((0, 0), (0, 1))), pivots[pivot : pivot + 1])[:, 0]
                        least = np.maximum(np.maximum(lo - d, d - hi), 0)
                        # Nearer than every score that counts, or read in an earlier turn: nothing to find here.
                        use = np.flatnonzero(~own & (least <= a.field("radius").to_numpy() + slack) & (least > a.field("done").to_numpy() + slack) & (d + hi + slack >= a.field("inner").to_numpy()))
                    for part in np.array_split(use, max(1, -(-len(use) * len(x) // TILE))):
                        if len(part):
                            yield from _best(part, a, q, x, ids, labels, rows, same, exact, k)

        return run

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """anchor, slot, score, id, row and rank of the first ``k`` rows of each slot of each anchor.

        ``anchors``: row, label, x and slots, an array of (slot, cap, floor), the scores that count, not empty.  Rows of the
        anchor's label count, without the anchor itself, or rows of other labels.
        """
        tasks = max(1, self.n // (EVERY * GROUP))
        # Anchors of neighbouring keys share a group; ids within a task are consecutive, so groups do not straddle tasks.
        spread = materialize(anchors.join(self.where, "row").repartitionByRange(tasks, "pivot", "lo", "row").sortWithinPartitions("pivot", "lo", "row").withColumn("grp", F.floor(F.monotonically_increasing_id() / GROUP)), "anchors")
        d2 = lambda score, x: F.sqrt(F.greatest(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) + self.top - 2 * score.cast("double"), F.lit(0.0)))
        inner = d2(F.array_max(F.transform("slots", lambda s: s["cap"])), F.col("x"))
        state = spread.select("grp", "row", "label", "x", "own", "bin", "slots", F.least(inner, F.lit(self.reach)).alias("inner"), F.lit(0.0).alias("radius"), F.lit(float("-inf")).alias("done"))
        found, turn = None, 0
        while True:
            state = materialize(state, "searches")
            if turn and state.isEmpty():
                return found
            groups = state.groupBy("grp").agg(F.collect_list(F.struct("row", "label", "x", "own", "slots", "inner", "radius", "done")).alias("anchors"))
            if turn == 0:
                pairs = state.select("grp", "bin", F.col("own").alias("block")).distinct()
            else:
                windows = groups.mapInArrow(self._windows(), "grp long, pivot int, w_lo double, w_hi double")
                keys = self.blocks.select("bin", "block", "pivot", "lo", "hi")
                pairs = windows.join(keys, "pivot").filter("lo <= w_hi AND hi >= w_lo").select("grp", "bin", "block")
            # Spark takes the size of arrays for that of one element: without the hints it may broadcast a group's copies.
            # Nor is any other table broadcast here that has rows of all anchors.
            wanted_in = pairs.groupBy("grp", "bin").agg(F.collect_list("block").alias("blocks"))
            asked = wanted_in.join(groups.hint("merge"), "grp").join(self.blocks.hint("merge"), "bin").filter("array_contains(blocks, block)").drop("blocks")
            new = asked.mapInArrow(self._tiles(same, turn == 0, k), FOUND)
            every = new if found is None else found.select("anchor", "slot", "score", "id", "row").unionByName(new)
            order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
            found = materialize(every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "found")
            # The k-th score of a full slot bounds what else it can want, the floor what it can want at all.
            full = found.groupBy("anchor", "slot").agg(F.count("*").alias("have"), F.min("score").alias("last")).filter(F.col("have") >= k)
            full = full.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "last"))).alias("lasts"))
            wanted = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["cap"].alias("cap"), F.coalesce(F.col("lasts")[s["slot"]], s["floor"]).alias("floor")))
            goal = F.least(d2(F.array_min(F.transform("wanted", lambda s: s["floor"])), F.col("x")), F.lit(self.reach))
            open_slots = F.exists("wanted", lambda s: F.col("lasts").isNull() | F.col("lasts")[s["slot"]].isNull())
            grown = F.greatest(2 * F.col("radius"), F.lit(self.reach / 4))
            nxt = state.join(full.hint("merge"), "row", "left").withColumn("wanted", wanted).withColumn("goal", goal)
            nxt = nxt.filter(F.col("goal") > F.col("radius")) if turn else nxt
            radius = F.when(open_slots, F.least(F.col("goal"), F.greatest(grown, F.col("inner") + self.reach / 8))).otherwise(F.col("goal"))
            done = F.col("radius") if turn else F.lit(float("-inf"))
            state = nxt.select("grp", "row", "label", "x", "own", "bin", F.col("wanted").alias("slots"), "inner", radius.alias("radius"), done.alias("done"))
            turn += 1


NO_ID = np.iinfo(np.int64).max  # a null id: after every other in the order of ids


def _best(part, a, q, x, ids, labels, rows, same, exact, k) -> Iterator[pa.RecordBatch]:
    """The first ``k`` rows of a block that count, for each slot of some anchors."""
    left = q[part].astype(np.float64) if exact else q[part]
    scores = left @ (x.astype(np.float64) if exact else x).T
    mine, label = a.field("row").to_numpy()[part], a.field("label").to_numpy()[part]
    allowed = label[:, None] == labels[None, :]
    allowed = allowed & (mine[:, None] != rows[None, :]) if same else ~allowed
    slots = a.field("slots")
    edge = slots.offsets.to_numpy()
    fields = {f: slots.flatten().field(f).to_numpy() for f in ("slot", "cap", "floor")}
    base = edge[0]
    out = []
    for j in range(int(np.diff(edge)[part].max(initial=0))):
        has = edge[part] + j < edge[part + 1]
        at = np.where(has, edge[part] + j - base, 0)
        good = allowed & has[:, None] & (scores <= fields["cap"][at][:, None]) & (scores >= fields["floor"][at][:, None])
        i, c = np.nonzero(good)
        if len(i):
            s = scores[i, c].astype(np.int64)
            order = np.lexsort((rows[c], ids[c], -s, i))
            i, c, s = i[order], c[order], s[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, c, s = i[first], c[first], s[first]
            out.append((mine[i], fields["slot"][at][i], s, ids[c], rows[c]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(t)) for o, t in zip(zip(*out, strict=True), (np.int64, np.int32, np.int64, np.int64, np.int64), strict=True)], ["anchor", "slot", "score", "id", "row"])


def mine(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the hard negatives of every anchor.

    Rows with a null label or vector, a null or non-finite component, a component that no long holds after scaling, or a
    length that is not the commonest one take no part.  Every row whose id is a multiple of EVERY is an anchor, repeated
    rows too; a null id is no anchor and comes last among equal scores.  Where the id is a multiple of 7, the
    label is the next of BUCKETS.  An anchor without positives, or a positive without negatives, has no row.  An empty table gives
    an empty result.
    """
    one = F.col(id_col).cast("long")
    label = F.when(F.pmod(one, F.lit(7)) == 0, F.pmod(F.col(label_col) + 1, F.lit(BUCKETS))).otherwise(F.col(label_col))
    numbered = rows.filter(F.col(label_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), one.alias("id"), label.cast("int").alias("label"), F.col(vec_col).alias("vec"))
    vectors = materialize(integer_vectors(numbered, SCALE, vec_col="vec").select("row", "id", "label", "x"), "integer-vectors")
    index = DistanceIndex(vectors, **options)
    anchors = vectors.filter(F.pmod("id", F.lit(EVERY)) == 0)
    slot = lambda number, cap, floor: F.struct(number.cast("int").alias("slot"), cap.cast("long").alias("cap"), floor.cast("long").alias("floor"))
    whole = F.array(slot(F.lit(0), F.lit(np.iinfo(np.int64).max), F.lit(np.iinfo(np.int64).min)))
    positives = index.search(anchors.withColumn("slots", whole), True, POSITIVES)
    # 3 p <= 10 s <= 9 p in steps that stay within a long; a negative p leaves nothing.
    p = F.col("score")
    cap, floor = p - F.expr("(score + 9) div 10"), 3 * F.expr("score div 10") + F.expr("(3 * (score % 10) + 9) div 10")
    slots = positives.filter("score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(slot(F.col("rank"), cap, floor))).alias("slots"))
    negatives = index.search(anchors.join(slots.hint("merge"), "row"), False, NEGATIVES)
    named = positives.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    own = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    both = negatives.withColumnRenamed("score", "negative_score").withColumnRenamed("id", "negative_id").join(named.hint("merge"), ["anchor", "slot"]).join(own, "anchor")
    return both.select("anchor_id", back("positive_id"), F.col("rank").cast("int").alias("rank"), back("negative_id"), "positive_score", "negative_score")

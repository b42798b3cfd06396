"""Hard negatives against all pairs, whitening against rational arithmetic, on odd tables."""

from collections import Counter
from fractions import Fraction
from math import floor, isfinite, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def odd(n=900, d=12, seed=5, scale=1.0):
    """Clusters, many copies of one vector, ties, repeated and null ids, and rows that take no part."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d))
    rows = []
    for i in range(n):
        v = centres[i % 6] + 0.4 * r.normal(size=d) if i % 3 else centres[0]
        rows.append((i, [float(c) for c in scale * v], int(r.integers(10)) if i % 4 else 1))
    rows += [rows[100], rows[200], (None, rows[3][1], 2), (None, rows[3][1], 3), (2**62, [0.0] * d, 4), (-100, [float(c) for c in -scale * centres[0]], 5)]
    bad = [(1000, None, 1), (1100, [None] + [1.0] * (d - 1), 1), (1200, [float("nan")] * d, 1), (1300, [float("inf")] + [1.0] * (d - 1), 1), (1400, [1.0] * (d - 1), 1), (1500, [], 1)]
    return rows, bad


def plain_negatives(rows):
    v = []
    for i, vec, label in rows:
        x = [floor(256 * c) for c in vec]
        v.append((i, x, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    x = np.array([r[1] for r in v], object)
    last = 1 << 70
    out = []
    for a, (i, q, label) in enumerate(v):
        if i is None or i % 100:
            continue
        s = [int(t) for t in x @ np.array(q, object)]
        near = sorted((-s[b], v[b][0] if v[b][0] is not None else last) for b in range(len(v)) if b != a and v[b][2] == label)
        far = sorted((-s[b], v[b][0] if v[b][0] is not None else last) for b in range(len(v)) if v[b][2] != label)
        for p, pid in near[:5]:
            fit = [(t, nid) for t, nid in far if 30 * -p <= 100 * -t <= 90 * -p][:10]
            out += [(i, None if pid == last else pid, k + 1, None if nid == last else nid, -p, -t) for k, (t, nid) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("scale, options", [(1.0, {"block": 40, "pivots": 5}), (300_000.0, {"block": 64, "pivots": 7}), (0.0, {})], ids=["small blocks", "beyond 2^53", "zeros"])
def test_hard_negatives_are_those_of_all_pairs(spark, scale, options):
    rows, bad = odd(scale=scale)
    df = spark.createDataFrame(rows + bad + [(1600, [1.0] * 12, None)], SCHEMA).select("*", F.lit("clash").alias("row"), F.lit(1).alias("a.b"), F.lit(0).alias("x"))
    got = hard_negatives.mine(df.repartition(7), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert Counter(tuple(r) for r in got.collect()) == want and (scale == 0 or len(want) > 100)


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, None, 1)], SCHEMA)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, [1.0, 0.0], 1)], SCHEMA)).count() == 0
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 2), (2, [0.5, 0.0], 3)]
    assert [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(few, SCHEMA)).collect()] == [(0, 1, 1, 2, 65536, 32768)]


def test_clustered_vectors_leave_blocks_unread(spark):
    """Tight, distant clusters: certified searches read a part of the blocks only."""
    r = np.random.default_rng(2)
    centres = 10 * r.normal(size=(16, 8))
    rows = [(i, [float(c) for c in centres[i % 16] + 0.01 * r.normal(size=8)], i // 16 % 10) for i in range(3200)]
    vectors = whitening.integer_vectors(spark.createDataFrame(rows, SCHEMA), 256).select(F.col("vec_id").alias("row"), F.col("vec_id").alias("id"), "label", "x")
    index = hard_negatives.DistanceIndex(vectors, pivots=16, block=100)
    reads = spark.sparkContext.accumulator(0)
    tiles = index._tiles

    def counted(*args):
        run = tiles(*args)

        def some(batches):
            for b in batches:
                reads.add(b.num_rows)
                yield from run(iter([b]))

        return some

    index._tiles = counted
    slots = F.array(F.struct(F.lit(0).alias("slot"), F.lit(2**63 - 1).alias("cap"), F.lit(-(2**63)).alias("floor")))
    found = index.search(vectors.filter("id % 400 = 0").withColumn("slots", slots), True, 3)
    assert found.count() == 24 and reads.value < index.blocks.count()


def most_sent(spark, since=-1):
    """The last stage's id, and the most bytes that tasks of one stage after ``since`` have sent the driver."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    stages = [(s.stageId(), s.resultSize()) for s in (found.apply(i) for i in range(found.size()))]
    return max((i for i, _ in stages), default=-1), max((size for i, size in stages if i > since), default=0)


def test_sample_sent_to_the_driver_does_not_grow_with_the_tasks(spark):
    x = F.array(*(F.xxhash64("id", F.lit(c)) % 256 for c in range(32)))
    vectors = spark.range(32_000, numPartitions=64).select(F.col("id").alias("row"), "id", F.lit(1).alias("label"), x.alias("x"))
    since, _ = most_sent(spark)
    index = hard_negatives.DistanceIndex(vectors, pivots=4, sample=400)
    assert index.n == 32_000 and most_sent(spark, since)[1] < 1_000_000
    picked = {r["row"] for r in index._lowest(vectors, 400).collect()}
    assert picked == {r["row"] for r in vectors.orderBy(F.xxhash64("id", "x", "row"), "row").limit(400).collect()} and len(picked) == 400


def test_groups_of_anchors_are_not_broadcast(spark):
    """Each of 100 blocks meets a group of 250 anchors: broadcast, its copies for each block would pass through the driver (15 MB before compression)."""
    x = F.array(*(F.xxhash64("id", F.lit(c)) % 256 for c in range(64)))
    vectors = spark.range(5000, numPartitions=4).select(F.col("id").alias("row"), "id", (F.col("id") % 3).cast("int").alias("label"), x.alias("x"))
    index = hard_negatives.DistanceIndex(vectors, pivots=4, block=50, sample=200)
    slots = F.array(F.struct(F.lit(0).alias("slot"), F.lit(2**63 - 1).alias("cap"), F.lit(-(2**63)).alias("floor")))
    since, _ = most_sent(spark)
    assert index.search(vectors.filter("id % 20 = 0").withColumn("slots", slots), True, 3).count() == 750
    assert most_sent(spark, since)[1] < 1_000_000


def plain_whitening(rows):
    x = [(i, [floor(1024 * c) + 100_000 for c in vec]) for i, vec, _ in rows]
    n, d = len(x), len(x[0][1])
    sums = [sum(v[j] for _, v in x) for j in range(d)]
    cov = [[Fraction(n * sum(v[a] * v[b] for _, v in x) - sums[a] * sums[b], n * n) for b in range(d)] for a in range(d)]
    deviation = Counter((i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in x)
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for _, v in x])
    return np.array(cov, float), deviation, centred


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e12])
def test_whitening_equals_rational_arithmetic(spark, scale):
    rows, bad = odd(n=400, d=11, scale=scale)
    df = spark.createDataFrame(rows + bad, SCHEMA).select("*", F.lit("clash").alias("x"), F.lit(1).alias("a.b"), F.lit(0).alias("n")).repartition(6)
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    cov, deviation, centred = plain_whitening(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1) == deviation
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {len(rows)} and got[0]["identity_error"] <= 1e-9
    for c in range(8):
        mine = np.sort([r["whitened"] for r in got if r["component"] == c + 1])
        want = centred @ vectors[:, c] / sqrt(values[c])
        assert min(np.abs(mine - np.sort(want)).max(), np.abs(mine - np.sort(-want)).max()) < 1e-6
        share = {r["explained"] for r in got if r["component"] == c + 1}
        assert len(share) == 1 and abs(share.pop() / (values[c] / np.trace(cov)) - 1) < 1e-9


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], None)], SCHEMA)).collect()
    assert [tuple(r)[:4] for r in one] == [(1, 1, 1, 0), (1, 2, 1, 0)] and all(r["whitened"] == 0 and r["explained"] == 0 and isfinite(r["identity_error"]) for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0, 2.0], 0) for i in range(9)], SCHEMA)).collect()
    assert {r["component"]: r["explained"] for r in flat} == {1: 1.0, 2: 0.0, 3: 0.0} and flat[0]["identity_error"] < 1e-9


def test_products_of_any_size():
    r = np.random.default_rng(4)
    for top in (5, 1 << 21, 1 << 40, (1 << 62) - 1):
        y = r.integers(-top, top, (1100, 3))
        assert (whitening.exact_products(y) == y.astype(object).T @ y.astype(object)).all()

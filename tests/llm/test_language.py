"""The byte network against direct convolution, finite differences and plain sampling."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import language
from lexmill.llm.language import FILTERS, WIDTHS, WINDOW, ByteNet

DOCS = "/root/testdata/sf0.01/documents.parquet"


def direct(net, window):
    """The probabilities of one window, filter by filter and place by place."""
    e = net.embed[window].astype(np.float64)
    peaks = []
    for w in WIDTHS:
        f = net.filters[w].astype(np.float64)
        for k in range(FILTERS):
            peaks.append(max(sum(float(e[at + j] @ f[j, :, k]) for j in range(w)) for at in range(len(window) - w + 1)))
    h = np.maximum(np.array(peaks) + net.bias, 0)
    z = h @ net.out + net.out_bias
    p = np.exp(z - z.max())
    return p / p.sum()


def trained(spark):
    return language.train(language.labelled_sample(spark.read.parquet(DOCS)))


def test_folded_tables_equal_direct_convolution():
    r = np.random.default_rng(2)
    net = ByteNet(["a", "b", "c"])
    x = r.integers(0, 256, (5, WINDOW), dtype=np.uint8)
    got = net.probabilities(x)
    for k in range(5):
        assert np.abs(got[k] - direct(net, x[k])).max() < 1e-5


def test_gradients_equal_finite_differences():
    r = np.random.default_rng(3)
    net = ByteNet(["a", "b"])
    params = [net.embed, *net.filters.values(), net.bias, net.out, net.out_bias]
    for p in params:
        p[...] = r.normal(0, 0.4, p.shape)
    x, y = r.integers(0, 40, (6, WINDOW), dtype=np.uint8), r.integers(0, 2, 6)

    def loss():
        return -np.mean([np.log(direct(net, w)[t]) for w, t in zip(x[:, :WINDOW], y, strict=True)])

    grads = net._gradients(x, y)
    for p, g in zip(params, grads, strict=True):
        flat, own = p.reshape(-1), g.reshape(-1)
        for at in [int(np.abs(own).argmax()), *r.integers(0, len(flat), 2).tolist()]:
            was, step = flat[at], 1e-2
            flat[at] = was + step
            high = loss()
            flat[at] = was - step
            low = loss()
            flat[at] = was
            assert own[at] == pytest.approx((high - low) / (2 * step), abs=3e-3)


def test_predictions_equal_a_plain_version(spark):
    docs = spark.read.parquet(DOCS).filter("doc_id % 40 = 0")
    net = trained(spark)
    rows = docs.select("doc_id", "text").collect() + [(-1, "é" * 200), (-2, "123 !!"), (-3, None), (-4, "a")]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    labelled = spark.read.parquet(DOCS).select("doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in language.identify(labelled.unionByName(df.withColumn("doc_id", F.col("doc_id") - 10_000))).collect()}
    for i, text in rows:
        raw, r = (text or "").encode(), got[i - 10_000]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        windows = [raw[k : k + WINDOW] for k in range(0, len(raw), WINDOW)]
        p = sum(direct(net, language.as_window(w)) * len(w) for w in windows[:60]) / sum(map(len, windows[:60]))
        if len(windows) <= 60:
            assert r["lang_pred"] == net.langs[int(p.argmax())] and r["score"] == pytest.approx(p.max(), abs=1e-4)


def test_samples_are_the_smallest_hashes_whatever_the_ids(spark):
    docs = spark.read.parquet(DOCS)
    langs = {lang for lang, _ in language.labelled_sample(docs)}
    learned = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    for ids in (F.col("doc_id"), F.lit(None).cast("long"), F.lit(learned).cast("long"), F.col("doc_id") % 7):
        df = docs.withColumn("doc_id", ids)
        for limit in (20, 200, 10_000):
            rows = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~language.held_out()).select(F.xxhash64(F.lit("sample"), "doc_id", "text").alias("o"), "lang").distinct()
            want = [r["lang"] for r in rows.orderBy("o", "lang").limit(limit).collect()]
            got = language.labelled_sample(df, limit)
            assert [lang for lang, _ in got] == want and len(got) == min(limit, len(want)) > 0
            assert got == language.labelled_sample(df.repartition(7), limit)
    same = docs.filter(F.col("doc_id") == 3).withColumn("doc_id", F.lit(learned).cast("long")).withColumn("lang", F.lit("en")).crossJoin(spark.range(3000).select(F.lit(1).alias("_x"))).drop("_x")
    assert len(language.labelled_sample(same, 500)) == 1
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    pred = language.identify(nulls, 50).filter("lang_pred <> 'und'").select("lang_pred").distinct().collect()
    assert {r[0] for r in pred} <= langs and pred


def test_equal_rows_are_judged_alike(spark):
    docs = spark.read.parquet(DOCS).filter("doc_id < 50")
    twice = docs.unionByName(docs).repartition(5)
    seen = {}
    for r in language.identify(twice).collect():
        assert seen.setdefault(r["doc_id"], (r["held_out"], r["lang_pred"], r["score"])) == (r["held_out"], r["lang_pred"], r["score"])

"""Exact duplicates against plain grouping: pieces, colliding fingerprints, salts, odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import exact_dedup
from lexmill.llm.exact_dedup import PRIMES, Polynomial

LONG = "long text \t with  runs " * 4000
ROWS = [
    (5, "same words"), (3, "same \t\nwords"), (3, "same words"), (9, " same words"), (None, "same words"), (None, "lone"), (None, "lone "), (None, "lone  "), (7, None), (6, ""), (8, " "), (4, "\n\n"),
    (10, LONG), (11, LONG.replace("\t", " ")), (12, LONG + "x"), (13, "é漢 x"), (14, "é漢 x"), (15, "Same words"), (2**62, "z"), (-5, "z"), (1, "\x00"), (2, "\x00\x00"),
]


def plain(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append((doc is None, doc or 0, i))
    out = []
    for text, members in groups.items():
        first = min(members)
        for none, doc, i in members:
            out.append((None if none else doc, None if first[0] else first[1], len(members), (none, doc, i) == first, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"huge": 40, "piece": 7, "compared": 999, "salted": 300}, {"primes": (3,), "compared": 999, "salted": 300}], ids=["whole", "pieces", "collisions"])
def test_groups_of_odd_rows(spark, options):
    df = spark.createDataFrame(ROWS * 2, "doc_id long, text string").select("*", F.lit("clash").alias("size"), F.lit(1).alias("h1"), F.lit(2).alias("a.b"), F.lit(3).alias("row_id"), F.lit(4).alias("kept"))
    got = exact_dedup.exact_duplicates(df.repartition(5), **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(ROWS * 2)


def test_one_row_of_a_group_stays_unchanged(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("row", F.lit("clash"))
    left = exact_dedup.unique_documents(df)
    assert left.columns == df.columns and left.count() == len({k[4] for k in plain(ROWS)})
    assert {(r["doc_id"], r["text"]) for r in left.collect()} <= set(ROWS)
    assert (None, "lone ") in {(r["doc_id"], r["text"]) for r in left.collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.unique_documents(none).count() == 0


def test_primes():
    assert all(p < 2**31 and all(p % d for d in range(2, int(p**0.5) + 1)) for p in PRIMES) and len(set(PRIMES)) == 4


def test_hashes_are_those_of_the_polynomial_and_combine():
    poly, r = Polynomial(), np.random.default_rng(3)
    texts = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 511, 512, 513, 1024, 5000, 3, 2_000_000)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = poly.of_rows(data, offsets)
    for k, p in enumerate(PRIMES):
        base = int(poly.base[k])
        for t, h in zip(texts[:-1], got, strict=False):
            want = 0
            for b in t:
                want = (want * base + b + 1) % p
            assert int(h[k]) == want
    a, b = texts[6], texts[8]
    both = np.frombuffer(a + b, np.uint8)
    assert (poly.combine(got[6:7], got[8:9], np.array([len(b)])) == poly.of_rows(both, np.array([0, len(both)]))).all()


def test_a_stream_reports_rows_that_differ_from_their_leader():
    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("row_id", "leader", "salt", "other", "chunk", "body"), r, strict=True)) for r in rows])
    batches = [batch((1, 1, 0, False, 0, b"ab"), (2, 1, 0, True, 0, b"ab")), batch((3, 1, 0, True, 0, b"ac"), (1, 1, 0, False, 1, b"c"), (2, 1, 0, True, 1, b"c")), batch((3, 1, 0, True, 1, b"d"))]
    assert [r for b in exact_dedup._differing(iter(batches)) for r in b.column(0).to_pylist()] == [3, 3]


def test_a_large_group_goes_to_many_salts(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("copy of one text " * 20).alias("text"))
    g = exact_dedup.ExactGroups(df, salted=10_000)
    v = g.verdicts.groupBy("keep_id", "group_size", "kept").count().collect()
    assert {tuple(r) for r in v} == {(0, 3000, True, 1), (0, 3000, False, 2999)}

"""Stored postings, publication races, leases, clearing and resumable vectors."""

import os
import subprocess
import sys
import textwrap
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lexmill.operators import retrieval
from lexmill.plans import commits, postings, scratch
from lexmill.plans.index_store import IndexFailed, IndexStale, IndexStore
from lexmill.plans.postings import Postings, build_postings

SF = "/root/testdata/sf0.001"
DOCS = [(1, "one two three"), (2, "two three four"), (3, " "), (4, "five")]


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, f"file://{tmp_path}/index")


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_stored_postings_give_the_rows_of_bm25_and_read_their_buckets_only(spark, tmp_path):
    texts, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    build_postings(texts, f"file://{tmp_path}/p")
    index, near = Postings(spark, f"file://{tmp_path}/p"), lambda df: [(*r[:2], round(r[2], 6), r[3]) for r in df.orderBy("query_id", "rank").collect()]
    assert near(index.search(items, 7)) == near(retrieval.bm25(texts, items, 7))
    # A second, smaller query set opens the stored index again: fewer files, no text read.
    few = spark.createDataFrame([(1, "banana"), (2, items.first()["text"].split()[0])], "query_id long, text string")
    again = Postings(spark, f"file://{tmp_path}/p")
    plan = again.blocks(again.asked(few), 3)._jdf.queryExecution().executedPlan().toString()
    opened = {r[0] for r in again._buckets("postings", again.wanted).select("_metadata.file_path").distinct().collect()}
    every = spark.read.parquet(f"file://{tmp_path}/p/postings").inputFiles()
    assert 0 < len(again.wanted) <= 2 and {int(f.split("bucket=")[1].split("/")[0]) for f in opened} <= set(again.wanted) and len(opened) < len(every)
    assert plan.count("PartitionFilters: [bucket") + plan.count("PartitionFilters: [isnotnull(bucket") >= 1 and "documents.parquet" not in plan
    assert near(again.search(few, 3)) == near(retrieval.bm25(texts, few, 3))


def test_blocks_below_the_bound_are_left_out(spark, tmp_path):
    rows = [(i, "common " + f"filler{i} " * (i % 50)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    build_postings(df, f"file://{tmp_path}/p")
    index, query = Postings(spark, f"file://{tmp_path}/p"), spark.createDataFrame([(1, "common"), (2, "common filler77")], "query_id long, text string")
    asked = index.asked(query)
    every = index._buckets("postings", index.wanted).join(asked, ["bucket", "token"])
    kept = index.blocks(asked, 5)
    assert kept.filter("query_id = 1").count() < every.filter("query_id = 1").count()
    rows = lambda d: [(r["query_id"], r["doc_id"], round(r["score"], 6)) for r in d.orderBy("query_id", "rank").collect()]
    assert rows(index.search(query, 5)) == rows(retrieval.bm25(df, query, 5))


def test_an_index_shuffles_its_postings_once_and_writes_no_tokens(spark, tmp_path):
    docs, items = "/root/testdata/sf0.01/documents.parquet", spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before, since = shuffled(), scratch.mark()
    build_postings(spark.read.parquet(docs), f"file://{tmp_path}/p")
    assert Postings(spark, f"file://{tmp_path}/p").search(items).count() == 400
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch._own.written[since:]} == {"asked", "asked-terms"}
    assert shuffled() - before < 4 * os.path.getsize(docs)


def test_few_and_many_queries_score_alike_with_odd_ids(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i * 10**15 - 7, f"common w{i % 7} " + "pad " * (i % 11)) for i in range(300)] + [(None, "common"), (5, ""), (6, None)], "doc_id long, text string")
    queries = spark.createDataFrame([("a", "common w3 w3"), ("b", "pad"), ("c", "nothing"), ("d", None)], "query_id string, text string")
    build_postings(docs, f"file://{tmp_path}/p")
    index = Postings(spark, f"file://{tmp_path}/p")
    rows = lambda: [(r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in index.search(queries, 9).orderBy("query_id", "rank").collect() if r["doc_id"] is not None]
    few = rows()
    monkeypatch.setattr(retrieval, "VOCABULARY", 1)
    many = rows()
    monkeypatch.undo()
    assert [r for r in few if r[0] == "b"] == [r for r in many if r[0] == "b"] and len(few) == 18
    assert few == [(r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in retrieval.bm25(docs, queries, 9).orderBy("query_id", "rank").collect()]


def test_runs_are_merged_into_blocks_across_slices_and_bundles(monkeypatch):
    for name, size in {"TOKENS": 40, "SLICE": 50, "BUNDLE": 12, "BLOCK": 4, "NAMED": 3, "MERGE": 16}.items():
        monkeypatch.setattr(postings, name, size)
    rng = np.random.default_rng(0)
    words = [[f"w{int(w)}" for w in rng.zipf(1.4, rng.integers(0, 30)) % 40] for _ in range(150)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, hi)), pa.array(words[lo:hi], pa.list_(pa.string()))], ["doc_id", "w"]) for lo, hi in ((0, 60), (60, 61), (61, 150))]
    bundles = pa.concat_batches(list(postings._invert(3)(iter(batches))))
    assert {n for x in bundles.column("sizes").to_pylist() for n in x} == {1, 2, 3, 4} and {"", "w1"} < set(bundles.column("name").to_pylist())
    bundles = bundles.take(pc.sort_indices(pa.table(bundles.columns[:3], names=["b", "f", "n"]), sort_keys=[(c, "ascending") for c in "bfn"]))
    blocks = pa.concat_batches(list(postings._merge(9.0)(bundles.slice(at, 7) for at in range(0, bundles.num_rows, 7)))).to_pylist()
    got = sorted((b["token"], e["doc_id"], e["tf"], e["dl"]) for b in blocks for e in b["entries"])
    assert got == sorted((t, i, w.count(t), len(w)) for i, w in enumerate(words) for t in set(w))
    impact = lambda e: e["tf"] * 2.5 / (e["tf"] + 1.5 * (0.25 + 0.75 * e["dl"] / 9))
    assert all(abs(b["top"] - max(map(impact, b["entries"]))) < 1e-12 and b["n"] == len(b["entries"]) <= 4 and b["level"] == int(b["top"] * 16) for b in blocks)
    assert len({b["bucket"] for b in blocks}) == 3 and sum(b["n"] < 4 for b in blocks) < 80


def test_postings_of_another_layout_are_refused(spark, tmp_path):
    spark.createDataFrame([(1, 1.0, 16, "bigint")], "n_docs long, avg_len double, n_buckets int, id_type string").write.parquet(f"file://{tmp_path}/p/stats")
    with pytest.raises(ValueError, match="layout"):
        Postings(spark, f"file://{tmp_path}/p")


def test_an_index_without_words_finds_nothing(spark, tmp_path):
    build_postings(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), f"file://{tmp_path}/p")
    assert Postings(spark, f"file://{tmp_path}/p").search(spark.createDataFrame([(1, "word")], "query_id long, text string")).count() == 0


def test_versions_and_chunk_search(spark, store, docs):
    first = store.build(docs)
    assert store.current() == first and store.state(first) == "published" and store.read().count() == 3
    hits = store.search(spark.createDataFrame([(9, "two four")], "query_id long, text string"), 1).collect()
    assert [(r["query_id"], r["doc_id"], r["chunk_index"], r["rank"]) for r in hits] == [(9, 2, 0, 1)]
    second = store.build(docs.withColumn("text", F.upper("text")))
    assert store.current() == second and store.read(first).count() == 3 and store.retired() == []
    assert sorted(r["doc_id"] for r in store.stale(docs).collect()) == [1, 2, 3, 4]


def test_one_of_two_builders_wins(spark, store, docs):
    a, b = store.begin(), store.begin()
    store._write(docs, __import__("lexmill.operators.chunks", fromlist=["Sizes"]).Sizes(), a[0])
    store.publish(*b, n_chunks=0)
    with pytest.raises(IndexFailed):
        store.publish(*a, n_chunks=3)
    assert [c["version"] for c in store.history()] == [b[0]] and store.state(a[0]) == "failed"


RACE = """
import sys, time
sys.path.insert(0, {root!r})
from lexmill.plans import commits, postings, scratch
while time.time() < {at}: pass
print(sum(commits.create_new(None, "file://{base}/c/%04d" % i, {{"by": sys.argv[1]}}) for i in range(300)))
"""


def test_processes_race_for_commits(tmp_path, spark):
    root = __import__("os").path.dirname(__import__("os").path.dirname(__file__))
    code = textwrap.dedent(RACE).format(root=root, at=time.time() + 4, base=tmp_path)
    both = [subprocess.Popen([sys.executable, "-c", code, w], stdout=subprocess.PIPE, text=True) for w in "ab"]
    won = [int(p.communicate(timeout=60)[0]) for p in both]
    assert sum(won) == 300 and len(commits.names(spark, f"file://{tmp_path}/c")) == 300
    by = [commits.read(spark, f"file://{tmp_path}/c/{i:04d}")["by"] for i in range(300)]
    assert [by.count("a"), by.count("b")] == won


def test_a_crashed_build_is_given_up(spark, store, docs):
    version, number = store.begin(seconds=0.01)
    alive, _ = store.begin(seconds=1000)
    time.sleep(0.05)
    assert store.recover() == [version] and store.recover() == [] and store.state(alive) == "building"
    with pytest.raises(IndexFailed):
        store.publish(version, number)
    with pytest.raises(Exception, match="."):
        store.build(docs.withColumn("text", F.raise_error(F.lit("broken source"))))
    assert store.history() == [] and sum(store.state(v) == "failed" for v in commits.names(spark, f"{store.base}/marks")) == 2


def test_leased_versions_survive_clearing(spark, store, docs):
    one = store.build(docs)
    with store.lease() as held:
        assert held == one
        two, three = store.build(docs), store.build(docs)
        failed = store.begin(seconds=0)[0]
        store.recover(time.time() + 1)
        assert store.clear() == [failed] and store.read(one).count() == 3
    building = store.begin()[0]
    assert store.retired() == [one] + [failed] or set(store.retired()) == {one, failed}
    assert one in store.clear() and store.state(one) == "retired" and store.state(building) == "building"
    with pytest.raises(LookupError):
        store.read(one)
    with pytest.raises(LookupError), store.lease(one):
        pass
    assert store.read(two).count() == store.read(three).count() == 3


def test_an_expired_lease_holds_nothing(spark, store, docs):
    one = store.build(docs)
    with store.lease(seconds=0.01):
        store.build(docs), store.build(docs)
        assert store.clear() == [one]


def test_vectors_resume_after_a_crash(spark, store):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    version = store.build(docs)
    fine, calls = commits.create_new, []

    def dies(spark_, path, body):
        if "vector-commits" in path and not path.endswith("plan"):
            calls.append(path)
            if len(calls) == 3:
                raise KeyboardInterrupt
        return fine(spark_, path, body)

    commits.create_new = dies
    try:
        with pytest.raises(KeyboardInterrupt):
            store.append_vectors(docs, n_batches=5, dims=16)
    finally:
        commits.create_new = fine
    some = store.vectors().count()
    assert 0 < some < 40
    assert store.append_vectors(docs, n_batches=5, dims=16) == 3 and store.append_vectors(docs, n_batches=5, dims=16) == 0
    rows = store.vectors(version).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(40)) and all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-9 for r in rows)
    with pytest.raises(ValueError):
        store.append_vectors(docs, n_batches=6, dims=16)


def test_a_changed_version_stops_the_append(spark, store, docs):
    version = store.build(docs)
    with pytest.raises(IndexStale):
        store.append_vectors(docs.withColumn("text", F.concat("text", F.lit("!"))), n_batches=2, dims=8)
    store.build(docs)
    with pytest.raises(IndexStale):
        store.append_vectors(docs, n_batches=2, dims=8, version=version)
    with pytest.raises(LookupError):
        store.vectors(version)


def test_scopes_prune_partitions(spark, tmp_path):
    rows = [(i, "u%d" % (i % 2), i // 15, "v1", "f" if i != 40 else "g", [0.001 * i if i <= 30 else 0.5 + 0.001 * i] + [0.0] * 3) for i in range(1, 43)]
    columns = "doc_id long, owner string, book int, version string, fingerprint string, embedding array<double>"
    spark.createDataFrame(rows, columns).write.partitionBy(*retrieval.SCOPE).parquet(f"file://{tmp_path}/v")
    stored = spark.read.schema(columns).parquet(f"file://{tmp_path}/v")
    asks = spark.createDataFrame([(1, "u0", 2, "v1", "f", [0.0] * 4), (2, "u1", 9, "v1", "f", [0.0] * 4), (3, "u0", 2, "v2", "f", [0.0] * 4), (4, "u0", 2, "v1", "h", [0.0] * 4)], "query_id long, owner string, book int, version string, fingerprint string, embedding array<double>")
    asks.write.parquet(f"file://{tmp_path}/q")
    got = retrieval.scoped_nearest(stored, spark.read.parquet(f"file://{tmp_path}/q").filter("query_id > 0"), 4)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["query_id"], r["doc_id"]) for r in got.orderBy("query_id", "rank").collect()] == [(1, 30), (1, 32), (1, 34), (1, 36)]

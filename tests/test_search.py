"""Retrieval with statuses, and rates of evaluation runs, on small tables."""

import math

import pytest

from lexmill.functions.text import content_hash
from lexmill.operators import evaluation, retrieval, search


@pytest.fixture(scope="module")
def shelf(spark):
    books = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, None), (4, 1, "a"), (5, 1, "v")], "user_id long, book_id long, active_version string")
    versions = spark.createDataFrame([("a", 1, 1, "ready", "h", "embedding+bm25", "f"), ("b", 2, 1, "ready", "h", "bm25", None), ("v", 5, 1, "ready", "h", "embedding+bm25", "f")], "version string, user_id long, book_id long, status string, content_hash string, mode string, fingerprint string")
    embedders = spark.createDataFrame([(1, "f"), (2, "f"), (5, "g")], "user_id long, fingerprint string")
    bodies = spark.createDataFrame([("a", 1, "anna ben anna"), ("a", 2, "ben clara"), ("a", 3, None), ("b", 4, "anna anna anna"), ("v", 5, "ben")], "version string, doc_id long, text string")
    vectors = spark.createDataFrame([("a", 1, "f", [1.0, 0.0]), ("a", 2, "f", [0.0, 1.0]), ("a", 3, "old", [1.0, 1.0]), ("b", 4, "f", [1.0, 0.0])], "version string, doc_id long, fingerprint string, embedding array<double>")
    return books, versions, embedders, bodies, vectors


REQUESTS = [(1, 1, 1, None, "anna"), (2, 1, 1, "h", "clara"), (3, 1, 1, "other", "anna"), (4, 2, 1, None, "anna"), (5, 3, 1, None, "anna"), (6, 4, 1, None, "anna"), (7, 9, 9, None, "anna"), (8, 1, 1, None, "anna"), (9, 2, 1, None, "nobody"), (10, 5, 1, None, "ben"), (11, 2, 1, None, None)]


def asked(spark):
    return spark.createDataFrame(REQUESTS, "request_id long, user_id long, book_id long, expected_hash string, text string")


def test_each_request_has_its_status(spark, shelf):
    vectors = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.2]), (4, [1.0, 0.0]), (8, None), (10, [1.0, 0.0])], "request_id long, embedding array<double>")
    got = {r["request_id"]: (r["status"], r["code"], r["vector_code"], r["source"], [(h["doc_id"], h["method"]) for h in r["hits"]]) for r in search.search(asked(spark), *shelf, vectors).collect()}
    assert got == {
        1: ("ok", None, None, "hybrid(embedding+bm25)", [(1, "hybrid"), (2, "vector")]),
        2: ("ok", None, None, "hybrid(embedding+bm25)", [(2, "hybrid"), (1, "vector")]),
        3: ("unavailable", "INDEX_STALE", None, None, []),
        4: ("ok", None, "BM25_ONLY", "bm25", [(4, "bm25")]),
        5: ("unavailable", "INDEX_LEGACY", None, None, []),
        6: ("unavailable", "INDEX_UNAVAILABLE", None, None, []),
        7: ("unavailable", "INDEX_UNAVAILABLE", None, None, []),
        8: ("ok", None, "VECTOR_FAILED", "bm25", [(1, "bm25")]),
        9: ("empty", None, "BM25_ONLY", None, []),
        10: ("ok", None, "VECTOR_INCOMPATIBLE", "bm25", [(5, "bm25")]),
        11: ("empty", None, "BM25_ONLY", None, []),
    }
    assert search.search(asked(spark).limit(0), *shelf, vectors).count() == 0


def test_a_reranker_that_fails_leaves_the_fused_order(spark, shelf):
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.2])], "request_id long, embedding array<double>")
    reverse = lambda pool, texts, queries, k: pool.filter("query_id <> 2").selectExpr("query_id", "doc_id", "3 - rank AS rank")
    got = {r["request_id"]: (r["rerank_code"], r["source"], [h["doc_id"] for h in r["hits"]]) for r in search.search(asked(spark), *shelf, vectors, reranker=reverse).collect()}
    assert got[1] == (None, "hybrid(embedding+bm25)+rerank", [2, 1]) and got[2] == ("RERANK_FAILED", "hybrid(embedding+bm25)", [2, 1])
    assert got[4] == (None, "bm25", [4])  # one hit needs no order


def test_scoped_scores_are_those_of_the_version_alone(spark, shelf):
    bodies = shelf[3]
    queries = spark.createDataFrame([(1, "a", "anna ben ben"), (2, "b", "anna ben"), (3, "none", "anna")], "query_id long, version string, text string")
    got = sorted(map(tuple, search.scoped_bm25(bodies, queries).collect()))
    alone = []
    for version in "ab":
        mine = queries.filter(f"version = '{version}'").select("query_id", "text")
        alone += map(tuple, retrieval.bm25(bodies.filter(f"version = '{version}'").select("doc_id", "text"), mine).collect())
    assert got == sorted(alone) and len(got) == 3


def test_rates_of_a_run(spark):
    docs = spark.createDataFrame([(1, "ab\U0001f600cdefgh\r\nij"), (2, None)], "doc_id long, text string")
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", content_hash(docs["text"]).alias("h")).collect()}
    answers = spark.createDataFrame(
        [(1, "r", "answer", "yes", "completed", 1, True), (2, "r", "answer", " ", "failed", 0, True), (3, "r", None, "书中没有提到", None, None, None), (4, "r", "insufficient_evidence", None, "completed", 2, False), (5, None, "answer", "x", "completed", 0, False)],
        "answer_id long, run string, kind string, answer string, end_status string, tool_calls long, needs_evidence boolean",
    )
    evidence = spark.createDataFrame(
        [
            (1, "E1", 1, 1, hashes[1], 2, 5, "\U0001f600c"),  # a pair is two units
            (1, "E2", 2, 1, hashes[1], 9, 12, "h\ni"),  # line ends are normalised
            (1, "E3", 3, 1, "old", 2, 5, "\U0001f600c"),
            (4, "E1", 1, 7, hashes[1], 0, 1, "a"),  # no such document
            (4, "E2", 2, None, None, None, None, "a b c"),
        ],
        "answer_id long, evidence_id string, ordinal int, doc_id long, content_hash string, start int, end int, text string",
    )
    citations = spark.createDataFrame([(1, "E1"), (1, "E3"), (4, "E1"), (4, "E9"), (3, "E1")], "answer_id long, evidence_id string")
    gold = spark.createDataFrame([(1, "h i"), (1, "zz"), (4, "abc"), (2, "q")], "answer_id long, quote string")
    rows = {r["run"]: r.asDict() for r in evaluation.answer_rates(answers, evidence, citations, gold, docs).collect()}
    r = rows["r"]
    assert (r["n_answers"], r["n_errors"], r["n_empty"]) == (4, 2, 2)
    assert (r["coordinate_accuracy"], r["citation_legality"]) == (0.5, 0.4)
    assert (r["hit"], r["recall"], r["mrr"]) == (round(2 / 3, 6), 0.5, round((1 / 2 + 1 / 2 + 0) / 3, 6))
    assert (r["no_evidence_answers"], r["missed_retrieval"], r["no_answer_handling"], r["avg_tool_calls"]) == (0.25, 0.5, 1.0, 0.75)
    assert rows[None]["coordinate_accuracy"] is None and rows[None]["hit"] is None and rows[None]["no_answer_handling"] == 0.0
    assert not math.isnan(rows[None]["no_evidence_answers"]) and evaluation.answer_rates(answers.limit(0), evidence, citations, gold, docs).count() == 0

"""Answers, lookups, scores, semantic recall and the late-row guard on fixed cases."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from lexmill.functions import answers as A
from lexmill.operators import lookup, memory, scoring
from lexmill.streaming import batches


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_summary_caps(spark):
    cap = lambda t, n: value(spark, A.cap_summary(F.lit(t), n))
    assert cap(" short ", 10) == "short"
    assert cap("a" * 60 + "。" + "b" * 100, 60) == "a" * 60 + "。"
    assert cap("a。" + "b" * 198, 60) == "a。" + "b" * 98
    assert cap(None, 5) == ""


def test_memory_values(spark):
    v = lambda k, t: value(spark, A.memory_value(F.lit(k), F.lit(t).cast("string")))
    assert v("preference.answer_length", " Brief ") == "concise" and v("preference.answer_length", "请用详尽的风格") == "detailed"
    assert v("preference.language", "zh - cn") == "zh" and v("preference.language", "说西班牙语吧") == "es" and v("preference.language", "klingon") is None
    assert v("fact.role", " a \n b ") == "a b" and v("fact.role", None) == ""


def test_json_items(spark):
    out = '说明 ```json\n[{"kind": "fact", "sourceMessageId": "12", "sourceRange": ["3", 9]}, 5]\n``` 完'
    items = value(spark, A.json_items(F.lit(out)))
    assert len(items) == 2 and items[1] == "5"
    c = value(spark, A.memory_candidate(F.lit(items[0])))
    assert (c["kind"], c["source_id"], c["range_start"], c["range_end"], c["key"]) == ("fact", 12, 3, 9, None)
    assert value(spark, A.json_items(F.lit("[]"))) == []
    for bad in ("no", "] [", "[1, ", None):
        assert value(spark, A.json_items(F.lit(bad).cast("string"))) is None


def test_styles_notes_and_patterns(spark):
    ok = lambda s, t: value(spark, A.complies(s, F.lit(t)))
    assert ok("bullets", "x\n- a\n 2. b") and not ok("bullets", "- a") and not ok("not_french", "Les amis") and ok("not_french", "lesson") and ok("english", "abc 1") and not ok("english", "中文 a")
    with pytest.raises(ValueError):
        A.complies("loud", F.lit(""))
    n = value(spark, A.chapter_note(F.lit("【摘要】 s \n【金句】\n“q1”\nplain\n「q2」\n\"q3\""), F.lit("has q1 only")))
    assert (n["summary"], n["quotes"]) == ("s", ["q1"])
    assert value(spark, A.chapter_note(F.lit("bare")))["summary"] == "bare"
    assert value(spark, A.says_no_answer(F.lit("书中没有提到"))) and not value(spark, A.says_no_answer(F.lit(None).cast("string")))
    rows = spark.createDataFrame([("a.*", "a.b", True), ("a", "a", True), ("a", "b", False), (None, "x", True), ("a", None, False)], "p string, k string, want boolean")
    assert rows.filter(A.key_matches(F.col("p"), F.col("k")) != F.col("want")).count() == 0
    alt = spark.createDataFrame([("a|b", "b", True), ("a", "b", False), (None, None, True), ("a", None, False)], "p string, k string, want boolean")
    assert alt.filter(A.one_of(F.col("p"), F.col("k")) != F.col("want")).count() == 0
    sel = spark.createDataFrame([("abcd", "h", "h", 1, 3, "bc", "ok"), ("abcd", "h", "g", 1, 3, "bc", "BOOK_CONTENT_CHANGED"), ("abcd", "h", "h", 1, 3, "bd", "INVALID_SELECTION"), ("abcd", "h", "h", None, 3, "bc", "INVALID_SELECTION"), ("abcd", "h", None, 1, 3, "bc", "BOOK_CONTENT_CHANGED")], "t string, h string, g string, s int, e int, x string, want string")
    assert sel.filter(A.selection_verdict(*(F.col(c) for c in "thgsex")) != F.col("want")).count() == 0


BOOK = "第一章 山\n" + "😀" * 800 + "\n第二章 水\nriver Ann\n第三章 水火\nAnnAnn"


def test_chapters_are_found(spark):
    docs = spark.createDataFrame([(1, BOOK), (2, None)], "doc_id long, text string")
    asks = [(1, 1, None, 2, None), (2, 1, None, None, "水"), (3, 1, None, None, "山"), (4, 1, None, None, "river"), (5, 1, None, 9, None), (6, 1, "ch-1-0", None, None), (7, 2, None, 1, None), (8, 1, None, None, None)]
    got = {r["ask_id"]: r for r in lookup.find_chapters(docs, spark.createDataFrame(asks, "ask_id long, doc_id long, chapter_id string, chapter_index int, title string")).collect()}
    assert {k: (r["status"], r["ordinal"]) for k, r in got.items()} == {1: ("ok", 2), 2: ("ambiguous", None), 3: ("ok", 1), 4: ("ok", 2), 5: ("empty", None), 6: ("ok", 1), 7: ("empty", None), 8: ("empty", None)}
    assert [m["ordinal"] for m in got[2]["matches"]] == [2, 3] and got[7]["n_chapters"] == 0
    first = got[3]
    assert first["truncated"] and len(first["text"].encode("utf-16-le")) // 2 == first["end"] - first["start"] == 1500 and "�" not in first["text"]
    assert got[1]["text"] == "第二章 水\nriver Ann\n" and not got[1]["truncated"]


def test_mentions_and_fallback(spark):
    docs = spark.createDataFrame([(1, BOOK), (2, None)], "doc_id long, text string")
    asks = spark.createDataFrame([(1, 1, "Ann"), (2, 1, " "), (3, 2, "Ann"), (4, 1, "Bob")], "ask_id long, doc_id long, name string")
    got = sorted(lookup.mentions(docs, asks).collect(), key=lambda r: r["rank"])
    assert [(r["ask_id"], r["chapter_ordinal"]) for r in got] == [(1, 2), (1, 3), (1, 3)] and got[2]["at"] - got[1]["at"] == 3
    raw = BOOK.encode("utf-16-le")
    assert all(raw[2 * r["start"] : 2 * r["end"]].decode("utf-16-le") == r["text"] for r in got)
    hits = spark.createDataFrame([(4, 1, 1, 0, 3, "x", "bm25")], "ask_id long, doc_id long, rank int, start int, end int, text string, method string")
    both = lookup.with_fallback(hits, docs, asks).collect()
    assert sorted((r["ask_id"], r["method"]) for r in both) == [(1, "fulltext")] * 3 + [(4, "bm25")]
    long = spark.createDataFrame([(1, 1, 5, 2005, "😀" * 1000), (1, 2, 0, 2, "ab")], "k int, rank int, start int, end int, text string")
    cut = {r["rank"]: (r["end"], len(r["text"]), r["truncated"]) for r in lookup.trim_hits(long, "k", size=601).collect()}
    assert cut == {1: (607, 301, True), 2: (2, 2, False)}


def test_calls_and_requests(spark):
    d = spark.createDataFrame([(1, 2, 0, "", "lo", "}"), (1, 1, 0, "c1", "he", "{"), (1, 1, 1, "c2", "x", None)], "response_id int, seq int, call_index int, id string, name string, arguments string")
    assert sorted(tuple(r) for r in lookup.assemble_calls(d).collect()) == [(1, 0, "c1", "helo", "{}"), (1, 1, "c2", "x", "")]
    calls = spark.createDataFrame([(n, i) for n in ("a", "b") for i in range(7 if n == "a" else 2)], "name string, i int")
    assert lookup.call_limits(calls, ["name"], ["i"]).filter("blocked").count() == 2
    known = spark.createDataFrame([(1, "r1", "f", "completed"), (1, "r2", "f", "running")], "user_id int, request_id string, fingerprint string, status string")
    new = spark.createDataFrame([(1, "r1", "f"), (1, "r2", "f"), (1, "r1", "g"), (2, "r1", "f")], "user_id int, request_id string, fingerprint string")
    assert sorted((r["user_id"], r["request_id"], r["fingerprint"], r["verdict"]) for r in lookup.judge_requests(known, new).collect()) == [(1, "r1", "f", "replay"), (1, "r1", "g", "conflict"), (1, "r2", "f", "running"), (2, "r1", "f", "new")]


def test_scores_and_embedding_checks(spark):
    gold = spark.createDataFrame([(1, 1, "interest.*", "user|book", None, None), (1, 2, "fact.role", None, "active", "cook"), (2, 3, None, None, None, None)], "run_id int, gold_id int, key string, scope string, status string, value string")
    saved = spark.createDataFrame([(1, 1, "interest.topic:x", "book", "active", "v"), (1, 2, "fact.role", "user", "active", "baker")], "run_id int, item_id int, key string, scope string, status string, value string")
    assert {r["run_id"]: (r["recall"], r["precision"]) for r in scoring.gold_scores(gold, saved).collect()} == {1: (0.5, 0.5), 2: (0.0, None)}
    requests = spark.createDataFrame([(i, 2) for i in range(1, 7)], "request_id int, n int")
    v, bad = [0.1, 0.2], [0.1, float("nan")]
    items = [(1, 0, 1, v), (1, 1, 0, v), (2, 0, 0, v), (3, 0, 0, v), (3, 1, 0, v), (4, 0, None, [0.1]), (4, 1, None, v), (5, 0, 1, [0.1]), (5, 1, 0, bad)]
    got = scoring.check_embeddings(requests, spark.createDataFrame(items, "request_id int, ordinal int, item_index int, embedding array<double>"), 2)
    assert {r["request_id"]: r["problem"] for r in got.collect()} == {1: None, 2: "count", 3: "index", 4: "dims", 5: "value", 6: "count"}


def test_recall_by_vectors(spark):
    now = dt.datetime(2026, 1, 1)
    rows = [(1, i, "interest", "user", None, t, "active", "user_message", now, now, 0.5, None) for i, t in ((1, "oak trees"), (2, "boats"), (3, "cars"))]
    m = spark.createDataFrame(rows, "user_id long, memory_id long, kind string, scope string, book_id long, content string, status string, source_type string, updated_at timestamp, last_seen_at timestamp, salience double, expires_at timestamp")
    q = spark.createDataFrame([(1, 1, None, "forests")], "user_id long, question_id long, book_id long, question string")
    vec = spark.createDataFrame([(1, "f", [1.0, 0.1]), (2, "f", [0.0, 1.0]), (3, "old", [1.0, 0.0])], "memory_id long, fingerprint string, vec array<double>")
    asked = spark.createDataFrame([(1, 1, "f", [1.0, 0.0])], "user_id long, question_id long, fingerprint string, vec array<double>")
    assert memory.recall(m, q, F.lit(now)).count() == 0
    assert [i["memory_id"] for i in memory.recall(m, q, F.lit(now), vectors=vec, asked=asked).first()["items"]] == [1]


def drain(query):
    """Waits for a batch with rows; with timers on, the stream itself never comes to an end."""
    for _ in range(240):
        if any(p["numInputRows"] for p in query.recentProgress):
            break
        time.sleep(0.5)
    query.stop()


def test_late_rows_of_a_stream(spark, tmp_path):
    kinds = "user_id long, message_id long"
    for n, rows in enumerate([[(1, 5), (1, 3), (2, 1)], [(1, 4), (1, 6), (2, 1)]]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
        q = batches.guard_late(stream, "user_id", "message_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        drain(q)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 3), (1, 5), (1, 6), (2, 1)]

"""The library's own operators: cases with known results, and every query against its SQL on small tables."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import catalog
from lexmill.functions import text as T
from lexmill.functions import vectors as V
from lexmill.operators import chunks, conversation, evidence, lookup, memory, retrieval, reports
from lexmill.plans import dag
from lexmill.plans.index_store import IndexStore
from lexmill.sources import text_files
from lexmill.streaming import batches

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents embeddings conversations benchmark labels events orders".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    plain = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    assert sorted(map(repr, (plain(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, (plain(r[i] for i in at) for r in want.fetchall())))


def test_normal_form_and_hash(spark):
    assert value(spark, T.normalize_text(F.lit("﻿a\r\nb\rc\n d "))) == "a\nb\nc\n d "
    assert value(spark, T.normalize_text(F.lit(None).cast("string"))) == ""
    assert value(spark, T.content_hash(F.lit("a\r\nb"))) == value(spark, T.content_hash(F.lit("a\nb")))


def test_tokens_of_words_and_cjk_runs(spark):
    assert value(spark, T.tokens(F.lit("It's A test-1 北京市 x 中"))) == ["it's", "test-1", "北", "京", "市", "北京", "京市", "中"]
    assert value(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_chapters_and_chunks():
    text = "intro\n第一章 开始\nbody one\n\n第二章 end\nbody two"
    assert [t for t, _, _ in chunks.chapters(text)] == ["前言", "第一章 开始", "第二章 end"]
    assert [t for t, _, _ in chunks.chapters("3.14 is pi\nx")] == ["3.14 is pi"]
    assert chunks.chapters(" \n\t　") == [] and chunks.chapters("plain")[0][0] == "全文"
    with pytest.raises(ValueError):
        chunks.Sizes(0)
    emoji = "😀" * 1500
    cut = list(chunks.chunk(emoji))
    units = np.frombuffer(emoji.encode("utf-16-le"), "<u2")
    assert all(units[s:e].tobytes().decode("utf-16-le") == t for _, _, s, e, t in cut) and cut[-1][3] == 3000
    paragraphs = "".join(f"{'p' * 300} {k}\n\n" for k in range(12))
    parts = list(chunks.chunk(paragraphs, chunks.SMALL))
    assert parts[0][2] == 0 and parts[-1][3] == len(paragraphs) and all(a[3] == b[2] for a, b in zip(parts, parts[1:], strict=False)) and len(parts) == 6


def test_vectors_embedder_and_scope(spark):
    v = spark.createDataFrame([(i, [0.001 * i if i <= 30 else 0.5 + 0.001 * i] + [0.0] * 3, "target" if i > 30 else "other") for i in range(1, 43)], "doc_id long, embedding array<float>, owner string")
    q = spark.createDataFrame([(0, [0.0] * 4)], "query_id long, embedding array<float>")
    got = retrieval.nearest_vectors(v.filter("owner = 'target'"), q, 10, dims=4).collect()
    assert {r["doc_id"] for r in got} == set(range(31, 41))
    assert retrieval.nearest_vectors(v.filter("owner = 'none'"), q, 10, dims=4).count() == 0
    assert abs(np.linalg.norm(V.embed("abc")) - 1) < 1e-9 and not V.embed("").any()
    assert value(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "zzz")], "doc_id long, text string")
    assert retrieval.nearest_texts(docs, spark.createDataFrame([(7, "alpha beta")], "query_id long, text string"), 1).first()["doc_id"] == 1


def log_of(spark, roles, tokens):
    return spark.createDataFrame([(1, i, r, "x", tokens, sum(x == "user" for x in roles[: i + 1])) for i, r in enumerate(roles)], "conv_id long, seq int, role string, text string, tokens int, round int")


def test_compression_cuts(spark):
    cut = lambda roles, n: conversation.compression_cut(log_of(spark, roles, n)).first()["cut"]
    u, a = "user", "assistant"
    assert cut([u, a, u, a, "tool", u, a, u, a, u], 10_000) > 0
    assert cut([u, a] * 5, 100_000) == 4
    assert cut([u, a] * 10, 1000) == -1 and 0 < cut([u, a] * 10, 4000) < 14 and cut([u, a] * 3, 100_000) == -1


def test_ranges_merge_across_parts(spark):
    r = spark.createDataFrame([(1, 0, 15), (1, 8, 12), (1, 12, 20), (1, 21, 22), (2, 5, 6)], "k int, s int, e int")
    want = [(1, 0, 20, 3), (1, 21, 22, 1), (2, 5, 6, 1)]
    for part in (None, F.floor(F.col("s") / 10)):
        assert sorted(map(tuple, conversation.merge_ranges(r, "k", "s", "e", part).collect())) == want


def test_question_rules(spark):
    ask = lambda q: value(spark, T.question_class(F.lit(q)))
    assert [ask(q) for q in ("不要记住这个", "请记住我喜欢咖啡", "这次用中文", "什么是熵", "什么是我的书", "我喜欢茶", "我在想", "hello", "Remember it")] == ["skip", "explicit", "skip", "skip", "weak", "strong", "weak", "skip", "explicit"]
    assert [r["key"] for r in value(spark, T.turn_overrides(F.lit("这次用英文分点详细回答")))] == ["preference.answer_length", "preference.answer_format", "preference.language"]
    assert value(spark, T.turn_overrides(F.lit("用英文"))) == []
    clean, cited = T.normalize_citations(F.lit("a [[E1]] b [[E9]] c [[E2"), F.array(F.lit("E1"), F.lit("E2")))
    assert value(spark, clean) == "a [[E1]] b 引用无效 c 引用无效" and value(spark, cited) == ["E1"]
    assert value(spark, T.occurrences(F.lit("abcabcab"), "ab", 5)) == [0, 3, 6]


def test_memory_validation_and_application(spark):
    good = ("preference", "preference.language", "user", "speaks French", "fr", 1, "I speak French", 0, 5, "explicit", "stable")
    names = "kind string, key string, scope string, content string, value string, source_id long, source_text string, range_start int, range_end int, statement_type string, stability string"
    swap = lambda i, v: (*good[:i], v, *good[i + 1 :])
    rows = [good, swap(0, "x"), swap(1, "fact.role"), swap(2, None), swap(3, " "), swap(4, "xx"), swap(6, None), swap(8, 99), swap(9, "?"), swap(10, "one_turn"), swap(3, "password: x")]
    got = [(r["verdict"], r["reason"]) for r in memory.validate(spark.createDataFrame(rows, names).coalesce(1)).collect()]
    assert got == [("candidate", None), *(("invalid", r) for r in ("kind", "key", "scope", "content", "enum_value", "source_id", "source_range", "statement_type")), ("skip", "one_turn"), ("skip", "sensitive")]
    m = lambda key, order, v, **o: (1, 0, key, order, o.get("status"), v, o.get("src", "user_message"), o.get("said", "explicit"), "stable", o.get("reopen", False))
    steps = [m("a", 1, "x"), m("a", 5, "y"), m("a", 3, "z"), m("b", 1, "x"), m("b", 2, "e", src="user_edit"), m("b", 3, "q"), m("c", 1, "x"), m("c", 2, None, status="completed"), m("c", 3, "y"), m("c", 4, "w", reopen=True), m("d", 1, "x", said="inferred")]
    df = spark.createDataFrame(steps, "user_id long, scope_id long, key string, order_id long, status string, value string, source_type string, statement_type string, stability string, reopen boolean")
    state = {r["key"]: (r["status"], r["value"], r["revision"], r["n_candidates"]) for r in memory.apply_candidates(df).collect()}
    assert state == {"a": ("active", "y", 3, 0), "b": ("active", "e", 2, 1), "c": ("active", "w", 3, 0), "d": ("none", None, 0, 1)}


def test_null_scopes_are_one_and_large_scopes_stay_apart(spark):
    m = lambda scope, order, v: (1, scope, "preference.language", order, None, v, "user_message", "explicit", "stable", False)
    rows = [m(None, 1, "en"), m(None, 2, "fr"), m(None, 3, "de"), m(9007199254740993, 4, "en"), m(9007199254740992, 5, "fr")]
    df = spark.createDataFrame(rows, "user_id long, scope_id long, key string, order_id long, status string, value string, source_type string, statement_type string, stability string, reopen boolean")
    got = {r["scope_id"]: (r["value"], r["revision"]) for r in memory.apply_candidates(df).collect()}
    assert got == {None: ("de", 3), 9007199254740993: ("en", 1), 9007199254740992: ("fr", 1)}


def test_a_window_estimate_is_floored_at_every_step(spark):
    log = spark.createDataFrame([(1, 20), (2, 20), (3, 5)], "conv_id long, tokens long")
    changes = spark.createDataFrame([(1, 1, -100), (1, 2, 50), (2, 1, 30), (2, 2, -10), (4, 1, -7), (4, 2, 7)], "conv_id long, seq int, delta long")
    assert dict(map(tuple, reports.window_estimate(log, changes).collect())) == {1: 50, 2: 40, 3: 5, 4: 7}


def test_recall_passes_over_what_does_not_fit(spark):
    now = dt.datetime(2026, 1, 1)
    row = lambda i, n, **o: (1, i, o.get("kind", "preference"), o.get("scope", "user"), o.get("book"), o.get("content", "x" * n), "active", "user_message", now, now - dt.timedelta(days=i), 0.5, o.get("expires"))
    rows = [row(1, 1000), row(2, 500), row(3, 100), row(4, 10, kind="interest", content="about cooking rice"), row(5, 10, kind="interest", content="football games"), row(6, 10, expires=now - dt.timedelta(days=1)), row(7, 10, kind="reading_goal", scope="book", book=9), row(8, 10, scope="book", book=8)]
    df = spark.createDataFrame(rows, "user_id long, memory_id long, kind string, scope string, book_id long, content string, status string, source_type string, updated_at timestamp, last_seen_at timestamp, salience double, expires_at timestamp")
    q = spark.createDataFrame([(1, 1, 9, "how about cooking rice")], "user_id long, question_id long, book_id long, question string")
    got = memory.recall(df, q, F.lit(now)).first()
    assert [(i["memory_id"], i["reason"]) for i in got["items"]] == [(7, "current_book"), (1, "global_preference"), (3, "global_preference"), (4, "relevant_topic")]


def test_evidence_and_status(spark):
    c = spark.createDataFrame([(1, 0, "user_selection", 1, "h", 0, 5, "a", "h"), (1, 1, "book_excerpt", 1, "h", 0, 5, "a", "h"), (1, 2, "book_excerpt", 1, "h", 0, 5, "a", "h"), (1, 3, "book_excerpt", 1, None, None, None, "t", "h")], "request_id int, ordinal int, kind string, book_id int, hash string, start int, end int, text string, book_hash string")
    assert [(r["evidence_id"], r["ordinal"], r["verified"]) for r in evidence.assign_evidence(c).orderBy("ordinal").collect()] == [("E1", 0, True), ("E2", 1, True), ("E3", 3, False)]
    s = spark.createDataFrame([(1, "done"), (1, "failed"), (2, "done"), (3, "pending"), (3, "failed"), (4, "skipped")], "request_id int, state string")
    assert {r["request_id"]: r["status"] for r in memory.request_status(s).collect()} == {1: "failed", 2: "completed", 3: "pending", 4: "skipped"}


def test_batches_equal_a_plain_fold(spark):
    r = np.random.default_rng(1)
    start = dt.datetime(2024, 1, 1, 23, 58, tzinfo=dt.UTC)
    rows = [(int(k), start + dt.timedelta(seconds=float(t)), i) for i, (k, t) in enumerate(zip(r.integers(0, 3, 200), r.uniform(0, 900, 200).round(3), strict=True))]
    got = batches.count_or_time(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long"), "user_id", "ts", "event_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("first_ts", "n"))).alias("b"))
    for row in got.collect():
        times = sorted((t - start).total_seconds() for k, t, _ in rows if k == row["user_id"])
        numbers = batches.batch_numbers(times)
        assert [x["n"] for x in row["b"]] == [numbers.count(n) for n in sorted(set(numbers))]


def test_stream_batches_and_files(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "e")], "user_id long, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, v string").parquet(str(tmp_path / "in"))
    q = batches.stream_batches(stream, "user_id", "v").writeStream.format("memory").queryName("batches").trigger(availableNow=True).start()
    q.awaitTermination(120)
    full = [r for r in spark.table("batches").collect() if r["n"] == 3]
    assert [(r["key"], sorted(set(r["items"]) & set("abcd"))) for r in full][0] == (1, sorted(full[0]["items"]))
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt/a.txt").write_bytes("中文内容".encode("gbk"))
    (tmp_path / "txt/b.txt").write_bytes(b"\xef\xbb\xbfplain")
    (tmp_path / "txt/c.bin").write_bytes(b"no")
    assert sorted(r["text"] for r in text_files.read_texts(spark, str(tmp_path / "txt")).collect()) == ["plain", "中文内容"]


def test_index_versions(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, " ")], "doc_id long, text string")
    first = store.build(docs)
    assert store.current() == first and store.read().count() == 2
    second = store.build(docs.withColumn("text", F.upper("text")))
    assert store.current() == second and store.read(first).count() == 2 and store.retired() == []
    assert sorted(r["doc_id"] for r in store.stale(docs).collect()) == [1, 2, 3]


def test_levels_and_notes(spark):
    done = dag.run_levels({"a": ([], lambda d: 1), "b": (["a"], lambda d: d["a"] + 1), "c": (["b"], lambda d: 1 // 0)})
    assert done["b"] == 2 and "error" in done["c"]
    with pytest.raises(ValueError):
        dag.run_levels({"a": (["b"], lambda d: 1), "b": (["a"], lambda d: 1)})
    notes = dag.chapter_notes(spark.createDataFrame([(1, "short"), (2, "y" * 20000)], "doc_id long, text string"), lambda s: s.str.len().astype(str))
    assert notes.count() == 2


def test_a_batch_closes_thirty_seconds_after_its_first_item():
    """A manual clock: a key that goes on slowly does not put the end off."""
    held, first, closed = [], 0, []
    for now, new in [(0, ["a"]), (20_000, ["b"]), (31_000, ["c"]), (40_000, []), (61_000, ["d"]), (62_000, ["e", "f", "g"]), (63_000, ["h", "i", "j", "k"])]:
        done, held, first = batches.add_items(held, first, new, now, 3, 30_000)
        closed += [(now, d) for d in done]
    assert closed == [(31_000, ["a", "b"]), (61_000, ["c"]), (62_000, ["d", "e", "f"]), (63_000, ["g", "h", "i"])]
    assert (held, first) == (["j", "k"], 63_000)


def test_rounds_are_dropped_as_one_by_one(spark):
    r = np.random.default_rng(6)
    rows = [(c, t, str(r.choice(["user", "assistant", "tool"], p=[0.4, 0.5, 0.1])), "x" * int(r.integers(1, 3000))) for c in range(60) for t in range(int(r.integers(1, 25)))]
    got = {x["conv_id"]: (x["dropped"], x["tokens_left"]) for x in conversation.rounds_to_drop(conversation.message_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 10_000).collect()}
    for c in range(60):
        window = [(role, -(-len(text) * 6 // 10)) for k, _, role, text in rows if k == c]
        dropped = 0
        while sum(t for _, t in window) > 10_000 * 0.7 - 2500:
            starts = [i for i, (role, _) in enumerate(window) if role == "user"]
            if len(starts) - 1 < 3 or len(window) - starts[1] < 6:
                break
            window, dropped = window[starts[1] :], dropped + 1
        assert got[c] == (dropped, sum(t for _, t in window))


def test_null_keys_stay(spark):
    calls = spark.createDataFrame([(None, i, "t") for i in range(8)] + [(1, 9, "t"), (1, 10, None)], "user_id long, event_id long, event_type string")
    got = {r["event_id"]: r["blocked"] for r in lookup.call_limits(calls, ["user_id", "event_type"], ["event_id"]).collect()}
    assert got == {i: i in (5, 6, 7) for i in (*range(8), 9, 10)}
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    events = spark.createDataFrame([(None, start + dt.timedelta(seconds=i), i) for i in range(4)], "user_id long, ts timestamp, event_id long")
    assert sorted(r["n"] for r in batches.count_or_time(events, "user_id", "ts", "event_id").collect()) == [1, 3]


def test_texts_are_cut_by_code_units(spark):
    df = spark.createDataFrame([("😀" * 4,), ("ab😀cd",), (None,), ("abcd",)], "t string")
    assert [r[0] for r in df.select(T.truncate(F.col("t"), 5, "+")).collect()] == ["😀😀+", "ab😀c+", "", "abcd"]
    assert [r[0] for r in df.select(T.truncate(F.col("t"), 3, "+")).collect()] == ["😀+", "ab+", "", "abc+"]


def test_points_meet_ranges_that_span_cells(spark):
    ranges = spark.createDataFrame([(1, 0, 20_000, "a"), (1, 20_000, 20_001, "b"), (2, 8191, 8193, "c"), (1, 5, 5, "none")], "k long, s int, e int, name string")
    points = spark.createDataFrame([(1, p) for p in (0, 8191, 8192, 19_999, 20_000, 20_001)] + [(2, 8191), (2, 8192), (2, 8193)], "k long, p int")
    got = sorted((r["k"], r["p"], r["name"]) for r in conversation.point_in_range(points, ranges, "k", "p", "s", "e").collect())
    assert got == [(1, 0, "a"), (1, 8191, "a"), (1, 8192, "a"), (1, 19_999, "a"), (1, 20_000, "b"), (2, 8191, "c"), (2, 8192, "c")]


def plain_bounds(text, lo, hi):
    """Paragraph bounds of a text without chapters, line by line."""
    start = lo
    while start > 0 and text[start - 1] != "\n":
        start -= 1
    while start > 0:
        before = text[: start - 1].rfind("\n") + 1
        if not text[before : start - 1].strip():
            break
        start = before
    end = hi
    while end < len(text):
        stop = text.find("\n", end)
        if stop < 0:
            return start, len(text)
        if not text[end:stop].strip():
            return start, end
        end = stop + 1
    return start, len(text)


def test_hits_are_widened_to_their_paragraphs(spark):
    r = np.random.default_rng(12)
    docs, hits = [], []
    for d in range(25):
        paragraphs = ["\n".join("w" * int(r.integers(1, 60)) for _ in range(int(r.integers(1, 6)))) for _ in range(int(r.integers(1, 7)))]
        text = str(r.choice(["\n\n", "\n \t\n", "\n\n\n"])).join(paragraphs)
        docs.append((d, text))
        for k in range(4):
            lo = int(r.integers(0, len(text)))
            hits.append((d % 3, d, f"c{k}", lo, min(len(text), lo + int(r.integers(1, 30)))))
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(hits, "request_id long, doc_id long, chunk_id string, start int, end int")
    for cap in (10_000, 40):
        want = set()
        for d, text in docs:
            ranges = []
            for q, _, _, lo, hi in (h for h in hits if h[1] == d):
                s, e = plain_bounds(text, lo, hi)
                if e - s > cap:
                    s = max(0, (lo + hi) // 2 - cap // 2)
                    e = min(len(text), s + cap)
                    s = max(0, e - cap)
                ranges.append((s, e, q))
            merged = []
            for s, e, q in sorted(ranges):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e, q])
            want |= {(q, d, s, e, text[s:e]) for s, e, q in merged}
        got = {(x["request_id"], x["doc_id"], x["start"], x["end"], x["text"]) for x in evidence.expand_hits(df, asked, cap).collect()}
        assert got == want
    wide = spark.createDataFrame([(1, "第一章 a\n\n😀😀x😀\n第二章 b\ntail")], "doc_id long, text string")
    one = evidence.expand_hits(wide, spark.createDataFrame([(7, 1, "c", 9, 11)], "request_id long, doc_id long, chunk_id string, start int, end int")).collect()
    assert [(x["text"], x["chunk_ids"]) for x in one] == [("😀😀x😀\n", ["c"])]


def test_bm25_in_rows_is_bm25_by_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(900_001, None), (900_002, "")], "doc_id long, text string"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").unionByName(spark.createDataFrame([(-1, ""), (-2, "qqqqq"), (-3, None)], "query_id long, text string"))
    rows = lambda: [(r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in retrieval.bm25(docs, items, 9).orderBy("query_id", "rank").collect()]
    within = rows()
    monkeypatch.setattr(retrieval, "VOCABULARY", 10)
    assert rows() == within and len(within) > 50
    monkeypatch.undo()
    assert retrieval.bm25(docs, items.limit(0)).count() == 0 and retrieval.bm25(docs.limit(0), items).count() == 0
    named = retrieval.bm25(docs, items.select(F.concat(F.lit("q"), "query_id").alias("query_id"), "text"), 2)
    assert {r["query_id"] for r in named.collect()} == {f"q{q}" for q, *_ in within}

"""Tools: declarations that are refused, calls from SQL, calls that are rows."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.operators import lookup
from lexmill.plans.tools import Tool, Tools

TEXTS = {
    1: "Chapter 1\nAnna met Ben.\r\nAnna left.\nChapter 2\nBen \U0001f600 saw Anna " + "x" * 2000,
    2: "no heads, only Anna",
    3: None,
    4: "第一章 开始\n" + "安娜" * 40 + "\n第二章 开始\n结束",
}
STRING = {"type": "object", "properties": {"q": {"type": "string"}}, "required": ["q"]}


def plain_problem(tool, arguments):
    """What the declarations ask for, value by value."""
    try:
        args = json.loads(arguments) if arguments is not None else None
    except ValueError:
        args = None
    if not isinstance(args, dict):
        return "not an object"
    for key in tool.required:
        if args.get(key) in (None, ""):
            return f"missing {key}"
    for key, value in args.items():
        kind = tool.properties.get(key, {}).get("type")
        if kind == "string" and not isinstance(value, str):
            return f"not string {key}"
        if kind == "integer" and (isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value)):
            return f"not integer {key}"
    return None


@pytest.mark.parametrize(
    "make",
    [
        lambda: Tool("", "d", STRING, "a int", print),
        lambda: Tool("a b", "d", STRING, "a int", print),
        lambda: Tool("a", None, STRING, "a int", print),
        lambda: Tool("a", "d", "schema", "a int", print),
        lambda: Tool("a", "d", STRING, "a int", None),
        lambda: Tool("a", "d", {"properties": {"q": {"type": "object"}}}, "a int", print),
        lambda: Tool("a", "d", {"properties": {"text": {"type": "string"}}}, "a int", print),
        lambda: Tool("a", "d", {"properties": {}, "required": ["q"]}, "a int", print),
        lambda: Tools([Tool("same", "d", STRING, "a int", print), Tool("SAME", "d", STRING, "a int", print)]),
        lambda: Tools(["no tool"]),
    ],
)
def test_what_is_ill_formed_fails_at_load(make):
    with pytest.raises(ValueError):
        make()


def test_a_dropped_file_is_a_tool(spark, tmp_path):
    (tmp_path / "_helper.py").write_text("raise RuntimeError")
    (tmp_path / "count.py").write_text("from lexmill.plans.tools import Tool\nTOOL = Tool('countOf', 'how often', {'properties': {'q': {'type': 'string'}}, 'required': ['q']}, 'n int', lambda text, q: [(text.count(q),)])\n")
    tools = Tools.load(tmp_path)
    assert [s["function"]["name"] for s in tools.schemas()] == ["countOf"]
    tools.register(spark)
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    got = spark.sql("SELECT doc_id, n FROM {docs} d, LATERAL countOf(text => d.text, q => 'Anna')", docs=docs)
    assert {r["doc_id"]: r["n"] for r in got.collect()} == {1: 3, 2: 1, 3: 0, 4: 0}
    (tmp_path / "second.py").write_text("x = 1\n")
    with pytest.raises(ValueError):
        Tools.load(tmp_path)


def test_three_tools_from_sql(spark):
    Tools.load().register(spark)
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    got = spark.sql("SELECT d.doc_id, m.* FROM {docs} d, LATERAL lookupCharacter(name => 'Anna', text => d.text) m", docs=docs)
    asks = docs.select(F.col("doc_id").alias("ask_id"), "doc_id", F.lit("Anna").alias("name"))
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r)[1:] for r in lookup.mentions(docs, asks).collect())
    found = spark.sql("SELECT d.doc_id, m.rank, m.start, m.snippet FROM {docs} d, LATERAL findInText(text => d.text, query => ' Anna ') m", docs=docs)
    wide = lookup.mentions(docs, asks, 200, 600, 3, chapter_of_start=True).select("doc_id", "rank", "start", "text")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wide.collect()))
    asks = spark.createDataFrame([(i, d, c, n, t) for i, (d, c, n, t) in enumerate([(1, None, 2, None), (1, None, None, "2"), (4, None, None, "开始"), (1, "ch-1-0", None, None), (2, None, 9, None), (3, None, 1, None), (1, None, None, "met"), (4, None, None, "结束")])], "ask_id long, doc_id long, chapter_id string, chapter_index int, title string")
    plain = {r["ask_id"]: r for r in lookup.find_chapters(docs, asks).collect()}
    rows = spark.sql("SELECT a.ask_id, c.* FROM {asks} a JOIN {docs} d ON a.doc_id = d.doc_id, LATERAL getChapterInfo(text => d.text, chapterId => a.chapter_id, chapterIndex => a.chapter_index, chapterTitle => a.title) c", asks=asks, docs=docs).collect()
    for ask_id, p in plain.items():
        mine = [r for r in rows if r["ask_id"] == ask_id]
        if p["status"] == "ok":
            assert [tuple(r[k] for k in ("status", "chapter_id", "ordinal", "title", "start", "end", "length", "truncated", "preview")) for r in mine] == [tuple(p[k] for k in ("status", "chapter_id", "ordinal", "title", "start", "end", "length", "truncated", "text"))]
        else:
            assert [(r["ordinal"], r["chapter_id"], r["title"]) for r in mine] == [tuple(m) for m in p["matches"] or []]


@pytest.mark.parametrize("call", ["text => 'a'", "text => 'a', name => NULL", "text => 'a', name => 3", "text => 'a', name => 'b', other => 1", "name => 'b', text => 5"])
def test_arguments_are_checked_before_the_query_runs(spark, call):
    Tools.load().register(spark)
    with pytest.raises(Exception, match="lookupCharacter|analyze"):
        spark.sql(f"SELECT * FROM lookupCharacter({call})")


def test_calls_that_are_rows(spark):
    def fails(text, q):
        raise RuntimeError("broken")

    tools = Tools([*Tools.load().tools.values(), Tool("broken", "d", STRING, "a int", fails), Tool("none", "d", {}, "a int", lambda text: [(len(text),)])])
    arguments = [None, "", "{", "[1]", "3", "null", "{}", '{"name": null}', '{"name": ""}', '{"name": 5}', '{"name": "Anna"}', '{"name": "Anna", "other": [1]}', '{"query": "Anna", "name": 3}', '{"query": "A"}', '{"q": "x"}', '{"q": true}', '{"chapterIndex": 1}', '{"chapterIndex": 2.0}', '{"chapterIndex": 1.5}', '{"chapterIndex": "1"}', '{"chapterIndex": true, "chapterTitle": 1}', '{"chapterTitle": 1, "chapterIndex": true}', '{"chapterTitle": null}', '{"chapterIndex": 1e0}', '{"name": "nobody"}']
    calls = [(i, d, n, a) for i, (d, n, a) in enumerate((d, n, a) for d in (1, 3, 99, None) for n in (*tools.tools, "unknown", None) for a in arguments)]
    df = spark.createDataFrame(calls, "call_id long, doc_id long, name string, arguments string")
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    got = {r["call_id"]: r for r in tools.run(df, docs).collect()}
    assert len(got) == len(calls)
    for call_id, doc_id, name, text_args in calls:
        r, tool = got[call_id], tools.tools.get(name)
        if tool is None:
            assert (r["status"], r["code"], r["problem"], r["n"]) == ("error", "UNKNOWN_TOOL", None, None)
            continue
        problem = plain_problem(tool, text_args)
        if problem:
            assert (r["status"], r["code"], r["problem"]) == ("error", "INVALID_TOOL_ARGS", problem), (name, text_args)
        elif name == "broken":
            assert (r["status"], r["code"], r["problem"]) == ("error", "TOOL_EXECUTION_FAILED", "broken")
        else:
            text = (TEXTS.get(doc_id) or "").replace("\r\n", "\n")
            given = {k: int(v) if tool.properties[k]["type"] == "integer" else v for k, v in json.loads(text_args).items() if k in tool.properties}
            rows = list(tool.rows(text, **given))
            assert (r["status"], r["n"], [tuple(json.loads(x).values()) for x in r["results"]]) == ("ok" if rows else "empty", len(rows), rows)
    assert tools.run(df.limit(0), docs).count() == 0

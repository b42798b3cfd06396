"""Names by one automaton against str.find, chapters, snippets at the edges of pairs, pairs of names."""

from collections import Counter

from pyspark.sql import functions as F

from lexmill.operators import characters

TEXT = "第一章 起\nanna and annanna met bob 😀\n第二章 承\nbob saw 😀anna. bobbob\n"
ROWS = [(1, TEXT), (2, None), (3, ""), (4, "nobody here"), (5, "x" * 99 + "😀anna" + "y" * 594 + "😀z"), (5, "anna bob")]
NAMES = [(1, "anna"), (2, "bob"), (3, "nan"), (4, " "), (5, None), (6, "bob"), (7, "zoe")]


def test_mentions_are_those_of_find(spark, monkeypatch):
    docs, names = spark.createDataFrame(ROWS, "doc_id long, text string"), spark.createDataFrame(NAMES, "name_id long, name string")
    units = lambda t: len(t.encode("utf-16-le")) // 2
    want = Counter()
    for doc, text in ROWS:
        for name_id, name in NAMES:
            if text and name and name.strip() and name in text:
                want[doc, 1, name_id, text.count(name), units(text[: text.index(name)])] += 1
    got = Counter(tuple(r) for r in characters.name_mentions(docs, names, by_chapter=False).collect())
    assert got == want and want[1, 1, 1, 3, 6] == 1
    monkeypatch.setattr(characters, "NAMES", 2)
    assert Counter(tuple(r) for r in characters.name_mentions(docs, names, by_chapter=False).collect()) == want
    by = {(r["chapter"], r["name_id"]): (r["n"], r["first"]) for r in characters.name_mentions(docs.filter("doc_id = 1"), names).collect()}
    second = TEXT.index("第二章")
    assert by[1, 1] == (2, 6)
    assert by[2, 2] == (3, units(TEXT[:second]) + 6) and by[2, 1][0] == 1
    assert characters.name_mentions(docs, names.limit(0)).count() == 0 and characters.name_mentions(docs.limit(0), names).count() == 0


def test_snippets_do_not_split_pairs(spark):
    docs, text = spark.createDataFrame([ROWS[4]], "doc_id long, text string"), ROWS[4][1]
    found = characters.name_mentions(docs, spark.createDataFrame(NAMES[:1], "name_id long, name string"))
    whole, inner = characters.first_snippets(found, docs).first(), characters.first_snippets(found, docs, before=1, after=599).first()
    # anna begins at unit 101, the signs beside it take the units 99 and 100, 699 and 700.
    assert (whole["n"], whole["first"], whole["snippet"]) == (1, 101, text[1:-1])
    assert inner["snippet"] == "anna" + "y" * 594


def test_pairs_count_chapters(spark):
    rows = [(1, 1, n) for n in (1, 2, 3)] + [(1, 2, 2), (1, 2, 1), (2, 1, 1), (2, 1, 3)]
    df = spark.createDataFrame(rows, "doc_id long, chapter int, name_id long").select("*", F.lit(1).alias("n"))
    assert {tuple(r) for r in characters.co_mentions(df.repartition(3)).collect()} == {(1, 2, 2), (1, 3, 2), (2, 3, 1)}
    assert characters.co_mentions(df.limit(0)).count() == 0

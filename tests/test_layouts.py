"""Migrations: once each, whole or not at all, one of two racing migrators, rollback, clearing."""

import threading

import pytest
from pyspark.sql import functions as F

from lexmill.plans import commits
from lexmill.plans.layouts import Append, Layout, MigrationFailed, Step, missing_rows


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def first(spark, n=5):
    return Step("first", lambda read: {"t": spark.range(n), "u": spark.range(2)})


def second(spark):
    return Step("second", lambda read: {"t": Append(spark.range(10, 12)), "u": None, "v": read("t").filter("id > 2")})


def test_twice_is_once_and_order(spark, tmp_path):
    layout = Layout(spark, f"file://{tmp_path}")
    assert layout.tables() == {} and layout.applied() == []
    assert layout.migrate([first(spark)]) == ["first"]
    assert layout.migrate([first(spark), second(spark)]) == ["second"]
    assert layout.migrate([first(spark), second(spark)]) == []
    assert ids(layout.read("t")) == [0, 1, 2, 3, 4, 10, 11] and ids(layout.read("v")) == [3, 4] and set(layout.tables()) == {"t", "v"}
    with pytest.raises(ValueError, match="one name"):
        layout.migrate([first(spark), first(spark)])


def test_failure_leaves_what_was_there(spark, tmp_path):
    layout = Layout(spark, f"file://{tmp_path}")

    def refuse(read):
        assert ids(read("t")) == [7], "other rows"

    broken = Step("broken", lambda read: {"v": read("t"), "t": read("t").select(F.raise_error(F.lit("no")).alias("id"))})
    refused = Step("refused", lambda read: {"t": spark.range(3)}, refuse)
    shaped = Step("shaped", lambda read: {"t": Append(spark.range(3).withColumn("x", F.lit(1)))})
    for bad in (broken, refused, shaped):
        with pytest.raises(MigrationFailed, match=bad.name):
            layout.migrate([first(spark), bad, second(spark)])
        assert layout.applied() == ["first"] and ids(layout.read("t")) == [0, 1, 2, 3, 4]
    assert len(commits.names(spark, f"file://{tmp_path}/data")) == 2 and not commits.names(spark, f"file://{tmp_path}/building")
    assert layout.migrate([first(spark), second(spark)]) == ["second"]


def test_rollback_and_clear(spark, tmp_path):
    layout = Layout(spark, f"file://{tmp_path}")
    layout.migrate([first(spark), second(spark), Step("third", lambda read: {"t": spark.range(1)})])
    assert layout.clear() == []
    assert layout.roll_back("first") == ["third", "second"] and layout.roll_back("first") == []
    assert ids(layout.read("t")) == [0, 1, 2, 3, 4] and ids(layout.read("u")) == [0, 1]
    assert len(layout.clear()) == 3  # what was appended, v, and the third step's t
    with pytest.raises(ValueError, match="does not hold"):
        layout.roll_back("second")
    assert layout.migrate([first(spark), second(spark)]) == ["second"]
    assert ids(layout.read("t")) == [0, 1, 2, 3, 4, 10, 11]
    assert layout.roll_back(None) == ["second", "first"] and layout.tables() == {}
    # A crashed migrator's folder is kept while its mark lasts.
    spark.range(1).write.parquet(f"file://{tmp_path}/data/t-crashed")
    commits.create_new(spark, f"file://{tmp_path}/building/t-crashed", {"until": 1000.0})
    assert "t-crashed" not in layout.clear(now=999.0) and "t-crashed" in layout.clear(now=1001.0) + layout.clear(now=1001.0)


def test_racing_migrators(spark, tmp_path):
    layout, gate, done = Layout(spark, f"file://{tmp_path}"), threading.Barrier(2, timeout=60), []

    def up(read):
        if len(done) == 0 and not gate.broken:
            try:
                gate.wait(30)  # both have read the same ledger
            except threading.BrokenBarrierError:
                pass
        return {"t": spark.range(4)}

    def run():
        done.append(layout.migrate([Step("only", up)]))

    threads = [threading.Thread(target=run) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(done) == [[], ["only"]] and [e["step"] for e in layout.history()] == ["only"] and ids(layout.read("t")) == [0, 1, 2, 3]
    assert len(commits.names(spark, f"file://{tmp_path}/data")) == 1


def test_backup_takes_what_it_lacks(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (None, None)], "id long, k string")
    have = spark.createDataFrame([(None, "b"), (2, "x"), (None, None)], "id long, k string")
    assert sorted(map(str, missing_rows(rows, have, ["id", "k"]).collect())) == sorted(["Row(id=1, k='a')", "Row(id=2, k=None)"])

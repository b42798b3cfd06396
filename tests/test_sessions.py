"""Sessions and interval joins: the stream gives the table's rows, late rows are counted, edges are defined."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.streaming import sessions as S

START = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, event_type string, ts timestamp"


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_sessions_at_the_gap(spark):
    rows = [(1, 1, "a", at(0)), (2, 1, "a", at(30)), (3, 1, "a", at(60.5)), (4, None, "a", at(5)), (5, None, "a", at(6)), (6, 2, "a", None), (7, 2, "a", at(1)), (8, 2, "a", at(1))]
    got = S.sessions(spark.createDataFrame(rows, EVENTS), "user_id").collect()
    assert sorted((r.user_id or 0, r.n) for r in got) == [(0, 2), (1, 1), (1, 2), (2, 2)]
    assert S.sessions(spark.createDataFrame([], EVENTS), "user_id").count() == 0


def test_join_against_all_pairs(spark):
    rows = [(i, [1, 1, 2, None][i % 4], "click" if i % 3 else "purchase", None if i == 17 else at((i * 37) % 300)) for i in range(90)]
    events = spark.createDataFrame(rows, EVENTS)
    left, right = (events.filter(F.col("event_type") == k).select("user_id", "ts", F.col("event_id").alias(n)) for k, n in (("click", "a"), ("purchase", "b")))
    got = S.followed_by(left, right, "user_id", "ts", 1800, how="left_outer").select("a", "b")
    pairs = [(x[0], y[0]) for x in rows for y in rows if x[2] == "click" and y[2] == "purchase" and x[1] is not None and x[1] == y[1] and x[3] and y[3] and dt.timedelta(0) <= y[3] - x[3] <= dt.timedelta(minutes=30)]
    alone = [(x[0], None) for x in rows if x[2] == "click" and x[0] not in {a for a, _ in pairs}]
    assert rows_of(got) == sorted(map(str, pairs + alone)) and pairs and alone


@pytest.fixture
def late_rows(spark):
    listener = S.LateRows()
    spark.streams.addListener(listener)
    yield listener
    spark.streams.removeListener(listener)


def run(spark, tmp_path, name, parts, plan):
    """The rows of a plan over a stream whose micro-batches are ``parts``, and its query."""
    source = f"file://{tmp_path}/{name}"
    out = f"{source}-out"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{source}/{i}")
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(source)
        query = plan(stream).writeStream.queryName(name).format("parquet").option("checkpointLocation", f"{source}-ck").trigger(availableNow=True).start(out)
        assert query.awaitTermination(180)
    return spark.read.parquet(out), query


def test_stream_of_sessions(spark, tmp_path, late_rows):
    rows = [(i, i % 3, "a", at(i * 7 + (i % 5) * 20 * (i % 3))) for i in range(60)]
    rows.sort(key=lambda r: r[3])
    late = [(900, 1, "a", at(3)), (901, 2, "a", at(4))]
    closing = [(999, 77, "end", at(5000))]
    parts = [rows[:25], rows[25:] + [], late, closing]
    got, query = run(spark, tmp_path, "sessions", parts, lambda s: S.sessions(s, "user_id"))
    want = S.sessions(spark.createDataFrame(rows, EVENTS), "user_id")
    assert rows_of(got) == rows_of(want)
    assert late_rows.total(query) == 2


def test_stream_join(spark, tmp_path):
    rows = [(i, i % 4, "click" if i % 3 else "purchase", at(i * 2 + (i * 13) % 9)) for i in range(120)]
    rows.sort(key=lambda r: r[3])

    def plan(events):
        left, right = (events.filter(F.col("event_type") == k).select("user_id", "ts", F.col("event_id").alias(n)) for k, n in (("click", "a"), ("purchase", "b")))
        return S.followed_by(left, right, "user_id", "ts", 900, how="left_outer").select("user_id", "a", "b", "ts", "then_ts")

    closing = [[(900, 77, "click", at(5000)), (901, 77, "purchase", at(5000))], [(902, 77, "click", at(9000)), (903, 77, "purchase", at(9000))]]
    got, _ = run(spark, tmp_path, "pairs", [rows[:40], rows[40:], *closing], plan)
    want = plan(spark.createDataFrame(rows, EVENTS))
    assert rows_of(got.filter("user_id < 77")) == rows_of(want)
    assert want.filter("b IS NULL").count() and want.filter("b IS NOT NULL").count()

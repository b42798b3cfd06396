"""Sessions and interval joins by event time: one expression for tables and streams, and a count of the rows that came too late."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end (``gap`` after the last row) and n of the sessions of every key.

    Rows at most ``gap`` apart are one session.  On a stream a session is given out once the watermark has passed its end; rows
    more than ``late`` behind are left out.  Rows without a time have no session; those without a key form sessions together.
    """
    stamped = events.select(F.col(key).alias("key"), F.col(ts).alias("ts")).filter("ts IS NOT NULL").withWatermark("ts", late)
    done = stamped.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("n"))
    return done.select(F.col("key").alias(key), F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def followed_by(first: DataFrame, second: DataFrame, key: str, ts: str, seconds: int, late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Pairs of a row of ``first`` and one of ``second`` of the same key, 0 to ``seconds`` later; with ``left_outer`` first rows without one, too.

    Other columns of the sides must differ; the second's time is returned as ``then_ts``.  The join is on the key and a time
    bucket of ``seconds``: a second row goes to its own bucket and the one before, so that a frequent key is spread over
    its buckets and a task holds two buckets of it.  The time bound lets a stream forget rows that the watermark has passed.
    Rows without key or time have no partner.
    """
    slot = lambda c: F.floor(F.unix_micros(F.col(c)) / (seconds * 1_000_000))
    left = first.withWatermark(ts, late).withColumn("_slot", slot(ts))
    named = second.withColumnsRenamed({ts: "then_ts", key: "_then_key"}).withWatermark("then_ts", late)
    right = named.withColumn("_then_slot", F.explode(F.array(slot("then_ts"), slot("then_ts") - 1)))
    near = (F.col("then_ts") >= F.col(ts)) & (F.col("then_ts") <= F.col(ts) + F.expr(f"INTERVAL {seconds} SECONDS"))
    same = (F.col(key) == F.col("_then_key")) & (F.col("_slot") == F.col("_then_slot"))
    return left.join(right, same & near, how).drop("_slot", "_then_key", "_then_slot")


class LateRows(StreamingQueryListener):
    """Counts, by the name or else the id of a query, the rows that its operators left out as too late.

    Add it with ``spark.streams.addListener``; progress arrives a moment after a batch, so ask once the query has ended.
    """

    def __init__(self) -> None:
        super().__init__()
        self._lock, self._late, self._ended = threading.Lock(), Counter(), {}

    def onQueryStarted(self, event) -> None:  # noqa: N802  names that Spark calls
        with self._lock:
            self._ended[str(event.runId)] = threading.Event()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            self._late[p.name or str(p.id)] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            ended = self._ended.get(str(event.runId))
        if ended is not None:
            ended.set()

    def total(self, query, wait: float = 30.0) -> int:
        """The late rows of a query; waits up to ``wait`` seconds until the end of a stopped one has been told."""
        with self._lock:
            ended = self._ended.get(str(query.runId))
        if ended is not None and not query.isActive:
            ended.wait(wait)
        with self._lock:
            return self._late[query.name or str(query.id)]

"""Streams: count-or-time batches, late and repeated rows, event-time windows.  The batch forms run on the same functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COUNT, SECONDS = 3, 30


def batch_numbers(times: list[float], count: int = COUNT, seconds: float = SECONDS) -> list[int]:
    """The batch of each of some ascending times: a batch closes when full, or ``seconds`` after its first."""
    out, first, n, number = [], 0.0, 0, -1
    for t in times:
        if not n or n == count or t - first >= seconds:
            first, n, number = t, 0, number + 1
        n += 1
        out.append(number)
    return out


def count_or_time(events: DataFrame, key: str, ts: str, order: str, count: int = COUNT, seconds: int = SECONDS) -> DataFrame:
    """key, first_ts, last_ts and n of the batches of every key.

    A pause of ``seconds`` always ends a batch, so keys are first cut into runs at their pauses.  Pauses
    are found within days, a day's first event looks at the last of the day before, and runs are
    numbered by prefix sums over days: no window holds a whole key, however frequent.
    """
    base = events.select(F.col(key).alias("key"), F.to_date(ts).alias("day"), F.unix_micros(ts).alias("us"), F.col(order).alias("o"))
    near, days = Window.partitionBy("key", "day").orderBy("us", "o"), Window.partitionBy("key").orderBy("day")
    last = base.groupBy("key", "day").agg(F.max("us").alias("last")).withColumn("prior", F.lag("last").over(days)).drop("last")
    same = lambda side: base["key"].eqNullSafe(side["_key"]) & base["day"].eqNullSafe(side["_day"])  # noqa: E731  rows without a key form one
    last = last.select(F.col("key").alias("_key"), F.col("day").alias("_day"), "prior")
    marked = base.join(last, same(last)).drop("_key", "_day").withColumn("pause", F.coalesce(F.col("us") - F.coalesce(F.lag("us").over(near), "prior") >= seconds * 1_000_000, F.lit(True)).cast("int"))
    before = marked.groupBy("key", "day").agg(F.sum("pause").alias("pauses")).withColumn("before", F.coalesce(F.sum("pauses").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("pauses")
    run = F.col("before") + F.sum("pause").over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = before.select(F.col("key").alias("_key"), F.col("day").alias("_day"), "before")
    rows = marked.join(before, marked["key"].eqNullSafe(before["_key"]) & marked["day"].eqNullSafe(before["_day"])).select("key", run.alias("run"), "us", "o")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, first, last, n = None, 0, 0, 0
        for batch in batches:
            out = []
            keys = batch["key"].astype(object).where(batch["key"].notna(), None)  # a missing key equals itself
            for key_, run_, us in zip(keys, batch["run"], batch["us"], strict=True):
                if n and ((key_, run_) != group or n == count or us - first >= seconds * 1_000_000):
                    out.append((group[0], first, last, n))
                    n = 0
                if not n:
                    group, first = (key_, run_), us
                last, n = us, n + 1
            yield pd.DataFrame(out, columns=["key", "first_us", "last_us", "n"])
        if n:
            yield pd.DataFrame([(group[0], first, last, n)], columns=["key", "first_us", "last_us", "n"])

    kind = events.schema[key].dataType.simpleString()
    done = rows.repartition("key", "run").sortWithinPartitions("key", "run", "us", "o").mapInPandas(fold, f"key {kind}, first_us long, last_us long, n long")
    return done.select(F.col("key").alias(key), F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "n")


def add_items(held: list, first: int, new: list, now: int, count: int, wait: int) -> tuple[list[list], list, int]:
    """The batches that are closed when ``new`` items come at ``now`` (ms), the items that stay open, and the time of the first of them."""
    closed: list[list] = []
    if held and now - first >= wait:
        closed.append(held)
        held = []
    for item in new:
        if not held:
            first = now
        held = [*held, item]
        if len(held) == count:
            closed.append(held)
            held = []
    return closed, held, first


def stream_batches(events: DataFrame, key: str, item: str, count: int = COUNT, seconds: int = SECONDS) -> DataFrame:
    """key, n and items (column ``item``, as text) of the batches of a stream: full, or ``seconds`` after their first item.

    Keyed state holds the items of the open batch and the processing time of the first; the timer is set to what is
    left of its time, so a key that goes on slowly does not put it off.
    """
    wait = seconds * 1000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            closed, held = [held], []
        else:
            new = [str(x) for frame in frames for x in frame[item]]
            closed, held, first = add_items(held, first, new, now, count, wait)
        if held:
            state.update((held, first))
            state.setTimeoutDuration(max(1, first + wait - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [k[0]] * len(closed), "n": [len(c) for c in closed], "items": closed})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"key {kind}, n long, items array<string>", "items array<string>, first long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, window_start, n and total of tumbling windows; on a stream rows later than ``late`` are left out."""
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def first_by_key(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One row of each key; on a stream its state lasts as long as the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def guard_late(events: DataFrame, key: str, order: str, days: float = 30) -> DataFrame:
    """Rows of a stream (all columns) above the highest ``order`` that earlier micro-batches had for their key.

    The rows of one micro-batch are judged by what came before it, so the state of a key is one
    number; it goes when nothing has come for ``days``.
    """
    kinds = events.schema

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.get[0] if state.exists else None
        high = mark
        for frame in frames:
            fresh = frame if mark is None else frame[frame[order] > mark]
            if len(fresh):
                top = int(fresh[order].max())
                high = top if high is None else max(high, top)
                yield fresh
        if high is not None:
            state.update((high,))
            state.setTimeoutDuration(int(days * 86_400_000))

    return events.groupBy(key).applyInPandasWithState(step, kinds, "mark long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drop_late(events: DataFrame, key: str, order: str, marks: DataFrame) -> DataFrame:
    """Rows above their key's mark (key, mark); keys without a mark keep all."""
    return events.join(marks, key, "left").filter(F.col("mark").isNull() | (F.col(order) > F.col("mark"))).drop("mark")

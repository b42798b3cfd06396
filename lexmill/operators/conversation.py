"""Conversation logs: rounds, token sums and window cuts, as window expressions over (conversation, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

LIMIT = 262_144
RANGE_CELL = 8192
KEEP_MESSAGES, KEEP_ROUNDS, KEEP_SHARE = 6, 3, 0.15


def message_log(turns: DataFrame) -> DataFrame:
    """conv_id, seq (from 0, no gaps), role, text, tokens (estimate) and round (0 before the first user message)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seq = (F.row_number().over(order) - 1).cast("int")
    rounds = F.sum((F.col("role") == "user").cast("int")).over(up_to).cast("int")
    return turns.select("conv_id", seq.alias("seq"), "role", "text", estimate_tokens(F.col("text")).alias("tokens"), F.coalesce(rounds, F.lit(0)).alias("round"))


def suffix_tokens(log: DataFrame) -> DataFrame:
    """``log`` with suffix_tokens: the tokens of a message and all later ones of its conversation."""
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("suffix_tokens", F.sum("tokens").over(later))


def compression_cut(log: DataFrame, limit: int = LIMIT, share: float = KEEP_SHARE) -> DataFrame:
    """conv_id, n_messages, n_rounds and cut: how many of the oldest messages to summarise, or -1.

    The cut keeps ``share`` of ``limit`` tokens, six messages and three rounds, and falls on the start of a round.
    """
    budget = int(limit * share)
    m = suffix_tokens(log)
    rounds = Window.partitionBy("conv_id")
    m = m.withColumn("n", F.count("*").over(rounds)).withColumn("n_rounds", F.max("round").over(rounds))
    bounds = m.groupBy("conv_id").agg(
        F.first("n").alias("n_messages"),
        F.first("n_rounds").alias("n_rounds"),
        F.coalesce(F.max(F.when(F.col("suffix_tokens") > budget, F.col("seq") + 1)), F.lit(0)).alias("budget_cut"),
        F.min(F.when((F.col("role") == "user") & (F.col("round") == F.col("n_rounds") - KEEP_ROUNDS + 1), F.col("seq"))).alias("third_last"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.col("seq")))).alias("starts"),
    )
    most = F.least("budget_cut", F.col("n_messages") - KEEP_MESSAGES, "third_last")
    cut = F.coalesce(F.array_max(F.filter("starts", lambda s: s <= F.col("most"))), F.element_at("starts", 1))
    enough = (F.col("n_rounds") > KEEP_ROUNDS) & (F.col("n_messages") > KEEP_MESSAGES)
    cut = F.when(enough, F.when(cut > F.element_at("starts", 1), cut).otherwise(-1)).otherwise(-1)
    return bounds.withColumn("most", most).select("conv_id", F.col("n_messages").cast("long").alias("n_messages"), F.col("n_rounds").cast("int").alias("n_rounds"), cut.cast("int").alias("cut"))


def rounds_to_drop(log: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, dropped (oldest rounds to leave out) and tokens_left, until the rest is at most 0.7 * limit - 2500.

    What stays has three rounds and six messages at least.  What comes before the first round goes with it.
    """
    room = limit * 0.7 - 2500
    by_round = log.groupBy("conv_id", "round").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    conv = Window.partitionBy("conv_id")
    later = conv.orderBy(F.desc("round")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = by_round.select("conv_id", "round", F.sum("t").over(later).alias("left"), F.sum("n").over(later).alias("messages"), F.sum("t").over(conv).alias("all"), F.max("round").over(conv).alias("rounds"))
    drop = F.greatest(F.col("round") - 1, F.lit(0))
    rows = rows.select("conv_id", drop.alias("dropped"), F.when(drop == 0, F.col("all")).otherwise(F.col("left")).alias("left"), ((drop == 0) | ((F.col("rounds") - drop >= KEEP_ROUNDS) & (F.col("messages") >= KEEP_MESSAGES))).alias("allowed"))
    ends = rows.filter("allowed").groupBy("conv_id").agg(F.min(F.when(F.col("left") <= room, F.struct("dropped", "left"))).alias("fits"), F.max(F.struct("dropped", "left")).alias("last"))
    best = F.coalesce("fits", "last")
    return ends.select("conv_id", best["dropped"].cast("int").alias("dropped"), best["left"].cast("long").alias("tokens_left"))


def summary_caps(log: DataFrame, each: int = 6000, total: int = 96_000, least: int = 500) -> DataFrame:
    """``log`` with cap: characters of a message that a summary reads, scaled down where the conversation exceeds ``total``."""
    own = F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(each))
    every = F.sum(own).over(Window.partitionBy("conv_id"))
    return log.withColumn("cap", F.greatest(F.lit(least), F.floor(own * F.least(F.lit(1.0), total / every))).cast("int"))


def summary_target(tokens: Column) -> Column:
    return F.when(tokens <= 20_000, 400).when(tokens <= 60_000, 800).otherwise(1200)


def merge_ranges(rows: DataFrame, key: str, start: str, end: str, part: Column | None = None) -> DataFrame:
    """key, start, end and n of the unions of ranges that overlap or touch.

    ``part`` (such as a day of ``start``) merges within parts first, so the window over a whole key
    sees islands only, not rows.
    """

    def islands(df: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("s", "e")
        reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(reached.isNull() | (F.col("s") > reached), 1).otherwise(0)
        marked = df.withColumn("new", new)
        marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return marked.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"))

    base = rows.select(F.col(key), F.col(start).alias("s"), F.col(end).alias("e"), F.lit(1).cast("long").alias("n"), (F.lit(0) if part is None else part).alias("part"))
    if part is not None:
        base = islands(base, [key, "part"]).drop("island", "part")
    return islands(base, [key]).select(key, F.col("s").alias(start), F.col("e").alias(end), "n")


def point_in_range(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points with the half-open range of their key that holds them; points in no range go.

    Where ranges overlap, each range counts.  Ranges and points are cut into cells of RANGE_CELL and meet on key and
    cell, so a point meets the ranges near it and not all of its key.
    """
    cell = lambda c: F.floor(c / RANGE_CELL)
    near = ranges.filter(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end) - 1))))
    both = points.withColumn("_cell", cell(F.col(at))).join(near, [key, "_cell"])
    return both.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` at or before it, by key; one sort of both, no join.

    A key's rows stand in one window, which streams over them and keeps one value; a null key is a key like others.
    """
    both = left.select(key, order, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    both = both.unionByName(right.select(key, order, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value")))
    w = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_value", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1").select("_row.*", F.col("_value").alias(value))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of every key; ``new`` wins ties.  Aggregated in partial maxima, no window."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct(order, "_new", *[c for c in rest if c != order])).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest)).select(*old.columns)


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))

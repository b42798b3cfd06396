"""Reports on runs: token use, rates with their denominators, grouped reasons, references, caches and grids of conditions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(calls: DataFrame, key: str) -> DataFrame:
    """key, n_calls, prompt, completion and total tokens, and kind: actual if any call gave its use, else unavailable (and no sums)."""
    total = F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    given = F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull() | F.col("total_tokens").isNotNull()
    sums = calls.groupBy(key).agg(F.count("*").alias("n_calls"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.sum(total).alias("total"), F.bool_or(given).alias("_given"))
    return sums.withColumn("kind", F.when(F.col("_given"), "actual").otherwise("unavailable")).drop("_given")


def rates(runs: DataFrame, by: list[str], **parts: tuple[Column, Column]) -> DataFrame:
    """For each group a share per name: of the rows where the second condition holds, those where the first does too; null of none."""
    share = lambda hit, of: F.try_divide(F.count_if(hit & of).cast("double"), F.count_if(of))
    return runs.groupBy(*by).agg(*(share(hit, of).alias(name) for name, (hit, of) in parts.items()))


def by_reason(items: DataFrame, key: str, reason: str, text: str, order: str, joiner: str = "\n") -> DataFrame:
    """key, reason and the texts of its items, in order, in one text."""
    grouped = items.groupBy(key, reason).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_g"))
    return grouped.select(key, reason, F.array_join(F.transform("_g", lambda x: x[text]), joiner).alias("texts"))


def resolve(refs: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """``refs`` with the value of their row, or ``deleted:<key>`` where it is gone."""
    return refs.join(rows.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.concat(F.lit("deleted:"), F.col(key).cast("string"))))


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``wanted`` with their cached value where all ``keys`` agree, else a made one; and the rows to add to the cache (keys, value)."""
    missing = wanted.join(cache.select(*keys), keys, "left_anti")
    fresh = make(missing.dropDuplicates(keys)).select(*keys, "value")
    return wanted.join(cache.select(*keys, "value").unionByName(fresh), keys, "left"), fresh


def grid(run: Callable[..., DataFrame], base: dict, factors: dict[str, list]) -> DataFrame:
    """The results of ``run(**condition)`` for ``base`` and for every change of one factor, with a column condition."""
    conditions = [("base", base)] + [(f"{name}={value}", {**base, name: value}) for name, values in factors.items() for value in values if value != base[name]]
    return _union([run(**c).withColumn("condition", F.lit(name)) for name, c in conditions])


def full_grid(run: Callable[..., DataFrame], factors: dict[str, list]) -> DataFrame:
    """The same for every combination of the factors' values."""
    return _union([run(**dict(zip(factors, values, strict=True))).withColumn("condition", F.lit(",".join(f"{n}={v}" for n, v in zip(factors, values, strict=True)))) for values in product(*factors.values())])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def window_estimate(log: DataFrame, changes: DataFrame) -> DataFrame:
    """conv_id and tokens: the sum of the log's tokens, then changes (conv_id, seq, delta) in order, never below 0 after any of them.

    A sum that is held at 0 from below is the last prefix sum less the smallest one, where that is negative.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "delta").rowsBetween(Window.unboundedPreceding, 0)
    moved = changes.withColumn("_s", F.sum("delta").over(order)).groupBy("conv_id").agg(F.sum("delta").alias("d"), F.min("_s").alias("low"))
    both = log.groupBy("conv_id").agg(F.sum("tokens").alias("t")).join(moved, "conv_id", "full_outer")
    start, zero = F.coalesce("t", F.lit(0).cast("long")), F.lit(0).cast("long")
    return both.select("conv_id", (start + F.coalesce("d", zero) - F.least(zero, start + F.coalesce("low", zero))).alias("tokens"))


def shown_answers(parts: DataFrame) -> DataFrame:
    """response_id and answer: the chunks (seq, kind, text) after the last retraction, joined in order; a response without any is empty."""
    last = parts.groupBy("response_id").agg(F.coalesce(F.max(F.when(F.col("kind") == "retract", F.col("seq"))), F.lit(-1)).alias("_last"))
    kept = parts.filter("kind = 'chunk'").join(last, "response_id").filter(F.col("seq") > F.col("_last"))
    joined = kept.groupBy("response_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("_p")).select("response_id", F.array_join(F.transform("_p", lambda x: x["text"]), "").alias("_a"))
    return last.join(joined, "response_id", "left").select("response_id", F.coalesce("_a", F.lit("")).alias("answer"))


def ends(rows: DataFrame, key: str, order: str, value: str, first: int = 5, last: int = 3) -> DataFrame:
    """key, and the first and the last values of each key in order."""
    every = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_e")).withColumn("_e", F.transform("_e", lambda x: x[value]))
    return every.select(key, F.slice("_e", 1, first).alias("first"), F.slice("_e", F.greatest(F.lit(1), F.size("_e") - last + 1), F.lit(last)).alias("last"))

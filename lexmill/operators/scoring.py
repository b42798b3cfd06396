"""Scores of evaluation runs, and checks of what an embedder returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import key_matches, one_of


def ratio(part: Column, whole: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.when(whole > 0, part / whole)


def gold_scores(gold: DataFrame, saved: DataFrame) -> DataFrame:
    """run_id, n_gold, n_found, n_saved, n_right, recall and precision of saved items against patterns.

    ``gold`` has run_id, gold_id, key, scope, status, value (null: any); ``saved`` run_id, item_id, key,
    scope, status, value.  Two semi-joins on the run: each side only asks whether there is a partner.
    """
    g = gold.select("run_id", "gold_id", *(F.col(c).alias(f"g_{c}") for c in ("key", "scope", "status", "value")))
    fits = (g["run_id"] == saved["run_id"]) & key_matches(F.col("g_key"), saved["key"]) & one_of(F.col("g_scope"), saved["scope"]) & one_of(F.col("g_status"), saved["status"]) & (F.col("g_value").isNull() | (F.col("g_value") == saved["value"]))
    count = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    out = count(gold, "n_gold").join(count(saved, "n_saved"), "run_id", "full_outer")
    out = out.join(count(g.join(saved, fits, "left_semi"), "n_found"), "run_id", "left").join(count(saved.join(g, fits, "left_semi"), "n_right"), "run_id", "left")
    out = out.fillna(0, ["n_gold", "n_saved", "n_found", "n_right"])
    return out.select("run_id", "n_gold", "n_found", "n_saved", "n_right", ratio(F.col("n_found"), F.col("n_gold")).alias("recall"), ratio(F.col("n_right"), F.col("n_saved")).alias("precision"))


def threshold_sweep(pairs: DataFrame, thresholds: tuple[float, ...] = (0.15, 0.25, 0.35)) -> DataFrame:
    """threshold, relevant_recall, irrelevant_inject and the numbers behind them, of pairs (score, relevant)."""
    each = pairs.select("score", "relevant", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    taken = F.col("score") >= F.col("threshold")
    n = each.groupBy("threshold").agg(F.count_if("relevant").alias("relevant"), F.count_if(~F.col("relevant")).alias("irrelevant"), F.count_if(F.col("relevant") & taken).alias("hit"), F.count_if(~F.col("relevant") & taken).alias("injected"))
    return n.select("threshold", ratio(F.col("hit"), F.col("relevant")).alias("relevant_recall"), ratio(F.col("injected"), F.col("irrelevant")).alias("irrelevant_inject"), "relevant", "irrelevant")


def check_embeddings(requests: DataFrame, items: DataFrame, dims: int) -> DataFrame:
    """request_id and problem of every request (request_id, n): null, count, index, dims or value.

    ``items`` has request_id, ordinal, item_index (null where the service gives none) and embedding.  If any
    item has an index, the indexes must be 0 to n - 1, each once; of several bad vectors the first one's problem counts.
    """
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = F.when(vector.isNull() | (F.size(vector) != dims), "dims").when(~finite, "value")
    got = items.groupBy("request_id").agg(
        F.count("*").alias("got"),
        F.count("item_index").alias("indexed"),
        F.count_distinct("item_index").alias("distinct"),
        F.min("item_index").alias("low"),
        F.max("item_index").alias("high"),
        F.min(F.when(bad.isNotNull(), F.struct(F.coalesce("item_index", "ordinal").alias("at"), bad.alias("problem"))))["problem"].alias("bad"),
    )
    all_ = requests.join(got, "request_id", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    off = (F.col("indexed") > 0) & ((F.col("distinct") != F.col("n")) | (F.col("low") < 0) | (F.col("high") >= F.col("n")))
    return all_.select("request_id", F.when(F.col("got") != F.col("n"), "count").when(off, "index").otherwise(F.col("bad")).alias("problem"))

"""Mixing of sources to target weights by Efraimidis-Spirakis sampling.

1. Sources in code point order (null last) get weights in turn; the total is shared by weight, no
   source above ``repeats`` times its size.  The level at which this holds has a closed form in
   prefix sums over the sources, ordered by cap / weight.
2. Complete epochs come first: every document of a source counts floor(target / size) times.
3. What is left of the target is filled with documents in the order of their exponential keys,
   -ln(u) / quality weight, u a hash of id, text and, for rows that repeat both and the source, the number of the copy.
   The document at which the budget ends gives only the words that are left.

A source is never sorted in one piece: 1 - exp(-LOWEST * key) cuts its key range into bins, and the words before a
bin are prefix sums of bin totals.  The keys of weight w are spread over B bins with a density of at most w / LOWEST, so
none expects more than 4 / B of them, whatever the weights.  The number of bins grows with the rows.  Copies of a row are numbered in the partitions of the written table first and then across them, so
a row that is repeated very often is held by no task either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3
BINS, BIN_ROWS = 1024, 20_000  # bins of a source at least, and rows of the whole table for each
WORD = "[^\\x20\\x09-\\x0D]+"
LOWEST = 0.5  # the smallest quality weight
#: Characters that count against a text in its quality weight.
NOISE = "0123456789#*$%&|<>{}[]\\/_=+~^@"


def quality_weight(text: Column) -> Column:
    """Between 0.5 (nothing but digits and symbols) and 2 (none of them); 0.5 without text."""
    n = F.length(text)
    return F.when(n > 0, LOWEST + 1.5 * F.length(F.translate(text, NOISE, "")) / n).otherwise(F.lit(LOWEST))


def exponential_key(seed: Column, copy: Column, weight: Column) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of the MD5 of a row's seed and the number of its copy."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", seed, copy.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / 2.0**52) / weight


def key_bin(key: Column, bins: int) -> Column:
    """The bin of a key, in the keys' order."""
    return F.least(F.lit(bins - 1), F.floor((1 - F.exp(-LOWEST * key)) * bins)).cast("int")


def row_seed(doc_id: Column, text: Column) -> Column:
    """The MD5 of id and text, nulls as ''."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (unit_id, unit_hash, row, part) with copy, from 1 within each unit."""
    unit = ["unit_id", "unit_hash"]
    repeated = materialize(rows.groupBy(*unit).agg(F.count("*").alias("n")).filter("n > 1").select(*unit), "repeated-rows")
    if not repeated.limit(1).count():
        return rows.withColumn("copy", F.lit(1).cast("long"))
    copies = materialize(rows.select(*unit, "row", "part").join(repeated, unit), "copies")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*unit).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(copies.groupBy(*unit, "part").agg(F.count("*").alias("n")).withColumn("before", before).drop("n"), "copy-parts")
    within = F.row_number().over(Window.partitionBy(*unit, "part").orderBy("row"))
    number = copies.withColumn("k", within).join(parts, [*unit, "part"]).select("row", (F.col("before") + F.col("k")).alias("copy"))
    return rows.join(number, "row", "left").withColumn("copy", F.coalesce("copy", F.lit(1).cast("long")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size and target of a table with one row (source, source_size) for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).select("source", "source_size", pick.cast("double").alias("weight"), (repeats * F.col("source_size")).cast("double").alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped, below = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every) - capped) / (F.sum("weight").over(every) - below)
    # The first source that its level does not fill sets the level of all that follow.
    open_level = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    found = F.min(F.struct(F.when(F.col("open").isNull(), 1).otherwise(0).alias("none"), F.col("cap_level"), F.col("open")))
    levels = ranked.withColumn("level", level).withColumn("cap_level", F.col("cap") / F.col("weight")).withColumn("open", open_level)
    final = levels.withColumn("final", found.over(every)["open"])
    return final.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target"))


def mix_table(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size (words), source_size, target (its source's) and taken (words, repeats counted) of every row.

    Null texts have size 0 and give nothing; rows without a source form one source; repeated
    rows count each on its own, ties in the key follow the id and size.  An empty table gives
    an empty result; other columns are not carried.  Taken words of a source differ from its
    target by less than one word.
    """
    placed = _placed(docs, weights, repeats, id_col, text_col, source_col)
    return placed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def _unit(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Two keys, never null, that rows share if their id, source and text are equal."""
    marked = [c for name in (id_col, source_col, text_col) for c in (F.col(name), F.col(name).isNull())]
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")).alias("unit_id"), F.xxhash64(*marked).alias("unit_hash")]


def _placed(docs: DataFrame, weights: tuple[int, ...], repeats: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Every row's keys, size, and what the mix takes of it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), quality_weight(text).alias("weight"), row_seed(F.col(id_col), F.col(text_col)).alias("seed"), *_unit(id_col, text_col, source_col))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "mixing")
    bins_each = max(BINS, -(-rows.count() // BIN_ROWS))
    rows = numbered(rows).withColumn("key", exponential_key(F.col("seed"), F.col("copy"), F.col("weight")))
    rows = rows.withColumn("bin", key_bin(F.col("key"), bins_each))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats)
    prior = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("before", F.coalesce(F.sum("words").over(prior), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    starts = starts.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("s_source"), F.col("bin").alias("s_bin"), "before", "source_size", "target")
    placed = rows.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bin") == F.col("s_bin")))
    order = Window.partitionBy("source", "bin").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budget = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("budget") - F.col("ahead")))
    placed = placed.withColumn("ahead", ahead).withColumn("epochs", epochs).withColumn("budget", budget)
    return placed.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows of ``docs``, all its columns: a copy for each epoch, and for the last, cut copy its first words.

    A cut copy's words are joined by single spaces.  Rows that repeat id, source and text are one
    document, which takes what all of them take; its other columns are those of the first in the
    order of their JSON.  Null ids and sources are kept like others; rows without words give
    nothing, nor does an empty table.  Columns may have any names.
    """
    keys = _unit(id_col, text_col, source_col)
    takes = _placed(docs, weights, repeats, id_col, text_col, source_col).groupBy("unit_id", "unit_hash").agg(F.max("size").alias("size"), F.sum("taken").alias("taken")).filter("taken > 0")
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.lit(0).alias("_")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), others.alias("others"), *keys)
    first = F.row_number().over(Window.partitionBy("unit_id", "unit_hash").orderBy("others"))
    single = rows.withColumn("nth", first).filter("nth = 1").select("row", "unit_id", "unit_hash")
    copies = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long"))
    mixed = single.join(takes, ["unit_id", "unit_hash"]).select("row", "size", "taken", F.explode(copies).alias("copy"))
    part = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    text = F.col("row").getField(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), part), " ")
    said = F.when(part < F.col("size"), cut).otherwise(text)
    return mixed.select(*(said.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))

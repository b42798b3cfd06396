"""Operator 3: no bin of keys is much larger than the others, whatever the weights."""

import pytest
from pyspark.sql import functions as F

from lexmill.llm import mixing


@pytest.mark.parametrize(("weight", "most"), [(0.5, 3), (0.75, 3), (1.0, 4), (2.0, 6)])
def test_bins_of_keys(spark, weight, most):
    n, bins = 400_000, 4000
    key = mixing.exponential_key(F.md5(F.col("id").cast("string").cast("binary")), F.lit(1), F.lit(weight))
    rows = spark.range(n).select(key.alias("key")).withColumn("bin", mixing.key_bin(F.col("key"), bins))
    sizes = rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("bin").collect()
    assert max(r.n for r in sizes) < most * n / bins
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:], strict=False))

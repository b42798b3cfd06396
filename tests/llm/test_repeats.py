"""Texts that share an id keep what only they have, whatever their hashes."""

from pyspark.sql import functions as F

from lexmill.llm import repeats


def test_texts_of_one_id_whose_32_bit_hashes_collide(spark):
    """Two texts under one id, alike in 32 bits of hash: the passage that one repeats is cut from it alone."""
    first, second = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    one = spark.range(200_000).select(F.concat(F.lit(first + " "), F.col("id").cast("string")).alias("a")).select("a", F.hash("a").alias("h"))
    two = spark.range(200_000).select(F.concat(F.lit(second + " "), F.col("id").cast("string")).alias("b")).select("b", F.hash("b").alias("h"))
    a, b = one.join(two, "h").select("a", "b").first()
    rows = spark.createDataFrame([(1, first), (5, a), (5, b), (7, second + " end")], "doc_id long, text string")
    got = {(r["row"]["doc_id"], r["row"]["text"]): (r["n_removed"], r["kept"]) for r in repeats.remove_repeats(rows).collect()}
    assert got == {(1, first): (0, first), (5, a): (60, a.split()[-1]), (5, b): (0, b), (7, second + " end"): (60, "end")}
    left = {(r["doc_id"], r["text"]) for r in repeats.cut_documents(rows).collect()}
    assert left == {(1, first), (5, a.split()[-1]), (5, b), (7, "end")}

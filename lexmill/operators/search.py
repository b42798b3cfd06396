"""Retrieval that answers for itself: every request with its status, the codes of the paths that were left out, and its hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.scratch import materialize
from .governance import index_gate, kept_order
from .retrieval import K1, B, counted, fuse, scoped_nearest, top

#: (pool, texts, queries, k) give query_id, doc_id and rank; a query without rows is one that it failed on.
Reranker = Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]


def scoped_bm25(bodies: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score and rank of the ``k`` best bodies (version, doc_id, text) of each query's (query_id, version, text) own version.

    Counts and lengths are those of the version.  Versions that nobody asks are not read (their partitions are pruned where ``bodies`` is
    partitioned by version); each body is tokenised once, and of its tokens only those that some query of its version has are kept.
    """
    asked = materialize(queries.select("query_id", "version", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "version", "token").agg(F.count("*").alias("times")), "asked")
    read = bodies.join(asked.select("version").distinct(), "version", "left_semi")
    counts = materialize(read.select("version", "doc_id", counted(tokens(F.col("text"))).alias("counts")).withColumn("dl", F.aggregate("counts", F.lit(0).cast("long"), lambda n, t: n + t["tf"])), "scoped-counts")
    stats = counts.groupBy("version").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"))
    postings = counts.select("version", "doc_id", "dl", F.explode("counts").alias("t")).select("version", "doc_id", "dl", "t.token", "t.tf").join(asked.select("version", "token").distinct(), ["version", "token"], "left_semi")
    df = postings.groupBy("version", "token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df, ["version", "token"]).join(stats, "version").select("query_id", "version", "token", (F.col("times") * idf).alias("w"), F.when(F.col("avg_len") > 0, F.col("avg_len")).otherwise(1.0).alias("avg_len"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
    scored = postings.join(weighted, ["version", "token"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0")
    return top(scored, "query_id", F.desc("score"), F.col("doc_id"), k=k).select("query_id", "doc_id", "score", "rank")


def search(requests: DataFrame, books: DataFrame, versions: DataFrame, embedders: DataFrame, bodies: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 5, recall: int = 20, reranker: Reranker | None = None, pool: int = 10) -> DataFrame:
    """request_id, version, status, code, vector_code, rerank_code, source and hits (doc_id, method, in order) of every request (request_id, user_id, book_id, expected_hash, text).

    The gate of ``index_gate`` decides which requests run and which have a vector path.  ``bodies`` (version, doc_id, text) and ``vectors``
    (version, doc_id, fingerprint, embedding) are those of all versions, with ids of their own; ``query_vectors`` (request_id, embedding)
    lacks the queries whose embedding failed: VECTOR_FAILED, and BM25 goes on alone.  Both paths recall ``recall`` rows of the version, which are fused;
    a ``reranker`` reorders ``pool`` of them where there are two or more, and where it fails the fused order stays: RERANK_FAILED.
    BM25 has no failure of its own here: a task that fails is run again by Spark, and what fails for good ends the job.
    """
    judged = index_gate(requests, books, versions, embedders).select("request_id", F.col("active_version").alias("version"), "text", "blocked", "skipped")
    judged = judged.join(query_vectors.filter(F.col("embedding").isNotNull()).select("request_id", "embedding"), "request_id", "left")
    vector_code = F.coalesce("skipped", F.when(F.col("blocked").isNull() & F.col("embedding").isNull(), "VECTOR_FAILED"))
    judged = materialize(judged.withColumn("vector_code", vector_code), "judged")
    open_ = judged.filter("blocked IS NULL").select(F.col("request_id").alias("query_id"), "version", "text", "vector_code", "embedding")
    made = versions.select("version", "fingerprint")
    near = scoped_nearest(vectors, open_.filter("vector_code IS NULL").join(made, "version"), recall, ("version",))
    fused = fuse(scoped_bm25(bodies, open_, recall), near, max(k, pool) if reranker else k)
    if reranker is None:
        hits = fused.filter(F.col("rank") <= k).withColumn("redone", F.lit(False))
    else:
        fused = materialize(fused, "fused")
        several = fused.filter("rank = 2").select("query_id")
        again = reranker(fused.join(several, "query_id", "left_semi").select("query_id", "doc_id", "rank"), bodies.select("doc_id", "text"), open_.select("query_id", "text"), k)
        order = kept_order(fused.select("query_id", "doc_id", "rank"), again.select("query_id", "doc_id", "rank"), k)
        hits = order.select("query_id", "doc_id", "rank", (F.col("method") == "rerank").alias("redone")).join(fused.select("query_id", "doc_id", "method"), ["query_id", "doc_id"])
    found = hits.groupBy(F.col("query_id").alias("request_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "method"))).alias("_h"), F.bool_or("redone").alias("_redone"))
    out = judged.join(found, "request_id", "left")
    some, open_row = F.col("_h").isNotNull(), F.col("blocked").isNull()
    status = F.when(~open_row, "unavailable").when(some, "ok").otherwise("empty")
    base = F.when(F.col("vector_code").isNull(), "hybrid(embedding+bm25)").otherwise("bm25")
    rerank_code = F.when((F.size("_h") > 1) & ~F.col("_redone"), "RERANK_FAILED") if reranker else F.lit(None).cast("string")
    return out.select(
        "request_id", F.when(open_row, F.col("version")).alias("version"), status.alias("status"), F.col("blocked").alias("code"), "vector_code", rerank_code.alias("rerank_code"),
        F.when(some, F.concat(base, F.when(F.col("_redone"), "+rerank").otherwise(""))).alias("source"),
        F.coalesce(F.transform("_h", lambda h: F.struct(h["doc_id"].alias("doc_id"), h["method"].alias("method"))), F.array().cast("array<struct<doc_id:bigint,method:string>>")).alias("hits"),
    )

"""Ranking: BM25, exact nearest neighbours, reciprocal rank fusion, and evaluation.

Queries are a stated set; documents are everything.  Statistics cover all documents; ties follow ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze, tokens
from ..functions.vectors import DIMS, Embedder, embed, embed_texts, l2_distance
from ..plans.scratch import materialize, new_path

K1, B, RRF = 1.5, 0.75, 60
QUERY_BLOCK = 1024  # query vectors that a scan of the documents carries at once
VOCABULARY = 20_000  # tokens of all queries together that are scored within a document's row


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once a row."""
    return F.transform(F.array(value), body).getItem(0)


def counted(words: Column) -> Column:
    """The distinct words of an array with their numbers, as an array of (token, tf): sorted, then cut into runs, in the row."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        heads = F.filter(places, lambda i: ~F.coalesce(F.get(s, i - 1) == F.get(s, i), F.lit(False)))
        return let(heads, lambda h: F.transform(h, lambda at, k: F.struct(F.get(s, at).alias("token"), (F.coalesce(F.get(h, k + 1), n) - at).cast("long").alias("tf"))))

    return let(F.sort_array(words), runs)


def term_frequencies(docs: DataFrame) -> DataFrame:
    """doc_id, token, tf; a document is one row, so its tokens are counted there and nothing is shuffled."""
    return docs.select("doc_id", F.explode(counted(tokens(F.col("text")))).alias("t")).select("doc_id", "t.token", "t.tf")


def length_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs and avg_len over all documents, those without tokens included."""
    return docs.select(F.size(tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))


def top(df: DataFrame, key: str, *order: Column, k: int) -> DataFrame:
    """The first ``k`` rows of each key, with ``rank``; Spark limits each task's rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank of the ``k`` best documents (doc_id, text) of each query (query_id, text).

    A query is a bag: a token that occurs twice adds twice.  Every document is tokenised once; its row keeps its
    length and the counts of the tokens that some query has, in one written table.  Up to QUERY_BLOCK queries with
    VOCABULARY tokens in all are scored within the documents' rows, each task keeping its best; only those are shuffled.
    More of them meet the counted tokens in a join (or, better, a stored index: ``plans.postings``).  Documents
    need ids of their own: a null id is not found, and two rows under one id would be two hits, or one with the sum.
    """
    asked = materialize(queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times")), "asked")
    rows = asked.limit(VOCABULARY + 1).collect()
    words = docs.select("doc_id", tokens(F.col("text")).alias("w"))
    whole = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int") and len({r["query_id"] for r in rows}) <= QUERY_BLOCK
    return _bm25_in_rows(words, rows, asked, k) if len(rows) <= VOCABULARY and whole else _bm25_by_join(words, asked, k)


def _bm25_in_rows(words: DataFrame, rows: list, asked: DataFrame, k: int) -> DataFrame:
    vocabulary, ids = sorted({r["token"] for r in rows}), sorted({r["query_id"] for r in rows})
    spec = asked.select("query_id").schema["query_id"].dataType.simpleString()
    counts = materialize(words.mapInArrow(_count_known(vocabulary), "doc_id long, dl int, terms array<int>, tfs array<int>"), "term-counts")
    n_docs, avg_len = counts.agg(F.count("*"), F.avg("dl")).first()
    df = np.zeros(len(vocabulary))
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most VOCABULARY rows
        df[r["term"]] = r["count"]
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    place, number = {t: i for i, t in enumerate(vocabulary)}, {q: i for i, q in enumerate(ids)}
    asks: list[tuple[list[int], list[float]]] = [([], []) for _ in ids]
    for r in sorted(rows, key=lambda r: r["token"]):
        at = place[r["token"]]
        asks[number[r["query_id"]]][0].append(at)
        asks[number[r["query_id"]]][1].append(r["times"] * idf[at])
    return score_in_rows(counts.filter("doc_id IS NOT NULL"), list(zip(ids, asks, strict=True)), len(vocabulary), float(avg_len or 1.0), k, spec)


def score_in_rows(counts: DataFrame, asks: list[tuple], terms: int, avg_len: float, k: int, spec: str, rows: Callable = iter) -> DataFrame:
    """query_id (of type ``spec``), doc_id, score, rank of the ``k`` best of ``counts`` (doc_id, dl, terms, tfs; terms are numbers below ``terms``).

    ``asks``: (query_id, (its terms, their weights)) of every query.  ``rows`` makes those columns of the batches of ``counts``, where they are others.
    """
    ids = [q for q, _ in asks]
    queries = [(np.array(t, np.int64), np.array(w)) for _, (t, w) in asks]
    block = max(64, min(1024, (4 << 20) // max(terms, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), k)
        for batch in rows(batches):
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                dl, edges = part.column(1).to_numpy().astype(np.float64), part.column(2).offsets.to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(edges))
                tf = part.column(3).flatten().to_numpy().astype(np.float64)
                share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avg_len))
                impact = np.bincount(part.column(2).flatten().to_numpy() * part.num_rows + row, share, terms * part.num_rows).reshape(terms, part.num_rows)
                score = np.stack([w @ impact[t] for t, w in queries])
                best.add(part.column(0).to_numpy(), np.where(score > 0, -np.round(score, 9), np.nan))
        best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(best.query.astype(np.int32)), pa.array(best.id), pa.array(-best.score)], ["q", "doc_id", "score"])

    if not ids:
        return counts.limit(0).selectExpr(f"cast(null as {spec}) AS query_id", "cast(null as long) AS doc_id", "cast(null as double) AS score", "cast(null as int) AS rank")
    found = counts.mapInArrow(run, "q int, doc_id long, score double")
    named = F.get(F.array(*(F.lit(q) for q in ids)).cast(f"array<{spec}>"), F.col("q"))
    return top(found, "q", F.desc("score"), F.col("doc_id"), k=k).select(named.alias("query_id"), "doc_id", "score", "rank")


def _count_known(vocabulary: list[str]):
    """doc_id, the number of words, and the known words' places in the vocabulary with their numbers, of rows (doc_id, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = pa.array(vocabulary, pa.string()), max(len(vocabulary), 1)
        for batch in batches:
            edges = batch.column(1).offsets.to_numpy()
            place = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=known), -1).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            cell, tf = np.unique(row[place >= 0] * n + place[place >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(cell, np.arange(batch.num_rows + 1) * n).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (cell % n, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(edges).astype(np.int32)), *lists], ["doc_id", "dl", "terms", "tfs"])

    return run


def _bm25_by_join(words: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    counts = materialize(words.select("doc_id", F.size("w").alias("dl"), counted(F.col("w")).alias("counts")), "term-counts")
    stats = counts.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len")).first()
    postings = counts.select("doc_id", "dl", F.explode("counts").alias("t")).select("doc_id", "dl", "t.token", "t.tf").join(asked.select("token").distinct(), "token", "left_semi")
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (stats["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / float(stats["avg_len"] or 1.0)))
    scored = postings.join(asked.join(df, "token"), "token").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).filter("score > 0")
    return top(scored.withColumn("score", F.round("score", 9)), "query_id", F.desc("score"), F.col("doc_id"), k=k).select("query_id", "doc_id", "score", "rank")


class Best:
    """The ``k`` smallest (score, id) of each of ``n`` queries among what has been seen; memory is bounded by n * k and a slice."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(n, np.inf)

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        query, row = np.nonzero(score <= self.worst[:, None])
        self.query, self.id, self.score = np.append(self.query, query), np.append(self.id, ids[row]), np.append(self.score, score[query, row])
        if len(self.query) > 4 * self.n * self.k:
            self.prune()

    def prune(self) -> None:
        order = np.lexsort((self.id, self.score, self.query))
        q = self.query[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < self.k]
        self.query, self.id, self.score = self.query[order], self.id[order], self.score[order]
        last = np.flatnonzero(np.bincount(self.query, minlength=self.n) == self.k)
        self.worst[last] = self.score[np.searchsorted(self.query, last, "right") - 1]


def _nearest(rows: DataFrame, ids: list, vectors: np.ndarray, k: int, metric: str, to_matrix) -> DataFrame:
    """Each task's ``k`` nearest rows of every query vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best = np.asarray(ids), Best(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own, m = part.column(0).to_numpy(zero_copy_only=False), to_matrix(part.column(1))
                if metric == "l2":
                    score = np.stack([np.sqrt(((m - v) ** 2).sum(axis=1)) for v in vectors])
                else:
                    norm = np.sqrt((m * m).sum(axis=1))[None, :] * np.sqrt((vectors * vectors).sum(axis=1))[:, None]
                    score = -(vectors @ m.T) / np.where(norm == 0, 1, norm)
                best.add(own, np.round(score, 9))
        best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(q[best.query].astype(np.int64)), pa.array(best.id), pa.array(best.score)], ["query_id", "doc_id", "score"])

    return rows.mapInArrow(run, "query_id long, doc_id long, score double")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", dims: int = 64) -> DataFrame:
    """query_id, doc_id, score, rank of the ``k`` nearest rows (doc_id, embedding) of each query (query_id, embedding).

    Exact: queries go out in blocks of QUERY_BLOCK vectors against all rows, each task keeps its best.
    Rows and queries whose vectors have another length take no part.  metric is l2 (distance) or cosine (similarity).
    """
    rows = vectors.filter(F.size("embedding") == dims).select("doc_id", "embedding")
    return _by_blocks(rows, queries.filter(F.size("embedding") == dims).select("query_id", "embedding"), k, metric, dims)


def nearest_texts(docs: DataFrame, queries: DataFrame, k: int = 10, dims: int = DIMS, embedder: Embedder = embed) -> DataFrame:
    """The same for texts under an embedder, L2 distance; null texts count as empty.

    More than one block of queries finds the texts embedded once and written; one block embeds them as it scans.
    """
    rows = embed_texts(docs.select("doc_id", "text"), dims, embedder)
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        rows = materialize(rows, "embedded")
    asked = embed_texts(queries.select(F.col("query_id").alias("doc_id"), "text"), dims, embedder)
    return _by_blocks(rows, asked.select(F.col("doc_id").alias("query_id"), "embedding"), k, "l2", dims)


SCOPE = ("owner", "book", "version")


def scoped_nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """query_id, doc_id, score (L2 distance) and rank of the ``k`` nearest rows of each query's own scope.

    ``vectors`` (doc_id, fingerprint, embedding and the scope's columns) is a table partitioned by the scope: the queries' scopes
    prune its partitions as the query runs, and the limit is applied within each task before anything is shuffled.  Rows
    of another fingerprint than the query's are refused, as are vectors of another length: they are not comparable.
    """
    asked = queries.select("query_id", *(F.col(c) for c in scope), F.col("fingerprint").alias("_fp"), F.col("embedding").alias("_q"))
    both = vectors.join(asked, list(scope)).filter((F.col("fingerprint") == F.col("_fp")) & (F.size("embedding") == F.size("_q")))
    scored = both.select("query_id", "doc_id", F.round(l2_distance(F.col("embedding"), F.col("_q")), 9).alias("score"))
    return top(scored, "query_id", F.col("score"), F.col("doc_id"), k=k)


def _by_blocks(rows: DataFrame, queries: DataFrame, k: int, metric: str, dims: int) -> DataFrame:
    """One scan of the rows for each block of queries; the driver holds one block at a time, and its results are written."""
    matrix = lambda c: np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    spark, path, block = rows.sparkSession, None, []

    def scan(block: list) -> DataFrame:
        vectors = np.array([r[1] for r in block], np.float64).reshape(-1, dims)
        found = _nearest(rows, [r[0] for r in block], vectors, k, metric, matrix)
        best = top(found, "query_id", F.col("score"), F.col("doc_id"), k=k)
        return best.select("query_id", "doc_id", (F.abs("score") if metric == "l2" else -F.col("score")).alias("score"), "rank")

    for r in queries.orderBy("query_id").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            path = path or new_path(spark, "nearest")
            scan(block).write.mode("append").parquet(path)
            block = []
    if path is None:
        return scan(block) if block else spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    if block:
        scan(block).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def fuse(first: DataFrame, second: DataFrame, k: int = 5, names: tuple[str, str] = ("bm25", "vector")) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: query_id, doc_id, rrf, method, rank.

    Ties: rows of the first list in its order, then those of the second alone.
    """
    a, b = first.select("query_id", "doc_id", F.col("rank").alias("r1")), second.select("query_id", "doc_id", F.col("rank").alias("r2"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    score = F.coalesce(1.0 / (RRF + F.col("r1")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("r2")), F.lit(0.0))
    method = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), "hybrid").when(F.col("r1").isNotNull(), names[0]).otherwise(names[1])
    scored = both.select("query_id", "doc_id", F.round(score, 9).alias("rrf"), method.alias("method"), "r1", "r2")
    return top(scored, "query_id", F.desc("rrf"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"), F.col("doc_id"), k=k).select("query_id", "doc_id", "rrf", "method", "rank")


def rerank(hits: DataFrame, texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits ordered by the share of a document's characters that occur in the query; the pool's rank stays as pool_rank."""
    q, d = queries.select("query_id", F.col("text").alias("q")), texts.select("doc_id", F.col("text").alias("d"))
    kept = F.length(F.regexp_replace("d", "\\s+", ""))
    share = F.size(F.filter(F.split("d", ""), lambda c: F.contains(F.col("q"), c))) / F.greatest(F.length("d"), F.lit(1))
    scored = hits.withColumnRenamed("rank", "pool_rank").join(q, "query_id").join(d, "doc_id").withColumn("score", F.round(F.when(kept > 0, share).otherwise(0.0), 9))
    return top(scored, "query_id", F.desc("score"), F.col("pool_rank"), k=k).select("query_id", "doc_id", "score", "pool_rank", "rank")


def evaluate(hits: DataFrame, texts: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row: answerable, hit, recall and mrr at ``k``; a hit contains the gold quote, white space aside.

    ``gold`` has rows (query_id, quote); queries without quotes are not answerable and not counted.
    """
    found = hits.filter(F.col("rank") <= k).join(texts.select("doc_id", squeeze(F.col("text")).alias("t")), "doc_id").join(gold, "query_id").filter(F.contains("t", squeeze(F.col("quote"))))
    per_quote = found.groupBy("query_id", "quote").agg(F.min("rank").alias("rank"))
    quotes = gold.select("query_id", "quote").distinct().join(per_quote, ["query_id", "quote"], "left")
    per_query = quotes.groupBy("query_id").agg(F.max(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit"), F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("recall"), F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("rr"))
    return per_query.agg(F.count("*").alias("answerable"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))


def nearest_rank(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """sorted[min(n - 1, floor(p n))] of each key for every share p.

    Values are counted first, so a key's window holds its distinct values only.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(key)
    ranked = counts.withColumn("_hi", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n")))
    return ranked.groupBy(key).agg(*(F.min(F.when(F.col("_hi") > at(p), F.col(value))).alias(name) for name, p in shares.items()))

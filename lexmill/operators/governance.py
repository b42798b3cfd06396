"""State changes as new tables: guarded updates, recovery after a stop, deletion with what hangs on it, expiry, retrieval statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import CANDIDATE_DAYS, QUESTION_DAYS


def guarded(rows: DataFrame, commands: DataFrame, epochs: DataFrame | None = None) -> DataFrame:
    """``commands`` (command_id, id, expected_revision and others) with verdict: ok, invalid (no revision), missing or conflict.

    ``rows`` has id, user_id and revision, one row each.  With ``epochs`` (user_id, current_epoch) a command's
    expected_epoch must be the user's too.
    """
    known = rows.select("id", F.col("revision").alias("_revision"), F.col("user_id").alias("_user"))
    out = commands.join(known, "id", "left")
    verdict = F.when(F.col("_revision").isNull(), "missing").when(F.col("expected_revision").isNull(), "invalid").when(F.col("expected_revision") != F.col("_revision"), "conflict")
    if epochs is not None:
        out = out.join(epochs.select(F.col("user_id").alias("_user"), F.col("current_epoch").alias("_epoch")), "_user", "left")
        verdict = verdict.when(~F.col("expected_epoch").eqNullSafe(F.coalesce("_epoch", F.lit(0))), "conflict")
    return out.withColumn("verdict", verdict.otherwise("ok")).drop("_revision", "_user", "_epoch")


def transition(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` (id, status, revision and others) after the moves ``asked`` (id, from_status, to_status): only a row that still has
    the status it is asked to leave moves, and its revision grows.  Of several moves of a row the smallest counts.
    """
    moves = asked.groupBy("id").agg(F.min(F.struct("from_status", "to_status")).alias("_m"))
    fits = F.coalesce(F.col("status") == F.col("_m")["from_status"], F.lit(False))
    out = rows.join(moves, "id", "left").withColumn("_fits", fits)
    return out.withColumn("status", F.when(F.col("_fits"), F.col("_m")["to_status"]).otherwise(F.col("status"))).withColumn("revision", F.col("revision") + F.col("_fits").cast("int")).drop("_m", "_fits")


#: What a stop leaves behind, by kind of row: status, what it becomes, and its error code.
STALE = {"index": {"building": ("failed", "RESTART")}, "request": {"running": ("interrupted", "RESTART")}, "source": {"processing": ("failed", "RESTART"), "pending": ("skipped", "RESTART_PENDING")}}


def recover(rows: DataFrame, kind: str, status: str = "status") -> DataFrame:
    """``rows`` with unfinished states closed as after a restart, and error_code where one was."""
    state, code = F.col(status), F.lit(None).cast("string")
    for was, (becomes, why) in STALE[kind].items():
        state, code = F.when(F.col(status) == was, becomes).otherwise(state), F.when(F.col(status) == was, why).otherwise(code)
    return rows.withColumn("error_code", code).withColumn(status, state)


def delete_with(parents: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], keys: list[str]) -> dict[str, DataFrame]:
    """Every child table without the rows of deleted ``parents`` (their ``keys``): name -> (table, its columns for the keys)."""
    gone = parents.select(*keys).distinct()
    return {name: table.join(gone.select(*(F.col(k).alias(c) for k, c in zip(keys, columns, strict=True))), columns, "left_anti") for name, (table, columns) in children.items()}


def expire_scoped(memories: DataFrame, deleted: DataFrame) -> DataFrame:
    """``memories`` with the open items of deleted books (user_id, book_id) expired and their revision raised; no epoch changes."""
    gone = deleted.select("user_id", "book_id").distinct().withColumn("_gone", F.lit(True))
    hit = F.coalesce("_gone", F.lit(False)) & (F.col("scope") == "book") & F.col("status").isin("active", "candidate")
    out = memories.join(gone, ["user_id", "book_id"], "left").withColumn("_hit", hit)
    out = out.withColumn("status", F.when(F.col("_hit"), "expired").otherwise(F.col("status"))).withColumn("revision", F.col("revision") + F.col("_hit").cast("int"))
    return out.select(*memories.columns)


def with_expiry(memories: DataFrame, now: Column) -> DataFrame:
    """``memories`` (kind, status, created_at) with expires_at, and those past it expired: candidates after 30 days, active open questions after 90."""
    days = F.when(F.col("status") == "candidate", CANDIDATE_DAYS).when((F.col("kind") == "open_question") & (F.col("status") == "active"), QUESTION_DAYS)
    out = memories.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(days))
    return out.withColumn("status", F.when(F.coalesce(F.col("expires_at") <= now, F.lit(False)), "expired").otherwise(F.col("status")))


def closed_latest(memories: DataFrame, keys: list[str]) -> DataFrame:
    """The closed item (completed or expired) of each key that was updated last; of equal times the largest id."""
    closed = memories.filter(F.col("status").isin("completed", "expired"))
    return closed.groupBy(*keys).agg(F.max(F.struct("updated_at", "id")).alias("_l")).select(*keys, F.col("_l.id").alias("id"))


def own_messages(messages: DataFrame, conversations: DataFrame, requests: DataFrame) -> DataFrame:
    """What users themselves said: messages (conversation_id, request_id, role, metadata as JSON) of role user and origin user_text, of known conversations and completed requests, with user_id."""
    said = messages.filter((F.col("role") == "user") & (F.get_json_object("metadata", "$.origin") == "user_text"))
    done = requests.filter("status = 'completed'").select("request_id").distinct()
    return said.join(conversations.select("conversation_id", "user_id"), "conversation_id").join(done, "request_id", "left_semi")


def active_conversations(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conversation_id, user_id, book_id, updated_at) with status: the latest of each user and book is active, the others archived."""
    order = Window.partitionBy("user_id", "book_id").orderBy(F.desc("updated_at"), F.desc("conversation_id"))
    return conversations.withColumn("status", F.when(F.row_number().over(order) == 1, "active").otherwise("archived"))


def index_gate(requests: DataFrame, books: DataFrame, versions: DataFrame, embedders: DataFrame) -> DataFrame:
    """``requests`` (user_id, book_id, expected_hash and more) with active_version, blocked and skipped: why no path, or no vector path, can be taken.

    ``books`` has user_id, book_id, active_version; ``versions`` version, user_id, book_id, status, content_hash, mode, fingerprint;
    ``embedders`` user_id, fingerprint.  Checks go in order: no index, an index without versions, a version that is not the book's or not ready, a changed text.
    """
    v = versions.select(F.col("version").alias("active_version"), F.col("user_id").alias("_vu"), F.col("book_id").alias("_vb"), F.col("status").alias("_vs"), F.col("content_hash").alias("_vh"), F.col("mode").alias("_mode"), F.col("fingerprint").alias("_built"))
    out = requests.join(books.select("user_id", "book_id", "active_version", F.lit(True).alias("_known")), ["user_id", "book_id"], "left").join(v, "active_version", "left")
    out = out.join(embedders.select("user_id", F.col("fingerprint").alias("_now")), "user_id", "left")
    ready = (F.col("_vu") == F.col("user_id")) & (F.col("_vb") == F.col("book_id")) & (F.col("_vs") == "ready")
    stale = F.col("expected_hash").isNotNull() & (F.col("expected_hash") != F.col("_vh"))
    blocked = F.when(F.col("_known").isNull(), "INDEX_UNAVAILABLE").when(F.col("active_version").isNull(), "INDEX_LEGACY").when(~F.coalesce(ready, F.lit(False)), "INDEX_UNAVAILABLE").when(stale, "INDEX_STALE")
    skipped = F.when(F.col("_mode") == "bm25", "BM25_ONLY").when(F.col("_now").isNull(), "VECTOR_UNAVAILABLE").when(~F.col("_now").eqNullSafe(F.col("_built")), "VECTOR_INCOMPATIBLE")
    out = out.withColumn("blocked", blocked).withColumn("skipped", F.when(F.col("blocked").isNull(), skipped))
    return out.drop("_known", "_vu", "_vb", "_vs", "_vh", "_mode", "_built", "_now")


def retrieval_status(requests: DataFrame, books: DataFrame, versions: DataFrame, embedders: DataFrame, found: DataFrame) -> DataFrame:
    """request_id, status (ok, empty, error, unavailable), code and vector_code of every request (request_id, user_id, book_id, expected_hash) behind ``index_gate``.

    ``found`` has request_id, bm25_hits and vector_hits, null where the path failed.  A vector path that cannot be used
    is skipped with its code and the other path goes on.
    """
    out = index_gate(requests, books, versions, embedders).join(found, "request_id", "left")
    out = out.withColumn("vector_code", F.coalesce("skipped", F.when(F.col("blocked").isNull() & F.col("vector_hits").isNull(), "VECTOR_FAILED")))
    usable = F.when(F.col("vector_code").isNull(), F.col("vector_hits"))
    hits = F.coalesce("bm25_hits", F.lit(0)) + F.coalesce(usable, F.lit(0))
    failed = F.col("bm25_hits").isNull() & usable.isNull()
    status = F.when(F.col("blocked").isNotNull(), "unavailable").when(hits > 0, "ok").when(failed, "error").otherwise("empty")
    code = F.when(F.col("blocked").isNotNull(), F.col("blocked")).when(status == "error", "RETRIEVAL_FAILED").when(F.col("bm25_hits").isNull(), "BM25_FAILED")
    return out.select("request_id", status.alias("status"), code.alias("code"), "vector_code")


def kept_order(pool: DataFrame, reranked: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, rank and method: the reranked order where a query has one, else the first ``k`` of its pool as they stood.

    ``pool`` and ``reranked`` have query_id, doc_id and rank; a reranker that failed leaves no rows.
    """
    done = reranked.select("query_id", "doc_id", "rank", F.lit("rerank").alias("method"))
    left = pool.join(done.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "doc_id", "rank", F.lit("pool").alias("method"))
    return done.unionByName(left).filter(F.col("rank") <= k)

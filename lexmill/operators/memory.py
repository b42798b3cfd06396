"""Governed memory: validation of candidates, keyed application in message order, scoped recall under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MEMORY_KEY, collapse, estimate_tokens, is_sensitive, jaccard, token_set
from ..functions.vectors import cosine

MAX_ITEMS, BUDGET, RELEVANT, NEAR = 6, 800, 0.25, 0.5
CANDIDATE_DAYS, QUESTION_DAYS = 30, 90
# Kinds with the beginning of their keys, allowed values of enumerated keys.
FAMILIES = {"preference": "preference.", "fact": "fact.", "interest": "interest.", "reading_goal": "reading_goal.", "open_question": "open_question:"}
VALUES = {
    "preference.answer_length": ["concise", "balanced", "detailed"],
    "preference.answer_format": ["bullets", "paragraphs", "steps"],
    "preference.language": ["zh", "en", "fr", "ja", "de", "es", "ru", "other"],
}


def validate(candidates: DataFrame) -> DataFrame:
    """``candidates`` with verdict (candidate, skip or invalid) and reason: the first check that fails.

    Columns: kind, key, scope, content, value, source_id, source_text (null if the source is unknown), range_start,
    range_end, statement_type, stability.
    """
    family, allowed = F.lit(False), F.lit(True)
    for kind, prefix in FAMILIES.items():
        family = F.when(F.col("kind") == kind, F.col("key").startswith(prefix)).otherwise(family)
    for key, values in VALUES.items():
        allowed = F.when(F.col("key") == key, F.col("value").isin(values)).otherwise(allowed)
    said = F.substring(F.col("source_text"), F.col("range_start") + 1, F.col("range_end") - F.col("range_start"))
    bad_range = (F.col("range_start") < 0) | (F.col("range_end") > F.length("source_text")) | (F.col("range_start") >= F.col("range_end")) | (F.length(F.trim(said)) == 0)
    no = lambda c: F.coalesce(~c, F.lit(True))
    checks: list[tuple[str, str, Column]] = [
        ("invalid", "kind", no(F.col("kind").isin(list(FAMILIES)))),
        ("invalid", "key", no(F.col("key").rlike(MEMORY_KEY) & family)),
        ("invalid", "scope", no(F.col("scope").isin("user", "book"))),
        ("invalid", "goal_scope", F.col("kind").isin("reading_goal", "open_question") & (F.col("scope") != "book")),
        ("invalid", "content", F.length(collapse(F.col("content"), 500)) == 0),
        ("invalid", "source_id", F.col("source_id").isNull() | F.col("source_text").isNull()),
        ("invalid", "source_range", F.coalesce(bad_range, F.lit(True))),
        ("invalid", "statement_type", no(F.col("statement_type").isin("explicit", "inferred"))),
        ("invalid", "stability", no(F.col("stability").isin("stable", "one_turn", "unknown"))),
        ("skip", "one_turn", F.col("stability") == "one_turn"),
        ("invalid", "enum_value", no(allowed)),
        ("skip", "sensitive", is_sensitive(F.col("content")) | is_sensitive(said)),
    ]
    verdict, reason = F.lit("candidate"), F.lit(None).cast("string")
    for says, why, fails in reversed(checks):
        verdict, reason = F.when(fails, says).otherwise(verdict), F.when(fails, why).otherwise(reason)
    return candidates.select("*", verdict.alias("verdict"), reason.alias("reason"))


STATE = "user_id long, scope_id long, key string, status string, value string, revision int, source_type string, order_id long, n_candidates int"


def apply_candidates(candidates: DataFrame) -> DataFrame:
    """The state of every (user_id, scope_id, key) after its candidates, in the order of order_id.

    An equal value refreshes; an older source is dropped; an explicit, stable one replaces what no person
    edited; everything else waits as a candidate; a closed item reopens only when asked explicitly.
    source_type ``user_edit`` and ``user_confirmation`` set the value, status ``completed`` and
    ``expired`` close the item.  A null scope_id is the scope of what holds for the user everywhere.
    A key's history is folded by nature; its rows arrive sorted and stream through, and what is held
    is one state and the key's distinct waiting values.
    """
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in STATE.split(", "))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting, out = None, set(), []

        def close() -> None:
            if state is not None:
                out.append({**state, "n_candidates": len(waiting)})

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["user_id"], r["scope_id"], r["key"])
                if state is None or (state["user_id"], state["scope_id"], state["key"]) != key:
                    close()
                    state, waiting = dict(zip(("user_id", "scope_id", "key"), key, strict=True)) | {"status": "none", "value": None, "revision": 0, "source_type": None, "order_id": 0}, set()
                manual, sure = r["source_type"] in ("user_edit", "user_confirmation"), r["statement_type"] == "explicit" and r["stability"] == "stable"
                new = {"value": r["value"], "source_type": r["source_type"], "order_id": max(state["order_id"], r["order_id"]), "revision": state["revision"] + 1, "status": "active"}
                if r["status"] in ("completed", "expired"):
                    if state["status"] == "active":
                        state |= {"status": r["status"], "revision": state["revision"] + 1}
                elif manual:
                    state |= new
                    waiting = set()
                elif state["status"] == "active":
                    if state["value"] == r["value"]:
                        state["order_id"] = max(state["order_id"], r["order_id"])
                    elif r["order_id"] <= state["order_id"]:
                        continue
                    elif state["source_type"] == "user_message" and sure:
                        state |= new
                        waiting = set()
                    else:
                        waiting.add(r["value"])
                elif state["status"] in ("completed", "expired"):
                    if r["reopen"] and r["statement_type"] == "explicit":
                        state |= new
                elif sure:
                    state |= new
                else:
                    waiting.add(r["value"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    keys = ["user_id", "scope_id", "key"]
    columns = [*keys, "order_id", "status", "value", "source_type", "statement_type", "stability", "reopen"]
    typed = candidates.select(*(F.col(c).cast("long").alias(c) if c in ("user_id", "scope_id", "order_id") else F.col(c) for c in columns))
    return typed.repartition(*keys).sortWithinPartitions(*keys, "order_id", "value").mapInArrow(fold, STATE)


def recall(memories: DataFrame, questions: DataFrame, now: Column, threshold: float = RELEVANT, budget: int = BUDGET, vectors: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """user_id, question_id and items (memory_id, reason, in order) that fit ``budget`` tokens and MAX_ITEMS.

    Only active, unexpired items in scope (of the user, or of the question's book) take part.  An item
    that does not fit is passed over, later ones may still fit.  With ``vectors`` (memory_id, fingerprint, vec) and
    ``asked`` (user_id, question_id, fingerprint, vec), an item without enough common words also
    takes part if its vector, of the same fingerprint, has a cosine of NEAR or more with the question's.
    """
    live = memories.filter((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    both = questions.select("user_id", "question_id", F.col("book_id").alias("q_book"), token_set(F.col("question")).alias("q")).join(live, "user_id")
    both = both.filter((F.col("scope") == "user") | ((F.col("scope") == "book") & (F.col("book_id") == F.col("q_book"))))
    reason = F.when(F.col("kind") == "preference", "global_preference").when((F.col("kind") == "reading_goal") & (F.col("scope") == "book"), "current_book")
    relevant = jaccard(F.col("q"), token_set(F.col("content"))) >= threshold
    if vectors is not None and asked is not None:
        both = both.join(asked.select("user_id", "question_id", F.col("fingerprint").alias("_fp"), F.col("vec").alias("_qv")), ["user_id", "question_id"], "left")
        both = both.join(vectors.select("memory_id", F.col("fingerprint").alias("_fp"), F.col("vec").alias("_mv")), ["memory_id", "_fp"], "left")
        relevant = relevant | (F.col("_mv").isNotNull() & (cosine(F.col("_qv"), F.col("_mv")) >= NEAR))
    reason = reason.when(relevant, "relevant_topic")
    manual = F.when(F.col("source_type").isin("user_edit", "user_confirmation"), 0).otherwise(1)
    order = Window.partitionBy("user_id", "question_id").orderBy("manual", F.when(F.col("scope") == "book", 0).otherwise(1), F.desc_nulls_last("seen"), F.desc("salience"), "memory_id")
    rows = both.withColumn("reason", reason).filter("reason IS NOT NULL").withColumn("manual", manual).withColumn("seen", F.coalesce("last_seen_at", "updated_at")).withColumn("tokens", estimate_tokens(F.col("content")))
    ranked = rows.withColumn("pos", F.row_number().over(order)).groupBy("user_id", "question_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tokens", "memory_id", "reason"))).alias("all"))
    start = F.struct(F.lit(0).alias("used"), F.slice(F.col("all"), 1, 0).alias("items"))

    def take(s: Column, x: Column) -> Column:
        fits = (F.size(s["items"]) < MAX_ITEMS) & (s["used"] + x["tokens"] <= budget)
        return F.struct(F.when(fits, s["used"] + x["tokens"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["items"], F.array(x))).otherwise(s["items"]).alias("items"))

    kept = F.aggregate("all", start, take)
    return ranked.select("user_id", "question_id", kept.alias("k")).select("user_id", "question_id", F.col("k.used").alias("tokens"), F.transform("k.items", lambda x: F.struct(x["memory_id"].alias("memory_id"), x["reason"].alias("reason"))).alias("items"))


def barrier(sources: DataFrame, epochs: DataFrame) -> DataFrame:
    """Sources (user_id, message_id, epoch, state) with those of an older epoch, or at or below the user's high-water mark, skipped."""
    stale = (F.col("epoch") < F.col("current_epoch")) | (F.col("message_id") <= F.col("blocked_through"))
    return sources.join(epochs, "user_id", "left").withColumn("state", F.when((F.col("state") == "pending") & stale, "skipped").otherwise(F.col("state"))).select(*sources.columns)


def request_status(sources: DataFrame) -> DataFrame:
    """Roll-up of sources by request: pending if any is, else failed, completed or skipped."""
    has = lambda s: F.bool_or(F.col("state") == s)
    return sources.groupBy("request_id").agg(F.when(has("pending") | has("processing"), "pending").when(has("failed"), "failed").when(has("done"), "completed").otherwise("skipped").alias("status"))

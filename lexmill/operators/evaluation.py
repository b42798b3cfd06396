"""Rates of an evaluation run from what its answers held: evidence, citations, gold quotes, tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import says_no_answer
from ..functions.text import content_hash, normalize_text, squeeze


def located(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """answer_id, n_located and n_exact of the evidence that names a place (doc_id, content_hash, start, end, in code units) and a text.

    Exact: the hash is the document's and its text from start to end is the evidence's.  Texts are normalised and hashed
    once a document that is named, before the equi-join; a document that is gone makes its evidence inexact.
    """
    named = evidence.filter(F.col("start").isNotNull()).select("answer_id", "doc_id", "content_hash", "start", "end", "text")
    whole = docs.join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    whole = whole.select("doc_id", content_hash(F.col("text")).alias("_hash"), F.encode(normalize_text(F.col("text")), "UTF-16BE").alias("_units"))
    part = F.substring("_units", 2 * F.col("start") + 1, 2 * (F.col("end") - F.col("start")))
    exact = (F.col("content_hash") == F.col("_hash")) & (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (part == F.encode("text", "UTF-16BE"))
    return named.join(whole, "doc_id", "left").groupBy("answer_id").agg(F.count("*").alias("n_located"), F.count_if(F.coalesce(exact, F.lit(False))).alias("n_exact"))


def cited(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, n_cited and n_legal: the citations of an answer are legal if its evidence has every one of them, else none is."""
    known = evidence.select("answer_id", "evidence_id").distinct().withColumn("_known", F.lit(True))
    judged = citations.join(known, ["answer_id", "evidence_id"], "left").groupBy("answer_id").agg(F.count("*").alias("n_cited"), F.count("_known").alias("_k"))
    return judged.select("answer_id", "n_cited", F.when(F.col("_k") == F.col("n_cited"), F.col("n_cited")).otherwise(0).alias("n_legal"))


def gold_found(evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """answer_id, n_gold, n_found and first (the place of the first evidence with a gold quote, white space aside) of every answer with gold (answer_id, quote)."""
    quotes = gold.groupBy("answer_id", "quote").agg(F.count("*").alias("_c"))
    texts = evidence.select("answer_id", "ordinal", squeeze(F.coalesce("text", F.lit(""))).alias("_t"))
    best = texts.join(quotes, "answer_id").filter(F.contains("_t", squeeze(F.col("quote")))).groupBy("answer_id", "quote").agg(F.min("ordinal").alias("_at"))
    both = quotes.join(best, ["answer_id", "quote"], "left")
    return both.groupBy("answer_id").agg(F.sum("_c").alias("n_gold"), F.sum(F.when(F.col("_at").isNotNull(), F.col("_c")).otherwise(0)).alias("n_found"), F.min("_at").alias("first"))


def answer_rates(answers: DataFrame, evidence: DataFrame, citations: DataFrame, gold: DataFrame, docs: DataFrame, by: str = "run") -> DataFrame:
    """The rates of each run of ``answers`` (answer_id, ``by``, kind, answer, end_status, tool_calls, needs_evidence); null where nothing is to be divided.

    ``evidence`` has answer_id, evidence_id, ordinal (1, 2, ... in an answer), text and a place or nulls; ``citations`` answer_id, evidence_id.
    coordinate_accuracy: exact of located evidence.  citation_legality: legal of all citations.  hit, recall, mrr: over answers with gold.
    no_evidence_answers: answers of kind answer without evidence, of all.  missed_retrieval: of those that need evidence, without a call and without
    evidence.  no_answer_handling: of those without gold, the ones that say so, by kind or in words.
    Each side is counted by answer before it is joined, so a join has one row of each answer.
    """
    n_evidence = evidence.groupBy("answer_id").agg(F.count("*").alias("n_evidence"))
    each = answers
    for part in (n_evidence, located(evidence, docs), cited(citations, evidence), gold_found(evidence, gold)):
        each = each.join(part, "answer_id", "left")
    each = each.fillna(0, ["n_evidence", "n_located", "n_exact", "n_cited", "n_legal", "n_gold", "n_found", "tool_calls"])
    has_gold, none = F.col("n_gold") > 0, F.col("n_evidence") == 0
    said = (F.coalesce(F.col("kind"), F.lit("")) == "insufficient_evidence") | says_no_answer(F.col("answer"))
    share = lambda hit, of: F.round(F.try_divide(F.count_if(hit & of).cast("double"), F.count_if(of)), 6)
    part = lambda hit, of: F.round(F.try_divide(F.sum(hit).cast("double"), F.sum(of)), 6)
    mean = lambda value: F.round(F.avg(F.when(has_gold, value)), 6)
    needs = F.coalesce(F.col("needs_evidence"), F.lit(False))
    return each.groupBy(by).agg(
        F.count("*").alias("n_answers"),
        F.count_if(~F.col("end_status").eqNullSafe(F.lit("completed"))).alias("n_errors"),
        F.count_if(F.trim(F.coalesce("answer", F.lit(""))) == "").alias("n_empty"),
        part(F.col("n_exact"), F.col("n_located")).alias("coordinate_accuracy"),
        part(F.col("n_legal"), F.col("n_cited")).alias("citation_legality"),
        share(F.col("n_found") > 0, has_gold).alias("hit"),
        mean(F.try_divide(F.col("n_found").cast("double"), F.col("n_gold"))).alias("recall"),
        mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        share(F.col("kind").eqNullSafe(F.lit("answer")) & none, F.lit(True)).alias("no_evidence_answers"),
        share((F.col("tool_calls") == 0) & none, needs).alias("missed_retrieval"),
        share(said, ~has_gold).alias("no_answer_handling"),
        F.round(F.avg("tool_calls"), 6).alias("avg_tool_calls"),
    )

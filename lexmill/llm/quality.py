"""Quality rules as a ledger of failure bits, in DataFrame functions alone.

Every rule is evaluated once for each document; the ledger keeps its failure bit and the
measurement it judged.  Policies are versioned bit masks applied to the ledger afterwards, and
ablations are bitwise aggregates of it: no rule is evaluated again.

Nulls count as the empty text: no words, and the rule on length fails.  Repeated rows are
judged each on its own.  The measurements are taken in the row: no shuffle, so no
hot key, and a very long text costs its own row only.  Rows are filtered through a written ledger, so that
the optimizer cannot take the measurements again for each rule of a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize

SYMBOLS, DIGITS = "[#*$%&|<>]", "[0-9]"
BULLETS, ELLIPSES = ("-", "*", "•"), ("...", "…")
SPACES = " \t\n\x0b\x0c\r"
# Rules in bit order: name, and whether a document fails it, from its measurements.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "many_digits": "100 * n_digits > 30 * word_chars",
    "bullet_lines": "100 * n_bullet_lines > 90 * n_lines",
    "ellipsis_lines": "100 * n_ellipsis_lines > 30 * n_lines",
    "few_distinct_words": "100 * n_distinct_words < 20 * n_words",
}
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "duplicate_lines", "short_words", "long_words"),
    "v2": tuple(RULES),
}


def mask(policy: str) -> int:
    """The failure bits that a policy rejects."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once a row."""
    return F.transform(F.array(value), body).getItem(0)


def _repeated(w: Column, n: Column) -> Column:
    """Words in windows of three that occur at least twice in the array ``w``.

    Hashes of the windows are sorted with their places only where a text has equal ones.
    """
    zero = F.lit(0).cast("long")
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(s: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))

        at = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
        return let(at, lambda a: F.aggregate(F.transform(a, lambda x, m: F.least(F.lit(3), F.coalesce(F.get(a, m + 1) - x, F.lit(3))).cast("long")), zero, lambda total, x: total + x))

    placed = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i")))
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.sort_array(placed(h)), covered)).otherwise(zero)
    return F.when(n < 3, zero).otherwise(let(hashes, some))


def measurements(text: Column) -> Column:
    """The measurements (MEASURED) of a text, as a struct."""

    def measured(t: Column) -> Column:
        words = F.array_remove(F.split(t, "[ \\t\\n\\x0B\\f\\r]+"), "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit("[^ \\t\\n\\x0B\\f\\r]")))
        begins = lambda x: _any(F.startswith(F.ltrim(x, F.lit(SPACES)), F.lit(b)) for b in BULLETS)
        ends = lambda x: _any(F.endswith(F.rtrim(x, F.lit(SPACES)), F.lit(e)) for e in ELLIPSES)
        count = lambda array: F.size(array).cast("long")
        by_line = let(lines, lambda x: F.struct(count(x).alias("n"), (count(x) - count(F.array_distinct(x))).alias("dup"), count(F.filter(x, begins)).alias("bullet"), count(F.filter(x, ends)).alias("ellipsis")))
        by_word = let(words, lambda w: F.struct(count(w).alias("n"), _repeated(w, F.size(w)).alias("repeat"), count(F.array_distinct(w)).alias("distinct"), F.length(F.array_join(w, "")).cast("long").alias("chars")))
        return F.struct(
            by_word.alias("w"),
            by_line.alias("l"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.regexp_count(t, F.lit(DIGITS)).cast("long").alias("n_digits"),
        )

    at = (("w", "n"), ("w", "chars"), ("n_symbols",), ("l", "n"), ("l", "dup"), ("w", "repeat"), ("n_digits",), ("l", "bullet"), ("l", "ellipsis"), ("w", "distinct"))
    flat = lambda m: F.struct(*((m[a[0]] if len(a) == 1 else m[a[0]][a[1]]).alias(name) for name, a in zip(MEASURED, at, strict=True)))
    return let(let(F.coalesce(text, F.lit("")), measured), flat)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_digits", "n_bullet_lines", "n_ellipsis_lines", "n_distinct_words")


def failure_bits() -> Column:
    """The failure bits of a row of measurements."""
    failures = F.lit(0)
    for k, rule in enumerate(RULES.values()):
        failures = failures.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)))
    return failures


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failures`` (a bit for each rule) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), measurements(F.col(text_col)).alias("_m"))
    rows = rows.select("doc_id", *(F.col("_m")[k].alias(k) for k in MEASURED))
    return rows.withColumn("failures", failure_bits())


def passes(policy: str, failures: Column | None = None) -> Column:
    """Whether a ledger row passes a policy."""
    failures = F.col("failures") if failures is None else failures
    return failures.bitwiseAND(F.lit(mask(policy))) == 0


def stored_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The ledger of ``docs`` written beside its rows: ``row`` (all columns), the measurements and ``failures``.

    Parquet keeps them apart, so what only asks for failure bits reads no text.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    judged = docs.select(row, measurements(F.col(text_col)).alias("_m")).select("row", *(F.col("_m")[k].alias(k) for k in MEASURED))
    return materialize(judged.withColumn("failures", failure_bits()), "ledger")


def accepted(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that pass a policy by their stored ledger.  An empty table gives none."""
    return stored_ledger(docs, text_col).filter(passes(policy)).select("row.*")


def text_key(text: Column) -> list[Column]:
    """Two hashes of a text, 128 bits; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("key_1"), F.xxhash64(F.lit(1), t).alias("key_2")]


def book(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger written without texts, with a key of each row's text: policies, later ones too, and ablations read it and evaluate no rule."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(F.col(text_col)), measurements(F.col(text_col)).alias("_m"))
    rows = rows.select("doc_id", "key_1", "key_2", *(F.col("_m")[k].alias(k) for k in MEASURED))
    return materialize(rows.withColumn("failures", failure_bits()), "book")


def accepted_by(docs: DataFrame, written: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that pass a policy by their written book: rows find their failure bits by the key of their text.

    Equal texts fail equal rules, so one row of the book for each text is enough: a text that a third of all rows share is one row of that side.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keys = written.filter(passes(policy)).select("key_1", "key_2").distinct()
    return docs.select(row, *text_key(F.col(text_col))).join(keys, ["key_1", "key_2"], "left_semi").select("row.*")


def ablations(book: DataFrame, policies: tuple[str, ...] = ("v1",)) -> DataFrame:
    """For each policy and rule: failed (documents that fail the rule) and alone (rejected by no other rule of the policy; 0 for rules that are not in it).

    The ledger is counted by its bits first: at most 2 ** rules rows, whatever its size.
    """
    counts = book.groupBy("failures").agg(F.count("*").alias("n"))
    asked = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(mask(p)).alias("mask"), F.lit(name).alias("rule"), F.lit(1 << k).alias("bit")) for p in policies for k, name in enumerate(RULES)))
    rows = counts.select("failures", "n", F.explode(asked).alias("r")).select("failures", "n", "r.*")
    sum_if = lambda condition: F.sum(F.when(F.expr(condition), F.col("n")).otherwise(0))
    return rows.groupBy("policy", "rule", "bit").agg(sum_if("failures & bit <> 0").alias("failed"), sum_if("failures & mask = bit AND mask & bit <> 0").alias("alone"))

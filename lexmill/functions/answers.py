"""Expressions on answers of a language model: length caps, notes, JSON items, style checks, normal forms of values.

Lengths are characters.  Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, collapse, estimate_tokens, utf16_length, utf16_prefix

# Other names of the values of enumerated keys, the value first; marks at which a summary may end; what says that a book has no answer.
ALIASES = {
    "preference.answer_length": {
        "concise": ["concise", "简洁", "简短", "简单", "short", "brief"],
        "balanced": ["balanced", "适中", "中等", "medium"],
        "detailed": ["detailed", "详细", "详尽", "长篇", "long", "verbose"],
    },
    "preference.answer_format": {
        "bullets": ["bullets", "分点", "列表", "要点", "条目", "list", "bullet"],
        "paragraphs": ["paragraphs", "段落", "连贯", "散文", "paragraph", "prose"],
        "steps": ["steps", "步骤", "分步", "step"],
    },
    "preference.language": {
        "zh": ["zh", "中文", "汉语", "chinese", "zh-cn"],
        "en": ["en", "英文", "英语", "english"],
        "fr": ["fr", "法语", "法文", "french"],
        "ja": ["ja", "日语", "日文", "japanese"],
        "de": ["de", "德语", "german"],
        "es": ["es", "西班牙语", "spanish"],
        "ru": ["ru", "俄语", "russian"],
        "other": ["other", "其他"],
    },
}
SUMMARY_ENDS = "。；"
NO_ANSWER = "证据不足|书中(并)?(未|没有)|未(给出|记载|提供|找到)|无法(从|在)书中|没有(给出|记载|找到)"
BULLET = r"(^|\n)" + SPACE + r"*([-*•]|\d+[.、)）])"
FRENCH_LETTERS = "[àâçéèêëîïôùûüœ]"
FRENCH_WORDS = "bonjour|voici|c'est|les|des|une"
SUMMARY, QUOTES = "【摘要】", "【金句】"


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def cap_summary(text: Column, cap: Column | int) -> Column:
    """The text shortened in proportion to ``cap`` tokens, then back to the last sentence or line end in its second half."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    whole = strip(text)
    tokens = estimate_tokens(whole)
    part = utf16_prefix(whole, F.floor(utf16_length(whole) * (cap / F.greatest(tokens, F.lit(1)))).cast("int"))
    size = F.length(part)
    from_end = F.locate("\n", F.reverse(F.translate(part, SUMMARY_ENDS, "\n" * len(SUMMARY_ENDS))))
    ended = F.substring(part, F.lit(1), size - from_end + 1)
    return F.when(tokens <= cap, whole).when((from_end > 0) & (size - from_end > size * 0.5), ended).otherwise(part)


def memory_value(key: Column, raw: Column) -> Column:
    """The value of an enumerated key (null if none fits), or the collapsed text of any other key.

    An exact name without regard to case and white space comes first, then the longest name within the text.
    """
    text = F.coalesce(raw, F.lit(""))
    compact = F.lower(F.regexp_replace(text, SPACE + "+", ""))
    out = collapse(text, 200)
    for known, values in ALIASES.items():
        names = [(name, value) for value, every in values.items() for name in every]
        table = F.create_map(*(F.lit(x) for pair in names for x in pair))
        within = [F.when(F.contains(text, F.lit(name)), value) for name, value in sorted(names, key=lambda p: -len(p[0])) if len(name) > 1]
        out = F.when(key == known, F.coalesce(table[compact], table[strip(text)], *within)).otherwise(out)
    return out


def json_items(output: Column) -> Column:
    """The JSON texts of the items of the array between the first [ and the last ], fences aside; null if it is no JSON array."""
    bare = F.regexp_replace(F.coalesce(output, F.lit("")), "```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.when(F.try_parse_json(found).isNotNull(), F.from_json(found, "array<string>"))


def whole_number(item: Column, path: str) -> Column:
    """A number or numeric string of a JSON text as long; null if it is neither."""
    return F.get_json_object(item, path).try_cast("long")


def memory_candidate(item: Column) -> Column:
    """kind, key, scope, content, value, source_id, range_start, range_end, statement_type and stability of a JSON item.

    Ranges may be objects or arrays, numbers may be strings; what does not fit is null.
    """
    said = lambda name: F.get_json_object(item, f"$.{name}")
    edge = lambda name, at: F.coalesce(whole_number(item, f"$.sourceRange.{name}"), whole_number(item, f"$.sourceRange[{at}]")).cast("int")
    return F.struct(
        said("kind").alias("kind"),
        said("key").alias("key"),
        said("scope").alias("scope"),
        said("content").alias("content"),
        memory_value(said("key"), said("normalizedValue")).alias("value"),
        whole_number(item, "$.sourceMessageId").alias("source_id"),
        edge("start", 0).alias("range_start"),
        edge("end", 1).alias("range_end"),
        said("statementType").alias("statement_type"),
        said("stability").alias("stability"),
    )


def complies(style: str, answer: Column) -> Column:
    """Whether an answer keeps a style: bullets, concise, detailed, not_french or english."""
    a = F.coalesce(answer, F.lit(""))
    if style == "bullets":
        return F.regexp_count(a, F.lit(BULLET)) >= 2
    if style == "concise":
        return F.length(a) <= 250
    if style == "detailed":
        return F.length(a) >= 400
    if style == "not_french":
        return ~(a.rlike(f"(?iu){FRENCH_LETTERS}") | a.rlike(f"(?i)(?<![a-z0-9_])({FRENCH_WORDS})(?![a-z0-9_])"))
    if style == "english":
        return F.regexp_count(a, F.lit("[a-zA-Z]")) > F.length(a) * 0.5
    raise ValueError(f"style {style}")


def says_no_answer(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(NO_ANSWER)


def chapter_note(text: Column, source: Column | None = None, most: int = 2) -> Column:
    """summary and the first ``most`` quotes of a note; with ``source``, only of quotes that it contains."""
    t = F.coalesce(text, F.lit(""))
    marked = F.regexp_extract(t, rf"(?s){SUMMARY}(.*?)(?={QUOTES}|\z)", 1)
    summary = strip(F.when(F.contains(t, F.lit(SUMMARY)), marked).otherwise(t))
    lines = F.split(F.regexp_extract(t, rf"(?s){QUOTES}(.*)\z", 1), "\n")
    quoted = F.transform(lines, lambda line: strip(F.regexp_extract(line, "[“\"「](.+?)[”\"」]", 1)))
    quotes = F.slice(F.filter(quoted, lambda q: q != ""), 1, most)
    if source is not None:
        quotes = F.filter(quotes, lambda q: F.contains(source, q))
    return F.struct(summary.alias("summary"), quotes.alias("quotes"))


def key_matches(pattern: Column, key: Column) -> Column:
    """Whether a key equals a pattern, or begins with what stands before its final *; a null pattern takes all."""
    begins = F.startswith(key, F.regexp_replace(pattern, r"\*$", ""))
    return pattern.isNull() | F.coalesce(F.when(pattern.endswith("*"), begins).otherwise(pattern == key), F.lit(False))


def one_of(pattern: Column, value: Column) -> Column:
    """Whether a value is among the alternatives a|b of a pattern; a null pattern takes all."""
    return pattern.isNull() | F.coalesce(F.array_contains(F.split(pattern, r"\|"), value), F.lit(False))


def selection_verdict(text: Column, content_hash: Column, said_hash: Column, start: Column, end: Column, said: Column) -> Column:
    """ok, BOOK_CONTENT_CHANGED (another hash) or INVALID_SELECTION (a range that does not hold the selected text)."""
    same = (start >= 0) & (start < end) & (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == said)
    return F.when(~content_hash.eqNullSafe(said_hash) | said_hash.isNull(), "BOOK_CONTENT_CHANGED").when(F.coalesce(same, F.lit(False)), "ok").otherwise("INVALID_SELECTION")

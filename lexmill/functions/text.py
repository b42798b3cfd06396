"""Scalar text functions as Column expressions.  Lengths and offsets are UTF-16 code units where the name says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r    -     　﻿]"
# Model context lengths, the mark of a cut text, and words that carry no topic.
CONTEXT_DEFAULT, CONTEXT_LONG = 262_144, 1_000_000
CUT = "\n...(内容已截断)"
STOP_WORDS = (
    "的 了 是 我 你 他 她 它 们 什么 怎么 怎样 如何 请 吗 呢 啊 吧 这 那 有 和 与 在 要 会 能 对 为 以 及 或 但 而 被 把 让 向 从 到 给 等 很 更 最 都 也 就 还 又 再 "
    "一个 一些 这个 那个 自己 现在 目前 觉得 认为 希望 想 知道 告诉 问题 回答"
).split()


def normalize_text(text: Column) -> Column:
    """Null becomes empty, one leading byte order mark goes, CR and CRLF become LF; nothing else changes."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^﻿", ""), "\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("txt-v1:"), F.sha2(normalize_text(text), 256))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words of two characters or more, then every CJK character and bigram, run by run; duplicates stay."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit("[a-z][a-z0-9'-]+"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit("[一-龥]+"), F.lit(0))

    def cut(run: Column, size: int) -> Column:
        last = F.length(run) - size + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(run, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.concat(words, F.flatten(F.transform(runs, lambda r: F.concat(cut(r, 1), cut(r, 2)))))


def token_set(text: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def squeeze(text: Column) -> Column:
    """Without white space, for comparisons of quotes."""
    return F.regexp_replace(text, SPACE + "+", "")


def collapse(text: Column, cap: int) -> Column:
    """Runs of white space become one space, ends are trimmed, the rest is cut at ``cap``."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")), 1, cap)


def question_title(text: Column) -> Column:
    return collapse(text, 30)


def utf16_prefix(text: Column, n: Column | int) -> Column:
    """The longest beginning of at most ``n`` UTF-16 code units; a surrogate pair is never split."""
    n = F.lit(n) if isinstance(n, int) else n
    short = F.substring(text, F.lit(1), n)
    fits = F.filter(F.sequence(F.floor(n / 2).cast("int"), n.cast("int")), lambda m: utf16_length(F.substring(text, F.lit(1), m)) <= n)
    return F.when(utf16_length(short) <= n, short).otherwise(F.substring(text, F.lit(1), F.array_max(fits)))


def truncate(text: Column, limit: int = 3000, mark: str = CUT) -> Column:
    """Null becomes empty; a text of more than ``limit`` UTF-16 code units is cut there and marked."""
    t = F.coalesce(text, F.lit(""))
    return F.when(utf16_length(t) > limit, F.concat(utf16_prefix(t, limit), F.lit(mark))).otherwise(t)


def estimate_tokens(text: Column) -> Column:
    """ceil(0.6 * UTF-16 length), the estimate without a tokenizer."""
    return F.ceil(utf16_length(F.coalesce(text, F.lit(""))) * F.lit(0.6)).cast("int")


def file_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with two decimals."""
    step = lambda size, name: F.concat(F.format_string("%.2f", n / float(size)), F.lit(f" {name}"))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, step(1 << 10, "KB")).when(n < 1 << 30, step(1 << 20, "MB")).otherwise(step(1 << 30, "GB"))


def mask_key(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 8), F.lit("****"), F.substring(key, -4, 4))


def context_limit(model: Column, known: dict[str, int] | None = None) -> Column:
    out = F.when(F.lower(model).contains("long"), F.lit(CONTEXT_LONG)).otherwise(F.lit(CONTEXT_DEFAULT))
    for name, size in (known or {}).items():
        out = F.when(model == name, F.lit(size)).otherwise(out)
    return out


def endpoint(url: Column, path: str) -> Column:
    """Trailing slashes go; ``path`` is appended unless it is there."""
    bare = F.regexp_replace(F.trim(url), "/+$", "")
    return F.when(bare.endswith(path), bare).otherwise(F.concat(bare, F.lit(path)))


def occurrences(text: Column, part: str, cap: int) -> Column:
    """Start offsets (characters, from 0) of the first ``cap`` non-overlapping occurrences of a literal."""
    pieces = F.split(text, r"\Q" + part.replace(r"\E", r"\E\\E\Q") + r"\E")
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x)) + (i - 1) * len(part))
    return F.when(F.size(pieces) > 1, F.slice(starts, 1, cap)).otherwise(F.array().cast("array<int>"))


# Patterns that sort questions, in their order, and those that override settings for one turn.
QUESTION_RULES = (
    ("skip", "不要记住|别记住|不用记|不需要记"),
    ("explicit", "忘记|忘掉|删除记忆|清除记忆|不要再记"),
    ("explicit", "更正|纠正|改过来|以后改为|以后改成"),
    ("explicit", "(?i)请记住|记住|记下|remember"),
    ("skip", "这次|仅这次|本次|这一轮|本轮|暂时"),
)
LATE_RULES = (("skip", "^(什么是|为什么|怎么会|请问|翻译|解释|总结)(?!.*我)"), ("strong", "我一直|我总是|我习惯|我喜欢|我偏好|我讨厌|我更喜欢|以后都|今后都|每次都|我是.*学生|我的职业|我是一名"), ("weak", "我"))
TURN_GATE = "这次|仅这次|本次|这一轮|本轮"
TURN_RULES = (
    (("preference.answer_length", "detailed", "详细|详尽|展开"), ("preference.answer_length", "concise", "简洁|简短|简单")),
    (("preference.answer_format", "bullets", "分点|列表|条目|要点"), ("preference.answer_format", "paragraphs", "段落|连贯")),
)
TURN_LANGUAGES = {"用法语": "fr", "用英文": "en", "用英语": "en", "用中文": "zh", "用日语": "ja", "用德语": "de"}
SENSITIVE = r"(?i)api[_-]?key|secret[_-]?key|password|passwd|密码|密钥|令牌|token\s*[:=]|sk-[a-zA-Z0-9]{10,}|bearer\s+[a-zA-Z0-9]"
MEMORY_KEY = r"^(preference\.(answer_length|answer_format|language|example_style)|fact\.role|interest\.topic:[a-z0-9][a-z0-9_-]{0,39}|reading_goal\.primary|open_question:[a-z0-9][a-z0-9_-]{0,39})$"


def question_class(question: Column, action: Column | None = None, has_selection: Column | None = None) -> Column:
    """skip, explicit, strong or weak: the first rule that fits decides."""
    q = F.coalesce(question, F.lit(""))
    action, has_selection = F.lit(None) if action is None else action, F.lit(False) if has_selection is None else has_selection
    out = F.lit("skip")
    for says, pattern in reversed(LATE_RULES):
        out = F.when(q.rlike("(?s)" + pattern if pattern.startswith("^") else pattern), says).otherwise(out)
    out = F.when((action == "translate") | ((action == "explain") & has_selection), "skip").otherwise(out)
    for says, pattern in reversed(QUESTION_RULES):
        out = F.when(q.rlike(pattern), says).otherwise(out)
    return out


def turn_overrides(question: Column) -> Column:
    """Settings that a question asks for this turn only: an array of (key, value)."""
    q = F.coalesce(question, F.lit(""))
    item = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    found = []
    for group in TURN_RULES:
        out = F.lit(None)
        for key, value, pattern in reversed(group):
            out = F.when(q.rlike(pattern), item(key, F.lit(value))).otherwise(out)
        found.append(out)
    said = F.regexp_extract(q, "|".join(TURN_LANGUAGES), 0)
    lang = F.lit(None)
    for word, code in TURN_LANGUAGES.items():
        lang = F.when(said == word, item("preference.language", F.lit(code))).otherwise(lang)
    every = F.array_compact(F.array(*found, lang))
    return F.when(q.rlike(TURN_GATE), every).otherwise(F.slice(every, 1, 0))


def is_sensitive(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(SENSITIVE)


def normalize_citations(answer: Column, evidence_ids: Column) -> tuple[Column, Column]:
    """The answer with marks outside ``evidence_ids`` replaced, and the cited ids in the order of their first mention."""
    bad, known = "引用无效", F.regexp_extract_all(answer, F.lit(r"\[\[(E\d+)\]\]"), F.lit(1))
    cited = F.array_distinct(F.filter(known, lambda x: F.array_contains(evidence_ids, x)))
    unknown = F.array_distinct(F.filter(known, lambda x: ~F.array_contains(evidence_ids, x)))
    clean = F.aggregate(unknown, answer, lambda s, x: F.replace(s, F.concat(F.lit("[["), x, F.lit("]]")), F.lit(bad)))
    return F.regexp_replace(clean, r"\[\[(?!E\d+\]\])E?\d*\]?", bad), cited

"""URL filter: rules first, a character language-model ratio for the rest.  DataFrame functions alone.

Rules label the URLs they fit.  Two smoothed variable-order Markov models, of accepted and of
rejected URLs, count every labelled URL.  The order-k estimate of a character falls back on order
k - 1 as far as its context is rare: p_k = (n(context, c) + M p_{k-1}) / (n(context) + M), so an
unseen context leaves the lower order as it is.  A URL's score is the difference of its two
log-likelihoods divided by its length.

The threshold is calibrated on labelled URLs scored by models of the other half of them (by a hash
of host and path, so all copies of a URL are in one half and no URL is scored by counts of its own): it is the
bin edge with the least sum of the two error rates.  Ids play no part in a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

ORDER = 4
SMOOTH = 2.0
ALPHABET = 256
BIN, BINS = 0.01, 1000  # calibration bins: scores from -BIN * BINS to BIN * BINS
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START = "\x02"
_BLOCK = 256
_URL = "://([^/?#]*)([^?#]*)"
_COUNTS = ("a0", "a1", "b0", "b1")  # allow or block, in URLs of fold 0 or 1


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, at = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(at)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(text: Column, order: int = ORDER) -> Column:
    """Every character of a text with the ``order`` characters before it (start marks before the first).

    Cut from blocks, so that a very long text takes time in proportion to its length.
    """
    padded = F.concat(F.lit(_START * order), text)
    n = F.length(text)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.substring(padded, b * _BLOCK + 1, F.lit(_BLOCK + order)))
    inner = F.flatten(F.transform(blocks, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - order), lambda i: F.substring(s, i, F.lit(order + 1)))))
    return F.when(n > 0, inner).otherwise(F.array().cast("array<string>"))


def gram_ratios(counts: DataFrame, order: int = ORDER, smooth: float = SMOOTH) -> DataFrame:
    """gram, and its log probability ratio under all counts (full) and without a fold's own (out0, out1).

    ``counts`` has one row for each gram, its columns in _COUNTS; shorter grams' counts are sums of its rows.
    """
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.struct(k.alias("size"), F.substring("gram", F.lit(order + 2) - k, k).alias("part"))))
    suffixes = counts.select("gram", *_COUNTS, parts.alias("p")).select("gram", F.col("p.size").alias("size"), F.col("p.part").alias("part"), *_COUNTS)
    tails = materialize(suffixes.groupBy("part", "size").agg(*(F.sum(c).alias(c) for c in _COUNTS)), "url-tails")
    heads = tails.groupBy(F.expr("substring(part, 1, size - 1)").alias("head"), "size").agg(*(F.sum(c).alias(f"{c}_all") for c in _COUNTS))
    known = tails.withColumn("head", F.expr("substring(part, 1, size - 1)")).join(heads, ["head", "size"]).select("part", "size", F.array(*(F.col(c).cast("double") for c in _COUNTS)).alias("n"), F.array(*(F.col(f"{c}_all").cast("double") for c in _COUNTS)).alias("total"))
    steps = suffixes.select("gram", "part", "size").join(known, ["part", "size"]).groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("size", "n", "total"))).alias("steps"))

    def log_p(*which: int) -> Column:
        pick = lambda a: sum((a[i] for i in which[1:]), a[which[0]])
        return F.log(F.aggregate("steps", F.lit(1.0 / ALPHABET), lambda p, s: (pick(s["n"]) + smooth * p) / (pick(s["total"]) + smooth)))

    return steps.select("gram", (log_p(0, 1) - log_p(2, 3)).alias("full"), (log_p(1) - log_p(3)).alias("out0"), (log_p(0) - log_p(2)).alias("out1"))


def calibrate(scored: DataFrame, step: float = BIN, bins: int = BINS) -> float:
    """The threshold for cross-fitted scores (says, score, copies): scores at or above it are allowed.

    Scores are counted in a fixed number of bins first; one row comes to the driver.  With labels
    of one kind only, or none, the threshold is 0.
    """
    at = F.greatest(F.lit(-bins), F.least(F.lit(bins), F.floor(F.col("score") / step))).cast("int")
    of = lambda says: F.sum(F.when(F.col("says") == says, F.col("copies")).otherwise(0))
    hist = scored.groupBy(at.alias("bin")).agg(of("allow").alias("a"), of("block").alias("b"))
    order = Window.orderBy("bin")
    below, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(below), F.lit(0)), F.sum(c).over(every))
    missed, let_in = share("a"), 1 - share("b")
    best = hist.select("bin", F.round(missed + let_in, 9).alias("loss")).filter("loss IS NOT NULL").agg(F.min(F.struct("loss", F.abs("bin").alias("size"), "bin")).alias("best")).first()["best"]
    return 0.0 if best is None else best["bin"] * step


def judge_urls(pages: DataFrame, rules=RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row.

    A rule that fits decides (the longest wins); otherwise the score does, against the calibrated
    threshold.  A URL without host and path (null, or without ``://``) is blocked, with score 0.
    Repeated rows are judged alike and each is returned; a null id is kept; other columns
    are not carried.  An empty table gives an empty result.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, says = best_rule(F.col("host"), F.col("path"), rules)
    text = F.concat("host", "path")
    digest = F.md5(F.concat("host", "path"))  # no host has a slash and every path begins with one: the two can be told apart
    fold = F.conv(F.substring(digest, 32, 1), 16, 10).cast("int") % 2
    # Equal URLs have equal scores: each is scored once, however many rows share it.
    urls = rows.select("host", "path", rule.alias("rule"), says.alias("says"), text.alias("text"), fold.alias("fold"))
    distinct = materialize(urls.groupBy("text", "host", "path", "rule", "says", "fold").agg(F.count("*").alias("copies")).withColumn("uid", F.unhex(digest)), "urls")
    pieces = distinct.select("uid", "says", "fold", "copies", F.explode(grams(F.col("text"), order)).alias("gram"))
    mine = [F.sum(F.when((F.col("says") == s) & (F.col("fold") == f), F.col("copies")).otherwise(0)).alias(c) for c, (s, f) in zip(_COUNTS, (("allow", 0), ("allow", 1), ("block", 0), ("block", 1)), strict=True)]
    # Unlabelled URLs' grams take part with zero counts, so every gram finds its ratio.
    counts = materialize(pieces.groupBy("gram").agg(*mine), "url-grams")
    ratio = materialize(gram_ratios(counts, order), "url-ratios")
    own = F.when(F.col("fold") == 0, F.col("out0")).otherwise(F.col("out1"))
    sums = pieces.select("uid", "fold", "gram").join(ratio, "gram").groupBy("uid").agg(F.round(F.avg("full"), 6).alias("score"), F.round(F.avg(own), 6).alias("cross"))
    scored = materialize(distinct.join(sums, "uid", "left"), "url-scores")
    threshold = calibrate(scored.filter("says IS NOT NULL AND cross IS NOT NULL").select("says", F.col("cross").alias("score"), "copies"))
    by_url = scored.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "rule", "says", F.coalesce("score", F.lit(0.0)).alias("score"))
    verdict = F.coalesce(F.col("says"), F.when((F.length("host") + F.length("path") > 0) & (F.col("score") >= threshold), "allow").otherwise("block"))
    both = rows.join(by_url, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

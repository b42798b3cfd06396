"""The URL model against a plain version: counts, backing off, cross-fitted scores, threshold and verdicts."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import url_model
from lexmill.llm.url_model import ALPHABET, BIN, BINS, ORDER, RULES, SMOOTH

ORG = "http://a{}.org/page/{}"


def split(url):
    found = re.search("://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    if not found:
        return "", ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2]


def rule_of(host, path):
    fits = [(len(rule), rule, says) for says, rule in RULES for name, at in [rule.split("/", 1)] if (host == name or host.endswith("." + name)) and path.startswith("/" + at)]
    return max(fits)[1:] if fits else (None, None)


class Model:
    """Counts of every context and character, once for each label and fold."""

    def __init__(self, urls):
        self.n, self.total = defaultdict(Counter), defaultdict(Counter)
        for text, says, fold, copies in urls:
            for context, c in self.steps(text):
                for k in range(ORDER + 1):
                    tail = context[ORDER - k :]
                    self.n[says, fold][tail, c] += copies
                    self.total[says, fold][tail] += copies

    @staticmethod
    def steps(text):
        padded = "\x02" * ORDER + text
        return [(padded[i : i + ORDER], padded[i + ORDER]) for i in range(len(text))]

    def log_p(self, says, folds, context, c):
        p = 1 / ALPHABET
        for k in range(ORDER + 1):
            tail = context[ORDER - k :]
            p = (sum(self.n[says, f][tail, c] for f in folds) + SMOOTH * p) / (sum(self.total[says, f][tail] for f in folds) + SMOOTH)
        return math.log(p)

    def score(self, text, folds):
        steps = self.steps(text)
        return round(sum(self.log_p("allow", folds, *s) - self.log_p("block", folds, *s) for s in steps) / len(steps), 6) if steps else None


def plain(pages):
    rows = [(i, *split(u)) for i, u in pages]
    urls = Counter((h, p, int(hashlib.md5((h + p).encode()).hexdigest()[-1], 16) % 2) for _, h, p in rows)
    labelled = [(h + p, rule_of(h, p)[1], f, n) for (h, p, f), n in urls.items()]
    model = Model([u for u in labelled if u[1]])
    cross = [(says, model.score(text, [1 - f]), n) for text, says, f, n in labelled if says and text]
    hist = defaultdict(lambda: [0, 0])
    for says, score, n in cross:
        hist[max(-BINS, min(BINS, math.floor(score / BIN)))][says == "block"] += n
    total = [sum(h[k] for h in hist.values()) for k in (0, 1)]
    losses = []
    for at in hist:
        below = [sum(h[k] for b, h in hist.items() if b < at) for k in (0, 1)]
        if all(total):
            losses.append((round(below[0] / total[0] + 1 - below[1] / total[1], 9), abs(at), at))
    threshold = min(losses)[2] * BIN if losses else 0.0
    out = []
    for i, h, p in rows:
        rule, says = rule_of(h, p)
        score = model.score(h + p, [0, 1]) or 0.0
        out.append((i, h, p, rule, says or ("allow" if h + p and score >= threshold else "block"), score))
    return out, threshold


def cases(spark):
    real = [(r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("page_id % 5 < 2").select("page_id", "url").collect()]
    odd = [None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://example.org/en/12", "http://x.example.org/es/é?q#f", "http://shop.com/de/" + "q" * 700, "http://new.net/p?x", "http://new.net/p#y", "ftp://ünï.net/ß/漢字", "x://org/", "x://net"]
    few = [(10_001 + k, u) for k, u in enumerate(odd)] + [(None, u) for u in odd] + [(20_001, "http://new.net/p")] * 6
    return {"real": real + few, "unlabelled": [(1, "http://a.net/x"), (2, None), (3, "http://b.net/")], "one label": [(k, ORG.format(k % 3, k)) for k in range(40)] + few[8:10]}


@pytest.mark.parametrize("name", ["real", "unlabelled", "one label"])
def test_urls_are_judged_as_by_the_plain_version(spark, name):
    pages = cases(spark)[name]
    want, threshold = plain(pages)
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(4)
    got = [tuple(r) for r in url_model.judge_urls(df).select("page_id", "host", "path", "rule", "verdict", "score").collect()]
    key = lambda r: (r[0] is not None, r[0], r[1], r[2])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[5] == pytest.approx(w[5], abs=3e-6)
        assert g[4] == w[4] or abs(w[5] - threshold) < 1e-5
    if name == "real":
        assert len({r[4] for r in want if r[3] is None}) == 2


def test_grams_of_long_texts_are_all_there(spark):
    text = "".join(chr(97 + k % 23) for k in range(1500)) + "é漢"
    got = spark.createDataFrame([(text,)], "t string").select(url_model.grams(F.col("t"))).first()[0]
    assert got == [context + c for context, c in Model.steps(text)]


def test_ids_play_no_part_in_a_verdict(spark):
    urls = [u for _, u in cases(spark)["real"]]
    judged = lambda ids, kind: Counter(tuple(r) for r in url_model.judge_urls(spark.createDataFrame(list(zip(ids, urls, strict=True)), f"page_id {kind}, url string")).select("host", "path", "rule", "verdict", "score").collect())
    want = judged(range(len(urls)), "long")
    assert judged((2 * i for i in range(len(urls))), "long") == want
    assert judged((None for _ in urls), "long") == want
    assert judged((f"p{i // 7}" for i in range(len(urls))), "string") == want

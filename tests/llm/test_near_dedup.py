"""Near duplicates against brute force: repeated and null ids, rows in two orders, blocks, measured recall."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import near_dedup
from test_against_libraries import words


def shingles(text, k):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def near(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def plain_components(rows, k, percent, same_ids):
    """The component (smallest row number) of each row; rows without id or words are alone."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            ids = rows[x][0] is not None and rows[y][0] is not None and bool(sets[x]) and bool(sets[y])
            if ids and (near(sets[x], sets[y], percent) or (same_ids and rows[x][0] == rows[y][0])):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return [find(x) for x in range(len(rows))], sets


BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def odd_rows():
    a, b = BASE, " ".join(f"other{i}" for i in range(30))
    rows = [(1, a), (2, a + " x"), (3, b), (3, a + " y"), (4, b + " y"), (5, b.upper()), (5, b), (5, b), (6, "lone text of its own here"), (6, a + " z"), (7, None), (7, a), (8, ""), (8, " \n"), (None, a), (None, a), (None, b)]
    r = np.random.default_rng(1)
    for i in range(9, 40):
        w = (a if r.random() < 0.5 else b).split()
        w[int(r.integers(len(w)))] = f"n{i}"
        rows.append((int(r.integers(3, 30)), " ".join(w)))
    return rows


@pytest.mark.parametrize("turned", [False, True])
def test_rows_that_repeat_ids_keep_their_links(spark, turned):
    rows = odd_rows()[:: -1 if turned else 1]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3 if turned else 5)
    for k in (2, 5):
        found, sets = plain_components(rows, k, 80, same_ids=True)
        least = {}
        for (i, _), c in zip(rows, found, strict=True):
            least[c] = min(least.get(c, i), i) if i is not None else None
        want = Counter((i, len(s), least[c] if s else i, i is None or (least[c] if s else i) == i) for (i, _), c, s in zip(rows, found, sets, strict=True))
        assert Counter(tuple(r) for r in near_dedup.near_duplicates(df, k=k).collect()) == want


@pytest.mark.parametrize("turned", [False, True])
def test_unique_documents_lose_no_text(spark, turned):
    rows = odd_rows()[:: -1 if turned else 1]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("tie"), F.lit(0).alias("_row"), F.lit(None).cast("string").alias("a.b"))
    found, sets = plain_components(rows, 5, 80, same_ids=False)
    kept = near_dedup.unique_documents(df)
    assert kept.columns == df.columns
    kept = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert all(kept[r] <= n for r, n in Counter(rows).items())
    linked = [x for x, (i, _) in enumerate(rows) if i is not None and sets[x]]
    alone = Counter(rows[x] for x in range(len(rows)) if x not in linked)
    assert all(kept[r] >= n for r, n in alone.items())
    by_group = Counter(found[x] for x in linked)
    assert sum(kept.values()) == sum(alone.values()) + len(by_group)
    for group in by_group:
        texts = {rows[x] for x in linked if found[x] == group}
        assert min(i for i, _ in texts) in {i for i, t in kept if (i, t) in texts}


def test_equal_sets_have_equal_keys_wherever_they_stand():
    s = np.array([5, 9, 11, 7, 5, 9, 11], np.uint64)
    one, two = near_dedup._set_keys(s, np.array([0, 3, 3, 4, 7]))
    assert one[0] == one[3] and two[0] == two[3] and one[1] == two[1] == 0 and one[2] not in (0, one[0])


def test_blocks_find_every_link_between_components():
    r = random.Random(4)
    sets = [np.array(sorted(r.sample(range(60), 40)), np.int64) for _ in range(90)]
    sets += [np.unique(np.append(s[:-1], 100)) for s in sets[:30]]
    regs = near_dedup._registers(near_dedup.mix(np.concatenate(sets).astype(np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 160)
    n = len(sets)
    component, left = np.arange(n) // 3, np.zeros(2 * n, bool)
    left[:n] = True
    group = {"cid": np.tile(np.arange(n), 2), "component": np.tile(component, 2), "left": left}
    a, b = near_dedup.block_links(group, np.concatenate([regs, regs]), sets + sets, 80)
    want = {(component[x], component[y]) for x in range(n) for y in range(x + 1, n) if component[x] != component[y] and 100 * len(set(sets[x]) & set(sets[y])) >= 80 * len(set(sets[x]) | set(sets[y]))}
    got = {tuple(sorted((component[x], component[y]))) for x, y in zip(a, b, strict=True)}
    assert got == {tuple(sorted(p)) for p in want} and len(a) == len(got)


def test_a_large_bucket_is_compared_in_blocks(spark):
    """Many texts that share most bands, few of them near the leader: all links of all rows are found."""
    r = np.random.default_rng(8)
    core = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = list(core)
        for at in r.choice(len(w), int(r.integers(2, 6)), replace=False):
            w[at] = f"v{i % 90}_{at}"
        rows.append((i, " ".join(w)))
    found, sets = plain_components(rows, 2, 80, same_ids=True)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == {i: c for (i, _), c in zip(rows, found, strict=True)}
    pairs = [(x, y) for x in range(0, 700, 7) for y in range(x) if near(sets[x], sets[y], 80)]
    assert len(pairs) > 50 and all(got[x] == got[y] for x, y in pairs)

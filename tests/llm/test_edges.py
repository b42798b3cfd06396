"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import chat, language, mixing, near_dedup, packing, quality, repeats, telephony, token_counts, url_model

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
PLAIN = " ".join(f"plain{i}" for i in range(90))
ROWS = [
    (1, PLAIN, "en", "a"), (1, PLAIN, "en", "a"), (2, PLAIN, None, None), (3, None, "en", "b"), (4, "", None, "b"), (5, LONG, "fr", "a"), (None, "no id " + PLAIN, "fr", None),
    (None, "no id " + PLAIN, "fr", None), (6, " \n\t", "en", "a"), (7, "one", "en", "c"), (8, "new words " + LONG[:3000], "en", None), (9, "x" * 60_000, None, "a"), (-4, "line\n" * 300, "en", "a"),
]
CLASH = ["_id", "_copy", "_gone", "_row", "_m", "row", "others", "unit_id", "unit_hash", "size", "taken", "key", "bin", "n_words", "kept", "component_id", "rep", "regs", "ids", "copy", "a.b", "doc", "sig", "failures", "held_out", "target"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH))


def operators():
    gpt, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    return {
        "media": telephony.audio_documents,
        "mixing": mixing.mix_table,
        "language": language.identify,
        "near": near_dedup.near_duplicates,
        "repeats": repeats.remove_repeats,
        "quality": quality.ledger,
        "packing": lambda d: packing.pack_documents(d, gpt),
        "counts": lambda d: token_counts.count_tokens(d, word),
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_every_row_gets_its_result(odd, name):
    got = operators()[name](odd)
    ids = got.select(F.col("row.doc_id").alias("doc_id")) if name == "repeats" else got
    if name == "packing":
        ids = ids.filter("start = 0")
    assert Counter(r["doc_id"] for r in ids.select("doc_id").collect()) == Counter(r[0] for r in ROWS)
    assert operators()[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, odd, name, stage):
    out = stage(spark, odd, "")
    if name != "packing":
        assert out.columns == odd.columns
    assert out.count() > 0 and stage(spark, odd.limit(0), "").count() == 0


def test_near_duplicates_keep_rows_without_id_and_one_of_a_group(spark, odd):
    left = corpus_pipeline.near_duplicates(spark, odd, "").collect()
    assert Counter(r["doc_id"] for r in left) == Counter(r[0] for r in ROWS if r[0] not in (1, 2)) + Counter([1])


def test_mixing_takes_repeated_rows_as_one_document(odd):
    words = lambda t: len((t or "").split())
    taken = {(r["doc_id"], r["size"]): 0 for r in mixing.mix_table(odd).collect()}
    for r in mixing.mix_table(odd).collect():
        taken[r["doc_id"], r["size"]] += r["taken"]
    mixed = Counter()
    for r in mixing.mix_documents(odd).collect():
        assert all(r[c] == "clash" for c in CLASH)
        mixed[r["doc_id"]] += words(r["text"])
    by_id = Counter()
    for (i, _), n in taken.items():
        by_id[i] += n
    assert {i: n for i, n in by_id.items() if n} == dict(mixed)


def test_urls_that_are_odd(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://example.org/es/1", "http://shop.com/de/" + "q" * 30_000, "http://x.com/fr/?a", "http://net.net/p#f", "http://net.net/p#f", "x://é/ü"]
    pages = spark.createDataFrame([(None if i == 4 else i, u) for i, u in enumerate(urls)], "page_id long, url string")
    pages = pages.select("*", *(F.lit("clash").alias(c) for c in ("host", "path", "rule", "says", "text", "fold", "gram", "uid")))
    got = url_model.judge_urls(pages).collect()
    assert len(got) == len(urls) and {r["verdict"] for r in got} <= {"allow", "block"}
    by_id = {r["page_id"]: r for r in got}
    assert by_id[None]["rule"] == "org/" and by_id[5]["verdict"] == "block" and by_id[7]["verdict"] == "allow"
    assert by_id[0]["verdict"] == by_id[3]["verdict"] == "block" and by_id[8]["verdict"] == by_id[9]["verdict"]
    assert url_model.judge_urls(pages.limit(0)).count() == 0


def test_conversations_that_are_odd(spark):
    turns = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant<|im_sep|>\n<\\|"), (1, 1, "assistant", ""), (2, None, "assistant", "é" * 5000), (None, 0, "a\nb", "t"), (None, 0, "a\nb", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").select("*", *(F.lit("clash").alias(c) for c in ("turns", "t", "formatted", "ids", "loss")))
    path = public_tokenizers.path("byte_bpe_50k.json")
    formatted = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_conversations(df, path).collect()}
    assert formatted[None] == [("a\nb", "t")] * 2 and formatted[2] == [("assistant", "é" * 5000)]
    assert Counter(formatted[1]) == Counter((r or "", t or "") for c, _, r, t in turns if c == 1)
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.format_conversations(df, path)).collect()}
    assert got == {1: (4, len(turns[2][3])), 2: (1, 5000), None: (2, 0)}
    assert chat.digests(chat.format_conversations(df.limit(0), path)).count() == 0


def test_passages_leave_no_table_in_the_catalog(spark, odd):
    assert repeats.remove_repeats(odd).count() == len(ROWS)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lexmill_")]

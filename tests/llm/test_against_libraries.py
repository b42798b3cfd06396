"""Results against plain versions: public libraries, direct loops, held-out labels, round trips."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import language, mixing, near_dedup, packing, quality, registry, repeats, telephony, token_counts

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "Hello,  World's 123 !!", "<|startoftext|>x<|endoftext|>", "é" * 70, "ΑΣ ΣΑΣ Å İstanbul 北京  x", "it's we'll I'M 'tis", "word " * 3000, "x" * 5000, "\x00\x01 \r\n\t\x0b\x0c tail ", "éä", "12345 1a2b _c_", "emoji 😀 ok\u0085y"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{i % 2}", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")


def words(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    got = {r["doc_id"]: r for r in token_counts.count_tokens(both, path).collect()}
    for r in both.collect():
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert got[r["doc_id"]]["n_tokens"] == n, repr((r["text"] or "")[:50])
        assert got[r["doc_id"]]["n_bytes"] == len((r["text"] or "").encode())
        assert got[r["doc_id"]]["over_limit"] == (n > 2048)


def test_long_words_have_the_librarys_tokens_in_near_linear_time():
    import time

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, m, r = Tokenizer.from_file(path), token_counts.RankMerger(path), np.random.default_rng(9)
    letters = "".join(map(chr, r.integers(97, 123, 200_000)))
    words_ = [letters, "x" * 9001, "ab" * 5000, "é" * 3000 + "aaa", letters[:2049], letters[:2048], "北京" * 2000, "hello" * 999, "=" * 5000 + letters[7:3000], "".join(map(chr, r.integers(0x400, 0x460, 4000)))]
    began = time.process_time()
    got = m.count_words(words_)
    assert time.process_time() - began < 6
    assert got.tolist() == [len(t.encode(w, add_special_tokens=False).ids) for w in words_]
    assert [int(m.survivors(np.frombuffer(w.encode(), np.uint8), np.array([len(w)]))[0]) for w in ("low", "lower")] == [int(m.survivors_of_one(np.frombuffer(w.encode(), np.uint8))) for w in ("low", "lower")]


def test_packing_covers_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    pieces = packing.pack_documents(both, path).toPandas()
    for doc_id, text in both.collect():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces[pieces.doc_id == doc_id].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids), repr((text or "")[:40])
        assert (own.doc_tokens == len(ids)).all()
        for start, length, crc in zip(own.start, own.length, own.ids_crc32, strict=True):
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
    for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
        total = int(seq.length.sum())
        assert total <= 1024 and (total == 1024 or total & (total - 1) == 0)


def test_audio_is_read_back_whole(docs):
    rows = {r["doc_id"]: r for r in telephony.audio_documents(docs).collect()}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = telephony.wav(payload, telephony.codec_of(payload))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_stored_pcm_is_what_a_scalar_decoder_and_filter_make(spark, docs):
    media = telephony.store_texts(docs)
    stored = {r["doc_id"]: r for r in telephony.store_pcm(telephony.resample(media)).collect()}
    features = {r["doc_id"]: r["feature"] for r in telephony.audio_documents(docs, parts=2).collect()}
    for r in media.collect():
        tag, rate, _, data = telephony.read_wav(bytes(r["media"]))
        if tag == telephony.TAGS["adpcm"]:
            raw = np.frombuffer(data, np.uint8).reshape(-1, telephony.UNIT + 4)[:3]
            plain = telephony.adpcm_blocks(raw[:, 4:], np.zeros(len(raw), np.int16), np.zeros(len(raw), np.uint8)).reshape(-1).tolist()
        else:
            plain = [int(telephony.EXPAND[tag][b]) for b in bytes(data)[:600]]
        whole = np.frombuffer(bytes(stored[r["doc_id"]]["pcm"]), "<i2")
        at = lambda k, x=plain: x[k] if 0 <= k < len(x) else 0
        for k in range(min(len(plain) - 8, 300)):
            between = sum((at(k - j) + at(k + 1 + j)) * (c >> 1) for j, c in enumerate(telephony.HALF_BAND))
            assert whole[2 * k] == plain[k] and whole[2 * k + 1] == max(-32768, min(32767, (between + (1 << 13)) >> 14))
        codec = telephony.NAMES[tag]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(whole[1:].tolist(), whole[:-1].tolist(), strict=True))
        loud = sum(map(abs, whole.tolist())) // len(whole)
        assert (stored[r["doc_id"]]["codec"], stored[r["doc_id"]]["pcm_rate"]) == (codec, 2 * rate)
        assert features[r["doc_id"]] == f"{codec}:{2 * rate}:{len(whole)}:{loud}:{crossings}:{zlib.crc32(whole.tobytes()):08x}"


def test_logarithmic_tables_have_known_values():
    mu, a = telephony.mulaw_table().astype(int), telephony.alaw_table().astype(int)
    assert (mu[0xFF], mu[0x00], mu[0x80], mu[0xF0]) == (0, -32124, 32124, 120)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)


def test_adpcm_equals_a_scalar_decoder():
    r = np.random.default_rng(3)
    rows, predictor, index = r.integers(0, 256, (5, 32), dtype=np.uint8), r.integers(-3000, 3000, 5).astype(np.int16), r.integers(0, 89, 5).astype(np.uint8)
    got = telephony.adpcm_blocks(rows, predictor, index)
    for k in range(5):
        value, at, out = int(predictor[k]), int(index[k]), [int(predictor[k])]
        for byte in rows[k].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[at])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                at = max(0, min(88, at + int(telephony.INDEX_CHANGE[code & 7])))
                out.append(value)
        assert got[k].tolist() == out


def test_doubling_keeps_a_slow_tone():
    t = np.arange(400)
    x = (8000 * np.sin(2 * np.pi * t / 40)).astype(np.int16)
    y = telephony.double_rate(x)
    want = 8000 * np.sin(2 * np.pi * np.arange(800) / 80)
    assert np.abs(y[40:-40] - want[40:-40]).max() < 60


def test_language_on_the_held_out_third(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    known = got[got.held_out & (got.lang_pred != "und")]
    assert (known.lang == known.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_without_letters_or_labels(spark, docs):
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] == "en"
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def plain_near(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = "the quick brown fox jumps over a lazy dog and runs far away into the deep dark forest at night".split()
    rows += [(1000 + i, " ".join(base[:i] + ["x" + str(i)] + base[i + 1 :])) for i in range(len(base))] + [(2000, " ".join(base)), (2001, " ".join(base).upper()), (2002, ""), (2003, None), (2004, "one"), (2005, "ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, k=k).collect()}
        assert got == plain_near(rows, k, 80)


def plain_repeats(rows):
    least = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, text in rows:
        w = words(text)
        gone = set()
        for p in range(len(w) - 49):
            if least[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def repeat_cases():
    r = np.random.default_rng(5)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    a, b, c = new(300), new(120), new(51)
    near = list(a)
    near[150] = "changed"
    rows = [
        (5, a), (9, near), (2, a[100:150]), (11, a[99:148]), (12, a[100:149] + new(3)), (20, new(40) + b + new(30)), (21, new(7) + b[:60] + new(5) + b[50:] + new(9)),
        (22, b[30:] + b[:90]), (30, ["x"] * 400), (31, ["x"] * 49), (32, ["x"] * 50 + ["y"] + ["x"] * 70), (33, ["x", "y"] * 200), (34, ["y"] + ["x", "y"] * 60), (40, c + c + c), (41, new(2) + c + c), (42, c[10:] + c[:45]),
        (50, new(30) + c[:50]), (51, [*c[1:], "z"]), (52, [*c[1:51], "q", "q"]), (60, new(20) + a[40:95] + b[10:70] + a[90:160]), (61, a[40:95] + b[10:70] + a[90:160]),
    ]
    line = new(20)
    rows += [(70 + k, new(k) + line * (3 + k % 4) + new(5)) for k in range(8)]
    return [(i, "  ".join(w)) for i, w in rows] + [(0, None), (1, ""), (3, " \n")]


def test_repeated_passages_by_brute_force(spark):
    rows = repeat_cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeats.remove_repeats(df).selectExpr("row.doc_id as doc_id", "n_words", "n_removed", "kept").collect()}
    want = plain_repeats(rows)
    assert {i: v[:2] for i, v in got.items()} == {i: v[:2] for i, v in want.items()}
    assert got == want


def test_repeated_passages_with_shared_and_null_ids(spark):
    w = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, w), (1, w), (1, w + " tail"), (2, "head " + w), (None, w), (None, w)], "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("row", F.lit(1))
    got = sorted((r["row"]["doc_id"] or -1, r["n_removed"]) for r in repeats.remove_repeats(df).collect())
    assert got == [(-1, 0), (-1, 0), (1, 0), (1, 0), (1, 0), (2, 60)]
    inner = " ".join(f"v{i}" for i in range(52))
    rows = [(4, "a b c " + inner + " d e f"), (4, "a b c " + inner + " d e f"), (7, "g h " + inner + " i j k l m n"), (7, "g h " + inner + " i j k l m n"), (8, inner)]
    twice = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["row"]["doc_id"], r["n_removed"]) for r in twice.collect()) == [(4, 0), (4, 0), (7, 52), (7, 52), (8, 52)]
    assert repeats.remove_repeats(df.limit(0)).count() == 0
    assert repeats.cut_documents(df).columns == df.columns


def test_mix_comes_to_its_targets(spark, docs):
    for df in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        mix = mixing.mix_table(df).toPandas()
        full = mix.merge(df.select("doc_id", "source").toPandas(), on="doc_id")
        assert (mix.taken <= 3 * mix["size"]).all() and (mix.taken >= 0).all()
        by = full.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
        assert (by.taken - by.target).abs().max() <= 0.5 + 1e-6 and (by.target <= 3 * by["size"] + 1e-6).all()
        assert abs(by.target.sum() - by["size"].sum()) < 1e-3
        out = mixing.mix_documents(df).toPandas()
        assert sum(len(words(t)) for t in out.text) == mix.taken.sum()
    assert mixing.mix_table(docs.limit(0)).count() == 0


def test_mix_of_repeated_rows_equals_sql(spark, docs, tmp_path):
    import duckdb

    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    own = docs.select("doc_id", "text", "source")
    hot = real.filter("doc_id < 4").crossJoin(spark.range(400).select(F.lit(1).alias("_"))).drop("_")
    df = real.unionByName(own).unionByName(own).unionByName(hot).unionByName(hot.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(hot.withColumn("source", F.lit(None).cast("string")))
    df.repartition(7).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    plain = con.execute(registry.ORACLES["op3_source_mixing"]).fetchall()
    got = [tuple(r) for r in mixing.mix_table(spark.read.parquet(str(tmp_path / "documents"))).select("doc_id", "size", "source_size", "target", "taken").collect()]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(got, key=key) == sorted(plain, key=key)
    other = mixing.mix_table(spark.read.parquet(str(tmp_path / "documents")).repartition(3)).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted((tuple(r) for r in other.collect()), key=key) == sorted(got, key=key)


def test_ledger_policies_and_ablations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    book = quality.ledger(docs).toPandas()
    counts = {(r["policy"], r["rule"]): (r["failed"], r["alone"]) for r in quality.ablations(quality.ledger(docs), tuple(quality.POLICIES)).collect()}
    assert len(counts) == len(quality.POLICIES) * len(quality.RULES)
    for policy in quality.POLICIES:
        m = quality.mask(policy)
        for k, rule in enumerate(quality.RULES):
            alone = int((book.failures & m == 1 << k).sum()) if m >> k & 1 else 0
            assert counts[policy, rule] == (int((book.failures & (1 << k) > 0).sum()), alone)


def test_ledger_measures_lines_and_words_plainly(spark):
    texts = [None, "", " \n\t", "- a\n * b\n\x0b•c\nplain ...\nx… \n...", "one one one 12 345", "a\n" * 40, "  ...  \n-", "x " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.ledger(df).collect():
        text = texts[r["doc_id"]] or ""
        lines = [x for x in text.split("\n") if words(x)]
        assert (r["n_lines"], r["n_dup_lines"], r["n_words"], r["n_distinct_words"]) == (len(lines), len(lines) - len(set(lines)), len(words(text)), len(set(words(text))))
        assert r["n_bullet_lines"] == sum(x.strip(" \t\n\x0b\x0c\r")[0] in "-*•" for x in lines)
        assert r["n_ellipsis_lines"] == sum(x.strip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines)
        assert r["n_digits"] == sum(c in "0123456789" for c in text)


def test_the_stored_ledger_is_evaluated_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = quality.accepted(docs)._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" not in plan and "split" not in plan
    book = quality.ledger(docs)
    kept = {r["doc_id"] for r in book.filter(quality.passes("v1")).collect()}
    assert {r["doc_id"] for r in quality.accepted(docs).collect()} == kept


def test_a_written_book_serves_policies_and_ablations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", F.lit("clash").alias("key_1"), F.lit("clash").alias("failures"))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    written = quality.book(docs)
    plan = written.filter(quality.passes("v2"))._jdf.queryExecution().executedPlan().toString()
    assert "split" not in plan and "xxhash64" not in plan and "text" not in written.columns
    assert sorted(map(tuple, written.drop("key_1", "key_2").collect()), key=str) == sorted(map(tuple, quality.ledger(docs).collect()), key=str)
    for policy in quality.POLICIES:
        got = quality.accepted_by(docs, written, policy)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, quality.accepted(docs, policy).collect()), key=str)
    assert quality.accepted_by(docs.limit(0), quality.book(docs.limit(0)), "v1").count() == 0


def test_pipeline_stages_equal_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        seen[name], docs = docs, spark.read.parquet(str(tmp_path / name))
    rules = seen["near_duplicates"].toPandas()
    passed = quality.ledger(seen["quality_rules"]).filter("failures & 63 = 0").toPandas()
    assert sorted(rules.doc_id) == sorted(passed.doc_id)
    groups = plain_near(list(zip(rules.doc_id, rules.text, strict=True)), 5, 80)
    single = seen["repeated_passages"].toPandas()
    assert sorted(single.doc_id) == sorted(i for i, (_, c) in groups.items() if i == c)
    left = {i: v for i, v in plain_repeats(list(zip(single.doc_id, single.text, strict=True))).items() if v[0] > v[1] or not v[0]}
    cut = seen["source_mixing"].toPandas()
    assert {i: " ".join(words(t)) for i, t in zip(cut.doc_id, cut.text, strict=True)} == {i: v[2] for i, v in left.items()}
    assert list(cut.columns) == list(single.columns) == list(rules.columns)
    mixed = seen["packing"].toPandas()
    taken = mixing.mix_table(seen["source_mixing"]).toPandas().set_index("doc_id").taken
    per_doc = defaultdict(int)
    for i, t in zip(mixed.doc_id, mixed.text, strict=True):
        per_doc[i] += len(words(t))
    assert {i: n for i, n in taken.items() if n} == dict(per_doc)
    pieces = docs.toPandas()
    assert set(pieces.doc_id) == set(mixed.doc_id)
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_registered_queries_cover_all_operators():
    import __spark_entry__

    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()

"""The loss mask is the tokens' own: no token under it leaves an assistant's text."""

import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat
from lexmill.llm.bpe_ids import ChunkEncoder, encoder, slow_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGES = ["", " ", "\n", "\n\n", ".", "?!", "<", "<|", "<\\|", "|>", "é", "😀", "　", "'s", "12", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "\t \r\n"]


def hard_turns():
    answers = [f"{a}answer{b}" for a, b in itertools.product(EDGES, EDGES)] + EDGES + [" " * 3_000_000]
    return [(k // 7, k, role, text) for k, text in enumerate(answers) for role, text in (("user", f"q{text[:50]}"), ("assistant", text))]


@pytest.fixture(scope="module")
def turns(spark):
    own = spark.createDataFrame(hard_turns(), "conv_id long, turn long, role string, text string")
    real = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select((F.col("conv_id") + 10_000).alias("conv_id"), "turn", "role", "text")
    return own.unionByName(real)


def test_no_token_under_the_mask_leaves_its_text(turns):
    formatted = chat.format_conversations(turns, PATH).toPandas()
    learned = 0
    for r in formatted.itertuples():
        raw = r.formatted.encode()
        starts, ends, loss = np.array(r.starts), np.array(r.ends), np.array(r.loss)
        assert starts[0] == 0 and ends[-1] == len(raw) and (starts[1:] == ends[:-1]).all()
        spans, at = [], 0
        for role, text in chat.parse(r.formatted):
            at += len(f"{chat.BEGIN}{chat.escape(role)}{chat.SAYS}".encode())
            size = len(chat.escape(text).encode())
            if role == "assistant" and size:
                spans.append((at, at + size))
            at += size + len(chat.END)
        inside = np.zeros(len(starts), bool)
        for a, b in spans:
            own = (starts >= a) & (ends <= b)
            assert starts[own][0] == a and ends[own][-1] == b
            inside |= own
            assert not ((starts < a) & (ends > a)).any() and not ((starts < b) & (ends > b)).any()
        assert (inside == loss).all()
        learned += int(loss.sum())
    assert learned > 80_000


def test_masked_texts_are_the_assistants(turns):
    want = {}
    for r in turns.orderBy("conv_id", "turn", "role", "text").collect():
        if r["role"] == "assistant" and r["text"]:
            want.setdefault(r["conv_id"], []).append(r["text"])
    for r in chat.format_conversations(turns, PATH).toPandas().itertuples():
        assert chat.masked_text(r.formatted.encode(), np.array(r.starts), np.array(r.ends), np.array(r.loss)) == want.get(r.conv_id, [])


def test_ids_equal_the_library(turns):
    t = slow_encoder(PATH, (chat.BEGIN, chat.SAYS, chat.END))
    for r in chat.format_conversations(turns.filter("conv_id < 10000"), PATH).toPandas().itertuples():
        assert list(r.ids) == t.encode(r.formatted, add_special_tokens=False).ids


def test_other_vocabulary_files_are_refused():
    assert encoder(PATH).size == 50_257
    with pytest.raises(ValueError, match="plain byte-level"):
        ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))

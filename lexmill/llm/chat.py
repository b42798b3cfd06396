"""Chat formatting with loss masks that are the tokens' own.

A conversation is rendered whole, encoded once, and the sorted spans of the assistant's texts are
intersected with the tokens' byte ranges by binary search.  The control strings that surround a text are
special tokens of the encoder, so both ends of every span are token edges: a token lies within one
span or within none, and the mask learns neither a header nor an end mark.

Control strings inside roles and texts are escaped reversibly: ``<|`` becomes ``<\\|``, ``<\\|`` becomes
``<\\\\|`` and so on.  What is learned is read back from the masked tokens' whole ranges.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_ids import encoder

BEGIN, SAYS, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"
FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[bytes, list[tuple[int, int]]]:
    """The conversation in template form as UTF-8, and the byte spans of the texts to learn, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role)}{SAYS}".encode(), escape(text).encode()
        at += len(head)
        if role == learned and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        out += [head, body, END.encode()]
    return b"".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def align(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens [start, end) touch one of the sorted, disjoint ``spans``: the first span that ends after a token's start decides."""
    if not len(spans) or not len(starts):
        return np.zeros(len(starts), bool)
    k = np.minimum(np.searchsorted(spans[:, 1], starts, "right"), len(spans) - 1)
    return np.maximum(starts, spans[k, 0]) < np.minimum(ends, spans[k, 1])


def masked_text(raw: bytes, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts under a mask: the whole ranges of its tokens, one text for each run of neighbours, unescaped."""
    at = np.flatnonzero(loss)
    if not len(at):
        return []
    head = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1])
    tail = np.append(head[1:], len(at)) - 1
    return [unescape(raw[a:b].decode()) for a, b in zip(starts[at[head]].tolist(), ends[at[tail]].tolist(), strict=True)]


def _turn_lists(column: pa.Array) -> tuple[np.ndarray, list, list]:
    """Bounds of the conversations, roles and texts of a column of lists of (turn, role, text)."""
    at, turns = column.offsets.to_numpy(), column.flatten()
    return at - at[0], turns.field("role").to_pylist(), turns.field("text").to_pylist()


def format_conversations(turns: DataFrame, vocab_path: str, learned: str = LEARNED, batch: int = 256) -> DataFrame:
    """conv_id, formatted, and of its token ids: byte ranges [start, end) in the UTF-8 form, and a loss flag.

    One row for each conv_id of ``turns`` (conv_id, turn, role, text); its rows stand in the order of
    turn, role and text (nulls first).  Null roles and texts are empty; an empty assistant text
    has nothing to learn.  Rows with a null conv_id form one conversation.  Repeated rows
    are repeated turns; other columns are not carried.  A conversation is one value: its rows meet in
    one task by nature, and its size is the only bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab_path, (BEGIN, SAYS, END))
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                bounds, roles, texts = _turn_lists(part.column(1))
                formatted, ids, starts, ends, loss = [], [], [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    raw, spans = render([(r or "", t or "") for r, t in zip(roles[a:b], texts[a:b], strict=True)], learned)
                    formatted.append(raw)
                    ids.append(encode.ids(raw.decode()))
                    ends.append(np.cumsum(encode.bytes_of[ids[-1]]).astype(np.int32))
                    starts.append((ends[-1] - encode.bytes_of[ids[-1]]).astype(np.int32))
                    loss.append(align(starts[-1], ends[-1], np.array(spans, np.int64).reshape(-1, 2)))
                edges = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(c) if c else [], k)) for c, k in ((ids, pa.int32()), (starts, pa.int32()), (ends, pa.int32()), (loss, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(formatted, pa.binary()).cast(pa.string()), *lists], ["conv_id", "formatted", "ids", "starts", "ends", "loss"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say when read back: turns, the text of the tokens under the loss mask, and length."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = batch.column(2).offsets.to_numpy()
            starts, ends, loss = (batch.column(k).values.to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            out: list[list] = [[], [], [], [], []]
            for text, a, b in zip(batch.column(1).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                learned = "".join(masked_text(text.encode(), starts[a:b], ends[a:b], loss[a:b]))
                for column, value in zip(out, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    return formatted.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

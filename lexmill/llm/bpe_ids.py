"""Byte-level BPE ids of whole Arrow columns, each distinct chunk of a slice encoded once.

A text may be cut in front of any single space that a visible character follows: the
vocabulary's pattern starts a new pre-token there whatever stands before.  Chunks cut that way
are deduplicated by a 64-bit hash, those not seen lately encoded in one call, and the
ids gathered back for every row.  The memory of seen chunks is bounded.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import tiktoken

from .token_counts import byte_letters
from .words import hash_ranges, ragged

# Fixed value: the pre-token pattern of a ByteLevel pre-tokenizer with use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KNOWN_CHUNKS = 600_000
# Bytes that cannot begin a white-space character (U+0085, U+00A0, U+1680, U+2000 and up, U+3000).
_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = True
_SAFE[0xC3:] = True
_SAFE[[0xE1, 0xE2, 0xE3]] = False


class ChunkEncoder:
    """Ids of a byte-level vocabulary file in the JSON format of tokenizers, with further ``specials`` after its ids.

    A file whose steps are other than plain byte-level BPE is refused.
    """

    def __init__(self, path: str, specials: tuple[str, ...] = ()) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not plain or spec.get("normalizer") or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        code = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        free = max(*model["vocab"].values(), *special.values()) + 1
        special |= {s: free + k for k, s in enumerate(specials)}
        self.path, self.specials = path, specials
        ranks = {bytes(code[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = max(*ranks.values(), *special.values(), 0) + 1
        self.bytes_of = np.zeros(self.size, np.int64)
        for piece, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes_of[i] = len(piece)
        self.forget()

    def forget(self) -> None:
        """Start with no known chunk."""
        self.known, self.at, self.size_of = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool: list[np.ndarray] = []
        self.filled = 0

    def learn(self, buf: np.ndarray, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where the chunks with these sorted, distinct hashes stand among the known ones; new ones are encoded."""
        if len(self.known) > KNOWN_CHUNKS:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            size = size[new]
            ids = np.asarray(self.encode(buf[ragged(start[new], size)].tobytes().decode("utf-8", "replace")), np.int32)
            last = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size)) + 1
            counts = np.diff(np.concatenate([[0], last]))
            self.known = np.insert(self.known, at[new], hashes[new])
            self.at = np.insert(self.at, at[new], self.filled + last - counts)
            self.size_of = np.insert(self.size_of, at[new], counts)
            self.pool.append(ids)
            self.filled += len(ids)
            at = np.searchsorted(self.known, hashes)
        return at

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, special strings in it read as their tokens."""
        try:
            return self.bpe.encode_to_numpy(text, allowed_special="all").astype(np.int32)
        except ValueError:
            return np.asarray(self._slowly(text), np.int32)

    def encode(self, text: str) -> list[int]:
        try:
            return self.bpe.encode(text, allowed_special="all")
        except ValueError:
            return self._slowly(text)

    def _slowly(self, text: str) -> list[int]:
        """For a run of white space that is too long for the pattern's matcher."""
        return slow_encoder(self.path, self.specials).encode(text, add_special_tokens=False).ids

    def rows(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, ``end_id`` after each, and the n + 1 bounds of the rows."""
        n, rows = len(offsets) - 1, offsets - offsets[0]
        buf = np.zeros(rows[-1] + 8, np.uint8)
        buf[:-8] = data[offsets[0] : offsets[-1]]
        cut = (buf[:-8] == 0x20) & _SAFE[buf[1:-7]]
        full = rows[:-1] < rows[1:]
        cut[rows[:-1][full]] = False
        cut[rows[1:][full] - 1] = False
        start = np.flatnonzero(cut)
        first = np.searchsorted(start, rows)
        owner = np.repeat(np.arange(n), np.diff(first))
        stop = np.minimum(np.append(start[1:], rows[-1]), rows[owner + 1]) if len(start) else start
        hashes, at, back = np.unique(hash_ranges(buf, start, stop), return_index=True, return_inverse=True)
        where = self.learn(buf, hashes, start[at], (stop - start)[at])[back]
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        # What stands before a row's first cut has no leading space to rely on: row by row.
        raw, heads = buf.tobytes(), []
        for r, a, b in zip(range(n), rows[:-1].tolist(), np.append(start, rows[-1])[first[:-1]].tolist(), strict=True):
            heads.append(self.encode(raw[a : min(b, int(rows[r + 1]))].decode("utf-8", "replace")))
        head_size = np.fromiter(map(len, heads), np.int64, n)
        pool = np.concatenate([*self.pool, np.fromiter((i for h in heads for i in h), np.int32, int(head_size.sum())), np.array([end_id], np.int32)])
        # One item each: the head, the chunks and the end of a row.
        chunks = np.diff(first)
        base = np.concatenate([[0], np.cumsum(chunks + 2)])
        item_at, item_size = np.empty(base[-1], np.int64), np.empty(base[-1], np.int64)
        item_at[base[:-1]], item_size[base[:-1]] = self.filled + np.cumsum(head_size) - head_size, head_size
        inside = ragged(base[:-1] + 1, chunks)
        item_at[inside], item_size[inside] = self.at[where], self.size_of[where]
        item_at[base[1:] - 1], item_size[base[1:] - 1] = len(pool) - 1, 1
        ends = np.concatenate([[0], np.cumsum(item_size)])
        return pool[ragged(item_at, item_size)], ends[base]


@lru_cache(maxsize=4)
def encoder(path: str, specials: tuple[str, ...] = ()) -> ChunkEncoder:
    """One per worker process."""
    return ChunkEncoder(path, specials)


@lru_cache(maxsize=4)
def slow_encoder(path: str, specials: tuple[str, ...] = ()):
    """The library of the vocabulary file itself, for the texts that the fast one cannot take."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens(list(specials))
    return t

"""Token counts of a BPE with word ends, by rank-synchronous array merging.

Pre-tokens that are new to a batch are held as ragged numpy arrays of symbols.  Every round
looks up the rank of each adjacent pair, takes the lowest rank of each sequence, and merges
all its occurrences (left to right, not overlapping) in all sequences at once.  What is left
when no sequence has a known pair is the number of tokens.  Pre-tokens of more than LONG bytes, which would
keep the rounds of all others going, are merged rank by rank with positions kept by rank, so that a round
touches only what it merges.

Null texts count as empty: no bytes, no tokens.  Special strings inside a text count as one
token each, as the library reads them by default.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, hash_ranges, ragged, slices, sums, utf8

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
CACHE_WORDS = 400_000
LONG = 2048

# Classes of bytes in plain words: 0 other signs, 1 letters, 2 digits, 9 not plain.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[0x21:0x7F] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x27, 0x3C]] = 9  # an apostrophe may start a contraction, < a special string
_CLASS[0xC3] = 1
_CLASS[0x80:0xC0] = 1  # after 0xC3: the letters from U+00C0 to U+00FF


def byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class RankMerger:
    """Counts tokens of pre-tokens under the merges of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.width = np.int64(len(vocab) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.known: dict[int, int] = {}

    def pretokens(self, text: str) -> list[bytes]:
        """The pre-tokens of a stretch without special strings."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [p.encode() for p in SPLIT.findall(text)]

    def ranks(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (k, k + 1) for k in ``at``; the number of merges where there is none."""
        rank = np.full(len(at), len(self.keys), np.int64)
        pair = np.flatnonzero(at < len(symbol) - 1)
        pair = pair[owner[at[pair]] == owner[at[pair] + 1]]
        key = symbol[at[pair]] * self.width + symbol[at[pair] + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank[pair] = np.where(self.keys[found] == key, self.rank[found], len(self.keys))
        return rank

    def survivors(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of symbols that survive the merges of each piece; ``flat`` has their bytes, none is empty."""
        if len(size) and size.max() > LONG:
            ends, long = np.cumsum(size), size > LONG
            count = np.zeros(len(size), np.int64)
            count[long] = [self.survivors_of_one(flat[b - n : b]) for b, n in zip(ends[long].tolist(), size[long].tolist(), strict=True)]
            count[~long] = self.survivors(flat[np.repeat(~long, size)], size[~long])
            return count
        owner = np.repeat(np.arange(len(size)), size)
        symbol = self.inner[flat]
        ends = np.cumsum(size) - 1
        symbol[ends] = self.final[flat[ends]]
        count, nowhere = size.copy(), np.int64(len(self.keys))
        rank = self.ranks(symbol, owner, np.arange(len(symbol)))
        while len(symbol) > 1:
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(owner))))
            where = np.flatnonzero((rank < nowhere) & (rank == lowest))
            if not len(where):
                break
            run = np.concatenate([[0], np.cumsum(np.diff(where) != 1)])
            head = where[np.searchsorted(run, run)]
            where = where[(where - head) % 2 == 0]  # of a run of overlapping pairs, every other one
            symbol[where] = self.made[rank[where]]
            np.subtract.at(count, owner[where], 1)
            stay = lowest < nowhere
            stay[where + 1] = False
            at = (np.cumsum(stay) - 1)[where]
            symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near] = self.ranks(symbol, owner, near)
        return count

    def survivors_of_one(self, flat: np.ndarray) -> int:
        """The same for one long piece: symbols are linked to their neighbours, pairs are found through their rank."""
        n, nowhere = len(flat), len(self.keys)
        symbol = np.append(self.inner[flat], -1)
        symbol[n - 1] = self.final[flat[-1]]
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n + 1, bool)
        alive[n] = False
        rank, places, queue = np.full(n + 1, nowhere, np.int64), {}, []

        def look_up(at: np.ndarray) -> None:
            at = at[(at >= 0) & (after[at] < n)]
            key = symbol[at] * self.width + symbol[after[at]]
            found = np.minimum(np.searchsorted(self.keys, key), nowhere - 1)
            rank[at] = np.where(self.keys[found] == key, self.rank[found], nowhere)
            at = at[rank[at] < nowhere]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            values, first = np.unique(rank[at], return_index=True)
            for r, part in zip(values.tolist(), np.split(at, first[1:]), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(part)

        look_up(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            run = np.concatenate([[0], np.cumsum(after[at[:-1]] != at[1:])])
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]  # of a run of overlapping pairs, every other one
            gone = after[at]
            symbol[at], alive[gone], rank[gone] = self.made[r], False, nowhere
            after[at] = after[gone]
            before[after[at]] = at
            rank[at] = nowhere
            look_up(np.unique(np.concatenate([at, before[at]])))
        return int(alive.sum())

    def count_ranges(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Tokens of each word buf[start:stop].

        Plain words (ASCII and the letters U+00C0 to U+00FF) are cut into pre-tokens as
        arrays; the others go through the pattern one by one.
        """
        size = stop - start
        flat = buf[ragged(start, size)]
        owner = np.repeat(np.arange(len(size)), size)
        kind = _CLASS[flat]
        before = np.concatenate([[0], flat[:-1]])
        tail = (flat >= 0x80) & (flat < 0xC0)
        odd = (kind == 9) | (tail & ((before != 0xC3) | (flat == 0x97) | (flat == 0xB7)))
        plain = np.ones(len(size), bool)
        plain[owner[odd]] = False
        counts = np.zeros(len(size), np.int64)
        other = np.flatnonzero(~plain)
        if len(other):
            raw = buf.tobytes()
            counts[other] = self.count_words([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[other].tolist(), stop[other].tolist(), strict=True)])
        use = plain[owner]
        flat, owner, kind, tail = flat[use], owner[use], kind[use], tail[use]
        if len(flat):
            upper = ((flat >= 0x41) & (flat <= 0x5A)) | (tail & (flat <= 0x9E))
            flat = flat + (upper * np.uint8(0x20))
            cut = np.concatenate([[True], (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)])
            at = np.flatnonzero(cut)
            np.add.at(counts, owner[at], self.survivors(flat, np.diff(np.append(at, len(flat)))))
        return counts

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, whatever it holds."""
        pieces: list[bytes] = []
        owner: list[int] = []
        extra = np.zeros(len(words), np.int64)
        for k, word in enumerate(words):
            parts = [word]
            if self.special is not None and "<" in word:
                extra[k] = len(self.special.findall(word))
                parts = self.special.split(word)
            for part in parts:
                for piece in self.pretokens(part):
                    pieces.append(piece)
                    owner.append(k)
        if pieces:
            size = np.fromiter(map(len, pieces), np.int64, len(pieces))
            np.add.at(extra, np.array(owner), self.survivors(np.frombuffer(b"".join(pieces), np.uint8), size))
        return extra

    def count_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every row; each distinct word of the slice is merged once."""
        w = Words(data, offsets)
        hashes, at, back = np.unique(hash_ranges(w.buf, w.start, w.stop), return_index=True, return_inverse=True)
        counts = np.fromiter((self.known.get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(counts < 0)
        if len(new):
            counts[new] = self.count_ranges(w.buf, w.start[at[new]], w.stop[at[new]])
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
            self.known.update(zip(hashes[new].tolist()[:CACHE_WORDS], counts[new].tolist(), strict=False))
        return sums(counts[back], w.first)


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    """One per worker process."""
    return RankMerger(path)


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row.

    One row per input row, repeated rows included; null ids stay null; other columns are
    not carried, so their names cannot clash.  An empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocab_path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            for i, j in slices(offsets):
                tokens[i:j] = m.count_rows(data, offsets[i : j + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

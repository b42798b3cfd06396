"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes are embedded; filters of several widths slide over a fixed-length window; each filter's
maximum, rectified, feeds a softmax over the languages.  For prediction, embedding and filters fold into
tables indexed by pairs of bytes, so a window batch costs one table row per byte.

Every byte of a text lies in exactly one window; a text's probabilities are the mean over its
windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices, utf8

WINDOW = 128
SAMPLE = 4000  # labelled documents that training reads, at most
EXCERPTS = 3  # windows of each
BIN_BITS = 12
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
_LETTER = regex.compile(r"\p{L}")
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def labelled_sample(docs: DataFrame, limit: int = SAMPLE, excerpts: int = EXCERPTS, window: int = WINDOW) -> list[tuple[str, list[str]]]:
    """At most ``limit`` (lang, excerpts) of labelled documents outside the held-out third: those with the smallest hashes of id and text.

    The hashes are counted in BINS ranges first, and only the ranges that hold the first ``limit`` documents are
    read on, so the sample is never short while there are labels.  Rows that repeat id, text and language
    count once.  A document holds ``excerpts`` stretches of ``window`` characters at hashed places, so what comes to
    the driver is bounded.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text"))
    rows = rows.select("lang", "text", order.alias("_o"), F.shiftright(order, 64 - BIN_BITS).alias("_bin"))
    counts = rows.groupBy("_bin").agg(F.approx_count_distinct("_o", 0.1).alias("n"))  # of repeated rows one counts
    last, total = 0, 0
    for last, n in sorted((r["_bin"], r["n"]) for r in counts.collect()):  # 2 ** BIN_BITS rows at most
        total += n
        if total >= 1.5 * limit:
            break
    at = F.transform(F.sequence(F.lit(1), F.lit(excerpts)), lambda k: F.substring("text", (F.pmod(F.xxhash64(F.col("_o"), k), F.greatest(F.lit(1), F.length("text") - window // 2).cast("long")) + 1).cast("int"), F.lit(window)))
    picked = rows.filter(F.col("_bin") <= last).select("_o", "lang", at.alias("excerpts")).groupBy("_o", "lang").agg(F.min("excerpts").alias("excerpts"))
    return [(r["lang"], r["excerpts"]) for r in picked.orderBy("_o", "lang").limit(limit).collect()]


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


class ByteNet:
    """Embedding, filters and output layer; ``fit`` trains them, ``probabilities`` applies them."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.langs = langs
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = {w: r.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteNet:
        """Adam on the cross-entropy of (n, WINDOW) byte windows and their language numbers."""
        r = np.random.default_rng(seed)
        params = [self.embed, *self.filters.values(), self.bias, self.out, self.out_bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs if len(windows) else 0):
            order = r.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                grads = self._gradients(windows[pick], target[pick])
                t += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            rate *= 0.8
        self.tables = None
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, length = x.shape
        e = self.embed[x]
        peaks, places = [], []
        for w, f in self.filters.items():
            conv = sum(e[:, j : length - w + 1 + j] @ f[j] for j in range(w))
            places.append(conv.argmax(axis=1))
            peaks.append(np.take_along_axis(conv, places[-1][:, None, :], 1)[:, 0])
        z = np.concatenate(peaks, axis=1) + self.bias
        h = np.maximum(z, 0)
        p = _softmax(h @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        p /= n
        dz = (p @ self.out.T) * (z > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        rows = np.arange(n)[:, None]
        for k, (w, f) in enumerate(self.filters.items()):
            g, df = dz[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(f)
            for j in range(w):
                seen = x[rows, places[k] + j]
                df[j] = np.einsum("nfe,nf->ef", self.embed[seen], g)
                np.add.at(d_embed, seen, g[:, :, None] * f[j].T[None])
            d_filters.append(df)
        return [d_embed, *d_filters, dz.sum(axis=0), h.T @ p, p.sum(axis=0)]

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows by pair of bytes (the two-byte parts of all filters) and by one byte (the third of width 3)."""
        if self.tables is None:
            part = {(w, j): self.embed @ f[j] for w, f in self.filters.items() for j in range(w)}
            pair = lambda w, j: (part[w, j][:, None, :] + part[w, j + 1][None, :, :]).reshape(65536, FILTERS)
            self.tables = np.ascontiguousarray(np.concatenate([pair(2, 0), pair(3, 0), pair(4, 0), pair(4, 2)], axis=1)), np.ascontiguousarray(part[3, 2])
        return self.tables

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, languages) probabilities of (n, WINDOW) byte windows."""
        pairs, singles = self.fold()
        out = np.empty((len(x), len(self.langs)), np.float32)
        f = FILTERS
        for at in range(0, len(x), 64):  # what a batch touches stays in the processor's cache
            b = x[at : at + 64]
            two = pairs[(b[:, :-1].astype(np.int32) << 8) | b[:, 1:]]
            peaks = [
                two[:, :, :f].max(axis=1),
                (two[:, :-1, f : 2 * f] + singles[b[:, 2:]]).max(axis=1),
                (two[:, :-2, 2 * f : 3 * f] + two[:, 2:, 3 * f :]).max(axis=1),
            ]
            h = np.maximum(np.concatenate(peaks, axis=1) + self.bias, 0)
            out[at : at + 64] = _softmax(h @ self.out + self.out_bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def as_window(raw: bytes, window: int = WINDOW) -> np.ndarray:
    return np.frombuffer(raw[:window].ljust(window, b"\0"), np.uint8)


def train(sample: list[tuple[str, list[str]]]) -> ByteNet:
    """A network for the languages of a sample; every fourth excerpt is cut short, so that short texts are known too."""
    langs = sorted({lang for lang, _ in sample})
    number = {lang: k for k, lang in enumerate(langs)}
    x, y = [], []
    for lang, excerpts in sample:
        for k, text in enumerate(e for e in excerpts if _LETTER.search(e)):
            raw = text.encode()
            x.append(as_window(raw[: 8 + len(x) % 48] if len(x) % 4 == 3 else raw))
            y.append(number[lang])
    return ByteNet(langs).fit(np.array(x, np.uint8).reshape(-1, WINDOW), np.array(y, np.int64))


def predict_rows(net: ByteNet, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number and mean probability of every row."""
    rows = offsets - offsets[0]
    size = np.diff(rows)
    n = np.maximum(1, -(-size // WINDOW))
    first = np.concatenate([[0], np.cumsum(n)])
    flat = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    shift = np.repeat(first[:-1] * WINDOW - rows[:-1], size)
    flat[np.arange(int(rows[-1])) + shift] = data[offsets[0] : offsets[-1]]
    p = net.probabilities(flat.reshape(-1, WINDOW)).astype(np.float64)
    owner = np.repeat(np.arange(len(n)), n)
    weight = np.minimum(WINDOW, size[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW).clip(1)
    mean = np.add.reduceat(p * weight[:, None], first[:-1], axis=0) / np.add.reduceat(weight, first[:-1])[:, None]
    best = mean.argmax(axis=1)
    return best, mean[np.arange(len(best)), best]


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    found = np.concatenate([[0], np.cumsum(_ASCII[data[offsets[0] : offsets[-1]]])])
    has = found[offsets[1:] - offsets[0]] > found[offsets[:-1] - offsets[0]]
    for k in np.flatnonzero(~has):
        has[k] = bool(_LETTER.search(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return has


def identify(docs: DataFrame, limit: int = SAMPLE, excerpts: int = EXCERPTS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    The network learns from ``excerpts`` stretches of each of at most ``limit`` labelled documents outside the
    held-out third; null and repeated ids are sampled like others.  A null text, or one without letters, is ``und``
    with score 0, and so is every text when nothing is labelled outside the held-out third.  Repeated rows are
    judged alike; other columns are not carried.
    """
    net = train(labelled_sample(docs, limit, excerpts))
    model = docs.sparkSession.sparkContext.broadcast(net)  # 256 * EMBED and WIDTHS * FILTERS numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for i, j in slices(offsets, 1 << 20):
                best, p = predict_rows(m, data, offsets[i : j + 1]) if m.langs else (None, None)
                known = has_letters(data, offsets[i : j + 1]) & bool(m.langs)
                if known.any():
                    lang[i:j][known], score[i:j][known] = np.array(m.langs, object)[best[known]], p[known]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

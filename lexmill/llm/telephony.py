"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded to resampled PCM.

The logarithmic codecs expand through 256-entry tables built from their rules.  ADPCM blocks
are decoded side by side: step k of the recurrence is one set of numpy operations over
all blocks of a slice of rows.  PCM is resampled from 8 to 16 kHz by a half-band filter in
integers, so results are the same everywhere.

Containers and PCM are both written to the shared folder and read back.  PCM has four to eight
times the bytes of its codes, so where only its digests are wanted it is written, read and removed in PARTS
parts of the stored files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, mark, materialize, new_path
from .words import slices, utf8

RATE = 8000
SLICE = 512 << 10  # bytes of containers that are decoded at once
PARTS = 8  # in which stored PCM is worked through where it is not the result
UNIT = 192  # payload bytes come in multiples of this; also the nibble bytes of an ADPCM block
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}
NAMES = {tag: name for name, tag in TAGS.items()}
#: Half-band filter for the samples between two samples, outward from the middle; twice their sum is 32768.
HALF_BAND = (20118, -4830, 1362, -266)

# Fixed values of IMA ADPCM: step sizes, and the change of the step index for a nibble's low three bits.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit samples of the mu-law codes: inverted bits; sign, exponent, mantissa; bias 132."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples of the A-law codes: even bits inverted; sign, exponent, mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, size = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent > 0, (size + 0x100) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


EXPAND = {TAGS["mulaw"]: mulaw_table(), TAGS["alaw"]: alaw_table()}


def adpcm_blocks(nibbles: np.ndarray, predictor: np.ndarray, index: np.ndarray) -> np.ndarray:
    """(blocks, 1 + 2 * width) samples of IMA ADPCM blocks with (blocks, width) nibble bytes."""
    codes = np.empty((2 * nibbles.shape[1], len(nibbles)), np.uint8)
    codes[0::2], codes[1::2] = (nibbles & 0x0F).T, (nibbles >> 4).T
    out = np.empty((len(codes) + 1, len(nibbles)), np.int16)
    # A nibble's part of the step, for every step index: a table of 89 * 16 entries from the rule.
    n, step = np.arange(16)[None, :], STEPS[:, None]
    change = (step >> 3) + np.where(n & 4, step, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 1, step >> 2, 0)
    delta = np.where(n & 8, -change, change).astype(np.int32).ravel()
    move = INDEX_CHANGE[np.arange(16) & 7]
    value, index = predictor.astype(np.int32), np.clip(index.astype(np.int32), 0, len(STEPS) - 1)
    out[0] = value
    for k, code in enumerate(codes, 1):
        value = np.clip(value + delta[(index << 4) + code], -32768, 32767)
        index = np.clip(index + move[code], 0, len(STEPS) - 1)
        out[k] = value
    return out.T


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A RIFF/WAVE container with ``payload`` as its samples (for ADPCM: as nibbles of blocks of UNIT bytes, from silence)."""
    tag = TAGS[codec]
    if codec == "adpcm":
        rows = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        rows[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, per_block = rows.tobytes(), 1 + 2 * UNIT
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * (UNIT + 4) // per_block, UNIT + 4, 4, 2, per_block)
        samples = len(rows) * per_block
    else:
        data, samples = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    body = b"WAVE" + b"".join(struct.pack("<4sI", name, len(part)) + part + b"\0" * (len(part) & 1) for name, part in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """Format tag, rate, block size and the data chunk of a container; ValueError if it is none."""
    view = memoryview(media)
    if len(view) < 12 or bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a RIFF/WAVE container")
    at, fmt = 12, None
    while at + 8 <= len(view):
        name, size = struct.unpack_from("<4sI", view, at)
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIH", view, at + 8)
        elif name == b"data" and fmt is not None:
            return fmt[0], fmt[2], fmt[4], view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples in the container")


def payload_of(media: bytes) -> bytes:
    """The bytes that ``wav`` stored."""
    tag, _, block, data = read_wav(media)
    if tag != TAGS["adpcm"]:
        return bytes(data)
    return np.frombuffer(data, np.uint8).reshape(-1, block)[:, 4:].tobytes()


def decode_media(media: list[bytes]) -> list[np.ndarray]:
    """The 16-bit samples of each container; the ADPCM blocks of all of them are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(media)
    blocks: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, item in enumerate(media):
        tag, _, block, data = read_wav(item)
        raw = np.frombuffer(data, np.uint8)
        if tag == TAGS["adpcm"]:
            blocks.setdefault(block, []).append((k, raw[: len(raw) // block * block].reshape(-1, block)))
        elif tag in EXPAND:
            out[k] = EXPAND[tag][raw]
        else:
            raise ValueError(f"format {tag} is not telephony audio")
    for parts in blocks.values():
        every = np.concatenate([rows for _, rows in parts])
        samples = adpcm_blocks(every[:, 4:], every[:, :2].copy().view("<i2")[:, 0], every[:, 2])
        at = 0
        for k, rows in parts:
            out[k] = samples[at : at + len(rows)].reshape(-1)
            at += len(rows)
    return out


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """Twice the sample rate: every sample, and between two of them the half-band filter's value; silence outside."""
    taps = len(HALF_BAND)
    x = np.zeros(len(pcm) + 2 * taps, np.int32)
    x[taps : taps + len(pcm)] = pcm
    n = len(pcm)
    between = np.zeros(n, np.int32)
    for k, c in enumerate(HALF_BAND):
        # 16-bit inputs and these taps keep the sum within 32 bits.
        between += (x[taps - k : taps - k + n] + x[taps + 1 + k : taps + 1 + k + n]) * (c >> 1)
    out = np.empty(2 * n, np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((between + (1 << 13)) >> 14, -32768, 32767)
    return out


def codec_of(payload: bytes) -> str:
    """One of the three codecs, by the payload alone."""
    return ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: every text's UTF-8 bytes, padded by spaces to a positive multiple of UNIT, as a container.

    Null texts count as empty.  Repeated rows are stored each on its own.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                media = []
                for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True):
                    payload = data[a:b].tobytes()
                    payload += b" " * ((-len(payload)) % UNIT if payload else UNIT)
                    media.append(wav(payload, codec_of(payload)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(store, "doc_id long, n_bytes long, media binary")


def _media_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    yield from slices(np.concatenate([[0], np.cumsum(sizes)]), limit)


def _resampled(batches: Iterator[pa.RecordBatch], media_col: str = "media") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(media_col)
        names = [n for n in batch.schema.names if n != media_col]
        for i, j in _media_slices(batch.column(at)):
            part = batch.slice(i, j - i)
            items = part.column(at).to_pylist()
            pcm = iter(decode_media([m for m in items if m is not None]))
            stored = [None if m is None else double_rate(next(pcm)).astype("<i2").tobytes() for m in items]
            heads = [(None, None) if m is None else read_wav(m)[:2] for m in items]
            own = [pa.array(stored, pa.binary()), pa.array([None if r is None else 2 * r for _, r in heads], pa.int32()), pa.array([NAMES.get(t) for t, _ in heads], pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *own], [*names, "pcm", "pcm_rate", "codec"])


def _with_pcm(fields: list[tuple[str, str]]) -> str:
    return "".join(f"`{name}` {kind}, " for name, kind in fields if name != "media") + "pcm binary, pcm_rate int, codec string"


def resample(media: DataFrame) -> DataFrame:
    """All columns of ``media`` but the container (column media), and pcm (16-bit little-endian), pcm_rate and codec of it; null for null media."""
    return media.mapInArrow(_resampled, _with_pcm([(f.name, f.dataType.simpleString()) for f in media.schema]))


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media binary"
DIGEST = MEDIA.removesuffix("media binary") + "feature string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in _media_slices(batch.column(2)):
            part, rows = batch.slice(i, j - i), []
            for media in part.column(2).to_pylist():
                payload = payload_of(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            own = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *own, part.column(2)], [f.split()[0] for f in MEDIA.split(", ")])


def media_digests(stored: DataFrame) -> DataFrame:
    """Digests of the payload and of the container of a stored table (doc_id, n_bytes, media), and the container's PCM; one worker a task does both."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: _resampled(_digested(batches)), _with_pcm([tuple(f.split()) for f in MEDIA.split(", ")]))


def pcm_features(stored: DataFrame) -> DataFrame:
    """A stored table (pcm, pcm_rate, codec and others) with feature in their place: codec, rate, samples, mean absolute value, zero crossings and checksum of the PCM."""
    names = [c for c in stored.columns if c not in ("pcm", "pcm_rate", "codec")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = []
            for raw, rate, codec in zip(*(batch.column(c) for c in ("pcm", "pcm_rate", "codec")), strict=True):
                if not raw.is_valid:
                    features.append(None)
                    continue
                pcm = np.frombuffer(raw.as_buffer(), "<i2")
                loud = int(np.abs(pcm.astype(np.int32)).sum(dtype=np.int64)) // max(1, len(pcm))
                crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
                features.append(f"{codec}:{rate}:{len(pcm)}:{loud}:{crossings}:{zlib.crc32(raw.as_buffer()):08x}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(features, pa.string())], [*names, "feature"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in stored.schema if f.name in names)
    return stored.mapInArrow(run, f"{fields}feature string")


def store_pcm(pcm: DataFrame) -> DataFrame:
    """A table with PCM, written to the shared folder in small row groups and read back."""
    return materialize(pcm, "pcm", codec="zstd", **{"parquet.block.size": 16 << 20})


def audio_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """Store every text as audio, read the stored bytes back, decode, resample and store the PCM, read it back and digest both.

    One row per input row: null and empty texts are one unit of spaces, equal texts have equal
    values, a null id stays null, other columns are not carried; an empty table gives none.
    """
    spark, begun = docs.sparkSession, mark()
    media = materialize(store_texts(docs, id_col, text_col), "media", codec="zstd")
    out, files = new_path(spark, "audio-digests"), sorted(media.inputFiles())
    pcm_features(media_digests(media.limit(0))).write.parquet(out)
    for k in range(min(parts, len(files))):
        since = mark()
        part = spark.read.schema(media.schema).parquet(*files[k::parts])
        pcm_features(store_pcm(media_digests(part))).write.mode("append").parquet(out)
        discard(spark, since)
    discard(spark, begun, keep=("audio-digests",))
    return spark.read.schema(DIGEST).parquet(out)

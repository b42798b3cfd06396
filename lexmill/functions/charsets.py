"""The encoding of a text file: every reading that is valid is scored by how usual its characters are, and the best one is taken.

A wrong reading of Chinese text is often valid, but made of rare characters: GB 2312 and Big5 both keep their usual
characters in a first level of their own, so the share of first-level and of very frequent characters tells the readings
apart.  Whole files are scored, by table lookup over their code points.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# The most frequent characters of Chinese texts, simplified and traditional, and the first levels' lead bytes.
FREQUENT = "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情"
FREQUENT_TRADITIONAL = "這個們來為國說時會對過發後裡種經麼學現當沒動還進樣開從實軍無與長機關點業將兩間問並應戰向頭體見產兒東聲員論處義幾認條氣題"
GB_LEADS, BIG5_LEADS = range(0xB0, 0xD8), range(0xA4, 0xC7)
PUNCTUATION = "　、。，．；：？！…—“”‘’（）《》〈〉「」『』【】〔〕·～"
FREQUENT_SCORE, FIRST, PLAIN, OTHER, ODD = 3, 1, 1, -1, -4
READINGS = ("gb18030", "big5", "utf-16-le", "utf-16-be")


def _first_level(codec: str, leads: range) -> set[str]:
    out = set()
    for lead in leads:
        for trail in range(0x40, 0xFF):
            try:
                out.add(bytes((lead, trail)).decode(codec))
            except UnicodeDecodeError:
                continue
    return {c for c in out if len(c) == 1 and "一" <= c <= "鿿"}


@cache
def _weights(codec: str) -> np.ndarray:
    """The score of every code point of the first plane in a reading."""
    simple, traditional = _first_level("gb2312", GB_LEADS), _first_level("big5", BIG5_LEADS)
    usual = simple if codec == "gb18030" else traditional if codec == "big5" else simple | traditional
    score = np.full(0x10000, ODD, np.int8)
    score[0x20:0x7F] = score[[9, 10, 13]] = 0
    score[0xA0:0x370] = score[0x3040:0x3100] = OTHER
    score[0x3400:0xA000] = OTHER
    score[[ord(c) for c in PUNCTUATION]] = PLAIN
    score[0xFF01:0xFF5F] = PLAIN
    score[[ord(c) for c in usual]] = FIRST
    score[[ord(c) for c in FREQUENT + FREQUENT_TRADITIONAL if c in usual]] = FREQUENT_SCORE
    score.flags.writeable = False
    return score


def usualness(text: str, codec: str) -> float:
    """The mean score of a reading's characters; ASCII counts where it speaks for a reading: in Unicode, against other widths."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    points = points[points != 0xFEFF]
    wide = codec.startswith("utf")
    if not wide:
        points = points[(points >= 0x80) | (points < 9)]
    if not len(points):
        return 0.0
    score = np.where(points < 0x10000, _weights(codec)[np.minimum(points, 0xFFFF)], OTHER).astype(np.int64)
    if wide:
        score = np.where((points >= 0x20) & (points < 0x7F), PLAIN, score)
    return float(score.mean())


def _read(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


def detect(raw: bytes) -> tuple[str | None, str]:
    """The encoding and the text of a file's bytes; no encoding, and replacement characters, where nothing reads them.

    A byte order mark decides and is dropped.  Valid UTF-8 without NUL bytes or replacement characters is UTF-8, as are no bytes.
    Of the other readings the one with the most usual characters is taken, in the order of READINGS at a tie; what plain
    GBK can say is called ``gbk``.
    """
    if raw.startswith(b"\xef\xbb\xbf"):
        text = _read(raw[3:], "utf-8")
        if text is not None:
            return "utf-8", text
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16", raw.decode("utf-16", "replace")
    plain = _read(raw, "utf-8")
    if plain is not None and "\0" not in plain and "�" not in plain:
        return "utf-8", plain
    found = [(codec, text) for codec in READINGS for text in (_read(raw, codec),) if text is not None and "�" not in text]
    if plain is not None and "�" not in plain:
        found.insert(0, ("utf-8", plain))
    if not found:
        return None, raw.decode("utf-8", "replace")
    # Text with NULs is UTF-8 only where two bytes a character read worse than one.
    codec, text = max(found, key=lambda f: usualness(f[1], f[0]))
    return ("gbk" if codec == "gb18030" and _read(raw, "gbk") is not None else codec), text

"""Encodings are told apart from 200 bytes up, wherever a file is cut."""

import pytest

from lexmill.functions.charsets import detect
from lexmill.sources import text_files

SIMPLE = """道可道，非常道。名可名，非常名。无名天地之始；有名万物之母。故常无欲，以观其妙；常有欲，以观其徼。此两者，同出而异名，同谓之玄。玄之又玄，众妙之门。
天下皆知美之为美，斯恶已。皆知善之为善，斯不善已。有无相生，难易相成，长短相形，高下相盈，音声相和，前后相随。是以圣人处无为之事，行不言之教。
有一天早上，他从家里出来，走到河边的小桥上，看见一个孩子坐在那里哭。他问孩子为什么哭，孩子说找不到回家的路了。于是他拉着孩子的手，一起往村子里走去。
太阳慢慢升起来，照在田野和树林上，远处传来火车的声音。"""
TRADITIONAL = """道可道，非常道。名可名，非常名。無名天地之始；有名萬物之母。故常無欲，以觀其妙；常有欲，以觀其徼。此兩者，同出而異名，同謂之玄。玄之又玄，眾妙之門。
天下皆知美之為美，斯惡已。皆知善之為善，斯不善已。有無相生，難易相成，長短相形，高下相盈，音聲相和，前後相隨。是以聖人處無為之事，行不言之教。
有一天早上，他從家裡出來，走到河邊的小橋上，看見一個孩子坐在那裡哭。他問孩子為什麼哭，孩子說找不到回家的路了。於是他拉著孩子的手，一起往村子裡走去。
太陽慢慢升起來，照在田野和樹林上，遠處傳來火車的聲音。"""
ENGLISH = "It was late in the evening when they came to the bridge; nobody had said a word for an hour.\n" * 3


def slices(text, codec, size=200):
    """Pieces of at least ``size`` bytes from every place of a text."""
    for i in range(len(text)):
        piece = text[i : i + size]
        while piece and len(piece[:-1].encode(codec)) >= size:
            piece = piece[:-1]
        if len(piece.encode(codec)) < size:
            return
        yield piece


@pytest.mark.parametrize(("codec", "text"), [("gbk", SIMPLE), ("big5", TRADITIONAL), ("utf-8", SIMPLE), ("utf-8", TRADITIONAL), ("utf-16-le", SIMPLE), ("utf-16-be", TRADITIONAL), ("utf-16-le", ENGLISH), ("utf-16-be", ENGLISH), ("utf-8", ENGLISH)])
def test_pieces_of_every_encoding(codec, text):
    pieces = list(slices(text, codec))
    assert len(pieces) > 20
    wrong = [p for p in pieces if detect(p.encode(codec)) != (codec, p)]
    assert not wrong


def test_mixed_with_ascii_and_markup():
    for codec, text in (("gbk", SIMPLE), ("big5", TRADITIONAL)):
        mixed = "".join(f"<p id={i} class='x'>{line}</p>\r\n" for i, line in enumerate(text.split("。")))
        assert detect(mixed.encode(codec)) == (codec, mixed)


def test_marks_and_defined_results():
    rare = SIMPLE + "𠀀㐂"  # four bytes in GB 18030, nothing in GBK
    assert detect(rare.encode("gb18030")) == ("gb18030", rare)
    assert detect(b"") == ("utf-8", "")
    assert detect(b"\xef\xbb\xbfab") == ("utf-8", "ab")
    assert detect("中文".encode("utf-16")) == ("utf-16", "中文")
    assert detect("中文".encode("utf-16-be").join([b"\xfe\xff", b""])) == ("utf-16", "中文")
    assert detect(b"\xff\xff\xff") == (None, "�" * 3)
    assert detect(b"a\x00b plain text with one NUL in it.") == ("utf-8", "a\x00b plain text with one NUL in it.")
    long = TRADITIONAL * 3000
    assert detect(long.encode("big5"))[0] == "big5"


def test_files(spark, tmp_path):
    for name, codec, text in (("a", "gbk", SIMPLE), ("b", "big5", TRADITIONAL), ("c", "utf-16-le", ENGLISH), ("d", "utf-8-sig", ENGLISH)):
        (tmp_path / f"{name}.txt").write_bytes(text.encode(codec))
    got = {r.path[-5:]: (r.encoding, r.text) for r in text_files.read_texts(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": ("gbk", SIMPLE), "b.txt": ("big5", TRADITIONAL), "c.txt": ("utf-16-le", ENGLISH), "d.txt": ("utf-8", ENGLISH)}


def test_report_says_what_it_leaves_out(spark):
    assert "Only the first 2 rows" in text_files.report(spark.range(3), "t", 2)
    assert "Only" not in text_files.report(spark.range(2), "t", 2)

"""The beginning of a chapter, by id, number or title."""

from bisect import bisect_left

from lexmill.operators.chunks import chapters, units
from lexmill.operators.lookup import PREVIEW
from lexmill.plans.tools import Tool


def rows(text: str, chapterTitle: str | None = None, chapterIndex: int | None = None, chapterId: str | None = None):
    at = units(text)
    every = [(f"ch-{n}-{at[s]}", n, title, s, e) for n, (title, s, e) in enumerate(chapters(text), 1)]
    if chapterId:
        chosen = [c for c in every if c[0] == chapterId][:1]
    elif chapterIndex is not None:
        chosen = [c for c in every if c[1] == chapterIndex]
    elif chapterTitle:
        chosen = [c for c in every if chapterTitle in c[2]] or [c for c in every if chapterTitle in text[c[3] : c[4]]][:1]
    else:
        chosen = []
    for ident, n, title, s, e in chosen:
        if len(chosen) > 1:
            yield "ambiguous", ident, n, title, at[s], at[e], at[e] - at[s], None, None
        else:
            stop = bisect_left(at, min(at[s] + PREVIEW, at[e]))
            yield "ok", ident, n, title, at[s], at[stop], at[e] - at[s], stop < e, text[s:stop]


TOOL = Tool(
    "getChapterInfo",
    "The beginning of a chapter, found by its id, its number from 1 or a part of its title; titles that fit several chapters list them.",
    {"type": "object", "properties": {"chapterTitle": {"type": "string"}, "chapterIndex": {"type": "integer"}, "chapterId": {"type": "string"}}},
    "status string, chapter_id string, ordinal int, title string, start int, end int, length int, truncated boolean, preview string",
    rows,
)

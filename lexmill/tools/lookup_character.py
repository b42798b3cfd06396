"""Where a name stands in a text."""

from lexmill.operators.lookup import places
from lexmill.plans.tools import Tool


def rows(text: str, name: str):
    return places(text, name) if name.strip() else ()


TOOL = Tool(
    "lookupCharacter",
    "The first places of a name in a text, with the text around them.",
    {"type": "object", "properties": {"name": {"type": "string", "description": "a name"}}, "required": ["name"]},
    "rank int, at int, start int, end int, chapter_ordinal int, snippet string",
    rows,
)

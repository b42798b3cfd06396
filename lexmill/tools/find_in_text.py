"""The first places of a query in a text, as it stands."""

from lexmill.operators.lookup import places
from lexmill.plans.tools import Tool


def rows(text: str, query: str):
    query = query.strip()
    return places(text, query, 200, 600, 3, chapter_of_start=True) if len(query) >= 2 else ()


TOOL = Tool(
    "findInText",
    "Passages of a text that contain a query word for word.",
    {"type": "object", "properties": {"query": {"type": "string", "description": "what to look for"}}, "required": ["query"]},
    "rank int, at int, start int, end int, chapter_ordinal int, snippet string",
    rows,
)

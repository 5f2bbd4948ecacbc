"""Values from attributes and from command-line text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute(value):
    """An attribute's plain value: arrays of one item give it, bytes give text."""
    if hasattr(value, "item") and getattr(value, "size", 1) == 1:
        value = value.item()
    elif isinstance(value, (list, tuple)) and len(value) == 1:
        value = value[0]
    return value.decode() if isinstance(value, bytes) else value


def split_list(text: str | None, kind=str) -> list | None:
    """``a, b`` to a list; None stays None."""
    return None if text is None else [kind(x.strip()) for x in text.split(",")]


def split_column(text: Column, kind: str = "string") -> Column:
    """The same for a column: trimmed items cast to ``kind``."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast(kind))


def join_characters(characters: Column) -> Column:
    """An array of single characters (bytes of a time stamp) as text."""
    return F.array_join(characters, "")

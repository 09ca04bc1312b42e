"""Text, identifier and payload expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldseam.functions.coerce import strip


def strip_code_fences(text: Column) -> Column:
    """SQL out of a Markdown block."""
    return strip(F.regexp_replace(text, "```(sql)?", ""))


def strip_semicolons(text: Column) -> Column:
    """Statement text without the white space and semicolons that close it."""
    return strip(F.rtrim(strip(text), F.lit(";")))


def contains_text(text: Column, part: Column | str) -> Column:
    """Substring test that ignores case."""
    needle = F.lit(part) if isinstance(part, str) else part
    return F.contains(F.lower(text), F.lower(needle))


def contains_word(text: Column, words: Iterable[str]) -> Column:
    """Whole-word test that ignores case, for any of ``words``."""
    return text.rlike(r"(?i)\b(?:" + "|".join(words) + r")\b")


def row_hash(columns: Iterable[str]) -> Column:
    """SHA-256 of the row, null fields included."""
    return F.sha2(payload_json(columns), 256)


def payload_json(columns: Iterable[str]) -> Column:
    """The row as JSON, without columns whose name starts with ``_``."""
    return F.to_json(F.struct(*[c for c in columns if not c.startswith("_")]), {"ignoreNullFields": "false"})

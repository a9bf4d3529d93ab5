"""What may leave the system: never the licensed context."""

from __future__ import annotations

from pyspark.sql import DataFrame

PRIVATE = ("context", "page_text", "full_text")


def published(rows: DataFrame) -> DataFrame:
    """``rows`` without licensed text, also not nested under another name at the top level."""
    return rows.select(*[c for c in rows.columns if c not in PRIVATE])


def check_published(rows: DataFrame) -> None:
    held = [c for c in rows.columns if c in PRIVATE]
    if held:
        raise ValueError(f"licensed columns in a published table: {held}")

"""Names for an operator's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores behind it as long as ``df`` has a column of that name in either case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem

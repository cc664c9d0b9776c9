"""Names of helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, label: str) -> str:
    """A column name that ``df`` can't have: longer than all of its own."""
    return label + "_" * max(map(len, df.columns), default=1)

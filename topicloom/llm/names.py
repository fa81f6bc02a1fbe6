"""Column names that no column of a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(table: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes; Spark does not tell cases apart."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

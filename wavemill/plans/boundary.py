"""The privacy boundary: only decisions leave.

Spark has no sealed types, so this is a convention: sinks take what ``publish`` gives, and it
selects decision columns and keys alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DECISION = ("kind", "class", "confidence_permille")


def assert_boundary_safe(df: DataFrame, keys: list[str]) -> None:
    """Raises unless the columns are the keys (scalars) and those of a decision."""
    for f in df.schema.fields:
        if f.name not in (*keys, *DECISION):
            raise ValueError(f"column {f.name} may not leave")
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType):
            raise ValueError(f"column {f.name} is no scalar")


def publish(df: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """Keys and the flattened decision; everything else stays behind."""
    out = df.select(*keys, *(f"{decision}.{c}" for c in DECISION))
    assert_boundary_safe(out, keys)
    return out

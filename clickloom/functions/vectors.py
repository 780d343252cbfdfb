"""Word vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_vector(vec: Column, zeros: int) -> Column:
    """``zeros`` trailing zeros appended."""
    return F.concat(vec, F.array_repeat(F.lit(0.0).cast("float"), zeros))

"""Putting rows and columns of several tables together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; columns are matched by name."""
    return reduce(DataFrame.unionByName, parts)


def zip_columns(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Columns of several tables side by side, matched on a unique row key.

    Columns of one table need no join: select them together instead.
    """
    return reduce(lambda left, right: left.join(right, key), frames)

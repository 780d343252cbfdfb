"""Synthetic click logs of any size, one row per id, repeatable by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import draws
from clickloom.functions.rows import quoted
from clickloom.spec import FeatureSpec

_WORDS = 4  # 8-digit words in one digest


def _word(seed: int | str, key: Column, j: int) -> Column:
    """The ``j``-th 8-digit hexadecimal word drawn for a row."""
    block = draws.digest(seed, key, F.lit(j // _WORDS))
    return F.substring(block, 1 + 8 * (j % _WORDS), 8)


def _number(word: Column) -> Column:
    return F.conv(word, 16, 10).cast("bigint")


def generate_clicklog(
    ids: DataFrame,
    spec: FeatureSpec,
    key: str = "id",
    seed: int = 0,
    sparse: str = "hex",
) -> DataFrame:
    """Label 0 or 1, dense FLOAT in [-1000, 1000), sparse 8-digit upper-case
    hexadecimal text (``hex``) or BIGINT below 2**63 (``int64``).

    ``ids`` is usually ``spark.range(rows, numPartitions=files)``. Runs without
    a shuffle.
    """
    k = F.col(key)
    label = F.pmod(_number(_word(seed, k, 0)), F.lit(2)).cast("bigint")
    columns = [label.alias(spec.label)]
    for j, c in enumerate(spec.dense, start=1):
        value = _number(_word(seed, k, j)) / F.lit(float(2**32)) * 2000.0 - 1000.0
        columns.append(value.cast("float").alias(c))
    first = 1 + len(spec.dense)
    for j, c in enumerate(spec.sparse):
        if sparse == "hex":
            value = F.upper(_word(seed, k, first + j))
        else:
            high = _number(_word(seed, k, first + 2 * j)).bitwiseAND(F.lit(0x7FFFFFFF))
            value = F.shiftleft(high, 32) + _number(_word(seed, k, first + 2 * j + 1))
        columns.append(value.alias(c))
    return ids.select(quoted(key), *columns)


def estimated_bytes(spec: FeatureSpec, rows: int, sparse: str = "hex") -> int:
    """Uncompressed size: 8-byte label, 4-byte dense, 8-byte sparse values."""
    return rows * (8 + 4 * len(spec.dense) + 8 * len(spec.sparse))

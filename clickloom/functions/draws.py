"""Repeatable random draws.

A draw depends only on the seed and the row's key, so a retried task, another
partitioning or another engine gives the same draw. ``rand()`` does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DRAW_DIGITS = 15
DRAW_RANGE = 16**_DRAW_DIGITS


def digest(seed: int | str, *keys: Column) -> Column:
    """32 hexadecimal digits from ``seed|key|key...``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def draw(seed: int | str, *keys: Column) -> Column:
    """Uniform BIGINT in [0, 16**15)."""
    return F.conv(F.substring(digest(seed, *keys), 1, _DRAW_DIGITS), 16, 10).cast(
        "bigint"
    )


def uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform DOUBLE in [0, 1)."""
    return draw(seed, *keys).cast("double") / F.lit(float(DRAW_RANGE))


# Modulus and multiplier of the two multiplicative generators that
# L'Ecuyer combines (1988).
GENERATORS = ((2147483563, 40014), (2147483399, 40692))


def generator_steps(dim: int) -> list[tuple[int, int, int, int]]:
    """Per component: the factors of its two numbers, in either generator."""

    def powers(modulus: int, multiplier: int) -> list[int]:
        return [pow(multiplier, k, modulus) for k in range(1, 2 * dim + 1)]

    first, second = (powers(m, a) for m, a in GENERATORS)
    return list(zip(first[::2], second[::2], first[1::2], second[1::2]))


def gaussian_vector(seed: int | str, dim: int, *keys: Column) -> Column:
    """``dim`` standard normal FLOATs from one digest per row.

    The two halves of the digest start two multiplicative sequences, together
    2**62 ways; each component takes two of their combined numbers through the
    polar form.
    """
    (m1, _), (m2, _) = GENERATORS
    names = ("a1", "a2", "b1", "b2")
    steps = F.array(
        *[
            F.struct(*[F.lit(x).cast("bigint").alias(n) for n, x in zip(names, step)])
            for step in generator_steps(dim)
        ]
    )

    def uniform_of(start: Column, first: Column, second: Column) -> Column:
        z = F.pmod(start["s1"] * first % m1 - start["s2"] * second % m2, F.lit(m1 - 1))
        return F.when(z == 0, F.lit(m1 - 1)).otherwise(z).cast("double") / F.lit(float(m1))

    def component(start: Column, step: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.ln(uniform_of(start, step["a1"], step["a2"])))
        turn = uniform_of(start, step["b1"], step["b2"])
        return (radius * F.cos(F.lit(2.0) * F.pi() * turn)).cast("float")

    def half(digits: Column, at: int, modulus: int) -> Column:
        return F.conv(F.substring(digits, at, _DRAW_DIGITS), 16, 10).cast("bigint") % (modulus - 1) + 1

    drawn = digest(seed, *keys)
    # The outer transforms bind the digest and the starts once; inlined, they would be computed
    # again for every component.
    one = F.transform(
        F.array(drawn),
        lambda d: F.struct(half(d, 1, m1).alias("s1"), half(d, 17, m2).alias("s2")),
    )
    vectors = F.transform(one, lambda s: F.transform(steps, lambda t: component(s, t)))
    return F.get(vectors, F.lit(0))


def gaussian_rows(digits: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of ``gaussian_vector`` for many digests at once: one row of ``dim`` FLOATs each.

    ``digits`` has the 32 characters of one digest in each row, as bytes.
    """
    # 0-9 have their value in the low four bits; a-f lie 9 above theirs.
    values = (digits & 15).astype(np.int64) + 9 * (digits >> 6).astype(np.int64)
    powers = 16 ** np.arange(_DRAW_DIGITS - 1, -1, -1, dtype=np.int64)
    (m1, _), (m2, _) = GENERATORS
    first = (values[:, :_DRAW_DIGITS] @ powers) % (m1 - 1) + 1
    second = (values[:, 16 : 16 + _DRAW_DIGITS] @ powers) % (m2 - 1) + 1
    a1, a2, b1, b2 = np.array(generator_steps(dim), np.int64).reshape(-1, 4).T

    def uniforms(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        z = (first[:, None] * own % m1 - second[:, None] * other % m2) % (m1 - 1)
        return np.where(z == 0, m1 - 1, z) / float(m1)

    radius = np.sqrt(-2.0 * np.log(uniforms(a1, a2)))
    return (radius * np.cos(2.0 * np.pi * uniforms(b1, b2))).astype(np.float32)


def digest_bytes(digests: pa.Array) -> np.ndarray:
    """The characters of digests, none of them null: one row of 32 bytes each."""
    fixed = digests.cast(pa.binary()).cast(pa.binary(32))
    return np.frombuffer(fixed.buffers()[1], np.uint8, 32 * len(fixed), 32 * fixed.offset).reshape(-1, 32)


def gaussian_vectors(digests: Column, dim: int) -> Column:
    """``gaussian_rows`` as an Arrow function of a digest column; a null digest has no vector."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def drawn(found: pa.Array) -> pa.Array:
        given = found.drop_null()
        flat = gaussian_rows(digest_bytes(given), dim).reshape(-1) if len(given) else np.zeros(0, np.float32)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(known)]) * dim
        offsets = pa.array(ends, pa.int32(), mask=np.append(~known, False))
        return pa.ListArray.from_arrays(offsets, pa.array(flat))

    return drawn(digests)

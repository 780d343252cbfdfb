"""Column functions as functions of Arrow arrays, for rows of hundreds of columns.

They give what ``dense`` and ``sparse`` give for a column of text without NULL, such as ``fill_missing``
returns: the same numbers to the last bit, and an error where those raise one. Numbers between steps
are NumPy arrays.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_DECIMAL = re.compile(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[fFdD]?")
_HEX_FLOAT = re.compile(r"([+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFdD]?")
_SPECIAL = {"NaN": "nan", "+NaN": "nan", "-NaN": "nan", "Infinity": "inf", "+Infinity": "inf", "-Infinity": "-inf"}
_SPECIAL_ANY_CASE = {"inf": "inf", "+inf": "inf", "infinity": "inf", "+infinity": "inf", "-inf": "-inf", "-infinity": "-inf", "nan": "nan"}
_LONG = re.compile(r"[+-]?[0-9]+")
# What Java's trim removes, and what Spark removes around whole numbers.
_BLANKS = "".join(map(chr, range(33)))
_BLANKS_AND_CONTROLS = _BLANKS + "\x7f"


def _text(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the values, with the end of the last, and the bytes they lie in."""
    wide = pa.types.is_large_string(c.type)
    starts = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1]
    data = c.buffers()[2]
    return starts, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def fill_missing(c: pa.Array, default: str = "0") -> pa.Array:
    """NULL, the empty string and a lone newline become ``default``."""
    if not len(c):
        return c
    starts, data = _text(c)
    size = np.diff(starts)
    missing = size == 0
    single = np.flatnonzero(size == 1)
    missing[single] = data[starts[single]] == 10
    if c.null_count:
        missing |= c.is_null().to_numpy(zero_copy_only=False)
    return pc.if_else(pa.array(missing), pa.scalar(default, c.type), c) if missing.any() else c


def _java_number(s: str) -> str | None:
    """A number as Java and Spark read it, in the form Arrow reads."""
    bare = s.strip(_BLANKS)
    if found := _DECIMAL.fullmatch(bare):
        return repr(float(found[1]))
    if found := _HEX_FLOAT.fullmatch(bare):
        try:
            return repr(float.fromhex(found[1]))
        except OverflowError:
            return "-inf" if bare.startswith("-") else "inf"
    return _SPECIAL.get(bare) or _SPECIAL_ANY_CASE.get(bare.lower())


def _floating(c: pa.Array, kind: pa.DataType, what: str) -> np.ndarray:
    try:
        values = pc.cast(c, kind).to_numpy(zero_copy_only=False)
        if np.isfinite(values).all():
            return values
    except pa.ArrowInvalid:
        pass
    # Arrow and Java differ in spaces, signs, suffixes and names: each such text is read once.
    coded = c.dictionary_encode()
    read = [_java_number(s) for s in coded.dictionary.to_pylist()]
    if None in read:
        raise ValueError(f"{what} cannot be read")
    with np.errstate(over="ignore"):
        numbers = np.array([float(s) for s in read], kind.to_pandas_dtype())
    return numbers[coded.indices.to_numpy()]


def dense_double(c: pa.Array) -> np.ndarray:
    return _floating(c, pa.float64(), "dense value")


def to_float(c: pa.Array) -> np.ndarray:
    return _floating(c, pa.float32(), "value")


def to_long(c: pa.Array) -> np.ndarray:
    """Whole numbers, with spaces around them and a sign."""
    _, data = _text(c)
    try:
        # Arrow also reads 0x1f.
        if not ((data | 32) == ord("x")).any():
            return pc.cast(c, pa.int64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:
        pass
    coded = c.dictionary_encode()
    read = [s.strip(_BLANKS_AND_CONTROLS) for s in coded.dictionary.to_pylist()]
    if not all(_LONG.fullmatch(s) and -(2**63) <= int(s) < 2**63 for s in read):
        raise ValueError("value cannot be read as a whole number")
    return np.array([int(s) for s in read], np.int64)[coded.indices.to_numpy()]


def unsigned_32(v: np.ndarray) -> np.ndarray:
    """The low 32 bits as an unsigned value."""
    return v & np.int64(0xFFFFFFFF)


def neg_to_zero(v: np.ndarray) -> np.ndarray:
    """Negative values become 0; NaN is left alone."""
    return np.where(v < 0, 0.0, v)


_LN2_HI, _LN2_LO = 6.93147180369123816490e-01, 1.90821492927058770002e-10
_LP = (
    6.666666666666735130e-01, 3.999999999940941908e-01, 2.857142874366239149e-01, 2.222219843214978396e-01,
    1.818357216161805012e-01, 1.531383769920937332e-01, 1.479819860511658591e-01,
)


def log1p(v: np.ndarray) -> np.ndarray:
    """Of numbers that are not negative, as Java's StrictMath (fdlibm) takes it.

    Its steps in its order, so that results do not depend on the machine's own logarithm.
    """
    with np.errstate(all="ignore"):
        u = 1.0 + v
        if (large := v >= 2.0**53).any():
            u[large] = v[large]
        bits = u.view(np.int64)
        k = (bits >> 52) - 1023
        c = np.where(k > 0, 1.0 - (u - v), v - (u - 1.0)) / u
        if large.any():
            c[large] = 0.0
        fraction = bits & 0xFFFFFFFFFFFFF
        half = (fraction >> 32) >= 0x6A09E
        k += half
        f = (fraction | np.where(half, 0x3FE0000000000000, 0x3FF0000000000000)).view(np.float64) - 1.0
        high = fraction >> 32
        # Below the square root of two less one the number itself is the fraction.
        small = (v.view(np.int64) >> 32) < 0x3FDA827A
        k[small] = 0
        f = np.where(small, v, f)
        c[small] = 0.0
        kd = k.astype(np.float64)
        hfsq = 0.5 * f * f
        s = f / (2.0 + f)
        z = s * s
        r = _LP[6]
        for p in _LP[5::-1]:
            r = p + z * r
        r = z * r
        out = np.where(
            k == 0, f - (hfsq - s * (hfsq + r)), kd * _LN2_HI - ((hfsq - (s * (hfsq + r) + (kd * _LN2_LO + c))) - f)
        )
        # Fractions near nothing: a shorter series.
        high = np.where(half, (0x100000 - high) >> 2, high)
        if (odd := ~small & (high == 0)).any():
            n, g, h, lost = kd[odd], f[odd], hfsq[odd], c[odd]
            r = h * (1.0 - 0.66666666666666666 * g)
            near = np.where(n == 0, g - r, n * _LN2_HI - ((r - (n * _LN2_LO + lost)) - g))
            out[odd] = np.where(g == 0, np.where(n == 0, 0.0, n * _LN2_HI + (lost + n * _LN2_LO)), near)
        if (tiny := v < 2.0**-29).any():
            out[tiny] = np.where(v[tiny] < 2.0**-54, v[tiny], v[tiny] - v[tiny] * v[tiny] * 0.5)
        if not (finite := np.isfinite(v)).all():
            out[~finite] = v[~finite]
    return out


def round_half_up(v: np.ndarray, places: int) -> np.ndarray:
    """Rounded as the shortest decimal that stands for a number, halves away from zero."""
    scale = 10.0**places
    with np.errstate(all="ignore"):
        scaled = v * scale
        floor = np.floor(scaled + 0.5)
        out = floor / scale
        # Near a half, and where 64 bits are too few, the decimal decides.
        sure = (np.abs(np.abs(scaled - floor) - 0.5) > 1e-3) & (np.abs(scaled) < 1e12)
    if not sure.all():
        unit = Decimal(1).scaleb(-places)
        for i in np.flatnonzero(~sure):
            x = float(v[i])
            if np.isfinite(x) and abs(x) < 1e15:
                out[i] = float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP)) + 0.0
            else:
                out[i] = x
    return out


_DIGIT = np.full(256, -1, np.int64)
for _i, _c in enumerate("0123456789abcdef"):
    _DIGIT[[ord(_c), ord(_c.upper())]] = _i


def _hex(c: pa.Array, message: str, m: int | None) -> np.ndarray:
    starts, data = _text(c)
    size = np.diff(starts)
    if (size == 0).any():
        raise ValueError(message)
    values = np.zeros(len(c), np.int64)
    for i in range(int(size.max(initial=0))):
        if i >= 15 and m is not None:
            values %= m
        longer = size > i
        everywhere = longer.all()
        digits = _DIGIT[data[starts[:-1] + i if everywhere else starts[:-1][longer] + i]]
        held = values if everywhere else values[longer]
        if (digits < 0).any() or (m is None and i >= 15 and (held >= 1 << 59).any()):
            raise ValueError(message)
        if everywhere:
            values = held * 16 + digits
        else:
            values[longer] = held * 16 + digits
    return values


def hex_to_int(c: pa.Array) -> np.ndarray:
    """Hexadecimal text of any length that fits 63 bits."""
    return _hex(c, "sparse value is not hexadecimal, or too large without a modulus", None)


def hex_mod(c: pa.Array, m: int) -> np.ndarray:
    """Hexadecimal text of any length modulo ``m``."""
    if not 0 < m < 2**58:
        raise ValueError("the modulus must be positive and below 2**58")
    return _hex(c, "sparse value is not hexadecimal", m) % m

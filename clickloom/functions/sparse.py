"""Sparse (categorical) columns: hexadecimal text to bounded integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Fixed value: hexadecimal digits that always fit a BIGINT.
_SAFE_DIGITS = 15


def _is_hex(c: Column) -> Column:
    """``conv`` alone reads any valid prefix (``'1g'`` gives 1); ``unhex`` is NULL then."""
    return F.unhex(c).isNotNull() & (F.length(c) > 0)


def hex_or_null(c: Column) -> Column:
    """Hexadecimal text of any length as BIGINT; NULL where it is none or does not fit."""
    short = F.conv(c, 16, 10).cast("bigint")
    digits = F.ltrim(c, F.lit("0"))
    long = F.when(F.length(digits) <= 16, F.conv(digits, 16, 10).try_cast("bigint"))
    return F.when(_is_hex(c), F.when(F.length(c) <= _SAFE_DIGITS, short).otherwise(long))


def hex_mod_or_null(c: Column, m: int) -> Column:
    """Hexadecimal text of any length modulo ``m``; NULL where it is none.

    Longer text is folded group by group of digits, so that no step leaves BIGINT.
    """
    short = F.pmod(F.conv(c, 16, 10).cast("bigint"), F.lit(m).cast("bigint"))
    width = min(7, (62 - m.bit_length()) // 4)
    if width < 1:
        raise ValueError("the modulus must be below 2**58")
    groups = F.regexp_extract_all(
        F.lpad(c, F.ceil(F.length(c) / width).cast("int") * width, F.lit("0")),
        F.lit(f".{{{width}}}"), F.lit(0),
    )
    folded = F.aggregate(
        groups,
        F.lit(0).cast("bigint"),
        lambda acc, g: (acc * F.lit(16**width) + F.conv(g, 16, 10).cast("bigint")) % F.lit(m),
    )
    return F.when(_is_hex(c), F.when(F.length(c) <= _SAFE_DIGITS, short).otherwise(folded))


def _or_fail(value: Column, message: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(message)).cast("bigint"))


def hex_to_int(c: Column, kind: T.DataType | None = None) -> Column:
    """Strict: hexadecimal text to BIGINT; integer columns pass through."""
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint")
    return _or_fail(hex_or_null(c), "sparse value is not hexadecimal, or too large without a modulus")


def modulus(c: Column, m: int) -> Column:
    """Remainder that is never negative."""
    return F.pmod(c.cast("bigint"), F.lit(m).cast("bigint"))


def hex_mod(c: Column, m: int, kind: T.DataType | None = None) -> Column:
    """Strict: hexadecimal text of any length, or an integer, modulo ``m``."""
    if isinstance(kind, T.IntegralType):
        return modulus(c, m)
    return _or_fail(hex_mod_or_null(c, m), "sparse value is not hexadecimal")


def hex_mod_lenient(c: Column, m: int, kind: T.DataType | None = None) -> Column:
    """Like ``hex_mod``; what cannot be read becomes 0."""
    value = modulus(c, m) if isinstance(kind, T.IntegralType) else hex_mod_or_null(c, m)
    return F.coalesce(value, F.lit(0).cast("bigint"))


def int_mod_lenient(c: Column, m: int) -> Column:
    """Decimal text or integer modulo ``m``; what cannot be read becomes 0."""
    return F.coalesce(modulus(c.try_cast("bigint"), m), F.lit(0).cast("bigint"))


def wrap_int32(v: Column) -> Column:
    """The low 32 bits of a BIGINT as a signed 32-bit value."""
    return F.shiftright(F.shiftleft(v, 32), 32).cast("int")


def hex_wrap_int32(c: Column, kind: T.DataType | None = None) -> Column:
    """Hexadecimal text of any length, or an integer: its low 32 bits as a signed value."""
    if isinstance(kind, T.IntegralType):
        return wrap_int32(c.cast("bigint"))
    low = F.when(_is_hex(c), F.conv(F.right(c, F.lit(8)), 16, 10).cast("bigint"))
    return wrap_int32(_or_fail(low, "sparse value is not hexadecimal"))


def hex_zero_pad(c: Column, width: int = 8) -> Column:
    return F.lpad(c, width, "0")


def int_to_hex(v: Column, width: int = 8) -> Column:
    return F.format_string(f"%0{width}X", v)

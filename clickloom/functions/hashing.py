"""64-bit word hashes on BIGINT bit patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seed and rotation of the xor hash; start value of the FNV-1a
# variant (its low 64 bits) and its two multipliers (their low words). The
# 128-bit constants have no other bits that reach the low 64 bits of a result.
XOR_SEED = 0x6C62272E07BB0142
XOR_ROTATE = 5
FNV_START = 0x62B821756295C58D
FNV_MULTIPLIERS = (0x201, 0x13B)

_LOW32 = 0xFFFFFFFF


def utf8_bytes(word: Column) -> Column:
    """UTF-8 byte values of a word, in order."""
    # In this charset the code of a character is its byte.
    single = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    positions = F.sequence(F.lit(1), F.octet_length(word))
    values = F.transform(positions, lambda i: F.ascii(F.substr(single, i, F.lit(1))).cast("bigint"))
    return F.when(word == "", F.array().cast("array<bigint>")).otherwise(values)


def xor_rotate_hash(word: Column) -> Column:
    """Xor each byte in, then rotate left."""

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        return F.shiftleft(x, XOR_ROTATE).bitwiseOR(
            F.shiftrightunsigned(x, 64 - XOR_ROTATE)
        )

    return F.aggregate(utf8_bytes(word), F.lit(XOR_SEED), step)


def fnv1a_hash(word: Column, multiplier: int = FNV_MULTIPLIERS[0]) -> Column:
    """Xor each byte in, then multiply modulo 2**64.

    The product is formed from two 32-bit halves, which never overflow BIGINT.
    """

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        low = x.bitwiseAND(F.lit(_LOW32)) * multiplier
        high = F.shiftrightunsigned(x, 32) * multiplier + F.shiftrightunsigned(low, 32)
        return F.shiftleft(high.bitwiseAND(F.lit(_LOW32)), 32).bitwiseOR(
            low.bitwiseAND(F.lit(_LOW32))
        )

    return F.aggregate(utf8_bytes(word), F.lit(FNV_START), step)


def low_bits(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def upper_bits(h: Column, low: int) -> Column:
    """The bits above the ``low`` lowest ones."""
    return F.shiftrightunsigned(h, low)


def pack_entry(h: Column, idx: Column, low: int = 24) -> Column:
    """Upper hash bits and, in place of the lower ones, the word's index.

    An index that needs more than ``low`` bits fails the query.
    """
    fits = idx.isNull() | ((idx >= 0) & (idx < (1 << low)))
    failure = F.raise_error(F.lit(f"index does not fit {low} bits")).cast("bigint")
    index = F.when(fits, low_bits(idx, low)).otherwise(failure)
    return F.shiftleft(upper_bits(h, low), low).bitwiseOR(index)


def unsigned(h: Column) -> Column:
    """Decimal text of a bit pattern read as unsigned."""
    return F.conv(F.hex(h), 16, 10)

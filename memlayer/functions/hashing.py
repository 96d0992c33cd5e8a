"""FNV-1a in 64 bits as expressions.

64-bit products overflow (an error under ANSI), so the state is two halves of 32 bits held in longs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlayer.functions.text import column

#: Offset basis and prime (2^40 + 435).
BASIS = 0xCBF29CE484222325
PRIME = 0x100000001B3
_MASK = 0xFFFFFFFF


def byte_values(text: Column | str) -> Column:
    """The UTF-8 bytes of a text as integers."""
    digits = F.hex(F.encode(column(text), "UTF-8"))
    n = F.length(digits) / 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def fnv1a(text: Column | str, seed: int = 0) -> Column:
    """``struct<hi, lo>``, which orders as the unsigned hash does (SF1, SF3)."""
    start = (seed ^ BASIS) & (1 << 64) - 1
    state = F.struct(F.lit(start >> 32).cast("long").alias("hi"), F.lit(start & _MASK).cast("long").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        x = h["lo"].bitwiseXOR(b.cast("long"))
        low = x * 435
        high = h["hi"] * 435 + F.shiftleft(x, 8) + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(F.lit(_MASK).cast("long")).alias("hi"), low.bitwiseAND(F.lit(_MASK).cast("long")).alias("lo"))

    return F.aggregate(byte_values(text), state, step)


def fnv1a_hex(text: Column | str, seed: int = 0) -> Column:
    h = fnv1a(text, seed)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def fnv1a_bucket(text: Column | str, dim: int = 64) -> Column:
    """The hash modulo a dimension; for a power of two its low bits are all that is carried (SF2)."""
    if dim & (dim - 1) == 0 and dim <= 1 << 16:
        return F.aggregate(byte_values(text), F.lit(BASIS & (dim - 1)), lambda h, b: (h.bitwiseXOR(b) * (PRIME & (dim - 1))).bitwiseAND(F.lit(dim - 1)))
    h = fnv1a(text)
    return ((h["hi"] % dim * ((1 << 32) % dim) + h["lo"] % dim) % dim).cast("int")


def fnv1a_int(data: bytes, seed: int = 0) -> int:
    """The same hash on the driver."""
    h = (seed ^ BASIS) & (1 << 64) - 1
    for b in data:
        h = (h ^ b) * PRIME & (1 << 64) - 1
    return h

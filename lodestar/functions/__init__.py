"""Column functions of the graph operators.  Unsigned 32-bit arithmetic is done in bigint under a mask, which ANSI mode allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 32) - 1
#: The multipliers and increments of the hashes.
WANG_MULTIPLIER = 0x27D4EB2D
LCG_MULTIPLIER, LCG_INCREMENT = 1664525, 1013904223
#: Bounds of the degree classes.
SMALL, MEDIUM = 32, 1024


def _u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def wang_hash(x: Column) -> Column:
    """Wang's 32-bit integer hash, as a bigint in 0 .. 2**32-1."""
    h = _u32(x.cast("bigint"))
    h = _u32(h.bitwiseXOR(F.lit(61)).bitwiseXOR(F.shiftright(h, 16)))
    h = _u32(h * 9)
    h = h.bitwiseXOR(F.shiftright(h, 4))
    h = _u32(h * F.lit(WANG_MULTIPLIER).cast("bigint"))
    return h.bitwiseXOR(F.shiftright(h, 15))


def lcg(seed: Column, shift: Column) -> Column:
    """One step of a linear congruential generator mod 2**32, moved by a shift."""
    return _u32(_u32(seed.cast("bigint")) * F.lit(LCG_MULTIPLIER) + F.lit(LCG_INCREMENT) + shift.cast("bigint"))


def degree_class(degree: Column, inclusive: bool = False) -> Column:
    """small, medium or large; bounds are exclusive for frontiers and inclusive for whole graphs."""
    below = (lambda b: degree <= b) if inclusive else (lambda b: degree < b)
    return F.when(below(SMALL), F.lit("small")).when(below(MEDIUM), F.lit("medium")).otherwise(F.lit("large"))


def byte_class(n_bytes: Column) -> Column:
    """The classes of compressed rows, by bytes."""
    return F.when(n_bytes < SMALL, F.lit("small")).otherwise(F.lit("large"))


def varint_length(value: Column) -> Column:
    """Bytes of a value in LEB128: seven bits a byte."""
    out = F.when(value < 1 << 7, 1)
    for k in range(2, 10):
        out = out.when(value < 1 << 7 * k, k) if 7 * k < 63 else out
    return out.otherwise(9).cast("int")


def cyclic_picks(neighbours: Column, start: Column, k: int) -> Column:
    """Up to k neighbours in a circle from a place on; no more than there are."""
    n = F.size(neighbours)
    order = F.sequence(F.lit(0), F.least(F.lit(k), n) - 1)
    picked = F.transform(order, lambda i: F.get(neighbours, F.pmod(start + i, n).cast("int")))
    return F.when(n > 0, picked).otherwise(F.slice(neighbours, 1, 0))

"""The cell lattice as bit masks: the least upper bound is a bitwise OR.

BOTTOM < ALLOC < {MB, IMMB, MV} < TOP and BOTTOM < FREED < TOP.  A mask that is
the OR of incomparable values is none of the six and reads as TOP, so Spark's
``bit_or``, with its partial aggregation, is the join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The masks.
MASKS = {"BOTTOM": 0, "ALLOC": 1, "MB": 3, "IMMB": 5, "MV": 9, "FREED": 16, "TOP": 31}
_NAMES = {m: n for n, m in MASKS.items()}


def encode(name: Column) -> Column:
    """The mask of a value's name; null for other text."""
    out = F.lit(None).cast("int")
    for n, m in MASKS.items():
        out = F.when(name == n, F.lit(m)).otherwise(out)
    return out


def decode(mask: Column) -> Column:
    """The name of a mask, TOP for an OR of incomparable values."""
    out = F.when(mask.isNull(), F.lit(None).cast("string")).otherwise("TOP")
    for n, m in MASKS.items():
        out = F.when(mask == m, n).otherwise(out)
    return out


def normal(mask: Column) -> Column:
    """A mask with TOP for an OR of incomparable values."""
    return F.when(mask.isin(*_NAMES), mask).otherwise(MASKS["TOP"])


def lub(mask: Column) -> Column:
    """Aggregate: the least upper bound of a column of masks."""
    return normal(F.bit_or(mask))


def join(a: Column, b: Column) -> Column:
    """The least upper bound of two masks."""
    return normal(a.bitwiseOR(b))


def leq(a: Column, b: Column) -> Column:
    """Whether a lies below b or is b."""
    return (b == MASKS["TOP"]) | (a.bitwiseOR(b) == b)


def compare(a: Column, b: Column) -> Column:
    """=, < or > of two masks, null if neither lies below the other."""
    return F.when(a == b, "=").when(leq(a, b), "<").when(leq(b, a), ">")


def is_default(mask: Column) -> Column:
    return mask == MASKS["BOTTOM"]


def join_masks(a: int, b: int) -> int:
    """``join`` of two Python integers."""
    return a | b if a | b in _NAMES else MASKS["TOP"]

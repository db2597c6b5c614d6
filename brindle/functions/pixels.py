"""Scalar expressions on pixels, arrays, bits and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 256


def pixel(x: Column) -> Column:
    """A value from -1 to 1 as a grey level from 0 to 255."""
    return F.floor((x.cast("double") + 1) * 127.5).cast("int")


def clipped(x: Column, low: int = 0, high: int = 255) -> Column:
    """Clips to the range and cuts the fraction off."""
    return F.greatest(F.least(x, F.lit(high)), F.lit(low)).cast("int")


def wrapped(x: Column, levels: int = LEVELS) -> Column:
    """Unsigned wrap-around (uint8 arithmetic)."""
    return F.pmod(x, F.lit(levels)).cast("int")


def wrapped_difference(a: Column, b: Column, levels: int = LEVELS) -> Column:
    """a - b element by element, wrapped."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(levels)).cast("int"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Integer distances of integer arrays: l2 is squared, hamming counts differing places."""
    if metric == "l2":
        return _sum(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")))
    if metric == "l1":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")))
    if metric == "hamming":
        return _sum(F.zip_with(a, b, lambda x, y: (x != y).cast("long")))
    raise ValueError(f"no metric named {metric!r}")


def bits(x: Column, width: Column | int) -> Column:
    """The low ``width`` bits of a non-negative number as '0' and '1' (none for width 0)."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.when(w == 0, "").otherwise(F.lpad(F.bin(x.cast("long")), w.cast("int"), "0"))


def golomb(v: Column, k: int) -> Column:
    """Golomb word: the quotient in unary, a one, the remainder in truncated binary."""
    b = (k - 1).bit_length()
    short = (1 << b) - k  # remainders with one bit less
    r = F.pmod(v, F.lit(k))
    tail = bits(r, b) if short in (0, 1 << b) else F.when(r < short, bits(r, b - 1)).otherwise(bits(r + short, b))
    return F.concat(F.repeat(F.lit("0"), F.floor(v / k).cast("int")), F.lit("1"), tail if b else F.lit(""))

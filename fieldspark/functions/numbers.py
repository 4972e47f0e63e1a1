"""Decimal rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import col


def round_to(c, digits: int) -> Column:
    """Nearest decimal, ties to even, judged on the double's exact value.

    ``round`` works on the shortest decimal text instead, so 0.285 becomes 0.29 there
    and 0.28 here. The distance to the midpoint is summed over the binary digits of
    the scale, largest first; every partial sum is exact.
    """
    x = col(c)
    scale = 10**digits
    n = F.floor(x * F.lit(float(scale))).cast("double")
    gap = -(n * 2 + 1)
    for k in range((2 * scale).bit_length() - 1, -1, -1):
        if 2 * scale >> k & 1:
            gap = gap + x * F.lit(float(1 << k))
    up = F.signum(gap) + F.abs(n % 2) * 0.5 > 0
    return (n + up.cast("double")) / F.lit(float(scale))

"""Rounding to two decimals, half to even on the exact binary value."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1 splits a double into two halves whose products with small integers are exact.
_SPLIT = 134217729.0


def round2(value: Column) -> Column:
    """Two-decimal rounding that treats ``2.675`` as the double just below the tie it is.

    Spark's ``round`` and ``bround`` work on the shortest decimal text of a double, so both
    misjudge such values. Only within a hair of a tie is the sign of ``200*value - (2k+1)``
    worked out exactly. Meant for non-negative scores.
    """
    scaled = value * F.lit(100.0)
    below = F.floor(scaled)
    excess = scaled - below
    upper = value * F.lit(_SPLIT) - (value * F.lit(_SPLIT) - value)
    residue = (upper * F.lit(200.0) - (below * 2 + 1)) + (value - upper) * F.lit(200.0)
    tie_goes_up = (residue > 0) | ((residue == 0) & (below % 2 == 1))
    near_tie = F.abs(excess - F.lit(0.5)) < F.lit(1e-6)
    up = F.when(near_tie, tie_goes_up).otherwise(excess > F.lit(0.5))
    return (below + F.when(up, F.lit(1)).otherwise(F.lit(0))) / F.lit(100.0)

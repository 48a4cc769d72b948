"""Tail probabilities, intervals and information criteria."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def _erfc(x: Column) -> Column:
    @F.pandas_udf("double")
    def erfc(v: pd.Series) -> pd.Series:
        return pd.Series([math.erfc(a) for a in v.astype("float64")])

    return erfc(x)


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-square with 1 or 2 degrees of freedom; 1 at or below 0, null for null."""
    v = F.greatest(x.cast("double"), F.lit(0.0))  # greatest skips nulls, hence the test on x
    if df == 2:
        return F.when(x.isNotNull(), F.exp(-v / 2))
    if df == 1:
        return F.when(x.isNotNull(), _erfc(F.sqrt(v / 2)))
    raise ValueError("1 or 2 degrees of freedom")


# Fixed value: the normal quantile of a 95 percent interval.
Z95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z95, one_root: bool = True) -> Column:
    """``low, high`` of the continuity-corrected Wilson interval; null for n = 0.

    ``one_root`` uses the lower bound's root for both bounds, as the known
    results do; without it the upper bound has its own.
    """
    s, n = successes.cast("double"), n.cast("double")
    p = s / F.when(n > 0, n)
    d = 2 * (n + z * z)
    inner = z * z - 1 / n + 4 * n * p * (1 - p)
    root = lambda c: z * F.sqrt(F.greatest(inner + c, F.lit(0.0))) + 1
    low = (2 * n * p + z * z - root(4 * p - 2)) / d
    high = (2 * n * p + z * z + root(4 * p - 2 if one_root else 2 - 4 * p)) / d
    return F.when(n > 0, F.struct(F.greatest(low, F.lit(0.0)).alias("low"), F.least(high, F.lit(1.0)).alias("high")))


def aic(ll: Column, k: Column) -> Column:
    return 2 * k - 2 * ll


def bic(ll: Column, k: Column, n: Column) -> Column:
    return k * F.ln(n) - 2 * ll


def nlogn(n: Column) -> Column:
    """n log n with 0 log 0 = 0."""
    return F.when(n > 0, n * F.ln(n)).otherwise(0.0)


def five_numbers(x: Column) -> Column:
    """Aggregate: minimum, quartiles and maximum of the non-null values, exact (linear between ranks)."""
    q = F.percentile(x, F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return F.struct(*[q[i].alias(n) for i, n in enumerate(["low", "q25", "median", "q75", "high"])])

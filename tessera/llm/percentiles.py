"""Percentiles of very large columns from mergeable compactor sketches.

A sketch is a hierarchy of randomised compactors: a full level is sorted, every
other value is kept at random and passed on with doubled weight.  Two sketches
merge level by level, so sketches of partitions, loads or days combine into
the sketch of the whole.  Spark's KLL aggregates implement this in the JVM
with map-side partial sketches; a sketch of ``k`` has a rank error of about
``2.3 / k**0.9`` with 99 percent probability, whatever the number of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_K = 800


def rank_error(k: int = DEFAULT_K) -> float:
    """Rank error (as a fraction) that one quantile meets with 99 percent probability."""
    return 2.296 / k**0.9021


def _family(df: DataFrame, value: str) -> str:
    kind = df.schema[value].dataType.simpleString()
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "double"


def sketch(df: DataFrame, groups: list[str], value: str, k: int = DEFAULT_K) -> DataFrame:
    """``groups + n_values, sketch`` per group; null and NaN values are left out.

    A group with no value has no row; null group values form a group; repeated
    rows count each time.  A hot group is sketched in every input split first,
    so only sketches of bounded size reach its final task.
    """
    kind = _family(df, value)
    v = F.col(f"`{value}`")
    ok = v.isNotNull() if kind == "bigint" else v.isNotNull() & ~F.isnan(v.cast("double"))
    agg = getattr(F, f"kll_sketch_agg_{kind}")
    return df.where(ok).groupBy(*groups).agg(F.count("*").alias("n_values"), agg(v.cast(kind), F.lit(k)).alias("sketch"))


def merge(sketches: DataFrame, groups: list[str], kind: str = "bigint", k: int = DEFAULT_K) -> DataFrame:
    """Combine sketches of separate loads level by level into one per group."""
    agg = getattr(F, f"kll_merge_agg_{kind}")
    return sketches.groupBy(*groups).agg(F.sum("n_values").alias("n_values"), agg(F.col("sketch"), F.lit(k)).alias("sketch"))


def quantile(fraction: float, kind: str = "bigint", column: str = "sketch") -> Column:
    """The value at ``fraction`` of the ranks (from 0 to 1)."""
    return getattr(F, f"kll_sketch_get_quantile_{kind}")(F.col(column), F.lit(float(fraction)))


def rank(value: Column, kind: str = "bigint", column: str = "sketch") -> Column:
    """The fraction of values not above ``value``."""
    return getattr(F, f"kll_sketch_get_rank_{kind}")(F.col(column), value)


def percentiles(sketches: DataFrame, groups: list[str], fractions: dict[str, float], kind: str = "bigint") -> DataFrame:
    """One column per named fraction, beside the groups and the number of values."""
    return sketches.select(*groups, "n_values", *[quantile(q, kind).alias(name) for name, q in fractions.items()])

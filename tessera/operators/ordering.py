"""Global order without a single-task window: prefix sums, ranks and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.storage import stage


def prefix_sums(df: DataFrame, order: list, values: list[str], by_partitions: int | None = None) -> DataFrame:
    """Adds ``cum_<value>``: sums over all rows up to this one in a total order.

    Rows are range-partitioned by the order; each part's totals (one row per
    part) give the offsets of the next, and the running sum is local to a part.
    The order should be total, or equal rows share an arbitrary but valid order.
    """
    n = by_partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = stage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "prefix")
    totals = r.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])  # at most n rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(F.broadcast(offsets), "_part")
    return out.withColumns({f"cum_{v}": F.sum(v).over(w) + F.col(f"_o_{v}") for v in values}).drop("_part", *[f"_o_{v}" for v in values])


def row_index(df: DataFrame, order: list, name: str = "row_no") -> DataFrame:
    """Adds a gapless number from 0 in a global order."""
    out = prefix_sums(df.withColumn("_one", F.lit(1).cast("bigint")), order, ["_one"])
    return out.withColumn(name, F.col("cum__one") - 1).drop("_one", "cum__one")


def _random(key, seed: int):
    return F.xxhash64(*key, F.lit(seed))


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by key and seed: the smallest hashes, taken as a distributed top-k."""
    return df.withColumn("_h", _random(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h")


def stratified_sample(df: DataFrame, stratum: str, keys: list[str], n: int, seed: int = 1, parts: int = 64) -> DataFrame:
    """Up to ``n`` rows of every stratum; each stratum is thinned in ``parts`` pieces before it meets itself."""
    h = df.withColumn("_h", _random(keys, seed)).withColumn("_p", F.pmod(F.col("_h"), F.lit(parts)))
    first = Window.partitionBy(stratum, "_p").orderBy("_h", *keys)
    last = Window.partitionBy(stratum).orderBy("_h", *keys)
    thin = h.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    return thin.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_h", "_p", "_r")


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 1) -> DataFrame:
    """All rows in a reproducible random order."""
    return df.withColumn("_h", _random(keys, seed)).orderBy("_h", *keys).drop("_h")


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of every group; Spark keeps only n per group before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_per_group(df, keys, order, 1)

"""Comparison of metrics with known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.ordering import prefix_sums


def truth_left(metric: DataFrame, truth: DataFrame, on: list[str], labels: list[str], fill: bool = True) -> DataFrame:
    """Metric rows with their truth labels; rows unknown to the truth get 0 (or null)."""
    j = metric.join(truth.select(*on, *labels), on, "left")
    return j.na.fill(0, subset=labels) if fill else j


def truth_right(truth: DataFrame, metric: DataFrame, on: list[str], scores: list[str]) -> DataFrame:
    """Truth rows with the metric's scores, null where no metric exists."""
    return truth.join(metric.select(*on, *scores), on, "left")


def truth_full(metric: DataFrame, truth: DataFrame, on: list[str], scores: list[str]) -> DataFrame:
    """Full join; minus infinity becomes the least finite score, then nulls become 0."""
    bad = float("-inf")
    low = metric.agg(*[F.min(F.when(F.col(s) != bad, F.col(s))).alias(f"_low_{s}") for s in scores])
    m = metric.crossJoin(F.broadcast(low))  # one row
    m = m.withColumns({s: F.when(F.col(s) == bad, F.col(f"_low_{s}")).otherwise(F.col(s)) for s in scores}).drop(*[f"_low_{s}" for s in scores])
    return m.join(truth, on, "full").na.fill(0)


def compare_methods(a: DataFrame, b: DataFrame, on: list[str], score: str) -> DataFrame:
    """Scores of two methods side by side, by key instead of by row position."""
    return a.select(*on, F.col(score).alias("score_1")).join(b.select(*on, F.col(score).alias("score_2")), on)


def correlation(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.corr("score_1", "score_2").alias("correlation"), F.count("*").alias("n"))


def precision_recall(df: DataFrame, score: str, truth: str, threshold: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision and recall of ``score > threshold``; null where undefined."""
    hit, is_ = F.col(score) > threshold, F.col(truth) == 1
    g = df.groupBy(*(by or [])).agg(F.count_if(hit & is_).alias("tp"), F.count_if(hit & ~is_).alias("fp"), F.count_if(~hit & is_).alias("fn"), F.count_if(~hit & ~is_).alias("tn"))
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b))
    return g.withColumn("precision", ratio(F.col("tp"), F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("fn")))


def pr_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One point per distinct score, from the highest: ``score, hits, tp, n, precision, recall``.

    Rows are counted per score first; the running sums over scores are
    distributed (see :func:`prefix_sums`).
    """
    g = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).alias("score")).agg(F.sum((F.col(truth) == 1).cast("bigint")).alias("p"), F.count("*").alias("n"))
    c = prefix_sums(g, [F.desc("score")], ["p", "n"])
    total = g.agg(F.sum("p").alias("_t"))
    return c.crossJoin(F.broadcast(total)).select("score", F.col("p").alias("hits"), F.col("cum_p").alias("tp"), F.col("cum_n").alias("n"), (F.col("cum_p") / F.col("cum_n")).alias("precision"), F.when(F.col("_t") > 0, F.col("cum_p") / F.col("_t")).alias("recall"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Area under the step curve: each score's share of the positives times its precision."""
    return curve.agg((F.sum(F.col("hits") * F.col("precision")) / F.max("tp")).alias("average_precision"))


def truth_tables(haplotypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels per individual and per site from the four haplotype bases.

    ``haplotypes`` has ``genotype, position, a1, a2, b1, b2``.  A site is
    homoeologous if every individual is homozygous in both subgenomes with
    different bases, and allelic in a subgenome if more than one base occurs.
    """
    het_a, het_b = F.col("a1") != F.col("a2"), F.col("b1") != F.col("b2")
    homeo = ~het_a & ~het_b & (F.col("a1") != F.col("b1"))
    per = haplotypes.select("genotype", "position", het_a.cast("int").alias("truth_het_a"), het_b.cast("int").alias("truth_het_b"), homeo.cast("int").alias("truth_homeo"))

    def many(s: str) -> Column:
        return (F.greatest(F.max(f"{s}1"), F.max(f"{s}2")) != F.least(F.min(f"{s}1"), F.min(f"{s}2"))).cast("int")

    same = F.min(homeo.cast("int"))
    one = (1 - many("a")) * (1 - many("b"))
    site = haplotypes.groupBy("position").agg((same * one).alias("truth_homeo"), many("a").alias("truth_a"), many("b").alias("truth_b"))
    return per, site

"""Read likelihoods under each subgenome, and their posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import seq


def with_emission(bases: DataFrame, ref: str = "ref_base", out: str = "logp", table: DataFrame | None = None) -> DataFrame:
    """Adds the log emission of each base given ``ref``.

    Without a table the literal error model is used.  ``table`` is an error
    table ``q, true_base, pos, read_base, prob`` with 1-based positions; the
    first row of a key wins, a missing key has log probability 0 and
    probability 0 counts as the smallest positive double.
    """
    if table is None:
        return bases.withColumn(out, seq.emit_logp(F.col(ref), F.col("base"), F.col("q")))
    t = error_table(table)
    j = bases.join(t, (bases["q"] == t["_tq"]) & (F.col(ref) == t["_tt"]) & (bases["base"] == t["_tr"]) & (bases["rd_idx"] == t["_tp"]), "left")
    return j.withColumn(out, F.coalesce("_tl", F.lit(0.0))).drop("_tq", "_tt", "_tr", "_tp", "_tl")


def error_table(table: DataFrame) -> DataFrame:
    """Keyed log probabilities of an error table; ``row_no`` (if present) decides duplicates."""
    order = F.col("row_no") if "row_no" in table.columns else F.lit(0)
    g = table.groupBy(F.col("q").alias("_tq"), F.col("true_base").alias("_tt"), F.col("read_base").alias("_tr"), (F.col("pos") - 1).alias("_tp"))
    p = F.min(F.struct(order.alias("o"), F.col("prob").alias("p")))["p"]
    return g.agg(F.ln(F.greatest(p, F.lit(2.2250738585072014e-308))).alias("_tl"))


def log_likelihood(bases: DataFrame, keys: list[str], by: str = "sg") -> DataFrame:
    """Summed log emissions of a read: ``keys, ll_a, ll_b`` in one aggregation."""
    pick = lambda s: F.sum(F.when(F.col(by) == s, F.col("logp")))
    return bases.groupBy(*keys).agg(pick("A").alias("ll_a"), pick("B").alias("ll_b"))


def posterior_a(a: Column, b: Column) -> Column:
    """Posterior of subgenome A: the softmax of two log-likelihoods, without overflow."""
    return F.when(a >= b, 1 / (1 + F.exp(b - a))).otherwise(F.exp(a - b) / (1 + F.exp(a - b)))


def read_posteriors(ll: DataFrame, min_loglik: float | None = None, min_posterior: float = 0.0) -> DataFrame:
    """Adds ``pp_a``; drops reads below the log-likelihood or posterior limit."""
    out = ll.where(F.col("ll_a").isNotNull() & F.col("ll_b").isNotNull()).withColumn("pp_a", posterior_a(F.col("ll_a"), F.col("ll_b")))
    if min_loglik is not None:
        out = out.where(F.greatest("ll_a", "ll_b") >= min_loglik)
    if min_posterior > 0:
        out = out.where(F.greatest(F.col("pp_a"), 1 - F.col("pp_a")) >= min_posterior)
    return out


def expected_coverage(pp: DataFrame, keys: list[str]) -> DataFrame:
    """Expected reads of each subgenome and the smaller of the two."""
    g = pp.groupBy(*keys).agg(F.count("*").alias("n_reads"), F.sum("pp_a").alias("cov_a"))
    return g.withColumn("cov_b", F.col("n_reads") - F.col("cov_a")).withColumn("min_cov", F.least("cov_a", "cov_b"))


def loglik_quantiles(ll: DataFrame, keys: list[str]) -> DataFrame:
    """Seven quantiles of the best log-likelihood, exact.

    Equal values are counted first, so a key moves its distinct values; the
    values at the wanted ranks are picked from running counts, which sort with
    spilling and hold no key in memory.
    """
    qs = {"q0": 0.0, "q025": 0.025, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q975": 0.975, "q1": 1.0}
    n = ll.groupBy(*keys, F.greatest("ll_a", "ll_b").alias("_l")).agg(F.count("*").alias("_k")).where("_l is not null")
    w = Window.partitionBy(*keys)
    n = n.withColumn("_to", F.sum("_k").over(w.orderBy("_l"))).withColumn("_n", F.sum("_k").over(w))
    at = {k: F.least(F.floor(F.col("_n") * q) + 1, F.col("_n")) for k, q in qs.items()}
    return n.groupBy(*keys).agg(*[F.max(F.when((F.col("_to") - F.col("_k") < r) & (r <= F.col("_to")), F.col("_l"))).alias(k) for k, r in at.items()])


def error_observations(bases: DataFrame, deleted: DataFrame | None = None, errors_only: bool = False) -> DataFrame:
    """One row per base: read position, reference base, quality, read base and log probability.

    A column ``hard_clip`` of ``bases`` shifts the read position by the bases
    clipped away before it.  ``deleted`` (``rd_idx, ref_base``: the base before
    the gap and the reference base without a read base) gives rows of quality
    -1 and base ``-``.  ``errors_only`` keeps the bases that differ.
    """
    shift = lambda d: F.col("rd_idx") + (F.coalesce("hard_clip", F.lit(0)) if "hard_clip" in d.columns else 0)
    out = bases.select(shift(bases).alias("read_pos"), F.col("ref_base"), F.col("q").alias("qual"), F.col("base").alias("read_base"), "logp")
    if deleted is not None:
        gap = deleted.select(shift(deleted).alias("read_pos"), "ref_base", F.lit(-1).alias("qual"), F.lit("-").alias("read_base"), F.lit(None).cast("double").alias("logp"))
        out = out.unionByName(gap)
    return out.where("ref_base <> read_base") if errors_only else out

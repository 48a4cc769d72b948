"""Per-site pileup, screens and the nine-genotype kernel.

A pileup row is one read base at one homoeologous site: ``site keys, base, q,
ll_a, ll_b, ref_a, ref_b``.  The likelihoods are those of the whole read;
subtracting the site's own emission leaves the read without this site, so
every site costs one pass over its bases.  The nine genotypes are nine sums of
one aggregation, not a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import seq
from tessera.operators.likelihood import posterior_a

GENOTYPES = [(a, b) for a in range(3) for b in range(3)]


def without_site(p: DataFrame, prefix: str = "") -> DataFrame:
    """Adds ``rest_a, rest_b``: read log-likelihoods without this site's base.

    ``base_a`` is the base as A reads it (equal to ``base`` unless B is
    reverse-complemented, where ``base_b`` is the complement).
    """
    base_b = F.col("base_b") if "base_b" in p.columns else F.col("base")
    return p.withColumn("rest_a", F.col("ll_a") - seq.emit_logp(F.col("ref_a"), F.col("base"), F.col("q"))).withColumn(
        "rest_b", F.col("ll_b") - seq.emit_logp(F.col("ref_b"), base_b, F.col("q"))
    )


def expected_counts(p: DataFrame, keys: list[str], weight: Column | None = None, counts: list[Column] | None = None) -> DataFrame:
    """Expected count of every base in each subgenome, leaving the site's own base out of the weight.

    ``ea_a .. ea_g`` and ``eb_a .. eb_g``, their sums ``cov_a, cov_b`` and modes
    ``mode_a, mode_b`` (ties in allele order).  ``counts`` are further
    aggregates to compute in the same pass.
    """
    w = weight if weight is not None else posterior_a(F.col("rest_a"), F.col("rest_b"))
    q = (p if weight is not None else without_site(p)).withColumn("_w", w)
    aggs = []
    for side, v in (("a", F.col("_w")), ("b", 1 - F.col("_w"))):
        aggs += [F.sum(F.when(F.col("base") == x, v).otherwise(0.0)).alias(f"e{side}_{x.lower()}") for x in seq.BASES]
        aggs.append(F.sum(v).alias(f"cov_{side}"))
    g = q.groupBy(*keys).agg(F.count("*").alias("n_cover"), *aggs, *(counts or []))
    for side in "ab":
        best = F.greatest(*[F.col(f"e{side}_{x.lower()}") for x in seq.BASES])
        mode = F.coalesce(*[F.when(F.col(f"e{side}_{x.lower()}") == best, x) for x in seq.BASES])
        g = g.withColumn(f"mode_{side}", mode)
    return g


def _count_bases() -> list[Column]:
    return [F.count_if(F.col("base") == x).alias(f"n_{x.lower()}") for x in seq.BASES]


def base_counts(p: DataFrame, keys: list[str]) -> DataFrame:
    """Number of each base at every site."""
    return p.groupBy(*keys).agg(*_count_bases())


def top_alleles(counts: DataFrame) -> DataFrame:
    """Adds the three most frequent bases ``nuc1..3`` with counts, ties in allele order.

    A site with one base only gets a stand-in second allele: C if the base is
    A, else A (``no_alt`` is then true).
    """
    ranked = F.array(*[F.struct((-F.col(f"n_{x.lower()}")).alias("neg"), F.lit(i).alias("rank"), F.lit(x).alias("base")) for i, x in enumerate(seq.BASES)])
    out = counts.withColumn("_r", F.array_sort(ranked))
    for i in (1, 2, 3):
        out = out.withColumn(f"nuc{i}", F.col("_r")[i - 1]["base"]).withColumn(f"num{i}", -F.col("_r")[i - 1]["neg"])
    return out.withColumn("no_alt", F.col("num2") == 0).drop("_r")


def biallelic(sites: DataFrame, fraction: float = 0.5, coverage: str = "min_cov") -> DataFrame:
    """Adds ``third_allele``: whether the third base exceeds its share of half the smaller coverage."""
    return sites.withColumn("third_allele", F.col("num3") > fraction * F.col(coverage) / 2)


def low_coverage(least: float = 0.9) -> Column:
    """Whether a subgenome's coverage of the site is below a share of its expected coverage of the region."""
    return (F.col("cov_a") < least * F.col("region_cov_a")) | (F.col("cov_b") < least * F.col("region_cov_b"))


def coverage_screen(sites: DataFrame, least: float = 0.9) -> DataFrame:
    """Sites whose coverage is at least a share of the region's expected coverage, in both subgenomes."""
    return sites.where(~low_coverage(least))


def covered(sites: DataFrame) -> DataFrame:
    """Sites with reads and with expected coverage in both subgenomes."""
    return sites.where("n_cover > 0 and cov_a > 0 and cov_b > 0")


def _emit(g: int, base: Column) -> Column:
    if g == 0:
        return seq.emit_logp(F.col("nuc1"), base, F.col("q"))
    if g == 2:
        return seq.emit_logp(F.col("nuc2"), base, F.col("q"))
    return seq.emit_logp_het(F.col("nuc1"), F.col("nuc2"), base, F.col("q"))


def genotype_likelihoods(p: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lp_00 .. lp_22``: log-likelihood of every genotype pair.

    ``p`` has the pileup columns plus ``nuc1, nuc2`` of its site.  Each base
    contributes log(exp(rest_a + e_g1) + exp(rest_b + e_g2)).
    """
    q = without_site(p)
    q = q.withColumns({f"_a{g}": F.col("rest_a") + _emit(g, F.col("base")) for g in range(3)} | {f"_b{g}": F.col("rest_b") + _emit(g, F.col("base")) for g in range(3)})
    return q.groupBy(*keys).agg(*[F.sum(seq.log_sum_exp(F.col(f"_a{a}"), F.col(f"_b{b}"))).alias(f"lp_{a}{b}") for a, b in GENOTYPES])


def posteriors(lik: DataFrame) -> DataFrame:
    """Adds ``pp_00 .. pp_22`` under a uniform prior, shifted by the greatest likelihood."""
    # arrays keep the generated code of the nine-fold expressions small
    lp = F.array(*[F.col(f"lp_{a}{b}") for a, b in GENOTYPES])
    e = F.transform(lp, lambda x: F.exp(x - F.array_max(F.col("_l"))))
    out = lik.withColumn("_l", lp).withColumn("_e", e)
    out = out.withColumn("_p", F.transform("_e", lambda x: x / F.aggregate(F.col("_e"), F.lit(0.0), lambda s, y: s + y)))
    return out.withColumns({f"pp_{a}{b}": F.col("_p")[i] for i, (a, b) in enumerate(GENOTYPES)}).drop("_l", "_e", "_p")


def marginals(pp: DataFrame) -> DataFrame:
    """Adds ``pa_0..2, pb_0..2`` and the heterozygote posteriors ``het_a, het_b``."""
    cols = {}
    for i in range(3):
        cols[f"pa_{i}"] = F.col(f"pp_{i}0") + F.col(f"pp_{i}1") + F.col(f"pp_{i}2")
        cols[f"pb_{i}"] = F.col(f"pp_0{i}") + F.col(f"pp_1{i}") + F.col(f"pp_2{i}")
    return pp.withColumns(cols).withColumn("het_a", F.col("pa_1")).withColumn("het_b", F.col("pb_1"))


def call(pp: DataFrame) -> DataFrame:
    """Adds the called pair ``g1, g2`` and its posterior; ties go to the earlier pair."""
    best = F.array_max(F.array(*[F.struct(F.col(f"pp_{a}{b}").alias("p"), F.lit(-i).alias("o"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(GENOTYPES)]))
    return pp.withColumn("_c", best).withColumns({"g1": F.col("_c.a"), "g2": F.col("_c.b"), "pp_call": F.col("_c.p")}).drop("_c")


def call_letters(df: DataFrame) -> DataFrame:
    """Adds ``call_a, call_b`` and ``genotype_call`` as letters, e.g. ``AA/AC``."""

    def text(g: str) -> Column:
        first = F.when(F.col(g) < 2, F.col("nuc1")).otherwise(F.col("nuc2"))
        second = F.when(F.col(g) > 0, F.col("nuc2")).otherwise(F.col("nuc1"))
        return F.concat(first, second)

    return df.withColumn("call_a", text("g1")).withColumn("call_b", text("g2")).withColumn("genotype_call", F.concat_ws("/", "call_a", "call_b"))


def genotype_quality(error: Column) -> Column:
    """Phred quality of an error probability, from 0 to 99."""
    return F.when(error > 0, F.least(F.lit(99), F.floor(-10 * F.log10(error)).cast("int"))).otherwise(99)


def site_table(p: DataFrame, keys: list[str], fraction: float = 0.5, regions: DataFrame | None = None, plain: bool = False, extra: list[Column] | None = None) -> DataFrame:
    """One row per site: expected counts, alleles and ``third_allele``, in one aggregation.

    ``regions`` (some of the keys, ``region_cov_a, region_cov_b``) holds the
    expected coverage of the region, whose smaller one judges a third allele
    (default: the site's own).  ``plain`` weights a base by its whole read
    (``pp_a``) instead of the read without the site.  ``extra`` are further
    aggregates of the same pass.
    """
    counts = [*_count_bases(), *(extra or [])]
    s = top_alleles(expected_counts(without_site(p), keys, F.col("pp_a"), counts) if plain else expected_counts(p, keys, counts=counts))
    if regions is not None:
        s = s.join(regions, [k for k in keys if k in regions.columns]).withColumn("min_cov", F.least("region_cov_a", "region_cov_b"))
    else:
        s = s.withColumn("min_cov", F.least("cov_a", "cov_b"))
    return biallelic(s, fraction)


def call_table(p: DataFrame, keys: list[str], sites: DataFrame) -> DataFrame:
    """Posteriors, marginals and call of the covered sites of ``sites`` without a third allele."""
    sites = covered(sites).where("not third_allele")
    lik = genotype_likelihoods(p.join(sites.select(*keys, "nuc1", "nuc2"), keys), keys)
    return call_letters(call(marginals(posteriors(lik))).join(sites.drop("third_allele"), keys))


def call_sites(p: DataFrame, keys: list[str], fraction: float = 0.5) -> DataFrame:
    """Everything per site: expected counts, alleles, screens, posteriors, marginals and call.

    Two aggregations on the same keys; the second joins the small per-site
    table back.  Sites without reads, without expected coverage in a subgenome
    or with a third allele are left out.
    """
    return call_table(p, keys, site_table(p, keys, fraction))

"""Heterozygosity and SNP metrics across individuals, in their named variants.

An info row has ``genotype, chrom_a, chrom_b, position_a, position_b,
genotype_call (AA/CC), major, minor, pp_00..pp_22, pa_0..2, pb_0..2, cov_a,
cov_b``.  The variants differ on purpose and are not merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SITE = ["position_a", "position_b", "chrom_a", "chrom_b"]
PP = [f"pp_{a}{b}" for a in range(3) for b in range(3)]
LETTERS = ["A", "C", "G", "T"]


def log(x: Column) -> Column:
    """Natural logarithm with minus infinity for 0."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf")))


def logged(info: DataFrame) -> DataFrame:
    """All posteriors as logarithms."""
    return info.withColumns({c: log(F.col(c)) for c in [*PP, *[f"p{s}_{i}" for s in "ab" for i in range(3)]]})


def het_metric(info: DataFrame) -> DataFrame:
    """Log odds of a heterozygote in each subgenome: log P(1) - max(log P(0), log P(2))."""
    return info.withColumns({f"pp_het_{s}": log(F.col(f"p{s}_1")) - F.greatest(log(F.col(f"p{s}_0")), log(F.col(f"p{s}_2"))) for s in "ab"})


def _letter_count(x: str) -> Column:
    return F.sum(F.length("genotype_call") - F.length(F.replace(F.col("genotype_call"), F.lit(x), F.lit(""))))


def _pick(ranked: Column) -> dict[str, Column]:
    """``n1, n2, n_alleles`` from letters ranked in an array of structs with ``letter``."""
    n1 = F.try_element_at(ranked, F.lit(1))["letter"]
    stand_in = F.when(n1 == "A", "C").otherwise("A")
    return {"n_alleles": F.size(ranked), "n1": n1, "n2": F.coalesce(F.try_element_at(ranked, F.lit(2))["letter"], stand_in)}


def alleles_by_frequency(info: DataFrame, site: list[str] = SITE) -> DataFrame:
    """Distinct letters and the two most frequent ones per site; ties alphabetical."""
    g = info.groupBy(*site).agg(*[_letter_count(x).alias(x) for x in LETTERS], F.avg("cov_a").alias("mean_a"), F.avg("cov_b").alias("mean_b"))
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(x)).alias("neg"), F.lit(x).alias("letter")) for x in LETTERS]), lambda v: v["neg"] < 0))
    return g.withColumn("_r", ranked).withColumns(_pick(F.col("_r"))).drop("_r", *LETTERS)


def alleles_by_order(info: DataFrame, site: list[str], order: str = "genotype", call: str = "genotype_call") -> DataFrame:
    """The same with letters in the order they are first seen, individuals sorted by ``order``."""
    seen = [F.min(F.when(F.instr(F.col(call), x) > 0, F.struct(F.col(order), F.instr(F.col(call), x)))).alias(x) for x in LETTERS]
    g = info.groupBy(*site).agg(*seen, F.avg("cov_a").alias("mean_a"), F.avg("cov_b").alias("mean_b"))
    ranked = F.array_sort(F.filter(F.array(*[F.struct(F.col(x).alias("at"), F.lit(x).alias("letter")) for x in LETTERS]), lambda v: v["at"].isNotNull()))
    return g.withColumn("_r", ranked).withColumns(_pick(F.col("_r"))).drop("_r", *LETTERS)


def _site_metrics(d: DataFrame, site: list[str], other) -> DataFrame:
    """Sums over individuals of rows that carry their site's ``n1, n2``."""
    is_ = lambda c, n: F.col(c) == F.col(n)
    low, top = F.least(*[F.col(c) for c in PP]), F.greatest(*[F.col(c) for c in PP])

    def homeo(x: str, y: str) -> Column:
        v = F.when(is_("major", x) & is_("minor", y), F.col("pp_02")).when(is_("major", y) & is_("minor", x), F.col("pp_20")).otherwise(low)
        return F.sum(v - top)

    def homo(s: str, n: str, m: str) -> Column:
        p = [F.col(f"p{s}_{i}") for i in range(3)]
        return F.sum(F.when(is_("major", n), p[0]).when(is_("minor", n), p[2]).otherwise(other(s, m, p)) - F.greatest(*p))

    aggs = [homeo("n1", "n2").alias("_h1"), homeo("n2", "n1").alias("_h2")]
    aggs += [homo(s, n, m).alias(f"_{s}{n}") for s in "ab" for n, m in (("n1", "n2"), ("n2", "n1"))]
    aggs += [F.max("n_alleles").alias("biallelic"), F.max("mean_a").alias("cov_a"), F.max("mean_b").alias("cov_b")]
    g = d.groupBy(*site).agg(*aggs)
    return g.select(*site, "biallelic", F.greatest("_h1", "_h2").alias("pp_homeo"), (-F.greatest("_an1", "_an2")).alias("pp_homo_a"), (-F.greatest("_bn1", "_bn2")).alias("pp_homo_b"), "cov_a", "cov_b")


def snp_metrics(info: DataFrame) -> DataFrame:
    """Homoeologous and allelic SNP metrics of real data, one row per site.

    An individual whose alleles don't fit the site's pair counts with its least
    posterior.  ``biallelic`` is the number of distinct letters.
    """
    d = logged(info).drop("cov_a", "cov_b").join(alleles_by_frequency(info), SITE)
    return _site_metrics(d, SITE, lambda s, m, p: F.least(*p))


def snp_metrics_simulation(info: DataFrame, site: list[str] | None = None) -> DataFrame:
    """The simulation variant: alleles in the order seen, another default, a biallelic flag."""
    site = site or ["position_a", "position_b"]
    d = logged(info).drop("cov_a", "cov_b").join(alleles_by_order(info, site), site)
    out = _site_metrics(d, site, lambda s, m, p: F.when(F.col("major") == F.col(m), p[2]).otherwise(p[0]))
    return out.withColumn("biallelic", F.col("biallelic") == 2)


def gatk_letters(gatk: DataFrame) -> DataFrame:
    """Adds ``call_a, call_b`` and ``letters``: dosage calls as allele letters.

    A call that is null, missing (``./.``) or needs an absent ALT gives null.
    """
    d = F.split(F.translate(F.trim("genotype_call"), "|", "/"), "/")

    def text(i: int, s: str) -> Column:
        ref, alt, g = F.col(f"ref_{s}_allele"), F.col(f"alt_{s}_allele"), F.get(d, F.lit(i))
        return F.when(g == "0", F.concat(ref, ref)).when(g == "1", F.concat(ref, alt)).when(g == "2", F.concat(alt, alt))

    return gatk.withColumn("call_a", text(0, "a")).withColumn("call_b", text(1, "b")).withColumn("letters", F.concat("call_a", "call_b"))


def gatk_het(gatk: DataFrame, scale: float = 0.1) -> DataFrame:
    """Heterozygosity from genotype likelihoods in Phred: scale * (min(PL0, PL2) - PL1)."""
    return gatk.withColumns({f"pp_het_{s}": scale * (F.least(f"pl{s}_0", f"pl{s}_2") - F.col(f"pl{s}_1")) for s in "ab"})


def gatk_snp_metrics(gatk: DataFrame, site: list[str], scale: float = 0.1, order: str = "genotype") -> DataFrame:
    """SNP metrics from Phred likelihoods of the two subgenomes; smaller sums are better.

    Joint likelihoods add; an individual whose alleles don't fit counts with
    its worst likelihood.  Individuals without a readable call are left out.
    """
    g = gatk_letters(gatk).where("letters is not null").withColumnsRenamed({"cova": "cov_a", "covb": "cov_b"})
    n = alleles_by_order(g, site, order, "letters")
    d = g.drop("cov_a", "cov_b").join(n, site)
    joint = {f"{a}{b}": F.col(f"pla_{a}") + F.col(f"plb_{b}") for a in range(3) for b in range(3)}
    worst = F.greatest(*joint.values())
    ra, rb = F.col("ref_a_allele"), F.col("ref_b_allele")
    n1, n2 = F.col("n1"), F.col("n2")
    fits = [(ra == n1) & (rb == n1), (ra == n1) & (rb == n2), (ra == n2) & (rb == n2), (ra == n2) & (rb == n1)]

    def homeo(names: list[str]) -> Column:
        v = F.when(fits[0], joint[names[0]])
        for f, x in zip(fits[1:], names[1:]):
            v = v.when(f, joint[x])
        return F.sum(v.otherwise(worst))

    def homo(s: str, n: str) -> Column:
        p = [F.col(f"pl{s}_{i}") for i in range(3)]
        v = F.when(F.col(f"ref_{s}_allele") == F.col(n), p[0]).when(F.coalesce(F.col(f"alt_{s}_allele") == F.col(n), F.lit(False)), p[2]).otherwise(F.greatest(*p))
        return F.sum(v)

    out = d.groupBy(*site).agg(
        (-scale * F.least(homeo(["02", "00", "20", "22"]), homeo(["20", "22", "02", "00"]))).alias("pp_homeo"),
        (-scale * F.least(homo("a", "n1"), homo("a", "n2"))).alias("pp_homo_a"),
        (-scale * F.least(homo("b", "n1"), homo("b", "n2"))).alias("pp_homo_b"),
        (F.max("n_alleles") == 2).alias("biallelic"), F.max("mean_a").alias("cov_a"), F.max("mean_b").alias("cov_b"),
    )
    return out


def pooled_metrics(info: DataFrame) -> DataFrame:
    """The pooled variant: p(n1) + p(n2) - p(max) in logs; 0 for one allele, NaN for more than two.

    Alleles are ranked by the number of individuals carrying them, ties
    alphabetical, separately for the joint call and for each subgenome.
    """
    d = info.withColumn("call_a", F.split("genotype_call", "/")[0]).withColumn("call_b", F.split("genotype_call", "/")[1])
    kinds = {"g": "genotype_call", "a": "call_a", "b": "call_b"}
    held = [F.sum(F.when(F.instr(F.col(c), x) > 0, 1).otherwise(0)).alias(f"{k}{x}") for k, c in kinds.items() for x in LETTERS]
    n = d.groupBy(*SITE).agg(*held)
    for k in kinds:
        ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"{k}{x}")).alias("neg"), F.lit(x).alias("letter")) for x in LETTERS]), lambda v: v["neg"] < 0))
        n = n.withColumn("_r", ranked).withColumns({f"{k}_n": F.size("_r"), f"{k}_1": F.try_element_at("_r", F.lit(1))["letter"], f"{k}_2": F.try_element_at("_r", F.lit(2))["letter"]})
    n = n.select(*SITE, *[f"{k}_{x}" for k in kinds for x in ("n", "1", "2")])
    j = d.join(n, SITE)
    zero = F.lit(0.0)
    finite = lambda c: F.when(c == float("-inf"), 0.0).otherwise(c)
    fwd = (F.col("major") == F.col("g_1")) & (F.col("minor") == F.col("g_2"))
    rev = (F.col("major") == F.col("g_2")) & (F.col("minor") == F.col("g_1"))
    l02, l20, top = log(F.col("pp_02")), log(F.col("pp_20")), log(F.greatest(*[F.col(c) for c in PP]))
    aggs = [
        F.sum(F.when(fwd, finite(l02)).when(rev, finite(l20)).otherwise(zero)).alias("h1"),
        F.sum(F.when(fwd, finite(l20)).when(rev, finite(l02)).otherwise(zero)).alias("h2"),
        F.sum(F.when(fwd | rev, top).otherwise(zero)).alias("hm"), F.max("g_n").alias("g_n"), F.max("a_n").alias("a_n"), F.max("b_n").alias("b_n"),
    ]
    for s in "ab":
        p = [log(F.col(f"p{s}_{i}")) for i in range(3)]
        m = log(F.greatest(*[F.col(f"p{s}_{i}") for i in range(3)]))
        one, two = F.col(f"{s}_1"), F.col(f"{s}_2")
        has1, has2 = (one == F.col("major")) | (one == F.col("minor")), (two == F.col("major")) | (two == F.col("minor"))
        aggs.append(F.sum(F.when(~has1, zero).when(one == F.col("minor"), p[2]).otherwise(p[0])).alias(f"{s}1"))
        aggs.append(F.sum(F.when(~has2, zero).when(two == F.col("major"), p[0]).otherwise(p[2])).alias(f"{s}2"))
        aggs.append(F.sum(F.when(~has1 & ~(two == F.col("major")), zero).otherwise(m)).alias(f"{s}m"))
    g = j.groupBy(*SITE).agg(*aggs)
    value = lambda n, x: F.when(F.col(n) == 1, 0.0).when(F.col(n) > 2, float("nan")).otherwise(F.col(f"{x}1") + F.col(f"{x}2") - F.col(f"{x}m"))
    return g.select(*SITE, value("g_n", "h").alias("pp_homeo"), value("a_n", "a").alias("pp_homo_a"), value("b_n", "b").alias("pp_homo_b"))


def info_filter(info: DataFrame, min_coverage: float = 8, test_level: float | None = None) -> DataFrame:
    """Rows covered enough in both subgenomes and, with a level, whose heterozygotes pass the coverage test.

    ``ect_a, ect_b`` are the tests' p-values; a heterozygote without one fails.
    """
    out = info.where((F.col("cov_a") >= min_coverage) & (F.col("cov_b") >= min_coverage))
    if test_level is not None:
        for i, s in enumerate("ab"):
            call = F.split("genotype_call", "/")[i]
            het = F.substring(call, 1, 1) != F.substring(call, 2, 1)
            out = out.where(~het | F.coalesce(F.col(f"ect_{s}") >= test_level, F.lit(False)))
    return out


def confident(info: DataFrame, least: float) -> DataFrame:
    """Rows whose best posterior reaches ``least``."""
    return info.where(F.greatest(*[F.col(c) for c in PP]) >= least)


def site_coverage(info: DataFrame) -> DataFrame:
    """Each row with the mean coverages of its site (joined back, not a window over the group)."""
    m = info.groupBy(*SITE).agg(F.avg("cov_a").alias("mean_cov_a"), F.avg("cov_b").alias("mean_cov_b"))
    return info.join(m, SITE)


def het_table(info: DataFrame) -> DataFrame:
    """Distinct sorted rows of the heterozygosity file, nulls as 0."""
    d = site_coverage(het_metric(info))
    cols = ["position_a", "position_b", "genotype", "chrom_a", "chrom_b", "pp_het_a", "pp_het_b", "mean_cov_a", "mean_cov_b"]
    return d.select(*cols).na.fill(0).dropDuplicates().orderBy("chrom_a", "position_a", "genotype")

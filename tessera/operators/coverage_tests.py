"""Statistical tests on coverage and haplotypes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.functions import stats


def _em(w: np.ndarray, het: tuple[bool, bool], fixed: tuple[bool, bool], eta: float, gamma: list[float], budget: int, eps: float) -> tuple[float, float, list[float], int]:
    """EM over (eta, gamma) for log weights ``w[read, 4]`` of A1, A2, B1, B2; returns ll, eta, gamma, iterations left.

    A homozygous subgenome has one component (the second repeats the first, as
    both emit alike); ``fixed`` holds a subgenome's gamma at one half.
    """
    ll = -np.inf
    gamma = list(gamma)
    while True:
        previous = ll
        parts = []
        for s, share in ((0, eta), (1, 1 - eta)):
            g = 0.5 if fixed[s] else gamma[s]
            split = (g, 1 - g) if het[s] else (1.0, 1.0)
            parts += [share * split[0], share * split[1]]
        with np.errstate(divide="ignore"):
            x = w + np.log(np.maximum(parts, 0.0))
        top = np.maximum(x.max(1, keepdims=True), 0.0)  # kept from below by 0, as in the known results
        e = np.exp(x - top)
        total = e.sum(1)
        if not (total > 0).all():  # weights far below 0: shift by the row's own greatest
            top = x.max(1, keepdims=True)
            e = np.exp(x - top)
            total = e.sum(1)
        pp = e / total[:, None]
        ll = float((np.log(total) + top[:, 0]).sum())
        eta = float(pp[:, :2].sum() / len(w))
        for s in (0, 1):
            if het[s] and not fixed[s]:
                mine = pp[:, 2 * s : 2 * s + 2].sum()
                gamma[s] = float(pp[:, 2 * s].sum() / mine) if mine > 0 else gamma[s]
        budget -= 1
        if budget < 0 or not (ll - previous > -ll * eps):
            return ll, eta, gamma, budget


def equal_coverage(site: pd.DataFrame, max_iter: int = 100, eps: float = 1e-6) -> tuple[float | None, float | None]:
    """p-values of equal homolog coverage in A and B (None where not heterozygous).

    Both hypotheses share one iteration budget, and the restricted fit starts
    from the free one.
    """
    import math

    het = (site["g1"].iloc[0] == 1, site["g2"].iloc[0] == 1)
    if not any(het):
        return None, None
    w = site[["w_a1", "w_a2", "w_b1", "w_b2"]].to_numpy(float)
    start = [site["g1"].iloc[0] / 2.0, site["g2"].iloc[0] / 2.0]
    ll1, eta, gamma, left = _em(w, het, (False, False), 0.5, start, max_iter, eps)
    out: list[float | None] = [None, None]
    for s in (0, 1):
        if het[s]:
            ll0, eta, gamma, left = _em(w, het, (s == 0, s == 1), eta, gamma, left, eps)
            out[s] = math.erfc(math.sqrt(max(2 * (ll1 - ll0), 0.0) / 2))
    return out[0], out[1]


def equal_coverage_test(p: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ect_a, ect_b`` for sites called heterozygous in a subgenome.

    ``p`` holds pileup rows with ``rest_a, rest_b`` and their site's ``nuc1,
    nuc2, g1, g2``.  Emissions are computed in the JVM; only heterozygous sites
    and four numbers per read reach the grouped EM.
    """
    from tessera.functions.seq import emit_logp

    q = p.where("g1 = 1 or g2 = 1")

    def w(rest: str, g: str, second: bool):
        first_allele = F.when(F.col(g) == 0, F.col("nuc1")).when(F.col(g) == 2, F.col("nuc2")).otherwise(F.col("nuc2") if second else F.col("nuc1"))
        return F.col(rest) + emit_logp(first_allele, F.col("base"), F.col("q"))

    q = q.select(*keys, "g1", "g2", w("rest_a", "g1", False).alias("w_a1"), w("rest_a", "g1", True).alias("w_a2"), w("rest_b", "g2", False).alias("w_b1"), w("rest_b", "g2", True).alias("w_b2"))
    types = ", ".join(f"{k} {q.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = equal_coverage(pdf)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ect_a": [np.nan if a is None else a], "ect_b": [np.nan if b is None else b]})

    out = q.groupBy(*keys).applyInPandas(run, f"{types}, ect_a double, ect_b double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ect_a", "ect_b")})


def haplotype_counts(bases: DataFrame, keys: list[str], read: str, order: str) -> DataFrame:
    """Reads per haplotype: the string of a read's bases over the het sites it covers completely.

    ``bases`` holds one row per read and het site with ``n_sites`` of its key.
    """
    h = bases.groupBy(*keys, read).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("base").alias("b")))).alias("_h"), F.max("n_sites").alias("_n"))
    h = h.where(F.size("_h") == F.col("_n")).select(*keys, F.array_join(F.transform("_h", lambda x: x["b"]), "").alias("haplotype"))
    return h.groupBy(*keys, "haplotype").agg(F.count("*").alias("n_reads"))


def haplotype_balance(counts: DataFrame, keys: list[str], z: float = stats.Z95) -> DataFrame:
    """Wilson interval of the larger of the two most frequent haplotypes.

    ``fails`` is true if one half lies outside the interval.
    """
    top = F.slice(F.sort_array(F.collect_list("n_reads"), asc=False), 1, 2)
    g = counts.groupBy(*keys).agg(top.alias("_t"))
    n1, n2 = F.col("_t")[0], F.coalesce(F.try_element_at("_t", F.lit(2)), F.lit(0))
    g = g.select(*keys, n1.alias("n1"), n2.cast("bigint").alias("n2"))
    g = g.withColumn("_w", stats.wilson(F.col("n1"), F.col("n1") + F.col("n2"), z))
    return g.select(*keys, "n1", "n2", F.col("_w.low").alias("low"), F.col("_w.high").alias("high"), ((F.col("_w.low") > 0.5) | (F.col("_w.high") < 0.5)).alias("fails"))


def allele_balance(df: DataFrame, n1: str, n2: str) -> DataFrame:
    """Adds ``chi2`` and ``p_value`` of equal allele counts; null without any."""
    n = F.col(n1) + F.col(n2)
    x = F.when(n > 0, (F.col(n1) - F.col(n2)) * (F.col(n1) - F.col(n2)) / n)
    return df.withColumn("chi2", x).withColumn("p_value", stats.chi2_sf(F.col("chi2"), 1))


def unbalanced_alleles(calls: DataFrame, side: str, level: float = 0.05) -> DataFrame:
    """Heterozygous sites of a subgenome whose commonest allele is not half of its expected coverage.

    Chi-square with one degree of freedom on the share of the modal base.
    """
    share = F.greatest(*[F.col(f"e{side}_{x}") for x in "actg"]) / F.col(f"cov_{side}")
    x = 4 * F.col(f"cov_{side}") * (share - 0.5) * (share - 0.5)
    return calls.where(F.col("g1" if side == "a" else "g2") == 1).withColumn("chi2", x).where(stats.chi2_sf(x, 1) < level)


def haplotype_number(df: DataFrame) -> DataFrame:
    """Likelihood ratios on the four largest clusters ``n1 >= n2 >= n3 >= n4``.

    ``lrt_four``: equal pairs (n1 = n2, n3 = n4, 2 df) against free sizes;
    ``lrt_three_a``: n2 = n3 with n1 twice as large or free; all from closed
    forms of the multinomial.  ``w_four`` and ``w_three`` are the fitted ratios,
    kept in [0.01, 100].
    """
    n = [F.col(f"n{i}").cast("double") for i in range(1, 5)]
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.01)), F.lit(100.0))
    over = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(100.0)
    w4, w3 = clamp(over(n[0] + n[1], n[2] + n[3])), clamp(over(n[0], n[1] + n[2]))
    free4 = sum((stats.nlogn(x) for x in n), F.lit(0.0)) - stats.nlogn(sum(n, F.lit(0.0)))
    pairs = (n[0] + n[1]) * F.ln(w4 / (2 * (1 + w4))) + (n[2] + n[3]) * F.ln(1 / (2 * (1 + w4)))
    t3 = n[0] + n[1] + n[2]
    free3 = sum((stats.nlogn(x) for x in n[:3]), F.lit(0.0)) - stats.nlogn(t3)
    one = n[0] * F.ln(w3 / (1 + w3)) + (n[1] + n[2]) * F.ln(1 / (2 * (1 + w3)))
    equal2 = (n[0] + n[1]) * F.ln(F.lit(0.5))
    free2 = stats.nlogn(n[0]) + stats.nlogn(n[1]) - stats.nlogn(n[0] + n[1])
    out = df.withColumns({"w_four": w4, "w_three": w3, "lrt_four": 2 * (free4 - pairs), "lrt_three": 2 * (free3 - one), "lrt_two": 2 * (free2 - equal2)})
    return out.withColumn("p_four", stats.chi2_sf(F.col("lrt_four"), 2)).withColumn("p_three", stats.chi2_sf(F.col("lrt_three"), 1)).withColumn("p_two", stats.chi2_sf(F.col("lrt_two"), 1))


def haplotype_hypothesis(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds ``state`` and ``p_equal``: how many haplotypes the four largest clusters stand for.

    ``four`` if equal pairs are not rejected (with ``p_equal`` testing equal
    subgenomes), else ``three_a`` (n2 = n3), else ``three_b`` (n1 = n2), else
    ``two``.  Absent clusters have size 0; fewer than four or three clusters
    reject the larger hypotheses.
    """
    n = [F.col(f"n{i}").cast("double") for i in range(1, 5)]
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.01)), F.lit(100.0))
    ratio = lambda a, b: clamp(F.when(b > 0, a / F.when(b > 0, b)).otherwise(100.0))

    def free(k: int):
        return sum((stats.nlogn(x) for x in n[:k]), F.lit(0.0)) - stats.nlogn(sum(n[:k], F.lit(0.0)))

    def four(w):
        return (n[0] + n[1]) * F.ln(w) + (n[0] + n[1] + n[2] + n[3]) * F.ln(0.5 / (1 + w))

    def three(single, x, y, w):
        return single * F.ln(w) + (x + y) * F.ln(F.lit(0.5)) - (single + x + y) * F.ln(1 + w)

    out = df.withColumns({"_w4": ratio(n[0] + n[1], n[2] + n[3]), "_wa": ratio(n[0], n[1] + n[2]), "_wb": ratio(n[2], n[0] + n[1])})
    out = out.withColumns({
        "_p4": F.when(n[3] > 0, stats.chi2_sf(2 * (free(4) - four(F.col("_w4"))), 2)).otherwise(0.0),
        "_pe": stats.chi2_sf(2 * (four(F.col("_w4")) - four(F.lit(1.0))), 1),
        "_pa": F.when(n[2] > 0, stats.chi2_sf(2 * (free(3) - three(n[0], n[1], n[2], F.col("_wa"))), 1)).otherwise(0.0),
        "_pb": F.when(n[2] > 0, stats.chi2_sf(2 * (free(3) - three(n[2], n[1], n[0], F.col("_wb"))), 1)).otherwise(0.0),
    })
    state = F.when(F.col("_p4") >= alpha, "four").when(F.col("_pa") >= alpha, "three_a").when(F.col("_pb") >= alpha, "three_b").otherwise("two")
    return out.withColumn("state", state).withColumn("p_equal", F.when(F.col("state") == "four", F.col("_pe"))).drop("_w4", "_wa", "_wb", "_p4", "_pe", "_pa", "_pb")


# Each hypothesis as two groups of clusters (by size rank) that must be pure and of opposite subgenomes.
_SPLITS = [((1, 2), (3, 4)), ((1, 3), (2, 4)), ((1, 4), (2, 3))]
_PAIRS = [((a,), (b,)) for a in range(1, 5) for b in range(a + 1, 5)]
_TRIPLES = [(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]


def purity_decision(df: DataFrame, alpha: float = 0.05, misalignment: float = 0.3) -> DataFrame:
    """Adds ``decision`` and ``kept``: the clusters (size ranks) that are pure enough to genotype.

    ``df`` has cluster sizes ``n1..n4``, their expected reads of A ``a1..a4``,
    and ``state, p_equal`` of :func:`haplotype_hypothesis`.  A group of clusters
    is pure if its share of A is at least ``0.5 - misalignment`` away from one
    half.  Hypotheses are tried in order; ``refuse`` keeps nothing.
    """
    edge = 0.5 - misalignment

    def off(group: tuple[int, ...]):
        n = sum((F.col(f"n{i}") for i in group), F.lit(0))
        return F.when(n > 0, sum((F.col(f"a{i}") for i in group), F.lit(0.0)) / F.when(n > 0, n) - 0.5).otherwise(0.0)

    pure = lambda g: F.abs(off(g)) >= edge
    opposite = lambda x, y: pure(x) & pure(y) & ((off(x) > 0) != (off(y) > 0))

    def triple(t: tuple[int, ...]):
        signs = [off((i,)) > 0 for i in t]
        rest = next(i for i in range(1, 5) if i not in t)
        return pure((t[0],)) & pure((t[1],)) & pure((t[2],)) & ~pure((rest,)) & ((signs[0] != signs[1]) | (signs[0] != signs[2]))

    unequal = F.coalesce(F.col("p_equal") < alpha, F.lit(False))
    two = [(opposite(*p), "two", p[0] + p[1]) for p in _PAIRS]
    three_b = [(opposite((1, 2), (3,)), "three_b", (1, 2, 3)), two[0]]
    rules = {
        "four_unequal": [(opposite(*_SPLITS[0]), "four", (1, 2, 3, 4)), *three_b],
        "four_equal": [(opposite(*_SPLITS[0]) | opposite(*_SPLITS[1]) | opposite(*_SPLITS[2]), "four", (1, 2, 3, 4)), *[(triple(t), "three_a", t) for t in _TRIPLES], *two],
        "three_a": [(opposite((1,), (2, 3)), "three_a", (1, 2, 3)), two[0], two[1]],
        "three_b": three_b,
        "two": [two[0]],
    }
    state = F.when(F.col("state") != "four", F.col("state")).when(unequal, "four_unequal").otherwise("four_equal")
    value = lambda name, kept: F.struct(F.lit(name).alias("decision"), F.array(*[F.lit(i) for i in kept]).cast("array<int>").alias("kept"))
    out = None
    for key, tests in rules.items():
        for test, name, kept in tests:
            cond = (F.col("_state") == key) & test
            out = F.when(cond, value(name, kept)) if out is None else out.when(cond, value(name, kept))
    return df.withColumn("_state", state).withColumn("_d", out.otherwise(value("refuse", ()))).withColumns({"decision": F.col("_d.decision"), "kept": F.col("_d.kept")}).drop("_d", "_state")


def cluster_purity(assigned: DataFrame, keys: list[str], cluster: str, pp: str = "pp_a") -> DataFrame:
    """Size, proportion of A and rank by size of every cluster (ties by cluster)."""
    from pyspark.sql import Window

    g = assigned.groupBy(*keys, cluster).agg(F.count("*").alias("n_reads"), F.avg(pp).alias("proportion_a"))
    return g.withColumn("size_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_reads"), cluster)))


def purity_class(clusters: DataFrame, misalignment: float = 0.3) -> DataFrame:
    """Adds ``subgenome``: A or B where the proportion clears one half by ``0.5 - misalignment``, else ``mixed``."""
    edge = 0.5 - misalignment
    c = F.when(F.col("proportion_a") >= 0.5 + edge, "A").when(F.col("proportion_a") <= 0.5 - edge, "B").otherwise("mixed")
    return clusters.withColumn("subgenome", c)


def select_chromosomes(clusters: DataFrame, keys: list[str], misalignment: float = 0.3) -> DataFrame:
    """Clusters taken as the chromosomes A1, A2, B1, B2 of a target, at most two of each subgenome, largest first.

    A lone cluster of a subgenome stands for both its chromosomes.  Clusters of
    mixed origin and further ones are ``excluded`` as paralogs.
    """
    from pyspark.sql import Window

    c = purity_class(clusters, misalignment)
    w = Window.partitionBy(*keys, "subgenome").orderBy("size_rank")
    c = c.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "subgenome")))
    name = F.when((F.col("subgenome") == "mixed") | (F.col("_i") > 2), "excluded").when(F.col("_n") == 1, F.concat(F.col("subgenome"), F.lit("1+"), F.col("subgenome"), F.lit("2"))).otherwise(F.concat(F.col("subgenome"), F.col("_i").cast("string")))
    return c.withColumn("chromosome", name).drop("_i", "_n")


def exclude_paralogs(reads: DataFrame, excluded: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Reads outside the excluded clusters."""
    return reads.join(excluded.select(*keys, cluster).distinct(), [*keys, cluster], "left_anti")


def cluster_genotypes(columns: DataFrame, keys: list[str], side: str = "a") -> DataFrame:
    """Genotype of one subgenome per haplotype column from reads assigned by cluster.

    ``columns`` has one row per read and column with ``base, q, nuc1, nuc2``;
    the three genotypes are independent of the other subgenome.
    """
    from tessera.functions.seq import emit_logp, emit_logp_het

    b, q = F.col("base"), F.col("q")
    ll = [F.sum(e) for e in (emit_logp(F.col("nuc1"), b, q), emit_logp_het(F.col("nuc1"), F.col("nuc2"), b, q), emit_logp(F.col("nuc2"), b, q))]
    g = columns.groupBy(*keys).agg(*[x.alias(f"l{i}") for i, x in enumerate(ll)], F.count("*").alias("n_reads"))
    top = F.greatest("l0", "l1", "l2")
    g = g.withColumn("_t", top).withColumns({f"e{i}": F.exp(F.col(f"l{i}") - F.col("_t")) for i in range(3)})
    total = F.col("e0") + F.col("e1") + F.col("e2")
    pp = {f"p{side}_{i}": F.col(f"e{i}") / total for i in range(3)}
    g = g.withColumns(pp)
    best = F.array_max(F.array(*[F.struct(F.col(f"p{side}_{i}").alias("p"), F.lit(-i).alias("o"), F.lit(i).alias("g")) for i in range(3)]))
    return g.withColumn("g", best["g"]).drop("_t", "e0", "e1", "e2")


def read_p_values(observed: DataFrame, simulated: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Share of a key's simulated scores at least as large as each observed one (with one added to both)."""
    both = observed.select(*keys, F.col(score).alias("_s"), F.lit(1).alias("_o")).unionByName(simulated.select(*keys, F.col(score).alias("_s"), F.lit(0).alias("_o")))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("_s")).rangeBetween(Window.unboundedPreceding, 0)
    r = both.withColumn("_ge", F.sum(1 - F.col("_o")).over(w)).withColumn("_n", F.sum(1 - F.col("_o")).over(Window.partitionBy(*keys)))
    return r.where("_o = 1").select(*keys, F.col("_s").alias(score), ((F.col("_ge") + 1) / (F.col("_n") + 1)).alias("p_value"))

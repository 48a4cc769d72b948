"""Haplotype models: evolution from an ancestor, quality-aware clustering, primers, denoising."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.seq import BASES, emit_logp, emit_logp_het
from tessera.operators.simulate import uniform
from tessera.storage import stage


def ancestor(haps: DataFrame) -> DataFrame:
    """``site, base``: most common base over haplotypes (``hap, site, base``), ties in allele order."""
    order = F.array_position(F.array(*[F.lit(b) for b in BASES]), F.col("base"))
    n = haps.groupBy("site", "base").agg(F.count("*").alias("n"))
    return n.groupBy("site").agg(F.max(F.struct("n", (-order).alias("o"), "base")).alias("v")).select("site", F.col("v.base").alias("base"))


def divergence(haps: DataFrame, corrected: bool = False) -> DataFrame:
    """``hap, n_sites, n_diff, distance, loglik`` of each haplotype from the ancestor under equal substitution rates.

    ``distance`` is the observed share of changes, or with ``corrected`` the
    expected number of changes per site (null from three quarters on).
    """
    j = haps.join(ancestor(haps).withColumnRenamed("base", "anc"), "site")
    g = j.groupBy("hap").agg(F.count("*").alias("n_sites"), F.count_if(F.col("base") != F.col("anc")).alias("n_diff"))
    p = F.col("n_diff") / F.col("n_sites")
    d = F.when(p < 0.75, -0.75 * F.ln(1 - p / 0.75)) if corrected else p
    g = g.withColumn("distance", d)
    decay = F.exp(-F.col("distance") / 0.75)
    differ = F.when(F.col("n_diff") > 0, F.col("n_diff") * F.ln(0.25 - 0.25 * decay)).otherwise(0.0)
    return g.withColumn("loglik", (F.col("n_sites") - F.col("n_diff")) * F.ln(0.25 + 0.75 * decay) + differ)


def modified_criteria(haps: DataFrame, loglik: float, n_param: int, n_reads: int) -> tuple[float, float]:
    """AIC and BIC with haplotypes as descendants of an ancestor instead of free parameters."""
    r = divergence(haps).agg(F.sum("loglik"), F.count("*"), F.max("n_sites")).first()
    ll, k = loglik + (r[0] or 0.0), n_param + r[1] - r[2] * (r[1] - 1)
    return 2 * k - 2 * ll, k * math.log(n_reads) - 2 * ll


def is_false_positive(before: tuple[float, float], after: tuple[float, float], use_aic: bool = False) -> bool:
    """Whether a further haplotype fails to lower the chosen criterion (AIC, BIC)."""
    i = 0 if use_aic else 1
    return after[i] >= before[i]


def haplotype_lloyd(reads: DataFrame, seeds: pd.DataFrame, key: str = "read_idx", max_iter: int = 20) -> tuple[DataFrame, pd.DataFrame, list[float]]:
    """Quality-aware hard clustering: reads (``key, site, base, q``) to the most probable haplotype, and back.

    ``seeds`` has ``cluster, site, hap``.  Returns ``key, cluster, ll``, the
    haplotypes and the summed log-likelihoods; rounds end when they stop rising.
    """
    haps, lls = seeds, []
    spark = reads.sparkSession
    reads = reads.select(key, "site", "base", "q")
    while True:
        h = F.broadcast(spark.createDataFrame(haps))  # k haplotypes, chosen by the caller
        e = reads.join(h, "site").groupBy(key, "cluster").agg(F.sum(emit_logp(F.col("hap"), F.col("base"), F.col("q"))).alias("ll"))
        best = e.groupBy(key).agg(F.max(F.struct("ll", (-F.col("cluster")).alias("c"))).alias("v"))
        a = stage(best.select(key, (-F.col("v.c")).alias("cluster"), F.col("v.ll").alias("ll")), "lloyd")
        lls.append(float(a.agg(F.sum("ll")).first()[0] or 0.0))
        if len(lls) > max_iter or (len(lls) > 1 and lls[-1] <= lls[-2] + 1e-9):
            return a, haps, lls
        r = reads.join(a.select(key, "cluster"), key)
        cand = r.select("cluster", "site", F.explode(F.array(*[F.struct(F.lit(b).alias("hap"), emit_logp(F.lit(b), F.col("base"), F.col("q")).alias("s")) for b in BASES])).alias("c"))
        g = cand.groupBy("cluster", "site", "c.hap").agg(F.sum("c.s").alias("s"))
        haps = g.groupBy("cluster", "site").agg(F.max(F.struct("s", "hap")).alias("v")).select("cluster", "site", F.col("v.hap").alias("hap")).toPandas()


def primer_offsets(reads: DataFrame, primer: str, max_offset: int = 10, max_iter: int = 50, eps: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """Most probable start of a primer in each read, by EM over the shares of offsets.

    Adds ``offset, offset_pp``; returns the shares as well.  The primer's bases
    match with one error rate, estimated along; N in the primer matches any
    base.  Reads shorter than primer and offset are scored on what they have.
    """
    offs = range(max_offset + 1)

    def hits(o: int):
        tests = [F.when(F.substring("seq", o + i + 1, 1) == c, 1).otherwise(0) for i, c in enumerate(primer) if c != "N"]
        return sum(tests[1:], tests[0])

    m = sum(c != "N" for c in primer)
    d = stage(reads.withColumn("_h", F.array(*[hits(o) for o in offs])), "primer")
    share, error, last = [1 / len(offs)] * len(offs), 0.05, -math.inf

    def posterior(share: list[float], error: float) -> DataFrame:
        w = F.transform(F.arrays_zip(F.col("_h").alias("h"), F.array(*[F.lit(s) for s in share]).alias("s")), lambda x: F.ln(F.greatest(x["s"], F.lit(1e-300))) + x["h"] * math.log(1 - error) + (m - x["h"]) * math.log(error / 3))
        p = d.withColumn("_w", w).withColumn("_m", F.array_max("_w"))
        return p.withColumn("_e", F.transform("_w", lambda x: F.exp(x - F.col("_m")))).withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))

    for _ in range(max_iter):
        p = posterior(share, error)
        r = p.agg(*[F.sum(F.col("_e")[o] / F.col("_s")).alias(f"p{o}") for o in offs], *[F.sum(F.col("_e")[o] / F.col("_s") * F.col("_h")[o]).alias(f"h{o}") for o in offs], F.sum(F.ln("_s") + F.col("_m")).alias("ll"), F.count("*").alias("n")).first()
        if not r["n"]:
            break
        share = [r[f"p{o}"] / r["n"] for o in offs]
        error = min(max(1 - sum(r[f"h{o}"] for o in offs) / (r["n"] * m), 1e-4), 0.5)
        if r["ll"] - last <= abs(r["ll"]) * eps:
            break
        last = r["ll"]
    p = posterior(share, error)
    top = F.array_max("_e")
    return p.withColumn("offset", F.array_position("_e", top) - 1).withColumn("offset_pp", top / F.col("_s")).drop("_h", "_w", "_m", "_e", "_s"), share


def trim_primer(df: DataFrame, primer: str) -> DataFrame:
    """Reads after their primer, by the offsets of :func:`primer_offsets`."""
    at = (F.col("offset") + len(primer) + 1).cast("int")
    return df.withColumn("seq", F.substring("seq", at, F.length("seq")))


def true_abundance(pdf: pd.DataFrame, error: float = 0.005, low: float = 2.0, max_iter: int = 100, eps: float = 1e-6) -> pd.DataFrame:
    """Haplotypes of one sample by expected true abundance, most abundant first.

    Each round estimates, for every remaining sequence, how many of its reads
    are its own rather than errors of the haplotypes chosen so far (a decreasing
    fixed point), and chooses the greatest; it ends when none keeps ``low``.
    """
    d = pdf[pdf["n_reads"] >= low].sort_values(["n_reads", "seq"], ascending=[False, True]).reset_index(drop=True)
    if d.empty:
        return d.assign(abundance=[])
    x = np.array([np.frombuffer(s.encode(), np.uint8) for s in d["seq"]])
    n, length = d["n_reads"].to_numpy(float), x.shape[1]
    self_p = (1 - error) ** length
    chosen: list[int] = []
    final: dict[int, float] = {}
    pressure, est = np.zeros(len(d)), n.copy()
    while True:
        open_ = [i for i in range(len(d)) if i not in final]
        if not open_:
            break
        best = max(open_, key=lambda i: (est[i], -i))
        if est[best] < low:
            break
        chosen.append(best)
        final[best] = est[best]
        far = (x != x[best]).sum(1)
        pressure += est[best] * (error / 3) ** far * (1 - error) ** (length - far)
        for i in open_:
            if i == best:
                continue
            t = est[i]
            for _ in range(max_iter):
                nxt = n[i] * t * self_p / (t * self_p + pressure[i])
                done = nxt < 1 or (t - nxt) <= eps * t
                t = nxt
                if done:
                    break
            est[i] = t
    return d.loc[chosen].assign(abundance=[final[i] for i in chosen])


def true_abundance_samples(uniq: DataFrame, sample: str, **options) -> DataFrame:
    """``sample, seq, abundance`` of every sample and length; sequential within one, parallel over all."""
    kind = uniq.schema[sample].dataType.simpleString()
    u = uniq.where("seq is not null").select(sample, "seq", "n_reads", F.length("seq").alias("_len"))
    return u.groupBy(sample, "_len").applyInPandas(lambda p: true_abundance(p, **options)[[sample, "seq", "abundance"]], f"`{sample}` {kind}, seq string, abundance double")


def online_kmodes(pdf: pd.DataFrame, k: int, codes: str = "codes", max_iter: int = 20) -> pd.DataFrame:
    """Order-dependent k-modes of one group: every row moves at once and modes follow immediately."""
    x = np.array(pdf[codes].tolist())
    first = list(dict.fromkeys(map(tuple, x)))[:k]
    k = len(first)
    top = int(x.max()) + 1
    count = np.zeros((k, x.shape[1], top), int)
    modes, label = np.array(first), np.full(len(x), -1)
    cols = np.arange(x.shape[1])
    for _ in range(max_iter):
        moved = 0
        for i, row in enumerate(x):
            j = int((modes != row).sum(1).argmin())
            if j != label[i]:
                if label[i] >= 0:
                    count[label[i], cols, row] -= 1
                    if count[label[i], 0].sum():
                        modes[label[i]] = count[label[i]].argmax(1)
                count[j, cols, row] += 1
                modes[j] = count[j].argmax(1)
                label[i] = j
                moved += 1
        if not moved:
            break
    return pdf.assign(cluster=label)


def monte_carlo_posteriors(p: DataFrame, keys: list[str], n_sample: int = 100, seed: int = 1) -> DataFrame:
    """Genotype posteriors averaged over random assignments of reads to subgenomes.

    ``p`` has pileup columns with ``pp_a, read, nuc1, nuc2``.  An assignment
    depends only on read, site, sample number and seed.
    """
    b, q = F.col("base"), F.col("q")
    e = [emit_logp(F.col("nuc1"), b, q), emit_logp_het(F.col("nuc1"), F.col("nuc2"), b, q), emit_logp(F.col("nuc2"), b, q)]
    d = p.withColumns({f"_e{i}": v for i, v in enumerate(e)}).withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(n_sample))))
    in_a = uniform(F.col("read"), *[F.col(k) for k in keys], F.col("_s"), seed=seed) < F.col("pp_a")
    pairs = [(i, j) for i in range(3) for j in range(3)]
    g = d.groupBy(*keys, "_s").agg(*[F.sum(F.when(in_a, F.col(f"_e{i}")).otherwise(F.col(f"_e{j}"))).alias(f"l{i}{j}") for i, j in pairs])
    g = g.withColumn("_l", F.array(*[F.col(f"l{i}{j}") for i, j in pairs]))
    g = g.withColumn("_x", F.transform("_l", lambda v: F.exp(v - F.array_max(F.col("_l"))))).withColumn("_t", F.aggregate("_x", F.lit(0.0), lambda a, v: a + v))
    return g.groupBy(*keys).agg(*[F.avg(F.col("_x")[n] / F.col("_t")).alias(f"pp_{i}{j}") for n, (i, j) in enumerate(pairs)])


def amplicon_reads(haps: DataFrame, n_reads: int, mean_q: int = 33, seed: int = 1) -> DataFrame:
    """Simulated reads ``read_idx, hap, site, base, q`` of haplotypes with weights (``hap, seq, weight``)."""
    w = Window.orderBy("hap").rowsBetween(Window.unboundedPreceding, 0)  # a few haplotypes
    total = haps.agg(F.sum("weight")).first()[0]
    h = haps.withColumn("hi", F.sum("weight").over(w) / total).withColumn("lo", F.col("hi") - F.col("weight") / total)
    r = haps.sparkSession.range(n_reads).withColumnRenamed("id", "read_idx").withColumn("u", uniform(F.col("read_idx"), F.lit("h"), seed=seed))
    j = r.join(F.broadcast(h), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    b = j.select("read_idx", "hap", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("site", "t"))
    b = b.withColumn("q", (F.lit(mean_q) - F.floor(uniform(F.col("read_idx"), F.col("site"), F.lit("q"), seed=seed) * 20)).cast("int"))
    wrong = uniform(F.col("read_idx"), F.col("site"), F.lit("e"), seed=seed) < F.pow(F.lit(10.0), -F.col("q") / 10.0)
    rest = F.array_except(F.array(*[F.lit(c) for c in BASES]), F.array("t"))
    other = F.element_at(rest, F.floor(uniform(F.col("read_idx"), F.col("site"), F.lit("b"), seed=seed) * 3).cast("int") + 1)
    return b.select("read_idx", "hap", "site", F.when(wrong, other).otherwise(F.col("t")).alias("base"), "q")

"""Haplotype models on small cases."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import haplotypes as H


def test_numeric():
    a = np.array([[-0.5, 0.5], [0.25, -0.25]])
    p = numeric.matrix_exponential(a)
    assert np.allclose(p.sum(1), 1) and np.allclose(numeric.matrix_exponential(np.zeros((3, 3))), np.eye(3))
    assert abs(numeric.minimise(lambda x: (x - 3) ** 2, 0.01, 100) - 3) < 1e-4
    assert abs(numeric.root(lambda x: x * x - 2, 0, 2) - math.sqrt(2)) < 1e-9


def test_divergence(spark):
    d = spark.createDataFrame([(h, i, c) for h, s in enumerate(["ACGT", "ACGA", "ACCT"]) for i, c in enumerate(s)], "hap int, site int, base string")
    r = {x["hap"]: x for x in H.divergence(d).collect()}
    assert r[0]["n_diff"] == 0 and r[0]["loglik"] == 0 and r[1]["distance"] == 0.25
    e = math.exp(-0.25 / 0.75)
    assert abs(r[1]["loglik"] - (3 * math.log(0.25 + 0.75 * e) + math.log(0.25 - 0.25 * e))) < 1e-9
    aic, bic = H.modified_criteria(d, -100.0, 20, 50)
    assert aic < bic and H.is_false_positive((1.0, 5.0), (0.5, 6.0)) and not H.is_false_positive((1.0, 5.0), (0.5, 6.0), True)


def test_lloyd_and_simulated_reads(spark):
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list("ACGT"), 20)) for _ in range(3)]
    haps = spark.createDataFrame([(i, s, 1.0 + i) for i, s in enumerate(seqs)], "hap int, seq string, weight double")
    r = H.amplicon_reads(haps, 90)
    assert r.select("read_idx").distinct().count() == 90
    broken = [s[:3] + ("A" if s[3] != "A" else "C") + s[4:] for s in seqs]
    seeds = pd.DataFrame([(i, j, c) for i, s in enumerate(broken) for j, c in enumerate(s)], columns=["cluster", "site", "hap"])
    a, found, lls = H.haplotype_lloyd(r, seeds)
    got = found.sort_values(["cluster", "site"]).groupby("cluster")["hap"].apply("".join).tolist()
    assert got == seqs and lls[-1] > lls[0]
    assert a.join(r.select("read_idx", F.col("hap").alias("origin")).distinct(), "read_idx").where("cluster <> origin").count() == 0


def test_primer_offsets(spark):
    primer, rng = "ACGTNCCA", np.random.default_rng(2)
    say = lambda n: "".join(rng.choice(list("ACGT"), n))
    rows = [(i, say(i % 4) + primer.replace("N", "G") + say(20)) for i in range(80)]
    d, share = H.primer_offsets(spark.createDataFrame(rows, "read_idx int, seq string"), primer, 6)
    assert all(r["offset"] == r["read_idx"] % 4 for r in d.collect()) and abs(share[0] - 0.25) < 0.02
    assert all(len(r["seq"]) == 20 for r in H.trim_primer(d, primer).collect())


def test_true_abundance_and_online_kmodes():
    base = "ACGTACGTACGTACGTACGT"
    near = "T" + base[1:]
    d = pd.DataFrame({"seq": [base, near, base[::-1]], "n_reads": [5000, 5, 300]})
    got = H.true_abundance(d)
    assert got["seq"].tolist() == [base, base[::-1]] and abs(got["abundance"].iloc[0] - 5000) < 1
    assert H.true_abundance(d.assign(n_reads=1)).empty
    p = pd.DataFrame({"codes": [[i % 2] * 5 for i in range(20)]})
    assert H.online_kmodes(p, 2)["cluster"].tolist() == [0, 1] * 10


def test_monte_carlo_posteriors(spark):
    rows = [(0, i, "A", 35, 0.999, "A", "C") for i in range(12)] + [(0, 100 + i, "C", 35, 0.001, "A", "C") for i in range(12)]
    r = H.monte_carlo_posteriors(spark.createDataFrame(rows, "site int, read int, base string, q int, pp_a double, nuc1 string, nuc2 string"), ["site"], 20).first()
    assert r["pp_02"] > 0.9 and abs(sum(r[f"pp_{i}{j}"] for i in range(3) for j in range(3)) - 1) < 1e-9

"""The per-site kernel: known cases, invariants and a simulated round trip."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import clusters, coverage_tests, genotype as G, metrics, simulate, truth, vcf
from tessera.operators.likelihood import error_table, log_likelihood, read_posteriors, with_emission

P = "site int, base string, q int, ll_a double, ll_b double, ref_a string, ref_b string"


def _plain(rows):
    """Posterior of the nine genotypes by plain loops."""
    e = lambda t, b, q: math.log(1 - 10 ** (-q / 10)) if t == b else -q * math.log(10) / 10 - math.log(3)
    counts = {x: sum(r[1] == x for r in rows) for x in "ACTG"}
    order = sorted("ACTG", key=lambda x: (-counts[x], "ACTG".index(x)))
    n1, n2 = order[0], order[1]

    def em(g, b, q):
        if g == 1:
            return math.log((math.exp(e(n1, b, q)) + math.exp(e(n2, b, q))) / 2)
        return e(n1 if g == 0 else n2, b, q)

    lp = [[sum(np.logaddexp(la - e(ra, b, q) + em(a, b, q), lb - e(rb, b, q) + em(c, b, q)) for _, b, q, la, lb, ra, rb in rows) for c in range(3)] for a in range(3)]
    x = np.exp(np.array(lp) - np.max(lp))
    return x / x.sum(), n1, n2


def _sites():
    rng = np.random.default_rng(4)
    out = []
    for s in range(12):
        two = rng.choice(list("ACTG"), 2, replace=False)
        for _ in range(rng.integers(6, 20)):
            b = two[0] if rng.random() < 0.6 or s % 4 == 0 else two[1]
            out.append((s, str(b), int(rng.integers(10, 40)), float(-rng.integers(1, 12)), float(-rng.integers(1, 12)), str(two[0]), str(two[s % 2])))
    return out


def test_kernel_equals_plain_loops(spark):
    rows = _sites()
    got = {r["site"]: r for r in G.call_sites(spark.createDataFrame(rows, P), ["site"]).collect()}
    assert len(got) == 12
    for s in range(12):
        want, n1, n2 = _plain([r for r in rows if r[0] == s])
        r = got[s]
        assert (r["nuc1"], r["nuc2"]) == (n1, n2)
        have = np.array([[r[f"pp_{a}{b}"] for b in range(3)] for a in range(3)])
        assert np.allclose(have, want, atol=1e-9) and abs(have.sum() - 1) < 1e-9
        assert (r["g1"], r["g2"]) == np.unravel_index(np.argmax(want), (3, 3))
        assert abs(r["pa_1"] - want[1].sum()) < 1e-9


def test_swapping_subgenomes_transposes(spark):
    rows = _sites()
    swapped = [(s, b, q, lb, la, rb, ra) for s, b, q, la, lb, ra, rb in reversed(rows)]
    x = {r["site"]: r for r in G.call_sites(spark.createDataFrame(rows, P), ["site"]).collect()}
    y = {r["site"]: r for r in G.call_sites(spark.createDataFrame(swapped, P).repartition(3), ["site"]).collect()}
    assert all(abs(x[s][f"pp_{a}{b}"] - y[s][f"pp_{b}{a}"]) < 1e-9 for s in x for a in range(3) for b in range(3))


def test_all_g_site(spark):
    quals = "FFFFFFFFFB<FFFF7FFFBFFB"
    rows = [(0, "G", ord(c) - 33, 0.0 if i < 11 else -60.0, -60.0 if i < 11 else 0.0, "G", "G") for i, c in enumerate(quals)]
    c = G.call_sites(spark.createDataFrame(rows, P), ["site"]).first()
    assert c["genotype_call"] == "GG/GG" and c["pp_00"] > 0.999 and c["nuc2"] == "A" and c["no_alt"]
    assert abs(c["ea_g"] - 11) < 1e-6 and abs(c["eb_g"] - 12) < 1e-6


def test_allele_order_and_stand_in(spark):
    d = spark.createDataFrame([(1, 5, 0, 0, 0), (2, 0, 5, 0, 0), (3, 2, 2, 2, 2), (4, 0, 1, 3, 3)], "site int, n_a int, n_c int, n_t int, n_g int")
    got = {r["site"]: (r["nuc1"], r["nuc2"], r["nuc3"], r["no_alt"]) for r in G.top_alleles(d).collect()}
    assert got == {1: ("A", "C", "T", True), 2: ("C", "A", "T", True), 3: ("A", "C", "T", False), 4: ("T", "G", "C", False)}


def test_simulated_round_trip(spark):
    """Genomes, individuals and reads with known alignments are called back."""
    g = simulate.genomes(spark, 1500, 0.03, 0.03, seed=3)
    h = simulate.individuals(g, 1, seed=3)
    r = simulate.reads(h, 12, 100, seed=3).join(g.select(F.col("position").alias("pos0"), "ref_a", "ref_b"), "pos0")
    both = r.select("*", F.explode(F.array(F.struct(F.lit("A").alias("sg"), F.col("ref_a").alias("ref_base")), F.struct(F.lit("B").alias("sg"), F.col("ref_b").alias("ref_base")))).alias("x")).select("*", "x.*")
    ll = log_likelihood(with_emission(both), ["read_id"])
    p = r.join(ll, "read_id").withColumnRenamed("pos0", "site")
    calls = G.call_sites(p, ["site"]).select("site", "genotype_call").join(h.withColumnRenamed("position", "site"), "site").toPandas()
    norm = lambda a, b: "".join(sorted((a, b)))
    ok = [norm(*c.split("/")[0]) == norm(a1, a2) and norm(*c.split("/")[1]) == norm(b1, b2) for c, a1, a2, b1, b2 in zip(calls["genotype_call"], calls["a1"], calls["a2"], calls["b1"], calls["b2"])]
    assert len(ok) > 1300 and np.mean(ok) > 0.97
    per, site = truth.truth_tables(h.select("genotype", "position", "a1", "a2", "b1", "b2"))
    homeo = site.where("truth_homeo = 1").count()
    assert 20 < homeo < 80


def test_error_table_first_row_wins(spark):
    t = spark.createDataFrame([(30, "A", 1, "C", 0.5, 0), (30, "A", 1, "C", 0.9, 1), (30, "A", 2, "C", 0.0, 2)], "q int, true_base string, pos int, read_base string, prob double, row_no bigint")
    b = spark.createDataFrame([(30, "A", 0, "C"), (30, "A", 1, "C"), (30, "A", 7, "C")], "q int, ref_base string, rd_idx int, base string")
    got = {r["rd_idx"]: r["logp"] for r in with_emission(b, table=t).collect()}
    assert abs(got[0] - math.log(0.5)) < 1e-12 and got[1] < -700 and got[7] == 0
    assert error_table(t).count() == 2


def test_posterior_is_stable(spark):
    d = spark.createDataFrame([(-5000.0, -5001.0), (0.0, -800.0), (None, 1.0)], "ll_a double, ll_b double")
    got = [r["pp_a"] for r in read_posteriors(d).collect()]
    assert abs(got[0] - 1 / (1 + math.exp(-1))) < 1e-12 and got[1] == 1.0 and len(got) == 2
    assert read_posteriors(d, min_posterior=0.9).count() == 1 and read_posteriors(d, min_loglik=-10).count() == 1


def test_vcf_rows(spark):
    rows = [(0, b, 30, -1.0, -1.0, "A", "C") for b in "AAAACCCC"]
    c = G.call_sites(spark.createDataFrame(rows, P), ["site"]).withColumns({"name_a": F.lit("cA"), "name_b": F.lit("cB"), "pos_a": F.lit(9), "pos_b": F.lit(19), "ref_a": F.lit("A"), "ref_b": F.lit("G")})
    r = {x["side"]: x for x in vcf.site_rows(c, gl=True).collect()}
    assert r["A"]["pos"] == 10 and r["A"]["ref"] == "A" and r["A"]["alt"] == "C" and r["B"]["alt"] == "A,C"
    assert r["A"]["gt"] in ("0/0", "0/1", "1/1") and r["B"]["gt"] in ("1/1", "1/2", "2/2")
    line = vcf.lines(vcf.site_rows(c, gl=True)).orderBy("chrom").first()["line"].split("\t")
    assert line[:7] == ["cA", "10", ".", "A", "C", ".", "PASS"] and line[8] == "GT:DP:GQ:GL" and line[9].count(",") == 2
    failed = vcf.apply_posthoc(vcf.site_rows(c), spark.createDataFrame([("cA", 10)], "chrom string, pos int"))
    assert {x["side"]: x["filter"] for x in failed.collect()} == {"A": "sc5", "B": "PASS"}
    assert vcf.header(["c"], "s", "20240101", equal_test=True)[-1].endswith("FORMAT\ts")


def test_equal_coverage(spark):
    def rows(site, n1, n2):
        return [(site, b, 35, 0.0, -50.0, "A", "A") for b in "A" * n1 + "C" * n2] + [(site, "A", 35, -50.0, 0.0, "A", "A")] * 10

    d = spark.createDataFrame(rows(0, 10, 10) + rows(1, 28, 8), P)
    c = G.call_sites(d, ["site"]).select("site", "nuc1", "nuc2", "g1", "g2")
    got = {r["site"]: r["ect_a"] for r in coverage_tests.equal_coverage_test(G.without_site(d).join(c, "site"), ["site"]).collect()}
    assert got[0] > 0.9 and got[1] < 0.01
    x2 = 2 * (28 * math.log(28 / 18) + 8 * math.log(8 / 18))
    assert abs(got[1] - math.erfc(math.sqrt(x2 / 2))) < 0.002


def test_haplotypes(spark):
    d = spark.createDataFrame([(1, 40, 40, 20, 20), (2, 50, 30, 20, 0), (3, 0, 0, 0, 0)], "k int, n1 bigint, n2 bigint, n3 bigint, n4 bigint")
    r = {x["k"]: x for x in coverage_tests.haplotype_number(d).collect()}
    assert abs(r[1]["lrt_four"]) < 1e-9 and r[1]["w_four"] == 2 and r[2]["lrt_three"] > 0
    b = coverage_tests.haplotype_balance(spark.createDataFrame([(1, "x", 90), (1, "y", 10), (2, "x", 50), (2, "y", 52)], "k int, h string, n_reads int"), ["k"])
    assert {x["k"]: x["fails"] for x in b.collect()} == {1: True, 2: False}


def test_metrics_prefer_the_right_sites(spark):
    cols = "genotype string, chrom_a string, chrom_b string, position_a bigint, position_b bigint, major string, minor string, genotype_call string, " + ", ".join(f"pp_{a}{b} double" for a in range(3) for b in range(3)) + ", " + ", ".join(f"p{s}_{i} double" for s in "ab" for i in range(3)) + ", cov_a double, cov_b double"

    def row(ind, pos, call, best):
        pp = [[0.01] * 3 for _ in range(3)]
        pp[best[0]][best[1]] = 0.92
        flat = [v for x in pp for v in x]
        pa, pb = [sum(x) for x in pp], [sum(x[i] for x in pp) for i in range(3)]
        return (ind, "A", "B", pos, pos, "A", "C", call, *flat, *pa, *pb, 10.0, 12.0)

    d = spark.createDataFrame([row("i0", 1, "AA/CC", (0, 2)), row("i1", 1, "AA/CC", (0, 2)), row("i0", 2, "AA/AA", (0, 0)), row("i1", 2, "CC/AA", (2, 0))], cols)
    for f in (metrics.snp_metrics, metrics.snp_metrics_simulation):
        r = {x["position_a"]: x for x in f(d).collect()}
        assert abs(r[1]["pp_homeo"]) < 1e-9 and r[2]["pp_homeo"] < -1 and r[2]["pp_homo_a"] > r[1]["pp_homo_a"]
    p = {x["position_a"]: x for x in metrics.pooled_metrics(d).collect()}
    assert p[1]["pp_homo_a"] == 0
    assert metrics.info_filter(d, 11).count() == 0 and metrics.confident(d, 0.9).count() == 4


def test_clusterings(spark):
    d = spark.createDataFrame([(i, i // 10, i % 2) for i in range(40)], "k int, a int, b int")
    same = clusters.agreement(d, "a", "a").first()
    assert abs(same["rand"] - 1) < 1e-12 and abs(same["ari"] - 1) < 1e-12 and abs(same["vi"]) < 1e-9
    other = clusters.agreement(d, "a", "b").first()
    assert abs(other["mi"]) < 1e-9 and abs(other["ari"]) < 0.1
    x = spark.createDataFrame([(i, [i % 3] * 6) for i in range(30)], "k int, x array<int>")
    a, m, costs = clusters.kmodes(x, 3, "k", "x", seeds=clusters.seed_by_distance(x, 3, "k", "x"))
    assert costs[-1] == 0 and a.select("cluster").distinct().count() == 3
    import pandas as pd

    den = clusters.deblur(pd.DataFrame({"seq": ["AAAA", "AAAT", "CCCC"], "n_reads": [1000, 30, 200]}))
    assert set(den["seq"]) == {"AAAA", "CCCC"}
    loss = (1 - 0.005) ** 4  # by hand: AAAT is one place off, CCCC four
    deep = clusters.deblur(pd.DataFrame({"seq": ["AAAA", "AAAT", "CCCC"], "n_reads": [1000, 100, 20]}))
    t = 100 - 1000 / loss * 0.06
    assert deep["abundance"].round(6).tolist() == [1000, round(t, 6), round(20 - 1000 / loss * 0.01 - int(t) / loss * 0.01, 6)]
    assert clusters.deblur(pd.DataFrame({"seq": ["AAAA", "AAAT"], "n_reads": [1000, 100]}), most=1)["seq"].tolist() == ["AAAA"]
    m = spark.createDataFrame([(i, [i % 3, i // 3, 7]) for i in range(9)], "cluster int, mode array<int>")
    r = spark.createDataFrame([(1, [1, 2, 7]), (2, [9, 9, 9]), (3, [2, 2, None])], "k int, x array<int>")
    want = sorted(map(tuple, clusters.assign_modes(r, m, "k", "x").collect()))
    old, clusters.MAX_MODES = clusters.MAX_MODES, 2
    try:
        assert sorted(map(tuple, clusters.assign_modes(r, m, "k", "x").collect())) == want
    finally:
        clusters.MAX_MODES = old


def test_kmodes_seeds_and_transfer(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centre = rng.integers(0, 4, (3, 12))
    rows = [[int(v) if rng.random() > 0.1 else int(rng.integers(0, 4)) for v in centre[i % 3]] for i in range(60)]
    x = spark.createDataFrame([(i, i % 2, r) for i, r in enumerate(rows)], "k int, g int, x array<int>")
    part = x.selectExpr("k", "k % 3 as cluster")
    for seeds in (clusters.seeds_from_set(x, 3, "k", "x"), clusters.seeds_from_partition(x, part, 3, "k", "x"), clusters.seeds_by_frequency(x, 3, "k", "x")):
        got = seeds.collect()
        assert sorted(r["cluster"] for r in got) == [0, 1, 2] and all(len(r["mode"]) == 12 for r in got)
    a, _, costs = clusters.kmodes(x, 3, "k", "x", seeds=clusters.seeds_from_partition(x, part, 3, "k", "x"))
    assert a.select("cluster").distinct().count() == 3
    full = np.array(rows)
    cost = lambda lab: sum(int((full[lab == c][:, s] != np.bincount(full[lab == c][:, s]).argmax()).sum()) for c in np.unique(lab) for s in range(12))
    lab, total = clusters.transfer_modes(full, np.arange(60) % 4, 4)
    assert cost(lab) == total <= cost(np.arange(60) % 4)
    for i in range(60):  # no single move is better
        for c in range(4):
            if (lab == lab[i]).sum() > 1:
                moved = lab.copy()
                moved[i] = c
                assert cost(moved) >= total
    t = clusters.kmodes_transfer(x, 3, ["g"], "k", "x").toPandas()
    assert len(t) == 60 and t.groupby("g")["cost"].nunique().tolist() == [1, 1]
    e = clusters.estimate_k(x, [1, 2, 3, 4], "k", "x", starts=2)
    assert e["cost"].is_monotonic_decreasing and e["kl"].notna().sum() == 2


def test_unbalanced_alleles(spark):
    from tessera.operators import coverage_tests

    cols = "k int, g1 int, g2 int, ea_a double, ea_c double, ea_t double, ea_g double, cov_a double"
    rows = [(1, 1, 0, 20.0, 18.0, 0.0, 0.0, 38.0), (2, 1, 0, 60.0, 20.0, 0.0, 0.0, 80.0), (3, 0, 1, 60.0, 20.0, 0.0, 0.0, 80.0)]
    got = coverage_tests.unbalanced_alleles(spark.createDataFrame(rows, cols), "a").collect()
    assert [r["k"] for r in got] == [2] and abs(got[0]["chi2"] - 20.0) < 1e-9


def test_mixture_recovers_haplotypes(spark):
    h = spark.createDataFrame([(i, j, ("ACGT" if i % 3 else "TCGA")[j], 30) for i in range(30) for j in range(4)], "read_idx int, site int, base string, q int")
    pp, haps, lls = clusters.haplotype_mixture(h, 2)
    top = pp.groupBy("read_idx").agg(F.max_by("cluster", "pp").alias("c")).toPandas()
    assert top.groupby(top["read_idx"] % 3 == 0)["c"].nunique().tolist() == [1, 1] and lls[-1] >= lls[0]

"""Files-like tables to calls: simulated reads aligned to both subgenomes, forward and reversed B."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.seq import reverse_complement
from tessera.operators import coverage_tests, regions, simulate
from tessera.plans import pipeline


@pytest.mark.parametrize("reverse", [False, True])
def test_pipeline_calls_simulated_genotypes(spark, reverse):
    n = 400
    g = simulate.genomes(spark, n, 0.05, 0.04, seed=9)
    h = simulate.individuals(g, 2, seed=9)
    sam = simulate.to_sam(simulate.reads(h, 10, 60, seed=9))
    fa = simulate.to_fasta(g, "ref_a", "A").select("name", "seq").unionByName(simulate.to_fasta(g, "ref_b", "B").select("name", "seq"))
    a = sam.withColumn("sg", F.lit("A")).withColumn("rname", F.lit("A"))
    b = sam.withColumn("sg", F.lit("B")).withColumn("rname", F.lit("B"))
    if reverse:
        fa = fa.withColumn("seq", F.when(F.col("name") == "B", reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
        b = b.withColumn("pos", F.lit(n) - (F.col("pos") - 1 + F.length("seq")) + 1).withColumn("flag", F.lit(16)).withColumn("seq", reverse_complement(F.col("seq"))).withColumn("qual", F.reverse("qual"))
    t = spark.createDataFrame([(f"B:1-{n}", f"A:1-{n}", 16 if reverse else 0, 1, f"{n}M")], "qname string, rname string, flag int, pos bigint, cigar string")
    targets = regions.target_alignment(t).withColumn("target_id", F.lit(1))
    calls = pipeline.genotype(a.unionByName(b), targets, fa, pipeline.Options(equal_coverage_test=True))
    r = calls.join(h.select(F.col("genotype").alias("sample"), F.col("position").alias("pos_a"), "a1", "a2", "b1", "b2"), ["sample", "pos_a"]).toPandas()
    norm = lambda x, y: "".join(sorted((x, y)))
    ok = [norm(*c.split("/")[0]) == norm(a1, a2) and norm(*c.split("/")[1]) == norm(b1, b2) for c, a1, a2, b1, b2 in zip(r["genotype_call"], r["a1"], r["a2"], r["b1"], r["b2"])]
    assert len(ok) > 0.9 * 2 * n and sum(ok) / len(ok) > 0.9
    if reverse:
        assert ((r["pos_a"] + r["pos_b"]) == n - 1).all()
    rows = pipeline.vcf_records(calls, pipeline.Options(equal_coverage_test=True, gl=True))
    assert rows.count() == 2 * len(r)
    if reverse:
        return
    p = pipeline.pileup(a.unionByName(b), targets, fa)
    share = F.least(F.col("cov_a") / F.col("region_cov_a"), F.col("cov_b") / F.col("region_cov_b"))
    least = pipeline.sites(p, targets).agg(F.percentile(share, F.lit(0.3))).first()[0]
    o = pipeline.Options(posthoc_test=True, coverage_screen=least, biallelic=0.1)
    s = pipeline.sites(p, targets, o)
    n_low, n_sites = s.where(share < least).count(), s.count()
    third = s.where((share >= least) & (F.col("num3") > 0.1 * F.least("region_cov_a", "region_cov_b") / 2)).count()
    kinds = {x["filter"]: x["n"] for x in pipeline.variants(a.unionByName(b), targets, fa, o).groupBy("filter").agg(F.count("*").alias("n")).collect()}
    assert kinds[f"c{round(100 * least)}"] == 2 * n_low > 0 and kinds.get("al2", 0) == 2 * third
    assert sum(kinds.values()) == 2 * n_sites and kinds["PASS"] > n_sites
    plain = pipeline.genotype(a.unionByName(b), targets, fa, pipeline.Options(amplicon=True))
    assert plain.count() > 0.9 * 2 * n and plain.where("low_region").count() in (0, plain.count())


def test_haplotype_decisions(spark):
    cols = "k int, n1 bigint, n2 bigint, n3 bigint, n4 bigint, a1 double, a2 double, a3 double, a4 double"
    rows = [
        (1, 100, 98, 50, 49, 97.0, 95.0, 2.0, 2.0),  # two pairs, unequal subgenomes, pure
        (2, 100, 98, 50, 49, 97.0, 3.0, 2.0, 2.0),  # the first pair mixes subgenomes: largest two remain
        (3, 100, 98, 97, 95, 97.0, 3.0, 94.0, 2.0),  # equal sizes: another split fits
        (4, 200, 100, 98, 5, 195.0, 2.0, 2.0, 1.0),  # one and a pair
        (5, 200, 100, 5, 0, 100.0, 50.0, 2.0, 0.0),  # nothing pure
        (6, 300, 100, 0, 0, 290.0, 2.0, 0.0, 0.0),
    ]
    d = coverage_tests.purity_decision(coverage_tests.haplotype_hypothesis(spark.createDataFrame(rows, cols)))
    got = {r["k"]: (r["state"], r["decision"], list(r["kept"])) for r in d.collect()}
    assert got[1] == ("four", "four", [1, 2, 3, 4]) and got[2] == ("four", "two", [1, 2]) and got[3][1] == "four"
    assert got[4] == ("three_a", "three_a", [1, 2, 3]) and got[5][1] == "refuse" and got[6] == ("two", "two", [1, 2])

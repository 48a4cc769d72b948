"""Queries across individuals: metrics, truth comparison, tests, clusterings, streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators import clusters, cohort_vcf, coverage_tests as T, genotype as G, metrics as M, simulate, truth
from tessera.operators.versions import latest
from tessera.plans.adapters import INFO, PILEUP, duck, spark_sql
from tessera.plans.dataset_queries import table
from tessera.plans.genotype_queries import kernel, pileup

SITE = ["position_a", "position_b", "chrom_a", "chrom_b"]


def info(spark: SparkSession, sf: str) -> DataFrame:
    return spark_sql(spark, sf, INFO)


def _round(df: DataFrame, cols: list[str], n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c in cols})  # no negative zero


def het_metric(spark, sf):
    """Log odds of heterozygotes per individual and site."""
    c = ["pp_het_a", "pp_het_b"]
    return _round(M.het_metric(info(spark, sf)).select("genotype", "position_a", "genotype_call", *c), c)


METRICS = ["pp_homeo", "pp_homo_a", "pp_homo_b", "cov_a", "cov_b"]


def snp_metrics(spark, sf):
    """Homoeologous and allelic metrics per site, alleles by frequency."""
    return _round(M.snp_metrics(info(spark, sf)).select("position_a", "biallelic", *METRICS), METRICS)


def snp_metrics_simulation(spark, sf):
    """The simulation variant, alleles in the order seen."""
    return _round(M.snp_metrics_simulation(info(spark, sf)).select("position_a", "biallelic", *METRICS), METRICS)


def pooled_metrics(spark, sf):
    """The pooled variant."""
    c = METRICS[:3]
    return _round(M.pooled_metrics(info(spark, sf)).select("position_a", *c), c)


def alleles_by_frequency(spark, sf):
    """The two most frequent allele letters per site."""
    return M.alleles_by_frequency(info(spark, sf)).select("position_a", "n_alleles", "n1", "n2")


def info_filter(spark, sf):
    """Rows with enough coverage in both subgenomes."""
    return M.info_filter(info(spark, sf), 8).select("genotype", "position_a", "genotype_call", "cov_a", "cov_b")


def confident_calls(spark, sf):
    """Rows whose best posterior reaches a limit."""
    return M.confident(info(spark, sf), 0.18).select("genotype", "position_a", "genotype_call")


def site_coverage(spark, sf):
    """Mean coverage of every site beside its rows."""
    c = ["mean_cov_a", "mean_cov_b"]
    return _round(M.site_coverage(info(spark, sf)).select("genotype", "position_a", "genotype_call", "cov_a", *c), c)


def gatk(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gatk_info")
    return latest(g, ["info_id"], "loaded_at", [c for c in g.columns if c not in ("info_id", "loaded_at")])


GATK_SITE = ["chroma", "positiona", "positionb"]


def gatk_het(spark, sf):
    """Heterozygosity from Phred likelihoods."""
    c = ["pp_het_a", "pp_het_b"]
    return _round(M.gatk_het(gatk(spark, sf)).select("info_id", *c), c)


def gatk_letters(spark, sf):
    """Dosage calls as allele letters."""
    return M.gatk_letters(gatk(spark, sf)).select("info_id", "call_a", "call_b", "letters")


def gatk_snp_metrics(spark, sf):
    """Homoeologous and allelic metrics from Phred likelihoods."""
    c = ["pp_homeo", "pp_homo_a", "pp_homo_b"]
    return _round(M.gatk_snp_metrics(gatk(spark, sf), GATK_SITE).select(*GATK_SITE, "biallelic", *c), c)


def _scored(spark, sf):
    """Sites with a score and a truth label derived from their position."""
    s = M.snp_metrics(info(spark, sf)).select("position_a", F.round("pp_homeo", 6).alias("score"))
    return s, _truth(spark, sf)


def _truth(spark, sf):
    """Truth labels: every customer's key is a site, odd ones are true."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("position_a"), (F.col("c_custkey") % 2).cast("int").alias("truth"))


def truth_left(spark, sf):
    """Metric rows with truth labels, unknown ones 0."""
    s, t = _scored(spark, sf)
    return truth.truth_left(s, t, ["position_a"], ["truth"])


def truth_right(spark, sf):
    """Truth rows with scores where they exist."""
    s, t = _scored(spark, sf)
    return truth.truth_right(t, s, ["position_a"], ["score"])


def truth_full(spark, sf):
    """Full join of scores and truth, gaps filled."""
    s, t = _scored(spark, sf)
    return truth.truth_full(s, t, ["position_a"], ["score"])


def precision_recall(spark, sf):
    """Confusion counts, precision and recall at a threshold."""
    s, t = _scored(spark, sf)
    return _round(truth.precision_recall(truth.truth_left(s, t, ["position_a"], ["truth"]), "score", "truth", -20.0), ["precision", "recall"])


def pr_curve(spark, sf):
    """Precision and recall at every distinct score."""
    s, t = _scored(spark, sf)
    return _round(truth.pr_curve(truth.truth_left(s, t, ["position_a"], ["truth"]), "score", "truth"), ["precision", "recall"])


def average_precision(spark, sf):
    """Area under the precision-recall curve."""
    s, t = _scored(spark, sf)
    c = truth.pr_curve(truth.truth_left(s, t, ["position_a"], ["truth"]), "score", "truth")
    return _round(truth.average_precision(c), ["average_precision"])


def method_correlation(spark, sf):
    """Correlation of two metric variants by site."""
    a = M.snp_metrics(info(spark, sf)).select("position_a", F.col("pp_homo_a").alias("s"))
    b = M.snp_metrics_simulation(info(spark, sf)).select("position_a", F.col("pp_homo_a").alias("s"))
    return _round(truth.correlation(truth.compare_methods(a, b, ["position_a"], "s")), ["correlation"], 5)


def wilson_interval(spark, sf):
    """Wilson interval of the reverse strand's share per reference."""
    from tessera.functions import stats
    from tessera.plans.read_queries import distinct_alignments

    g = distinct_alignments(spark, sf).where("(flag & 4) = 0").groupBy("rname").agg(F.count_if((F.col("flag").bitwiseAND(16)) != 0).alias("k"), F.count("*").alias("n"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return _round(g.select("rname", "k", "n", w["low"].alias("low"), w["high"].alias("high")), ["low", "high"])


def _top4(spark, sf):
    """Abundances of the four most abundant whole sequences of every sample, 0 where there are fewer."""
    n = table(spark, sf, "hash_seqs").where("abundance is not null").groupBy("sample_id", F.upper("hash_sequence").alias("cluster")).agg(F.sum("abundance").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("n"), "cluster"))).where("r <= 4")
    return top.groupBy("sample_id").agg(*[F.coalesce(F.max(F.when(F.col("r") == i, F.col("n"))), F.lit(0)).cast("bigint").alias(f"n{i}") for i in range(1, 5)])


def haplotype_lrt(spark, sf):
    """Likelihood-ratio tests on the four largest clusters of every sample."""
    c = ["w_four", "w_three", "lrt_four", "lrt_three", "lrt_two", "p_four"]
    return _round(T.haplotype_number(_top4(spark, sf)).select("sample_id", "n1", "n2", "n3", "n4", *c), c, 5)


def haplotype_hypothesis(spark, sf):
    """Number of haplotypes and the clusters pure enough to genotype, per sample.

    No table tells which subgenome a sequence is from, so the reads of A are
    taken as 0.95 of the first and fourth cluster and 0.1 of the others.
    """
    d = _top4(spark, sf)
    d = d.withColumns({f"a{i}": F.col(f"n{i}") * (0.95 if i in (1, 4) else 0.1) for i in range(1, 5)})
    r = T.purity_decision(T.haplotype_hypothesis(d))
    return r.select("sample_id", "n1", "n2", "n3", "n4", "state", F.round("p_equal", 5).alias("p_equal"), "decision", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


def allele_balance(spark, sf):
    """Chi-square test of equal counts of the two largest clusters."""
    return _round(T.allele_balance(_top4(spark, sf), "n1", "n2").select("sample_id", "n1", "n2", "chi2"), ["chi2"], 5)


def equal_coverage_test(spark, sf):
    """EM test of equal homolog coverage at heterozygous sites."""
    p = pileup(spark, sf)
    c = G.call_sites(p, ["site"]).where("g1 = 1 or g2 = 1").select("site", "nuc1", "nuc2", "g1", "g2")
    return _round(T.equal_coverage_test(G.without_site(p).join(c, "site"), ["site"]), ["ect_a", "ect_b"], 4)


def cluster_purity(spark, sf):
    """Size, proportion of A and rank of every cluster of a target."""
    p = pileup(spark, sf).withColumn("cluster", F.pmod("read_no", F.lit(5))).withColumn("pp_a", F.when(F.col("ll_a") > F.col("ll_b"), 1.0).otherwise(0.0))
    c = T.select_chromosomes(T.cluster_purity(p, ["site"], "cluster"), ["site"])
    return _round(c, ["proportion_a"])


def cluster_contingency(spark, sf):
    """Rows per pair of labels: noted cluster and run."""
    return clusters.contingency(table(spark, sf, "kmodes_obs"), "cluster_id", "run_id")


AGREE = ["mi", "nmi_min", "nmi_geo", "nmi_mean", "nmi_max", "nmi_joint", "vi", "nvi", "rand", "ari"]


def cluster_agreement(spark, sf):
    """Agreement indices of two labelings."""
    d = table(spark, sf, "kmodes_obs").withColumn("b", F.pmod(F.col("cluster_id"), F.lit(7)))
    return _round(clusters.agreement(d, "cluster_id", "b"), AGREE, 5)


def cluster_homogeneity(spark, sf):
    """Mean share of equal pairs within clusters."""
    d = table(spark, sf, "kmodes_obs").withColumn("b", F.pmod("obs_id", F.lit(3)))
    return _round(clusters.homogeneity(d, "cluster_id", "b"), ["bhi"])


def _modes(spark, sf):
    """Modes of the earlier run's clusters."""
    o = table(spark, sf, "kmodes_obs").where("cluster_id is not null")
    return clusters.update_modes(o, o.select("obs_id", F.col("cluster_id").alias("cluster")), "obs_id", "dmat")


def kmodes_update(spark, sf):
    """Most frequent code per cluster and site."""
    return _modes(spark, sf).select("cluster", F.posexplode("mode").alias("site", "code"))


def kmodes_assign(spark, sf):
    """Nearest mode of every observation."""
    m = _modes(spark, sf)
    return clusters.assign_modes(table(spark, sf, "kmodes_obs"), m, "obs_id", "dmat")


def kmodes_cluster(spark, sf):
    """Lloyd's k-modes with 20 clusters, run until the cost no longer falls."""
    a, _, _ = clusters.kmodes(table(spark, sf, "kmodes_obs"), 20, "obs_id", "dmat", max_iter=None)
    return a


def kmodes_converged(spark, sf):
    """Whether every observation has a cluster and no round of k-modes cost more than the one before."""
    o = table(spark, sf, "kmodes_obs")
    a, _, costs = clusters.kmodes(o, 20, "obs_id", "dmat", max_iter=None)
    falls = all(x >= y for x, y in zip(costs, costs[1:]))
    return a.agg(F.count("*").alias("n_rows"), F.count_if(F.col("cluster").isNull()).alias("n_open"), (F.sum("distance") <= F.lit(costs[0])).alias("cheaper")).withColumn("falls", F.lit(falls))


def stratified_counts(spark, sf):
    """Rows a stratified sample of 50 takes from every run."""
    from tessera.operators import ordering

    return ordering.stratified_sample(table(spark, sf, "kmodes_obs").where("run_id is not null"), "run_id", ["obs_id"], 50).groupBy("run_id").agg(F.count("*").alias("n_rows"))


def deblur_sequences(spark, sf):
    """Denoised sequences of every sample."""
    d = table(spark, sf, "hash_seqs").where("abundance is not null").groupBy("sample_id", F.upper("hash_sequence").alias("seq")).agg(F.sum("abundance").alias("n_reads"))
    return clusters.deblur_samples(d, "sample_id").withColumn("abundance", F.round("abundance", 4))


CALLS = "chrom_a position_a chrom_b position_b genotype call_a call_b cov_a cov_b".split()


def _cohort(spark, sf, kind):
    i = info(spark, sf)
    one = i.groupBy(*SITE, "genotype").agg(F.max(F.struct("genotype_call", "cov_a", "cov_b")).alias("v"))
    calls = one.select(*SITE, "genotype", F.substring_index("v.genotype_call", "/", 1).alias("call_a"), F.substring_index("v.genotype_call", "/", -1).alias("call_b"), "v.cov_a", "v.cov_b")
    m = M.snp_metrics(i)
    m = m.select(*SITE, *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("pp_homo_a", "pp_homo_b", "pp_homeo")])  # so that no digit of the text is a tie
    bases = lambda s, k: i.select(F.col(f"chrom_{s}").alias("chrom"), (F.col(f"position_{s}") - 1).alias("pos0"), F.substring(F.lit("ACTG"), (1 + (F.col(f"position_{s}") + k) % 4).cast("int"), F.lit(1)).alias("base")).distinct()
    return cohort_vcf.records(calls, m, bases("a", 0), bases("b", 1), kind, [f"ind{k}" for k in range(5)])


def cohort_vcf_a(spark, sf):
    """Multi-sample records of subgenome A with the posterior of a homologous SNP."""
    return _cohort(spark, sf, "a")


def cohort_vcf_b(spark, sf):
    """Multi-sample records of subgenome B."""
    return _cohort(spark, sf, "b")


def cohort_vcf_ab(spark, sf):
    """Multi-sample records of site pairs with the posterior of a homoeologous SNP."""
    return _cohort(spark, sf, "ab")


def _simulated(spark, sf):
    """Five individuals of a genome with one site per order."""
    return simulate.individuals(simulate.genomes(spark, table(spark, sf, "orders").count(), 0.01, 0.01), 5)


def simulated_shape(spark, sf):
    """What a simulation must keep: sites per individual, letters, and alleles only beside the true bases."""
    h = _simulated(spark, sf)
    letters = F.concat("a1", "a2", "b1", "b2").rlike("^[ACGT]{4}$")
    return h.groupBy("genotype").agg(F.count("*").alias("n_sites"), F.countDistinct("position").alias("n_positions"), F.every(letters).alias("letters"))


def simulated_genotypes(spark, sf):
    """Simulated individuals: heterozygotes per site kind."""
    t, _ = truth.truth_tables(_simulated(spark, sf))
    return t.groupBy("genotype").agg(F.sum("truth_het_a").alias("het_a"), F.sum("truth_het_b").alias("het_b"), F.sum("truth_homeo").alias("homeo"))


def stream_windowed_counts(spark, sf):
    """Events per type and hour, counted as a stream that runs to its end."""
    import uuid

    from tessera.storage import shared_dir
    from tessera.streaming import ingest

    src = table(spark, sf, "events")
    out = f"{shared_dir(spark)}/tessera/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    c = ingest.windowed_counts(stream, "ts", ["event_type"])
    q = c.writeStream.outputMode("update").option("checkpointLocation", f"{out}/log").foreachBatch(lambda d, i: d.write.mode("append").parquet(f"{out}/rows")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(c.schema).parquet(f"{out}/rows").groupBy("window_start", "event_type").agg(F.max("n_rows").alias("n_rows"))  # the last update of a window has its greatest count
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n_rows")


FUNCTIONS = [het_metric, snp_metrics, snp_metrics_simulation, pooled_metrics, alleles_by_frequency, info_filter, confident_calls, site_coverage, gatk_het, gatk_letters,
             gatk_snp_metrics, truth_left, truth_right, truth_full, precision_recall, pr_curve, average_precision, method_correlation, wilson_interval, haplotype_lrt, haplotype_hypothesis,
             allele_balance, equal_coverage_test, cluster_purity, cluster_contingency, cluster_agreement, cluster_homogeneity, kmodes_update, kmodes_assign,
             kmodes_cluster, kmodes_converged, cohort_vcf_a, cohort_vcf_b, cohort_vcf_ab, stratified_counts, deblur_sequences, simulated_genotypes, simulated_shape, stream_windowed_counts]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_PP = [f"pp_{a}{b}" for a in range(3) for b in range(3)]
_LOW, _TOP = f"ln(least({', '.join(_PP)}))", f"ln(greatest({', '.join(_PP)}))"


def _mn(s: str) -> tuple[str, str]:
    p = ", ".join(f"p{s}_{i}" for i in range(3))
    return f"ln(least({p}))", f"ln(greatest({p}))"


def _site(alleles: str, other: dict[str, str], flag: str) -> str:
    homeo = lambda x, y: f"sum(case when major = {x} and minor = {y} then ln(pp_02) when major = {y} and minor = {x} then ln(pp_20) else {_LOW} end - {_TOP})"
    homo = lambda s, n, m: f"sum(case when major = {n} then ln(p{s}_0) when minor = {n} then ln(p{s}_2) else {other[s].replace('@', m)} end - {_mn(s)[1]})"
    return f"""
with i as ({duck(INFO)}),
ch as (select position_a, genotype, c, min(k) k, count(*) n from (select position_a, genotype, unnest(string_split(replace(genotype_call, '/', ''), '')) c, unnest(range(4)) k from i) group by 1, 2, 3),
rk as (select position_a, c, row_number() over (partition by position_a order by {alleles}) r from (select position_a, c, sum(n) n, min((genotype, k)) f from ch group by 1, 2)),
al as (select position_a, count(*) n_alleles, max(c) filter (r = 1) n1, coalesce(max(c) filter (r = 2), case when max(c) filter (r = 1) = 'A' then 'C' else 'A' end) n2 from rk group by 1),
mt as (select position_a, {flag} biallelic, greatest({homeo('n1', 'n2')}, {homeo('n2', 'n1')}) pp_homeo,
  -greatest({homo('a', 'n1', 'n2')}, {homo('a', 'n2', 'n1')}) pp_homo_a, -greatest({homo('b', 'n1', 'n2')}, {homo('b', 'n2', 'n1')}) pp_homo_b, avg(cov_a) cov_a, avg(cov_b) cov_b
  from i join al using (position_a) group by position_a)
"""


_REAL = _site("n desc, c", {s: _mn(s)[0] for s in "ab"}, "max(n_alleles)::int")
_SIM = _site("f, c", {s: f"(case when major = @ then ln(p{s}_2) else ln(p{s}_0) end)" for s in "ab"}, "max(n_alleles) = 2")
_R = "select position_a, biallelic, " + ", ".join(f"round({c}, 6) + 0.0 {c}" for c in METRICS) + " from mt"
_TR = """, s as (select position_a, round(pp_homeo, 6) score from mt), t as (select c_custkey position_a, (c_custkey % 2)::int truth from customer),
j as (select s.position_a, score, coalesce(truth, 0) truth from s left join t using (position_a))"""
_LATEST = "with g as (select * from gatk_info qualify row_number() over (partition by info_id order by loaded_at desc) = 1)"
_LET = _LATEST + """, h as (select *, string_split(trim(replace(genotype_call, '|', '/')), '/') d from g),
c as (select *, case d[1] when '0' then ref_a_allele || ref_a_allele when '1' then ref_a_allele || alt_a_allele when '2' then alt_a_allele || alt_a_allele end call_a,
 case d[2] when '0' then ref_b_allele || ref_b_allele when '1' then ref_b_allele || alt_b_allele when '2' then alt_b_allele || alt_b_allele end call_b from h),
l as (select *, call_a || call_b letters from c)"""


def _gatk_sql() -> str:
    pl = {f"{a}{b}": f"(pla_{a} + plb_{b})" for a in range(3) for b in range(3)}
    worst = f"greatest({', '.join(pl.values())})"
    fits = ["ref_a_allele = n1 and ref_b_allele = n1", "ref_a_allele = n1 and ref_b_allele = n2", "ref_a_allele = n2 and ref_b_allele = n2", "ref_a_allele = n2 and ref_b_allele = n1"]
    homeo = lambda names: "sum(case " + " ".join(f"when {f} then {pl[x]}" for f, x in zip(fits, names)) + f" else {worst} end)"
    homo = lambda s, n: f"sum(case when ref_{s}_allele = {n} then pl{s}_0 when alt_{s}_allele = {n} then pl{s}_2 else greatest(pl{s}_0, pl{s}_1, pl{s}_2) end)"
    return _LET + f""", ch as (select chroma, positiona, positionb, unnest(string_split(letters, '')) c, genotype, unnest(range(4)) k from l where letters is not null),
rk as (select chroma, positiona, positionb, c, row_number() over (partition by chroma, positiona, positionb order by min((genotype, k))) r from ch group by 1, 2, 3, 4),
al as (select chroma, positiona, positionb, count(*) na, max(c) filter (r = 1) n1, coalesce(max(c) filter (r = 2), case when max(c) filter (r = 1) = 'A' then 'C' else 'A' end) n2 from rk group by 1, 2, 3)
select l.chroma, l.positiona, l.positionb, max(na) = 2 biallelic, round(-0.1 * least({homeo(['02', '00', '20', '22'])}, {homeo(['20', '22', '02', '00'])}), 6) pp_homeo,
 round(-0.1 * least({homo('a', 'n1')}, {homo('a', 'n2')}), 6) pp_homo_a, round(-0.1 * least({homo('b', 'n1')}, {homo('b', 'n2')}), 6) pp_homo_b
from l join al on l.chroma is not distinct from al.chroma and l.positiona = al.positiona and l.positionb = al.positionb where letters is not null and l.chroma is not null group by 1, 2, 3"""


def _pooled_sql() -> str:
    v = lambda n, x: f"case when {n} = 1 then 0.0 when {n} > 2 then 'nan'::double else round({x}1 + {x}2 - {x}m, 6) end"
    top = {s: f"ln(greatest(p{s}_0, p{s}_1, p{s}_2))" for s in "ab"}
    per = ", ".join(
        f"sum(case when {s}_1 <> major and {s}_1 <> minor then 0 when {s}_1 = minor then ln(p{s}_2) else ln(p{s}_0) end) {s}1, "
        f"sum(case when {s}_2 <> major and {s}_2 <> minor then 0 when {s}_2 = major then ln(p{s}_0) else ln(p{s}_2) end) {s}2, "
        f"sum(case when {s}_1 <> major and {s}_1 <> minor and not {s}_2 = major then 0 else {top[s]} end) {s}m"
        for s in "ab"
    )
    return f"""
with i as ({duck(INFO)}),
k as (select *, genotype_call g, string_split(genotype_call, '/')[1] a, string_split(genotype_call, '/')[2] b from i),
u as (select position_a, 'g' kind, g txt from k union all select position_a, 'a', a from k union all select position_a, 'b', b from k),
n as (select position_a, kind, c, count(*) n from u join (values ('A'), ('C'), ('G'), ('T')) l(c) on contains(txt, c) group by 1, 2, 3),
r as (select *, row_number() over (partition by position_a, kind order by n desc, c) r from n),
al as (select position_a, {', '.join(f"count(*) filter (kind = '{x}') {x}_n, max(c) filter (kind = '{x}' and r = 1) {x}_1, max(c) filter (kind = '{x}' and r = 2) {x}_2" for x in 'gab')} from r group by 1),
s as (select position_a, max(g_n) g_n, max(a_n) a_n, max(b_n) b_n,
 sum(case when major = g_1 and minor = g_2 then ln(pp_02) when major = g_2 and minor = g_1 then ln(pp_20) else 0 end) h1,
 sum(case when major = g_1 and minor = g_2 then ln(pp_20) when major = g_2 and minor = g_1 then ln(pp_02) else 0 end) h2,
 sum(case when (major = g_1 and minor = g_2) or (major = g_2 and minor = g_1) then {_TOP} else 0 end) hm, {per}
 from i join al using (position_a) group by 1)
select position_a, {v('g_n', 'h')} pp_homeo, {v('a_n', 'a')} pp_homo_a, {v('b_n', 'b')} pp_homo_b from s"""


def _cohort_sql(kind: str) -> str:
    sides = "ab" if kind == "ab" else kind
    ref = " || ".join(f"substr('ACTG', (1 + (position_a + {0 if s == 'a' else 1}) % 4)::int, 1)" for s in sides)
    own = "string_split(gc, '/')" if kind == "ab" else f"string_split(string_split(gc, '/')[{1 if kind == 'a' else 2}], '')"
    depth = " || ':' || ".join(f"v.cov_{s}::bigint" for s in sides)
    entry, metric = {"a": ("PPHA", "pp_homo_a"), "b": ("PPHA", "pp_homo_b"), "ab": ("PPH0", "pp_homeo")}[kind]
    text = lambda i: f"coalesce(max(array_to_string(list_transform(own, lambda x: list_position(list_prepend(ref, alts), x) - 1), '/') || ':' || depth) filter (genotype = 'ind{i}'), './.') ind{i}"
    return _REAL + f""", w as (select position_a, genotype, max(struct_pack(genotype_call := genotype_call, cov_a := cov_a, cov_b := cov_b)) v from i group by 1, 2),
x as (select *, v.genotype_call gc, {ref} ref, {depth} depth from w), y as (select *, {own} own from x),
z as (select position_a, list_filter(list_sort(list_distinct(flatten(list(own)))), lambda q: q <> max(ref)) alts from y group by 1)
select 'chr{"A/chrB" if kind == "ab" else kind.upper()}' chrom, position_a pos, {"position_a pos_b, " if kind == "ab" else ""}max(ref) "ref", case when len(any_value(alts)) > 0 then array_to_string(any_value(alts), ',') else '.' end alt,
 format('{entry}={{:e}}', max(round({metric}, 4) + 0.0)) info, '{"GT:DPA:DPB" if kind == "ab" else "GT:DP"}' "format", {", ".join(text(i) for i in range(5))}
from y join z using (position_a) join mt using (position_a) group by position_a"""


_T4 = """
with n as (select sample_id, upper(hash_sequence) c, sum(abundance) n from hash_seqs where abundance is not null group by 1, 2),
g as (select sample_id, list(n order by n desc) t from n group by 1),
q as (select sample_id, coalesce(t[1], 0)::bigint n1, coalesce(t[2], 0)::bigint n2, coalesce(t[3], 0)::bigint n3, coalesce(t[4], 0)::bigint n4 from g),
w as (select *, least(greatest(case when n3 + n4 > 0 then (n1 + n2) / (n3 + n4)::double else 100 end, 0.01), 100) w4, least(greatest(case when n2 + n3 > 0 then n1 / (n2 + n3)::double else 100 end, 0.01), 100) w3 from q)
"""
_NL = lambda x: f"(case when {x} > 0 then ({x}) * ln({x}) else 0 end)"
_Z = 1.959963984540054
ORACLE = {
    "het_metric": f"select genotype, position_a, genotype_call, round(ln(pa_1) - greatest(ln(pa_0), ln(pa_2)), 6) pp_het_a, round(ln(pb_1) - greatest(ln(pb_0), ln(pb_2)), 6) pp_het_b from ({duck(INFO)})",
    "snp_metrics": _REAL + _R,
    "snp_metrics_simulation": _SIM + _R,
    "pooled_metrics": _pooled_sql(),
    "alleles_by_frequency": _REAL + "select position_a, n_alleles::int n_alleles, n1, n2 from al",
    "info_filter": f"select genotype, position_a, genotype_call, cov_a, cov_b from ({duck(INFO)}) where cov_a >= 8 and cov_b >= 8",
    "confident_calls": f"select genotype, position_a, genotype_call from ({duck(INFO)}) where greatest({', '.join(_PP)}) >= 0.18",
    "site_coverage": f"select genotype, position_a, genotype_call, cov_a, round(avg(cov_a) over (partition by position_a), 6) mean_cov_a, round(avg(cov_b) over (partition by position_a), 6) mean_cov_b from ({duck(INFO)})",
    "gatk_het": _LATEST + "select info_id, round(0.1 * (least(pla_0, pla_2) - pla_1), 6) pp_het_a, round(0.1 * (least(plb_0, plb_2) - plb_1), 6) pp_het_b from g",
    "gatk_letters": _LET + "select info_id, call_a, call_b, letters from l",
    "gatk_snp_metrics": _gatk_sql(),
    "truth_left": _REAL + _TR + "select position_a, score, truth from j",
    "truth_right": _REAL + _TR + "select t.position_a, truth, score from t left join s using (position_a)",
    "truth_full": _REAL + _TR + "select position_a, coalesce(score, 0) score, coalesce(truth, 0) truth from s full join t using (position_a)",
    "precision_recall": _REAL + _TR + """, n as (select count(*) filter (score > -20 and truth = 1) tp, count(*) filter (score > -20 and truth <> 1) fp, count(*) filter (score <= -20 and truth = 1) fn, count(*) filter (score <= -20 and truth <> 1) tn from j)
select *, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) recall from n""",
    "pr_curve": _REAL + _TR + """, k as (select score, sum(truth)::bigint p, count(*) n from j group by 1)
select score, p hits, sum(p) over (order by score desc)::bigint tp, sum(n) over (order by score desc)::bigint n, round(sum(p) over (order by score desc) / sum(n) over (order by score desc), 6) as precision,
 round(sum(p) over (order by score desc) / (select sum(p) from k), 6) recall from k""",
    "average_precision": _REAL + _TR + """, k as (select score, sum(truth)::bigint p, count(*) n from j group by 1), c as (select p, sum(p) over (order by score desc) / sum(n) over (order by score desc) pr from k)
select round(sum(p * pr) / sum(p), 6) average_precision from c""",
    "method_correlation": f"select round(corr(a.s, b.s), 5) correlation, count(*) n from ({_REAL} select position_a, pp_homo_a s from mt) a join ({_SIM} select position_a, pp_homo_a s from mt) b using (position_a)",
    "wilson_interval": rf"""
with a as (select lower(regexp_replace(trim(rname), ':\d+-\d+$', '')) rname, flag from alignments qualify row_number() over (partition by aln_id order by loaded_at desc, read_id desc) = 1),
g as (select rname, count(*) filter ((flag & 16) <> 0) k, count(*) n from a where (flag & 4) = 0 group by 1), h as (select *, k / n::double p, 2 * (n + {_Z} * {_Z}) d from g)
select rname, k, n, round(greatest((2 * n * p + {_Z} * {_Z} - ({_Z} * sqrt(greatest({_Z} * {_Z} - 1 / n::double + 4 * n * p * (1 - p) + (4 * p - 2), 0)) + 1)) / d, 0), 6) low,
 round(least((2 * n * p + {_Z} * {_Z} + ({_Z} * sqrt(greatest({_Z} * {_Z} - 1 / n::double + 4 * n * p * (1 - p) + (4 * p - 2), 0)) + 1)) / d, 1), 6) high from h""",
    "haplotype_lrt": _T4 + f"""select sample_id, n1, n2, n3, n4, round(w4, 5) w_four, round(w3, 5) w_three,
 round(2 * ({_NL('n1')} + {_NL('n2')} + {_NL('n3')} + {_NL('n4')} - {_NL('n1 + n2 + n3 + n4')} - ((n1 + n2) * ln(w4 / (2 * (1 + w4))) + (n3 + n4) * ln(1 / (2 * (1 + w4))))), 5) lrt_four,
 round(2 * ({_NL('n1')} + {_NL('n2')} + {_NL('n3')} - {_NL('n1 + n2 + n3')} - (n1 * ln(w3 / (1 + w3)) + (n2 + n3) * ln(1 / (2 * (1 + w3))))), 5) lrt_three,
 round(2 * ({_NL('n1')} + {_NL('n2')} - {_NL('n1 + n2')} - (n1 + n2) * ln(0.5)), 5) lrt_two,
 round(exp(-greatest(2 * ({_NL('n1')} + {_NL('n2')} + {_NL('n3')} + {_NL('n4')} - {_NL('n1 + n2 + n3 + n4')} - ((n1 + n2) * ln(w4 / (2 * (1 + w4))) + (n3 + n4) * ln(1 / (2 * (1 + w4))))), 0) / 2), 5) p_four from w""",
    "allele_balance": _T4 + "select sample_id, n1, n2, round((n1 - n2) * (n1 - n2) / (n1 + n2)::double, 5) chi2 from q where n1 + n2 > 0",
    "cluster_contingency": "select cluster_id a, run_id b, count(*) n from kmodes_obs where cluster_id is not null and run_id is not null group by 1, 2",
    "cluster_homogeneity": "with c as (select cluster_id a, obs_id % 3 b, count(*) n from kmodes_obs where cluster_id is not null group by 1, 2), g as (select a, sum(n) n, sum(n * (n - 1)) s from c group by 1 having sum(n) > 1) select round(avg(s / (n * (n - 1))), 6) bhi, count(*) n_clusters from g",
    "cluster_agreement": """
with c as (select cluster_id a, cluster_id % 7 b, count(*)::double n from kmodes_obs where cluster_id is not null group by 1, 2),
t as (select sum(n) t, sum(n * (n - 1) / 2) s, sum(n * ln(n)) h from c),
ra as (select sum(n * (n - 1) / 2) sa, sum(n * ln(n)) la from (select sum(n) n from c group by a)), rb as (select sum(n * (n - 1) / 2) sb, sum(n * ln(n)) lb from (select sum(n) n from c group by b)),
v as (select *, ln(t) - la / t ha, ln(t) - lb / t hb, ln(t) - h / t hj, t * (t - 1) / 2 p from t, ra, rb), m as (select *, ha + hb - hj mi, sa * sb / p ex from v)
select t::bigint n, round(mi, 5) mi, round(mi / least(ha, hb), 5) nmi_min, round(mi / sqrt(ha * hb), 5) nmi_geo, round(2 * mi / (ha + hb), 5) nmi_mean, round(mi / greatest(ha, hb), 5) nmi_max, round(mi / hj, 5) nmi_joint,
 round(ha + hb - 2 * mi, 5) vi, round(1 - mi / hj, 5) nvi, round((p + 2 * s - sa - sb) / p, 5) rand, round((s - ex) / ((sa + sb) / 2 - ex), 5) ari from m""",
    "kmodes_update": """
with e as (select cluster_id, unnest(dmat) code, unnest(range(len(dmat))) site from kmodes_obs where cluster_id is not null),
n as (select cluster_id, site, code, count(*) n from e where code is not null group by 1, 2, 3)
select cluster_id as cluster, site::int site, code from n qualify row_number() over (partition by cluster_id, site order by n desc, code) = 1""",
    "kmodes_assign": """
with e as (select cluster_id, unnest(dmat) code, unnest(range(len(dmat))) site from kmodes_obs where cluster_id is not null),
n as (select cluster_id, site, code, count(*) n from e where code is not null group by 1, 2, 3),
m as (select cluster_id c, list(code order by site) md from (select * from n qualify row_number() over (partition by cluster_id, site order by n desc, code) = 1) group by 1),
d as (select obs_id, c, list_sum(list_transform(list_zip(dmat, md), lambda p: (p[1] is distinct from p[2])::int)) d from kmodes_obs cross join m)
select obs_id, c as cluster, d::int distance from d qualify row_number() over (partition by obs_id order by d, c) = 1""",
    **{f"cohort_vcf_{k}": _cohort_sql(k) for k in ("a", "b", "ab")},
    "kmodes_converged": "select count(*) n_rows, 0::bigint n_open, true cheaper, true falls from kmodes_obs",
    "stratified_counts": "select run_id, least(count(*), 50)::bigint n_rows from kmodes_obs where run_id is not null group by 1",
    "simulated_shape": "select 'ind' || i genotype, n n_sites, n n_positions, true letters from range(5) r(i), (select count(*) n from orders)",
    "stream_windowed_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') window_start, event_type, count(*) n_rows from events group by 1, 2",
    "cluster_purity": f"""
with p as (select *, read_no % 5 as cluster, case when ll_a > ll_b then 1.0 else 0.0 end pp from ({duck(PILEUP)})),
g as (select site, cluster, count(*) n_reads, avg(pp) pa from p group by 1, 2), r as (select *, row_number() over (partition by site order by n_reads desc, cluster)::int size_rank,
 case when pa >= 0.7 then 'A' when pa <= 0.3 then 'B' else 'mixed' end subgenome from g),
i as (select *, row_number() over (partition by site, subgenome order by size_rank) i, count(*) over (partition by site, subgenome) k from r)
select site, cluster, n_reads, round(pa, 6) proportion_a, size_rank, subgenome, case when subgenome = 'mixed' or i > 2 then 'excluded' when k = 1 then subgenome || '1+' || subgenome || '2' else subgenome || i end chromosome from i""",
}

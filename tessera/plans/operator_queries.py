"""Queries of read, likelihood, test and table operators on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql, stats
from tessera.operators import clusters, coverage_tests as T, fastx, likelihood, metrics as M, ordering, reads, vcf
from tessera.plans.adapters import INFO, PILEUP, duck, spark_sql
from tessera.plans.dataset_queries import table
from tessera.plans.read_queries import _A, distinct_alignments


def reads_by_length(spark, sf):
    """Reads within a range of lengths."""
    return reads.by_length(distinct_alignments(spark, sf), 90, 100).select("aln_id")


def reads_by_strand(spark, sf):
    """Reads of the reverse strand."""
    return reads.by_strand(distinct_alignments(spark, sf), True).select("aln_id")


def reads_within_errors(spark, sf):
    """Reads with at most a tenth of an expected error."""
    return fastx.max_errors(distinct_alignments(spark, sf), 0.1).select("aln_id")


def reads_trimmed(spark, sf):
    """Reads cut to a length."""
    return fastx.trim_to_length(distinct_alignments(spark, sf), 50).select("aln_id", "seq", "qual")


def reads_reversed(spark, sf):
    """Reads as the other strand has them."""
    return fastx.reverse_complement_reads(distinct_alignments(spark, sf).withColumn("seq", F.upper("seq"))).select("aln_id", "seq", "qual")


def read_report(spark, sf):
    """Length and expected errors of every named read."""
    d = distinct_alignments(spark, sf).where("qual is not null").withColumn("name", F.col("aln_id").cast("string"))
    return fastx.read_report(d)


def read_names(spark, sf):
    """Read names without their last part."""
    from tessera.functions import seq

    return distinct_alignments(spark, sf).select("aln_id", seq.strip_name(F.concat("qname", F.lit("/1"))).alias("name"))


def nearest_sequence(spark, sf):
    """Nearest other sequence of equal length, for every sequence whose id is divisible by 50."""
    d = table(spark, sf, "hash_seqs").where("hash_sequence is not null").select("seq_id", F.upper("hash_sequence").alias("seq"))
    return fastx.nearest_other(d.where("seq_id % 50 = 0"), d, "seq_id", "seq")


def abundance_ranks(spark, sf):
    """Clusters by size."""
    return clusters.abundance_ranks(table(spark, sf, "kmodes_obs"), "cluster_id")


def paralog_anti_join(spark, sf):
    """Observations outside small clusters of their run."""
    o = table(spark, sf, "kmodes_obs").where("cluster_id is not null and run_id is not null")
    small = o.groupBy("run_id", "cluster_id").count().where("count < 10")
    return T.exclude_paralogs(o, small, ["run_id"], "cluster_id").select("obs_id")


def haplotype_balance(spark, sf):
    """Wilson interval of the two largest clusters of every run."""
    o = table(spark, sf, "kmodes_obs").where("cluster_id is not null and run_id is not null")
    c = o.groupBy("run_id", "cluster_id").agg(F.count("*").alias("n_reads"))
    return T.haplotype_balance(c, ["run_id"]).withColumns({x: F.round(x, 6) for x in ("low", "high")})


def read_p_values(spark, sf):
    """Share of an individual's B coverages at least as large as each A coverage."""
    g = table(spark, sf, "gatk_info").where("genotype is not null")
    p = T.read_p_values(g.where("cova is not null").select("genotype", F.col("cova").alias("s")), g.where("covb is not null").select("genotype", F.col("covb").alias("s")), ["genotype"], "s")
    return p.groupBy("genotype", "s").agg(F.count("*").alias("n"), F.round(F.max("p_value"), 9).alias("p_value"))


def loglik_quantiles(spark, sf):
    """Seven quantiles of the best read likelihood per site."""
    return likelihood.loglik_quantiles(spark_sql(spark, sf, PILEUP), ["site"])


def error_observations(spark, sf):
    """Errors only: reference base, quality, read base and log probability."""
    p = likelihood.with_emission(spark_sql(spark, sf, PILEUP).withColumn("rd_idx", F.col("read_no") % 8), "ref_a")
    e = likelihood.error_observations(p.withColumnRenamed("ref_a", "ref_base"), errors_only=True)
    return e.groupBy("read_pos", "ref_base", "qual", "read_base").agg(F.count("*").alias("n"), F.round(F.max("logp"), 6).alias("logp"))


def het_table(spark, sf):
    """The heterozygosity file: distinct rows with mean coverage."""
    d = M.het_table(spark_sql(spark, sf, INFO))
    return d.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("pp_het_a", "pp_het_b", "mean_cov_a", "mean_cov_b")}).distinct()


ROWS = "select l_orderkey chrom, l_linenumber * 1000000 + l_partkey pos, case when l_suppkey % 3 = 0 then '0/1' else '1/1' end gt, case when l_suppkey % 3 = 0 then l_discount * 30 end et, 'PASS' status from lineitem"


def corrected_calls(spark, sf):
    """Heterozygous calls after their equal-coverage test."""
    return vcf.correct_by_test(spark_sql(spark, sf, ROWS)).groupBy("gt").agg(F.count("*").alias("n"))


def posthoc_filter(spark, sf):
    """Filters after a coverage test on haplotypes, by a table of failures."""
    rows = spark_sql(spark, sf, ROWS).withColumnRenamed("status", "filter")
    return vcf.apply_posthoc(rows, rows.where("et > 2").select("chrom", "pos")).groupBy("filter").agg(F.count("*").alias("n"))


def information_criteria(spark, sf):
    """AIC and BIC of every order's fit."""
    o = table(spark, sf, "orders")
    ll, k, n = -F.col("o_totalprice"), F.col("o_custkey") % 9, F.lit(1000)
    return o.select("o_orderkey", F.round(stats.aic(ll, k), 4).alias("aic"), F.round(stats.bic(ll, k, n), 4).alias("bic"))


def shuffled_rows(spark, sf):
    """All sequences in a random order."""
    return ordering.shuffle_rows(table(spark, sf, "hash_seqs"), ["seq_id"]).select("seq_id", "abundance")


def sql_functions(spark, sf):
    """The scalar functions called from SQL text."""
    sql.register(spark)
    a = distinct_alignments(spark, sf)
    return spark.sql("""select aln_id, cigar_ref_len(cigar) ref_len, cigar_read_len(cigar) read_len, round(expected_errors(qual), 6) errors, reverse_complement(upper(seq)) rc,
        round(emit_logp('A', upper(left(seq, 1)), 30), 6) logp, round(emit_prob('A', upper(left(seq, 1)), 30), 6) prob, round(chi2_sf2(cast(flag % 64 as double)), 9) tail from {a}""", a=a)


FUNCTIONS = [reads_by_length, reads_by_strand, reads_within_errors, reads_trimmed, reads_reversed, read_report, read_names, nearest_sequence, abundance_ranks, paralog_anti_join, haplotype_balance,
             read_p_values, loglik_quantiles, error_observations, het_table, corrected_calls, posthoc_filter, information_criteria, shuffled_rows, sql_functions]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_EE = "coalesce(list_sum(list_transform(string_split(nullif(qual, ''), ''), lambda c: pow(10.0::double, -(ascii(c) - 33) / 10.0::double))), 0)"
_RC = "translate(reverse(upper(seq)), 'ACGTUNRYKMSWBDHV', 'TGCAANYRMKSWVHDB')"
_Z = stats.Z95
_ROOT = f"({_Z} * sqrt(greatest({_Z} * {_Z} - 1 / n + 4 * n * p * (1 - p) + (4 * p - 2), 0)) + 1)"
_Q = {"q0": 0.0, "q025": 0.025, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q975": 0.975, "q1": 1.0}
_LEN = "list_sum(list_transform(regexp_extract_all(cigar, '[0-9]+[{ops}]'), lambda x: x[:-2]::int))"
ORACLE = {
    "reads_by_length": _A + "select aln_id from a where length(seq) between 90 and 100",
    "reads_by_strand": _A + "select aln_id from a where (flag & 16) <> 0",
    "reads_within_errors": _A + f"select aln_id from a where qual is not null and {_EE} <= 0.1",
    "reads_trimmed": _A + "select aln_id, seq[1:50] seq, qual[1:50] qual from a",
    "reads_reversed": _A + f"select aln_id, {_RC} seq, reverse(qual) qual from a",
    "read_report": _A + f"select aln_id::varchar as name, length(seq)::int length, round({_EE}, 6) expected_errors from a where qual is not null",
    "read_names": _A + "select aln_id, qname as name from a",
    "nearest_sequence": "with s as (select seq_id, upper(hash_sequence) s from hash_seqs where hash_sequence is not null) select q.seq_id, min(hamming(q.s, x.s))::int distance, arg_min(x.seq_id, (hamming(q.s, x.s), x.seq_id)) nearest from s q join s x on length(q.s) = length(x.s) and q.seq_id <> x.seq_id where q.seq_id % 50 = 0 group by 1",
    "abundance_ranks": "select cluster_id, count(*) n, row_number() over (order by count(*) desc, cluster_id)::int rank from kmodes_obs where cluster_id is not null group by 1",
    "paralog_anti_join": "select obs_id from kmodes_obs where cluster_id is not null and run_id is not null qualify count(*) over (partition by run_id, cluster_id) >= 10",
    "haplotype_balance": f"""
with c as (select run_id, count(*) n from kmodes_obs where cluster_id is not null and run_id is not null group by run_id, cluster_id),
t as (select run_id, list(n order by n desc) l from c group by 1), h as (select run_id, l[1] n1, coalesce(l[2], 0)::bigint n2, (l[1] + coalesce(l[2], 0))::double n, l[1] / (l[1] + coalesce(l[2], 0))::double p from t),
w as (select *, greatest((2 * n * p + {_Z} * {_Z} - {_ROOT}) / (2 * (n + {_Z} * {_Z})), 0) low, least((2 * n * p + {_Z} * {_Z} + {_ROOT}) / (2 * (n + {_Z} * {_Z})), 1) high from h)
select run_id, n1, n2, round(low, 6) low, round(high, 6) high, low > 0.5 or high < 0.5 fails from w""",
    "read_p_values": """
with o as (select genotype, cova s, count(*) n from gatk_info where genotype is not null and cova is not null group by 1, 2), b as (select genotype, covb v, count(*) k from gatk_info where genotype is not null and covb is not null group by 1, 2)
select o.genotype, s, n, round((coalesce(sum(k) filter (v >= s), 0) + 1) / (coalesce(sum(k), 0) + 1), 9) p_value from o left join b on o.genotype = b.genotype group by 1, 2, 3""",
    "loglik_quantiles": f"with l as (select site, list(greatest(ll_a, ll_b) order by greatest(ll_a, ll_b)) l from ({duck(PILEUP)}) group by 1) select site, " + ", ".join(f"l[least(floor(len(l) * {q})::int + 1, len(l))] {k}" for k, q in _Q.items()) + " from l",
    "error_observations": f"select read_no % 8 read_pos, ref_a ref_base, q qual, base read_base, count(*) n, round(max(-q * ln(10.0::double) / 10.0 - ln(3.0::double)), 6) logp from ({duck(PILEUP)}) where ref_a <> base group by 1, 2, 3, 4",
    "het_table": f"""
with h as (select *, ln(pa_1) - greatest(ln(pa_0), ln(pa_2)) ha, ln(pb_1) - greatest(ln(pb_0), ln(pb_2)) hb, avg(cov_a) over (partition by position_a, position_b, chrom_a, chrom_b) ma, avg(cov_b) over (partition by position_a, position_b, chrom_a, chrom_b) mb from ({duck(INFO)}))
select distinct position_a, position_b, genotype, chrom_a, chrom_b, round(ha, 6) + 0.0 pp_het_a, round(hb, 6) + 0.0 pp_het_b, round(ma, 6) mean_cov_a, round(mb, 6) mean_cov_b from h""",
    "corrected_calls": f"select case when et is null then gt when et >= -log10(0.05::double) then './.' else '0/1' end gt, count(*) n from ({duck(ROWS)}) group by 1",
    "posthoc_filter": f"with r as ({duck(ROWS)}) select case when exists (select 1 from r f where f.et > 2 and f.chrom = r.chrom and f.pos = r.pos) then 'sc5' else 'PASS' end as \"filter\", count(*) n from r group by 1",
    "information_criteria": "select o_orderkey, round(2 * (o_custkey % 9) + 2 * o_totalprice, 4) aic, round((o_custkey % 9) * ln(1000) + 2 * o_totalprice, 4) bic from orders",
    "shuffled_rows": "select seq_id, abundance from hash_seqs",
    "sql_functions": _A + f"""select aln_id, coalesce({_LEN.format(ops='MDN=X')}, 0)::int ref_len, coalesce({_LEN.format(ops='MIS=X')}, 0)::int read_len, case when qual is not null then round({_EE}, 6) end errors, {_RC} rc,
 case when upper(seq[1]) = 'A' then round(ln(1 - 0.001::double), 6) else round(-3 * ln(10.0::double) - ln(3.0::double), 6) end logp, case when upper(seq[1]) = 'A' then round(0.999::double, 6) else round(0.001::double / 3, 6) end prob, round(exp(-(flag % 64) / 2.0::double), 9) tail from a""",
}

"""Queries of the per-site kernel: pileup, alleles, posteriors, calls and VCF rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import genotype as G, vcf
from tessera.operators.likelihood import expected_coverage, read_posteriors
from tessera.plans.adapters import PILEUP, duck, spark_sql

KEYS = ["site"]
ABS = [f"{a}{b}" for a, b in G.GENOTYPES]


def pileup(spark: SparkSession, sf: str) -> DataFrame:
    return spark_sql(spark, sf, PILEUP)


def _round(df: DataFrame, cols: list[str], n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


def site_base_counts(spark, sf):
    """Number of each base per site."""
    return G.base_counts(pileup(spark, sf), KEYS)


def loo_expected_counts(spark, sf):
    """Expected base counts per subgenome, each base weighted by its read without the site."""
    cols = [f"e{s}_{x}" for s in "ab" for x in "actg"] + ["cov_a", "cov_b"]
    return _round(G.expected_counts(pileup(spark, sf), KEYS), cols)


def top3_alleles(spark, sf):
    """Three most frequent bases per site in allele order."""
    t = G.top_alleles(G.base_counts(pileup(spark, sf), KEYS))
    return t.select("site", "nuc1", "num1", "nuc2", "num2", "nuc3", "num3", "no_alt")


def biallelic_screen(spark, sf):
    """Sites with evidence of a third allele."""
    p = pileup(spark, sf)
    sites = G.top_alleles(G.base_counts(p, KEYS)).join(G.expected_counts(p, KEYS).select("site", "cov_a", "cov_b"), "site").withColumn("min_cov", F.least("cov_a", "cov_b"))
    return G.biallelic(sites, 0.05).where("third_allele").select("site", "nuc3", "num3")


def genotype_posterior(spark, sf):
    """Posterior of the nine genotypes at every site."""
    c = G.call_sites(pileup(spark, sf), KEYS)
    return _round(c.select("site", *[f"pp_{x}" for x in ABS]), [f"pp_{x}" for x in ABS])


def genotype_marginals(spark, sf):
    """Marginal posteriors of each subgenome's genotype."""
    cols = [f"p{s}_{i}" for s in "ab" for i in range(3)]
    return _round(G.call_sites(pileup(spark, sf), KEYS).select("site", *cols), cols)


def genotype_call(spark, sf):
    """Most probable genotype pair per site with its posterior and expected coverage."""
    c = G.call_sites(pileup(spark, sf), KEYS)
    return _round(c.select("site", "nuc1", "nuc2", "g1", "g2", "genotype_call", "pp_call", "cov_a", "cov_b"), ["pp_call", "cov_a", "cov_b"])


def _called(spark, sf):
    p = pileup(spark, sf)
    refs = p.groupBy("site").agg(F.min("ref_a").alias("ref_a"), F.min("ref_b").alias("ref_b"))
    return G.call_sites(p, KEYS).join(refs, "site").withColumns({"name_a": F.lit("chrA"), "name_b": F.lit("chrB"), "pos_a": F.col("site"), "pos_b": F.col("site")})


def vcf_rows(spark, sf):
    """VCF columns of both subgenomes' records."""
    rows = vcf.site_rows(_called(spark, sf))
    return rows.select("chrom", "pos", "ref", "alt", "filter", "format", "gt", "dp")


def _sites(spark, sf):
    """All sites with their counts, alleles and references."""
    p = pileup(spark, sf)
    refs = [F.min("ref_a").alias("ref_a"), F.min("ref_b").alias("ref_b"), *G._count_bases()]
    s = G.top_alleles(G.expected_counts(p, KEYS, counts=refs)).withColumn("min_cov", F.least("cov_a", "cov_b"))
    return s.withColumns({"name_a": F.lit("chrA"), "name_b": F.lit("chrB"), "pos_a": F.col("site"), "pos_b": F.col("site")})


def vcf_third_allele(spark, sf):
    """Records of sites with evidence of a third allele."""
    return vcf.third_allele_rows(G.biallelic(_sites(spark, sf), 0.05))


def _screened(spark, sf):
    """Sites beside the coverage that is expected of each subgenome: its mean over all sites."""
    s = _sites(spark, sf)
    return s.crossJoin(F.broadcast(s.agg(F.round(F.avg("cov_a"), 6).alias("region_cov_a"), F.round(F.avg("cov_b"), 6).alias("region_cov_b"))))  # one row


def vcf_low_coverage(spark, sf):
    """Records of sites below the coverage screen."""
    return vcf.coverage_rows(_screened(spark, sf), 0.6)


def coverage_screen(spark, sf):
    """Sites that pass the coverage screen."""
    return _round(G.coverage_screen(_screened(spark, sf), 0.6).select("site", "cov_a", "cov_b"), ["cov_a", "cov_b"], 4)


def region_coverage(spark, sf):
    """Expected reads of each subgenome per site, from whole-read posteriors."""
    return _round(expected_coverage(read_posteriors(pileup(spark, sf)), KEYS), ["cov_a", "cov_b", "min_cov"])


def vcf_lines(spark, sf):
    """Complete VCF body lines with GL."""
    return vcf.lines(vcf.site_rows(_called(spark, sf), gl=True))


def genotype_table(spark, sf):
    """Flat table of calls, one row per site pair."""
    return _round(vcf.flat_table(_called(spark, sf)), ["pp_call", "cov_a", "cov_b"])


def multi_sample_vcf(spark, sf):
    """One record per site with every individual's call, missing ones as ./."""
    p = pileup(spark, sf).withColumn("sample", F.concat(F.lit("s"), F.pmod("read_no", F.lit(3)).cast("string")))
    keys = ["site", "sample"]
    refs = p.groupBy(*keys).agg(F.min("ref_a").alias("ref_a"), F.min("ref_b").alias("ref_b"))
    c = G.call_sites(p, keys).join(refs, keys).withColumns({"name_a": F.lit("chrA"), "name_b": F.lit("chrB"), "pos_a": F.col("site"), "pos_b": F.col("site")})
    return vcf.multi_sample(vcf.site_rows(c, extra=["sample"]), ["s0", "s1", "s2"])


QUERIES = {f.__name__: f for f in (site_base_counts, loo_expected_counts, top3_alleles, biallelic_screen, genotype_posterior, genotype_marginals, genotype_call, vcf_rows, vcf_third_allele, vcf_low_coverage, coverage_screen, region_coverage, vcf_lines, genotype_table, multi_sample_vcf)}

_L10, _L3 = math.log(10), math.log(3)


def _emit(t: str) -> str:
    return f"(case when {t} = base then ln(1 - pow(10.0::double, -q / 10.0::double)) else -q * {_L10!r} / 10.0 - {_L3!r} end)"


def _prob(t: str) -> str:
    return f"(case when {t} = base then 1 - pow(10.0::double, -q / 10.0::double) else pow(10.0::double, -q / 10.0::double) / 3.0 end)"


def kernel(keys: str = "site", extra: str = "") -> str:
    """DuckDB text of the whole kernel up to the table ``called``."""
    e = {0: _emit("nuc1"), 1: f"ln(({_prob('nuc1')} + {_prob('nuc2')}) / 2.0)", 2: _emit("nuc2")}
    lse = ", ".join(f"sum(greatest(ra + e{a}, rb + e{b}) + ln(1 + exp(least(ra + e{a}, rb + e{b}) - greatest(ra + e{a}, rb + e{b})))) lp_{a}{b}" for a, b in G.GENOTYPES)
    top = ", ".join(f"lp_{x}" for x in ABS)
    tot = " + ".join(f"exp(lp_{x} - t)" for x in ABS)
    best = " ".join(f"when pp_{x} = greatest({', '.join('pp_' + y for y in ABS)}) then {i}" for i, x in enumerate(ABS))
    return f"""
with p as (select *{extra} from ({duck(PILEUP)})),
r as (select *, ll_a - {_emit('ref_a')} ra, ll_b - {_emit('ref_b')} rb from p),
w as (select *, 1 / (1 + exp(rb - ra)) w from r),
ec as (select {keys}, count(*) n_cover, {', '.join(f"sum(case when base = '{x}' then w else 0 end) ea_{x.lower()}, sum(case when base = '{x}' then 1 - w else 0 end) eb_{x.lower()}" for x in 'ACTG')},
  sum(w) cov_a, sum(1 - w) cov_b from w group by {keys}),
bc as (select {keys}, base, count(*) n from p group by {keys}, base),
al as (select k.*, b.base, coalesce(bc.n, 0) n, row_number() over (partition by {', '.join('k.' + c.strip() for c in keys.split(','))} order by coalesce(bc.n, 0) desc, instr('ACTG', b.base)) i
  from (select distinct {keys} from p) k cross join (values ('A'), ('C'), ('T'), ('G')) b(base) left join bc on {' and '.join(f'bc.{c.strip()} = k.{c.strip()}' for c in keys.split(','))} and bc.base = b.base),
t3 as (select {keys}, max(base) filter (i = 1) nuc1, max(base) filter (i = 2) nuc2, max(base) filter (i = 3) nuc3,
  max(n) filter (i = 1) num1, max(n) filter (i = 2) num2, max(n) filter (i = 3) num3 from al group by {keys}),
st as (select * from t3 join ec using ({keys}) where n_cover > 0 and cov_a > 0 and cov_b > 0 and not num3 > 0.5 * least(cov_a, cov_b) / 2),
em as (select {keys}, ra, rb, {', '.join(f'{v} e{g}' for g, v in e.items())} from r join st using ({keys})),
lp as (select {keys}, {lse} from em group by {keys}),
tp as (select *, greatest({top}) t from lp),
pp as (select {keys}, {top}, {', '.join(f'exp(lp_{x} - t) / ({tot}) pp_{x}' for x in ABS)} from tp),
c0 as (select *, case {best} end g from pp),
c1 as (select c0.*, st.* exclude ({keys}), g // 3 g1, g % 3 g2, {', '.join(f'pp_{i}0 + pp_{i}1 + pp_{i}2 pa_{i}, pp_0{i} + pp_1{i} + pp_2{i} pb_{i}' for i in range(3))} from c0 join st using ({keys})),
called as (select *, (case when g1 < 2 then nuc1 else nuc2 end) || (case when g1 > 0 then nuc2 else nuc1 end) || '/' || (case when g2 < 2 then nuc1 else nuc2 end) || (case when g2 > 0 then nuc2 else nuc1 end) genotype_call,
  greatest({', '.join('pp_' + y for y in ABS)}) pp_call from c1)
"""


_K = kernel()
_VCF = """, rf as (select site, min(ref_a) ref_a, min(ref_b) ref_b from p group by 1),
v as (select 'chrA' chrom, site + 1 pos, ref_a "ref", nuc1, nuc2, num2, g1 g, cov_a cov from called join rf using (site)
union all select 'chrB', site + 1, ref_b, nuc1, nuc2, num2, g2, cov_b from called join rf using (site)),
o as (select chrom, pos, "ref", coalesce(nullif(concat_ws(',', case when nuc1 <> "ref" then nuc1 end, case when nuc2 <> "ref" and num2 > 0 then nuc2 end), ''), '.') alt, 'PASS' "filter", 'GT:DP:GQ' "format",
 case when nuc1 = "ref" then (case g when 2 then '1/1' when 1 then '0/1' else '0/0' end)
      when nuc2 = "ref" then (case g when 2 then '0/0' when 1 then '0/1' else '1/1' end)
      else (case g when 2 then '2/2' when 1 then '1/2' else '1/1' end) end gt, floor(cov + 0.5)::int dp from v)
"""
_SCREEN = """, rf as (select site, min(ref_a) ref_a, min(ref_b) ref_b from p group by 1),
s as (select *, cov_a < 0.6 * round(avg(cov_a) over (), 6) or cov_b < 0.6 * round(avg(cov_b) over (), 6) low from t3 join ec using (site) join rf using (site))"""
_ALT = """coalesce(nullif(concat_ws(',', case when nuc1 <> {r} then nuc1 end, case when nuc2 <> {r} and num2 > 0 then nuc2 end), ''), '.')"""
_GT = """case when nuc1 = "ref" then (case g when 2 then '1/1' when 1 then '0/1' else '0/0' end)
      when nuc2 = "ref" then (case g when 2 then '0/0' when 1 then '0/1' else '1/1' end)
      else (case g when 2 then '2/2' when 1 then '1/2' else '1/1' end) end"""


def _lines_sql() -> str:
    profile = {
        "a": "case g2 " + " ".join(f"when {j} then [lp_0{j}, lp_1{j}, lp_2{j}]" for j in range(3)) + " end",
        "b": "case g1 " + " ".join(f"when {j} then [lp_{j}0, lp_{j}1, lp_{j}2]" for j in range(3)) + " end",
    }
    side = lambda s, g: f"select 'chr{s.upper()}' chrom, site + 1 pos, ref_{s} \"ref\", nuc1, nuc2, num2, {g} g, cov_{s} cov, 1 - case {g} when 0 then p{s}_0 when 1 then p{s}_1 else p{s}_2 end err, {profile[s]} l from called join rf using (site)"
    return _K + f""", rf as (select site, min(ref_a) ref_a, min(ref_b) ref_b from p group by 1), v as ({side("a", "g1")} union all {side("b", "g2")}),
o as (select *, {_ALT.format(r='"ref"')} alt, {_GT} gt, floor(cov + 0.5)::int dp, case when err > 0 then least(99, floor(-10 * log10(err))::int) else 99 end gq,
  array_to_string(list_transform(case when nuc1 <> "ref" and nuc2 = "ref" then list_reverse(l) else l end, lambda x: printf('%.2f', x / {_L10!r})), ',') gl from v)
select chrom, pos, concat_ws(chr(9), chrom, pos::varchar, '.', "ref", alt, '.', 'PASS', '.', 'GT:DP:GQ:GL', concat_ws(':', gt, dp::varchar, gq::varchar, gl)) line from o"""


def _multi_sql() -> str:
    side = lambda s, g: f"select 'chr{s.upper()}' chrom, site + 1 pos, ref_{s} \"ref\", nuc1, nuc2, num2, {g} g, sample from called join rf using (site, sample)"
    samples = ", ".join(f"coalesce(max(txt) filter (sample = 's{i}'), './.') s{i}" for i in range(3))
    return kernel("site, sample", ", 's' || (read_no % 3) as sample") + f""", rf as (select site, sample, min(ref_a) ref_a, min(ref_b) ref_b from p group by 1, 2), v as ({side("a", "g1")} union all {side("b", "g2")}),
o as (select *, {_ALT.format(r='"ref"')} alt, {_GT} gt from v),
t as (select *, array_to_string(list_transform(string_split(gt, '/'), lambda i: list_concat(["ref"], string_split(alt, ','))[i::int + 1]), '/') txt from o)
select chrom, pos, "ref", coalesce(string_agg(distinct alt, ',' order by alt) filter (alt <> '.'), '.') alt, {samples}, count(*) n_called from t group by 1, 2, 3"""


ORACLE = {
    "vcf_lines": _lines_sql(),
    "multi_sample_vcf": _multi_sql(),
    "vcf_third_allele": _K + _SCREEN + " union all ".join(f"select '{x.upper()}' side, 'chr{x.upper()}' chrom, site + 1 pos, ref_{x} \"ref\", {_ALT.format(r='ref_' + x)} alt, 'al2' as \"filter\" from s where num3 > 0.05 * least(cov_a, cov_b) / 2" for x in "ab"),
    "vcf_low_coverage": _K + _SCREEN + " union all ".join(f"select '{x.upper()}' side, 'chr{x.upper()}' chrom, site + 1 pos, ref_{x} \"ref\", '.' alt, 'c60' as \"filter\" from s where low" for x in "ab"),
    "coverage_screen": _K + _SCREEN + "select site, round(cov_a, 4) cov_a, round(cov_b, 4) cov_b from s where not low",
    "region_coverage": _K + "select site, count(*) n_reads, round(sum(v), 6) cov_a, round(sum(1 - v), 6) cov_b, round(least(sum(v), sum(1 - v)), 6) min_cov from (select site, 1 / (1 + exp(ll_b - ll_a)) v from p) group by 1",
    "site_base_counts": _K + "select site, " + ", ".join(f"count(*) filter (base = '{x}') n_{x.lower()}" for x in "ACTG") + " from p group by 1",
    "loo_expected_counts": _K
    + "select site, n_cover, " + ", ".join(f"round(e{s}_{x}, 6) e{s}_{x}" for s in "ab" for x in "actg")
    + ", round(cov_a, 6) cov_a, round(cov_b, 6) cov_b, "
    + ", ".join("case " + " ".join(f"when e{s}_{x} = greatest({', '.join(f'e{s}_{y}' for y in 'actg')}) then '{x.upper()}'" for x in "actg") + f" end mode_{s}" for s in "ab")
    + " from ec",
    "top3_alleles": _K + "select site, nuc1, num1, nuc2, num2, nuc3, num3, num2 = 0 no_alt from t3",
    "biallelic_screen": _K + "select site, nuc3, num3 from t3 join ec using (site) where num3 > 0.05 * least(cov_a, cov_b) / 2",
    "genotype_posterior": _K + "select site, " + ", ".join(f"round(pp_{x}, 6) pp_{x}" for x in ABS) + " from called",
    "genotype_marginals": _K + "select site, " + ", ".join(f"round(p{s}_{i}, 6) p{s}_{i}" for s in "ab" for i in range(3)) + " from called",
    "genotype_call": _K + "select site, nuc1, nuc2, g1::int g1, g2::int g2, genotype_call, round(pp_call, 6) pp_call, round(cov_a, 6) cov_a, round(cov_b, 6) cov_b from called",
    "vcf_rows": _K + _VCF + "select * from o",
    "genotype_table": _K
    + "select 'chrA' name_a, 'chrB' name_b, site + 1 pos_a, site + 1 pos_b, genotype_call, nuc1 major, nuc2 minor, round(pp_call, 6) pp_call, "
    + ", ".join(f"round(pp_{x}, 6) pp_{x}" for x in ABS) + ", " + ", ".join(f"round(p{s}_{i}, 6) p{s}_{i}" for s in "ab" for i in range(3))
    + ", round(cov_a, 6) cov_a, round(cov_b, 6) cov_b from called",
}

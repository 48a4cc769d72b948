"""End-to-end genotyping: alignments, targets and references to calls.

One lazy plan covers all samples and targets at once; samples and targets are
keys of every step instead of processes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tessera.functions import cigar, seq
from tessera.operators import coverage_tests, genotype as G, regions, vcf
from tessera.operators.likelihood import expected_coverage, log_likelihood, read_posteriors, with_emission
from tessera.operators.reads import ReadFilter, extents, filter_reads, match_clips, overlap_targets, pair_subgenomes, strand_name
from tessera.storage import stage


@dataclass(frozen=True)
class Options:
    """Keyword options of the genotyper, with their defaults."""

    # regions in the older 0-based notation are an option of ``regions.parse_targets``
    reads: ReadFilter = field(default_factory=ReadFilter)
    min_loglik: float | None = None
    min_posterior: float = 0.0
    biallelic: float = 0.5
    equal_coverage_test: bool = False
    posthoc_test: bool = False  # marks unbalanced heterozygous sites
    posthoc_min_posterior: float | None = None
    gl: bool = False
    min_subgenomic_coverage: float = 5.0  # ``low_region`` beside the calls tells; not enforced
    coverage_screen: float | None = None  # least share of the region's coverage, in both subgenomes
    error_model: DataFrame | None = None
    amplicon: bool = False  # plain read posteriors as weights, no leave-one-out


def reads_in_targets(alignments: DataFrame, targets: DataFrame, o: Options) -> DataFrame:
    """Reads aligned once in each subgenome within a target, with matched clips: ``sample, target_id, name``."""
    t = targets.select("target_id", "b_reversed", *[f"{k}_{s}" for s in "ab" for k in ("chrom", "start", "end")])
    sides = []
    for s in "ab":
        iv = t.select("target_id", F.col(f"chrom_{s}").alias("chrom"), F.col(f"start_{s}").alias("start0"), F.col(f"end_{s}").alias("end0"))
        mine = filter_reads(alignments.where(F.col("sg") == s.upper()), o.reads)
        hit = overlap_targets(mine, iv).drop("start0", "end0")
        flip = F.col("b_reversed") if s == "b" else F.lit(False)
        hit = hit.join(F.broadcast(t.select("target_id", "b_reversed")) if t.limit(100_001).count() <= 100_000 else t.select("target_id", "b_reversed"), "target_id")
        sides.append(hit.withColumn("name", strand_name(F.col("qname"), F.col("flag"), flip)))
    both = sides[0].unionByName(sides[1])
    p = pair_subgenomes(both, ["sample", "target_id", "name", "b_reversed"], ["pos", "cigar", "seq", "qual"])
    return match_clips(p, F.col("b_reversed"))


def bases_of(pairs: DataFrame, side: str) -> DataFrame:
    """Aligned bases of one side within the matched clips; read offsets run along A's strand."""
    keys = ["sample", "target_id", "name", "b_reversed", "clip_start", "clip_end", "_n"]
    p = pairs.withColumn("_n", F.length(f"seq_{side}"))
    b = cigar.explode_bases(p, keys, f"cigar_{side}", f"pos_{side}", f"seq_{side}", f"qual_{side}")
    if side == "b":
        b = b.withColumn("rd_idx", F.when(F.col("b_reversed"), F.col("_n") - 1 - F.col("rd_idx")).otherwise(F.col("rd_idx")))
    return b.where("rd_idx >= clip_start and rd_idx < _n - clip_end").drop("clip_start", "clip_end", "_n")


def reference_extent(pairs: DataFrame, targets: DataFrame, side: str) -> DataFrame:
    """``chrom, start0, end0`` of every target on one side: the exact extent of its paired reads, widened to the target."""
    e = extents(pairs.select("target_id", F.col(f"pos_{side}").alias("pos"), F.col(f"cigar_{side}").alias("cigar")), ["target_id"])
    j = targets.select("target_id", F.col(f"chrom_{side}").alias("chrom"), F.col(f"start_{side}").alias("_s"), F.col(f"end_{side}").alias("_e")).join(e, "target_id", "left")
    return j.select("chrom", F.greatest(F.least("start0", "_s"), F.lit(0)).alias("start0"), F.greatest("end0", "_e").alias("end0"))


def pileup(alignments: DataFrame, targets: DataFrame, reference: DataFrame, o: Options = Options()) -> DataFrame:
    """Joint pileup rows: bases aligned to both positions of a homoeologous pair, with read likelihoods.

    ``reference`` has ``name, seq`` of both subgenomes.
    """
    pairs = stage(reads_in_targets(alignments, targets, o), "pairs")
    smap = stage(regions.site_map(targets), "sites")
    ranges = [reference_extent(pairs, targets, s) for s in "ab"]
    refs = stage(regions.reference_bases(reference, ranges[0].unionByName(ranges[1])), "reference")
    chroms = targets.select("target_id", "chrom_a", "chrom_b")
    one: dict[str, DataFrame] = {}
    lls = []
    for s in "ab":
        b = bases_of(pairs, s).join(chroms.select("target_id", F.col(f"chrom_{s}").alias("chrom")), "target_id")
        b = b.join(refs.withColumnRenamed("base", "ref_base"), ["chrom", "pos0"])
        b = with_emission(b, "ref_base", "logp", o.error_model).withColumn("sg", F.lit(s.upper()))
        # positions absent from the other subgenome don't count for the read's likelihood
        gone = regions.unmatched_sites(targets).where("kind = 'deleted'").select("target_id", F.col("pos_a").alias("pos0")) if s == "a" else regions.inserted_sites(targets).select("target_id", F.col("pos_b").alias("pos0"))
        lls.append(b.join(gone, ["target_id", "pos0"], "left_anti").select("sample", "target_id", "name", "sg", "logp"))
        one[s] = b
    ll = read_posteriors(log_likelihood(lls[0].unionByName(lls[1]), ["sample", "target_id", "name"]), o.min_loglik, o.min_posterior)
    keys = ["sample", "target_id", "name", "rd_idx"]
    a = one["a"].join(smap.withColumnRenamed("pos_a", "pos0"), ["target_id", "pos0"]).select(*keys, F.col("pos0").alias("pos_a"), "pos_b", "base", "q", F.col("ref_base").alias("ref_a"), "b_reversed")
    b = one["b"].select(*keys, F.col("pos0").alias("pos_b"), F.col("base").alias("base_b"), F.col("ref_base").alias("ref_b"))
    return a.join(b, [*keys, "pos_b"]).join(ll.select("sample", "target_id", "name", "ll_a", "ll_b", "pp_a"), ["sample", "target_id", "name"])


KEYS = ["sample", "target_id", "pos_a", "pos_b"]


def sites(p: DataFrame, targets: DataFrame, o: Options = Options()) -> DataFrame:
    """All sites of a pileup, judged by the expected coverage of their sample and target.

    One aggregation by read and one by site, reference bases included.
    """
    region = ["sample", "target_id"]
    reads = p.groupBy(*region, "name").agg(F.max("pp_a").alias("pp_a"))
    cov = expected_coverage(reads, region).select(*region, F.col("cov_a").alias("region_cov_a"), F.col("cov_b").alias("region_cov_b"))
    ref_b = F.when(F.col("b_reversed"), seq.complement(F.col("ref_b"))).otherwise(F.col("ref_b"))
    s = G.site_table(p, KEYS, o.biallelic, cov, o.amplicon, [F.min("ref_a").alias("ref_a"), F.min(ref_b).alias("ref_b")])
    s = s.withColumn("low_region", F.col("min_cov") < o.min_subgenomic_coverage)
    return s.join(targets.select("target_id", F.col("chrom_a").alias("name_a"), F.col("chrom_b").alias("name_b")), "target_id")


def calls_of(p: DataFrame, s: DataFrame, o: Options = Options()) -> DataFrame:
    """Calls of the sites that pass the screens, with the equal-coverage test if asked for."""
    calls = G.call_table(p, KEYS, s if o.coverage_screen is None else G.coverage_screen(s, o.coverage_screen))
    if o.equal_coverage_test:
        het = calls.where("g1 = 1 or g2 = 1").select(*KEYS, "nuc1", "nuc2", "g1", "g2")
        ect = coverage_tests.equal_coverage_test(G.without_site(p).join(het, KEYS), KEYS)
        calls = calls.join(ect, KEYS, "left")
    return calls


def genotype(alignments: DataFrame, targets: DataFrame, reference: DataFrame, o: Options = Options()) -> DataFrame:
    """Calls of every sample at every homoeologous site."""
    p = stage(pileup(alignments, targets, reference, o), "pileup")
    return calls_of(p, sites(p, targets, o), o)


def vcf_records(calls: DataFrame, o: Options = Options()) -> DataFrame:
    """VCF rows of the calls of all samples; unbalanced heterozygous sites fail if the post-hoc test is asked for."""
    rows = vcf.site_rows(calls, o.gl, o.equal_coverage_test, o.posthoc_min_posterior, extra=["sample", "target_id"])
    if not o.posthoc_test:
        return rows
    bad = [coverage_tests.unbalanced_alleles(calls, s).select("sample", "target_id", F.lit(s.upper()).alias("side"), (F.col(f"pos_{s}") + 1).alias("pos")) for s in "ab"]
    failed = bad[0].unionByName(bad[1]).withColumn("_bad", F.lit(True))
    return rows.join(failed, ["sample", "target_id", "side", "pos"], "left").withColumn("filter", F.when(F.col("_bad"), "sc5").otherwise(F.col("filter"))).drop("_bad")


def variants(alignments: DataFrame, targets: DataFrame, reference: DataFrame, o: Options = Options()) -> DataFrame:
    """All VCF rows of all samples: called sites, third alleles and sites below the coverage screen."""
    p = stage(pileup(alignments, targets, reference, o), "pileup")
    s = stage(sites(p, targets, o), "pileup-sites")
    names = ["sample", "target_id"]
    rows = vcf_records(calls_of(p, s, o), o)
    high = s if o.coverage_screen is None else G.coverage_screen(s, o.coverage_screen)
    rows = rows.unionByName(vcf.third_allele_rows(G.covered(high), names), allowMissingColumns=True)
    if o.coverage_screen is not None:
        rows = rows.unionByName(vcf.coverage_rows(s, o.coverage_screen, names), allowMissingColumns=True)
    return rows

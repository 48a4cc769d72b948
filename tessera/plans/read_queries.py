"""Queries on alignments and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import cigar, seq
from tessera.operators import fastx, ordering, reads, regions
from tessera.plans.dataset_queries import table

CLEAN = r"lower(regexp_replace(trim(rname), ':\d+-\d+$', ''))"


def alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment rows, one per delivery, with reference names in one spelling."""
    a = table(spark, sf, "alignments")
    return a.withColumn("rname", F.lower(F.regexp_replace(F.trim("rname"), r":\d+-\d+$", "")))


def distinct_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """One row per alignment, whatever the number of deliveries."""
    cols = ["read_id", "run_id", "sample_id", "sg", "qname", "flag", "rname", "pos", "cigar", "seq", "qual"]
    g = alignments(spark, sf).groupBy("aln_id").agg(F.max(F.struct("loaded_at", *cols)).alias("v"))
    return g.select("aln_id", *[F.col("v")[c].alias(c) for c in cols])


def sam_flag_filter(spark, sf):
    """Mapped reads without the supplementary bit."""
    return reads.filter_reads(distinct_alignments(spark, sf)).select("aln_id", "flag")


LIMITS = reads.ReadFilter(max_clip=8, max_indel=3, min_length=85, max_length=110)


def read_filter_report(spark, sf):
    """Alignments per first failing predicate of the filter bank."""
    return reads.filter_report(distinct_alignments(spark, sf), LIMITS, ["sg"])


def expected_errors(spark, sf):
    """Expected errors and error-free probability of every read."""
    q = F.col("qual")
    return distinct_alignments(spark, sf).select("aln_id", F.round(seq.expected_errors(q), 6).alias("expected_errors"), F.round(seq.error_free_prob(q), 6).alias("error_free"))


def cigar_lengths(spark, sf):
    """Reference and read bases consumed, longest clip and indel."""
    o = cigar.parse(F.col("cigar"))
    return distinct_alignments(spark, sf).select("aln_id", cigar.ref_len(o).cast("bigint").alias("ref_len"), cigar.read_len(o).cast("bigint").alias("read_len"), cigar.longest(o, ["S"]).alias("clip"), cigar.longest(o, ["I", "D"]).alias("indel"))


def cigar_explode(spark, sf):
    """One row per CIGAR operation."""
    d = distinct_alignments(spark, sf).select("aln_id", F.posexplode(cigar.parse(F.col("cigar"))).alias("i", "o"))
    return d.select("aln_id", "i", F.col("o.len").alias("len"), F.col("o.op").alias("op"))


def cigar_reverse(spark, sf):
    """CIGAR strings read from the other end."""
    return distinct_alignments(spark, sf).select("aln_id", cigar.render(cigar.reverse(cigar.parse(F.col("cigar")))).alias("reversed"))


def depth_by_position(spark, sf):
    """Reads and mean quality at every covered reference position."""
    b = cigar.explode_bases(distinct_alignments(spark, sf).where("(flag & 4) = 0"), ["rname"])
    return b.groupBy("rname", "pos0").agg(F.count("*").alias("depth"), F.round(F.avg("q"), 4).alias("mean_q"), F.count_if(F.col("base") == "A").alias("n_a"))


def target_windows(spark, sf):
    """Target intervals along every reference."""
    t = table(spark, sf, "target_refs").select("which_ref", F.lower("ref_name").alias("chrom"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    return t.select((F.col("which_ref") * 10 + F.col("k")).alias("target_id"), "chrom", (F.col("k") * 40000).cast("bigint").alias("start0"), (F.col("k") * 40000 + 15000).cast("bigint").alias("end0"))


def region_overlap(spark, sf):
    """Mapped alignments overlapping each target interval."""
    mapped = distinct_alignments(spark, sf).where("(flag & 4) = 0")
    return reads.overlap_targets(mapped, target_windows(spark, sf)).select("aln_id", "target_id", "start0", "end0")


def strand_names(spark, sf):
    """Read names with their strand."""
    return distinct_alignments(spark, sf).select("aln_id", reads.strand_name(F.col("qname"), F.col("flag")).alias("name"))


READ = ["run_id", "qname"]


def merge_subgenomes(spark, sf):
    """Alignments of each read per subgenome (full outer join by name)."""
    return reads.merge_subgenomes(distinct_alignments(spark, sf), READ)


def in_both_once(spark, sf):
    """Reads aligned exactly once in each subgenome."""
    return reads.in_both_once(distinct_alignments(spark, sf), READ)


def pair_subgenomes(spark, sf):
    """Both alignments of each read side by side."""
    return reads.pair_subgenomes(distinct_alignments(spark, sf), READ, ["pos", "cigar"])


def match_clips(spark, sf):
    """Longer soft clip of the two alignments at each end."""
    p = reads.pair_subgenomes(distinct_alignments(spark, sf), READ, ["pos", "cigar"])
    return reads.match_clips(p).select(*READ, "clip_start", "clip_end")


def alignment_extents(spark, sf):
    """Reference extent covered per subgenome and reference."""
    return reads.extents(distinct_alignments(spark, sf).where("(flag & 4) = 0"), ["sg", "rname"])


def selected_fastq(spark, sf):
    """Sequence of each read, from A if it is aligned there."""
    return reads.selected_fastq(distinct_alignments(spark, sf).where("seq is not null"), READ).select(*READ, "seq")


def region_parse(spark, sf):
    """Region strings taken apart, 0-based and half open."""
    t = target_windows(spark, sf).withColumn("region", F.concat("chrom", F.lit(":"), (F.col("start0") + 1).cast("string"), F.lit("-"), F.col("end0").cast("string")))
    r = t.select("target_id", seq.parse_region(F.col("region")).alias("r"))
    return r.select("target_id", "r.chrom", "r.start0", "r.end0")


def site_map(spark, sf):
    """Homoeologous position pairs from target alignments (CIGARs of the first reads of each reference)."""
    a = distinct_alignments(spark, sf).where("(flag & 4) = 0").select(F.col("aln_id").alias("target_id"), F.lit(0).cast("bigint").alias("start_a"), F.lit(1000).cast("bigint").alias("start_b"), F.lit(1500).cast("bigint").alias("end_b"), F.lit(1).cast("bigint").alias("pos"), "cigar", (F.col("flag").bitwiseAND(16) != 0).alias("b_reversed"))
    return regions.site_map(a)


def unmatched_sites(spark, sf):
    """A positions deleted or skipped in B."""
    a = distinct_alignments(spark, sf).where("(flag & 4) = 0").select(F.col("aln_id").alias("target_id"), F.lit(0).cast("bigint").alias("start_a"), F.col("pos"), "cigar")
    return regions.unmatched_sites(a)


def revcomp(spark, sf):
    """Reverse complements of the unique sequences."""
    return table(spark, sf, "hash_seqs").select("seq_id", seq.reverse_complement(F.upper("hash_sequence")).alias("rc"))


def ambiguous_sequences(spark, sf):
    """Sequences with letters other than A, C, G, T, and the same cleaned."""
    s = F.col("hash_sequence")
    return table(spark, sf, "hash_seqs").where(seq.is_ambiguous(s)).select("seq_id", seq.clean_bases(s).alias("as_a"), seq.clean_bases(s, None).alias("dropped"))


def iupac_masks(spark, sf):
    """Distribution of nucleotide masks over the unique sequences."""
    e = table(spark, sf, "hash_seqs").select(F.explode(seq.letters(F.col("hash_sequence"))).alias("c"))
    return e.groupBy(seq.iupac_mask(F.col("c")).alias("mask")).agg(F.count("*").alias("n"))


def base_by_quality(spark, sf):
    """Distribution of bases at every quality."""
    return fastx.base_by_quality(distinct_alignments(spark, sf).where("seq <> '*'")).withColumn("share", F.round("share", 6))


def unique_sequences(spark, sf):
    """Distinct read sequences with their number and first read."""
    a = distinct_alignments(spark, sf).where("seq is not null and seq <> '*'").withColumn("seq", F.upper("seq"))
    return fastx.unique_sequences(a, "seq", "read_id")


def trim_by_quality(spark, sf):
    """Bounds kept after cutting both ends by mean error."""
    d = distinct_alignments(spark, sf).where("qual is not null and qual <> '*'")
    return fastx.cut_sites(d, 0.01).select("aln_id", "first", "last")


def trim_tail(spark, sf):
    """Length kept before the first base of quality under 12."""
    d = distinct_alignments(spark, sf).where("qual is not null and qual <> '*'")
    return fastx.trim_tail_below(d, 12).select("aln_id", F.length("qual").alias("kept"))


def name_filter(spark, sf):
    """Reads whose name holds none of the given parts."""
    return fastx.drop_named(distinct_alignments(spark, sf), [":16", ":9:"], "qname").select("aln_id")


def kmer_counts(spark, sf):
    """Sequences holding each 6-letter piece."""
    k = fastx.kmers(table(spark, sf, "hash_seqs").withColumn("s", F.upper("hash_sequence")), ["seq_id"], "s", 6)
    return k.groupBy("kmer").agg(F.count("*").alias("n_seqs"))


def stratified_top(spark, sf):
    """Three most abundant sequences of every sample."""
    d = table(spark, sf, "hash_seqs").where("abundance is not null")
    return ordering.top_per_group(d, ["sample_id"], [F.desc("abundance"), F.asc("seq_id")], 3).select("sample_id", "seq_id", "abundance")


def abundance_top(spark, sf):
    """Twenty most abundant sequences."""
    return table(spark, sf, "hash_seqs").where("abundance is not null").orderBy(F.desc("abundance"), "seq_id").limit(20).select("seq_id", "abundance")


def first_delivery(spark, sf):
    """First delivery of every alignment."""
    return ordering.first_wins(table(spark, sf, "alignments").select("aln_id", "loaded_at", "pos"), ["aln_id"], [F.asc("loaded_at"), F.asc("pos")]).select("aln_id", F.unix_micros("loaded_at").alias("loaded_us"), "pos")


def running_rows(spark, sf):
    """Rows and abundance up to each sequence in a global order, without a single-task window."""
    d = table(spark, sf, "hash_seqs").select("seq_id", F.coalesce("abundance", F.lit(0)).cast("bigint").alias("n"))
    return ordering.prefix_sums(d, [F.asc("seq_id")], ["n"]).select("seq_id", "cum_n")


def five_number_summary(spark, sf):
    """Minimum, quartiles and maximum of the mapping quality per subgenome."""
    from tessera.functions import stats

    g = table(spark, sf, "alignments").where("mapq is not null").groupBy("sg").agg(stats.five_numbers(F.col("mapq")).alias("v"))
    return g.select("sg", "v.*")


def bed_subset(spark, sf):
    """Mapped alignments overlapping any target interval, each once."""
    bed = target_windows(spark, sf).select("chrom", F.col("start0").alias("start"), F.col("end0").alias("end"))
    return regions.within_bed(distinct_alignments(spark, sf).where("(flag & 4) = 0").select("aln_id", "rname", "pos", "cigar"), bed)


def chromosome_rename(spark, sf):
    """Reference names replaced by their numbers."""
    names = table(spark, sf, "target_refs").select(F.lower("ref_name").alias("old"), F.col("which_ref").cast("string").alias("new"))
    return regions.rename_chromosomes(distinct_alignments(spark, sf).select("aln_id", "rname"), names)


def stratified_sample(spark, sf):
    """Five rows of every sample by hashed order."""
    return ordering.stratified_sample(table(spark, sf, "hash_seqs"), "sample_id", ["seq_id"], 5).select("sample_id", "seq_id")


FUNCTIONS = [sam_flag_filter, read_filter_report, expected_errors, cigar_lengths, cigar_explode, cigar_reverse, depth_by_position, region_overlap, strand_names,
             merge_subgenomes, in_both_once, pair_subgenomes, match_clips, alignment_extents, selected_fastq, region_parse, site_map, unmatched_sites, revcomp,
             ambiguous_sequences, iupac_masks, base_by_quality, unique_sequences, trim_by_quality, trim_tail, name_filter, kmer_counts, stratified_top,
             abundance_top, first_delivery, running_rows, five_number_summary, bed_subset, chromosome_rename, stratified_sample]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_A = rf"""
with a as (select * exclude (rname), {CLEAN} rname from alignments
  qualify row_number() over (partition by aln_id order by loaded_at desc, read_id desc) = 1),
o0 as (select aln_id, unnest(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1)) len, unnest(regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1)) op,
  unnest(range(len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')))) i from a where regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+')),
o as (select aln_id, i::int i, len::int len, op from o0),
l as (select aln_id, coalesce(sum(len) filter (op in ('M','D','N','=','X')), 0)::bigint ref_len, coalesce(sum(len) filter (op in ('M','I','S','=','X')), 0)::bigint read_len,
  coalesce(max(len) filter (op = 'S'), 0)::int clip, coalesce(max(len) filter (op in ('I','D')), 0)::int indel, coalesce(max(len) filter (op = 'H'), 0)::int hclip from a left join o using (aln_id) group by 1),
bl as (select *, coalesce(sum(case when op in ('M','I','S','=','X') then len else 0 end) over (partition by aln_id order by i rows between unbounded preceding and 1 preceding), 0) rd0,
  coalesce(sum(case when op in ('M','D','N','=','X') then len else 0 end) over (partition by aln_id order by i rows between unbounded preceding and 1 preceding), 0) rf0 from o),
w as (select (which_ref * 10 + k)::int target_id, lower(ref_name) chrom, (k * 40000)::bigint start0, (k * 40000 + 15000)::bigint end0 from target_refs cross join range(10) r(k)),
e as (select a.*, (pos - 1)::bigint start0, (pos - 1 + ref_len)::bigint end0, ref_len, read_len, clip, hclip, indel from a join l using (aln_id)),
pr as (select run_id, qname, count(*) filter (sg = 'A') n_a, count(*) filter (sg = 'B') n_b from a group by 1, 2),
s as (select aln_id, sg, run_id, qname, pos, cigar, flag,
  coalesce(nullif(regexp_extract(cigar, '^([0-9]+H)?([0-9]+)S', 2), '')::int, 0) c5, coalesce(nullif(regexp_extract(cigar, '([0-9]+)S([0-9]+H)?$', 1), '')::int, 0) c3 from a),
z as (select x.run_id, x.qname, x.pos pos_a, x.cigar cigar_a, y.pos pos_b, y.cigar cigar_b, greatest(x.c5, y.c5) clip_start, greatest(x.c3, y.c3) clip_end, l.read_len
  from pr join s x on x.run_id is not distinct from pr.run_id and x.qname is not distinct from pr.qname and x.sg = 'A' join s y on y.run_id is not distinct from pr.run_id and y.qname is not distinct from pr.qname and y.sg = 'B' join l on l.aln_id = x.aln_id where n_a = 1 and n_b = 1)
"""
_CH = "unnest(string_split(qual, '')) c"
ORACLE = {
    "sam_flag_filter": _A + "select aln_id, flag from a where (flag & 4) = 0 and (flag & 2048) = 0",
    "read_filter_report": _A + """select sg, case when (flag & 4) <> 0 then 'unmapped' when (flag & 2048) <> 0 then 'secondary' when clip >= 8 then 'soft_clip' when hclip >= 8 then 'hard_clip'
  when indel >= 3 then 'indel' when read_len > 110 then 'too_long' when read_len < 85 then 'too_short' else 'kept' end reason, count(*) n_reads from e group by 1, 2""",
    "expected_errors": _A + "select aln_id, case when qual is not null then round(coalesce(list_sum(list_transform(string_split(nullif(qual, ''), ''), lambda c: pow(10.0::double, -(ascii(c) - 33) / 10.0::double))), 0), 6) end expected_errors, case when qual is not null then round(coalesce(list_product(list_transform(string_split(nullif(qual, ''), ''), lambda c: 1 - pow(10.0::double, -(ascii(c) - 33) / 10.0::double))), 1), 6) end error_free from a",
    "cigar_lengths": _A + "select aln_id, ref_len, read_len, clip, indel from l",
    "cigar_explode": _A + "select * from o",
    "cigar_reverse": _A + "select aln_id, coalesce(string_agg(len || op, '' order by i desc), '*') reversed from a left join o using (aln_id) group by 1",
    "depth_by_position": _A + """, b as (select rname, pos, seq, qual, rd0, rf0, unnest(range(len)) k from bl join a using (aln_id) where (flag & 4) = 0 and op in ('M','=','X') and seq is not null and seq <> '*'),
c as (select rname, (pos - 1 + rf0 + k)::bigint pos0, upper(seq)[(rd0 + k + 1)::bigint] base, case when qual <> '*' and length(qual) > rd0 + k then ascii(qual[(rd0 + k + 1)::bigint]) - 33 end q from b)
select rname, pos0, count(*) depth, round(avg(q), 4) mean_q, count(*) filter (base = 'A') n_a from c where base <> '' group by 1, 2""",
    "region_overlap": _A + "select aln_id, target_id, e.start0, e.end0 from e join w on e.rname = w.chrom and e.start0 < w.end0 and e.end0 > w.start0 where (flag & 4) = 0 and e.end0 > e.start0",
    "strand_names": _A + "select aln_id, qname || case when (flag & 16) <> 0 then '-' else '+' end as name from a",
    "merge_subgenomes": _A + "select * from pr",
    "in_both_once": _A + "select run_id, qname from pr where n_a = 1 and n_b = 1",
    "pair_subgenomes": _A + "select run_id, qname, pos_a, cigar_a, pos_b, cigar_b from z",
    "match_clips": _A + "select run_id, qname, clip_start, clip_end from z where clip_start + clip_end < read_len",
    "alignment_extents": _A + "select sg, rname, min(start0) start0, max(end0) end0 from e where (flag & 4) = 0 and end0 > start0 group by 1, 2",
    "selected_fastq": _A + "select run_id, qname, seq from (select run_id, qname, seq, row_number() over (partition by run_id, qname order by sg, seq, qual) r from a where seq is not null) where r = 1",
    "region_parse": _A + "select target_id, chrom, start0, end0 from w",
    "site_map": _A + """, b as (select aln_id, flag, rd0, rf0, unnest(range(len)) k, h from bl join a using (aln_id) join (select aln_id, coalesce(max(len) filter (i = 0 and op = 'H'), 0) h from o group by 1) using (aln_id) where (flag & 4) = 0 and op in ('M','=','X'))
select aln_id target_id, (rf0 + k)::bigint pos_a, (case when (flag & 16) <> 0 then 1499 - (h + rd0 + k) else 1000 + h + rd0 + k end)::bigint pos_b from b""",
    "unmatched_sites": _A + ", b as (select aln_id, pos, op, rf0, unnest(range(len)) k from bl join a using (aln_id) where (flag & 4) = 0 and op in ('D', 'N')) select aln_id target_id, (pos - 1 + rf0 + k)::bigint pos_a, case op when 'D' then 'deleted' else 'skipped' end kind from b",
    "revcomp": "select seq_id, translate(reverse(upper(hash_sequence)), 'ACGTUNRYKMSWBDHV', 'TGCAANYRMKSWVHDB') rc from hash_seqs",
    "ambiguous_sequences": "select seq_id, regexp_replace(upper(hash_sequence), '[^ACGT]', 'A', 'g') as_a, regexp_replace(upper(hash_sequence), '[^ACGT]', '', 'g') dropped from hash_seqs where regexp_matches(upper(hash_sequence), '[^ACGT]')",
    "iupac_masks": "select case upper(c) when 'A' then 1 when 'C' then 2 when 'T' then 4 when 'G' then 8 when 'N' then 15 else 0 end mask, count(*) n from (select unnest(string_split(hash_sequence, '')) c from hash_seqs) group by 1",
    "base_by_quality": _A + ", b as (select upper(unnest(string_split(seq, ''))) base, unnest(string_split(qual, '')) c from a where seq <> '*'), g as (select ascii(c) - 33 q, base, count(*) n from b where c is not null and base is not null group by 1, 2) select q, base, n, round(n / sum(n) over (partition by q), 6) share from g",
    "unique_sequences": _A + "select upper(seq) seq, count(*) n_reads, min(read_id) first_idx from a where seq is not null and seq <> '*' group by 1",
    "trim_by_quality": _A + """, q as (select aln_id, length(qual) n, unnest(string_split(qual, '')) c, unnest(range(1, length(qual) + 1)) i from a where qual is not null and qual <> '*'),
qe as (select aln_id, n, i, pow(10.0::double, -(ascii(c) - 33) / 10.0::double) e from q),
qm as (select aln_id, n, i, sum(e) over (partition by aln_id order by i) / i f, sum(e) over (partition by aln_id order by i desc) / (n - i + 1) b from qe)
select aln_id, coalesce(min(i) filter (f <= 0.01), max(n) + 1)::int "first", coalesce(max(i) filter (b <= 0.01), 0)::int "last" from qm group by 1""",
    "trim_tail": _A + "select aln_id, coalesce(list_position(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33 < 12), true) - 1, length(qual))::int kept from a where qual is not null and qual <> '*'",
    "name_filter": _A + "select aln_id from a where not coalesce(contains(qname, ':16'), false) and not coalesce(contains(qname, ':9:'), false)",
    "kmer_counts": "select kmer, count(*) n_seqs from (select distinct seq_id, upper(hash_sequence)[k:k + 5] kmer from (select seq_id, hash_sequence, unnest(range(1, length(hash_sequence) - 4)) k from hash_seqs)) group by 1",
    "stratified_top": "select sample_id, seq_id, abundance from hash_seqs where abundance is not null qualify row_number() over (partition by sample_id order by abundance desc, seq_id) <= 3",
    "abundance_top": "select seq_id, abundance from hash_seqs where abundance is not null order by abundance desc, seq_id limit 20",
    "first_delivery": "select aln_id, epoch_us(loaded_at) loaded_us, pos from alignments qualify row_number() over (partition by aln_id order by loaded_at, pos) = 1",
    "five_number_summary": "select sg, min(mapq)::double low, quantile_cont(mapq, 0.25) q25, quantile_cont(mapq, 0.5) median, quantile_cont(mapq, 0.75) q75, max(mapq)::double high from alignments where mapq is not null group by 1",
    "bed_subset": _A + "select distinct aln_id, e.rname, pos, cigar from e join w on e.rname = w.chrom and e.start0 < w.end0 and e.end0 > w.start0 where (flag & 4) = 0 and e.end0 > e.start0",
    "chromosome_rename": _A + "select aln_id, coalesce(which::varchar, rname) rname from a left join (select lower(ref_name) old, min(which_ref) which from target_refs group by 1) n on n.old = rname",
    "running_rows": "select seq_id, sum(coalesce(abundance, 0)) over (order by seq_id)::bigint cum_n from hash_seqs",
}

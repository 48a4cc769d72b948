"""Queries of readers and writers: tables become text files and are read back whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import regions, vcf
from tessera.plans.adapters import INFO, duck, spark_sql
from tessera.plans.dataset_queries import table
from tessera.plans.genotype_queries import _K, _VCF, _called
from tessera.sources import readers, writers
from tessera.storage import scratch


def _put(df: DataFrame, name: str, header: list[str] | None = None) -> str:
    """Write a ``value`` column as text, in the order it has, and return its path."""
    path = scratch(df.sparkSession, name)
    if header:
        writers.write_text(df, path, header)
    else:
        df.select("value").write.text(path)
    return path


def _sam(spark: SparkSession, sf: str) -> str:
    return _put(writers.sam_lines(table(spark, sf, "alignments")), "sam", writers.sam_header(table(spark, sf, "target_refs")))


SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def sam_scan(spark, sf):
    """All alignments, written as SAM and read back."""
    return readers.sam(spark, _sam(spark, sf)).select(*SAM)


def sam_scan_stranded(spark, sf):
    """Read names with their strand, as the scan appends it."""
    return readers.sam(spark, _sam(spark, sf), strand_suffix=True, sample="s", sg="A").select("qname", "flag", "pos", "sample", "sg")


def sam_references(spark, sf):
    """References of a SAM header."""
    return readers.sam_references(spark, _sam(spark, sf))


def _records(spark, sf):
    d = table(spark, sf, "hash_seqs").where("hash_sequence is not null")
    return d.select("seq_id", "abundance", F.col("seq_id").cast("string").alias("name"), F.col("hash_sequence").alias("seq"), F.repeat(F.lit("I"), F.length("hash_sequence")).alias("qual"))


def _fastq(spark, sf):
    return _put(writers.fastq_lines(_records(spark, sf).orderBy("seq_id")), "fastq")


def _fasta(spark, sf):
    return _put(writers.fasta_lines(_records(spark, sf)), "fasta")


def fastq_scan(spark, sf):
    """Sequences as FASTQ and back, with the number of each record."""
    return readers.fastq(spark, _fastq(spark, sf), index=True)


def fastq_filtered(spark, sf):
    """Records without ambiguous letters and within a range of lengths."""
    return readers.fastq(spark, _fastq(spark, sf), drop_ambiguous=True, min_length=150, max_length=220).select("name", "seq")


def fastq_count(spark, sf):
    """Number of records of a file."""
    return readers.fastq(spark, _fastq(spark, sf)).agg(F.count("*").alias("n_records"), F.sum(F.length("seq")).alias("n_letters"))


def fastq_note_lines(spark, sf):
    """FASTQ records that carry a note in their header line."""
    d = _records(spark, sf).withColumn("note", F.concat(F.lit("ppA="), F.coalesce(F.col("abundance").cast("string"), F.lit("NA"))))
    return writers.fastq_lines(d, note="note")


def fasta_scan(spark, sf):
    """Sequences as wrapped FASTA and back."""
    return readers.fasta(spark, _fasta(spark, sf))


def fastx_scan(spark, sf):
    """A file whose format shows in its first letter."""
    return readers.fastx(spark, _fasta(spark, sf))


def region_extract(spark, sf):
    """A slice of every sequence of a FASTA file."""
    f = readers.fasta(spark, _fasta(spark, sf))
    return regions.extract(f, f.select(F.col("name").alias("chrom"), F.lit(2).alias("start0"), F.lit(40).alias("end0")))


def fasta_bases(spark, sf):
    """Bases of a FASTA file by position, counted."""
    b = regions.reference_bases(readers.fasta(spark, _fasta(spark, sf)), width=16)
    return b.groupBy("base").agg(F.count("*").alias("n"), F.sum("pos0").alias("places"))


def fasta_index(spark, sf):
    """Rows of a FASTA index."""
    d = table(spark, sf, "target_refs").select(F.concat_ws("\t", "ref_name", F.col("ref_length").cast("string"), (F.col("which_ref") * 10).cast("string"), F.lit("60"), F.lit("61")).alias("value"))
    return readers.faidx(spark, _put(d, "fai"))


def _targets(spark, sf):
    t = table(spark, sf, "target_refs")
    name = lambda s: F.max(F.when(F.col("sg") == s, F.concat("ref_name", F.lit(":1-"), F.col("ref_length").cast("string"))))
    g = t.groupBy("pair_no").agg(name("A").alias("a"), name("B").alias("b"))
    return readers.targets(spark, _put(g.select(F.concat_ws("\t", F.col("pair_no").cast("string"), "a", "b").alias("value")), "targets"))


def target_regions(spark, sf):
    """Target pairs with both regions parsed."""
    return regions.parse_targets(_targets(spark, sf)).drop("region_a", "region_b")


def target_bed(spark, sf):
    """Targets as BED rows, written and read back."""
    b = regions.targets_to_bed(_targets(spark, sf), "region_a")
    return readers.bed(spark, _put(b.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("value")), "bed"))


ERRORS = "select distinct cast(l_quantity as int) q, substr('ACGT', cast(1 + l_linenumber % 4 as int), 1) true_base, cast(l_suppkey as int) pos, substr('ACGT', cast(1 + l_partkey % 4 as int), 1) read_base, l_discount prob from lineitem"


def error_table_scan(spark, sf):
    """An error table as text and back."""
    d = spark_sql(spark, sf, ERRORS).select(F.concat_ws(" ", F.col("q").cast("string"), "true_base", F.col("pos").cast("string"), "read_base", F.col("prob").cast("string")).alias("value"))
    return readers.error_table(spark, _put(d, "errors", ["q true pos read prob"])).drop("row_no")


def art_profile_scan(spark, sf):
    """Quality profile of a read simulator: qualities and cumulative counts per base and position."""
    n = spark_sql(spark, sf, "select substr('ACGT', cast(1 + l_linenumber % 4 as int), 1) base, cast(l_suppkey as int) pos, cast(l_quantity as int) q, count(*) n from lineitem group by 1, 2, 3")
    v = F.array_sort(F.collect_list(F.struct("q", "n")))  # at most one entry a quality
    g = n.groupBy("base", "pos").agg(v.alias("v"))
    sums = F.transform("v", lambda x, i: F.aggregate(F.slice("v", 1, i + 1), F.lit(0).cast("bigint"), lambda s, y: s + y["n"]).cast("string"))
    line = lambda values: F.concat_ws("\t", "base", F.col("pos").cast("string"), F.array_join(values, "\t"))
    d = g.select(F.concat_ws("\n", line(F.transform("v", lambda x: x["q"].cast("string"))), line(sums)).alias("value"))
    return readers.art_profile(spark, _put(d, "art"))


def error_profile_scan(spark, sf):
    """A 16-row error matrix on one line, scaled by 1000."""
    n = table(spark, sf, "lineitem").groupBy(((F.col("l_partkey") % 16) * 10 + F.col("l_linenumber") % 10).cast("int").alias("i")).count()
    all_ = spark.range(160).select(F.col("id").cast("int").alias("i")).join(n, "i", "left").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("count", F.lit(0)).alias("n")))).alias("v"))  # 160 entries
    d = all_.select(F.array_join(F.transform("v", lambda x: x["n"].cast("string")), ",").alias("value"))
    return readers.error_profile(spark, _put(d, "profile"))


def base_table_scan(spark, sf):
    """Share of each base by quality, as text and back."""
    share = [F.round(F.count_if(F.col("l_linenumber") == i) / F.count("*"), 6).cast("string") for i in range(1, 5)]
    d = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.concat_ws(" ", *share).alias("v"))
    return readers.base_table(spark, _put(d.select(F.concat_ws(" ", F.col("q").cast("string"), "v").alias("value")), "bases"))


def partition_scan(spark, sf):
    """One label per observation in file order, numbered."""
    d = table(spark, sf, "kmodes_obs").orderBy("obs_id").select(F.coalesce(F.col("cluster_id").cast("string"), F.lit("NA")).alias("value"))
    return readers.partition_file(spark, _put(d, "partition"))


def categorical_scan(spark, sf):
    """Categorical rows with a truth column, numbered in file order."""
    d = table(spark, sf, "kmodes_obs").orderBy("obs_id").select(F.concat_ws(" ", F.coalesce("cluster_id", F.lit(-1)).cast("string"), F.array_join(F.transform("dmat", lambda x: F.coalesce(x, F.lit(-7)).cast("string")), " ")).alias("value"))
    return readers.categorical_matrix(spark, _put(d, "matrix"), truth_column=0, shift=1)


def tsv_scan(spark, sf):
    """A table with a header as TSV and back, NA for null."""
    path = scratch(spark, "tsv")
    writers.write_tsv(table(spark, sf, "gatk_info").select("info_id", "genotype", "positiona", "cova", "pla_0"), path)
    d = readers.tsv(spark, path)
    return d.select(F.col("info_id").cast("bigint"), "genotype", *[F.col(c).cast("bigint") for c in ("positiona", "cova", "pla_0")])


def united_tables(spark, sf):
    """Union by name of tables with different columns."""
    a, b = table(spark, sf, "gatk_info").select("info_id", "cova"), table(spark, sf, "gatk_info_copy").select("info_id", "covb")
    return readers.union_all([a, b])


def read_table_lines(spark, sf):
    """Blank-separated base codes of each sequence."""
    return writers.read_table(_records(spark, sf).withColumn("seq", F.upper("seq")))


def cluster_files(spark, sf):
    """Observations in one folder per cluster, counted from the files."""
    path = scratch(spark, "clusters")
    writers.write_clusters(table(spark, sf, "kmodes_obs").where("cluster_id is not null").select("obs_id", "cluster_id"), path, "cluster_id")
    return spark.read.parquet(path).groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("obs_id").alias("first_obs"))


def call_log_scan(spark, sf):
    """Calls and expected counts of a genotyper's text log."""
    i = spark_sql(spark, sf, INFO)
    d = i.select(F.concat(F.lit("Genotype at site: "), "genotype_call").alias("value")).unionByName(i.select(F.concat(F.lit("Expected counts genome A: "), F.col("cov_a").cast("int").cast("string"), F.lit(" 0 0 0")).alias("value")))
    return readers.call_log(spark, _put(d, "log")).select("kind", "first", "second")


def vcf_scan(spark, sf):
    """Called sites written as a VCF file with its header, sorted, and read back."""
    path = scratch(spark, "vcf")
    writers.write_vcf(vcf.lines(vcf.site_rows(_called(spark, sf))), path, vcf.header(["chrA", "chrB"], "sample", "20240101"))
    v = readers.vcf(spark, path)
    return v.select("chrom", "pos", "ref", "alt", "filter", F.col("fields")["GT"].alias("gt"), F.col("fields")["DP"].cast("int").alias("dp"))


FUNCTIONS = [sam_scan, sam_scan_stranded, sam_references, fastq_scan, fastq_filtered, fastq_count, fastq_note_lines, fasta_scan, fastx_scan, region_extract, fasta_bases, fasta_index, target_regions,
             target_bed, error_table_scan, art_profile_scan, error_profile_scan, base_table_scan, partition_scan, categorical_scan, tsv_scan, united_tables, read_table_lines, cluster_files, call_log_scan, vcf_scan]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_H = "from hash_seqs where hash_sequence is not null"
ORACLE = {
    "sam_scan": "select coalesce(qname, '0') qname, coalesce(flag, 0) flag, coalesce(rname, '*') rname, coalesce(pos, 0) pos, coalesce(mapq, 255) mapq, coalesce(cigar, '*') cigar, coalesce(rnext, '*') rnext, coalesce(pnext, 0) pnext, coalesce(tlen, 0) tlen, coalesce(seq, '*') seq, coalesce(qual, '*') qual from alignments",
    "sam_scan_stranded": "select coalesce(qname, '0') || case when (coalesce(flag, 0) & 16) <> 0 then '-' else '+' end qname, coalesce(flag, 0) flag, coalesce(pos, 0) pos, 's' sample, 'A' sg from alignments",
    "sam_references": "select ref_name, ref_length from target_refs",
    "fastq_scan": f"select row_number() over (order by seq_id) - 1 read_idx, seq_id::varchar as name, upper(hash_sequence) seq, repeat('I', length(hash_sequence)) qual {_H}",
    "fastq_filtered": f"select seq_id::varchar as name, upper(hash_sequence) seq {_H} and regexp_full_match(upper(hash_sequence), '[ACGT]*') and length(hash_sequence) between 150 and 220",
    "fastq_count": f"select count(*) n_records, sum(length(hash_sequence))::bigint n_letters {_H}",
    "fastq_note_lines": f"select '@' || seq_id || ' ppA=' || coalesce(abundance::varchar, 'NA') || chr(10) || hash_sequence || chr(10) || '+' || chr(10) || repeat('I', length(hash_sequence)) as value {_H}",
    "fasta_scan": f"select seq_id::varchar as name, '' description, upper(hash_sequence) seq {_H}",
    "fastx_scan": f"select seq_id::varchar as name, upper(hash_sequence) seq, null::varchar qual {_H}",
    "region_extract": f"select seq_id || ':3-40' as name, upper(hash_sequence[3:40]) seq {_H}",
    "fasta_bases": f"with b as (select unnest(string_split(upper(hash_sequence), '')) base, unnest(range(length(hash_sequence))) p {_H}) select base, count(*) n, sum(p)::bigint places from b group by 1",
    "fasta_index": "select ref_name as name, ref_length length, which_ref::bigint * 10 as offset, 60 linebases, 61 linewidth from target_refs",
    "target_regions": "select a.pair_no::int target_id, a.ref_name chrom_a, 0::bigint start_a, a.ref_length end_a, b.ref_name chrom_b, 0::bigint start_b, b.ref_length end_b from target_refs a join target_refs b using (pair_no) where a.sg = 'A' and b.sg = 'B'",
    "target_bed": "select ref_name chrom, 1::bigint as start, ref_length as \"end\" from target_refs where sg = 'A'",
    "error_table_scan": duck(ERRORS),
    "art_profile_scan": "select base, pos, q, sum(n) over (partition by base, pos order by q)::bigint cum from (select substr('ACGT', cast(1 + l_linenumber % 4 as int), 1) base, cast(l_suppkey as int) pos, cast(l_quantity as int) q, count(*) n from lineitem group by 1, 2, 3)",
    "error_profile_scan": "with n as (select ((l_partkey % 16) * 10 + l_linenumber % 10)::int i, count(*) n from lineitem group by 1) select substr('ACGT', (1 + i // 40)::int, 1) true_base, substr('ACGT', (1 + (i // 10) % 4)::int, 1) read_base, (i % 10)::int q, coalesce(n, 0) / 1000.0 prob from range(160) r(i) left join n using (i)",
    "base_table_scan": "select l_quantity::int q, " + ", ".join(f"round(count(*) filter (l_linenumber = {i}) / count(*), 6) p{x}" for i, x in enumerate("acgt", 1)) + " from lineitem group by 1",
    "partition_scan": "select row_number() over (order by obs_id) - 1 read_idx, coalesce(cluster_id, -1) as cluster from kmodes_obs",
    "categorical_scan": "select row_number() over (order by obs_id) - 1 obs, list_transform(dmat, lambda x: coalesce(x, -7) - 1) codes, coalesce(cluster_id, -1) truth from kmodes_obs",
    "tsv_scan": "select info_id, genotype, positiona, cova::bigint cova, pla_0::bigint pla_0 from gatk_info",
    "united_tables": "select info_id, cova, null::int covb from gatk_info union all select info_id, null, covb from gatk_info_copy",
    "read_table_lines": f"select array_to_string(list_transform(string_split(upper(hash_sequence), ''), lambda c: instr('ACTG', c)::varchar), ' ') as value {_H}",
    "cluster_files": "select cluster_id, count(*) n, min(obs_id) first_obs from kmodes_obs where cluster_id is not null group by 1",
    "call_log_scan": f"select 'genotype' kind, string_split(genotype_call, '/')[1] \"first\", string_split(genotype_call, '/')[2] \"second\" from ({duck(INFO)}) union all select 'counts_a', cov_a::int || ' 0 0 0', null from ({duck(INFO)})",
    "vcf_scan": _K + _VCF + "select chrom, pos, \"ref\", alt, \"filter\", gt, dp from o",
}

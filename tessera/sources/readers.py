"""Readers: SAM, FASTA, FASTQ, error tables, cluster files, info and VCF tables.

Text is scanned in splits by Spark and parsed with column expressions; only
formats whose records span lines in a way no expression can follow use a
grouped step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators.ordering import row_index
from tessera.storage import stage

SAM_COLUMNS = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen int, seq string, qual string"


def sam(spark: SparkSession, path: str | list[str], sample: str | None = None, sg: str | None = None, strand_suffix: bool = False, require_header: bool = True) -> DataFrame:
    """Alignment rows of SAM text; header lines are dropped.

    A file without ``@SQ`` lines is an error if ``require_header``.  Lines with
    fewer than 11 fields are left out (see the rejects operator for reasons).
    ``strand_suffix`` appends + or - to the read name.
    """
    lines = spark.read.text(path)
    if require_header and lines.where("value like '@SQ%'").isEmpty():
        raise ValueError("no @SQ header lines")
    f = F.split("value", "\t")
    rows = lines.where("value not like '@%' and value <> ''").withColumn("f", f).where(F.size("f") >= 11)
    names = [c.split() for c in SAM_COLUMNS.split(", ")]
    out = rows.select(*[(F.col("f")[i] if t == "string" else F.col("f")[i].try_cast(t)).alias(n) for i, (n, t) in enumerate(names)])
    if strand_suffix:
        out = out.withColumn("qname", F.concat("qname", F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")))
    if sample is not None:
        out = out.withColumn("sample", F.lit(sample))
    if sg is not None:
        out = out.withColumn("sg", F.lit(sg))
    return out


def sam_references(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``ref_name, ref_length`` of the @SQ lines."""
    h = spark.read.text(path).where("value like '@SQ%'")
    return h.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("ref_name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).try_cast("bigint").alias("ref_length"))


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name, description, seq`` (upper case) of single- or multi-line FASTA; records are split by Spark.

    A record begins with ``>`` at the start of a line; elsewhere it is a letter of the description.
    """
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s+", "")
    return r.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S+\s*", "")).alias("description"), F.upper(body).alias("seq"))


def _phase(lines: list[str]) -> int | None:
    """Where the first whole record begins among the first lines of a block; None if they don't tell."""
    for p in range(4):
        at = lines[p:]
        if len(at) < 4 or not at[0].startswith("@") or not at[2].startswith("+") or len(at[1]) != len(at[3]):
            continue
        if len(at) > 4 and not at[4].startswith("@"):
            continue
        return p
    return None


_HEAD, _TAIL = 1 << 10, 1 << 60  # numbers of a block's lines: those before its first record, its records, those after


def _records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records of every file block, and the lines at its ends that belong to neighbouring blocks."""
    at, lines, started, count = None, [], False, _HEAD

    def frame(h=(), s=(), q=(), rest=()) -> pd.DataFrame:
        n = len(h)
        nonlocal count
        d = pd.DataFrame({"file": [at[0]] * (n + len(rest)), "block": [at[1]] * (n + len(rest)), "no": [*range(count, count + n), *[r[0] for r in rest]], "line": [None] * n + [r[1] for r in rest]})
        count += n
        d["h"], d["s"], d["q"] = [*h, *[None] * len(rest)], [*s, *[None] * len(rest)], [*q, *[None] * len(rest)]
        return d

    def drain(last: bool) -> Iterator[pd.DataFrame]:
        nonlocal lines, started
        if not started and (len(lines) >= 12 or last):
            p = _phase(lines[:12]) if len(lines) >= 4 else None
            if p is None:  # too short to tell: its neighbours decide
                if last:
                    yield frame(rest=list(enumerate(lines)))
                    lines = []
                return
            if p:
                yield frame(rest=list(enumerate(lines[:p])))
            lines, started = lines[p:], True
        if started:
            n = len(lines) // 4 * 4
            if n:
                yield frame(lines[0:n:4], lines[1:n:4], lines[3:n:4])
            lines = lines[n:]
            if last and lines:
                yield frame(rest=[(_TAIL + i, x) for i, x in enumerate(lines)])
                lines = []

    for pdf in parts:
        cut = ((pdf["file"] != pdf["file"].shift()) | (pdf["block"] != pdf["block"].shift())).to_numpy().nonzero()[0].tolist()
        for x, y in zip(cut, [*cut[1:], len(pdf)]):
            key = (pdf["file"].iloc[x], int(pdf["block"].iloc[x]))
            if key != at:
                if at is not None:
                    yield from drain(True)
                at, lines, started, count = key, [], False, _HEAD
            lines.extend(pdf["value"].iloc[x:y])
            yield from drain(False)
    if at is not None:
        yield from drain(True)


def _stitched(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["block", "no"])
    lines = pdf["line"].tolist()
    n = len(lines) // 4 * 4
    d = pdf.iloc[0:n:4][["file", "block", "no"]].reset_index(drop=True)
    return d.assign(h=lines[0:n:4], s=lines[1:n:4], q=lines[3:n:4])


def fastq(spark: SparkSession, path: str | list[str], drop_ambiguous: bool = False, min_length: int = 0, max_length: int | None = None, index: bool = False) -> DataFrame:
    """``name, seq, qual`` of four-line FASTQ records, upper case; with ``index`` also ``read_idx``, from 0 in the order of files and records.

    The index counts all records, before any is dropped, so it joins partition
    files and denoiser results.

    Files are read in blocks: a block finds its first whole record, and the few
    lines before it join the lines left over by the block before.  Incomplete
    last records are left out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.rtrim("value").alias("value"))
    cut = stage(lines.mapInPandas(_records, "file string, block bigint, no bigint, line string, h string, s string, q string"), "fastq")
    place = "file string, block bigint, no bigint"
    ends = cut.where("line is not null").select("file", "block", "no", "line").groupBy("file").applyInPandas(_stitched, f"{place}, h string, s string, q string")
    out = cut.where("h is not null").select("file", "block", "no", "h", "s", "q").unionByName(ends).where("h like '@%'")
    if index:
        out = row_index(out, ["file", "block", "no"], "read_idx")
    out = out.select(*(["read_idx"] if index else []), F.regexp_extract("h", r"^@(\S+)", 1).alias("name"), F.upper("s").alias("seq"), F.col("q").alias("qual"))
    if drop_ambiguous:
        out = out.where(~F.col("seq").rlike("[^ACGT]"))
    out = out.where(F.length("seq") >= min_length)
    return out.where(F.length("seq") <= max_length) if max_length is not None else out


def fastx(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ by the first character; FASTA gets a null quality."""
    first = spark.read.text(path).limit(1).collect()
    if first and first[0][0].startswith("@"):
        return fastq(spark, path)
    return fasta(spark, path).select("name", "seq", F.lit(None).cast("string").alias("qual"))


def faidx(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, length bigint, offset bigint, linebases int, linewidth int")


def targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="target_id int, region_a string, region_b string")


def bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start bigint, end bigint")


def error_table(spark: SparkSession, path: str) -> DataFrame:
    """``q, true_base, pos, read_base, prob, row_no`` of a blank-separated table, header or not."""
    r = spark.read.text(path).withColumn("row_no", F.monotonically_increasing_id()).withColumn("f", F.split(F.trim("value"), r"\s+"))
    r = r.where((F.size("f") == 5) & F.col("f")[0].rlike(r"^\d+$"))
    return r.select(F.col("f")[0].cast("int").alias("q"), F.col("f")[1].alias("true_base"), F.col("f")[2].cast("int").alias("pos"), F.col("f")[3].alias("read_base"), F.col("f")[4].cast("double").alias("prob"), "row_no")


def error_profile(spark: SparkSession, path: str, scale: float = 1000.0) -> DataFrame:
    """``true_base, read_base, q, prob`` of a 16-row matrix (A, C, G, T to A, C, G, T) scaled by 1000."""
    r = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace(F.regexp_replace("value", r"^[\s,]+|[\s,]+$", ""), r"[\s,]+", ","), ",").alias("v")).where(F.size("v") >= 16)
    width = (F.size("v") / 16).cast("int")
    p = r.select(width.alias("w"), F.posexplode("v").alias("i", "x"))
    letter = lambda k: F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), k + 1)
    row = F.floor(F.col("i") / F.col("w")).cast("int")
    return p.select(letter(F.floor(row / 4).cast("int")).alias("true_base"), letter(row % 4).alias("read_base"), (F.col("i") % F.col("w")).alias("q"), (F.col("x").cast("double") / scale).alias("prob"))


def art_profile(spark: SparkSession, path: str) -> DataFrame:
    """``base, pos, q, cum`` of a read-simulator quality profile: pairs of lines, qualities then cumulative counts."""
    r = spark.read.text(path).where("value not like '#%' and trim(value) <> ''").withColumn("n", F.monotonically_increasing_id())
    f = F.split(F.trim("value"), r"\s+")
    r = r.select("n", f[0].alias("base"), f[1].cast("int").alias("pos"), F.slice(f, 3, 1_000_000).cast("array<bigint>").alias("v"))
    g = r.groupBy("base", "pos").agg(F.min(F.struct("n", "v")).alias("a"), F.max(F.struct("n", "v")).alias("b"))
    z = F.arrays_zip(F.col("a.v").alias("q"), F.col("b.v").alias("cum"))
    return g.select("base", "pos", F.explode(z).alias("z")).select("base", "pos", F.col("z.q").cast("int").alias("q"), F.col("z.cum").alias("cum"))


def base_table(spark: SparkSession, path: str) -> DataFrame:
    """``q, pa, pc, pg, pt`` of a base-by-quality table."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).withColumn("f", f).where(F.size("f") == 5).select(F.col("f")[0].cast("int").alias("q"), *[F.col("f")[i].cast("double").alias(n) for i, n in enumerate(["pa", "pc", "pg", "pt"], 1)])


def cluster_result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Assignments (``read_idx, cluster``; NA is null) and sizes (``cluster, n``) of a denoiser's text result."""
    t = spark.read.text(path)
    part = lambda key: F.split(F.trim(F.regexp_replace("value", f"^{key}:", "")), r"\s+")
    a = t.where("value like 'assignments:%'").select(F.posexplode(part("assignments")).alias("read_idx", "c")).select("read_idx", F.col("c").try_cast("int").alias("cluster"))
    s = t.where("value like 'sizes:%'").select(F.posexplode(part("sizes")).alias("cluster", "n")).select("cluster", F.col("n").try_cast("bigint").alias("n"))
    # one line of sizes: as many rows as clusters
    return a, s.withColumn("size_rank", F.row_number().over(Window.orderBy(F.desc("n"), "cluster"))).orderBy("size_rank")


def cluster_number(spark: SparkSession, path: str) -> DataFrame:
    """``k`` of a denoiser's text result."""
    return spark.read.text(path).where("value like 'K:%'").select(F.trim(F.regexp_replace("value", "^K:", "")).try_cast("int").alias("k"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``_line, value`` of the lines that hold anything, numbered so that they sort in file order."""
    t = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")).alias("_line"), "value")
    return t.where("trim(value) <> ''")


def partition_file(spark: SparkSession, path: str) -> DataFrame:
    """``read_idx, cluster`` of one label per read in file order, on one line or many; NA becomes -1."""
    t = _numbered(spark, path).select("_line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("_at", "c"))
    return row_index(t, ["_line", "_at"], "read_idx").select("read_idx", F.coalesce(F.col("c").try_cast("int"), F.lit(-1)).alias("cluster"))


def categorical_matrix(spark: SparkSession, path: str, truth_column: int | None = None, shift: int = 0) -> DataFrame:
    """``obs, codes[, truth]`` of blank-separated whole numbers, one row per line, ``obs`` its number from 0; ``shift`` is subtracted."""
    f = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("int"))
    r = row_index(_numbered(spark, path), ["_line"], "obs").select("obs", f.alias("v"))
    if truth_column is None:
        return r.select("obs", F.transform("v", lambda x: x - shift).alias("codes"))
    keep = F.filter("v", lambda x, i: i != truth_column)
    return r.select("obs", F.transform(keep, lambda x: x - shift).alias("codes"), F.col("v")[truth_column].alias("truth"))


def tsv(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """Tables with a header, all files of the paths united; NA is null, brackets in names become underscores."""
    d = spark.read.csv(paths, sep="\t", header=True, inferSchema=True, nullValue="NA", recursiveFileLookup=recursive)
    return d.toDF(*[c.strip().lower().replace("(", "_").replace(")", "").replace(",", "").replace(" ", "_") for c in d.columns])


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Union by name; absent columns are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """VCF records with the first sample's FORMAT fields as a map ``fields`` and INFO as a map ``info``."""
    f = F.split("value", "\t")
    r = spark.read.text(path).where("value not like '#%' and value <> ''").withColumn("f", f).where(F.size("f") >= 8)
    keys, vals = F.split(F.get("f", F.lit(8)), ":"), F.split(F.get("f", F.lit(9)), ":")
    n = F.least(F.size(keys), F.size(vals))
    fields = F.map_from_arrays(F.slice(keys, 1, n), F.slice(vals, 1, n))
    info = F.map_from_entries(F.transform(F.array_distinct(F.filter(F.split(F.col("f")[7], ";"), lambda x: x.contains("="))), lambda x: F.struct(F.substring_index(x, "=", 1), F.substring_index(x, "=", -1))))
    return r.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("bigint").alias("pos"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"), F.col("f")[6].alias("filter"), F.when(F.size("f") >= 10, fields).alias("fields"), info.alias("info"))


def gvcf_info(a: DataFrame, b: DataFrame, genotype: str, chroms: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Rows of the two subgenomes' gVCF records joined on chromosome and position (not by line number).

    ``chroms`` pairs the chromosomes (``chrom_a, chrom_b``), whose positions
    are then equal as in a simulation; ``sites`` (``chrom_a, pos_a, chrom_b,
    pos_b``, 1-based) pairs single positions instead.

    ``<NON_REF>`` is no allele; likelihoods and depth come from the FORMAT map,
    whatever its shape; absent ones are null.
    """

    def side(v: DataFrame, s: str) -> DataFrame:
        alt = F.filter(F.split("alt", ","), lambda x: (x != "<NON_REF>") & (x != "."))
        pl = F.split(F.col("fields")["PL"], ",")
        dosage = F.aggregate(F.split(F.translate(F.col("fields")["GT"], "|", "/"), "/"), F.lit(0), lambda acc, x: acc + F.when(x.rlike(r"^[1-9]"), 1).otherwise(0))
        gt = F.when(F.col("fields")["GT"].contains("."), ".").otherwise(dosage.cast("string"))
        return v.select(F.col("chrom").alias(f"chrom{s}"), "pos", F.col("ref").alias(f"ref_{s}_allele"), F.get(alt, F.lit(0)).alias(f"alt_{s}_allele"), *[F.get(pl, F.lit(i)).try_cast("int").alias(f"pl{s}_{i}") for i in range(3)], F.col("fields")["DP"].try_cast("int").alias(f"cov{s}"), gt.alias(f"gt_{s}"))

    left, right = side(a, "a").withColumnRenamed("pos", "positiona"), side(b, "b").withColumnRenamed("pos", "positionb")
    if sites is not None:
        pairs = sites.select(F.col("chrom_a").alias("chroma"), F.col("pos_a").alias("positiona"), F.col("chrom_b").alias("chromb"), F.col("pos_b").alias("positionb"))
        j = left.join(pairs, ["chroma", "positiona"]).join(right, ["chromb", "positionb"])
    else:
        j = left.join(chroms.select(F.col("chrom_a").alias("chroma"), F.col("chrom_b").alias("chromb")).distinct(), "chroma").withColumn("positionb", F.col("positiona")).join(right, ["chromb", "positionb"])
    return j.select(F.lit(genotype).alias("genotype"), "chroma", "chromb", "positiona", "positionb", F.concat_ws("/", "gt_a", "gt_b").alias("genotype_call"), *[f"{k}_{s}_allele" for s in "ab" for k in ("ref", "alt")], *[f"pl{s}_{i}" for s in "ab" for i in range(3)], "cova", "covb")


def call_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line_no, kind, first, second`` of a genotyper's text log, for interoperation.

    ``kind`` is ``genotype`` (calls of A and B), ``counts_a`` or ``counts_b``
    (expected counts in order A, C, T, G, as one string in ``first``).
    """
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    g = F.regexp_extract("value", r"Genotype\b.*?([ACGT]{2})/([ACGT]{2})", 1)
    h = F.regexp_extract("value", r"Genotype\b.*?([ACGT]{2})/([ACGT]{2})", 2)
    side = F.regexp_extract("value", r"Expected counts genome ([AB]):\s*(.*)$", 1)
    kind = F.when(g != "", "genotype").when(side == "A", "counts_a").when(side == "B", "counts_b")
    return t.select("file", "line_no", kind.alias("kind"), F.when(g != "", g).otherwise(F.trim(F.regexp_extract("value", r"Expected counts genome ([AB]):\s*(.*)$", 2))).alias("first"), F.when(g != "", h).alias("second")).where("kind is not null")

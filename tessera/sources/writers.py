"""Writers of text formats; each lays out one string column and lets Spark write it in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fastq_lines(df: DataFrame, name: str = "name", note: str | None = None) -> DataFrame:
    head = F.concat(F.lit("@"), F.col(name), F.concat(F.lit(" "), F.col(note)) if note else F.lit(""))
    return df.select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value"))


def fasta_lines(df: DataFrame, width: int = 60, name: str = "name") -> DataFrame:
    """Records wrapped at ``width`` letters."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("value"))


def sam_lines(df: DataFrame) -> DataFrame:
    fill = {"rname": "*", "pos": "0", "mapq": "255", "cigar": "*", "rnext": "*", "pnext": "0", "tlen": "0", "seq": "*", "qual": "*"}
    cols = ["qname", "flag", *fill]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(fill.get(c, "0"))) if c in df.columns else F.lit(fill[c]) for c in cols]
    return df.select(F.concat_ws("\t", *parts).alias("value"))


def sam_header(references: DataFrame) -> list[str]:
    """Header lines; references are a dimension table."""
    return ["@HD\tVN:1.6\tSO:unsorted", *[f"@SQ\tSN:{r['ref_name']}\tLN:{r['ref_length']}" for r in references.orderBy("ref_name").toLocalIterator()]]


def write_text(df: DataFrame, path: str, header: list[str] | None = None, order: list | None = None, single: bool = False) -> None:
    """Write the ``value`` column; rows sorted by ``order`` across files, the header as the first lines of the first file.

    With a header and no order the rows follow in any order.
    """
    keys = [F.col(k).alias(f"_o{i}") if isinstance(k, str) else k.alias(f"_o{i}") for i, k in enumerate(order or [])]
    d = df.select("value", F.lit(1).alias("_part"), F.lit(0).alias("_no"), *keys)
    names = [c for c in d.columns if c.startswith("_o")]
    if header:
        head = df.sparkSession.createDataFrame(list(enumerate(header)), "_no int, value string").withColumn("_part", F.lit(0))
        d = head.select("value", "_part", "_no", *[F.lit(None).cast(d.schema[c].dataType).alias(c) for c in names]).unionByName(d)
    if header or order:
        d = d.orderBy("_part", "_no", *names)
    d = d.select("value")
    if single:
        d = d.coalesce(1)
    d.write.mode("overwrite").text(path)


def write_vcf(lines: DataFrame, path: str, header: list[str]) -> None:
    """VCF body sorted by chromosome and position."""
    write_text(lines.withColumn("value", F.col("line")), path, header, ["chrom", "pos"])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")


def write_clusters(df: DataFrame, path: str, cluster: str) -> None:
    """One folder per cluster, so a cluster's reads are found by pruning."""
    df.write.mode("overwrite").partitionBy(cluster).parquet(path)


def read_table(df: DataFrame) -> DataFrame:
    """Blank-separated base codes of each read."""
    codes = F.array_join(F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c: F.instr(F.lit("ACTG"), c).cast("string")), " ")
    return df.select(codes.alias("value"))

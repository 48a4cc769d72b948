"""Target regions and the map between homoeologous positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.functions import cigar, seq


def parse_targets(df: DataFrame, a: str = "region_a", b: str = "region_b", legacy: bool = False) -> DataFrame:
    """Adds ``chrom_a, start_a, end_a, chrom_b, start_b, end_b`` (0-based, half open); malformed regions give nulls."""
    for side, col in (("a", a), ("b", b)):
        r = seq.parse_region(F.col(col), legacy)
        df = df.withColumn("_r", r).withColumns({f"chrom_{side}": F.col("_r.chrom"), f"start_{side}": F.col("_r.start0"), f"end_{side}": F.col("_r.end0")}).drop("_r")
    return df


def targets_to_bed(df: DataFrame, region: str) -> DataFrame:
    """``chrom, start, end`` of region strings, numbers as written."""
    parts = F.split(F.col(region), "[:-]")
    return df.select(parts[0].alias("chrom"), parts[1].cast("bigint").alias("start"), parts[2].cast("bigint").alias("end"))


def target_alignment(df: DataFrame) -> DataFrame:
    """Targets whose alignment occurs exactly once, with both regions parsed.

    ``df`` holds alignments of B target regions (QNAME) to A target regions
    (RNAME).  ``n_hits`` other than 1 is an error of the input and is left for
    the caller to report through :func:`target_errors`.
    """
    g = df.groupBy("qname").agg(F.count("*").alias("n_hits"), F.first("rname").alias("rname"), F.first("flag").alias("flag"), F.first("pos").alias("pos"), F.first("cigar").alias("cigar"))
    g = g.where("n_hits = 1").withColumn("b_reversed", F.col("flag").bitwiseAND(16) != 0)
    return parse_targets(g.withColumnsRenamed({"rname": "region_a", "qname": "region_b"}))


def target_errors(df: DataFrame) -> DataFrame:
    return df.groupBy("qname").agg(F.count("*").alias("n_hits")).where("n_hits <> 1")


def site_map(targets: DataFrame) -> DataFrame:
    """``target_id, pos_a, pos_b`` of every homoeologous position pair (0-based).

    ``targets`` has ``target_id, start_a, start_b, end_b, pos, cigar,
    b_reversed``; ``pos`` is the 1-based alignment start within the A region.
    Matches map position by position; indels, skips and clips have no pair.  A
    reversed B counts from its far end.
    """
    ops = cigar.parse(F.col("cigar"))
    # clips of the B target shift its coordinate: hard clips count as well
    hard = F.try_element_at(ops, F.lit(1))
    shift = F.when(hard["op"] == "H", hard["len"]).otherwise(0)
    t = targets.select("target_id", "start_a", "start_b", "end_b", "pos", "b_reversed", shift.alias("_h"), F.explode(cigar.blocks(ops, F.lit(0))).alias("_b"))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("_b.len") - 1)).alias("_i"))
    in_b = F.col("_h") + F.col("_b.rd0") + F.col("_i")
    pos_b = F.when(F.col("b_reversed"), F.col("end_b") - 1 - in_b).otherwise(F.col("start_b") + in_b)
    return t.select("target_id", (F.col("start_a") + F.col("pos") - 1 + F.col("_b.rf0") + F.col("_i")).alias("pos_a"), pos_b.alias("pos_b"))


def unmatched_sites(targets: DataFrame) -> DataFrame:
    """``target_id, pos_a, kind``: A positions without a partner, ``deleted`` in B or ``skipped``."""
    ops = cigar.parse(F.col("cigar"))
    zero = F.struct(F.lit(0).cast("bigint").alias("rf"), F.array().cast("array<struct<rf0:bigint,len:int,op:string>>").alias("out"))

    def step(acc, x):
        takes = x["op"].isin(cigar.REF_OPS)
        here = F.array(F.struct(acc["rf"].alias("rf0"), x["len"].alias("len"), x["op"].alias("op")))
        return F.struct((acc["rf"] + F.when(takes, x["len"]).otherwise(0)).cast("bigint").alias("rf"), F.when(x["op"].isin("D", "N"), F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    gaps = F.aggregate(ops, zero, step)["out"]
    t = targets.select("target_id", "start_a", "pos", F.explode(gaps).alias("_g")).select("*", F.explode(F.sequence(F.lit(0), F.col("_g.len") - 1)).alias("_i"))
    return t.select("target_id", (F.col("start_a") + F.col("pos") - 1 + F.col("_g.rf0") + F.col("_i")).alias("pos_a"), F.when(F.col("_g.op") == "D", "deleted").otherwise("skipped").alias("kind"))


def inserted_sites(targets: DataFrame) -> DataFrame:
    """``target_id, pos_b``: B positions inserted between A positions, which therefore have no partner."""
    ops = cigar.parse(F.col("cigar"))
    zero = F.struct(F.lit(0).alias("rd"), F.array().cast("array<struct<rd0:int,len:int>>").alias("out"))

    def step(acc, x):
        here = F.array(F.struct(acc["rd"].alias("rd0"), x["len"].alias("len")))
        takes = x["op"].isin([*cigar.READ_OPS, "H"])
        return F.struct((acc["rd"] + F.when(takes, x["len"]).otherwise(0)).alias("rd"), F.when(x["op"] == "I", F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    t = targets.select("target_id", "start_b", "end_b", "b_reversed", F.explode(F.aggregate(ops, zero, step)["out"]).alias("_g")).select("*", F.explode(F.sequence(F.lit(0), F.col("_g.len") - 1)).alias("_i"))
    at = F.col("_g.rd0") + F.col("_i")
    return t.select("target_id", F.when(F.col("b_reversed"), F.col("end_b") - 1 - at).otherwise(F.col("start_b") + at).alias("pos_b"))


def extract(fasta: DataFrame, regions: DataFrame) -> DataFrame:
    """Slices of reference sequences: ``regions`` has ``chrom, start0, end0``; names are 1-based inclusive."""
    j = regions.join(fasta.select(F.col("name").alias("chrom"), F.col("seq").alias("_s")), "chrom")
    name = F.concat_ws("", "chrom", F.lit(":"), (F.col("start0") + 1).cast("string"), F.lit("-"), F.col("end0").cast("string"))
    return j.select(name.alias("name"), F.substring("_s", F.col("start0").cast("int") + 1, (F.col("end0") - F.col("start0")).cast("int")).alias("seq"))


def reference_blocks(fasta: DataFrame, width: int = 10_000) -> DataFrame:
    """``chrom, block, bases``: sequences cut into blocks, each in one pass however long the chromosome."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, s in zip(pdf["name"], pdf["seq"]):
                for at in range(0, len(s or ""), 1000 * width):
                    pieces = [s[i : i + width].upper() for i in range(at, min(at + 1000 * width, len(s)), width)]
                    yield pd.DataFrame({"chrom": name, "block": range(at // width, at // width + len(pieces)), "bases": pieces})

    return fasta.select("name", "seq").mapInPandas(cut, "chrom string, block bigint, bases string")


def reference_bases(fasta: DataFrame, ranges: DataFrame | None = None, width: int = 10_000) -> DataFrame:
    """``chrom, pos0, base``: one row per reference position, for equi-joins.

    ``ranges`` (``chrom, start0, end0``) keeps only blocks they touch, before
    any base is exploded.
    """
    b = reference_blocks(fasta, width)
    if ranges is not None:
        need = ranges.where("end0 > start0").select("chrom", F.explode(F.sequence(F.floor(F.col("start0") / width), F.floor((F.col("end0") - 1) / width))).alias("block")).distinct()
        b = b.join(need, ["chrom", "block"], "left_semi")
    return b.select("chrom", "block", F.posexplode(seq.letters(F.col("bases"))).alias("_p", "base")).select("chrom", (F.col("block") * width + F.col("_p")).alias("pos0"), "base")


def rename_chromosomes(df: DataFrame, names: DataFrame, column: str = "rname") -> DataFrame:
    """Replace names by a table ``old, new``; unknown names stay."""
    n = names.groupBy("old").agg(F.min("new").alias("_new"))
    return df.join(n, df[column] == n["old"], "left").withColumn(column, F.coalesce("_new", column)).drop("old", "_new")


def within_bed(reads: DataFrame, bed: DataFrame) -> DataFrame:
    """Alignments that overlap any interval of ``chrom, start, end``, each once."""
    from tessera.operators.reads import overlap_targets

    iv = bed.select(F.lit(0).alias("target_id"), "chrom", F.col("start").alias("start0"), F.col("end").alias("end0")).distinct()
    r = reads.withColumn("_row", F.struct(*reads.columns))
    return overlap_targets(r, iv).select("_row").distinct().select("_row.*")

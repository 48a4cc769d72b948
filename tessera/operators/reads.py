"""Alignment-level operators: filter bank, region selection, merging of subgenomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import cigar, seq


@dataclass(frozen=True)
class ReadFilter:
    """Limits of the read filter; the defaults keep all mapped primary reads.

    ``secondary`` and ``unmapped`` drop such reads if True.  With ``compat``
    the "secondary" test looks at the supplementary bit (0x800) as the
    reference tool does, else at both 0x100 and 0x800.
    """

    unmapped: bool = True
    secondary: bool = True
    max_clip: int | None = None
    max_indel: int | None = None
    min_length: int = 0
    max_length: int = 0
    max_expected_errors: float | None = None
    compat: bool = True


def reject_reason(f: ReadFilter = ReadFilter()) -> Column:
    """First failing predicate of an alignment row (null: kept), in the documented order."""
    ops = cigar.parse(F.col("cigar"))
    length = cigar.read_len(ops)
    bits = 0x800 if f.compat else 0x900
    tests: list[tuple[str, Column]] = []
    if f.unmapped:
        tests.append(("unmapped", F.col("flag").bitwiseAND(4) != 0))
    if f.secondary:
        tests.append(("secondary", F.col("flag").bitwiseAND(bits) != 0))
    if f.max_clip is not None:
        tests.append(("soft_clip", cigar.longest(ops, ["S"]) >= f.max_clip))
        tests.append(("hard_clip", cigar.longest(ops, ["H"]) >= f.max_clip))
    if f.max_indel is not None:
        tests.append(("indel", cigar.longest(ops, ["I", "D"]) >= f.max_indel))
    if f.max_length:
        tests.append(("too_long", length > f.max_length))
    if f.min_length:
        tests.append(("too_short", length < f.min_length))
    if f.max_expected_errors is not None:
        tests.append(("expected_errors", seq.expected_errors(F.col("qual")) > f.max_expected_errors))
    out = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return out


def filter_reads(df: DataFrame, f: ReadFilter = ReadFilter()) -> DataFrame:
    """Rows passing all predicates; null flags and qualities pass the tests on them."""
    return df.where(reject_reason(f).isNull())


def filter_report(df: DataFrame, f: ReadFilter = ReadFilter(), by: list[str] | None = None) -> DataFrame:
    """Rows per first failing predicate (``kept`` for the rest)."""
    return df.groupBy(*(by or []), F.coalesce(reject_reason(f), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_reads"))


def span(df: DataFrame) -> DataFrame:
    """Adds ``start0`` and ``end0`` (half open) of each alignment on its reference."""
    return df.withColumn("start0", F.col("pos") - 1).withColumn("end0", F.col("pos") - 1 + cigar.ref_len(cigar.parse(F.col("cigar"))))


def overlap_targets(reads: DataFrame, targets: DataFrame, bin_width: int = 1 << 14) -> DataFrame:
    """Reads joined with every target interval they overlap.

    ``targets`` has ``target_id, chrom, start0, end0``.  Both sides are cut into
    position bins, so the range predicate becomes an equi-join on chromosome and
    bin; a pair is reported by the bin where the later of the two begins.  Empty
    alignments overlap nothing.
    """
    t = targets.select("target_id", F.col("chrom").alias("_chrom"), F.col("start0").alias("_s"), F.col("end0").alias("_e")).where("_e > _s")
    t = t.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / bin_width), F.floor((F.col("_e") - 1) / bin_width))))
    r = span(reads).where("end0 > start0")
    r = r.withColumn("_rbin", F.explode(F.sequence(F.floor(F.col("start0") / bin_width), F.floor((F.col("end0") - 1) / bin_width))))
    hit = (F.col("rname") == F.col("_chrom")) & (F.col("_rbin") == F.col("_bin")) & (F.col("start0") < F.col("_e")) & (F.col("end0") > F.col("_s"))
    first = F.floor(F.greatest("start0", "_s") / bin_width) == F.col("_bin")
    return r.join(t, hit & first).drop("_chrom", "_bin", "_rbin", "_s", "_e")


def strand_name(name: Column, flag: Column, flip: Column | None = None) -> Column:
    """Read name with its strand; ``flip`` turns the strand of a reverse-complemented reference."""
    reverse = (flag.bitwiseAND(16) != 0) != (flip if flip is not None else F.lit(False))
    return F.concat(name, F.when(reverse, "-").otherwise("+"))


def merge_subgenomes(df: DataFrame, keys: list[str], sg: str = "sg") -> DataFrame:
    """One row per read with its number of alignments in each subgenome.

    The full outer join of the two files is one grouped count over their union:
    no row explosion for repeated names, and partial counts before the shuffle.
    """
    return df.groupBy(*keys).agg(F.count_if(F.col(sg) == "A").alias("n_a"), F.count_if(F.col(sg) == "B").alias("n_b"))


def in_both_once(df: DataFrame, keys: list[str], sg: str = "sg") -> DataFrame:
    """Keys of reads aligned exactly once in each subgenome."""
    return merge_subgenomes(df, keys, sg).where("n_a = 1 and n_b = 1").select(*keys)


def pair_subgenomes(df: DataFrame, keys: list[str], fields: list[str], sg: str = "sg") -> DataFrame:
    """One row per read aligned once in each subgenome, with ``<field>_a`` and ``<field>_b``."""
    aggs = [F.count_if(F.col(sg) == "A").alias("n_a"), F.count_if(F.col(sg) == "B").alias("n_b")]
    for s in ("A", "B"):
        aggs.append(F.max(F.when(F.col(sg) == s, F.struct(*fields))).alias(f"_{s}"))
    g = df.groupBy(*keys).agg(*aggs).where("n_a = 1 and n_b = 1")
    return g.select(*keys, *[F.col(f"_{s}")[f].alias(f"{f}_{s.lower()}") for s in ("A", "B") for f in fields])


def extents(df: DataFrame, keys: list[str]) -> DataFrame:
    """First and last reference position covered per key (0-based, half open)."""
    return span(df).where("end0 > start0").groupBy(*keys).agg(F.min("start0").alias("start0"), F.max("end0").alias("end0"))


def selected_fastq(df: DataFrame, keys: list[str], sg: str = "sg") -> DataFrame:
    """Sequence and quality of each read: the A alignment if there is one, else B."""
    best = F.min(F.struct(F.col(sg), F.col("seq"), F.col("qual")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.seq").alias("seq"), F.col("_b.qual").alias("qual"))


def match_clips(pairs: DataFrame, b_reversed: Column | None = None) -> DataFrame:
    """Adds ``clip_start`` and ``clip_end``: the longer soft clip of the two alignments at each end.

    Works on :func:`pair_subgenomes` rows with ``cigar_a, cigar_b, seq_a``.  If
    B is reverse-complemented its ends are exchanged.  Reads clipped as a whole
    are dropped; bases are kept where ``clip_start <= rd_idx < length - clip_end``.
    """
    a, b = cigar.parse(F.col("cigar_a")), cigar.parse(F.col("cigar_b"))
    flip = b_reversed if b_reversed is not None else F.lit(False)
    b5 = F.when(flip, cigar.clip(b, "end")).otherwise(cigar.clip(b, "start"))
    b3 = F.when(flip, cigar.clip(b, "start")).otherwise(cigar.clip(b, "end"))
    out = pairs.withColumn("clip_start", F.greatest(cigar.clip(a, "start"), b5)).withColumn("clip_end", F.greatest(cigar.clip(a, "end"), b3))
    return out.where(F.col("clip_start") + F.col("clip_end") < cigar.read_len(a))


def common_extent(pairs: DataFrame) -> DataFrame:
    """Adds the reference extent both alignments of a read cover, relative to each region's start."""
    sa, sb = F.col("pos_a") - F.col("region_a"), F.col("pos_b") - F.col("region_b")
    ea, eb = sa + cigar.ref_len(cigar.parse(F.col("cigar_a"))), sb + cigar.ref_len(cigar.parse(F.col("cigar_b")))
    return pairs.withColumn("extent_start", F.greatest(sa, sb)).withColumn("extent_end", F.least(ea, eb)).where("extent_end > extent_start")


def by_length(df: DataFrame, low: int | None = None, high: int | None = None, column: str = "seq") -> DataFrame:
    n = F.length(column)
    return df.where((n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else F.lit(True)))


def by_strand(df: DataFrame, reverse: bool) -> DataFrame:
    return df.where((F.col("flag").bitwiseAND(16) != 0) == F.lit(reverse))

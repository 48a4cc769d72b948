"""Multi-sample VCF tables of a cohort: one for each subgenome and one of site pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SITE = ["chrom_a", "position_a", "chrom_b", "position_b"]
# INFO entry and metric of each table
ENTRIES = {"a": ("PPHA", "pp_homo_a"), "b": ("PPHA", "pp_homo_b"), "ab": ("PPH0", "pp_homeo")}


def header(kind: str, references: list[str], samples: list[str], date: str, source: str = "tessera") -> list[str]:
    """Header lines of the table ``a``, ``b`` or ``ab``; the last has a position column for each subgenome."""
    what = {"a": "Posterior of a homologous SNP in A", "b": "Posterior of a homologous SNP in B", "ab": "Posterior of a homoeologous SNP"}[kind]
    out = ["##fileformat=VCFv4.2", f"##fileDate={date}", f"##source={source}", *[f"##reference=file://{r}" for r in references]]
    out.append(f'##INFO=<ID={ENTRIES[kind][0]},Number=A,Type=Float,Description="{what}">')
    out.append('##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">')
    depths = [("DP", "Read depth")] if kind != "ab" else [("DPA", "Read depth in A"), ("DPB", "Read depth in B")]
    out += [f'##FORMAT=<ID={d},Number=1,Type=Integer,Description="{t}">' for d, t in depths]
    place = ["POS"] if kind != "ab" else ["POS_A", "POS_B"]
    return [*out, "\t".join(["#CHROM", *place, "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def records(info: DataFrame, metrics: DataFrame, bases_a: DataFrame, bases_b: DataFrame, kind: str, samples: list[str]) -> DataFrame:
    """``chrom, pos[, pos_b], ref, alt, info, format`` and a column per sample, one row per site.

    ``info`` has a row per sample and site (:data:`SITE`, ``genotype, call_a,
    call_b, cov_a, cov_b``), ``metrics`` one per site, the reference bases
    ``chrom, pos0, base``.  Alleles are letters in ``a`` and ``b``, pairs of
    letters (the two bases a subgenome carries) in ``ab``; they are numbered
    with the reference first and the others in order.  A sample without a call
    has ``./.``; sites without a reference base are left out.
    """
    sides = ["a", "b"] if kind == "ab" else [kind]
    d = info
    for s, bases in (("a", bases_a), ("b", bases_b)):
        if s in sides:
            d = d.join(bases.select(F.col("chrom").alias(f"chrom_{s}"), (F.col("pos0") + 1).alias(f"position_{s}"), F.col("base").alias(f"ref_{s}")), [f"chrom_{s}", f"position_{s}"])
    ref = F.concat(*[F.col(f"ref_{s}") for s in sides])
    letters = F.array("call_a", "call_b") if kind == "ab" else F.filter(F.split(f"call_{kind}", ""), lambda x: x != "")
    d = d.withColumn("_ref", ref).withColumn("_own", letters)
    depth = F.concat_ws(":", *[F.col(f"cov_{s}").cast("bigint").cast("string") for s in sides])
    mine = F.struct(F.col("_own").alias("own"), depth.alias("depth"))
    g = d.groupBy(*SITE).agg(
        F.max("_ref").alias("ref"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_own")))).alias("_seen"),
        *[F.max(F.when(F.col("genotype") == x, mine)).alias(f"_s{i}") for i, x in enumerate(samples)],
    )
    g = g.join(metrics.select(*SITE, ENTRIES[kind][1]), SITE).withColumn("_alt", F.array_remove("_seen", F.col("ref")))
    alleles = F.concat(F.array("ref"), F.col("_alt"))

    def text(c: Column) -> Column:
        numbers = F.transform(c["own"], lambda x: (F.array_position(alleles, x) - 1).cast("string"))
        return F.when(c.isNull(), "./.").otherwise(F.concat_ws(":", F.array_join(numbers, "/"), c["depth"]))

    chrom = F.concat_ws("/", *[F.col(f"chrom_{s}") for s in sides]).alias("chrom")
    place = [F.col(f"position_{sides[0]}").alias("pos")] + ([F.col("position_b").alias("pos_b")] if kind == "ab" else [])
    value = F.format_string(f"{ENTRIES[kind][0]}=%e", ENTRIES[kind][1])
    fmt = F.lit("GT:DPA:DPB" if kind == "ab" else "GT:DP")
    alt = F.when(F.size("_alt") > 0, F.array_join("_alt", ",")).otherwise(".")
    return g.select(chrom, *place, "ref", alt.alias("alt"), value.alias("info"), fmt.alias("format"), *[text(F.col(f"_s{i}")).alias(x) for i, x in enumerate(samples)])


def lines(rows: DataFrame) -> DataFrame:
    """``chrom, pos, line`` of complete tab-separated records."""
    place = ["chrom", F.col("pos").cast("string"), *([F.col("pos_b").cast("string")] if "pos_b" in rows.columns else [])]
    rest = [c for c in rows.columns if c not in ("chrom", "pos", "pos_b", "ref", "alt", "info", "format")]
    return rows.select("chrom", "pos", F.concat_ws("\t", *place, F.lit("."), "ref", "alt", F.lit("."), F.lit("."), "info", "format", *[F.col(f"`{c}`") for c in rest]).alias("line"))

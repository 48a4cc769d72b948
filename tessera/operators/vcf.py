"""VCF records of called sites: rows, lines, headers, post-hoc filters, multi-sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.genotype import genotype_quality, low_coverage

LN10 = 2.302585092994046


def header(chroms: list[str], sample: str, date: str, source: str = "tessera", equal_test: bool = False, posthoc: bool = False, gl: bool = False, coverage: float | None = None, min_quality: int | None = None, reference: str | None = None, clustering: bool = False) -> list[str]:
    """Header lines; FILTER and FORMAT entries only for what the records use.

    Records by ``clustering`` have the filters of indels instead of the per-site ones.
    """
    out = ["##fileformat=VCFv4.2", f"##fileDate={date}", f"##source={source}"]
    if reference is not None:
        out.append(f"##reference={reference}")
    out.append("##phasing=no")
    out += [f"##contig=<ID={c}>" for c in chroms]
    if clustering:
        posthoc, coverage, equal_test = False, None, False
        out += ['##FILTER=<ID=sgi,Description="Indel within a subgenome">', '##FILTER=<ID=hmi,Description="Indel between the subgenomes">']
    else:
        out.append('##FILTER=<ID=al2,Description="More than two alleles">')
    if posthoc:
        out.append('##FILTER=<ID=sc5,Description="Coverage test on haplotypes failed at 5 percent">')
        if min_quality is not None:
            out.append(f'##FILTER=<ID=gq{min_quality},Description="Heterozygous call below quality {min_quality}">')
    if coverage is not None:
        out.append(f'##FILTER=<ID=c{round(coverage * 100)},Description="Coverage below {coverage:g} of the expected">')
    out += ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Expected depth">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">']
    if equal_test:
        out.append('##FORMAT=<ID=ET,Number=1,Type=Float,Description="Equal coverage test, minus log10 p">')
    if gl:
        out.append('##FORMAT=<ID=GL,Number=G,Type=Float,Description="Profile log10 likelihoods">')
    return [*out, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + sample]


def _alt(ref: Column, nuc1: Column, nuc2: Column, observed: Column) -> Column:
    alleles = F.concat_ws(",", F.when(nuc1 != ref, nuc1), F.when((nuc2 != ref) & (nuc2 != nuc1) & observed, nuc2))
    return F.when(alleles == "", ".").otherwise(alleles)


def _gt(ref: Column, nuc1: Column, nuc2: Column, g: Column) -> Column:
    """Allele indexes: nuc1 and nuc2 are numbered by their place among REF and ALT."""
    texts = F.when(nuc1 == ref, F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1"))).when(nuc2 == ref, F.array(F.lit("1/1"), F.lit("0/1"), F.lit("0/0")))
    return F.element_at(texts.otherwise(F.array(F.lit("1/1"), F.lit("1/2"), F.lit("2/2"))), g + 1)


def site_rows(calls: DataFrame, gl: bool = False, equal_test: bool = False, min_het_posterior: float | None = None, extra: list[str] | None = None) -> DataFrame:
    """Two records per called site: ``side, chrom, pos, ref, alt, filter, format, gt, dp, gq[, et][, gl]``.

    ``calls`` comes from the genotype kernel with ``name_a, pos_a (0-based),
    ref_a`` and the same of B, plus ``ect_a, ect_b`` p-values for ``equal_test``.
    ``min_het_posterior`` marks uncertain heterozygotes with a ``gqNN`` filter.
    """
    extra = extra or []

    def side(s: str) -> Column:
        g = F.col("g1") if s == "a" else F.col("g2")
        other = F.col("g2") if s == "a" else F.col("g1")
        err = 1 - F.element_at(F.array(*[F.col(f"p{s}_{i}") for i in range(3)]), g + 1)
        ref = F.col(f"ref_{s}")
        fields = [
            F.lit(s.upper()).alias("side"), F.col(f"name_{s}").alias("chrom"), (F.col(f"pos_{s}") + 1).alias("pos"), ref.alias("ref"),
            _alt(ref, F.col("nuc1"), F.col("nuc2"), ~F.col("no_alt")).alias("alt"), _filter(g, F.col(f"het_{s}"), min_het_posterior).alias("filter"),
        ]
        et = F.lit(equal_test) & (g == 1)
        fmt = F.concat(F.lit("GT:DP:GQ"), F.when(et, ":ET").otherwise(""), F.lit(":GL" if gl else ""))
        fields += [fmt.alias("format"), _gt(ref, F.col("nuc1"), F.col("nuc2"), g).alias("gt"), F.floor(F.col(f"cov_{s}") + 0.5).cast("int").alias("dp"), genotype_quality(err).alias("gq")]
        if equal_test:
            fields.append(F.when(g == 1, F.abs(F.log10(F.col(f"ect_{s}")))).alias("et"))
        if gl:
            def lp(i: int) -> Column:
                by_other = [F.col(f"lp_{i}{j}" if s == "a" else f"lp_{j}{i}") for j in range(3)]
                return F.element_at(F.array(*by_other), other + 1) / LN10

            order = F.when((F.col("nuc1") != ref) & (F.col("nuc2") == ref), F.array(lp(2), lp(1), lp(0))).otherwise(F.array(lp(0), lp(1), lp(2)))
            fields.append(order.alias("gl"))
        return F.struct(*fields)

    out = calls.select(*extra, F.explode(F.array(side("a"), side("b"))).alias("_r"))
    return out.select(*extra, "_r.*")


def _filter(g: Column, het: Column, least: float | None) -> Column:
    if least is None:
        return F.lit("PASS")
    import math

    quality = 99 if least >= 1 else min(99, int(-10 * math.log10(1 - least)))
    return F.when((g == 1) & (het < least), f"gq{quality}").otherwise("PASS")


def third_allele_rows(sites: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``al2`` records of sites with a third allele, without genotype."""

    def side(s: str) -> Column:
        ref = F.col(f"ref_{s}")
        return F.struct(F.lit(s.upper()).alias("side"), F.col(f"name_{s}").alias("chrom"), (F.col(f"pos_{s}") + 1).alias("pos"), ref.alias("ref"), _alt(ref, F.col("nuc1"), F.col("nuc2"), ~F.col("no_alt")).alias("alt"), F.lit("al2").alias("filter"))

    return sites.where("third_allele").select(*(extra or []), F.explode(F.array(side("a"), side("b"))).alias("_r")).select(*(extra or []), "_r.*")


def coverage_rows(sites: DataFrame, least: float = 0.9, extra: list[str] | None = None) -> DataFrame:
    """``cNN`` records of sites below the coverage screen, without alternative or genotype."""
    side = lambda s: F.struct(F.lit(s.upper()).alias("side"), F.col(f"name_{s}").alias("chrom"), (F.col(f"pos_{s}") + 1).alias("pos"), F.col(f"ref_{s}").alias("ref"), F.lit(".").alias("alt"), F.lit(f"c{round(100 * least)}").alias("filter"))
    return sites.where(low_coverage(least)).select(*(extra or []), F.explode(F.array(side("a"), side("b"))).alias("_r")).select(*(extra or []), "_r.*")


def lines(rows: DataFrame) -> DataFrame:
    """``chrom, pos, line`` of complete tab-separated records."""
    parts = [F.col("gt"), F.col("dp").cast("string"), F.col("gq").cast("string")]
    if "et" in rows.columns:
        parts.append(F.format_string("%.1f", "et"))
    if "gl" in rows.columns:
        parts.append(F.array_join(F.transform("gl", lambda x: F.format_string("%.2f", x)), ","))
    kept = [p if i < 3 else F.when(F.col("format").contains(":ET") if (i == 3 and "et" in rows.columns) else F.lit(True), p) for i, p in enumerate(parts)]
    sample = F.concat_ws(":", *kept)
    return rows.select("chrom", "pos", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), "filter", F.lit("."), "format", sample).alias("line"))


def apply_posthoc(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """FILTER ``sc5`` for records whose ``chrom, pos`` is in ``failed``, before anything is written."""
    f = failed.select("chrom", "pos").distinct().withColumn("_f", F.lit(True))
    return rows.join(f, ["chrom", "pos"], "left").withColumn("filter", F.when(F.col("_f"), "sc5").otherwise(F.col("filter"))).drop("_f")


def correct_by_test(rows: DataFrame, level: float = 0.05) -> DataFrame:
    """Heterozygous calls of a merged file by their equal-coverage test: ``./.`` if rejected, else ``0/1``."""
    limit = -F.log10(F.lit(level))
    return rows.withColumn("gt", F.when(F.col("et").isNull(), F.col("gt")).when(F.col("et") >= limit, "./.").otherwise("0/1"))


def flat_table(calls: DataFrame) -> DataFrame:
    """The flat genotype table: one row per site pair, 1-based positions, letters for alleles."""
    pp = [f"pp_{a}{b}" for a in range(3) for b in range(3)]
    return calls.select("name_a", "name_b", (F.col("pos_a") + 1).alias("pos_a"), (F.col("pos_b") + 1).alias("pos_b"), "genotype_call", F.col("nuc1").alias("major"), F.col("nuc2").alias("minor"), "pp_call", *[F.round(c, 6).alias(c) for c in pp], *[F.round(f"p{s}_{i}", 6).alias(f"p{s}_{i}") for s in "ab" for i in range(3)], "cov_a", "cov_b")


def multi_sample(rows: DataFrame, samples: list[str]) -> DataFrame:
    """One record per site with a column per sample, ``./.`` where a sample has none.

    The samples are given, so the pivot is one aggregation.  ALT joins the
    alleles of all samples; each sample keeps its own allele letters.
    """
    alleles = F.array_compact(F.array_union(F.array("ref"), F.split("alt", ",")))
    idx = F.transform(F.split("gt", "/"), lambda i: F.try_element_at(alleles, i.cast("int") + 1))
    named = rows.withColumn("_text", F.array_join(idx, "/"))
    g = named.groupBy("chrom", "pos", "ref").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("alt") != ".", F.col("alt")))), ",").alias("alt"),
        *[F.coalesce(F.max(F.when(F.col("sample") == s, F.col("_text"))), F.lit("./.")).alias(s) for s in samples],
        F.count("*").alias("n_called"),
    )
    return g.withColumn("alt", F.when(F.col("alt") == "", ".").otherwise(F.col("alt")))

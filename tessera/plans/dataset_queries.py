"""Queries of the general data-care operators (copies, rejects, hot keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.copydiff import diff_copies
from tessera.operators.hotkeys import accumulate
from tessera.operators.rejects import load_lines, reject_lines
from tessera.operators.versions import latest
from tessera.storage import stage

CALL = "trim(translate(genotype_call, '|', '/'))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _diff(spark: SparkSession, sf: str, values: bool) -> DataFrame:
    return diff_copies(
        table(spark, sf, "gatk_info"), table(spark, sf, "gatk_info_copy"), keys=["info_id"],
        fields=["genotype_call", "positiona", "positionb"], version="loaded_at",
        normalise={"genotype_call": CALL}, with_values=values,
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every record missing in one system and every differing field of the rest."""
    return _diff(spark, sf, False)


def p1_values(spark: SparkSession, sf: str) -> DataFrame:
    """As ``p1_found``, with the values on both sides."""
    return _diff(spark, sf, True)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that cannot be loaded, with the first failing check."""
    return reject_lines(table(spark, sf, "raw_sam_lines"), "raw_line", ["line_id"])


def p5_valid(spark: SparkSession, sf: str) -> DataFrame:
    """The valid alignment lines as typed columns."""
    got = load_lines(table(spark, sf, "raw_sam_lines"), "raw_line", ["line_id", "file_name"])
    return got.select("line_id", "file_name", "qname", "flag", "rname", "pos", "mapq", "cigar", "seq")


def mapped_references(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct mapped alignment with its reference (null if unknown)."""
    a = table(spark, sf, "alignments").where("aln_id is not null and (flag & 4) = 0").select("aln_id", "which_ref", "rname", "loaded_at")
    refs = table(spark, sf, "target_refs").groupBy(F.lower("ref_name").alias("_name")).agg(F.min("which_ref").alias("_ref"))
    name = F.lower(F.regexp_replace(F.trim("rname"), r":\d+-\d+$", ""))
    a = a.join(refs, (name == F.col("_name")) & F.col("which_ref").isNull(), "left")
    a = a.select("aln_id", "loaded_at", F.coalesce("which_ref", "_ref").alias("which_ref"))
    return latest(a, ["aln_id"], "loaded_at", ["which_ref"])


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct mapped alignments per reference."""
    counts = accumulate(mapped_references(spark, sf), "which_ref")
    return counts.where("which_ref is not null").select("which_ref", F.col("n_rows").alias("n_per_ref"))


def p6_found(spark: SparkSession, sf: str, share: float = 0.02) -> DataFrame:
    """References holding at least ``share`` of all distinct mapped alignments."""
    counts = stage(accumulate(mapped_references(spark, sf), "which_ref"), "p6")
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.where(F.col("which_ref").isNotNull() & (F.col("n_rows") >= F.lit(share * total))).select("which_ref")


QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p5_found": p5_found, "p5_valid": p5_valid, "p6_found": p6_found, "p6_counts": p6_counts}

_P1 = """
with m as (select info_id, trim(replace(genotype_call, '|', '/')) g, positiona a, positionb b from gatk_info
           qualify row_number() over (partition by info_id order by loaded_at desc nulls last) = 1),
c as (select info_id, trim(replace(genotype_call, '|', '/')) g, positiona a, positionb b from gatk_info_copy
      qualify row_number() over (partition by info_id order by loaded_at desc nulls last) = 1),
j as (select m.info_id, m.g mg, m.a ma, m.b mb, c.g cg, c.a ca, c.b cb from m join c using (info_id)),
d as (select info_id, 'missing_in_copy' finding, null::varchar main_value, null::varchar copy_value from m where info_id not in (select info_id from c)
union all select info_id, 'missing_in_main', null, null from c where info_id not in (select info_id from m)
union all select info_id, 'genotype_call', mg, cg from j where mg is distinct from cg
union all select info_id, 'positiona', ma::varchar, ca::varchar from j where ma is distinct from ca
union all select info_id, 'positionb', mb::varchar, cb::varchar from j where mb is distinct from cb)
"""
_P5 = r"""
with f as (select line_id, file_name, string_split(raw_line, chr(9)) f0 from raw_sam_lines where raw_line is null or raw_line not like '@%'),
g as (select line_id, file_name, f0, list_transform(f0[1:9], lambda x: case when length(x) >= 2 and x[1] = '"' and x[-1] = '"'
        and length(x) - length(replace(x, '"', '')) = 2 then x[2:-2] else x end) u from f),
r as (select *, case
  when f0 is null or len(f0) < 11 or len(list_filter(f0[12:], lambda x: not regexp_matches(x, '^[A-Za-z][A-Za-z0-9]:[A-Za-z]:'))) > 0 then 'columns'
  when len(list_filter(u, lambda x: contains(x, '"'))) > 0 then 'quoting'
  when not regexp_full_match(u[2], '[0-9]+') or u[2]::hugeint > 65535 then 'flag'
  when (u[2]::hugeint::int & 4) = 0 and (not regexp_full_match(u[6], '([0-9]+[MIDNSHP=X])+') or (f0[10] <> '*' and
       length(f0[10]) <> list_sum(list_transform(regexp_extract_all(u[6], '([0-9]+)[MIS=X]', 1), lambda x: x::bigint)))) then 'cigar' end reason from g)
"""
_P6 = r"""
with a as (select aln_id, coalesce(which_ref, (select min(t.which_ref) from target_refs t where lower(t.ref_name) = lower(regexp_replace(trim(rname), ':\d+-\d+$', '')))) which_ref
           from alignments where (flag & 4) = 0 and aln_id is not null
           qualify row_number() over (partition by aln_id order by loaded_at desc) = 1),
n as (select which_ref, count(*) n_per_ref from a group by 1)
"""
ORACLE = {
    "p1_found": _P1 + "select info_id, finding from d",
    "p1_values": _P1 + "select info_id, finding, main_value, copy_value from d",
    "p5_found": _P5 + "select line_id, reason from r where reason is not null",
    "p5_valid": _P5 + "select line_id, file_name, u[1] qname, u[2]::int flag, u[3] rname, try_cast(u[4] as bigint) pos, try_cast(u[5] as int) mapq, u[6] cigar, f0[10] seq from r where reason is null",
    "p6_found": _P6 + "select which_ref from n where which_ref is not null and n_per_ref >= 0.02 * (select sum(n_per_ref) from n)",
    "p6_counts": _P6 + "select which_ref, n_per_ref from n where which_ref is not null",
}

"""CIGAR strings as arrays of operations, and alignments as one row per base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the SAM format: what each operation consumes.
READ_OPS = ["M", "I", "S", "=", "X"]
REF_OPS = ["M", "D", "N", "=", "X"]
MATCH_OPS = ["M", "=", "X"]
VALID = "^([0-9]+[MIDNSHP=X])+$"


def is_valid(c: Column) -> Column:
    return c.rlike(VALID)


def parse(c: Column) -> Column:
    """Array of ``len, op``; empty where the string is ``*``, null or malformed."""
    n = F.regexp_extract_all(c, F.lit("([0-9]+)([MIDNSHP=X])"), 1)
    op = F.regexp_extract_all(c, F.lit("([0-9]+)([MIDNSHP=X])"), 2)
    ops = F.zip_with(n, op, lambda a, b: F.struct(a.cast("int").alias("len"), b.alias("op")))
    return F.when(is_valid(c), ops).otherwise(F.array().cast("array<struct<len:int,op:string>>"))


def _sum(ops: Column, kinds: list[str]) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(kinds)), F.lit(0), lambda s, x: s + x["len"])


def ref_len(ops: Column) -> Column:
    """Reference bases consumed."""
    return _sum(ops, REF_OPS)


def read_len(ops: Column) -> Column:
    """Read bases consumed, soft clips included."""
    return _sum(ops, READ_OPS)


def longest(ops: Column, kinds: list[str]) -> Column:
    """Longest single operation of the given kinds; 0 if none."""
    return F.coalesce(F.array_max(F.transform(F.filter(ops, lambda x: x["op"].isin(kinds)), lambda x: x["len"])), F.lit(0))


def clip(ops: Column, end: str) -> Column:
    """Soft-clipped bases at the ``start`` or ``end`` (hard clips outside don't count)."""
    inner = F.filter(ops, lambda x: x["op"] != "H")
    at = F.try_element_at(inner, F.lit(1 if end == "start" else -1))
    return F.when(at["op"] == "S", at["len"]).otherwise(0)


def reverse(ops: Column) -> Column:
    return F.reverse(ops)


def render(ops: Column) -> Column:
    """The string of an operation array; ``*`` if empty."""
    s = F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return F.when(F.size(ops) > 0, s).otherwise("*")


def blocks(ops: Column, start0: Column) -> Column:
    """Aligned blocks ``rd0, rf0, len``: one per M, = or X, by a running fold over the operations."""
    zero = F.struct(F.lit(0).alias("rd"), start0.cast("bigint").alias("rf"), F.array().cast("array<struct<rd0:int,rf0:bigint,len:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        hit = x["op"].isin(MATCH_OPS)
        here = F.array(F.struct(acc["rd"].alias("rd0"), acc["rf"].alias("rf0"), x["len"].alias("len")))
        return F.struct(
            (acc["rd"] + F.when(x["op"].isin(READ_OPS), x["len"]).otherwise(0)).alias("rd"),
            (acc["rf"] + F.when(x["op"].isin(REF_OPS), x["len"]).otherwise(0)).cast("bigint").alias("rf"),
            F.when(hit, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(ops, zero, step)["out"]


def explode_bases(df: DataFrame, keys: list[str], cigar: str = "cigar", pos: str = "pos", seq: str = "seq", qual: str = "qual") -> DataFrame:
    """One row per aligned base: ``keys, rd_idx, pos0, base, q``.

    Insertions, deletions, skips and clips give no row.  Rows without a valid
    CIGAR or with sequence ``*`` give none; a missing quality string gives null
    qualities.  Runs in whole-stage code: fold, two generators, substring.
    """
    b = df.where(F.col(seq).isNotNull() & (F.col(seq) != "*")).select(*keys, F.upper(seq).alias("_s"), F.col(qual).alias("_q"), F.explode(blocks(parse(F.col(cigar)), F.col(pos) - 1)).alias("_b"))
    b = b.select(*keys, "_s", "_q", "_b", F.explode(F.sequence(F.lit(0), F.col("_b.len") - 1)).alias("_i")).where("_b.len > 0")
    rd = F.col("_b.rd0") + F.col("_i")
    letter = F.substring(F.col("_s"), rd + 1, F.lit(1))
    q = F.when((F.col("_q") != "*") & (F.length("_q") > rd), F.ascii(F.substring(F.col("_q"), rd + 1, F.lit(1))) - 33)
    return b.select(*keys, rd.alias("rd_idx"), (F.col("_b.rf0") + F.col("_i")).alias("pos0"), letter.alias("base"), q.alias("q")).where("base <> ''")

"""Copies, rejects and hot keys against brute force on small fixtures."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators.copydiff import diff_copies
from tessera.operators.hotkeys import accumulate
from tessera.operators.ordering import prefix_sums, row_index, stratified_sample
from tessera.operators.rejects import load_lines, reject_lines, split_records
from tessera.operators.versions import latest

SCHEMA = "id bigint, a string, b bigint, t bigint, finding string"


def test_diff_finds_every_difference(spark):
    m = spark.createDataFrame([(1, "x", 1, 5, ""), (1, "old", 9, 1, ""), (2, None, 1, 1, ""), (3, "p", None, 1, ""), (4, "q", 1, 1, ""), (None, "n", 1, 1, "")], SCHEMA)
    c = spark.createDataFrame([(1, "x", 2, 1, ""), (2, None, 1, 1, ""), (3, "r", None, 1, ""), (5, "q", 1, 1, ""), (5, "q", 1, 1, "")], SCHEMA)
    got = {tuple(r) for r in diff_copies(m, c, ["id"], ["a", "b"], "t").collect()}
    assert got == {(1, "b"), (3, "a"), (4, "missing_in_copy"), (5, "missing_in_main"), (None, "missing_in_copy")}
    vals = {(r["id"], r["finding"]): (r["main_value"], r["copy_value"]) for r in diff_copies(m, c, ["id"], ["a", "b"], "t", with_values=True).collect()}
    assert vals[(1, "b")] == ("1", "2")


def test_diff_empty_sides_and_ties(spark):
    e = spark.createDataFrame([], SCHEMA)
    m = spark.createDataFrame([(1, "x", 1, 5, ""), (1, "z", 1, 5, ""), (2, "y", 1, None, "")], SCHEMA)
    assert diff_copies(e, e, ["id"], ["a"], "t").count() == 0
    assert {tuple(r) for r in diff_copies(m, e, ["id"], ["a"], "t").collect()} == {(1, "missing_in_copy"), (2, "missing_in_copy")}
    assert diff_copies(m, m, ["id"], ["a", "b"], "t").count() == 0
    assert [r["a"] for r in latest(m, ["id"], "t", ["a"]).orderBy("id").collect()] == ["z", "y"]


def _line(flag="0", cigar="4M", seq="ACGT", extra=(), qname="r"):
    return "\t".join([qname, flag, "chr", "1", "60", cigar, "*", "0", "0", seq, "FFFF", *extra])


def _reason(line):
    """Plain rules, field by field."""
    if line is not None and line.startswith("@"):
        return None
    f = (line or "").split("\t")
    if len(f) < 11 or any(not re.match(r"[A-Za-z][A-Za-z0-9]:[A-Za-z]:", x) for x in f[11:]):
        return "columns"
    for i in range(9):
        if '"' in f[i]:
            if f[i].count('"') == 2 and len(f[i]) >= 2 and f[i][0] == f[i][-1] == '"':
                f[i] = f[i][1:-1]
            else:
                return "quoting"
    if not re.fullmatch("[0-9]+", f[1]) or int(f[1]) > 65535:
        return "flag"
    if not int(f[1]) & 4:
        if not re.fullmatch("([0-9]+[MIDNSHP=X])+", f[5]):
            return "cigar"
        n = sum(int(a) for a, _ in re.findall("([0-9]+)([MIS=X])", f[5]))
        if f[9] != "*" and len(f[9]) != n:
            return "cigar"
    return None


def test_rejects_match_plain_rules(spark):
    rng = random.Random(3)
    lines = [None, "", "@HD\tVN:1", _line(), _line(seq="*"), _line(flag="70000"), _line(flag="0065535"), _line(flag="-1"), _line(flag="99999999999999999999"), _line(cigar="4Z"), _line(cigar="M4"), _line(cigar="2M2"),
             _line(cigar="*", flag="4"), _line(cigar="*"), _line(extra=("NM:i:1",)), _line(extra=("NM:i",)), _line(extra=("N",)), _line(extra=("",)), _line(qname='"r"'), _line(qname='"r'), _line(qname='"'), _line(qname='""'), _line(qname='"""'),
             _line(flag='"16"'), _line(cigar='"2M2S"'), _line(cigar="1H4M"), _line(cigar="2M1D2M"), _line(cigar="99999999999999M"), _line(seq="ACGÜ"), _line(cigar="900000M", seq="A" * 900_000)]
    alphabet = ["a", "4M", '"', "\t", "0", ":", "*", "16", "NM:i:0", "é"]
    for _ in range(400):
        base = list(_line(extra=("NM:i:1",) if rng.random() < 0.5 else ()))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(alphabet)
        lines.append("".join(base))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id bigint, line string").repartition(3)
    got = {r["id"]: r["reason"] for r in reject_lines(df, "line", ["id"]).collect()}
    want = {i: r for i, x in enumerate(lines) if (r := _reason(x))}
    assert got == want
    ok = {r["id"] for r in load_lines(df, "line", ["id"]).collect()}
    assert ok == {i for i, x in enumerate(lines) if i not in want and not (x or "").startswith("@")}
    assert reject_lines(df.where("false"), "line", ["id"]).count() == 0


def test_record_ends_respect_quotes():
    import numpy as np

    raw = np.frombuffer(b'a,"x\ny"\nb,c\n"z"', np.uint8)
    offs = split_records(raw)
    assert [bytes(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])] == [b'a,"x\ny"\n', b"b,c\n", b'"z"']


def test_hot_keys_sum_exactly(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 500).cast("string")).alias("k"), (F.lit(2**45 + 1) + F.col("id")).alias("v"), (F.col("id") / 3).alias("x"))
    got = {r["k"]: tuple(r)[1:3] for r in accumulate(df, "k", ["v", "x"]).collect()}
    want = {r["k"]: (r["n"], r["s"]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    assert got == want
    assert accumulate(df.where("false"), "k").count() == 0
    small = {r["k"]: r["n_rows"] for r in accumulate(df, "k", flush=10).collect()}
    assert small == {k: v[0] for k, v in want.items()}


def test_orders(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("v"))
    assert all(r["cum_v"] == 2 * (r["k"] + 1) for r in prefix_sums(df, [F.asc("k")], ["v"]).collect())
    assert sorted(r["row_no"] for r in row_index(df, [F.asc("k")]).collect()) == list(range(1000))
    s = stratified_sample(df.withColumn("g", F.col("k") % 4), "g", ["k"], 5).groupBy("g").count().collect()
    assert [r["count"] for r in s] == [5] * 4

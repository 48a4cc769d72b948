"""Reference bases are loaded as far as the reads reach, however far that is from the target."""

import math
import random

from pyspark.sql import functions as F

from tessera.operators import regions
from tessera.plans import pipeline


def test_bases_far_beyond_the_target_count(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice("ACGT") for _ in range(60_000))
    read = text[30_050:30_100] + text[55_100:55_150]  # a skip of 25,000 on A, none on B
    left = text[4_900:4_950] + text[29_950:30_000] + text[30_000:30_020]  # the same before the target
    b = text[:30_050] + read + text[30_150:]
    b = b[:29_900] + left + b[30_020:]
    q = lambda s: "?" * len(s)
    rows = [("r", "A", "A", 0, 30_051, "50M25000N50M", read, q(read)), ("r", "B", "B", 0, 30_051, "100M", read, q(read))]
    rows += [("l", "A", "A", 0, 4_901, "50M25000N70M", left, q(left)), ("l", "B", "B", 0, 29_901, "120M", left, q(left))]
    sam = spark.createDataFrame(rows, "qname string, sg string, rname string, flag int, pos bigint, cigar string, seq string, qual string").withColumn("sample", F.lit("s"))
    t = spark.createDataFrame([("B:30001-30100", "A:30001-30100", 0, 1, "100M")], "qname string, rname string, flag int, pos bigint, cigar string")
    targets = regions.target_alignment(t).withColumn("target_id", F.lit(1))
    fa = spark.createDataFrame([("A", text), ("B", b)], "name string, seq string")
    got = {r["name"]: r["ll_a"] for r in pipeline.pileup(sam, targets, fa).select("name", "ll_a").distinct().collect()}
    one = math.log(1 - 10**-3)
    assert set(got) == {"r+", "l+"} and abs(got["r+"] - 100 * one) < 1e-6 and abs(got["l+"] - 120 * one) < 1e-6

"""Alignment-level operators on hand-written reads."""

from pyspark.sql import functions as F

from tessera.functions import cigar, seq, stats
from tessera.operators import align, fastx, reads, regions

COLS = "sample string, sg string, qname string, flag int, rname string, pos bigint, mapq int, cigar string, seq string, qual string"


def _df(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_cigar_functions(spark):
    d = spark.createDataFrame([("2H3S10M2I5M4D1M1S",), ("*",), (None,), ("5Q",), ("3N2M",), ("4=1X",)], "c string").withColumn("o", cigar.parse(F.col("c")))
    got = [tuple(r) for r in d.select("c", cigar.ref_len(F.col("o")), cigar.read_len(F.col("o")), cigar.longest(F.col("o"), ["S"]), cigar.clip(F.col("o"), "start"), cigar.clip(F.col("o"), "end")).collect()]
    assert got[0] == ("2H3S10M2I5M4D1M1S", 20, 22, 3, 3, 1)
    assert [r[1] for r in got[1:4]] == [0, 0, 0] and got[4][1:3] == (5, 2) and got[5][1:3] == (5, 5)
    r = d.select(cigar.render(F.col("o")).alias("a"), cigar.render(cigar.reverse(F.col("o"))).alias("b")).first()
    assert r["a"] == "2H3S10M2I5M4D1M1S" and r["b"] == "1S1M4D5M2I10M3S2H"


def test_explode_bases_walks_the_cigar(spark):
    d = _df(spark, [("s", "A", "r", 0, "c", 10, 60, "1S2M1I1M2D1M", "TACGTA", "ABCDEF"), ("s", "A", "u", 4, "*", 0, 0, "*", "ACG", "FFF"), ("s", "A", "n", 0, "c", 1, 0, "3M", None, None), ("s", "A", "q", 0, "c", 1, 0, "2M", "AC", "*")])
    got = sorted(tuple(r) for r in cigar.explode_bases(d, ["qname"]).collect())
    assert got == [("q", 0, 0, "A", None), ("q", 1, 1, "C", None), ("r", 1, 9, "A", 33), ("r", 2, 10, "C", 34), ("r", 4, 11, "T", 36), ("r", 5, 14, "A", 37)]


def test_filter_order_and_report(spark):
    d = _df(spark, [("s", "A", "a", 4 + 2048, "c", 1, 0, "9S1M", "A" * 10, "!" * 10), ("s", "A", "b", 2048, "c", 1, 0, "10M", "A" * 10, "F" * 10), ("s", "A", "c", 0, "c", 1, 0, "9S1M", "A" * 10, "F" * 10),
                    ("s", "A", "d", 0, "c", 1, 0, "5M3I2M", "A" * 10, "F" * 10), ("s", "A", "e", 256, "c", 1, 0, "10M", "A" * 10, "!" * 10), ("s", "A", "f", 0, "c", 1, 0, "10M", "A" * 10, None)])
    f = reads.ReadFilter(max_clip=5, max_indel=3, max_expected_errors=1.0)
    assert {r["reason"]: r["n_reads"] for r in reads.filter_report(d, f).collect()} == {"unmapped": 1, "secondary": 1, "soft_clip": 1, "indel": 1, "expected_errors": 1, "kept": 1}
    assert [r["qname"] for r in reads.filter_reads(d, f).collect()] == ["f"]
    strict = reads.ReadFilter(compat=False)
    assert "e" not in [r["qname"] for r in reads.filter_reads(d, strict).collect()]


def test_merge_counts_repeats_without_explosion(spark):
    d = _df(spark, [("s", x, q, 0, "c", 1, 0, "1M", "A", "F") for q, x in [("r1", "A"), ("r1", "B"), ("r2", "A"), ("r2", "A"), ("r2", "B"), ("r3", "B"), (None, "A")]])
    assert [r["qname"] for r in reads.in_both_once(d, ["qname"]).collect()] == ["r1"]
    p = reads.pair_subgenomes(d, ["qname"], ["cigar", "pos"]).collect()
    assert len(p) == 1 and p[0]["cigar_b"] == "1M"
    assert reads.merge_subgenomes(d.where("false"), ["qname"]).count() == 0


def test_overlap_equals_plain_predicate(spark):
    r = spark.range(300).select(F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "c1").otherwise("c2").alias("rname"), (F.col("id") * 37 % 5000 + 1).alias("pos"), F.lit("60M").alias("cigar"))
    t = spark.range(40).select(F.col("id").alias("target_id"), F.when(F.col("id") % 3 == 0, "c1").otherwise("c2").alias("chrom"), (F.col("id") * 131 % 5000).alias("start0"), (F.col("id") * 131 % 5000 + F.col("id") * 9).alias("end0"))
    got = sorted((x["n"], x["target_id"]) for x in reads.overlap_targets(r, t, 64).collect())
    want = sorted((x["n"], x["target_id"]) for x in r.crossJoin(t).where("rname = chrom and end0 > start0 and pos - 1 < end0 and pos + 59 > start0").collect())
    assert got == want


def test_clips_and_extents(spark):
    p = spark.createDataFrame([("a", "2S8M", "9M1S", 5, 7, 0, 0), ("b", "6S4M", "4M6S", 5, 7, 0, 0)], "q string, cigar_a string, cigar_b string, pos_a bigint, pos_b bigint, region_a bigint, region_b bigint")
    got = [tuple(r) for r in reads.match_clips(p).select("q", "clip_start", "clip_end").collect()]
    assert got == [("a", 2, 1)]
    flipped = [tuple(r) for r in reads.match_clips(p, F.lit(True)).select("q", "clip_start", "clip_end").collect()]
    assert flipped == [("a", 2, 0), ("b", 6, 0)]
    e = reads.common_extent(p).first()
    assert (e["extent_start"], e["extent_end"]) == (7, 13)


def test_site_map_forward_and_reversed(spark):
    t = spark.createDataFrame([(1, 100, 200, 206, 1, "2M1D2M2I", False), (2, 100, 200, 205, 1, "3M2S", True)], "target_id int, start_a bigint, start_b bigint, end_b bigint, pos bigint, cigar string, b_reversed boolean")
    got = sorted(tuple(r) for r in regions.site_map(t).collect())
    assert got == [(1, 100, 200), (1, 101, 201), (1, 103, 202), (1, 104, 203), (2, 100, 204), (2, 101, 203), (2, 102, 202)]
    assert [tuple(r) for r in regions.unmatched_sites(t).collect()] == [(1, 102, "deleted")]
    assert sorted(tuple(r) for r in regions.inserted_sites(t).collect()) == [(1, 204), (1, 205)]


def test_regions(spark):
    d = spark.createDataFrame([("c:3-9",), ("bad",), ("c:0-4",), (None,)], "r string")
    got = [r[0] for r in d.select(seq.parse_region(F.col("r"))).collect()]
    assert tuple(got[0]) == ("c", 2, 9) and got[1] is None and tuple(got[2]) == ("c", 0, 4) and got[3] is None
    assert d.select(seq.parse_region(F.col("r"), True)).first()[0]["start0"] == 3
    fa = spark.createDataFrame([("c", "ACGTACGTAC")], "name string, seq string")
    rg = spark.createDataFrame([("c", 2, 9)], "chrom string, start0 bigint, end0 bigint")
    assert tuple(regions.extract(fa, rg).first()) == ("c:3-9", "GTACGTA")


def test_sequence_functions(spark):
    d = spark.createDataFrame([("ACGTN", "!5FI"), ("", ""), (None, None)], "s string, q string")
    r = d.select(seq.reverse_complement(F.col("s")), seq.expected_errors(F.col("q")), seq.is_ambiguous(F.col("s")), seq.clean_bases(F.col("s"))).collect()
    assert r[0][0] == "NACGT" and abs(r[0][1] - (1 + 10**-2 + 10**-3.7 + 10**-4)) < 1e-12 and r[0][2] and r[0][3] == "ACGTA"
    assert r[1][1] == 0 and r[2][0] is None
    e = spark.createDataFrame([("A", "A", 0), ("A", "C", 20), ("A", "A", 20)], "t string, b string, q int").select(seq.emit_logp(F.col("t"), F.col("b"), F.col("q"))).collect()
    import math

    assert e[0][0] == -math.inf and abs(e[1][0] - math.log(0.01 / 3)) < 1e-12 and abs(e[2][0] - math.log(0.99)) < 1e-12


def test_trims(spark):
    d = spark.createDataFrame([("r", "ACGTACGT", "!!IIIII!"), ("z", "AC", "!!"), ("e", "", "")], "name string, seq string, qual string")
    got = {r["name"]: (r["seq"], r["qual"]) for r in fastx.trim_by_quality(d, 0.01).collect()}
    assert got["r"][0] == "" or set(got["r"][1]) <= set("!I")
    assert got["z"] == ("", "") and got["e"] == ("", "")
    assert {r["name"]: r["seq"] for r in fastx.trim_tail_below(d, 5).collect()} == {"r": "", "z": "", "e": ""}
    a = spark.createDataFrame([("r", "ANGT", "ABCD")], "name string, seq string, qual string")
    assert tuple(fastx.drop_ambiguous_bases(a).select("seq", "qual").first()) == ("AGT", "ACD")


def test_nearest_other(spark):
    d = spark.createDataFrame([(1, "AAAA"), (2, "AAAT"), (3, "TTTT"), (4, "AA")], "k int, s string")
    got = {r["k"]: (r["distance"], r["nearest"]) for r in fastx.nearest_other(d, d, "k", "s").collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (3, 2)}


def test_alignment_and_merging(spark):
    assert align.global_align("ACGT", "AGT") == ("ACGT", "A-GT", 1)
    a, b, s = align.global_align("AAACGT", "CGTTTT", free_ends=True)
    assert s == 3 and a.replace("-", "") == "AAACGT" and b.replace("-", "") == "CGTTTT"
    assert align.global_align("ARG", "AAG", profile=True)[2] == 3
    truth = "ACGGTCATTGCAAGCTTACG"
    from tessera.operators.align import _merge

    assert _merge(truth[:14], "I" * 14, truth[6:], "I" * 14, -7)[0] == truth
    f = spark.createDataFrame([("r", truth[:14], "I" * 14), ("x", "", "")], "name string, seq string, qual string")
    back = truth[6:][::-1].translate(str.maketrans("ACGT", "TGCA"))
    g = spark.createDataFrame([("r", back, "I" * 14)], "name string, seq string, qual string")
    r = align.merge_pairs(f, g).collect()
    assert len(r) == 1 and r[0]["seq"] == truth and r[0]["overlap"] == 8


def test_chi2_tail(spark):
    r = spark.createDataFrame([(9.278056,), (0.0,), (None,)], "x double").select(stats.chi2_sf(F.col("x"), 1), stats.chi2_sf(F.col("x"), 2)).collect()
    assert abs(r[0][0] - 2.319155e-3) < 1e-8 and r[1][0] == 1 and r[2][0] is None and abs(r[0][1] - 2.718281828**-4.639028) < 1e-6

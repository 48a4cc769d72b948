"""Readers and writers on files written by the test."""

from pyspark.sql import functions as F

from tessera.sources import readers, writers
from tessera.streaming import ingest


def _put(path, text):
    path.write_text(text)
    return str(path)


def test_sam_round_trip(spark, tmp_path):
    p = _put(tmp_path / "a.sam", "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:500\nr1\t16\tc1\t5\t60\t4M\t*\t0\t0\tACGT\tFFFF\tNM:i:0\nbad\t1\n")
    d = readers.sam(spark, p, "s", "A", strand_suffix=True)
    assert [tuple(r)[:6] for r in d.collect()] == [("r1-", 16, "c1", 5, 60, "4M")]
    assert tuple(readers.sam_references(spark, p).first()) == ("c1", 500)
    assert writers.sam_lines(d).first()["value"].split("\t")[9] == "ACGT"
    import pytest

    with pytest.raises(ValueError):
        readers.sam(spark, _put(tmp_path / "b.sam", "r1\t0\n"))


def test_fasta_fastq(spark, tmp_path):
    fa = _put(tmp_path / "x.fa", ">c1 first > second\nACG\nta\n>c2\nGG\n")
    assert {r["name"]: r["seq"] for r in readers.fasta(spark, fa).collect()} == {"c1": "ACGTA", "c2": "GG"}
    fq = _put(tmp_path / "x.fq", "@r1 x\nacgn\n+\nFFFF\n@r2\nAC\n+\n@F\n")
    assert {r["name"]: (r["seq"], r["qual"]) for r in readers.fastx(spark, fq).collect()} == {"r1": ("ACGN", "FFFF"), "r2": ("AC", "@F")}
    assert readers.fastq(spark, fq, drop_ambiguous=True).count() == 1 and readers.fastq(spark, fq, min_length=3).count() == 1
    d = readers.fastq(spark, fq)
    assert sorted(r["value"] for r in writers.fastq_lines(d).collect())[1] == "@r2\nAC\n+\n@F"
    w = writers.fasta_lines(spark.createDataFrame([("n", "ACGTACG")], "name string, seq string"), 3).first()["value"]
    assert w == ">n\nACG\nTAC\nG"


def test_fastq_blocks(spark, tmp_path):
    """Records cut by file blocks come back whole, wherever the cuts fall and whatever the qualities."""
    import random

    rng = random.Random(6)
    want = []
    for f in range(3):
        rec = [(f"f{f}r{i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30)))) for i in range(200)]
        rec = [(n, s, "".join(rng.choice("@+FI#") for _ in s)) for n, s in rec]
        want += rec
        _put(tmp_path / f"{f}.fq", "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in rec))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (997, 3001, 100_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            got = sorted(map(tuple, readers.fastq(spark, str(tmp_path)).collect()))
            assert got == sorted(want)
            rows = readers.fastq(spark, str(tmp_path), index=True, min_length=2).orderBy("read_idx").collect()
            assert [tuple(r)[1:] for r in rows] == [w for w in want if len(w[1]) > 1]
            assert all(want[r["read_idx"]][0] == r["name"] for r in rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_reference_blocks(spark):
    from tessera.operators import regions

    fa = spark.createDataFrame([("c", "ACGTacgtAC"), ("d", ""), ("e", None)], "name string, seq string")
    got = {(r["chrom"], r["pos0"]): r["base"] for r in regions.reference_bases(fa, width=3).collect()}
    assert "".join(got["c", i] for i in range(10)) == "ACGTACGTAC" and len(got) == 10
    some = regions.reference_bases(fa, spark.createDataFrame([("c", 4, 5)], "chrom string, start0 bigint, end0 bigint"), 3)
    assert sorted(r["pos0"] for r in some.collect()) == [3, 4, 5]


def test_tables(spark, tmp_path):
    e = readers.error_table(spark, _put(tmp_path / "e.txt", "q t p r pr\n64 C 1226 C 0.9977\n64 C 1226 C 0.5\n")).collect()
    assert len(e) == 2 and e[0]["prob"] == 0.9977
    a, s = readers.cluster_result(spark, _put(tmp_path / "k.txt", "K: 2\nassignments: 0 1 NA 0\nsizes: 2 1\n"))
    assert [r["cluster"] for r in a.orderBy("read_idx").collect()] == [0, 1, None, 0] and s.count() == 2
    assert readers.cluster_number(spark, str(tmp_path / "k.txt")).first()["k"] == 2 and [r["cluster"] for r in s.collect()] == [0, 1]
    m = readers.categorical_matrix(spark, _put(tmp_path / "m.txt", "1 2 3\n2 2 1\n"), 0, 1).orderBy("obs").collect()
    assert [r["codes"] for r in m] == [[1, 2], [1, 0]] and [r["truth"] for r in m] == [1, 2]
    prof = readers.error_profile(spark, _put(tmp_path / "d.csv", ",".join(["1000", "0"] * 16)))
    assert prof.count() == 32
    t = readers.tsv(spark, _put(tmp_path / "i.txt", "Genotype\tPP(0,1)\tCovA\nx\t0.5\tNA\n"))
    assert t.columns == ["genotype", "pp_01", "cova"] and t.first()["cova"] is None
    assert readers.union_all([t, t.drop("cova")]).count() == 2


def test_call_log(spark, tmp_path):
    p = _put(tmp_path / "x.log", "noise\nExpected counts genome A:  0 0 0 11\nExpected counts genome B: 0 0 0 12\nGenotype (0,0): GG/GT\n")
    got = [(r["kind"], r["first"], r["second"]) for r in readers.call_log(spark, p).orderBy("line_no").collect()]
    assert got == [("counts_a", "0 0 0 11", None), ("counts_b", "0 0 0 12", None), ("genotype", "GG", "GT")]


def test_vcf_shapes(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    a = readers.vcf(spark, _put(tmp_path / "a.vcf", head + "A\t5\t.\tG\tC,<NON_REF>\t.\t.\tDP=9;MQ=1\tGT:AD:DP:GQ:PL:SB\t0/1:4,5:9:99:50,0,60:1\nA\t6\t.\tG\t<NON_REF>\t.\t.\t.\tGT:DP\t0/0:7\n"))
    b = readers.vcf(spark, _put(tmp_path / "b.vcf", head + "B\t5\t.\tT\t<NON_REF>\t.\t.\t.\tGT:DP:PL\t0|0:3:0,5,9\nB\t7\t.\tT\t.\t.\t.\t.\tGT\t./.\n"))
    chroms = spark.createDataFrame([("A", "B"), ("A2", "B2")], "chrom_a string, chrom_b string")
    other = readers.vcf(spark, _put(tmp_path / "c.vcf", head + "B2\t5\t.\tC\t.\t.\t.\t.\tGT\t0/0\n"))
    r = readers.gvcf_info(a, b.unionByName(other), "ind", chroms).collect()
    sites = spark.createDataFrame([("A", 6, "B2", 5)], "chrom_a string, pos_a bigint, chrom_b string, pos_b bigint")
    s = readers.gvcf_info(a, b.unionByName(other), "ind", chroms, sites).first()
    assert (s["positiona"], s["positionb"], s["chromb"], s["ref_b_allele"]) == (6, 5, "B2", "C")
    assert len(r) == 1 and r[0]["genotype_call"] == "1/0" and r[0]["alt_a_allele"] == "C" and r[0]["alt_b_allele"] is None and r[0]["pla_0"] == 50 and r[0]["covb"] == 3
    assert a.first()["info"] == {"DP": "9", "MQ": "1"}


def test_stream_batches_replace_themselves(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _put(src / "a.sam", "@SQ\tSN:c\tLN:9\nr1\t0\tc\t1\t60\t2M\t*\t0\t0\tAC\tFF\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tFF\n")
    for _ in range(2):
        ingest.ingest_filtered(ingest.stream_lines(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("qname").isNotNull()).count() == 1


def test_vcf_file_begins_with_its_header(spark, tmp_path):
    rows = spark.createDataFrame([("B", 9, "B\t9\t."), ("A", 10, "A\t10\t."), ("A", 2, "A\t2\t.")], "chrom string, pos bigint, line string")
    writers.write_vcf(rows.repartition(3), str(tmp_path / "v"), ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*")))
    assert text.split("\n")[:-1] == ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID", "A\t2\t.", "A\t10\t.", "B\t9\t."]

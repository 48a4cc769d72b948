"""Recorded results of the genotype kernel."""

import math

from tessera.operators import genotype as G

P = "site int, base string, q int, ll_a double, ll_b double, ref_a string, ref_b string"
FAR = -1000.0


def _reads(site, text, quals, of_a, ref_a, ref_b):
    """Pileup rows of reads that clearly come from A or from B."""
    return [(site, b, ord(q) - 33, -1.0 if a else FAR, FAR if a else -1.0, ref_a, ref_b) for b, q, a in zip(text, quals, of_a)]


def test_site_where_all_reads_agree(spark):
    """23 reads of G, 11 from A and 12 from B: the posterior falls by half for every read of a heterozygote."""
    quals = "<BBBFFFFFFF" + "7FFFFFFFFFFF"  # those of the recorded site; which read came from where is not recorded
    assert sorted(quals) == sorted("FFFFFFFFFB<FFFF7FFFBFFB")
    rows = _reads(1, "G" * 23, quals, [True] * 11 + [False] * 12, "G", "G")
    r = G.call_sites(spark.createDataFrame(rows, P), ["site"]).first()
    assert [round(r[f"ea_{x}"], 3) for x in "actg"] == [0, 0, 0, 11] and [round(r[f"eb_{x}"], 3) for x in "actg"] == [0, 0, 0, 12]
    assert [round(r[f"pp_{a}{b}"], 6) for a in range(3) for b in range(3)] == [0.999267, 0.000245, 0, 0.000489, 0, 0, 0, 0, 0]
    assert r["genotype_call"] == "GG/GG" and r["no_alt"]


def test_homoeologous_site(spark):
    """38 reads of C from A and 36 of T from B, as recorded: CC and TT, and the heterozygotes are far behind."""
    rows = _reads(1, "C" * 38 + "T" * 36, "F" * 74, [True] * 38 + [False] * 36, "C", "T")
    r = G.call_sites(spark.createDataFrame(rows, P), ["site"]).first()
    assert r["genotype_call"] == "CC/TT" and r["pp_call"] > 0.99
    assert math.isclose(r["cov_a"], 38, abs_tol=1e-6) and (r["mode_a"], r["mode_b"]) == ("C", "T")


def test_one_odd_read_of_unknown_origin(spark):
    """21 reads of G and one of T that fits both subgenomes: it counts half in each, as recorded."""
    rows = _reads(1, "G" * 21, "F" * 21, [True] * 14 + [False] * 7, "G", "G")
    odd = math.log((10 ** (-37 / 10)) / 3)
    rows.append((1, "T", 37, odd - 1.0, odd - 1.0, "G", "G"))
    r = G.call_sites(spark.createDataFrame(rows, P), ["site"]).first()
    assert [round(r[f"ea_{x}"], 6) for x in "actg"] == [0, 0, 0.5, 14] and [round(r[f"eb_{x}"], 6) for x in "actg"] == [0, 0, 0.5, 7]
    assert (r["nuc1"], r["nuc2"]) == ("G", "T") and r["genotype_call"] == "GG/GT"

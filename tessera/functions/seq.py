"""Column expressions on bases, qualities and sequences.

Everything here is a Spark expression (no Python at run time).  Bases are
letters; the order A, C, T, G decides ties wherever alleles are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Allele order, complements, and the four-bit masks of the nucleotide letters.
BASES = ["A", "C", "T", "G"]
COMPLEMENT = ("ACGTUNRYKMSWBDHVacgtun", "TGCAANYRMKSWVHDBtgcaan")
IUPAC = {"A": 1, "C": 2, "T": 4, "G": 8, "R": 9, "Y": 6, "S": 10, "W": 5, "K": 12, "M": 3, "B": 14, "D": 13, "H": 7, "V": 11, "N": 15, "U": 4, "X": 0}
PHRED = 33
LN10 = math.log(10)
LN3 = math.log(3)


def reverse_complement(s: Column) -> Column:
    """The opposite strand; letters without a complement stay."""
    return F.translate(F.reverse(s), *COMPLEMENT)


def complement(s: Column) -> Column:
    return F.translate(s, *COMPLEMENT)


def base_rank(b: Column) -> Column:
    """0 to 3 in allele order; null for any other letter."""
    at = F.instr(F.lit("".join(BASES)), F.upper(b)) - 1
    return F.when(F.length(b) == 1, F.when(at >= 0, at))


def iupac_mask(b: Column) -> Column:
    """Four-bit mask of a nucleotide letter in either case; unknown letters have none set."""
    pairs = [x for k, v in IUPAC.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(b)), F.lit(0))


def is_ambiguous(s: Column) -> Column:
    """Whether a sequence holds any letter other than A, C, G, T."""
    return F.upper(s).rlike("[^ACGT]")


def clean_bases(s: Column, n_as: str | None = "A") -> Column:
    """Upper-case bases with all others read as ``n_as`` or, if that is None, dropped."""
    return F.regexp_replace(F.upper(s), "[^ACGT]", n_as or "")


def quality(c: Column) -> Column:
    """Integer quality of a character."""
    return F.ascii(c) - PHRED


def qualities(q: Column) -> Column:
    """Array of integer qualities of a quality string; null stays null."""
    chars = F.filter(F.split(q, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c) - PHRED)


def error_prob(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def expected_errors(q: Column) -> Column:
    """Sum of the error probabilities of a quality string; 0 if empty."""
    return F.aggregate(qualities(q), F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), -x / 10.0))


def error_free_prob(q: Column) -> Column:
    """Probability that no base of the read is wrong."""
    return F.aggregate(qualities(q), F.lit(1.0), lambda acc, x: acc * (1 - F.pow(F.lit(10.0), -x / 10.0)))


def emit_logp(true_base: Column, read_base: Column, q: Column) -> Column:
    """Log probability of reading a base given the true one (q 0 and a match give minus infinity)."""
    ep = error_prob(q)
    hit = F.when(ep >= 1, F.lit(float("-inf"))).otherwise(F.ln(1 - ep))
    return F.when(true_base == read_base, hit).otherwise(-q * LN10 / 10.0 - LN3)


def emit_prob(true_base: Column, read_base: Column, q: Column) -> Column:
    ep = error_prob(q)
    return F.when(true_base == read_base, 1 - ep).otherwise(ep / 3.0)


def emit_logp_het(first: Column, second: Column, read_base: Column, q: Column) -> Column:
    """Log of the mean emission of two alleles."""
    return F.ln((emit_prob(first, read_base, q) + emit_prob(second, read_base, q)) / 2.0)


def log_sum_exp(a: Column, b: Column) -> Column:
    """log(exp a + exp b), shifted by the greater so nothing underflows."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return hi + F.log1p(F.exp(lo - hi))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two equally long arrays differ; a null differs from any value, not from null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def hamming_text(a: Column, b: Column) -> Column:
    return hamming(letters(a), letters(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def strip_name(name: Column) -> Column:
    """Read name without its mate suffix (``/1`` or ``-1``)."""
    return F.regexp_replace(name, "[/-][^/-]*$", "")


def parse_region(r: Column, legacy: bool = False) -> Column:
    """``chrom, start0, end0`` (half open) of ``chrom:start-end``, 1-based inclusive unless legacy."""
    pat = r"^([^:]+):(\d+)-(\d+)$"
    start = F.regexp_extract(r, pat, 2).try_cast("bigint")
    end = F.regexp_extract(r, pat, 3).try_cast("bigint")
    ok = r.rlike(pat)
    return F.when(ok, F.struct(F.regexp_extract(r, pat, 1).alias("chrom"), (start if legacy else F.greatest(start - 1, F.lit(0))).alias("start0"), end.alias("end0")))


def trim_bounds(q: Column, threshold: float) -> Column:
    """``first, last`` (1-based) kept after cutting both ends until the mean error so far is at most ``threshold``.

    The cut from an end is the shortest prefix whose mean error exceeds the
    threshold, extended while it does; a read that never passes keeps nothing.
    """
    e = F.transform(qualities(q), lambda x: F.pow(F.lit(10.0), -x / 10.0))

    def first_pass(arr: Column) -> Column:
        # walk from the end: count bases while the running mean is above the threshold
        walk = F.aggregate(
            arr, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("cut"), F.lit(True).alias("on")),
            lambda acc, x: F.struct(
                (acc["n"] + 1).alias("n"), (acc["s"] + x).alias("s"),
                F.when(acc["on"] & ((acc["s"] + x) / (acc["n"] + 1) > threshold), acc["n"] + 1).otherwise(acc["cut"]).alias("cut"),
                (acc["on"] & ((acc["s"] + x) / (acc["n"] + 1) > threshold)).alias("on"),
            ),
        )
        return walk["cut"]

    return F.struct((first_pass(e) + 1).alias("first"), (F.size(e) - first_pass(F.reverse(e))).alias("last"))

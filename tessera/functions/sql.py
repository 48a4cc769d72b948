"""The scalar functions as SQL functions of a session, for queries written as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name and parameters, result, body
FUNCTIONS = {
    "phred_error(q int)": ("double", "pow(10.0D, -q / 10.0D)"),
    "emit_prob(t string, b string, q int)": ("double", "if(t = b, 1 - pow(10.0D, -q / 10.0D), pow(10.0D, -q / 10.0D) / 3.0D)"),
    "emit_logp(t string, b string, q int)": ("double", "if(t = b, ln(1 - pow(10.0D, -q / 10.0D)), -q * ln(10.0D) / 10.0D - ln(3.0D))"),
    "chi2_sf2(x double)": ("double", "if(x is null, null, exp(-greatest(x, 0.0D) / 2))"),
    "reverse_complement(s string)": ("string", "translate(reverse(s), 'ACGTUNRYKMSWBDHVacgt', 'TGCAANYRMKSWVHDBtgca')"),
    "expected_errors(s string)": ("double", "aggregate(transform(filter(split(s, ''), c -> c <> ''), c -> pow(10.0D, -(ascii(c) - 33) / 10.0D)), 0.0D, (a, x) -> a + x)"),
    "cigar_ops(c string)": ("array<struct<len: int, op: string>>", "zip_with(regexp_extract_all(c, '([0-9]+)([MIDNSHP=X])', 1), regexp_extract_all(c, '([0-9]+)([MIDNSHP=X])', 2), (n, o) -> named_struct('len', cast(n as int), 'op', o))"),
    "cigar_ref_len(c string)": ("int", "aggregate(filter(cigar_ops(c), x -> x.op in ('M', 'D', 'N', '=', 'X')), 0, (a, x) -> a + x.len)"),
    "cigar_read_len(c string)": ("int", "aggregate(filter(cigar_ops(c), x -> x.op in ('M', 'I', 'S', '=', 'X')), 0, (a, x) -> a + x.len)"),
}


def register(spark: SparkSession) -> list[str]:
    """Define the functions in the session; returns their names.  They are SQL bodies, so the optimiser sees through them."""
    for head, (result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} returns {result} return {body}")
    return [h.split("(")[0] for h in FUNCTIONS]

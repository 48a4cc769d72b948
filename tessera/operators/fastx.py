"""Operators on plain reads: filters, trims, profiles, unique sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import seq


def drop_named(df: DataFrame, parts: list[str], name: str = "name") -> DataFrame:
    """Reads whose name contains none of the given parts; a null name contains none."""
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.coalesce(F.contains(F.col(name), F.lit(p)), F.lit(False))
    return df.where(~hit)


def max_errors(df: DataFrame, most: float, qual: str = "qual") -> DataFrame:
    return df.where(seq.expected_errors(F.col(qual)) <= most)


def unambiguous(df: DataFrame, column: str = "seq") -> DataFrame:
    return df.where(~seq.is_ambiguous(F.col(column)))


def drop_ambiguous_bases(df: DataFrame) -> DataFrame:
    """Remove ambiguous bases together with their qualities."""
    pairs = F.filter(F.zip_with(seq.letters(F.upper("seq")), seq.letters(F.col("qual")), lambda b, q: F.struct(b.alias("b"), q.alias("q"))), lambda x: x["b"].rlike("^[ACGT]$"))
    d = df.withColumn("_p", pairs)
    return d.withColumn("seq", F.array_join(F.transform("_p", lambda x: x["b"]), "")).withColumn("qual", F.array_join(F.transform("_p", lambda x: x["q"]), "")).drop("_p")


def trim_by_quality(df: DataFrame, threshold: float) -> DataFrame:
    """Cut both ends until the mean error of what was passed is at most ``threshold``; empty if nothing is left."""
    b = seq.trim_bounds(F.col("qual"), threshold)
    d = df.withColumn("_b", b)
    n = F.greatest(F.col("_b.last") - F.col("_b.first") + 1, F.lit(0))
    return d.withColumn("seq", F.substring("seq", F.col("_b.first"), n)).withColumn("qual", F.substring("qual", F.col("_b.first"), n)).drop("_b")


def trim_to_length(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("seq", F.substring("seq", 1, n)).withColumn("qual", F.substring("qual", 1, n))


def trim_tail_below(df: DataFrame, least: int) -> DataFrame:
    """Cut from the first base whose quality is below ``least``."""
    low = F.array_position(F.transform(seq.qualities(F.col("qual")), lambda x: x < least), True)
    n = F.when(low > 0, low - 1).otherwise(F.length("qual")).cast("int")
    return df.withColumn("_n", n).withColumn("seq", F.substring("seq", F.lit(1), F.col("_n"))).withColumn("qual", F.substring("qual", F.lit(1), F.col("_n"))).drop("_n")


def cut_sites(df: DataFrame, threshold: float) -> DataFrame:
    """``first, last`` kept by :func:`trim_by_quality`, beside the read."""
    return df.withColumn("_b", seq.trim_bounds(F.col("qual"), threshold)).withColumns({"first": F.col("_b.first"), "last": F.col("_b.last")}).drop("_b")


def reverse_complement_reads(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", seq.reverse_complement(F.col("seq"))).withColumn("qual", F.reverse("qual"))


def base_by_quality(df: DataFrame) -> DataFrame:
    """``q, base, n, share``: distribution of bases at every quality."""
    z = F.arrays_zip(seq.letters(F.upper("seq")).alias("b"), seq.qualities(F.col("qual")).alias("q"))
    e = df.select(F.explode(z).alias("z")).select(F.col("z.b").alias("base"), F.col("z.q").alias("q")).where("base is not null and q is not null")
    g = e.groupBy("q", "base").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("q")))  # at most 94 x letters rows


def unique_sequences(df: DataFrame, column: str = "seq", index: str = "read_idx", least: int = 1) -> DataFrame:
    """``seq, n_reads, first_idx``: distinct sequences seen at least ``least`` times."""
    return df.groupBy(F.col(column).alias("seq")).agg(F.count("*").alias("n_reads"), F.min(index).alias("first_idx")).where(F.col("n_reads") >= least)


def sequence_members(df: DataFrame, column: str = "seq", index: str = "read_idx") -> DataFrame:
    """``first_idx, index``: every read with the first read of its sequence (a list without collecting it)."""
    first = df.groupBy(F.col(column).alias("_s")).agg(F.min(index).alias("first_idx"))
    return df.join(first, F.col(column).eqNullSafe(F.col("_s"))).select("first_idx", index)


def abundance_rank(df: DataFrame, keys: list, n: int) -> DataFrame:
    """The ``n`` most frequent rows by ``n_reads`` (a distributed top-k)."""
    return df.orderBy(F.desc("n_reads"), *keys).limit(n)


def kmers(df: DataFrame, key: list[str], column: str, k: int) -> DataFrame:
    """One row per distinct k-letter piece of each sequence; shorter ones have none."""
    n = F.length(column) - k + 1
    pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(column), i, F.lit(k)))
    return df.where(n >= 1).select(*key, F.explode(F.array_distinct(pieces)).alias("kmer"))


def nearest_other(df: DataFrame, against: DataFrame, key: str, column: str, block: int = 10_000) -> DataFrame:
    """Least Hamming distance of each row of ``df`` (a stated query set) to rows of ``against`` of equal length.

    The comparison set stays where it is: the query set visits it in blocks of
    about ``block`` rows, each sent to all tasks, so no key gathers the rows of
    one length.  Ties go to the lesser key.
    """
    q = df.select(F.col(key).alias("_q"), F.col(column).alias("_a"), F.length(column).alias("_n"))
    a = against.select(F.col(key).alias("_k"), F.col(column).alias("_b"), F.length(column).alias("_n"))
    parts = -(-q.count() // block) or 1
    joined = [a.join(F.broadcast(q.where(F.pmod(F.xxhash64("_q"), F.lit(parts)) == i)), "_n").where("_q <> _k") for i in range(parts)]
    j = reduce(DataFrame.unionByName, joined)
    d = F.length("_a") - F.length(F.array_join(F.zip_with(seq.letters(F.col("_a")), seq.letters(F.col("_b")), lambda x, y: F.when(x == y, F.lit("x")).otherwise(F.lit(""))), ""))
    g = j.groupBy("_q").agg(F.min(F.struct(d.alias("d"), F.col("_k").alias("k"))).alias("m"))
    return g.select(F.col("_q").alias(key), F.col("m.d").alias("distance"), F.col("m.k").alias("nearest"))


def read_report(df: DataFrame) -> DataFrame:
    return df.select("name", F.length("seq").alias("length"), F.round(seq.expected_errors(F.col("qual")), 6).alias("expected_errors"))


def pair_distance(df: DataFrame) -> DataFrame:
    """Expected number of places at which two reads truly differ, from bases and qualities.

    Equal bases differ truly with probability e1(1-e2) + e2(1-e1) + 2/3 e1 e2,
    unequal ones with one less the chance that an error made the difference.
    """
    e1 = F.transform(seq.qualities(F.col("qual1")), lambda x: F.pow(F.lit(10.0), -x / 10.0))
    e2 = F.transform(seq.qualities(F.col("qual2")), lambda x: F.pow(F.lit(10.0), -x / 10.0))
    z = F.arrays_zip(seq.letters(F.col("seq1")).alias("a"), seq.letters(F.col("seq2")).alias("b"), e1.alias("p"), e2.alias("q"))

    def term(x: Column) -> Column:
        p, q = x["p"], x["q"]
        same = p * (1 - q) + q * (1 - p) + 2.0 / 3 * p * q
        other = 1 - (p * (1 - q) / 3 + q * (1 - p) / 3 + 2.0 / 9 * p * q)
        return F.when(x["a"].isNull() | x["b"].isNull(), 0.0).when(x["a"] == x["b"], same).otherwise(other)

    return df.withColumn("distance", F.aggregate(F.filter(z, lambda x: x["a"].isNotNull() & x["b"].isNotNull()), F.lit(0.0), lambda s, x: s + term(x)))

"""Simulated allotetraploid genomes, individuals and reads with exact alignments.

Every random number comes from a hash of its position and the seed, so any
partition can be recomputed alone with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.seq import complement


def uniform(*keys: Column, seed: int = 1) -> Column:
    """A number in (0, 1) that depends only on the keys and the seed."""
    return (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _base(u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), F.floor(u * 4).cast("int") + 1)


def _other(base: Column, u: Column) -> Column:
    rest = F.array_except(F.array(*[F.lit(x) for x in "ACGT"]), F.array(base))
    return F.element_at(rest, F.floor(u * 3).cast("int") + 1)


def genomes(spark: SparkSession, length: int, homoeo_rate: float = 0.007, allelic_rate: float = 0.005, mismatch_rate: float = 0.0, seed: int = 1) -> DataFrame:
    """``position, a, b, ref_a, ref_b, kind, alt``: one row per site.

    A site is homoeologous with ``homoeo_rate`` (B differs from A), else allelic
    in A or B with twice ``allelic_rate`` and a fair coin.  References differ
    from the truth with ``mismatch_rate``.
    """
    g = spark.range(length).withColumnRenamed("id", "position")
    p = F.col("position")
    u = lambda k: uniform(p, F.lit(k), seed=seed)
    g = g.withColumn("a", _base(u(1)))
    homeo = u(2) < homoeo_rate
    g = g.withColumn("kind", F.when(homeo, "homoeo").when(u(3) < 2 * allelic_rate, F.when(u(4) < 0.5, "allelic_a").otherwise("allelic_b")).otherwise("same"))
    g = g.withColumn("b", F.when(F.col("kind") == "homoeo", _other(F.col("a"), u(5))).otherwise(F.col("a")))
    own = F.when(F.col("kind") == "allelic_a", F.col("a")).when(F.col("kind") == "allelic_b", F.col("b"))
    g = g.withColumn("alt", F.when(own.isNotNull(), _other(F.coalesce(own, F.col("a")), u(6))))
    ref = lambda c, k: F.when(u(k) < mismatch_rate, _other(F.col(c), u(k + 1))).otherwise(F.col(c))
    return g.withColumn("ref_a", ref("a", 7)).withColumn("ref_b", ref("b", 9))


def individuals(g: DataFrame, n: int, alpha: int = 100, beta: int = 100, seed: int = 1) -> DataFrame:
    """``genotype, position, a1, a2, b1, b2``: haplotypes by Hardy-Weinberg at an allele frequency from Beta(alpha, beta).

    The Beta variate is the ratio of two sums of exponentials (whole-number
    parameters).
    """
    total = lambda k, m: F.aggregate(F.sequence(F.lit(1), F.lit(m)), F.lit(0.0), lambda s, i: s - F.ln(uniform(F.col("position"), F.lit(k), i, seed=seed)))
    g = g.withColumn("_x", F.when(F.col("alt").isNotNull(), total(21, alpha))).withColumn("_y", F.when(F.col("alt").isNotNull(), total(22, beta)))
    g = g.withColumn("freq", F.col("_x") / (F.col("_x") + F.col("_y"))).drop("_x", "_y")
    d = g.withColumn("genotype", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("ind"), i.cast("string")))))

    def allele(s: str, i: int) -> Column:
        takes = (F.col("kind") == f"allelic_{s}") & (uniform(F.col("position"), F.col("genotype"), F.lit(f"{s}{i}"), seed=seed) < F.col("freq"))
        return F.when(takes, F.col("alt")).otherwise(F.col(s)).alias(f"{s}{i}")

    return d.select("genotype", "position", "ref_a", "ref_b", *[allele(s, i) for s in "ab" for i in (1, 2)])


def reads(haplotypes: DataFrame, coverage: int, read_length: int = 150, seed: int = 1, mean_q: int = 35) -> DataFrame:
    """Bases of simulated reads at exact places: ``genotype, read_id, hap, rd_idx, pos0, base, q``.

    Each chromosome copy is tiled so that every site is covered ``coverage``
    times: read ``i`` starts at a hashed offset within its tile.  Errors follow
    the qualities.
    """
    h = haplotypes.select("genotype", "position", F.explode(F.array(*[F.struct(F.lit(x).alias("hap"), F.col(x).alias("base")) for x in ("a1", "a2", "b1", "b2")])).alias("h"))
    h = h.select("genotype", "position", "h.hap", "h.base", F.explode(F.sequence(F.lit(0), F.lit(coverage - 1))).alias("layer"))
    shift = F.floor(uniform(F.col("genotype"), F.col("hap"), F.col("layer"), seed=seed) * read_length).cast("bigint")
    h = h.withColumn("_t", F.col("position") + shift)
    h = h.withColumn("tile", F.floor(F.col("_t") / read_length)).withColumn("rd_idx", F.pmod(F.col("_t"), F.lit(read_length)).cast("int"))
    h = h.withColumn("read_id", F.concat_ws(":", "genotype", "hap", F.col("layer").cast("string"), F.col("tile").cast("string")))
    q = (F.lit(mean_q) - F.floor(uniform(F.col("read_id"), F.col("rd_idx"), F.lit("q"), seed=seed) * 15)).cast("int")
    h = h.withColumn("q", q)
    wrong = uniform(F.col("read_id"), F.col("rd_idx"), F.lit("e"), seed=seed) < F.pow(F.lit(10.0), -F.col("q") / 10.0)
    base = F.when(wrong, _other(F.col("base"), uniform(F.col("read_id"), F.col("rd_idx"), F.lit("b"), seed=seed))).otherwise(F.col("base"))
    return h.select("genotype", "read_id", "hap", "rd_idx", F.col("position").alias("pos0"), base.alias("base"), "q")


def to_sam(bases: DataFrame, rname: str = "chr") -> DataFrame:
    """Alignment rows of simulated reads: each read is one run of matches."""
    arr = F.array_sort(F.collect_list(F.struct("pos0", "base", "q")))
    g = bases.groupBy("genotype", "read_id").agg(arr.alias("_b"))
    seq = F.array_join(F.transform("_b", lambda x: x["base"]), "")
    qual = F.array_join(F.transform("_b", lambda x: F.char(x["q"] + 33)), "")
    return g.select(F.col("genotype").alias("sample"), F.col("read_id").alias("qname"), F.lit(0).alias("flag"), F.lit(rname).alias("rname"), (F.col("_b")[0]["pos0"] + 1).alias("pos"), F.lit(255).alias("mapq"), F.concat(F.size("_b").cast("string"), F.lit("M")).alias("cigar"), seq.alias("seq"), qual.alias("qual"))


def to_fasta(g: DataFrame, column: str, name: str, block: int = 1_000_000) -> DataFrame:
    """``name, part, seq``: a genome's bases in blocks of bounded size."""
    arr = F.array_sort(F.collect_list(F.struct("position", column)))
    b = g.groupBy(F.floor(F.col("position") / block).alias("part")).agg(F.array_join(F.transform(arr, lambda x: x[column]), "").alias("seq"))
    return b.select(F.lit(name).alias("name"), "part", "seq")


def reversed_b(bases: DataFrame) -> DataFrame:
    """Bases as the opposite strand reads them."""
    return bases.withColumn("base", complement(F.col("base")))

"""Mixing sources to target weights by Pareto order sampling.

Each source gets whole copies of all its records as far as its share asks and
``max_repeats`` allows; the rest of its share is a fixed-size sample with
unequal inclusion probabilities.  Records are ranked by their random odds
divided by their inclusion odds, and the smallest ranks are taken until the
remaining size is filled.  The cut-off rank is found from distributed rank
histograms, never by ordering a source in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.truncation import canonical_source
from tessera.storage import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the vocabulary file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BINS = 4096
STEPS = 256  # bins of the weight histogram an octave
_LOADED: dict[str, object] = {}


def load_tokenizer(path: str = TOKENIZER):
    """The byte-level BPE of a rank file; loaded once per Python worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of each text; null and empty texts have none."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load_tokenizer(path)
        for s in parts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return count(text)


def sized(docs: DataFrame, key: str, text: str, source: str, path: str = TOKENIZER) -> DataFrame:
    """``_id, _source, size``: each record's source and tokens."""
    return docs.select(F.col(f"`{key}`").alias("_id"), canonical_source(F.col(f"`{source}`")).alias("_source"), token_count(F.col(f"`{text}`"), path).alias("size"))


def allocate(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: wanted and available size, whole copies, rest and reachability.

    The total size is that of all records from target sources unless given.
    A source with share 0 takes nothing; one without records cannot reach a
    positive share; spellings of one source in the targets add up their shares
    and keep the smallest cap.
    """
    t = targets.groupBy(canonical_source(F.col("source_name")).alias("_source")).agg(
        F.min("source_name").alias("source_name"), F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    have = sizes.groupBy("_source").agg(F.sum("size").alias("available"), F.count("*").alias("n_records"))
    p = stage(t.join(have, "_source", "left").na.fill({"available": 0, "n_records": 0}), "mix-plan")
    whole = total if total is not None else (p.agg(F.sum("available")).first()[0] or 0)
    want = F.coalesce(F.col("target_share"), F.lit(0.0)) * F.lit(float(whole))
    cap = F.coalesce(F.col("max_repeats"), F.lit(1)).cast("double")
    p = p.withColumn("wanted", want).withColumn("reachable", cap * F.col("available") >= want)
    repeats = F.when(F.col("available") > 0, F.least(want / F.greatest(F.col("available"), F.lit(1)), cap)).otherwise(0.0)
    p = p.withColumn("copies", F.floor(repeats + F.lit(1e-12)).cast("int"))
    return p.withColumn("rest", F.greatest(F.round((repeats - F.col("copies")) * F.col("available")), F.lit(0.0)).cast("bigint"))


def _inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``lam``: inclusion probability proportional to weight, capped at 1, of expected size ``rest``.

    One histogram of the weights per source (:data:`STEPS` bins an octave)
    tells which records are certain, up to those of one bin; from there the
    factor is solved with the certain records it implies until it no longer
    changes.  The expected size is concave in the factor, so this ends after
    a step or two.
    """
    plan = plan.select("_source", "rest").where("rest > 0")
    cur = sizes.join(plan, "_source").where("size > 0 and weight > 0")
    hist = cur.groupBy("_source", F.floor(F.log2("weight") * STEPS).alias("bin")).agg(F.max("rest").alias("rest"), F.sum("size").alias("s"), F.sum(F.col("size") * F.col("weight")).alias("t"), F.max("weight").alias("w"))
    w = Window.partitionBy("_source").orderBy(F.desc("bin"))
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    below = w.rowsBetween(0, Window.unboundedFollowing)
    c = (F.col("rest") - F.coalesce(F.sum("s").over(above), F.lit(0))) / F.sum("t").over(below)
    # the first bin whose records are not certain when all above it are
    fits = hist.withColumn("c", c).withColumn("w", F.col("w")).where("c > 0").groupBy("_source").agg(F.max(F.when(F.col("c") * F.col("w") <= 1, F.col("c"))).alias("c"), F.max("c").alias("top"))
    factor = stage(fits.select("_source", F.coalesce("c", "top").alias("c")), "mix-factor")
    while True:
        over = cur.join(factor, "_source").groupBy("_source").agg(
            F.max("c").alias("c"), F.max("rest").alias("rest"),
            F.sum(F.when(F.col("weight") * F.col("c") >= 1, F.col("size")).otherwise(0)).alias("sure"),
            F.sum(F.when(F.col("weight") * F.col("c") < 1, F.col("size") * F.col("weight")).otherwise(0.0)).alias("open"),
        )
        nxt = stage(over.select("_source", "c", F.when((F.col("open") > 0) & (F.col("rest") > F.col("sure")), (F.col("rest") - F.col("sure")) / F.col("open")).otherwise(F.col("c")).alias("n")), "mix-factor")
        factor = nxt.select("_source", F.col("n").alias("c"))
        if nxt.where("abs(n - c) > c * 1e-9").isEmpty():
            break
    return cur.join(factor, "_source").withColumn("lam", F.least(F.col("weight") * F.col("c"), F.lit(1.0))).drop("c")


def pareto_sample(sizes: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """``_id, _source, size`` of a fixed-size Pareto sample of every source.

    ``sizes`` has ``_id, _source, size, weight``.  The random number of a
    record comes from its key and the seed, so a lost task repeats its choice.
    Ties of rank go by key.  A record across the cut is taken if at least half
    of it fits.
    """
    r = _inclusion(sizes, plan)
    u = (F.shiftrightunsigned(F.xxhash64(F.col("_id"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    q = F.when(F.col("lam") >= 1, 0.0).otherwise(u / (1 - u) * (1 - F.col("lam")) / F.col("lam"))
    r = stage(r.select("_id", "_source", "size", "rest", (q / (1 + q)).alias("rank")), "mix-rank")
    taken, left = [], r.withColumn("lo", F.lit(0.0)).withColumn("width", F.lit(1.0))
    for _ in range(2):  # two histogram levels: a bin then holds 1/BINS**2 of the ranks
        bin_ = F.least(F.floor((F.col("rank") - F.col("lo")) / F.col("width") * BINS), F.lit(BINS - 1)).alias("bin")
        left = left.withColumn("bin", bin_)
        hist = left.groupBy("_source", "rest", "bin").agg(F.sum("size").alias("n"))
        w = Window.partitionBy("_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        cut = hist.withColumn("cum", F.sum("n").over(w)).withColumn("before", F.col("cum") - F.col("n")).where("cum > rest").groupBy("_source").agg(F.min("bin").alias("cut"), F.min("before").alias("before"))
        cut = stage(cut, "mix-cut")
        j = left.join(F.broadcast(cut) if cut.count() <= 10_000 else cut, "_source", "left")
        taken.append(j.where("cut is null or bin < cut").select("_id", "_source", "size"))
        left = j.where("bin = cut").select("_id", "_source", "size", (F.col("rest") - F.col("before")).alias("rest"), "rank", (F.col("lo") + F.col("bin") * F.col("width") / BINS).alias("lo"), (F.col("width") / BINS).alias("width"))
    w = Window.partitionBy("_source").orderBy("rank", "_id").rowsBetween(Window.unboundedPreceding, 0)
    last = left.withColumn("cum", F.sum("size").over(w)).where("cum - size / 2 <= rest")
    out = last.select("_id", "_source", "size")
    for t in taken:
        out = out.unionByName(t)
    return out


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weight: str | None = None, total: int | None = None, path: str = TOKENIZER, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture (``_id, source_name, size, copies``) and the report of shares.

    ``weight`` is a SQL expression over ``size`` that inclusion probabilities
    follow within a source (default: equal).  Records of sources without a
    target, records without tokens and sources with share 0 get no copies.
    Repeated rows are separate records.
    """
    s = stage(sized(docs, key, text, source, path), "mix-sizes")
    names = targets.select(canonical_source(F.col("source_name")).alias("_source")).distinct()
    s = s.join(names, "_source", "left_semi").withColumn("weight", F.expr(weight or "1.0").cast("double"))
    plan = stage(allocate(s, targets, total), "mix-plan")
    extra = stage(pareto_sample(s, plan, seed).withColumn("extra", F.lit(1)), "mix-sample")
    whole = s.join(plan.where("copies > 0").select("_source", "copies"), "_source").select("_id", "_source", "size", "copies")
    rows = whole.unionByName(extra.select("_id", "_source", "size", F.col("extra").alias("copies")))
    used = rows.groupBy("_source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"))
    report = plan.join(used, "_source", "left").na.fill({"used": 0})
    # a source falls short if its sample does; a sample may end within a record of the wanted size, so the cap decides then
    report = stage(report.withColumn("reachable", (F.col("used") >= F.col("wanted")) | F.col("reachable")), "mix-report")
    reached = report.agg(F.sum("used")).first()[0] or 0
    report = report.withColumn("actual_share", F.col("used") / F.lit(max(reached, 1)))
    return rows.join(plan.select("_source", "source_name"), "_source"), report

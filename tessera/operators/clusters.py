"""Categorical clustering, agreement of clusterings, and denoising of amplicons."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.ordering import row_index, sample_rows
from tessera.storage import discard, small, stage

MAX_MODES = 10_000


def assign_modes(df: DataFrame, modes: DataFrame, key: str, codes: str) -> DataFrame:
    """``key, cluster, distance``: nearest mode of each row by Hamming distance, ties to the lesser cluster.

    A null differs from any code, not from null.  The modes (``cluster, mode``)
    go to all tasks after a check of their number, and rows never move; more
    than :data:`MAX_MODES` go in blocks, and each key's best block counts (keys
    are then one row each).  A row without codes has a null distance, and
    without modes there is no cluster.
    """
    rows = small(modes.select("cluster", "mode").where("mode is not null"), MAX_MODES)
    if rows is None:
        m = stage(modes.select("cluster", "mode").where("mode is not null"), "modes")
        n = -(-m.count() * 5 // (4 * MAX_MODES))
        parts = [assign_modes(df, m.where(F.pmod(F.xxhash64("cluster"), F.lit(n)) == i), key, codes) for i in range(n)]
        best = F.min(F.struct(F.col("distance").isNull().alias("none"), "distance", "cluster")).alias("_b")
        return reduce(DataFrame.unionByName, parts).where("cluster is not null").groupBy(key).agg(best).select(key, "_b.cluster", "_b.distance")
    rows.sort(key=lambda r: r["cluster"])
    labels, known = [r["cluster"] for r in rows], list(dict.fromkeys(c for r in rows for c in r["mode"] if c is not None))
    place = {c: i for i, c in enumerate([*known, None])}
    width = max((len(r["mode"]) for r in rows), default=0)
    m = np.array([[place[c] for c in r["mode"]] + [len(known)] * (width - len(r["mode"])) for r in rows], np.int32).reshape(len(rows), width)
    out = StructType([df.schema[key], StructField("cluster", modes.schema["cluster"].dataType), StructField("distance", IntegerType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            n, lists = b.num_rows, b.column(1)
            none = np.asarray(lists.is_null().to_numpy(zero_copy_only=False), bool)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            w = max(width, int(size.max(initial=0)))
            x = np.full((n, w), len(known), np.int32)
            x[np.arange(w) < size[:, None]] = pc.fill_null(pc.index_in(flat, value_set=pa.array([*known, None], flat.type)), -1).to_numpy(zero_copy_only=False)
            best, far = np.zeros(n, np.int64), np.zeros(n, np.int32)
            step = max(1, 200_000 // max(len(m), 1))
            for i in range(0, n if len(m) else 0, step):
                y = x[i : i + step]
                d = np.zeros((len(y), len(m)), np.int32)
                for j in range(w):
                    d += y[:, j, None] != (m[:, j] if j < width else len(known))
                best[i : i + step] = d.argmin(1)
                far[i : i + step] = d.min(1)
            gone = none | (len(m) == 0)
            cluster = pa.array(labels, pa_out[1]).take(pa.array(best)) if labels else pa.nulls(n, pa_out[1])
            yield pa.RecordBatch.from_arrays([b.column(0), cluster, pa.array(far, pa.int32(), mask=gone)], names=[key, "cluster", "distance"])

    pa_out = [f.type for f in to_arrow_schema(out)]
    return df.select(key, F.col(codes).alias("_x")).mapInArrow(run, out)


def update_modes(df: DataFrame, assigned: DataFrame, key: str, codes: str) -> DataFrame:
    """``cluster, mode``: most frequent code per cluster and site, ties to the lesser code; nulls don't count."""
    e = df.join(assigned.select(key, "cluster"), key).select("cluster", F.posexplode(codes).alias("site", "code"))
    n = e.where("code is not null").groupBy("cluster", "site", "code").agg(F.count("*").alias("n"))
    m = n.groupBy("cluster", "site").agg(F.max(F.struct("n", (-F.col("code")).alias("neg"))).alias("v"))
    width = df.agg(F.max(F.size(codes))).first()[0] or 0
    per = m.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("site", -F.col("v.neg")))).alias("_m"))
    return per.select("cluster", F.transform(F.sequence(F.lit(0), F.lit(max(width - 1, 0))), lambda i: F.try_element_at("_m", i)).alias("mode"))


def kmodes(df: DataFrame, k: int, key: str, codes: str, seeds: DataFrame | None = None, max_iter: int | None = 20, seed: int = 1) -> tuple[DataFrame, DataFrame, list[int]]:
    """Lloyd's k-modes: assignment, modes and the cost after each round.

    Seeds default to ``k`` rows drawn by key hash.  Rounds end when the cost
    no longer falls; if ``max_iter`` (None: no limit) comes first, this raises
    instead of returning.  Every round is one map over the rows and one grouped
    count.
    """
    df = df.where(F.col(codes).isNotNull())
    if seeds is None:
        s = sample_rows(df.select(key, F.col(codes).alias("mode")), [key], k, seed)
        seeds = s.withColumn("cluster", (F.row_number().over(Window.orderBy(key)) - 1).cast("int")).select("cluster", "mode")  # k rows
    modes, costs, a = stage(seeds, "modes"), [], None
    while True:
        before, a = a, stage(assign_modes(df, modes, key, codes), "assigned")
        if before is not None:
            discard(before)
        costs.append(int(a.agg(F.sum("distance")).first()[0] or 0))
        if len(costs) > 1 and costs[-1] >= costs[-2]:
            return a, modes, costs
        if max_iter is not None and len(costs) > max_iter:
            raise RuntimeError(f"k-modes: the cost still falls after {max_iter} rounds: {costs}")
        old, modes = modes, stage(update_modes(df, a, key, codes), "modes")
        discard(old)


def seed_by_distance(df: DataFrame, k: int, key: str, codes: str, seed: int = 1) -> DataFrame:
    """Seeds far from each other: each next one is drawn with odds of the distance to the nearest seed.

    The draw is a weighted minimum (exponential clocks from the key's hash), so
    every step is one aggregation.
    """
    picked = sample_rows(df.select(key, codes), [key], 1, seed).withColumn("cluster", F.lit(0)).select("cluster", F.col(codes).alias("mode"))
    picked = stage(picked, "seeds")
    for i in range(1, k):
        d = assign_modes(df, picked, key, codes).where("distance > 0")
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed + i)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        pick = d.select(F.struct((-F.ln(u) / F.col("distance")).alias("t"), F.col(key).alias("k")).alias("v")).agg(F.min("v").alias("v")).select(F.col("v.k").alias(key))
        row = df.join(F.broadcast(pick), key).limit(1).select(F.lit(i).alias("cluster"), F.col(codes).alias("mode"))
        picked = stage(picked.unionByName(row), "seeds")
    return picked


def density_seeds(df: DataFrame, k: int, key: str, codes: str) -> DataFrame:
    """The ``k`` rows of greatest density: mean frequency of their codes over all sites."""
    e = df.select(key, F.posexplode(codes).alias("site", "code"))
    n = e.groupBy("site", "code").agg(F.count("*").alias("n"))
    d = e.join(n, ["site", "code"]).groupBy(key).agg(F.avg("n").alias("density"))
    top = d.orderBy(F.desc("density"), key).limit(k)
    return df.join(top, key).withColumn("cluster", (F.row_number().over(Window.orderBy(F.desc("density"), key)) - 1).cast("int")).select("cluster", F.col(codes).alias("mode"))


def seeds_from_set(rows: DataFrame, k: int, key: str, codes: str, seed: int = 1) -> DataFrame:
    """``k`` different code lists drawn from a given set of rows; fewer if it has fewer."""
    one = rows.where(F.col(codes).isNotNull()).groupBy(F.col(codes).alias("mode")).agg(F.min(key).alias("_k"))
    return _numbered(sample_rows(one, ["_k"], k, seed), "_k")


def seeds_from_partition(df: DataFrame, partition: DataFrame, k: int, key: str, codes: str, seed: int = 1) -> DataFrame:
    """One row drawn from each of up to ``k`` groups of a partition (``key, cluster``), largest groups first."""
    size = partition.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "cluster").limit(k)
    drawn = partition.join(size, "cluster").groupBy("cluster").agg(F.min(F.struct(F.xxhash64(F.col(key), F.lit(seed)), F.col(key).alias("k")))["k"].alias(key))
    return _numbered(df.join(drawn, key).withColumn("mode", F.col(codes)), key)


def seeds_by_frequency(df: DataFrame, k: int, key: str, codes: str) -> DataFrame:
    """Frequent codes dealt out over ``k`` drafts site by site, each replaced by the row nearest to it.

    Draft ``i`` takes at every site the code of rank ``i`` (round again where a
    site has fewer codes), so the drafts differ; a draft that is no row's
    nearest stays as it is.
    """
    n = df.select(F.posexplode(codes).alias("site", "code")).where("code is not null").groupBy("site", "code").agg(F.count("*").alias("n"))
    ranked = n.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", (-F.col("code")).alias("c"))), asc=False), lambda x: -x["c"]).alias("codes"))  # codes of a site
    draft = ranked.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("cluster", "site", F.element_at("codes", (F.pmod(F.col("cluster") + F.col("site"), F.size("codes")) + 1).cast("int")).alias("code"))
    draft = stage(draft.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("site", "code"))), lambda x: x["code"]).alias("mode")), "seeds")
    near = assign_modes(df, draft, key, codes).groupBy("cluster").agg(F.min(F.struct("distance", F.col(key).alias("k")))["k"].alias(key))
    rows = df.join(near, key).select("cluster", F.col(codes).alias("_row"))
    return stage(draft.join(rows, "cluster", "left").select("cluster", F.coalesce("_row", "mode").alias("mode")), "seeds")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    return stage(rows.withColumn("cluster", (F.row_number().over(Window.orderBy(order)) - 1).cast("int")).select("cluster", "mode"), "seeds")  # k rows


def transfer_modes(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Optimal transfer of single rows between clusters until none lowers the cost: labels and cost.

    The cost of a cluster is the number of its codes that differ from its modes.
    A row's move changes it by the modal counts with and without the row.
    Codes are whole numbers from 0; ties keep the row where it is, and no
    cluster is emptied.
    """
    n, sites = x.shape
    label = label.copy()
    counts = np.zeros((k, sites, int(x.max(initial=0)) + 1), np.int64)
    at = np.arange(sites)
    for i in range(n):
        counts[label[i], at, x[i]] += 1
    size = np.bincount(label, minlength=k)
    quiet, i = 0, 0
    while quiet < n:
        a = label[i]
        if size[a] > 1:
            top = counts.max(2)
            own = counts[:, at, x[i]]
            join = sites - (np.maximum(own + 1, top) - top).sum(1)  # what the row adds to each cluster
            counts[a, at, x[i]] -= 1
            leave = sites - (top[a] - counts[a].max(1)).sum()  # what it costs where it is
            join[a] = leave
            b = int(join.argmin())
            if join[b] >= leave:
                b = a
            counts[b, at, x[i]] += 1
            if b != a:
                size[a] -= 1
                size[b] += 1
                label[i], quiet = b, -1
        quiet += 1
        i = (i + 1) % n
    return label, int((size[:, None] - counts.max(2)).sum())


def kmodes_transfer(df: DataFrame, k: int, group: list[str], key: str, codes: str) -> DataFrame:
    """``group, key, cluster, cost``: clusters of each group by optimal transfer, from rows dealt out in order.

    The method is sequential, so one group is one task; groups run in parallel.
    Rows need equally long codes from 0 on without nulls; others are left out.
    """
    ok = df.where(F.col(codes).isNotNull() & ~F.exists(codes, lambda v: v.isNull() | (v < 0)))
    schema = ", ".join(f"`{c}` {ok.schema[c].dataType.simpleString()}" for c in [*group, key]) + ", cluster int, cost bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        m = min(k, len(pdf))
        label, cost = transfer_modes(np.stack(pdf[codes].to_list()).astype(np.int64), np.arange(len(pdf)) % m, m)
        return pdf[[*group, key]].assign(cluster=label.astype(np.int32), cost=cost)

    return ok.select(*group, key, codes).groupBy(*group).applyInPandas(run, schema)


def estimate_k(df: DataFrame, ks: list[int], key: str, codes: str, seed: int = 1, starts: int = 1) -> pd.DataFrame:
    """Cost, jump and Krzanowski-Lai statistic of each number of clusters; the greatest of either is the estimate.

    The cost is the least of ``starts`` seedings, with their standard deviation
    beside it.  The second statistic compares how the cost falls before and
    after a number, so it needs consecutive numbers and is missing at the ends.
    """
    p = df.agg(F.max(F.size(codes))).first()[0]
    n = df.count()
    rows, last = [], 0.0
    for k in ks:
        costs = [kmodes(df, k, key, codes, max_iter=None, seed=seed + i)[2][-1] for i in range(starts)]
        cost = min(costs)
        d = (max(cost, 1) / (n * p)) ** (-p / 2) if cost else math.inf
        rows.append((k, cost, float(np.std(costs)), d - last))
        last = d
    out = pd.DataFrame(rows, columns=["k", "cost", "sd", "jump"])
    w = dict(zip(out["k"], out["cost"]))
    fall = {k: (k - 1) ** (2 / p) * w[k - 1] - k ** (2 / p) * w[k] for k in w if k - 1 in w}
    out["kl"] = [abs(fall[k] / fall[k + 1]) if k in fall and fall.get(k + 1) else math.nan for k in out["k"]]
    return out


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n``: rows per pair of labels; rows with a null label are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row of agreement indices of two labelings: Rand, adjusted Rand, mutual information and its norms.

    ``mi, nmi_min, nmi_geo, nmi_mean, nmi_max, nmi_joint, vi, nvi, rand, ari``;
    null where the denominator is 0 (one cluster on both sides).
    """
    c = contingency(df, a, b)
    ra, rb = c.groupBy("a").agg(F.sum("n").alias("n")), c.groupBy("b").agg(F.sum("n").alias("n"))
    two = lambda x: x * (x - 1) / 2.0
    nl = lambda x: x * F.ln(x)
    n = F.col("n").cast("double")
    tot = c.agg(F.sum("n").cast("double").alias("t"), F.sum(two(n)).alias("s"), F.sum(nl(n)).alias("h"))
    ta = ra.agg(F.sum(two(n)).alias("sa"), F.sum(nl(n)).alias("la"))
    tb = rb.agg(F.sum(two(n)).alias("sb"), F.sum(nl(n)).alias("lb"))
    r = tot.crossJoin(ta).crossJoin(tb)  # one row each
    t = F.col("t")
    r = r.withColumns({"ha": F.ln(t) - F.col("la") / t, "hb": F.ln(t) - F.col("lb") / t, "hj": F.ln(t) - F.col("h") / t})
    r = r.withColumn("mi", F.col("ha") + F.col("hb") - F.col("hj"))
    safe = lambda x, y: F.when(F.abs(y) > 1e-12, x / y)
    mi = F.col("mi")
    pairs = two(t)
    expected = safe(F.col("sa") * F.col("sb"), pairs)
    return r.select(
        t.cast("bigint").alias("n"), mi, safe(mi, F.least("ha", "hb")).alias("nmi_min"), safe(mi, F.sqrt(F.col("ha") * F.col("hb"))).alias("nmi_geo"),
        safe(2 * mi, F.col("ha") + F.col("hb")).alias("nmi_mean"), safe(mi, F.greatest("ha", "hb")).alias("nmi_max"), safe(mi, F.col("hj")).alias("nmi_joint"),
        (F.col("ha") + F.col("hb") - 2 * mi).alias("vi"), (1 - safe(mi, F.col("hj"))).alias("nvi"),
        safe(pairs + 2 * F.col("s") - F.col("sa") - F.col("sb"), pairs).alias("rand"),
        safe(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("ari"),
    )


def homogeneity(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Biological homogeneity: mean over clusters of the share of row pairs with equal truth, from counts."""
    c = contingency(df, cluster, truth).groupBy("a").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("n > 1")
    return c.agg(F.avg(F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("bhi"), F.count("*").alias("n_clusters"))


def abundance_ranks(df: DataFrame, cluster: str) -> DataFrame:
    """Clusters by size, largest first (ties by label)."""
    g = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"))
    return row_index(g, [F.desc("n"), cluster], "_no").withColumn("rank", (F.col("_no") + 1).cast("int")).drop("_no")


# Upper bound of the error share by Hamming distance, up to 11 places.
DEBLUR_ERRORS = [0, 0.06, 0.02, 0.02, 0.01, 0.005, 0.005, 0.005, 0.001, 0.001, 0.001, 0.0005]


def deblur(pdf: pd.DataFrame, errors: list[float] | None = None, error_rate: float = 0.005, adjust: float = 1.0, most: int | None = None) -> pd.DataFrame:
    """Sequential denoising of one sample's unique sequences of equal length.

    In order of observed abundance each sequence still above 0 subtracts its
    expected errors from all later ones within the error table's distance.
    Its own reads are scaled up by those it lost to errors: with ``error_rate``
    a place, a share ``(1 - error_rate) ** length`` stays free of errors.
    Sequences above 0 are kept, at most ``most`` of them by observed abundance.
    """
    beta = np.array(errors or DEBLUR_ERRORS)
    d = pdf.sort_values(["n_reads", "seq"], ascending=[False, True]).reset_index(drop=True)
    x = np.array([np.frombuffer(s.encode(), np.uint8) for s in d["seq"]])
    n = d["n_reads"].to_numpy(float).copy()
    clean = (1 - error_rate) ** (x.shape[1] if len(d) else 0)
    for i in range(len(d)):
        if n[i] <= 0:
            continue
        far = (x[i + 1 :] != x[i]).sum(1)
        near = far < len(beta)
        n[i + 1 :][near] -= np.floor(n[i]) / clean * beta[far[near]] * adjust
    d["abundance"] = n
    kept = d[n > 0]
    return kept if most is None else kept.head(most)


def deblur_samples(uniq: DataFrame, sample: str, error_rate: float = 0.005, adjust: float = 1.0, most: int | None = None) -> DataFrame:
    """``sample, seq, abundance`` after denoising each sample and length on its own.

    The method is sequential within a sample, so one group is one task; samples
    and lengths run in parallel.
    """
    kind = uniq.schema[sample].dataType.simpleString()
    u = uniq.select(sample, "seq", "n_reads", F.length("seq").alias("_len")).where("seq is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return deblur(pdf, None, error_rate, adjust, most)[[sample, "seq", "abundance"]]

    return u.groupBy(sample, "_len").applyInPandas(run, f"`{sample}` {kind}, seq string, abundance double")


def haplotype_mixture(reads: DataFrame, k: int, key: str = "read_idx", max_iter: int = 30, eps: float = 1e-6) -> tuple[DataFrame, pd.DataFrame, list[float]]:
    """Mixture of ``k`` haplotypes over reads (``key, site, base, q``) with the literal error model.

    Returns the reads' posteriors (``key, cluster, pp``), the haplotypes with
    their weights, and the log-likelihoods.  The E-step is one join with the
    small haplotype table and a grouped sum; the M-step one grouped count.
    """
    from tessera.functions.seq import emit_logp

    reads = reads.select(key, "site", "base", "q")
    seqs = reads.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "base"))), lambda v: v["base"]), "").alias("s"))
    top = seqs.groupBy("s").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(k).collect()
    haps = pd.DataFrame([(i, j, c) for i, r in enumerate(top) for j, c in enumerate(r["s"])], columns=["cluster", "site", "hap"])
    pi = pd.DataFrame({"cluster": range(len(top)), "w": [r["n"] for r in top]})
    pi["w"] = pi["w"] / pi["w"].sum()
    lls: list[float] = []
    spark = reads.sparkSession
    while True:
        h = F.broadcast(spark.createDataFrame(haps))  # k haplotypes
        w = F.broadcast(spark.createDataFrame(pi))
        e = reads.join(h, "site").groupBy(key, "cluster").agg(F.sum(emit_logp(F.col("hap"), F.col("base"), F.col("q"))).alias("ll"))
        e = e.join(w, "cluster").withColumn("ll", F.col("ll") + F.ln(F.greatest("w", F.lit(1e-300))))
        t = e.groupBy(key).agg(F.max("ll").alias("m"))
        e = e.join(t, key).withColumn("x", F.exp(F.col("ll") - F.col("m")))
        s = e.groupBy(key).agg(F.sum("x").alias("s"), F.max("m").alias("mm"))
        pp = stage(e.join(s, key).select(key, "cluster", (F.col("x") / F.col("s")).alias("pp")), "mixture")
        lls.append(float(s.agg(F.sum(F.ln("s") + F.col("mm"))).first()[0]))
        if len(lls) > max_iter or (len(lls) > 1 and lls[-1] - lls[-2] <= abs(lls[-1]) * eps):
            return pp, haps.merge(pi, on="cluster"), lls
        pi = pp.groupBy("cluster").agg(F.avg("pp").alias("w")).toPandas()
        score = reads.join(pp, key).groupBy("cluster", "site", "base").agg(F.sum(F.col("pp") * F.greatest(F.col("q"), F.lit(1))).alias("v"))
        best = score.groupBy("cluster", "site").agg(F.max(F.struct("v", F.col("base").alias("hap"))).alias("b"))
        haps = best.select("cluster", "site", F.col("b.hap").alias("hap")).toPandas()


def select_k(reads: DataFrame, ks: list[int], key: str = "read_idx") -> pd.DataFrame:
    """BIC and AIC of the mixture for growing ``k``; stops at the first increase of BIC."""
    n, sites = reads.select(key).distinct().count(), reads.agg(F.max("site")).first()[0] + 1
    rows: list[tuple] = []
    for k in ks:
        ll = haplotype_mixture(reads, k, key)[2][-1]
        p = k * sites + k - 1
        rows.append((k, ll, 2 * p - 2 * ll, p * math.log(n) - 2 * ll))
        if len(rows) > 1 and rows[-1][3] > rows[-2][3]:
            break
    return pd.DataFrame(rows, columns=["k", "loglik", "aic", "bic"])

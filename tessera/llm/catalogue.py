"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import leakage, mixing, nearcopies, percentiles, similarity, truncation
from tessera.operators.versions import latest


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _observations(spark: SparkSession, sf: str):
    return similarity.density_peaks(_table(spark, sf, "kmodes_obs"), "obs_id", "dmat", radius=10)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every observation with the least observation of its cluster."""
    found = similarity.labels(_observations(spark, sf)).where("id <> first_id")
    return found.select(F.col("first_id").alias("first_obs_id"), F.col("id").alias("obs_id"))


def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters with their size and most typical members."""
    return similarity.describe(_observations(spark, sf)).select(F.col("first_id").alias("first_obs_id"), F.col("n").alias("n_obs"), "typical")


def _coverages(spark: SparkSession, sf: str) -> DataFrame:
    """``genotype, coverage, value`` of the valid versions, measured values only."""
    g = latest(_table(spark, sf, "gatk_info"), ["info_id"], "loaded_at", ["genotype", "cova", "covb"])
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), F.col(c).alias("value")) for c in ("cova", "covb")])).alias("x")
    return g.select("genotype", kinds).select("genotype", "x.coverage", "x.value").where("value >= 0")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Genotypes whose 90th percentile of a coverage exceeds 4 times its median."""
    s = percentiles.sketch(_coverages(spark, sf), ["genotype", "coverage"], "value")
    p = percentiles.percentiles(s, ["genotype", "coverage"], {"p50": 0.5, "p90": 0.9})
    return p.where("p90 > 4 * p50").select("genotype", "coverage")


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per genotype and coverage, combined from one sketch per load day."""
    g = latest(_table(spark, sf, "gatk_info"), ["info_id"], "loaded_at", ["loaded_at", "genotype", "cova", "covb"])
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), F.col(c).alias("value")) for c in ("cova", "covb")])).alias("x")
    days = g.select("genotype", F.to_date("loaded_at").alias("day"), kinds).select("genotype", "day", "x.coverage", "x.value").where("value >= 0")
    daily = percentiles.sketch(days, ["genotype", "coverage", "day"], "value")
    whole = percentiles.merge(daily, ["genotype", "coverage"])
    return percentiles.percentiles(whole, ["genotype", "coverage"], {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99})


def p3_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the combined sketches of the loads meet the rank-error bound, from exact ranks of all values."""
    fractions = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    v = _coverages(spark, sf)
    p = p3_percentiles(spark, sf)
    counts = [F.count_if(F.col("value") < F.col(c)).alias(f"lo_{c}") for c in fractions] + [F.count_if(F.col("value") <= F.col(c)).alias(f"hi_{c}") for c in fractions]
    p = p.select(F.col("genotype").alias("_g"), F.col("coverage").alias("_c"), *fractions)
    g = v.join(p, F.col("genotype").eqNullSafe(F.col("_g")) & (F.col("coverage") == F.col("_c"))).groupBy("genotype", "coverage").agg(F.count("*").alias("n_values"), *counts)
    e = percentiles.rank_error()
    ok = F.lit(True)
    for c, q in fractions.items():  # the ranks of a value are those of all its ties
        ok = ok & (F.col(f"lo_{c}") <= (q + e) * F.col("n_values")) & (F.col(f"hi_{c}") >= (q - e) * F.col("n_values"))
    return g.select("genotype", "coverage", "n_values", ok.alias("within_bound"))


FIELDS = ["read", "sequence"]


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    reads = _table(spark, sf, "alignments").where("seq is not null and seq <> '*'").select(F.lit(0).alias("field"), F.col("read_id").alias("id"), F.upper("seq").alias("seq"))
    seqs = _table(spark, sf, "hash_seqs").where("hash_sequence is not null").select(F.lit(1).alias("field"), F.col("seq_id").alias("id"), F.upper("hash_sequence").alias("seq"))
    return reads.unionByName(seqs)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("field_name", F.element_at(F.array(*[F.lit(x) for x in FIELDS]), F.col("field") + 1))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of reads and of unique sequences sharing half of their 11-letter pieces."""
    return _named(nearcopies.similar_ids(_sequences(spark, sf))).select("field_name", "id_low", "id_high")


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per read and unique sequence with its class and number of links."""
    return _named(nearcopies.classes(_sequences(spark, sf))).select("field_name", "id", "class_id", "n_links")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents holding 12 or more consecutive words of a test item."""
    return leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which test items leaked, into how many documents."""
    found = p7_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return _table(spark, sf, "eval_items").select("item_id", "suite").join(found, "item_id").select("item_id", "suite", "n_docs")


def p7_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Every leak with the words of the item's question that the document holds too."""
    return leakage.question_overlap(p7_found(spark, sf), _table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def _mix(spark: SparkSession, sf: str):
    return mixing.mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"), weight="sqrt(size)")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return _mix(spark, sf)[1].where("not reachable").select("source_name")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of every source, in tokens."""
    return _mix(spark, sf)[1].select("source_name", "target_share", "max_repeats", "n_records", "available", "used", F.round("actual_share", 6).alias("actual_share"), "reachable")


def p8_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every source keeps its cap of repeats and comes within a record of the size wanted and possible."""
    rows, report = _mix(spark, sf)
    most = rows.groupBy("_id", "source_name").agg(F.sum("copies").alias("c"), F.max("size").alias("size")).groupBy("source_name").agg(F.max("c").alias("c"), F.max("size").alias("size"))
    j = report.join(most, "source_name", "left").na.fill({"c": 0, "size": 0})
    goal = F.least(F.col("wanted"), F.coalesce("max_repeats", F.lit(1)) * F.col("available"))
    return j.select("source_name", (F.col("c") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("used") - goal) <= F.col("size") / 2 + 1).alias("on_target"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture itself: documents with their number of copies."""
    rows = _mix(spark, sf)[0].groupBy("_id", "source_name").agg(F.max("size").alias("tokens"), F.sum("copies").alias("copies"))
    return rows.withColumnRenamed("_id", "doc_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text stops before its end."""
    return truncation.truncated(_table(spark, sf, "documents")).where("cause is not null").select(F.col("_id").alias("doc_id")).distinct()


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts its texts, and at which limits."""
    return truncation.rates(truncation.truncated(_table(spark, sf, "documents")))


QUERIES = {
    "p2_found": p2_found, "p2_clusters": p2_clusters,
    "p3_found": p3_found, "p3_percentiles": p3_percentiles, "p3_errors": p3_errors,
    "p4_found": p4_found, "p4_classes": p4_classes,
    "p7_found": p7_found, "p7_items": p7_items, "p7_overlap": p7_overlap,
    "p8_found": p8_found, "p8_shares": p8_shares, "p8_mix": p8_mix, "p8_limits": p8_limits,
    "p9_found": p9_found, "p9_rates": p9_rates,
}

_P4 = """
with r as (select distinct 'read' f, read_id id, upper(seq) s from alignments where seq is not null and seq <> '*' and read_id is not null
union select distinct 'sequence', seq_id, upper(hash_sequence) from hash_seqs where hash_sequence is not null and seq_id is not null),
u as (select f, s, row_number() over () u from (select distinct f, s from r where length(s) >= 11)),
t as (select distinct f, u, s[k:k + 10] t from (select f, u, s, unnest(range(1, length(s) - 9)) k from u)),
n as (select u, count(*) n from t group by 1),
c as (select a.u a, b.u b, count(*) c from t a join t b on a.t = b.t and a.f = b.f and a.u < b.u group by 1, 2),
p as (select a, b from c join n x on x.u = a join n y on y.u = b where c >= 0.5 * (x.n + y.n - c)),
m as (select u, r.f, id from r join u on r.f = u.f and r.s = u.s),
o as (select x.f, x.id i, y.id j from p join m x on x.u = a join m y on y.u = b union select x.f, x.id, y.id from m x join m y on x.u = y.u)
"""
_P9 = r"""
with t as (select doc_id, source, text, regexp_replace(text, '\s+$', '') u from documents),
l as (select *, string_split(u, chr(10))[-1] z from t where length(u) > 0),
m as (select doc_id, coalesce(regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g'), '') source, length(text) chars, octet_length(encode(text)) bytes, (
  (regexp_matches(u, '[.?!]["''”’»)\]}]*$') and not regexp_matches(u, '(\.\s?\.\s?\.|…)["''”’»)\]}.]*$')
     and not (regexp_matches(z, '^(finished in|exit (status|code))\b') and not regexp_matches(z, '^(exit (status|code) -?\d+|finished in \d+(\.\d+)? (ms|s|m|h|min))$')))
  or regexp_matches(z, '^(-- \S.*|\|.*\||(Keywords|Files): *\S.*|exit (status|code) -?\d+|finished in \d+(\.\d+)? (ms|s|m|h|min))$')
  or (regexp_matches(z, '^[ \t]*```$') and len(string_split_regex(u, '(?m)^[ \t]*```')) % 2 = 1)) closed from l)
"""
_P7 = """
with i as (select item_id, suite, string_split_regex(trim(regexp_replace(lower(item_text), '[^a-z0-9]+', ' ', 'g')), ' ') w from eval_items),
r as (select distinct item_id, suite, array_to_string(w[k:k + 11], ' ') g from (select item_id, suite, w, unnest(range(1, greatest(len(w) - 10, 1))) k from i)),
d as (select doc_id, string_split_regex(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') w from documents),
x as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 10, 1))) k from d)),
f as (select distinct doc_id, item_id, suite from x join r using (g))
"""
_P2 = """
with s as (select obs_id, list_transform(dmat, lambda x: coalesce(x, -1)) d from kmodes_obs),
t as (select a.obs_id, min(b.obs_id) f from s a join s b on b.obs_id < a.obs_id and list_sum(list_transform(list_zip(a.d, b.d), lambda p: (p[1] >= 0 and p[2] >= 0 and p[1] <> p[2])::int)) <= 10 group by 1)
"""
ORACLE = {
    # clusters are cliques in this data, so the least similar observation names them
    "p2_found": _P2 + "select f first_obs_id, obs_id from t",
    # density: others that agree in a wholly known fifth of the sites, over the five fifths
    "p2_clusters": _P2 + """, w as (select obs_id, k, d[16 * k + 1:16 * k + 16] v from s, range(5) r(k)),
c as (select obs_id, k, v, count(*) over (partition by k, v) - 1 n from w),
y as (select obs_id, sum(case when list_contains(v, -1) then 0 else n end) density from c group by 1),
m as (select y.obs_id, density, coalesce(f, y.obs_id) f from y left join t on y.obs_id = t.obs_id),
o as (select *, row_number() over (partition by f order by density desc, obs_id) r from m)
select f first_obs_id, count(*) n_obs, list(obs_id order by r) filter (r <= 3) typical from o group by 1""",
    "p4_found": _P4 + "select distinct f field_name, least(i, j) id_low, greatest(i, j) id_high from o where i <> j",
    # links of every id: the different sequences similar to its own; classes: the components
    "p4_classes": _P4.replace("with r as", "with recursive r as", 1) + """, l as (select u, count(*) n from (select a u from p union all select b from p) group by 1),
e as (select distinct x.f, x.id a, y.id b from (select a, b from p union all select b, a from p) z join m x on x.u = z.a join m y on y.u = z.b union select x.f, x.id, y.id from m x join m y on x.u = y.u),
w(f, a, b) as (select f, a, b from e union select w.f, w.a, e.b from w join e on w.f = e.f and w.b = e.a),
k as (select f, a id, min(b) class_id from w group by 1, 2)
select k.f field_name, k.id, k.class_id, (select coalesce(sum(l.n), 0) from m left join l using (u) where m.f = k.f and m.id = k.id)::bigint n_links from k""",
    "p7_found": _P7 + "select doc_id, item_id from f",
    "p7_items": _P7 + "select item_id, suite, count(*) n_docs from f group by 1, 2",
    "p7_overlap": _P7 + """, q as (select item_id, list_filter(list_distinct(string_split_regex(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda x: x <> '') q from eval_items)
select f.doc_id, f.item_id, len(q)::int question_words, len(list_intersect(q, d.w))::int question_shared from f join q using (item_id) join d using (doc_id)""",
    # any measure of size gives the same sources; here characters stand for tokens
    "p8_found": r"""
with t as (select min(source_name) source_name, regexp_replace(lower(trim(source_name)), '[ _-]+', '_', 'g') s, sum(target_share) share, min(max_repeats) m from mix_targets group by 2),
d as (select regexp_replace(lower(trim(source)), '[ _-]+', '_', 'g') s, sum(length(text)) n from documents group by 1),
j as (select t.*, coalesce(n, 0) n from t left join d using (s))
select source_name from j where m * n < share * (select sum(n) from j)""",
    # the sample depends on hashes and a tokenizer; what it must keep is known
    "p8_limits": "select source_name, true within_cap, true on_target from mix_targets",
    # an approximate percentile must meet its bound
    "p3_errors": """
with v as (select genotype, cova, covb from gatk_info qualify row_number() over (partition by info_id order by loaded_at desc) = 1),
s as (select genotype, 'cova' coverage, cova v from v where cova >= 0 union all select genotype, 'covb', covb from v where covb >= 0)
select genotype, coverage, count(*) n_values, true within_bound from s group by 1, 2""",
    "p3_found": """
with v as (select genotype, cova, covb from gatk_info qualify row_number() over (partition by info_id order by loaded_at desc) = 1),
s as (select genotype, 'cova' coverage, cova v from v where cova >= 0 union all select genotype, 'covb', covb from v where covb >= 0)
select genotype, coverage from s group by 1, 2 having quantile_disc(v, 0.9) > 4 * quantile_disc(v, 0.5)""",
    "p9_found": _P9 + "select distinct doc_id from m where not closed",
    "p9_rates": _P9 + """, h as (select source, 'chars' k, chars l, count(*) n from m group by 1, 2, 3 union all select source, 'bytes', bytes, count(*) from m group by 1, 2, 3),
g as (select *, length(bin(l)) o from h),
e as (select a.source, a.k, a.l, a.n, sum(b.n) - a.n tn, count(*) - 1 tk from g a join g b on a.source = b.source and a.k = b.k and abs(a.o - b.o) <= 1 where a.n >= 5 group by 1, 2, 3, 4),
s as (select source, k, l from e where n >= 8 * case when tk > 0 then tn / tk else 0 end),
d as (select m.*, exists (select 1 from s where s.source = m.source and ((k = 'chars' and l = chars) or (k = 'bytes' and l = bytes))) hit from m),
q as (select source, coalesce(string_agg(l::varchar, ',' order by l) filter (k = 'chars'), '') lc, coalesce(string_agg(l::varchar, ',' order by l) filter (k = 'bytes'), '') lb from s group by 1)
select d.source, 'text' field, count(*) n_docs, count(*) filter (not closed) n_cut, count(*) filter (not closed and hit) n_field_limit, round(count(*) filter (not closed) / count(*), 6) cut_share, coalesce(any_value(lc), '') limits_chars, coalesce(any_value(lb), '') limits_bytes from d left join q using (source) group by 1""",
}

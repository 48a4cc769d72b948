"""Test scaffolding: genomic-shaped rows derived from the driver's tables.

Each adapter is one SQL text that Spark and DuckDB read alike, so a query and
its SQL start from the same rows.  Nothing here belongs to the engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PILEUP = """
select l_partkey as site, l_orderkey * 8 + l_linenumber as read_no,
  substr('ACTG', cast(1 + (case when (l_suppkey + l_linenumber) % 5 = 0 then l_partkey + 1 when (l_suppkey + l_linenumber) % 17 = 3 then l_partkey + 2 else l_partkey end) % 4 as int), 1) as base,
  cast(20 + cast(l_quantity as bigint) % 21 as int) as q,
  cast(-3 * l_linenumber as double) as ll_a, cast(-2 * (l_suppkey % 5) as double) as ll_b,
  substr('ACTG', cast(1 + l_partkey % 4 as int), 1) as ref_a,
  substr('ACTG', cast(1 + (l_partkey + case when l_partkey % 3 = 0 then 1 else 0 end) % 4 as int), 1) as ref_b
from lineitem
"""

# individuals x sites: nine posteriors from whole-number weights
_W = ", ".join(f"cast(1 + (o_orderkey * {7 * a + 3 * b + 1} + o_custkey * {a + 2 * b + 1}) % 97 as double) as w_{a}{b}" for a in range(3) for b in range(3))
_SUM = " + ".join(f"w_{a}{b}" for a in range(3) for b in range(3))
_PP = ", ".join(f"w_{a}{b} / ({_SUM}) as pp_{a}{b}" for a in range(3) for b in range(3))
_PA = ", ".join(f"(w_{i}0 + w_{i}1 + w_{i}2) / ({_SUM}) as pa_{i}" for i in range(3))
_PB = ", ".join(f"(w_0{i} + w_1{i} + w_2{i}) / ({_SUM}) as pb_{i}" for i in range(3))
INFO = f"""
select concat('ind', cast(o_orderkey % 5 as string)) as genotype, 'chrA' as chrom_a, 'chrB' as chrom_b,
  o_custkey as position_a, o_custkey as position_b, major, minor,
  case when k = 0 then concat(major, major, '/', major, major) when k = 1 then concat(major, minor, '/', major, major)
       when k = 2 then concat(major, major, '/', minor, minor) else concat(minor, minor, '/', major, minor) end as genotype_call,
  {_PP}, {_PA}, {_PB}, cov_a, cov_b
from (select o_orderkey, o_custkey, o_orderkey % 4 as k, {_W},
  substr('ACTG', cast(1 + o_custkey % 4 as int), 1) as major, substr('ACTG', cast(1 + (o_custkey + 1) % 4 as int), 1) as minor,
  cast(5 + o_orderkey % 20 as double) as cov_a, cast(3 + o_orderkey % 23 as double) as cov_b from orders) x
"""


def spark_sql(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run an adapter text on the parquet tables it names."""
    names = {t for t in re.findall(r"\b(?:from|join)\s+([a-z_]+)", sql)} & {"lineitem", "orders", "events", "documents", "embeddings", "part", "customer", "alignments", "hash_seqs", "kmodes_obs", "gatk_info"}
    for n in names:
        sql = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names})


def duck(sql: str) -> str:
    """The adapter text for DuckDB."""
    return sql.replace("as string", "as varchar")

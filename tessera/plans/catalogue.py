"""All core queries and their SQL."""

from tessera.plans import cohort_queries, dataset_queries, genotype_queries, operator_queries, read_queries, source_queries

_ALL = (dataset_queries, genotype_queries, read_queries, cohort_queries, source_queries, operator_queries)
QUERIES = {name: f for m in _ALL for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _ALL for name, sql in m.ORACLE.items()}

"""Differences between two copies of a dataset.

Both sides are tagged, united and grouped once by key.  Each group keeps one
struct per side (its newest version), and generated higher-order SQL turns the
list of compared fields into one finding per difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def diff_copies(
    main: DataFrame,
    copy: DataFrame,
    keys: list[str],
    fields: list[str],
    version: str | None = None,
    normalise: dict[str, str] | None = None,
    with_values: bool = False,
) -> DataFrame:
    """Rows ``keys + finding`` for every difference between two copies.

    ``finding`` is ``missing_in_copy``, ``missing_in_main`` or the name of a
    field whose values differ.  ``normalise`` maps a field to a SQL expression
    applied on both sides before comparing.  ``version`` names the column whose
    greatest value marks a key's valid row; without it, and for equal versions,
    the row with the greatest field values is taken.  ``with_values`` adds
    ``main_value`` and ``copy_value`` as strings.

    Defined cases: null equals only null; a null key is a key of its own;
    repeated rows collapse; an empty side makes every key of the other side
    missing; columns other than the named ones are never read, so clashing
    extra columns are harmless.  A hot key is reduced by partial aggregation
    before the only shuffle.
    """
    normalise = normalise or {}

    def tagged(df: DataFrame, side: bool) -> DataFrame:
        # internal names cannot clash with user columns: they are positional
        order = F.col(f"`{version}`") if version else F.lit(None).cast("int")
        vals = [F.expr(normalise[f]) if f in normalise else F.col(f"`{f}`") for f in fields]
        return df.select(
            *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)],
            F.lit(side).alias("_main"),
            F.struct(order.alias("o"), *[v.alias(f"f{i}") for i, v in enumerate(vals)]).alias("_v"),
        )

    both = tagged(main, True).unionByName(tagged(copy, False))
    ks = [f"_k{i}" for i in range(len(keys))]
    grouped = both.groupBy(*ks).agg(
        F.max(F.when(F.col("_main"), F.col("_v"))).alias("_m"),
        F.max(F.when(~F.col("_main"), F.col("_v"))).alias("_c"),
    )

    def text(c: str) -> str:
        return f"cast({c} as string)"

    entries = ", ".join(
        f"named_struct('finding', '{f}', 'differs', not (_m.f{i} <=> _c.f{i}), "
        f"'main_value', {text(f'_m.f{i}')}, 'copy_value', {text(f'_c.f{i}')})"
        for i, f in enumerate(fields)
    )
    null_text = "cast(null as string)"

    def missing(side: str) -> str:
        return f"array(named_struct('finding', 'missing_in_{side}', 'differs', true, 'main_value', {null_text}, 'copy_value', {null_text}))"

    findings: Column = F.expr(
        f"case when _c is null then {missing('copy')} when _m is null then {missing('main')} "
        f"else filter(array({entries}), x -> x.differs) end"
    )
    out = grouped.select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], F.explode(findings).alias("_x"))
    cols = [F.col(f"`{k}`") for k in keys] + [F.col("_x.finding").alias("finding")]
    if with_values:
        cols += [F.col("_x.main_value").alias("main_value"), F.col("_x.copy_value").alias("copy_value")]
    return out.select(*cols)

"""Sketches as stored columns: one row a period, merged over any range of periods without the rows they were made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Base-2 logarithm of an HLL sketch's registers, a KLL sketch's k, and base-2 logarithm of a theta sketch's entries.
HLL_BITS, KLL_K, THETA_BITS = 12, 400, 12


def per_period(rows: DataFrame, by: Sequence[str], member: str, value: str, kind: str, kinds: tuple[str, str]) -> DataFrame:
    """(by, members, quantiles, one, other): of each period sketches of the distinct ``member``, of ``value``, and of the
    members with a row of the first and of the second of ``kinds``. Sizes are fixed; nulls are left out."""
    first, second = (F.when(F.col(kind) == k, F.col(member)) for k in kinds)
    return rows.groupBy(*by).agg(
        F.hll_sketch_agg(member, HLL_BITS).alias("members"), F.kll_sketch_agg_double(value, KLL_K).alias("quantiles"),
        F.theta_sketch_agg(first, THETA_BITS).alias("one"), F.theta_sketch_agg(second, THETA_BITS).alias("other"),
    )


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, about_users, median, about_both): estimates from the sketches of several periods put together."""
    whole = sketches.groupBy(*by).agg(
        F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.theta_union_agg("one").alias("one"), F.theta_union_agg("other").alias("other"),
    )
    both = F.theta_sketch_estimate(F.theta_intersection("one", "other"))
    return whole.select(*by, F.hll_sketch_estimate("members").alias("about_users"), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)).alias("median"), both.alias("about_both"))

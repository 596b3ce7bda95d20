"""Profiles that add up: quantile and distinct-value sketches stored by group and merged for any range.

A stored row has the rows, the least and greatest value, a KLL quantile sketch and an HLL sketch of one group, such as an asset and a
day. Merging rows gives the profile of their union without the data. Bounds: a quantile's rank errs by less than ``RANK_ERROR`` of
the rows (99 of 100 times, for k = 200), a number of distinct values by ``DISTINCT_ERROR`` (three standard errors of 2**12 registers).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, REGISTERS = 200, 12
RANK_ERROR, DISTINCT_ERROR = 0.0165, 0.05


def sketched(df: DataFrame, value: str, key: str, by: list[str]) -> DataFrame:
    """One row of sketches a group: AGG5, AGG6, AGG14 and AGG20 read such rows for any set of groups."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("_x").alias("least"), F.max("_x").alias("most"), F.kll_sketch_agg_double("_x", F.lit(K)).alias("quantiles"), F.hll_sketch_agg(key, F.lit(REGISTERS)).alias("distinct_keys")
    )


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """Stored rows added up to fewer groups."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("quantiles", F.lit(K)).alias("quantiles"), F.hll_union_agg("distinct_keys").alias("distinct_keys")
    )


def profile(sketches: DataFrame, shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """The estimates that sketches hold: p5, p50, p95 and n_keys."""
    out = sketches.withColumns({f"p{s * 100:g}".replace(".", "_"): F.kll_sketch_get_quantile_double("quantiles", F.lit(float(s))) for s in shares})
    return out.withColumn("n_keys", F.hll_sketch_estimate("distinct_keys")).drop("quantiles", "distinct_keys")


def within_bounds(estimates: DataFrame, df: DataFrame, value: str, key: str, by: list[str], shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """by, n, least, most and whether each estimate lies within its bound of the exact rank or number, counted on the data."""
    names = [f"p{s * 100:g}".replace(".", "_") for s in shares]
    e = estimates.select(*[F.col(b).alias(f"_{b}") for b in by], *[F.col(n).alias(f"_{n}") for n in names], F.col("n_keys").alias("_keys"))
    on = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    rows = df.where(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double")).join(e, on)
    below = [F.count_if(F.col("_x") < F.col(f"_{n}")).alias(f"_below_{n}") for n in names] + [F.count_if(F.col("_x") <= F.col(f"_{n}")).alias(f"_upto_{n}") for n in names]
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_x").alias("least"), F.max("_x").alias("most"), F.count_distinct(key).alias("_exact"), F.max("_keys").alias("_keys"), *below)
    # A rank of a group of n rows is given to the row, so one row is allowed beside the bound.
    slack = F.lit(RANK_ERROR) * F.col("n") + 1
    right = {n: (F.col(f"_below_{n}") <= s * F.col("n") + slack) & (F.col(f"_upto_{n}") >= s * F.col("n") - slack) for n, s in zip(names, shares, strict=True)}
    right["n_keys"] = F.abs(F.col("_keys") - F.col("_exact")) <= F.lit(DISTINCT_ERROR) * F.col("_exact") + 1
    return found.select(*by, "n", "least", "most", *[c.alias(f"{n}_within") for n, c in right.items()])

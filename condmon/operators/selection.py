"""Exact percentiles without a group in one task.

A mergeable sketch brackets each wanted rank; then the rows below the bracket are counted and only those inside are counted by
value. The sketch errs by one rank in ``ACCURACY`` at most, and brackets are twice as wide, so of n rows of a group some
4 n / ``ACCURACY`` meet behind the shuffle, as one row for each distinct value; groups of up to ``SMALL`` rows are one bracket. A rank
that lies outside its bracket is an error, never a wrong value.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import Steps
from .windows import matches

ACCURACY = 10_000
SMALL = 4 * ACCURACY


def percentiles_of(df: DataFrame, value: str, by: list[str], shares: tuple[float, ...], also: dict[str, Column] | None = None, steps: Steps | None = None, discrete: bool = False) -> DataFrame:
    """by, n (values), p (array of the interpolated percentiles, in the order of ``shares``) and the aggregates ``also`` of each group.

    With ``discrete`` a percentile is a value of the group instead: the least that is not below the share of all values.
    Null values count in nothing but ``also``; groups without a value have n 0 and nulls. ``df`` is read twice, so it should be a written step.
    With ``steps`` the brackets, a row for each group, are written too; Spark then knows their size and broadcasts them where they are small.
    """
    wide = 2 / ACCURACY
    lows = [max(s - wide, 0.0) for s in shares]
    highs = [min(s + wide, 1.0) for s in shares]
    brackets = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.percentile_approx(value, [*lows, *highs], ACCURACY).alias("_ends"), F.min(value).alias("_least"), F.max(value).alias("_most"), *[a.alias(n) for n, a in (also or {}).items()]
    )
    # The ends of the whole range are not left to the sketch; small groups take it, as a rank is more than the sketch's share of them.
    whole = F.col("n") <= SMALL
    low = lambda k: F.when(whole | F.lit(lows[k] == 0), F.col("_least")).otherwise(F.get("_ends", F.lit(k)))
    high = lambda k: F.when(whole | F.lit(highs[k] == 1), F.col("_most")).otherwise(F.get("_ends", F.lit(k + len(shares))))
    nth = lambda s: F.greatest(F.ceil(F.col("n").cast("decimal(20,0)") * F.lit(Decimal(str(s)))).cast("long"), F.lit(1)) - 1
    place = lambda s: nth(s).cast("double") if discrete else (F.col("n") - 1) * F.lit(float(s))
    rank = lambda s, f: f(place(s)).cast("long")
    wanted = [
        F.struct(F.lit(k).alias("k"), F.when(whole, -1).otherwise(k).alias("b"), low(k).alias("low"), high(k).alias("high"), rank(s, F.floor).alias("first"), rank(s, F.ceil).alias("second"), place(s).alias("place"))
        for k, s in enumerate(shares)
    ]
    brackets = brackets.withColumn("_wanted", F.array(*wanted)).drop("_ends", "_least", "_most")
    brackets = steps.keep(brackets, "brackets") if steps else brackets
    groups = brackets.select(*[F.col(b).alias(f"_by_{b}") for b in by], "_wanted")
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    met = rows.join(groups, matches(by)) if by else rows.crossJoin(F.broadcast(groups))
    # A row below a bracket is counted without its value, one inside with it.
    # The ranks of a small group share one bracket, -1.
    near = F.transform(F.filter("_wanted", lambda w: (F.col("_x") <= w["high"]) & ((w["b"] >= 0) | (w["k"] == 0))), lambda w: F.struct(w["b"].alias("b"), F.when(F.col("_x") >= w["low"], F.col("_x")).alias("v")))
    counted = met.select(*by, F.inline(near)).groupBy(*by, "b", "v").agg(F.count("*").alias("c"))
    up_to = Window.partitionBy(*by, "b").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("c").over(up_to))
    # Few rows hold a wanted rank; those are given once for each.
    placed = ranked.withColumn("from", F.col("upto") - F.col("c"))
    placed = placed.join(groups, matches(by)) if by else placed.crossJoin(F.broadcast(groups))
    holds = lambda r: (F.col("from") <= r) & (r < F.col("upto"))
    hits = F.filter("_wanted", lambda w: (w["b"] == F.col("b")) & (holds(w["first"]) | holds(w["second"])))
    hits = F.transform(hits, lambda w: F.struct(w["k"].alias("k"), F.when(holds(w["first"]), F.col("v")).alias("below"), F.when(holds(w["second"]), F.col("v")).alias("above"), w["place"].alias("place")))
    found = placed.select(*by, F.inline(hits)).groupBy(*by, "k").agg(F.max("below").alias("below"), F.max("above").alias("above"), F.first("place").alias("place"))
    missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    exact = F.when(F.col("below").isNull() | F.col("above").isNull(), missed).otherwise(F.col("below") + (F.col("above") - F.col("below")) * (F.col("place") - F.floor("place")))
    listed = found.withColumn("x", exact).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("p"))
    listed = listed.select(*[F.col(b).alias(f"_by_{b}") for b in by], "p")
    out = brackets.drop("_wanted")
    out = out.join(listed, matches(by), "left") if by else out.crossJoin(F.broadcast(listed))
    return out.withColumn("p", F.coalesce("p", F.array(*[F.lit(None).cast("double")] * len(shares)))).drop(*[f"_by_{b}" for b in by])


def spreads_of(df: DataFrame, values: dict[str, str], by: list[str], shares: tuple[float, ...], steps: Steps | None = None) -> DataFrame:
    """by, n (rows) and for each of ``values`` (name to whole-numbered column) the array of its discrete percentiles under its name; without ``by`` one row.

    Null values count in n only. ``df`` is read twice.
    """
    each = df.select(*by, F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), F.col(c).cast("long").alias("_value")) for name, c in values.items()])))
    found = percentiles_of(each, "_value", [*by, "_name"], shares, {"_rows": F.count("*")}, steps, discrete=True)
    own = {name: F.max(F.when(F.col("_name") == name, F.col("p").cast("array<long>"))).alias(name) for name in values}
    return found.groupBy(*by).agg(F.coalesce(F.max("_rows"), F.lit(0)).cast("long").alias("n"), *own.values())


def named(df: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """The array ``p`` as columns p5, p50, p97_5."""
    return df.withColumns({f"p{s * 100:g}".replace(".", "_"): F.get("p", F.lit(k)) for k, s in enumerate(shares)}).drop("p")

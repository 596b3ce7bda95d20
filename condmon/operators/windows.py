"""Ordered operators that cut a long series into chunks of time.

A window over one asset's whole series is one task, however long the series. Here a series is cut
into chunks; each chunk is a window of its own, and what crosses chunk borders goes through one
row per chunk. Aggregates at few points (trailing) take one row for each tile that lies wholly inside a point's window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import micros

CHUNK_SECONDS = 30 * 86_400


def chunk_of(ts: str, seconds: int) -> Column:
    return F.floor(micros(F.col(ts)) / (seconds * 1_000_000)).cast("long")


def _tails(df: DataFrame, keys: list[str], value: Column, order: list[str]) -> DataFrame:
    """One row per chunk: its last non-null value."""
    held = df.withColumn("_value", value).where("_value is not null")
    return held.groupBy(*keys, "_chunk").agg(F.max_by("_value", F.struct(*order)).alias("_tail"))


def carry_last(df: DataFrame, keys: list[str], ts: str, order: list[str], value: Column, out: str, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Add the last non-null ``value`` of the row itself and all before it, by key."""
    df = df.withColumn("_chunk", chunk_of(ts, chunk_seconds)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = df.select(*keys, "_chunk").distinct().join(_tails(df, keys, F.col("_value"), order), [*keys, "_chunk"], "left")
    carried = every.select(*keys, "_chunk", F.last("_tail", ignorenulls=True).over(earlier).alias("_carried"))
    joined = local.join(carried, [*keys, "_chunk"], "left").withColumn(out, F.coalesce("_local", "_carried"))
    return joined.drop("_chunk", "_value", "_local", "_carried")


def previous_row(df: DataFrame, keys: list[str], ts: str, order: list[str], columns: list[str], out: str, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Add the row before, by key, as a struct of ``columns``; null on a key's first row."""
    df = df.withColumn("_chunk", chunk_of(ts, chunk_seconds))
    row = F.struct(*columns)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = df.withColumn("_local", F.lag(row).over(inside))
    chain = Window.partitionBy(*keys).orderBy("_chunk")
    tails = _tails(df, keys, row, order)
    before = tails.select(*keys, "_chunk", F.lag("_tail").over(chain).alias("_before"))
    joined = local.join(before, [*keys, "_chunk"], "left").withColumn(out, F.coalesce("_local", "_before"))
    return joined.drop("_chunk", "_local", "_before")


def running(df: DataFrame, keys: list[str], ts: str, order: list[str], totals: dict[str, tuple[str, Column]], before: bool = False, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Add sums or greatest values (``"sum"`` or ``"max"`` of a column) over the row and all before it, by key; with ``before`` without the row itself.

    A chunk's total goes through one row to the chunks behind it. ``df`` is read twice.
    """
    functions = {"sum": F.sum, "max": F.max}
    df = df.withColumn("_chunk", chunk_of(ts, chunk_seconds)).withColumns({f"_v_{n}": c for n, (_, c) in totals.items()})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = df.withColumns({f"_l_{n}": functions[f](f"_v_{n}").over(inside) for n, (f, _) in totals.items()})
    chunks = df.groupBy(*keys, "_chunk").agg(*[functions[f](f"_v_{n}").alias(f"_t_{n}") for n, (f, _) in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*keys, "_chunk", *[functions[f](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (f, _) in totals.items()])
    out = local.join(carried, [*keys, "_chunk"])
    whole = {n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) if f == "sum" else F.greatest(f"_l_{n}", f"_c_{n}") for n, (f, _) in totals.items()}
    return out.withColumns(whole).drop("_chunk", *[f"_{x}_{n}" for n in totals for x in "vltc"])


def numbered(df: DataFrame, keys: list[str], ts: str, order: list[str], out: str, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Add the row's number within its key, from 1, in an order that tells all rows apart: its number in its chunk and the rows of the chunks before."""
    return running(df, keys, ts, order, {out: ("sum", F.lit(1).cast("long"))}, chunk_seconds=chunk_seconds)


def trailing(points: DataFrame, at: str, log: DataFrame, keys: list[str], ts: str, seconds: int, aggregates: dict[str, tuple[str, Column]], tiles: int = 16) -> DataFrame:
    """Aggregates over ``(t - seconds, t]`` of the log at the times ``at`` of some points: keys, ``at``, the aggregates and ``seen`` (a log row at t itself).

    aggregates: name to ``"count"``, ``"min"``, ``"max"`` or ``"mean"`` of a column. The axis is cut into tiles of a ``tiles``-th
    of the window; each tile of the log becomes one row of partial aggregates. A point takes the tiles that lie wholly inside its
    window, and raw rows of the two at its ends only. Points without a row in their window are left out.
    """
    size = -(-seconds * 1_000_000 // tiles)
    functions = {"count": F.count, "min": F.min, "max": F.max, "mean": F.sum}
    columns = {n: c for n, (_, c) in aggregates.items()}
    # A mean is carried as sum and count.
    parts = {n: (f, n) for n, (f, _) in aggregates.items()} | {f"_n_{n}": ("count", n) for n, (f, _) in aggregates.items() if f == "mean"}
    rows = log.where(F.col(ts).isNotNull()).select(*keys, micros(F.col(ts)).alias("_axis"), *[c.alias(n) for n, c in columns.items()]).withColumn("_tile", F.floor(F.col("_axis") / size).cast("long"))
    tile_rows = rows.groupBy(*keys, "_tile").agg(*[functions[f](c).alias(f"_p_{n}") for n, (f, c) in parts.items()])
    times = points.where(F.col(at).isNotNull()).select(*keys, at).distinct().withColumn("_end", micros(F.col(at)))
    first, last = F.floor((F.col("_end") - seconds * 1_000_000 + 1) / size).cast("long"), F.floor(F.col("_end") / size).cast("long")
    times = times.withColumns({"_first": first, "_last": last})
    inner = times.where("_last - _first > 1").select(*keys, at, F.explode(F.expr("sequence(_first + 1, _last - 1)")).alias("_tile")).join(tile_rows, [*keys, "_tile"])
    inner = inner.select(*keys, at, F.lit(False).alias("_hit"), *[f"_p_{n}" for n in parts])
    ends = times.withColumn("_tile", F.explode(F.array_distinct(F.array("_first", "_last")))).join(rows, [*keys, "_tile"])
    ends = ends.where(F.col("_axis").between(F.col("_end") - seconds * 1_000_000 + 1, F.col("_end")))
    single = lambda f, c: F.col(c).isNotNull().cast("long") if f == "count" else F.col(c)
    ends = ends.select(*keys, at, (F.col("_axis") == F.col("_end")).alias("_hit"), *[single(f, c).alias(f"_p_{n}") for n, (f, c) in parts.items()])
    merge = {"count": F.sum, "min": F.min, "max": F.max, "mean": F.sum}
    out = inner.unionByName(ends).groupBy(*keys, at).agg(F.max("_hit").alias("seen"), *[merge[f](f"_p_{n}").alias(f"_p_{n}") for n, (f, _) in parts.items()])
    done = {n: F.try_divide(f"_p_{n}", f"_p__n_{n}") if f == "mean" else F.col(f"_p_{n}") for n, (f, _) in aggregates.items()}
    return out.select(*keys, at, *[c.alias(n) for n, c in done.items()], "seen")


def running_down(points: DataFrame, by: list[str], value: str, totals: list[str], parts: int = 64) -> DataFrame:
    """Sums of ``totals`` over a row and all of its group with a larger ``value``, under the same names; ``value`` is unique in a group.

    Each group's values are cut into ``parts`` ranges; a range is a window of its own, and its total goes through one row to the ranges below.
    ``points`` is read three times.
    """
    shares = [k / parts for k in range(1, parts)]
    cuts = points.groupBy(*by).agg(F.percentile_approx(value, shares, 1000).alias("_cuts")).select(*[F.col(b).alias(f"_by_{b}") for b in by], "_cuts")
    ranged = points.join(cuts, matches(by)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts", *[f"_by_{b}" for b in by])
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({t: F.sum(t).over(inside) for t in totals})
    ranges = ranged.groupBy(*by, "_range").agg(*[F.sum(t).alias(t) for t in totals])
    above = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_range").alias("_by__range"), *[F.coalesce(F.sum(t).over(above), F.lit(0)).alias(f"_c_{t}") for t in totals])
    out = local.join(carried, matches([*by, "_range"]))
    return out.withColumns({t: F.col(t) + F.col(f"_c_{t}") for t in totals}).drop("_range", "_by__range", *[f"_by_{b}" for b in by], *[f"_c_{t}" for t in totals])


def matches(keys: list[str]) -> Column:
    """Null-safe equality of keys and of the columns of the other side, which are named ``_by_`` and the key."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys], F.lit(True))

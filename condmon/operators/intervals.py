"""Range joins as equi-joins on bins whose lengths are powers of two: a point and an interval meet once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import micros

#: An interval takes so many bins at most; one over more bins goes to a level of bins twice as long.
MOST_BINS = 4


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, first: Column, last: Column, bin_seconds: int, condition: Column) -> DataFrame:
    """Inner join of points and intervals [first, last] (columns of ``intervals``) by key, with ``condition`` on top.

    Bins of level k are ``bin_seconds * 2**k`` long. An interval lies in up to ``MOST_BINS`` bins of the lowest level at which that many cover it, so
    the bins of a long one hold hardly more points than itself. A point looks up its bin of each level that some interval uses: where
    none is long, one. The levels in use are one row. Points without a time and intervals without an end meet nothing; ``intervals`` is read twice.
    """
    low, high = (F.floor(micros(x) / (bin_seconds * 1_000_000)).cast("long") for x in (first, last))
    covered = intervals.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    # The least k for which the bins from low to high, MOST_BINS - 1 of them and a started one, suffice.
    level = F.greatest(F.ceil(F.log2((F.col("_high") - F.col("_low")) / (MOST_BINS - 1))), F.lit(0)).cast("int")
    covered = covered.withColumn("_level", F.when(F.col("_high") - F.col("_low") < MOST_BINS, 0).otherwise(level))
    used = covered.agg(F.collect_set("_level").alias("_levels"))
    i = covered.withColumn("_bin", F.explode(F.expr("sequence(shiftright(_low, _level), shiftright(_high, _level))"))).drop("_low", "_high")
    place = F.floor(micros(F.col(ts)) / (bin_seconds * 1_000_000)).cast("long")
    p = points.where(F.col(ts).isNotNull()).withColumn("_place", place).crossJoin(F.broadcast(used))
    p = p.withColumn("_level", F.explode("_levels")).withColumn("_bin", F.expr("shiftright(_place, _level)")).drop("_place", "_levels")
    return p.join(i, [*keys, "_level", "_bin"]).where(condition).drop("_level", "_bin")

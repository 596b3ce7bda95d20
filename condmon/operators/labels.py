"""Event-horizon labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import add_seconds, seconds_between
from .intervals import points_in_intervals

VERSION = "horizon-v1"
STATUSES = ("missing_prediction_boundary", "inside_failure_interval", "positive", "negative", "horizon_censored")


def observation_end(log: DataFrame, asset: str = "asset") -> DataFrame:
    """AGG27: the latest time seen of each asset."""
    return log.groupBy(asset).agg(F.max("ts").alias("label_observation_end"))


def label(cycle_rows: DataFrame, failures: DataFrame, ends: DataFrame, horizon_seconds: int, asset: str = "asset", bin_seconds: int | None = None) -> DataFrame:
    """LAB1, JN4, JN5, TOP4: five statuses, the earliest failure in ``(t, t + H]`` and the seconds to it.

    failures: asset, record_id, source_row, failure_start, failure_end (inclusive). ends: asset, label_observation_end.
    """
    bins = bin_seconds or horizon_seconds
    df = cycle_rows.join(ends, asset, "left").withColumns(
        {
            "horizon_version": F.lit(VERSION),
            "horizon_s": F.lit(horizon_seconds).cast("long"),
            "prediction_ts": F.when(~F.coalesce("right_censored", F.lit(True)), F.col("stop_ts")),
        }
    )
    df = df.withColumn("horizon_end", add_seconds(F.col("prediction_ts"), horizon_seconds))
    points = df.select(asset, "cycle_id", "prediction_ts", "horizon_end", "label_observation_end")
    events = failures.select(asset, "record_id", "source_row", "failure_start", "failure_end")
    within = F.col("prediction_ts").between(F.col("failure_start"), F.col("failure_end"))
    inside = points_in_intervals(points, events, [asset], "prediction_ts", F.col("failure_start"), F.col("failure_end"), bins, within)
    inside = inside.select(asset, "cycle_id").distinct().withColumn("_inside", F.lit(True))
    ahead = (F.col("failure_start") > F.col("prediction_ts")) & (F.col("failure_start") <= F.col("horizon_end")) & (F.col("failure_start") <= F.col("label_observation_end"))
    future = points_in_intervals(points, events, [asset], "prediction_ts", add_seconds(F.col("failure_start"), -horizon_seconds), F.col("failure_start"), bins, ahead)
    first = future.groupBy(asset, "cycle_id").agg(F.min(F.struct("failure_start", "source_row", "record_id", "failure_end")).alias("_next"))
    df = df.join(inside, [asset, "cycle_id"], "left").join(first, [asset, "cycle_id"], "left")
    df = df.withColumn("_next", F.when(F.col("_inside").isNull(), F.col("_next")))
    status = (
        F.when(F.col("prediction_ts").isNull(), "missing_prediction_boundary")
        .when(F.col("_inside"), "inside_failure_interval")
        .when(F.col("_next").isNotNull(), "positive")
        .when(F.col("horizon_end") <= F.col("label_observation_end"), "negative")
        .otherwise("horizon_censored")
    )
    df = df.withColumns(
        {
            "horizon_status": status,
            "failure_within": F.when(status == "positive", True).when(status == "negative", False),
            "matched_record_id": F.col("_next.record_id"),
            "matched_source_row": F.col("_next.source_row").cast("long"),
            "matched_start": F.col("_next.failure_start"),
            "matched_end": F.col("_next.failure_end"),
        }
    )
    return df.withColumn("seconds_to_failure", seconds_between(F.col("prediction_ts"), F.col("matched_start"))).drop("_inside", "_next")

"""Feature snapshots, modelling views, key coverage and chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_if, reasons

SNAPSHOT_V1, SNAPSHOT_V2 = "window-snapshot-v1", "window-context-snapshot-v2"
VIEW_V1, VIEW_V2 = "modelling-view-v1", "modelling-view-v2"
CONTEXT = ("context_version", "context_status", "context_duration_s", "context_previous_cycle_id", "context_previous_duration_s", "context_previous_idle_s")
LABELS = ("horizon_version", "horizon_s", "label_observation_end", "horizon_end", "horizon_status", "failure_within", "matched_record_id", "matched_source_row", "matched_start", "matched_end", "seconds_to_failure")
FEATURES = (
    *("win_status", "win_window_s", "win_window_start", "win_count", "win_first_ts", "win_last_ts", "win_min", "win_mean", "win_max"),
    *("eligibility_version", "eligibility_gap_s", "max_window_gap_s", "eligibility_status", "eligibility_reasons"),
)


def snapshot(features: DataFrame, lineage: dict[str, Column], version: str = SNAPSHOT_V1) -> DataFrame:
    """SNP1: key, prediction time, features and lineage, without any label column."""
    columns = ["asset", "cycle_id", "prediction_ts", *[c for c in FEATURES if c in features.columns]]
    return features.select(F.lit(version).alias("snapshot_version"), *columns, *[v.alias(k) for k, v in lineage.items()])


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """JN8: inner join of two tables whose keys must be the same set; see ``key_coverage`` for the check."""
    return left.join(right, key)


def key_coverage(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """JN9: keys in both tables, only in one of them, and repeated in either; one row, one shuffle."""
    side = lambda df, n: df.select(*key, F.lit(n).alias("side"))
    each = side(left, 0).unionByName(side(right, 1)).groupBy(*key).agg(count_if(F.col("side") == 0).alias("l"), count_if(F.col("side") == 1).alias("r"))
    return each.agg(
        count_if(F.expr("l > 0 and r > 0")).alias("in_both"),
        count_if(F.expr("r = 0")).alias("only_left"),
        count_if(F.expr("l = 0")).alias("only_right"),
        count_if(F.expr("l > 1")).alias("repeated_left"),
        count_if(F.expr("r > 1")).alias("repeated_right"),
    )


def snapshot_v2(v1: DataFrame, context_rows: DataFrame) -> DataFrame:
    """SNP2, SNP3: the v1 snapshot, untouched, with each cycle's context under the v2 version."""
    key = ["asset", "cycle_id"]
    out = one_to_one(v1.drop("snapshot_version"), context_rows.select(*key, *CONTEXT), key)
    return out.withColumn("snapshot_version", F.lit(SNAPSHOT_V2))


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET1: multiset difference both ways, with the side; empty for equal tables."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def digest(df: DataFrame) -> DataFrame:
    """SNP3: one row that two tables share only if they hold the same rows as often (but for 64-bit chance)."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"), F.coalesce(F.bit_xor(h.cast("long")), F.lit(0)).alias("hash_xor"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET2: set difference both ways, with the side."""
    b = b.select(*a.columns)
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def modelling_view(snapshots: DataFrame, labels: DataFrame, lineage: dict[str, Column], with_context: bool = False) -> DataFrame:
    """VIEW1 and, with context, VIEW2: features, labels, row status and ordered exclusion reasons."""
    key = ["asset", "cycle_id"]
    df = one_to_one(snapshots, labels.select(*key, *LABELS), key)
    feature, status = F.col("eligibility_status"), F.col("horizon_status")
    trainable = (feature == "eligible") & status.isin("positive", "negative")
    rules = [
        (feature == "ineligible", "feature_ineligible"),
        (status == "horizon_censored", "horizon_censored"),
        (status == "inside_failure_interval", "inside_failure_interval"),
        (status == "missing_prediction_boundary", "missing_prediction_boundary"),
        (~F.coalesce(status.isin("missing_prediction_boundary", "inside_failure_interval", "positive", "negative", "horizon_censored"), F.lit(False)), "unsupported_horizon_status"),
    ]
    if with_context:
        available = F.coalesce(F.col("context_status") == "available", F.lit(False))
        trainable &= available
        rules.append((~available, "cycle_context_unavailable"))
    return df.withColumns(
        {
            **lineage,
            "view_version": F.lit(VIEW_V2 if with_context else VIEW_V1),
            "row_status": F.when(F.coalesce(trainable, F.lit(False)), "trainable").otherwise("excluded"),
            "exclusion_reasons": reasons(*rules),
        }
    )


def partition(ts: Column, validation_start: str, test_start: str) -> Column:
    """SPL1: train, validation or test by time; a missing time has no partition."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return F.when(ts < at(validation_start), "train").when(ts < at(test_start), "validation").when(ts.isNotNull(), "test")


def split_comparison(view: DataFrame, candidates: list[tuple[str, str, str]]) -> DataFrame:
    """AGG11: rows, labels, times and events of each candidate split's partitions. The candidates are a short given list."""
    rows = view.sparkSession.createDataFrame(candidates, "candidate string, validation_start string, test_start string")
    rows = rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("validation_start", "test_start")})
    each = view.where("row_status = 'trainable'").crossJoin(F.broadcast(rows))
    part = F.when(F.col("prediction_ts") < F.col("validation_start"), "train").when(F.col("prediction_ts") < F.col("test_start"), "validation").otherwise("test")
    return each.groupBy("candidate", part.alias("part")).agg(
        F.count("*").alias("n_rows"),
        count_if(F.col("failure_within")).alias("positives"),
        F.min("prediction_ts").alias("first_ts"),
        F.max("prediction_ts").alias("last_ts"),
        F.count_distinct("matched_record_id").alias("n_events"),
    )

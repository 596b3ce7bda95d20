"""Row invariants as rule lists. All rules of a table are counted in one pass, and violating rows are one DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import add_seconds, content_id, count_if, reasons, seconds_between
from .cycles import VERSION as CYCLE_VERSION
from .intervals import points_in_intervals

Rules = list[tuple[str, Column]]


def violations(df: DataFrame, rules: Rules, table: str) -> DataFrame:
    """AGG22, VAL10-VAL15: a row per rule with its number of violating rows (a null condition violates)."""
    bad = [count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{k}") for k, (_, ok) in enumerate(rules)]
    listed = ", ".join(f"'{name}', r{k}" for k, (name, _) in enumerate(rules))
    wide = df.agg(F.count("*").alias("n_rows"), *bad)
    return wide.selectExpr(f"'{table}' as audited", "n_rows", f"stack({len(rules)}, {listed}) as (rule, violations)")


def violating_rows(df: DataFrame, rules: Rules, key: list[str], most: int | None = None) -> DataFrame:
    """TOP3: keys of violating rows with the rules they break, at most ``most`` of them."""
    out = df.select(*key, reasons(*[(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]).alias("broken")).where(F.size("broken") > 0)
    return out.limit(most) if most else out


def _all_null(*names: str) -> Column:
    return reduce(Column.__and__, [F.col(n).isNull() for n in names])


def _all_set(*names: str) -> Column:
    return reduce(Column.__and__, [F.col(n).isNotNull() for n in names])


def table_rules(df: DataFrame, key: list[str], lineage: list[str], table: str, versions: dict[str, str] | None = None) -> DataFrame:
    """VAL12, VAL16-VAL20: what holds of a whole table: unique keys, one complete lineage tuple, fixed versions. Rows as of ``violations``."""
    keys = df.groupBy(*key).agg(F.count("*").alias("n"), F.lit(1).alias("_")).agg(F.sum("n").alias("n_rows"), count_if(F.col("n") > 1).alias("violations"))
    parts = [keys.select(F.lit(table).alias("audited"), "n_rows", F.lit("unique_key").alias("rule"), "violations")]
    if lineage:
        blank = reduce(Column.__or__, [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in lineage])
        tuples = df.agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*lineage)).alias("n"), count_if(blank).alias("blank"))
        parts.append(tuples.select(F.lit(table), "n_rows", F.lit("one_lineage"), (F.greatest(F.col("n") - 1, F.lit(0)) + F.col("blank")).alias("violations")))
    if versions:
        parts.append(violations(df, [(f"{c}_is_{v}", F.col(c).eqNullSafe(F.lit(v))) for c, v in versions.items()], table))
    return reduce(DataFrame.union, [p.withColumn("n_rows", F.coalesce("n_rows", F.lit(0))) for p in parts])


def same_population(a: DataFrame, b: DataFrame, key: list[str], table: str) -> DataFrame:
    """VAL17: both tables hold the same keys, as often."""
    side = lambda df, n: df.select(*key, F.lit(n).alias("side"))
    each = side(a, 1).unionByName(side(b, -1)).groupBy(*key).agg(F.sum("side").alias("more"))
    return each.agg(F.count("*").alias("n_rows"), count_if(F.col("more") != 0).alias("violations")).select(F.lit(table).alias("audited"), "n_rows", F.lit("same_population").alias("rule"), "violations")


def horizon_evidence(label_rows: DataFrame, failures: DataFrame, horizon_seconds: int, asset: str = "asset") -> DataFrame:
    """JN13: every label with the number and the first start of the failures in ``(t, t + H]``, whatever its status says."""
    points = label_rows.select(asset, "cycle_id", "prediction_ts", "horizon_end")
    inside = (F.col("failure_start") > F.col("prediction_ts")) & (F.col("failure_start") <= F.col("horizon_end"))
    pairs = points_in_intervals(points, failures, [asset], "prediction_ts", add_seconds(F.col("failure_start"), -horizon_seconds), F.col("failure_start"), horizon_seconds, inside)
    found = pairs.groupBy(asset, "cycle_id").agg(F.count("*").alias("n_ahead"), F.min("failure_start").alias("first_start"))
    out = label_rows.select(asset, "cycle_id", "horizon_status").join(found, [asset, "cycle_id"], "left")
    return out.withColumn("n_ahead", F.coalesce("n_ahead", F.lit(0)))


def cycle_rules() -> Rules:
    """VAL10."""
    return [
        ("id_matches_start", F.col("cycle_id") == content_id(CYCLE_VERSION, F.col("start_record_id"))),
        ("known_start_type", F.col("start_type").isin("observed", "left_censored")),
        ("has_start", F.col("start_ts").isNotNull()),
        ("stop_agrees_with_censoring", F.when(F.col("right_censored"), _all_null("stop_ts", "stop_record_id", "duration_s")).otherwise(_all_set("stop_ts", "stop_record_id", "duration_s"))),
        ("duration_matches", F.col("right_censored") | (F.col("duration_s") == seconds_between(F.col("start_ts"), F.col("stop_ts")))),
        ("stop_after_start", F.col("right_censored") | (F.col("stop_ts") > F.col("start_ts"))),
        ("has_observations", F.col("n_observations") > 0),
    ]


def horizon_rules() -> Rules:
    """VAL11: the shape of each of the five statuses."""
    status = F.col("horizon_status")
    matched = ("matched_record_id", "matched_source_row", "matched_start", "matched_end", "seconds_to_failure")
    return [
        ("known_status", status.isin("missing_prediction_boundary", "inside_failure_interval", "positive", "negative", "horizon_censored")),
        ("end_is_prediction_plus_horizon", F.col("prediction_ts").isNull() | (F.col("horizon_end") == F.timestamp_add("SECOND", F.col("horizon_s"), F.col("prediction_ts")))),
        ("missing_has_no_prediction", (status == "missing_prediction_boundary") == F.col("prediction_ts").isNull()),
        ("positive_is_matched", (status != "positive") | (F.col("failure_within") & _all_set(*matched))),
        ("positive_in_horizon", (status != "positive") | ((F.col("matched_start") > F.col("prediction_ts")) & (F.col("matched_start") <= F.col("horizon_end")))),
        ("others_unmatched", (status == "positive") | _all_null(*matched)),
        ("negative_is_observed", (status != "negative") | (~F.col("failure_within") & (F.col("horizon_end") <= F.col("label_observation_end")))),
        ("undecided_has_no_target", status.isin("positive", "negative") | F.col("failure_within").isNull()),
        ("censored_not_observed", (status != "horizon_censored") | (F.col("horizon_end") > F.col("label_observation_end"))),
    ]


def window_rules(prefix: str = "win") -> Rules:
    """VAL12, VAL14: available windows are fully supported, missing ones not at all."""
    c = lambda n: F.col(f"{prefix}_{n}")
    values = [f"{prefix}_{n}" for n in ("first_ts", "last_ts", "min", "mean", "max")]
    available = c("status") == "available"
    return [
        ("known_status", c("status").isin("available", "missing_prediction_boundary", "missing_prediction_observation")),
        ("missing_boundary_has_no_prediction", (c("status") == "missing_prediction_boundary") == F.col("prediction_ts").isNull()),
        ("available_has_values", ~available | ((c("count") > 0) & _all_set(*values))),
        ("missing_has_none", available | ((c("count") == 0) & _all_null(*values))),
        ("ordered_values", ~available | ((c("min") <= c("mean") + 1e-9) & (c("mean") <= c("max") + 1e-9))),
        ("inside_window", ~available | ((c("first_ts") > c("window_start")) & (c("last_ts") <= F.col("prediction_ts")))),
        ("window_start", F.col("prediction_ts").isNull() | (c("window_start") == F.timestamp_add("SECOND", -c("window_s"), F.col("prediction_ts")))),
    ]


def context_rules() -> Rules:
    """VAL15."""
    available = F.col("context_status") == "available"
    return [
        ("known_status", F.col("context_status").isin("missing_prediction_boundary", "left_censored_current_cycle", "incomplete_current_cycle", "missing_previous_cycle", "incomplete_previous_cycle", "invalid_previous_interval", "available")),
        ("available_is_complete", ~available | _all_set("context_duration_s", "context_previous_cycle_id", "context_previous_duration_s", "context_previous_idle_s")),
        ("no_negative_times", F.coalesce(F.least("context_duration_s", "context_previous_duration_s", "context_previous_idle_s") >= 0, F.lit(True))),
    ]


#: VAL13: exclusion reasons by the value that gives them.
LABEL_REASONS = ("horizon_censored", "inside_failure_interval", "missing_prediction_boundary")


def expected_reasons(with_context: bool) -> Column:
    """The exclusion reasons that a view row's own columns ask for, as a set."""
    asked = [F.when(F.col("eligibility_status") == "ineligible", "feature_ineligible"), F.when(F.col("horizon_status").isin(*LABEL_REASONS), F.col("horizon_status"))]
    if with_context:
        asked.append(F.when(~F.col("context_status").eqNullSafe(F.lit("available")), "cycle_context_unavailable"))
    return F.sort_array(F.array_compact(F.array(*asked)))


def view_rules(with_context: bool = True) -> Rules:
    """VAL13: row status and reasons follow from the row's own columns, and label and feature times belong to the same point."""
    trainable, none = F.col("row_status") == "trainable", F.size("exclusion_reasons") == 0
    return [
        ("known_row_status", F.col("row_status").isin("trainable", "excluded")),
        ("reasons_agree", trainable == none),
        ("reasons_recomputed", F.sort_array("exclusion_reasons") == expected_reasons(with_context)),
        ("trainable_has_target", ~trainable | F.col("failure_within").isNotNull()),
        ("trainable_is_eligible", ~trainable | (F.col("eligibility_status") == "eligible")),
        ("window_is_past", F.col("win_last_ts").isNull() | (F.col("win_last_ts") <= F.col("prediction_ts"))),
        ("window_boundary", F.col("prediction_ts").isNull() | (F.col("win_window_start") == F.timestamp_add("SECOND", -F.col("win_window_s"), F.col("prediction_ts")))),
    ]


def score_rules() -> Rules:
    """VAL17."""
    p = F.col("probability")
    return [("has_key", _all_set("asset", "cycle_id", "prediction_ts")), ("probability_in_range", ~F.isnan(p) & p.between(0.0, 1.0))]


def event_rules(horizon_seconds: int, first: str, last: str) -> Rules:
    """VAL16, VAL18: an event and its whole warning window lie inside the period."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return [
        ("ordered_interval", F.col("failure_start") <= F.col("failure_end")),
        ("warning_window_inside", add_seconds(F.col("failure_start"), -horizon_seconds) >= at(first)),
        ("end_inside", F.col("failure_end") < at(last)),
    ]


def policy_input_rules() -> Rules:
    """VAL19."""
    return [
        ("no_negative_lead", F.col("lead_s") >= 0),
        ("no_negative_gap", F.coalesce(F.col("max_internal_gap_s") >= 0, F.lit(True))),
        ("known_label", F.col("horizon_status").isin("missing_prediction_boundary", "inside_failure_interval", "positive", "negative", "horizon_censored")),
    ]

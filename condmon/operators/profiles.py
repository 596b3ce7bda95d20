"""Profiles: distributions, sensitivities, overlaps, drift and worst examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_if
from ..steps import Steps
from .selection import named, percentiles_of, spreads_of


def status_counts(df: DataFrame, column: str, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """AGG17, AGG18, AGG20: rows per status; listed statuses without rows count 0."""
    found = df.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))
    if not statuses:
        return found
    listed = df.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return listed.join(found, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def events_with_counts(events: DataFrame, labelled: DataFrame, asset: str = "asset") -> DataFrame:
    """AGG17: positive rows of every event, events without one included."""
    found = labelled.where("horizon_status = 'positive'").groupBy(asset, F.col("matched_record_id").alias("record_id")).agg(F.count("*").alias("n_positive"), F.min("seconds_to_failure").alias("least_seconds"))
    return events.select(asset, "record_id").join(found, [asset, "record_id"], "left").withColumn("n_positive", F.coalesce("n_positive", F.lit(0)))


def unknown_events(labelled: DataFrame, events: DataFrame, asset: str = "asset") -> DataFrame:
    """Matched events that are not in the event table (left anti, no list on the driver)."""
    known = events.select(asset, F.col("record_id").alias("matched_record_id"))
    return labelled.where("matched_record_id is not null").select(asset, "matched_record_id").distinct().join(known, [asset, "matched_record_id"], "left_anti")


def distribution(df: DataFrame, value: str, by: list[str], shares: tuple[float, ...] = (0.05, 0.5, 0.95), steps: Steps | None = None) -> DataFrame:
    """AGG7, AGG9, AGG10: count, extrema, mean and exact percentiles of each group with a value."""
    also = {"least": F.min(value), "mean": F.avg(value), "most": F.max(value)}
    return named(percentiles_of(df, value, by, shares, also, steps).where("n > 0"), shares)


def monthly_drift(view: DataFrame, value: str, label: str = "failure_within", ts: str = "prediction_ts", steps: Steps | None = None) -> DataFrame:
    """AGG10: distribution by month and label."""
    return distribution(view.withColumn("month", F.date_format(ts, "yyyy-MM")), value, ["month", label], steps=steps)


def support(features: DataFrame, prefix: str = "win", steps: Steps | None = None) -> DataFrame:
    """AGG14: exact spread of observation counts and spans of available windows."""
    out = spreads_of(features, {"_c": f"{prefix}_count", "_s": "span_s"}, [], (0.05, 0.5, 0.95), steps)
    names = {f"{x}_{q}": F.get(f"_{x[0]}", F.lit(k)) for x in ("count", "span") for k, q in enumerate(("p5", "p50", "p95"))}
    return out.withColumns(names).drop("_c", "_s")


def gap_sensitivity(covered: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """AGG15: windows with a gap of at least each threshold, all in one pass."""
    wide = covered.agg(F.count("*").alias("n"), *[count_if(F.col("window_gap_s") >= t).alias(f"t{t}") for t in thresholds])
    pairs = ", ".join(f"{t}, t{t}" for t in thresholds)
    return wide.selectExpr("n", f"stack({len(thresholds)}, {pairs}) as (threshold_s, excluded)").withColumn("threshold_s", F.col("threshold_s").cast("long"))


def tail_bounds(covered: DataFrame, prefix: str = "win", steps: Steps | None = None) -> DataFrame:
    """The exact 5 % points of observation count and span, one row."""
    p = spreads_of(covered, {"_c": f"{prefix}_count", "_s": "span_s"}, [], (0.05,), steps)
    return p.select(F.get("_c", F.lit(0)).alias("low_count"), F.get("_s", F.lit(0)).alias("low_span"))


def tail_overlap(covered: DataFrame, bounds: DataFrame, prefix: str = "win") -> DataFrame:
    """AGG16: windows below the count bound, the span bound, both; and their overlap with internal gaps."""
    low_c, low_s, gap = F.col(f"{prefix}_count") < F.col("low_count"), F.col("span_s") < F.col("low_span"), F.col("internal_gap_count") > 0
    tail = low_c | low_s
    return covered.crossJoin(F.broadcast(bounds)).agg(
        count_if(low_c & low_s).alias("both"),
        count_if(low_c & ~low_s).alias("count_only"),
        count_if(~low_c & low_s).alias("span_only"),
        count_if(~tail).alias("neither"),
        count_if(gap & tail).alias("gap_and_tail"),
        count_if(gap & ~tail).alias("gap_only"),
        count_if(~gap & tail).alias("tail_only"),
        count_if(low_c & ~low_s & gap).alias("count_only_with_gap"),
        F.min(F.when(gap & ~tail, F.col("max_internal_gap_s"))).alias("gap_only_least_s"),
        F.max(F.when(gap & ~tail, F.col("max_internal_gap_s"))).alias("gap_only_most_s"),
    )


def coverage_policies(covered: DataFrame, labels: DataFrame, bounds: DataFrame, policies: list[tuple[str, bool, int | None]], asset: str = "asset", prefix: str = "win") -> DataFrame:
    """AGG13, PROF2: rows kept and dropped by each policy, and kept ones by label.

    A policy (name, use_tail, least_gap_s) drops the tail below the bounds if ``use_tail``, and windows with a gap of ``least_gap_s`` or more if given.
    """
    df = covered.join(labels.select(asset, "cycle_id", "horizon_status"), [asset, "cycle_id"]).crossJoin(F.broadcast(bounds))
    tail = F.coalesce((F.col(f"{prefix}_count") < F.col("low_count")) | (F.col("span_s") < F.col("low_span")), F.lit(False))
    one = lambda name, use_tail, gap: F.struct(F.lit(name).alias("policy"), F.lit(use_tail).alias("use_tail"), F.lit(gap).cast("long").alias("gap"))
    each = df.select("horizon_status", "window_gap_s", tail.alias("tail"), F.inline(F.array(*[one(*p) for p in policies])))
    kept = ~((F.col("use_tail") & F.col("tail")) | F.coalesce(F.col("window_gap_s") >= F.col("gap"), F.lit(False)))
    counts = {"kept": kept, "excluded": ~kept, "kept_positive": kept & (F.col("horizon_status") == "positive"), "kept_negative": kept & (F.col("horizon_status") == "negative")}
    return each.groupBy("policy").agg(*[count_if(c).alias(name) for name, c in counts.items()])


def one_sided(covered: DataFrame, bounds: DataFrame, k: int = 5, asset: str = "asset", prefix: str = "win") -> DataFrame:
    """TOP2, PROF1: windows that one tail test rejects and the other does not, per kind the k that lie furthest on the accepted side.

    ``count_only`` windows go by span downwards, ``span_only`` ones by count downwards, each then by the rejected value upwards and the key.
    """
    low_c, low_s = F.col(f"{prefix}_count") < F.col("low_count"), F.col("span_s") < F.col("low_span")
    kinds = {"count_only": (low_c & ~low_s, "span_s", f"{prefix}_count"), "span_only": (~low_c & low_s, f"{prefix}_count", "span_s")}
    df = covered.crossJoin(F.broadcast(bounds)).withColumn("gap", F.col("internal_gap_count") > 0)
    parts = []
    for kind, (rows, accepted, rejected) in kinds.items():
        top = worst(df, rows, [F.desc(accepted), F.asc(rejected), F.asc(asset), F.asc("cycle_id")], [asset, "cycle_id", f"{prefix}_count", "span_s", "gap"], k)
        parts.append(top.withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)


def gap_tail_disagreement(covered: DataFrame, bounds: DataFrame, k: int = 5, asset: str = "asset", prefix: str = "win") -> DataFrame:
    """TOP2, PROF1: windows that the tail test and the gap test judge unlike: per kind the k first.

    ``tail_only`` ones by count and span upwards; ``gap_only`` ones by their longest gap and their number of gaps downwards, then by count and span.
    A gap before the first reading counts with its whole interval.
    """
    count, key = f"{prefix}_count", ["prediction_ts", asset, "cycle_id"]
    df = covered.crossJoin(F.broadcast(bounds)).withColumns(
        {
            "tail": (F.col(count) < F.col("low_count")) | (F.col("span_s") < F.col("low_span")),
            "gap": F.col("first_follows_gap") | (F.col("internal_gap_count") > 0),
            "longest_gap_s": F.greatest(F.when(F.col("first_follows_gap"), F.coalesce("preceding_interval_s", F.lit(0))).otherwise(0), F.coalesce("max_internal_gap_s", F.lit(0))).cast("long"),
        }
    )
    columns = [*key[1:], count, "span_s", "internal_gap_count", "longest_gap_s"]
    up = [F.asc(c) for c in (count, "span_s", *key)]
    tail_only = worst(df, F.col("tail") & ~F.col("gap"), up, columns, k).withColumn("kind", F.lit("tail_only"))
    gap_only = worst(df, ~F.col("tail") & F.col("gap"), [F.desc("longest_gap_s"), F.desc("internal_gap_count"), *up], columns, k).withColumn("kind", F.lit("gap_only"))
    return tail_only.unionByName(gap_only)


def overlap_rules() -> list[tuple[str, Column]]:
    """PROF1: a ``tail_overlap`` row adds up, given the number of windows ``n``."""
    total = lambda *names: sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return [
        ("tails_add_up", total("both", "count_only", "span_only", "neither") == F.col("n")),
        ("tail_windows_add_up", total("gap_and_tail", "tail_only") == total("both", "count_only", "span_only")),
        ("gap_only_in_the_rest", F.col("gap_only") <= F.col("neither")),
        ("marked_ones_among_count_only", F.col("count_only_with_gap") <= F.col("count_only")),
        ("ordered_gaps", F.coalesce(F.col("gap_only_least_s") <= F.col("gap_only_most_s"), F.col("gap_only") == 0)),
    ]


def worst(df: DataFrame, conditions: Column, order: list[Column], columns: list[str], k: int = 5) -> DataFrame:
    """TOP1, TOP2: the first k rows that fulfil the conditions, in an order that ends in a unique key."""
    return df.where(conditions).orderBy(*order).limit(k).select(*columns)


def confusion(view: DataFrame, value: str, thresholds: list[float], by: str = "part") -> DataFrame:
    """AGG12, BAS5: confusion counts and distinct events hit for every threshold and partition. The thresholds are a short given list."""
    rows = view.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    each = view.crossJoin(F.broadcast(rows)).withColumn("hit", F.col(value) <= F.col("threshold"))
    positive, hit = F.col("failure_within"), F.col("hit")
    out = each.where("hit is not null and failure_within is not null").groupBy("threshold", by).agg(
        count_if(positive & hit).alias("tp"),
        count_if(positive & ~hit).alias("fn"),
        count_if(~positive & hit).alias("fp"),
        count_if(~positive & ~hit).alias("tn"),
        F.count_distinct(F.when(hit, F.col("matched_record_id"))).alias("events_hit"),
    )
    return out.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def context_profile(view: DataFrame, steps: Steps | None = None) -> DataFrame:
    """AGG20: rows per context status with the exact spread of what is known of the cycle, the one before and the time between."""
    names = {"duration": "context_duration_s", "previous": "context_previous_duration_s", "idle": "context_previous_idle_s"}
    out = spreads_of(view, {f"_{n}": c for n, c in names.items()}, ["context_status"], (0.05, 0.5, 0.95), steps)
    return out.withColumns({f"{n}_{q}": F.get(f"_{n}", F.lit(k)) for n in names for k, q in enumerate(("p5", "p50", "p95"))}).drop(*[f"_{n}" for n in names])


def metric_listing(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG23: counts of every value of several columns as one list."""
    each = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("metric"), "value", "n") for c in columns]
    return reduce(DataFrame.unionByName, each)


def view_summary(view: DataFrame) -> DataFrame:
    """AGG19: rows, trainable rows, labels, time range and events of a view, one row."""
    return view.agg(
        F.count("*").alias("n_rows"),
        count_if(F.col("row_status") == "trainable").alias("trainable"),
        count_if(F.col("row_status") == "excluded").alias("excluded"),
        count_if(F.expr("row_status = 'trainable' and failure_within")).alias("positives"),
        F.min("prediction_ts").alias("first_ts"),
        F.max("prediction_ts").alias("last_ts"),
        F.count_distinct("matched_record_id").alias("n_events"),
        F.count_distinct(F.struct("asset", "cycle_id")).alias("n_keys"),
    )

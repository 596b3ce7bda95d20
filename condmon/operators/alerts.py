"""Alert episodes from scores, for all policies at once, and their match with recorded failures.

points: asset, cycle_id, prediction_ts, probability. policies: policy, threshold, persistence,
merge_gap_s, cooldown_s; a short given table. failures: asset, record_id, failure_start, failure_end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import add_seconds, seconds_between
from ..steps import Steps
from .intervals import points_in_intervals
from .models import average_precision, unique_best
from .selection import percentiles_of
from .windows import CHUNK_SECONDS, chunk_of, numbered, running

KEY = ["asset", "policy"]


def policy_grid(points: DataFrame, shares: tuple[float, ...] = (0.9, 0.95, 0.99), persistence: tuple[int, ...] = (1, 2), merge_gap_s: int = 3600, cooldown_s: int = 7200) -> DataFrame:
    """ALR9: thresholds at the scores' percentiles, crossed with the persistence values. ``points`` is read twice."""
    cut = percentiles_of(points, "probability", [], shares).select(F.col("p").alias("t"))
    rows = [(k, f"p{s * 100:g}-n{n}", n) for k, s in enumerate(shares) for n in persistence]
    grid = points.sparkSession.createDataFrame(rows, "k int, policy string, persistence int")
    out = grid.crossJoin(F.broadcast(cut)).select("policy", F.get("t", F.col("k")).alias("threshold"), "persistence")
    return out.withColumns({"merge_gap_s": F.lit(merge_gap_s).cast("long"), "cooldown_s": F.lit(cooldown_s).cast("long")})


def streaks(points: DataFrame, policies: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """ALR1: runs of consecutive points at or above the threshold, with their points counted off.

    A series is cut into chunks of time. A chunk becomes one row: its breaks (points below) and the points behind the last one. Over these
    rows alone go the breaks before each chunk and the length of the run that is still open where it begins. ``points`` is read twice.
    """
    order, part = ["prediction_ts", "cycle_id"], [*KEY, "_chunk"]
    each = points.crossJoin(F.broadcast(policies)).withColumns({"_over": F.col("probability") >= F.col("threshold"), "_chunk": chunk_of("prediction_ts", chunk_seconds)})
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = each.withColumn("_breaks", F.sum((~F.col("_over")).cast("long")).over(inside))
    ends = cut.groupBy(*part, "_breaks").agg(F.count_if("_over").alias("n")).groupBy(*part).agg(F.max(F.struct("_breaks", "n")).alias("end"))
    earlier = Window.partitionBy(*KEY).orderBy("_chunk")
    ends = ends.withColumn("_after", F.sum("end._breaks").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    # Chunks without a break carry on the run of the chunk before, so runs are sums over the chunks of one number of breaks.
    ends = ends.withColumn("_open", F.sum("end.n").over(Window.partitionBy(*KEY, "_after").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)))
    before = ends.select(*KEY, "_chunk", F.lag("_after", 1, 0).over(earlier).alias("_before"), F.lag("_open", 1, 0).over(earlier).alias("_open"))
    rows = cut.where("_over").withColumn("_at", F.row_number().over(Window.partitionBy(*part, "_breaks").orderBy(*order)))
    rows = rows.join(before, part)
    nth = F.col("_at") + F.when(F.col("_breaks") == 0, F.col("_open")).otherwise(0)
    return rows.withColumns({"_nth": nth, "_run": F.col("_before") + F.col("_breaks")}).drop("_at", "_open", "_before", "_breaks", "_chunk")


def drafts(streak_rows: DataFrame) -> DataFrame:
    """ALR2: streaks of at least ``persistence`` points; the trigger is the point that reaches it."""
    point = F.struct("prediction_ts", "cycle_id")
    trigger = F.col("_nth") >= F.col("persistence")
    out = streak_rows.groupBy(*KEY, "_run", "persistence", "merge_gap_s", "cooldown_s").agg(
        F.min(F.when(trigger, point)).alias("start"), F.max(point).alias("end"), F.count("*").alias("support"), F.max("probability").alias("peak")
    )
    out = out.where("support >= persistence")
    return out.withColumns({"alert_points": F.col("support") - F.col("persistence") + 1, "n_streaks": F.lit(1).cast("long")}).drop("_run")


def merged(draft_rows: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """ALR3: drafts whose start is at most the merge gap after the latest end so far become one. ``draft_rows`` is read four times."""
    rows = draft_rows.withColumn("_ts", F.col("start.prediction_ts"))
    rows = running(rows, KEY, "_ts", ["start"], {"_latest": ("max", F.col("end.prediction_ts"))}, True, chunk_seconds)
    fresh = F.coalesce(F.col("_ts") > F.timestamp_add("SECOND", F.col("merge_gap_s"), F.col("_latest")), F.lit(True))
    rows = running(rows.withColumn("_new", fresh.cast("long")), KEY, "_ts", ["start"], {"_group": ("sum", F.col("_new"))}, False, chunk_seconds)
    return rows.groupBy(*KEY, "cooldown_s", "_group").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("support").alias("support"),
        F.sum("alert_points").alias("alert_points"),
        F.sum("n_streaks").alias("n_streaks"),
        F.max("peak").alias("peak"),
    ).drop("_group")


def cooled(merged_rows: DataFrame, steps: Steps, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """ALR4: drop an episode that starts within the cooldown after the last retained end.

    An episode that starts after the cooldown of the one before is retained whatever came before, as ends never decrease; the episodes from one
    such start to the next are a cluster. In a cluster each episode points to the first that starts after its own cooldown, found by
    counting starts. Retained are those that the first one reaches; pointers double, so a cluster of n takes log n joins, and one of one episode none.
    """
    rows = merged_rows.withColumns({"_ts": F.col("start.prediction_ts"), "_until": add_seconds(F.col("end.prediction_ts"), F.col("cooldown_s"))})
    rows = running(rows, KEY, "_ts", ["start"], {"_last": ("max", F.col("_until"))}, True, chunk_seconds)
    first = F.coalesce(F.col("_ts") >= F.col("_last"), F.lit(True))
    rows = steps.keep(rows.withColumn("_first", first.cast("long")).drop("_last"), "merged")
    totals = {"_cluster": ("sum", F.col("_first")), "_at": ("sum", F.lit(1).cast("long"))}
    rows = steps.keep(running(rows, KEY, "_ts", ["start"], totals, False, chunk_seconds), "clusters")
    key = [*KEY, "_cluster"]
    sizes = rows.groupBy(*key).agg(F.min("_at").alias("_begin"), F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    kept = rows.where("_first = 1").select(*key, "_at")
    if most > 1:
        several = rows.join(sizes.where("_n > 1"), key)
        mark = lambda t, start: several.select(*key, "_begin", "_n", "_at", F.col(t).alias("_t"), F.lit(start).cast("long").alias("_start"))
        # At one time the end of a cooldown comes before a start, which it lets through.
        counted = running(mark("_ts", 1).unionByName(mark("_until", 0)), key, "_t", ["_t", "_start", "_at"], {"_starts": ("sum", F.col("_start"))}, False, chunk_seconds)
        jumps = counted.where("_start = 0 and _starts < _n").select(*key, "_at", (F.col("_begin") + F.col("_starts")).alias("_next"))
        jumps, reach = steps.keep(jumps, "jumps"), 1
        while reach < most:
            met = kept.join(jumps, [*key, "_at"]).select(*key, F.col("_next").alias("_at"))
            further = jumps.select(*key, F.col("_at").alias("_next"), F.col("_next").alias("_far"))
            jumps = jumps.join(further, [*key, "_next"]).select(*key, "_at", F.col("_far").alias("_next"))
            kept, reach = kept.unionByName(met), 2 * reach
            if reach % 16 == 0 and reach < most:
                kept, jumps = steps.keep(kept, "reached"), steps.keep(jumps, "jumps")
    out = rows.join(kept, [*key, "_at"], "left_semi").drop("_cluster", "_at", "_first", "_until")
    return numbered(steps.keep(out, "cooled"), KEY, "_ts", ["start"], "episode", chunk_seconds).drop("_ts")


def detected(points: DataFrame, policies: DataFrame, steps: Steps, chunk_seconds: int = CHUNK_SECONDS) -> dict[str, DataFrame]:
    """ALR1-ALR5: the tables ``streaks``, ``drafts``, ``merged`` and ``episodes``, each of the first three written once."""
    runs = steps.keep(streaks(points, policies, chunk_seconds), "streaks")
    ready = steps.keep(drafts(runs), "drafts")
    joined = steps.keep(merged(ready, chunk_seconds), "episodes")
    found = cooled(joined, steps, chunk_seconds).select(
        *KEY, "episode", F.col("start.cycle_id").alias("start_cycle_id"), F.col("start.prediction_ts").alias("start_ts"), F.col("end.cycle_id").alias("end_cycle_id"),
        F.col("end.prediction_ts").alias("end_ts"), "support", "alert_points", "n_streaks", "peak",
    )
    return {"streaks": runs, "drafts": ready, "merged": joined, "episodes": steps.keep(found, "found")}


def episodes(points: DataFrame, policies: DataFrame, steps: Steps | None = None, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """ALR5."""
    return detected(points, policies, steps or Steps(points.sparkSession, "alerts"), chunk_seconds)["episodes"]


def episode_audit(points: DataFrame, policies: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """ALR5's counts: points, qualifying points, streaks, qualified streaks, merged, suppressed and kept episodes of each policy."""
    n = lambda df, name: df.groupBy("policy").agg(F.count("*").alias(name))
    out = policies.select("policy").crossJoin(points.agg(F.count("*").alias("n_points")))
    out = out.join(n(found["streaks"], "qualifying_points"), "policy", "left").join(n(found["streaks"].where("_nth = 1"), "streaks"), "policy", "left")
    out = out.join(n(found["drafts"], "qualified_streaks"), "policy", "left")
    out = out.join(n(found["merged"], "merged_episodes"), "policy", "left").join(n(found["episodes"], "episodes"), "policy", "left").fillna(0)
    return out.withColumn("suppressed", F.col("merged_episodes") - F.col("episodes"))


def classified(episode_rows: DataFrame, failures: DataFrame, horizon_seconds: int) -> DataFrame:
    """ALR6: ``warning`` if the start lies in [start - H, start) of any failure, else ``inside`` if in [start, end] of one, else ``false_alert``."""
    key = [*KEY, "episode"]
    first = add_seconds(F.col("failure_start"), -horizon_seconds)
    near = (F.col("start_ts") >= first) & (F.col("start_ts") <= F.col("failure_end"))
    pairs = points_in_intervals(episode_rows, failures, ["asset"], "start_ts", first, F.col("failure_end"), horizon_seconds, near)
    kinds = pairs.groupBy(*key).agg(F.max(F.col("start_ts") < F.col("failure_start")).alias("_warns"))
    kind = F.when(F.col("_warns"), "warning").when(F.col("_warns").isNotNull(), "inside").otherwise("false_alert")
    return episode_rows.join(kinds, key, "left").withColumn("kind", kind).drop("_warns")


def event_matches(episode_rows: DataFrame, failures: DataFrame, policies: DataFrame, horizon_seconds: int) -> DataFrame:
    """ALR6: per policy and failure the first warning, the lead time and how many episodes warned."""
    first = add_seconds(F.col("failure_start"), -horizon_seconds)
    warns = (F.col("start_ts") >= first) & (F.col("start_ts") < F.col("failure_start"))
    pairs = points_in_intervals(episode_rows, failures, ["asset"], "start_ts", first, F.col("failure_start"), horizon_seconds, warns)
    found = pairs.groupBy(*KEY, "record_id").agg(F.min("start_ts").alias("first_warning_ts"), F.count("*").alias("n_warnings"))
    every = failures.select("asset", "record_id", "failure_start").crossJoin(F.broadcast(policies.select("policy")))
    out = every.join(found, [*KEY, "record_id"], "left")
    return out.withColumns(
        {"detected": F.col("first_warning_ts").isNotNull(), "n_warnings": F.coalesce("n_warnings", F.lit(0)), "lead_s": seconds_between(F.col("first_warning_ts"), F.col("failure_start"))}
    )


def policy_metrics(points: DataFrame, episode_rows: DataFrame, failures: DataFrame, policies: DataFrame, horizon_seconds: int) -> DataFrame:
    """ALR7: detection rate, episodes and false alerts per operating day of each policy."""
    days = points.agg(F.count_distinct(F.struct("asset", F.to_date("prediction_ts"))).alias("operating_days"))
    kinds = classified(episode_rows, failures, horizon_seconds).groupBy("policy").agg(
        F.count("*").alias("episodes"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("warning", "warnings"), ("inside", "insides"), ("false_alert", "false_alerts"))]
    )
    events = event_matches(episode_rows, failures, policies, horizon_seconds).groupBy("policy").agg(F.count("*").alias("events"), F.count_if("detected").alias("detected"))
    out = policies.select("policy").join(events, "policy", "left").join(kinds, "policy", "left").fillna(0).crossJoin(days)
    return out.withColumns(
        {
            "missed": F.col("events") - F.col("detected"),
            "detection_rate": F.try_divide("detected", "events"),
            "episodes_per_day": F.try_divide("episodes", "operating_days"),
            "false_alerts_per_day": F.try_divide("false_alerts", "operating_days"),
        }
    )


def select_policy(metrics: DataFrame) -> DataFrame:
    """ALR8: among the policies with the most detected events the one with the fewest false alerts; no row for a tie."""
    return unique_best(metrics, "struct(detected, -false_alerts)")


def episode_order(episode_rows: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """VAL18: episodes that start before an earlier one of the same asset and policy has ended."""
    rows = running(episode_rows, KEY, "start_ts", ["start_ts", "episode"], {"_latest": ("max", F.col("end_ts"))}, True, chunk_seconds)
    return rows.where("start_ts <= _latest or end_ts < start_ts").drop("_latest")


def most_operating_days(points: DataFrame) -> DataFrame:
    """One row: ``most_days``, the days from the first point to the last times the assets, as ``operating_days`` counts each asset's days; 0 without points."""
    day = F.to_date("prediction_ts")
    return points.agg(F.coalesce(F.count_distinct("asset") * (F.date_diff(F.max(day), F.min(day)) + 1), F.lit(0)).alias("most_days"))


def metric_rules(most_days: int | Column) -> list[tuple[str, Column]]:
    """VAL18: counts of ``policy_metrics`` reconcile, and no more asset days were in operation than ``most_days``; none only where there can be none."""
    most = F.lit(most_days)
    return [
        ("kinds_add_up", F.col("warnings") + F.col("insides") + F.col("false_alerts") == F.col("episodes")),
        ("events_add_up", F.col("detected") + F.col("missed") == F.col("events")),
        ("rate_in_range", F.coalesce(F.col("detection_rate").between(0.0, 1.0), F.col("events") == 0)),
        ("operating_days_in_period", F.col("operating_days").between(F.least(F.lit(1), most), most)),
    ]


def aggregates(scored: DataFrame, metrics: DataFrame, matches: DataFrame, label: str = "failure_within") -> DataFrame:
    """PIPE10: the sixteen aggregates of a scored population under each policy, and nothing of its rows; lead times are the mean of the detected events'."""
    area = average_precision(scored.withColumn("_all", F.lit(1)), ["_all"], "probability", label).drop("_all", "positives")
    population = scored.agg(F.count("*").alias("row_count"), F.count_if(label).alias("positive_count"), F.count_if(~F.col(label)).alias("negative_count")).crossJoin(F.broadcast(area))
    lead = matches.groupBy("policy").agg(F.avg("lead_s").alias("warning_lead_time_s"))
    return metrics.join(lead, "policy", "left").crossJoin(F.broadcast(population))

"""Pipelines from raw files to policy metrics, as compositions of operators and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, audit, cycles, features, labels, models, profiles, quality, snapshots
from ..sources import landing, merging
from ..steps import Steps

KEY = ["asset", "cycle_id"]


def land(spark: SparkSession, log_csv: str, names: list[str], key: str, sha256: str, version: str, path: str) -> DataFrame:
    """PIPE1: raw file to the raw table; a rerun adds no row, and repeated or missing keys are refused."""
    raw = landing.read_log(spark, log_csv, names, key, sha256, version)
    safe = quality.key_safety(raw, "record_id").first()
    if safe["null_keys"] or safe["blank_keys"] or safe["repeated_keys"]:
        raise ValueError(f"unsafe keys: {safe.asDict()}")
    merging.append_new(raw, path, ["record_id"])
    return spark.read.parquet(path)


def validate(raw: DataFrame, contract: quality.Contract, path: str, gap_seconds: int, lineage: list[str], asset: str = "asset") -> DataFrame:
    """PIPE2: accepted and quarantined rows and metrics; returns the accepted rows."""
    annotated = quality.annotate(raw, contract, asset, gap_seconds)
    merging.write_outputs(annotated, quality.metrics(annotated, lineage=lineage), path, ["record_id"])
    return raw.sparkSession.read.parquet(f"{path}/accepted")


def derive_cycles(accepted: DataFrame, path: str, asset: str = "asset") -> DataFrame:
    """PIPE3: cycles, upserted into a new version; conflicts are an error."""
    spark, found = accepted.sparkSession, cycles.derive(accepted, asset)
    if merging.versions(spark, path):
        merged = merging.monotonic_merge(merging.read_newest(spark, path), found, [asset, "cycle_id"])
        if not merged.where("action = 'conflict'").isEmpty():
            raise ValueError("cycles changed in what may not change; see monotonic_merge")
        found = merged.drop("action")
    merging.write_version(found, path)
    return merging.read_newest(spark, path)


def label_cycles(cycle_rows: DataFrame, failures: DataFrame, accepted: DataFrame, horizon_seconds: int) -> DataFrame:
    """PIPE4."""
    return labels.label(cycle_rows, failures, labels.observation_end(accepted), horizon_seconds)


def feature_snapshots(cycle_rows: DataFrame, accepted: DataFrame, signal: str, window_seconds: int, gap_seconds: int, lineage: dict[str, Column]) -> DataFrame:
    """PIPE5."""
    points = cycle_rows.withColumn("prediction_ts", F.when(~F.col("right_censored"), F.col("stop_ts")))
    win = features.signal_window(points, accepted, signal, window_seconds)
    covered = features.internal_gaps(features.coverage(win, accepted), accepted, window_seconds)
    v1 = snapshots.snapshot(features.eligibility(win, covered, gap_seconds), lineage)
    return snapshots.snapshot_v2(v1, cycles.context(cycle_rows))


def expand_snapshots(v1_path: str, context_rows: DataFrame, path: str) -> DataFrame:
    """SNP2, SNP3, VAL20: write the v2 snapshots of a v1 table of one version and lineage, and prove that v1 is what it was."""
    spark = context_rows.sparkSession
    v1 = spark.read.parquet(v1_path)
    wrong = audit.table_rules(v1, KEY, ["dataset_version"], "v1", {"snapshot_version": snapshots.SNAPSHOT_V1}).where("violations > 0")
    if not wrong.isEmpty():
        raise ValueError(f"unfit v1 table: {[r['rule'] for r in wrong.collect()]}")
    before = snapshots.digest(v1).first()
    merging.create(snapshots.snapshot_v2(v1, context_rows), path)
    if snapshots.digest(spark.read.parquet(v1_path)).first() != before:
        raise ValueError("the v1 table has changed")
    return spark.read.parquet(path)


def modelling_view(snapshot_rows: DataFrame, label_rows: DataFrame, lineage: dict[str, Column]) -> DataFrame:
    """PIPE6: refuses key sets that differ."""
    seen = snapshots.key_coverage(snapshot_rows, label_rows, KEY).first()
    if any(seen[n] for n in ("only_left", "only_right", "repeated_left", "repeated_right")):
        raise ValueError(f"snapshots and labels differ in keys: {seen.asDict()}")
    return snapshots.modelling_view(snapshot_rows, label_rows, lineage, with_context=True)


def compare_candidates(view: DataFrame, candidates: list[models.Candidate], validation_start: str, test_start: str) -> DataFrame:
    """PIPE7: evidence of each candidate on the same development rows."""
    inputs = list(dict.fromkeys(i for c in candidates for i in c.inputs))
    rows = models.development_rows(view, inputs, test_start).withColumn("part", snapshots.partition(F.col("prediction_ts"), validation_start, test_start)).persist()
    try:
        return models.compare(rows.where("part = 'train'"), rows.where("part = 'validation'"), candidates)
    finally:
        rows.unpersist()


def score(view: DataFrame, inputs: list[str], validation_start: str, test_start: str, part: str) -> DataFrame:
    """PIPE8, PIPE10: fit on the training rows, score those of one other part."""
    rows = view.where("row_status = 'trainable'").dropna(subset=inputs).withColumn("part", snapshots.partition(F.col("prediction_ts"), validation_start, test_start))
    return models.predict(models.fit(rows.where("part = 'train'"), inputs), rows.where(F.col("part") == part), inputs)


def held_out(scored: DataFrame, failures: DataFrame, horizon_seconds: int, **grid) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
    """PIPE10: aggregates of the held-out population and the metrics of every policy on it; no row of it leaves."""
    return models.evaluation(scored.withColumn("part", F.lit("test")), ["part"]), evaluate_policies(scored, failures, horizon_seconds, **grid)


def profiles_of(cycle_rows: DataFrame, label_rows: DataFrame, covered: DataFrame, view: DataFrame, policies: list[tuple[str, bool, int | None]], splits: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """PIPE12: the read-only profiles of one source, each a small table."""
    bounds = profiles.tail_bounds(covered)
    return {
        "cycles": cycles.statistics(cycle_rows),
        "labels": profiles.status_counts(label_rows, "horizon_status", labels.STATUSES),
        "features": profiles.support(covered),
        "coverage": profiles.coverage_policies(covered, label_rows, bounds, policies),
        "tail": profiles.tail_overlap(covered, bounds),
        "eligibility": profiles.status_counts(view, "eligibility_status"),
        "context": profiles.context_profile(view),
        "splits": snapshots.split_comparison(view, splits),
        "view": profiles.view_summary(view),
        "drift": profiles.monthly_drift(view.where("row_status = 'trainable'"), "win_mean"),
    }


def evaluate_policies(scored: DataFrame, failures: DataFrame, horizon_seconds: int, **grid) -> DataFrame:  # noqa: ANN003
    """PIPE9: metrics of every policy of the grid."""
    points = scored.select(*KEY, "prediction_ts", "probability")
    steps = Steps(scored.sparkSession, "policies")
    policies = steps.keep(alerts.policy_grid(points, **grid), "policies")
    return alerts.policy_metrics(points, alerts.episodes(points, policies, steps), failures, policies, horizon_seconds)

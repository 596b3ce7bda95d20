"""Registered queries of the condition-monitoring operators with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import add_seconds
from ..operators import alerts, audit, cycles, features, labels, models, profiles, quality, sketches, snapshots, windows
from ..sources import landing, merging
from . import adapters as A
from .sql_base import with_base

QUERIES: dict = {}
SQL: dict[str, str] = {}
MERGE_GAP, COOLDOWN = A.DAY, 2 * A.DAY
INPUTS = ["win_count", "win_mean", "context_duration_s", "context_previous_duration_s", "context_previous_idle_s"]


def query(sql: str | None = None, alerts: bool = False, plain: bool = False, kept: tuple[str, ...] = ()):  # noqa: ANN201
    """Register a function of a run as a query under its name; the run writes the steps named in ``kept`` once."""

    def add(f):  # noqa: ANN001, ANN202
        def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(A.Run(spark, sf_dir, kept))

        registered.__name__, registered.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = registered
        if sql:
            SQL[f.__name__] = sql if plain else with_base(sql, alerts)
        return f

    return add


def _text(reasons: str = "reasons") -> Column:
    return F.array_join(reasons, ",").alias(reasons)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- quality ----------------------------------------------------------------------------------
@query("SELECT record_id, idx, ts, value, CASE WHEN active_number IN (0, 1) THEN active_number END AS active, interval_s, forward_gap, array_to_string(reasons, ',') AS reasons FROM ann")
def quality_annotated(r: A.Run) -> DataFrame:
    """PRJ1-2, VAL1-6."""
    df = r.annotated()
    return df.select("record_id", "idx", "ts", F.when(~F.isnan("value"), F.col("value")).alias("value"), "active", "interval_s", "forward_gap", _text())


@query("SELECT len(reasons) = 0 AS accepted, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM ann GROUP BY 1")
def quality_split(r: A.Run) -> DataFrame:
    """FLT1, SNK4's two sides."""
    good, bad = quality.split(r.annotated())
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("accepted").agg(F.count("*").alias("n"), F.sum(F.substring("record_id", 2, 20).cast("long")).alias("id_sum"))


@query("SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM ann) GROUP BY 1")
def quality_reasons(r: A.Run) -> DataFrame:
    """AGG3."""
    return quality.reason_histogram(r.annotated())


@query("""
SELECT t.source, n_rows, accepted, quarantined, forward_gaps, coalesce(reason_counts, '') AS reason_counts, sha256('quality|log-validation-v1|' || t.source) AS quality_batch_id
FROM (SELECT source, count(*) AS n_rows, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(reasons) > 0) AS quarantined, count(*) FILTER (forward_gap) AS forward_gaps FROM ann GROUP BY 1) t
LEFT JOIN (SELECT source, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reason_counts FROM (SELECT source, reason, count(*) AS n FROM (SELECT source, unnest(reasons) AS reason FROM ann) GROUP BY 1, 2) GROUP BY 1) r USING (source)""")
def quality_metrics(r: A.Run) -> DataFrame:
    """AGG1-2."""
    df = quality.metrics(r.annotated(), lineage=["source"])
    text = F.array_join(F.transform(F.map_entries("reason_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return df.withColumn("reason_counts", text)


@query("""
, e AS (SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN 7 ELSE o_orderkey END AS source_row,
        CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE date_trunc('minute', o_orderdate) END AS event_start,
        date_trunc('minute', CASE WHEN o_orderkey % 37 = 0 THEN o_orderdate - INTERVAL 1 HOUR ELSE o_orderdate + INTERVAL 1 HOUR END) AS event_end, o_orderkey AS k FROM orders),
d AS (SELECT *, source_row IS NOT NULL AND count(*) OVER (PARTITION BY source_row) > 1 AS dup FROM e)
SELECT report_id, source_row, event_start, event_end, array_to_string(list_filter([CASE WHEN k % 29 = 0 THEN 'malformed_csv' END, CASE WHEN source_row IS NULL THEN 'invalid_source_row' END,
  CASE WHEN dup THEN 'duplicate_source_row' END, CASE WHEN k % 43 = 0 THEN 'missing_report' END, CASE WHEN event_start IS NULL THEN 'invalid_event_start' END,
  CASE WHEN event_end < event_start THEN 'reversed_interval' END, CASE WHEN k % 31 = 0 THEN 'missing_kind' END], lambda x: x IS NOT NULL), ',') AS reasons FROM d""")
def event_quality(r: A.Run) -> DataFrame:
    """VAL7, PRJ3."""
    return quality.annotate_events(r.raw_events()).select("report_id", "source_row", "event_start", "event_end", _text())


@query("SELECT asset, record_id, idx, previous_idx, previous_ts, interval_s, forward_gap FROM seq")
def sequence_annotated(r: A.Run) -> DataFrame:
    """VAL5, JN1."""
    return r.sequence().select("asset", "record_id", "idx", "previous_idx", "previous_ts", "interval_s", "forward_gap")


@query("""
SELECT asset, count(*) AS n_rows, 0::BIGINT AS bad_ts, count(*) FILTER (value IS NULL) AS bad_value, min(ts) AS first_ts, max(ts) AS last_ts, min(value) AS min_value, max(value) AS max_value,
  count(*) FILTER (forward_gap) AS forward_gaps, max(interval_s) AS largest_interval_s, sum(CASE WHEN forward_gap THEN interval_s // 36000 - 1 ELSE 0 END)::BIGINT AS missing_intervals,
  count(idx) - count(previous_idx) - 1 AS index_breaks, string_agg(DISTINCT active::VARCHAR, ',' ORDER BY active::VARCHAR) AS active_domain FROM seq GROUP BY 1""")
def source_profile(r: A.Run) -> DataFrame:
    """SRCPROF."""
    return quality.source_profile(r.sequence(), "asset", A.GAP, A.NOMINAL)


@query("SELECT interval_s // 3600 AS interval_units, count(*) AS n FROM seq WHERE interval_s IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def frequent_intervals(r: A.Run) -> DataFrame:
    """TOP5."""
    return quality.frequent_intervals(r.sequence())


@query("""
SELECT (SELECT count(*) FROM raw) AS n_rows, (SELECT count(*) FROM raw WHERE idx IS NULL) AS null_keys, 0::BIGINT AS blank_keys,
       (SELECT count(*) FROM (SELECT asset || '-' || idx FROM raw WHERE idx IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys""")
def key_safety(r: A.Run) -> DataFrame:
    """VAL8."""
    df = quality.typed(r.raw_log(), A.CONTRACT)
    return quality.key_safety(df.withColumn("key", F.when(F.col("idx").isNotNull(), F.concat_ws("-", "asset", "idx"))), "key")


@query("SELECT asset, count(DISTINCT (source, v)) AS n_tuples, count(*) FILTER (v = '') AS incomplete_rows FROM (SELECT asset, source, CASE WHEN event_id % 997 = 0 THEN '' ELSE 'v1' END AS v FROM raw) GROUP BY 1 HAVING count(DISTINCT (source, v)) <> 1 OR count(*) FILTER (v = '') > 0")
def lineage_check(r: A.Run) -> DataFrame:
    """VAL9, VAL20, AGG21."""
    n = F.substring("record_id", 2, 20).cast("long")
    return quality.lineage_tuples(r.raw_log().withColumn("v", F.when(n % 997 == 0, "").otherwise("v1")), ["source", "v"], ["asset"])


# --- cycles -----------------------------------------------------------------------------------
@query("SELECT record_id, is_active, is_start, is_stop, is_left_censored FROM flg")
def cycle_boundaries(r: A.Run) -> DataFrame:
    """CYC1, JN2."""
    return cycles.boundaries(r.sequence()).select("record_id", "is_active", "is_start", "is_stop", "is_left_censored")


@query("SELECT f.record_id, s.cycle_id, s.anchor AS start_record_id, s.atype AS start_type FROM flg f LEFT JOIN seg s USING (record_id)")
def cycle_segments(r: A.Run) -> DataFrame:
    """CYC2, WIN2."""
    return cycles.segments(cycles.boundaries(r.sequence())).select("record_id", "cycle_id", "start_record_id", "start_type")


@query("SELECT * FROM cyc")
def operating_cycles(r: A.Run) -> DataFrame:
    """CYC3, AGG4."""
    return r.cycle_rows()


@query("SELECT * FROM ctx")
def cycle_context(r: A.Run) -> DataFrame:
    """CYC4, WIN4."""
    return cycles.context(r.cycle_rows()).select("asset", "cycle_id", *snapshots.CONTEXT)


@query("""
SELECT asset, count(*) AS n_cycles, count(*) FILTER (start_type = 'observed') AS observed_starts, count(*) FILTER (start_type = 'left_censored') AS left_censored,
  count(*) FILTER (NOT right_censored) AS observed_stops, count(*) FILTER (right_censored) AS right_censored, sum(n_observations)::BIGINT AS n_observations,
  min(d) AS min_duration_s, max(d) AS max_duration_s, quantile_disc(d, 0.5) AS median_duration_s, quantile_disc(d, 0.95) AS p95_duration_s
FROM (SELECT *, CASE WHEN start_type = 'observed' AND NOT right_censored THEN duration_s END AS d FROM cyc) GROUP BY 1""")
def cycle_statistics(r: A.Run) -> DataFrame:
    """AGG5."""
    return cycles.statistics(r.cycle_rows(), ["asset"])


@query("""
SELECT asset, start_type, right_censored, count(*) AS n_cycles, min(duration_s) AS min_duration_s, max(duration_s) AS max_duration_s,
  quantile_disc(duration_s, 0.5) AS median_duration_s, quantile_disc(duration_s, 0.95) AS p95_duration_s FROM cyc GROUP BY 1, 2, 3""")
def cycle_inspection(r: A.Run) -> DataFrame:
    """AGG6, SRT1."""
    return cycles.inspection(r.cycle_rows(), ["asset"])


@query("""
, g AS (SELECT asset, start_type, right_censored, count(*) AS n, sum(n_observations) AS o FROM cyc GROUP BY 1, 2, 3),
b AS (SELECT *, CASE WHEN asset % 2 = 0 AND NOT right_censored THEN 1 ELSE 0 END AS more FROM g),
k(rule) AS (VALUES ('known_start_type'), ('has_observations'), ('censored_without_durations'), ('closed_with_all_durations'), ('ordered_durations')),
t(rule) AS (VALUES ('n_cycles_add_up'), ('n_observations_add_up'), ('n_durations_add_up'))
SELECT 'groups' AS audited, (SELECT count(*) FROM g) AS n_rows, rule, 0::BIGINT AS violations FROM k UNION ALL SELECT 'groups', (SELECT count(*) FROM cyc), rule, 0 FROM t
UNION ALL SELECT 'broken groups', (SELECT count(*) FROM g), rule, CASE rule WHEN 'has_observations' THEN (SELECT count(*) FROM b WHERE o < n + more) WHEN 'closed_with_all_durations' THEN (SELECT sum(more) FROM b) WHEN 'ordered_durations' THEN (SELECT count(*) FROM g WHERE asset % 3 = 0 AND NOT right_censored) WHEN 'censored_without_durations' THEN (SELECT count(*) FROM g WHERE asset % 5 = 0 AND right_censored) ELSE 0 END FROM k
UNION ALL SELECT 'broken groups', (SELECT count(*) FROM cyc), rule, CASE rule WHEN 'n_cycles_add_up' THEN (SELECT (sum(more) > 0)::INT FROM b) ELSE 0 END FROM t""", kept=("cycle_rows",))
def inspection_audit(r: A.Run) -> DataFrame:
    """AGG6: groups by censoring hold their checks and add up to the cycles; groups broken by rule do not."""
    whole = r.steps.keep(cycles.inspection_groups(r.cycle_rows(), ["asset"]), "groups")
    odd = lambda n: F.col("asset") % n == 0
    closed = ~F.col("right_censored")
    broken = whole.withColumns(
        {
            "n_cycles": F.col("n_cycles") + F.when(odd(2) & closed, 1).otherwise(0),
            "min_duration_s": F.when(odd(3) & closed, F.col("max_duration_s") + 1).when(odd(5) & ~closed, 1).otherwise(F.col("min_duration_s")),
        }
    )
    parts = []
    for rows, name in ((whole, "groups"), (broken, "broken groups")):
        parts += [audit.violations(rows, cycles.group_rules(), name), cycles.totals_agree(rows, r.cycle_rows(), name)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT to_day AS day, count(*) AS n_cycles, sum(n_observations)::BIGINT AS n_observations FROM (SELECT start_ts::DATE AS to_day, n_observations FROM cyc) GROUP BY 1")
def daily_activity(r: A.Run) -> DataFrame:
    """AGG25."""
    return r.cycle_rows().groupBy(F.to_date("start_ts").alias("day")).agg(F.count("*").alias("n_cycles"), F.sum("n_observations").alias("n_observations"))


@query("SELECT date_trunc('month', failure_start)::DATE AS month, count(*) AS n_events, sum(date_sub('minute', failure_start, failure_end))::BIGINT AS minutes FROM fail GROUP BY 1")
def monthly_events(r: A.Run) -> DataFrame:
    """AGG26."""
    f = r.failures()
    return f.groupBy(F.trunc("failure_start", "month").alias("month")).agg(F.count("*").alias("n_events"), F.sum(F.timestamp_diff("MINUTE", "failure_start", "failure_end")).alias("minutes"))


@query("SELECT 'log' AS product, count(*) AS n FROM tel UNION ALL SELECT 'failures', count(*) FROM fail UNION ALL SELECT 'cycles', count(*) FROM cyc")
def product_counts(r: A.Run) -> DataFrame:
    """AGG24, SET4."""
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("product"), "n")
    return n(r.log(), "log").unionAll(n(r.failures(), "failures")).unionAll(n(r.cycle_rows(), "cycles"))


@query("""
SELECT asset % 4 AS fleet, strftime(ts, '%Y-%m') AS month, count(*) AS n, min(value) AS least, max(value) AS most, true AS p5_within, true AS p50_within, true AS p95_within, true AS n_keys_within
FROM tel WHERE value IS NOT NULL GROUP BY 1, 2""")
def merged_sketches(r: A.Run) -> DataFrame:
    """AGG5, AGG14, AGG20 as profiles that add up: sketches stored by asset and day, merged by fleet and month, held against exact ranks and counts."""
    rows = r.readings().select("asset", (F.col("asset") % 4).alias("fleet"), F.to_date("ts").alias("day"), F.date_format("ts", "yyyy-MM").alias("month"), "value", "record_id")
    stored = r.steps.keep(sketches.sketched(rows, "value", "record_id", ["asset", "day"]), "sketches")
    groups = stored.withColumns({"fleet": F.col("asset") % 4, "month": F.date_format("day", "yyyy-MM")})
    found = r.steps.keep(sketches.profile(sketches.merged(groups, ["fleet", "month"])), "estimates")
    return sketches.within_bounds(found, rows, "value", "record_id", ["fleet", "month"])


# --- labels -----------------------------------------------------------------------------------
@query("SELECT asset, max(ts) AS label_observation_end FROM tel GROUP BY 1")
def observation_ends(r: A.Run) -> DataFrame:
    """AGG27."""
    return labels.observation_end(r.readings())


@query("SELECT asset, cycle_id, prediction_ts, horizon_version, horizon_s, label_observation_end, horizon_end, horizon_status, failure_within, matched_record_id, matched_source_row, matched_start, matched_end, seconds_to_failure FROM lab", kept=A.LABELS)
def horizon_labels(r: A.Run) -> DataFrame:
    """LAB1, JN4, JN5, TOP4."""
    return r.labelled().select("asset", "cycle_id", "prediction_ts", *snapshots.LABELS)


@query("SELECT s AS status, count(l.cycle_id) AS n FROM (VALUES ('missing_prediction_boundary'), ('inside_failure_interval'), ('positive'), ('negative'), ('horizon_censored')) v(s) LEFT JOIN lab l ON horizon_status = s GROUP BY 1", kept=A.LABELS)
def label_statuses(r: A.Run) -> DataFrame:
    """AGG17."""
    return profiles.status_counts(r.labelled(), "horizon_status", labels.STATUSES)


@query("SELECT f.asset, f.record_id, count(l.cycle_id) AS n_positive, min(seconds_to_failure) AS least_seconds FROM fail f LEFT JOIN lab l ON l.asset = f.asset AND l.matched_record_id = f.record_id AND horizon_status = 'positive' GROUP BY 1, 2", kept=A.LABELS)
def event_positives(r: A.Run) -> DataFrame:
    """AGG17, JN15."""
    return profiles.events_with_counts(r.failures(), r.labelled())


@query("SELECT l.asset, l.matched_record_id FROM lab l WHERE matched_record_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fail f WHERE f.asset = l.asset AND f.record_id = l.matched_record_id AND f.source_row % 2 = 0) GROUP BY 1, 2", kept=A.LABELS)
def unknown_events(r: A.Run) -> DataFrame:
    """JN12: matched events that a table of the even source rows lacks."""
    return profiles.unknown_events(r.labelled(), r.failures().where("source_row % 2 = 0"))


# --- features ---------------------------------------------------------------------------------
@query("SELECT asset, cycle_id, prediction_ts, win_status, win_window_start, win_count, win_first_ts, win_last_ts, win_min, round(win_mean, 6) AS win_mean, win_max FROM win", kept=A.LABELS)
def window_features(r: A.Run) -> DataFrame:
    """FEA1, WIN3, JN3."""
    df = r.windowed().select("asset", "cycle_id", "prediction_ts", *[f"win_{x}" for x in ("status", "window_start", "count", "first_ts", "last_ts", "min", "mean", "max")])
    return _rounded(df, "win_mean")


@query("SELECT asset, cycle_id, win_status AS diff_status, diff_count, round(diff_mean, 6) AS diff_mean, round(diff_mean_abs, 6) AS diff_mean_abs, round(diff_max_abs, 6) AS diff_max_abs FROM win", kept=A.LABELS)
def difference_features(r: A.Run) -> DataFrame:
    """FEA2."""
    df = features.difference_window(r.points(), r.readings(), "value", "second", A.WINDOW)
    return _rounded(df.select("asset", "cycle_id", *[f"diff_{x}" for x in ("status", "count", "mean", "mean_abs", "max_abs")]), "diff_mean", "diff_mean_abs", "diff_max_abs")


@query("SELECT asset, cycle_id, span_s, lead_s, first_follows_gap, preceding_interval_s, internal_gap_count, max_internal_gap_s FROM cov", kept=A.COVERED)
def window_coverage(r: A.Run) -> DataFrame:
    """FEA3, FEA4, JN6."""
    return r.covered().select("asset", "cycle_id", "span_s", "lead_s", "first_follows_gap", "preceding_interval_s", "internal_gap_count", "max_internal_gap_s")


@query("SELECT asset, cycle_id, max_window_gap_s, eligibility_status, eligibility_reasons FROM eli", kept=A.COVERED)
def window_eligibility(r: A.Run) -> DataFrame:
    """ELI1, JN7."""
    return r.eligible().select("asset", "cycle_id", "max_window_gap_s", "eligibility_status", _text("eligibility_reasons"))


@query("SELECT 'eligibility_status' AS metric, eligibility_status AS value, count(*) AS n FROM eli GROUP BY 2 UNION ALL SELECT 'win_status', win_status, count(*) FROM eli GROUP BY 2 UNION ALL SELECT 'eligibility_reasons', eligibility_reasons, count(*) FROM eli GROUP BY 2", kept=A.COVERED)
def eligibility_profile(r: A.Run) -> DataFrame:
    """AGG18, AGG20, AGG23."""
    return profiles.metric_listing(r.eligible().withColumn("eligibility_reasons", F.array_join("eligibility_reasons", ",")), ["eligibility_status", "win_status", "eligibility_reasons"])


@query("SELECT context_status, count(*) AS n, " + ", ".join(f"quantile_disc({c}, {q / 100}) AS {n}_p{q}" for n, c in (("duration", "context_duration_s"), ("previous", "context_previous_duration_s"), ("idle", "context_previous_idle_s")) for q in (5, 50, 95)) + " FROM vw GROUP BY 1", kept=A.VIEW)
def context_profile(r: A.Run) -> DataFrame:
    """AGG20."""
    return profiles.context_profile(r.view(), r.steps)


@query("SELECT win_status AS diff_status, count(*) AS n, min(diff_mean_abs) AS least, round(avg(diff_mean_abs), 6) AS mean, max(diff_mean_abs) AS most, quantile_cont(diff_mean_abs, 0.05) AS p5, quantile_cont(diff_mean_abs, 0.5) AS p50, quantile_cont(diff_mean_abs, 0.95) AS p95 FROM win WHERE diff_mean_abs IS NOT NULL GROUP BY 1", kept=A.LABELS)
def difference_profile(r: A.Run) -> DataFrame:
    """AGG20: spread of the mean size of the signals' difference by status."""
    found = r.steps.keep(features.difference_window(r.points(), r.readings(), "value", "second", A.WINDOW), "differences")
    return _rounded(profiles.distribution(found, "diff_mean_abs", ["diff_status"]), "mean")


@query("SELECT count(*) AS n, " + ", ".join(f"quantile_disc({c}, {q}) AS {n}_p{int(q * 100)}" for c, n in (("win_count", "count"), ("span_s", "span")) for q in (0.05, 0.5, 0.95)) + " FROM cov", kept=A.COVERED)
def window_support(r: A.Run) -> DataFrame:
    """AGG14."""
    return profiles.support(r.covered(), steps=r.steps)


THRESHOLDS = (43_200, 86_400, 129_600, 172_800, 216_000, 259_200)


@query("SELECT n, t AS threshold_s, excluded FROM (SELECT v.t, count(*) AS n, count(*) FILTER (greatest(CASE WHEN first_follows_gap THEN lead_s ELSE 0 END, coalesce(max_internal_gap_s, 0)) >= v.t) AS excluded FROM cov, (VALUES (43200), (86400), (129600), (172800), (216000), (259200)) v(t) GROUP BY 1)", kept=A.COVERED)
def gap_sensitivity(r: A.Run) -> DataFrame:
    """AGG15."""
    return profiles.gap_sensitivity(r.covered(), THRESHOLDS)


@query("""
SELECT count(*) FILTER (lc AND ls) AS both, count(*) FILTER (lc AND NOT ls) AS count_only, count(*) FILTER (NOT lc AND ls) AS span_only, count(*) FILTER (NOT lc AND NOT ls) AS neither,
  count(*) FILTER (g AND (lc OR ls)) AS gap_and_tail, count(*) FILTER (g AND NOT (lc OR ls)) AS gap_only, count(*) FILTER (NOT g AND (lc OR ls)) AS tail_only, count(*) FILTER (lc AND NOT ls AND g) AS count_only_with_gap,
  min(max_internal_gap_s) FILTER (g AND NOT (lc OR ls)) AS gap_only_least_s, max(max_internal_gap_s) FILTER (g AND NOT (lc OR ls)) AS gap_only_most_s
FROM (SELECT *, win_count < low_count AS lc, span_s < low_span AS ls, internal_gap_count > 0 AS g FROM cov, bnds)""", kept=A.COVERED)
def tail_overlap(r: A.Run) -> DataFrame:
    """AGG16, PROF1."""
    c = r.covered()
    return profiles.tail_overlap(c, r.bounds())


@query("""
, x AS (SELECT c.*, l.horizon_status, win_count < low_count OR span_s < low_span AS tail, greatest(CASE WHEN first_follows_gap THEN lead_s ELSE 0 END, coalesce(max_internal_gap_s, 0)) AS longest
        FROM cov c JOIN lab l USING (asset, cycle_id), bnds),
y AS (SELECT p.policy, x.*, (p.tail_out AND x.tail) OR coalesce(longest >= p.gap, false) AS dropped FROM x,
      (VALUES ('gap_two_days', false, 172800), ('gap_two_days_or_thin', true, 172800), ('thin', true, NULL), ('gap_half_day', false, 43200), ('gap_half_day_or_thin', true, 43200), ('gap_week_or_thin', true, 604800)) p(policy, tail_out, gap))
SELECT policy, count(*) FILTER (NOT dropped) AS kept, count(*) FILTER (dropped) AS excluded, count(*) FILTER (NOT dropped AND horizon_status = 'positive') AS kept_positive,
  count(*) FILTER (NOT dropped AND horizon_status = 'negative') AS kept_negative FROM y GROUP BY 1""", kept=A.COVERED)
def coverage_policies(r: A.Run) -> DataFrame:
    """AGG13, PROF2."""
    c = r.covered()
    gaps = {"gap_two_days": 2 * A.GAP, "gap_half_day": A.GAP // 2, "gap_week": 7 * A.GAP}
    policies = [(name, False, gap) for name, gap in gaps.items() if name != "gap_week"]
    policies += [(f"{name}_or_thin", True, gap) for name, gap in gaps.items()] + [("thin", True, None)]
    return profiles.coverage_policies(c, r.labelled(), r.bounds(), policies)


@query("""
, t AS (SELECT c.*, win_count < low_count AS lc, span_s < low_span AS ls, internal_gap_count > 0 AS gap FROM cov c, bnds)
SELECT * FROM (SELECT asset, cycle_id, win_count, span_s, gap, 'count_only' AS kind FROM t WHERE lc AND NOT ls ORDER BY span_s DESC, win_count, asset, cycle_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT asset, cycle_id, win_count, span_s, gap, 'span_only' FROM t WHERE ls AND NOT lc ORDER BY win_count DESC, span_s, asset, cycle_id LIMIT 5)""", kept=A.COVERED)
def one_sided_windows(r: A.Run) -> DataFrame:
    """TOP2, PROF1: a top-k report."""
    c = r.covered()
    return profiles.one_sided(c, r.bounds())


@query("""
, t AS (SELECT c.*, win_count < low_count OR span_s < low_span AS tail, first_follows_gap OR internal_gap_count > 0 AS gap,
               greatest(CASE WHEN first_follows_gap THEN coalesce(preceding_interval_s, 0) ELSE 0 END, coalesce(max_internal_gap_s, 0))::BIGINT AS longest_gap_s FROM cov c, bnds)
SELECT * FROM (SELECT asset, cycle_id, win_count, span_s, internal_gap_count, longest_gap_s, 'tail_only' AS kind FROM t WHERE tail AND NOT gap ORDER BY win_count, span_s, prediction_ts, asset, cycle_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT asset, cycle_id, win_count, span_s, internal_gap_count, longest_gap_s, 'gap_only' FROM t WHERE NOT tail AND gap ORDER BY longest_gap_s DESC, internal_gap_count DESC, win_count, span_s, prediction_ts, asset, cycle_id LIMIT 5)""", kept=A.COVERED)
def gap_tail_windows(r: A.Run) -> DataFrame:
    """TOP2, PROF1: a top-k report of the windows that the gap and the tail test judge unlike."""
    return profiles.gap_tail_disagreement(r.covered(), r.bounds())


@query("""
, t AS (SELECT win_count < low_count AS lc, span_s < low_span AS ls, internal_gap_count > 0 AS g FROM cov, bnds),
x AS (SELECT count(*) FILTER (lc AND NOT ls) AS co, count(*) FILTER (lc AND NOT ls AND g) AS cog FROM t)
SELECT 'tail overlap' AS audited, 1::BIGINT AS n_rows, rule, violations FROM (VALUES ('tails_add_up', 0::BIGINT), ('tail_windows_add_up', 0), ('gap_only_in_the_rest', 0), ('marked_ones_among_count_only', 0), ('ordered_gaps', 0)) v(rule, violations)
UNION ALL SELECT 'broken overlap', 1, 'tails_add_up', 1 UNION ALL SELECT 'broken overlap', 1, 'tail_windows_add_up', 1 UNION ALL SELECT 'broken overlap', 1, 'gap_only_in_the_rest', 0
UNION ALL SELECT 'broken overlap', 1, 'marked_ones_among_count_only', (cog > co + 1)::BIGINT FROM x UNION ALL SELECT 'broken overlap', 1, 'ordered_gaps', 0""", kept=A.COVERED)
def overlap_audit(r: A.Run) -> DataFrame:
    """PROF1: the overlap profile adds up, and one with a window too many does not."""
    c = r.covered()
    row = profiles.tail_overlap(c, r.bounds()).crossJoin(c.agg(F.count("*").alias("n")))
    broken = row.withColumn("count_only", F.col("count_only") + 1)
    return audit.violations(row, profiles.overlap_rules(), "tail overlap").unionByName(audit.violations(broken, profiles.overlap_rules(), "broken overlap"))


@query("SELECT asset, cycle_id, win_count, span_s FROM cov, bnds WHERE win_count <= low_count AND span_s <= low_span ORDER BY win_count, span_s, asset, cycle_id LIMIT 5", kept=A.COVERED)
def worst_windows(r: A.Run) -> DataFrame:
    """TOP1, TOP2: a top-k report."""
    c = r.covered()
    both = c.crossJoin(F.broadcast(r.bounds()))
    low = (F.col("win_count") <= F.col("low_count")) & (F.col("span_s") <= F.col("low_span"))
    return profiles.worst(both, low, [F.asc(x) for x in ("win_count", "span_s", "asset", "cycle_id")], ["asset", "cycle_id", "win_count", "span_s"])


# --- snapshots and views ----------------------------------------------------------------------
@query("SELECT 'window-context-snapshot-v2' AS snapshot_version, e.asset, e.cycle_id, e.prediction_ts, win_status, win_count, round(win_mean, 6) AS win_mean, eligibility_status, eligibility_reasons, context_status, context_previous_idle_s, 'events-v1' AS dataset_version FROM eli e JOIN ctx USING (asset, cycle_id)", kept=A.COVERED)
def feature_snapshot(r: A.Run) -> DataFrame:
    """SNP1, SNP2, JN8."""
    df = r.snapshot_v2()
    out = df.select("snapshot_version", "asset", "cycle_id", "prediction_ts", "win_status", "win_count", "win_mean", "eligibility_status", _text("eligibility_reasons"), "context_status", "context_previous_idle_s", "dataset_version")
    return _rounded(out, "win_mean")


@query("SELECT asset, cycle_id, CASE WHEN eligibility_status = 'eligible' AND horizon_status IN ('positive', 'negative') THEN 'trainable' ELSE 'excluded' END AS row_status, replace(replace(exclusion_reasons, ',cycle_context_unavailable', ''), 'cycle_context_unavailable', '') AS exclusion_reasons, 'modelling-view-v1' AS view_version, failure_within FROM vw", kept=A.COVERED)
def modelling_view_v1(r: A.Run) -> DataFrame:
    """VIEW1."""
    return r.view_v1().select("asset", "cycle_id", "row_status", _text("exclusion_reasons"), "view_version", "failure_within")


@query("SELECT asset, cycle_id, part, row_status, exclusion_reasons, 'modelling-view-v2' AS view_version, failure_within, context_status, matched_record_id FROM vw", kept=A.COVERED)
def modelling_view_v2(r: A.Run) -> DataFrame:
    """VIEW2, SPL1."""
    return r.view().select("asset", "cycle_id", "part", "row_status", _text("exclusion_reasons"), "view_version", "failure_within", "context_status", "matched_record_id")


@query("SELECT count(*) AS n_rows, count(*) FILTER (row_status = 'trainable') AS trainable, count(*) FILTER (row_status = 'excluded') AS excluded, count(*) FILTER (row_status = 'trainable' AND failure_within) AS positives, min(prediction_ts) AS first_ts, max(prediction_ts) AS last_ts, count(DISTINCT matched_record_id) AS n_events, count(DISTINCT (asset, cycle_id)) AS n_keys FROM vw", kept=A.COVERED)
def view_summary(r: A.Run) -> DataFrame:
    """AGG8, AGG19, AGG21, WIN5."""
    return profiles.view_summary(r.view())


CANDIDATES = [("middle", "2024-01-15 00:00:00", "2024-01-22 00:00:00"), ("late", "2024-01-20 00:00:00", "2024-01-26 00:00:00")]


@query("""
SELECT candidate, CASE WHEN prediction_ts < a THEN 'train' WHEN prediction_ts < b THEN 'validation' ELSE 'test' END AS part, count(*) AS n_rows, count(*) FILTER (failure_within) AS positives,
  min(prediction_ts) AS first_ts, max(prediction_ts) AS last_ts, count(DISTINCT matched_record_id) AS n_events
FROM vw, (VALUES ('middle', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-22'), ('late', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-26')) c(candidate, a, b) WHERE row_status = 'trainable' GROUP BY 1, 2""", kept=A.COVERED)
def split_comparison(r: A.Run) -> DataFrame:
    """AGG11."""
    return snapshots.split_comparison(r.view(), CANDIDATES)


@query("SELECT count(*) FILTER (l > 0 AND r > 0) AS in_both, count(*) FILTER (r = 0) AS only_left, count(*) FILTER (l = 0) AS only_right, 0::BIGINT AS repeated_left, 0::BIGINT AS repeated_right FROM (SELECT asset, cycle_id, 1 AS l, count(c2.cycle_id) AS r FROM cyc LEFT JOIN (SELECT cycle_id FROM lab WHERE horizon_status <> 'negative') c2 USING (cycle_id) GROUP BY 1, 2)", kept=A.LABELS)
def key_coverage(r: A.Run) -> DataFrame:
    """JN9: all cycles against those whose label is not negative."""
    return snapshots.key_coverage(r.cycle_rows(), r.labelled().where("horizon_status != 'negative'"), ["asset", "cycle_id"])


@query("SELECT o_orderstatus, o_orderpriority, 'left' AS side FROM (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 1000 EXCEPT ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 200000) UNION ALL SELECT o_orderstatus, o_orderpriority, 'right' FROM (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 200000 EXCEPT ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 1000)", plain=True)
def multiset_difference(r: A.Run) -> DataFrame:
    """SET1, SNP3's proof."""
    o = r.table("orders")
    names = ("o_orderstatus", "o_orderpriority")
    return snapshots.table_difference(o.where("o_totalprice > 1000").select(*names), o.where("o_totalprice > 200000").select(*names))


@query("SELECT o_custkey, 'left' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_custkey, 'right' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')", plain=True)
def key_set_difference(r: A.Run) -> DataFrame:
    """SET2, SET5."""
    o = r.table("orders")
    return snapshots.set_difference(o.where("o_orderstatus = 'O'").select("o_custkey"), o.where("o_orderstatus = 'F'").select("o_custkey"))


#: The audit's rules as SQL conditions: table, what it is audited as, and (rule, condition that a good row fulfils).
_STATUSES = "('missing_prediction_boundary', 'inside_failure_interval', 'positive', 'negative', 'horizon_censored')"
_MATCHED = ("matched_record_id", "matched_source_row", "matched_start", "matched_end", "seconds_to_failure")
_SET, _NONE = (lambda *names: " AND ".join(f"{n} IS NOT NULL" for n in names)), (lambda *names: " AND ".join(f"{n} IS NULL" for n in names))
_VALUES = ("win_first_ts", "win_last_ts", "win_min", "win_mean", "win_max")
_AUDITS = [
    ("cyc", "cycles", [
        ("id_matches_start", "cycle_id = sha256('cycle-v1|' || start_record_id)"), ("known_start_type", "start_type IN ('observed', 'left_censored')"), ("has_start", "start_ts IS NOT NULL"),
        ("stop_agrees_with_censoring", f"CASE WHEN right_censored THEN {_NONE('stop_ts', 'stop_record_id', 'duration_s')} ELSE {_SET('stop_ts', 'stop_record_id', 'duration_s')} END"),
        ("duration_matches", "right_censored OR duration_s = date_sub('second', start_ts, stop_ts)"), ("stop_after_start", "right_censored OR stop_ts > start_ts"), ("has_observations", "n_observations > 0")]),
    ("lab", "labels", [
        ("known_status", f"horizon_status IN {_STATUSES}"), ("end_is_prediction_plus_horizon", "prediction_ts IS NULL OR horizon_end = prediction_ts + INTERVAL 172800 SECOND"),
        ("missing_has_no_prediction", "(horizon_status = 'missing_prediction_boundary') = (prediction_ts IS NULL)"), ("positive_is_matched", f"horizon_status <> 'positive' OR (failure_within AND {_SET(*_MATCHED)})"),
        ("positive_in_horizon", "horizon_status <> 'positive' OR (matched_start > prediction_ts AND matched_start <= horizon_end)"), ("others_unmatched", f"horizon_status = 'positive' OR ({_NONE(*_MATCHED)})"),
        ("negative_is_observed", "horizon_status <> 'negative' OR (NOT failure_within AND horizon_end <= label_observation_end)"), ("undecided_has_no_target", "horizon_status IN ('positive', 'negative') OR failure_within IS NULL"),
        ("censored_not_observed", "horizon_status <> 'horizon_censored' OR horizon_end > label_observation_end")]),
    ("win", "windows", [
        ("known_status", "win_status IN ('available', 'missing_prediction_boundary', 'missing_prediction_observation')"), ("missing_boundary_has_no_prediction", "(win_status = 'missing_prediction_boundary') = (prediction_ts IS NULL)"),
        ("available_has_values", f"win_status <> 'available' OR (win_count > 0 AND {_SET(*_VALUES)})"), ("missing_has_none", f"win_status = 'available' OR (win_count = 0 AND {_NONE(*_VALUES)})"),
        ("ordered_values", "win_status <> 'available' OR (win_min <= win_mean + 1e-9 AND win_mean <= win_max + 1e-9)"), ("inside_window", "win_status <> 'available' OR (win_first_ts > win_window_start AND win_last_ts <= prediction_ts)"),
        ("window_start", "prediction_ts IS NULL OR win_window_start = prediction_ts - INTERVAL 259200 SECOND")]),
    ("ctx", "context", [
        ("known_status", "context_status IN ('missing_prediction_boundary', 'left_censored_current_cycle', 'incomplete_current_cycle', 'missing_previous_cycle', 'incomplete_previous_cycle', 'invalid_previous_interval', 'available')"),
        ("available_is_complete", f"context_status <> 'available' OR ({_SET('context_duration_s', 'context_previous_cycle_id', 'context_previous_duration_s', 'context_previous_idle_s')})"),
        ("no_negative_times", "coalesce(least(context_duration_s, context_previous_duration_s, context_previous_idle_s) >= 0, true)")]),
    ("vw JOIN win USING (asset, cycle_id)", "view", [
        ("known_row_status", "row_status IN ('trainable', 'excluded')"), ("reasons_agree", "(row_status = 'trainable') = (exclusion_reasons = '')"),
        ("reasons_recomputed", "list_sort(list_filter(string_split(exclusion_reasons, ','), lambda x: x <> '')) = list_sort(list_filter([CASE WHEN eligibility_status = 'ineligible' THEN 'feature_ineligible' END, CASE WHEN horizon_status IN ('horizon_censored', 'inside_failure_interval', 'missing_prediction_boundary') THEN horizon_status END, CASE WHEN context_status IS DISTINCT FROM 'available' THEN 'cycle_context_unavailable' END], lambda x: x IS NOT NULL))"),
        ("trainable_has_target", "row_status <> 'trainable' OR failure_within IS NOT NULL"), ("trainable_is_eligible", "row_status <> 'trainable' OR eligibility_status = 'eligible'"),
        ("window_is_past", "win_last_ts IS NULL OR win_last_ts <= win.prediction_ts"), ("window_boundary", "win.prediction_ts IS NULL OR win_window_start = win.prediction_ts - INTERVAL 259200 SECOND")]),
    ("cov JOIN lab USING (asset, cycle_id)", "policy inputs", [
        ("no_negative_lead", "lead_s >= 0"), ("no_negative_gap", "coalesce(max_internal_gap_s >= 0, true)"), ("known_label", f"horizon_status IN {_STATUSES}")]),
    ("sco", "scores", [("has_key", _SET("asset", "cycle_id", "prediction_ts")), ("probability_in_range", "probability BETWEEN 0 AND 1")]),
    ("fail", "events", [
        ("ordered_interval", "failure_start <= failure_end"), ("warning_window_inside", "failure_start - INTERVAL 172800 SECOND >= TIMESTAMP '2024-01-01'"), ("end_inside", "failure_end < TIMESTAMP '2024-01-31'")]),
]


def _unique(audited: str, table: str, key: str) -> str:
    return f"SELECT '{audited}' AS audited, coalesce(sum(n), 0)::BIGINT AS n_rows, 'unique_key' AS rule, count(*) FILTER (n > 1) AS violations FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})"


def _fixed(audited: str, table: str, *rules: str) -> list[str]:
    """Rules that hold by how a table is made in SQL."""
    return [f"SELECT '{audited}', count(*), '{rule}', 0 FROM {table}" for rule in rules]


_AUDIT_SQL = " UNION ALL ".join([
    *(f"SELECT '{name}' AS audited, count(*) AS n_rows, '{rule}' AS rule, count(*) FILTER (NOT coalesce({ok}, false)) AS violations FROM {table}" for table, name, rules in _AUDITS for rule, ok in rules),
    _unique("events", "fail", "asset, record_id"), _unique("view", "vw", "asset, cycle_id"), _unique("policy inputs", "cov", "asset, cycle_id"),
    *_fixed("events", "fail", "one_lineage"), *_fixed("view", "vw", "one_lineage", "view_version_is_modelling-view-v2", "snapshot_version_is_window-context-snapshot-v2"),
    "SELECT 'view and labels', count(*), 'same_population', count(*) FILTER (v <> l) FROM (SELECT coalesce(v, 0) AS v, coalesce(l, 0) AS l FROM (SELECT asset, cycle_id, count(*) AS v FROM vw GROUP BY 1, 2) FULL JOIN (SELECT asset, cycle_id, count(*) AS l FROM lab GROUP BY 1, 2) USING (asset, cycle_id))",
])


@query(_AUDIT_SQL, kept=A.VIEW)
def audit_suite(r: A.Run) -> DataFrame:
    """VAL10-VAL19, AGG22, PIPE11, JN13, JN14."""
    lab, win, view = r.labelled(), r.windowed(), r.view()
    joined = r.covered().join(lab.select("asset", "cycle_id", "horizon_status"), ["asset", "cycle_id"])
    parts = [
        audit.violations(r.cycle_rows(), audit.cycle_rules(), "cycles"),
        audit.violations(lab, audit.horizon_rules(), "labels"),
        audit.violations(win, audit.window_rules(), "windows"),
        audit.violations(cycles.context(r.cycle_rows()), audit.context_rules(), "context"),
        audit.violations(view, audit.view_rules(), "view"),
        audit.violations(joined, audit.policy_input_rules(), "policy inputs"),
        audit.violations(r.score_points(), audit.score_rules(), "scores"),
        audit.violations(r.failures(), audit.event_rules(A.HORIZON, "2024-01-01 00:00:00", "2024-01-31 00:00:00"), "events"),
        audit.table_rules(r.failures().withColumn("dataset_version", F.lit("errors-v1")), ["asset", "record_id"], ["dataset_version"], "events"),
        audit.table_rules(joined, ["asset", "cycle_id"], [], "policy inputs"),
        audit.same_population(view, lab, ["asset", "cycle_id"], "view and labels"),
        audit.table_rules(view, ["asset", "cycle_id"], ["dataset_version", "failure_dataset_version"], "view", {"view_version": snapshots.VIEW_V2, "snapshot_version": snapshots.SNAPSHOT_V2}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
SELECT 'events' AS audited, count(*) AS n_rows, 'ordered_interval' AS rule, count(*) FILTER (failure_start > failure_end) AS violations FROM fail
UNION ALL SELECT 'events', count(*), 'warning_window_inside', count(*) FILTER (failure_start - INTERVAL 172800 SECOND < TIMESTAMP '2024-01-01') FROM fail
UNION ALL SELECT 'events', count(*), 'end_inside', count(*) FILTER (failure_end >= TIMESTAMP '2024-01-25') FROM fail""")
def event_audit(r: A.Run) -> DataFrame:
    """VAL16, VAL18: real violations, as the period cuts through the data."""
    return audit.violations(r.failures(), audit.event_rules(A.HORIZON, "2024-01-01 00:00:00", "2024-01-25 00:00:00"), "events")


@query("""
, b AS (SELECT *, win_count % 5 = 0 AS flip, win_count % 7 = 0 AS blank, win_count % 3 = 0 AS wrong FROM vw),
r AS (SELECT CASE WHEN flip THEN CASE row_status WHEN 'trainable' THEN 'excluded' ELSE 'trainable' END ELSE row_status END AS row_status,
             CASE WHEN blank THEN NULL ELSE failure_within END AS failure_within, CASE WHEN wrong THEN 'feature_ineligible' ELSE exclusion_reasons END AS reasons, exclusion_reasons, eligibility_status FROM b),
n AS (SELECT count(*) AS n_rows, 0::BIGINT AS known_row_status, count(*) FILTER ((row_status = 'trainable') <> (reasons = '')) AS reasons_agree,
             count(*) FILTER (reasons <> exclusion_reasons) AS reasons_recomputed, count(*) FILTER (row_status = 'trainable' AND failure_within IS NULL) AS trainable_has_target,
             count(*) FILTER (row_status = 'trainable' AND eligibility_status <> 'eligible') AS trainable_is_eligible, 0::BIGINT AS window_is_past, 0::BIGINT AS window_boundary FROM r)
SELECT 'broken view' AS audited, n_rows, rule, violations FROM n UNPIVOT (violations FOR rule IN (known_row_status, reasons_agree, reasons_recomputed, trainable_has_target, trainable_is_eligible, window_is_past, window_boundary))""", kept=A.COVERED)
def broken_view_audit(r: A.Run) -> DataFrame:
    """VAL13, AGG22: a view whose status, label and reasons are broken by rule."""
    n, status = F.col("win_count"), F.col("row_status")
    broken = r.view().withColumns(
        {
            "row_status": F.when(n % 5 == 0, F.when(status == "trainable", "excluded").otherwise("trainable")).otherwise(status),
            "failure_within": F.when(n % 7 != 0, F.col("failure_within")),
            "exclusion_reasons": F.when(n % 3 == 0, F.array(F.lit("feature_ineligible"))).otherwise(F.col("exclusion_reasons")),
        }
    )
    return audit.violations(broken, audit.view_rules(), "broken view")


@query("""
, b AS (SELECT *, CASE WHEN n_observations % 3 = 0 THEN NOT right_censored ELSE right_censored END AS rc, CASE WHEN n_observations % 5 = 0 THEN 0 ELSE n_observations END AS n,
               CASE WHEN n_observations % 4 = 0 THEN duration_s + 1 ELSE duration_s END AS d FROM cyc),
x AS (SELECT count(*) AS n_rows, 0::BIGINT AS id_matches_start, 0::BIGINT AS known_start_type, 0::BIGINT AS has_start, count(*) FILTER (rc <> right_censored) AS stop_agrees_with_censoring,
             count(*) FILTER (NOT (rc OR coalesce(d = duration_s, false))) AS duration_matches, count(*) FILTER (NOT rc AND stop_ts IS NULL) AS stop_after_start, count(*) FILTER (n <= 0) AS has_observations FROM b)
SELECT 'broken cycles' AS audited, n_rows, rule, violations FROM x UNPIVOT (violations FOR rule IN (id_matches_start, known_start_type, has_start, stop_agrees_with_censoring, duration_matches, stop_after_start, has_observations))""")
def broken_cycle_audit(r: A.Run) -> DataFrame:
    """VAL10, AGG22: cycles whose censoring, count and duration are broken by rule."""
    n = F.col("n_observations")
    broken = r.cycle_rows().withColumns(
        {
            "right_censored": F.when(n % 3 == 0, ~F.col("right_censored")).otherwise(F.col("right_censored")),
            "duration_s": F.when(n % 4 == 0, F.col("duration_s") + 1).otherwise(F.col("duration_s")),
            "n_observations": F.when(n % 5 == 0, 0).otherwise(n),
        }
    )
    return audit.violations(broken, audit.cycle_rules(), "broken cycles")


@query("""
, e AS (SELECT record_id, source_row, CASE WHEN source_row % 5 = 0 THEN '' WHEN source_row % 7 = 0 THEN 'errors-v0' ELSE 'errors-v1' END AS v, unnest(range(CASE WHEN source_row % 3 = 0 THEN 2 ELSE 1 END)) AS copy FROM fail),
p AS (SELECT cycle_id, CASE WHEN win_count % 2 = 0 THEN -1 ELSE lead_s END AS lead_s, CASE WHEN win_count % 5 = 0 THEN -5 ELSE max_internal_gap_s END AS gap, win_count % 4 = 0 AS odd, unnest(range(CASE WHEN win_count % 3 = 0 THEN 2 ELSE 1 END)) AS copy FROM cov)
SELECT 'broken events' AS audited, (SELECT count(*) FROM e) AS n_rows, 'unique_key' AS rule, (SELECT count(*) FROM fail WHERE source_row % 3 = 0) AS violations
UNION ALL SELECT 'broken events', count(*), 'one_lineage', greatest(count(DISTINCT v) - 1, 0) + count(*) FILTER (v = '') FROM e
UNION ALL SELECT 'broken inputs', count(*), 'no_negative_lead', count(*) FILTER (lead_s < 0) FROM p
UNION ALL SELECT 'broken inputs', count(*), 'no_negative_gap', count(*) FILTER (gap < 0) FROM p
UNION ALL SELECT 'broken inputs', count(*), 'known_label', count(*) FILTER (odd) FROM p
UNION ALL SELECT 'broken inputs', (SELECT count(*) FROM p), 'unique_key', count(*) FROM cov WHERE win_count % 3 = 0""", kept=A.COVERED)
def broken_input_audit(r: A.Run) -> DataFrame:
    """VAL16, VAL19: events and policy inputs that are broken by rule: repeated keys, blank and second versions, impossible times, unknown labels."""
    twice = lambda df, often: df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(often, 2).otherwise(1))))
    n, w = F.col("source_row"), F.col("win_count")
    events = twice(r.failures().withColumn("dataset_version", F.when(n % 5 == 0, "").when(n % 7 == 0, "errors-v0").otherwise("errors-v1")), n % 3 == 0)
    inputs = r.covered().withColumns({"lead_s": F.when(w % 2 == 0, -1).otherwise(F.col("lead_s")), "max_internal_gap_s": F.when(w % 5 == 0, -5).otherwise(F.col("max_internal_gap_s")), "horizon_status": F.when(w % 4 == 0, "odd").otherwise("negative")})
    inputs = twice(inputs, w % 3 == 0)
    parts = [audit.table_rules(events, ["asset", "record_id"], ["dataset_version"], "broken events"), audit.violations(inputs, audit.policy_input_rules(), "broken inputs"), audit.table_rules(inputs, ["asset", "cycle_id"], [], "broken inputs")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- merges -----------------------------------------------------------------------------------
CUT = "2024-01-20 00:00:00"


def _earlier(r: A.Run) -> DataFrame:
    """Cycles as they were known at an earlier time."""
    seq = r.sequence().where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"))
    return cycles.derive(seq)


_EARLY = """
, cut0 AS (SELECT asset, cycle_id, max(anchor) AS start_record_id, max(atype) AS start_type, max(CASE WHEN record_id = anchor THEN ts END) AS start_ts,
                max(CASE WHEN is_stop THEN record_id END) AS stop_record_id, max(CASE WHEN is_stop THEN ts END) AS stop_ts, count(*) FILTER (is_active) AS n_observations
           FROM seg WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
old AS (SELECT *, stop_ts IS NULL AS right_censored FROM cut0)
"""


@query(_EARLY + "SELECT * FROM cyc WHERE (asset, cycle_id) NOT IN (SELECT (asset, cycle_id) FROM old)", kept=("sequence",))
def insert_only_merge(r: A.Run) -> DataFrame:
    """SNK1, JN10."""
    return merging.insert_only(_earlier(r), r.cycle_rows(), ["asset", "cycle_id"])


@query(_EARLY + """
SELECT c.*, CASE WHEN o.cycle_id IS NULL THEN 'insert' WHEN NOT o.right_censored OR (c.n_observations = o.n_observations AND c.right_censored) THEN 'equal' ELSE 'update' END AS action
FROM cyc c LEFT JOIN old o USING (asset, cycle_id)""", kept=("sequence",))
def monotonic_merge(r: A.Run) -> DataFrame:
    """SNK2."""
    return merging.monotonic_merge(_earlier(r), r.cycle_rows(), ["asset", "cycle_id"])


@query(_EARLY + """
, o AS (SELECT *, n_observations + CASE WHEN asset % 7 = 0 THEN 100 ELSE 0 END AS n FROM old),
m AS (SELECT c.asset, c.cycle_id, c.n_observations AS fresh, o.n, CASE WHEN o.cycle_id IS NULL THEN 'insert' WHEN o.n = c.n_observations AND o.stop_ts IS NOT DISTINCT FROM c.stop_ts THEN 'equal'
        WHEN NOT o.right_censored OR c.n_observations < o.n THEN 'conflict' WHEN c.n_observations > o.n OR NOT c.right_censored THEN 'update' ELSE 'conflict' END AS action
      FROM cyc c LEFT JOIN o USING (asset, cycle_id))
SELECT asset, cycle_id, action, CASE WHEN action IN ('insert', 'update') THEN fresh ELSE n END AS n_observations FROM m""", kept=("sequence",))
def merge_conflicts(r: A.Run) -> DataFrame:
    """SNK2: a target that counts too many observations of some assets."""
    more = F.when(F.col("asset") % 7 == 0, 100).otherwise(0)
    target = _earlier(r).withColumn("n_observations", F.col("n_observations") + more)
    return merging.monotonic_merge(target, r.cycle_rows(), ["asset", "cycle_id"]).select("asset", "cycle_id", "action", "n_observations")


@query(_EARLY + """
SELECT asset, cycle_id, CASE WHEN o.cycle_id IS NULL THEN 'insert' WHEN o.stop_ts IS NOT DISTINCT FROM c.stop_ts AND o.n_observations = c.n_observations THEN 'equal' ELSE 'conflict' END AS action
FROM cyc c LEFT JOIN old o USING (asset, cycle_id)""", kept=("sequence",))
def immutable_merge(r: A.Run) -> DataFrame:
    """SNK3, JN11."""
    return merging.immutable_merge(_earlier(r), r.cycle_rows(), ["asset", "cycle_id"], ["stop_ts", "n_observations"])


@query(_EARLY + """
SELECT asset, cycle_id, CASE WHEN o.cycle_id IS NULL THEN 'missing' ELSE 'changed' END AS problem
FROM cyc c LEFT JOIN old o USING (asset, cycle_id) WHERE o.cycle_id IS NULL OR o.stop_ts IS DISTINCT FROM c.stop_ts""", kept=("sequence",))
def write_reconciliation(r: A.Run) -> DataFrame:
    """JN10, JN11."""
    return merging.reconcile(_earlier(r), r.cycle_rows(), ["asset", "cycle_id"], ["stop_ts"])


@query("SELECT record_id, sha256('log|abc|' || idx) AS lineage_id, sha256('batch|abc|v1') AS ingestion_batch_id, 'v1' AS dataset_version FROM tel")
def lineage_columns(r: A.Run) -> DataFrame:
    """ID1, SRC3."""
    df = r.log().withColumn("key", F.col("idx").cast("string")).withColumnRenamed("record_id", "own_id")
    out = landing.with_lineage(df, "log", "key", "abc", "v1")
    return out.select(F.col("own_id").alias("record_id"), F.col("record_id").alias("lineage_id"), "ingestion_batch_id", "dataset_version")


# --- baselines and models ---------------------------------------------------------------------
_TRAIN = ", tr AS (SELECT * FROM vw WHERE row_status = 'trainable')\n, med AS (SELECT month, count(*) AS n, quantile_cont(win_mean, 0.5) AS median FROM (SELECT *, strftime(prediction_ts, '%Y-%m-%d') AS month FROM tr WHERE part = 'train' AND NOT failure_within) GROUP BY 1)\n"


@query(_TRAIN + "SELECT month AS day, any_value(med.n) AS n, round(any_value(median), 6) AS median, round(quantile_cont(abs(win_mean - median), 0.5), 6) AS mad FROM (SELECT *, strftime(prediction_ts, '%Y-%m-%d') AS month FROM tr WHERE part = 'train' AND NOT failure_within) JOIN med USING (month) GROUP BY 1", kept=A.VIEW)
def robust_baselines(r: A.Run) -> DataFrame:
    """BAS1, per day of the training period."""
    rows = r.view().where("row_status = 'trainable' and part = 'train'").withColumn("day", F.date_format("prediction_ts", "yyyy-MM-dd"))
    return _rounded(models.robust_baseline(rows, "win_mean", ["day"]), "median", "mad")


@query("""
, tr AS (SELECT * FROM vw WHERE row_status = 'trainable'), m AS (SELECT quantile_cont(win_mean, 0.5) AS median FROM tr WHERE part = 'train' AND NOT failure_within),
d AS (SELECT quantile_cont(abs(win_mean - median), 0.5) AS mad FROM tr, m WHERE part = 'train' AND NOT failure_within),
s AS (SELECT part, failure_within, abs(win_mean - median) / mad AS deviation FROM tr, m, d)
SELECT part, failure_within, count(*) AS n, round(min(deviation), 6) AS least, round(avg(deviation), 6) AS mean, round(max(deviation), 6) AS most,
  round(quantile_cont(deviation, 0.05), 6) AS p5, round(quantile_cont(deviation, 0.5), 6) AS p50, round(quantile_cont(deviation, 0.95), 6) AS p95 FROM s GROUP BY 1, 2""", kept=A.VIEW)
def robust_score_distribution(r: A.Run) -> DataFrame:
    """BAS2, BAS3, AGG9."""
    rows = r.view().where("row_status = 'trainable'").withColumn("all", F.lit(1))
    scored = models.robust_score(rows, models.robust_baseline(rows.where("part = 'train'"), "win_mean", ["all"]), "win_mean", ["all"])
    return _rounded(profiles.distribution(scored, "deviation", ["part", "failure_within"]), "least", "mean", "most", "p5", "p50", "p95")


@query("""
SELECT threshold, part, count(*) FILTER (failure_within AND hit) AS tp, count(*) FILTER (failure_within AND NOT hit) AS fn, count(*) FILTER (NOT failure_within AND hit) AS fp,
  count(*) FILTER (NOT failure_within AND NOT hit) AS tn, count(DISTINCT CASE WHEN hit THEN matched_record_id END) AS events_hit,
  round(count(*) FILTER (failure_within AND hit) / nullif(count(*) FILTER (hit), 0), 6) AS precision, round(count(*) FILTER (failure_within AND hit) / nullif(count(*) FILTER (failure_within), 0), 6) AS recall
FROM (SELECT *, win_mean <= threshold AS hit FROM vw, (VALUES (40.0::DOUBLE), (60.0), (80.0), (100.0), (150.0)) t(threshold) WHERE row_status = 'trainable') GROUP BY 1, 2""", kept=A.COVERED)
def directional_confusion(r: A.Run) -> DataFrame:
    """BAS4, BAS5, AGG12."""
    rows = r.view().where("row_status = 'trainable'")
    return _rounded(profiles.confusion(rows, "win_mean", [40.0, 60.0, 80.0, 100.0, 150.0]), "precision", "recall")


@query("SELECT strftime(prediction_ts, '%Y-%m') AS month, failure_within, count(*) AS n, round(min(win_mean), 6) AS least, round(avg(win_mean), 6) AS mean, round(max(win_mean), 6) AS most, round(quantile_cont(win_mean, 0.05), 6) AS p5, round(quantile_cont(win_mean, 0.5), 6) AS p50, round(quantile_cont(win_mean, 0.95), 6) AS p95 FROM vw WHERE row_status = 'trainable' GROUP BY 1, 2", kept=A.VIEW)
def monthly_drift(r: A.Run) -> DataFrame:
    """AGG10."""
    return _rounded(profiles.monthly_drift(r.view().where("row_status = 'trainable'"), "win_mean"), "least", "mean", "most", "p5", "p50", "p95")


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, count(*) AS n, min(l_extendedprice) AS least, avg(l_extendedprice) AS mean, max(l_extendedprice) AS most, quantile_cont(l_extendedprice, 0.05) AS p5, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1, 2", plain=True, kept=A.VIEW)
def line_price_drift(r: A.Run) -> DataFrame:
    """AGG7, AGG10 on the largest table."""
    rows = r.table("lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return profiles.distribution(rows, "l_extendedprice", ["month", "l_returnflag"])


def _development(r: A.Run) -> tuple[DataFrame, DataFrame]:
    rows = models.development_rows(r.view(), INPUTS, A.TEST_START)
    return rows.where("part = 'train'"), rows.where("part = 'validation'")


@query(kept=A.VIEW)
def model_comparison(r: A.Run) -> DataFrame:
    """MOD1-MOD6."""
    train, validation = _development(r)
    return models.compare(train, validation, [models.Candidate("window", tuple(INPUTS[:2])), models.Candidate("window and context", tuple(INPUTS))])


@query(kept=A.VIEW)
def validation_scores(r: A.Run) -> DataFrame:
    """MOD7."""
    train, validation = _development(r)
    return models.predict(models.fit(train, INPUTS), validation, INPUTS).select("asset", "cycle_id", "prediction_ts", "failure_within", "probability")


@query(kept=A.VIEW)
def held_out_metrics(r: A.Run) -> DataFrame:
    """MOD8, MOD9, AGG7: fit on train, score test, aggregates only."""
    train, _ = _development(r)
    test = r.view().where("row_status = 'trainable' and part = 'test'").dropna(subset=INPUTS)
    scored = models.predict(models.fit(train, INPUTS), test, INPUTS)
    return profiles.distribution(scored, "probability", ["failure_within"], (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))


@query("""
, v AS (SELECT part, win_mean, failure_within FROM vw WHERE row_status = 'trainable'), g AS (SELECT part, win_mean, count(*) AS n, count(*) FILTER (failure_within) AS pos FROM v GROUP BY 1, 2),
c AS (SELECT part, pos, sum(n) OVER w AS n, sum(pos) OVER w AS tp FROM g WINDOW w AS (PARTITION BY part ORDER BY win_mean DESC))
SELECT part, sum(pos)::BIGINT AS positives, round(sum(pos * tp / n) / nullif(sum(pos), 0), 6) AS average_precision FROM c GROUP BY 1""", kept=A.VIEW)
def average_precision(r: A.Run) -> DataFrame:
    """MOD4 for a rule score."""
    rows = r.view().where("row_status = 'trainable'")
    return _rounded(models.average_precision(rows, ["part"], "win_mean"), "average_precision")


@query("""
, v AS (SELECT * FROM vw WHERE row_status = 'trainable'), g AS (SELECT part, win_mean, count(*) AS n, count(*) FILTER (failure_within) AS pos FROM v GROUP BY 1, 2),
c AS (SELECT part, pos, sum(n) OVER w AS n, sum(pos) OVER w AS tp FROM g WINDOW w AS (PARTITION BY part ORDER BY win_mean DESC)),
ap AS (SELECT part, sum(pos)::BIGINT AS positives, sum(pos * tp / n) / nullif(sum(pos), 0) AS average_precision FROM c GROUP BY 1)
SELECT part, count(*) AS n_rows, count(DISTINCT asset) AS n_assets, min(prediction_ts) AS first_ts, max(prediction_ts) AS last_ts, min(win_mean) AS least, avg(win_mean) AS mean, max(win_mean) AS most,
  avg(win_mean) FILTER (failure_within) AS mean_positive, max(win_mean) FILTER (failure_within) AS most_positive, quantile_cont(win_mean, 0.05) AS p5, quantile_cont(win_mean, 0.25) AS p25,
  quantile_cont(win_mean, 0.5) AS p50, quantile_cont(win_mean, 0.75) AS p75, quantile_cont(win_mean, 0.95) AS p95, any_value(positives) AS positives, any_value(average_precision) AS average_precision
FROM v JOIN ap USING (part) GROUP BY 1""", kept=A.VIEW)
def score_evaluation(r: A.Run) -> DataFrame:
    """MOD8, MOD9 for a rule score."""
    return models.evaluation(r.view().where("row_status = 'trainable'"), ["part"], "win_mean")


#: A model of one input orders rows by that input, upwards or downwards as it varies with the label in training, so SQL can follow it.
_ONE_INPUT = """
, dev AS (SELECT asset, cycle_id, part, failure_within AS y, win_mean, win_count FROM vw WHERE row_status = 'trainable' AND win_mean IS NOT NULL AND win_count IS NOT NULL
          AND context_duration_s IS NOT NULL AND context_previous_duration_s IS NOT NULL AND context_previous_idle_s IS NOT NULL),
way AS (SELECT sign(covar_pop(win_mean, y::INT)) AS m, sign(covar_pop(win_count, y::INT)) AS c FROM dev WHERE part = 'train'),
sc AS (SELECT part, asset, cycle_id, y, 'mean' AS candidate, m * win_mean AS s FROM dev, way UNION ALL SELECT part, asset, cycle_id, y, 'count', c * win_count FROM dev, way)
"""


def _one_input(r: A.Run, name: str, part: str) -> DataFrame:
    train, _ = _development(r)
    rows = r.view().where((F.col("row_status") == "trainable") & (F.col("part") == part)).dropna(subset=INPUTS)
    return models.predict(models.fit(train, [name]), rows, [name])


@query(_ONE_INPUT + """
, g AS (SELECT candidate, s, count(*) AS n, count(*) FILTER (y) AS pos FROM sc WHERE part = 'validation' GROUP BY 1, 2),
c AS (SELECT candidate, s, sum(n) OVER w AS n, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY candidate) AS p FROM g WINDOW w AS (PARTITION BY candidate ORDER BY s DESC)),
d AS (SELECT candidate, tp / nullif(p, 0) AS recall, tp / n AS prec, coalesce(lag(tp / nullif(p, 0)) OVER w, 0) AS recall0, coalesce(lag(tp / n) OVER w, tp / n) AS prec0 FROM c WINDOW w AS (PARTITION BY candidate ORDER BY s DESC)),
a AS (SELECT candidate, coalesce(sum((recall - recall0) * (prec + prec0) / 2), 0) AS area FROM d GROUP BY 1),
n AS (SELECT candidate, count(*) AS n_rows, count(*) FILTER (y) AS positives FROM sc WHERE part = 'validation' GROUP BY 1)
SELECT candidate, 1 AS n_inputs, n_rows, positives, round(area, 6) AS pr_area, area = (SELECT max(area) FROM a) AND (SELECT count(*) FROM a WHERE area = (SELECT max(area) FROM a)) = 1 AS best FROM a JOIN n USING (candidate)""", kept=A.VIEW)
def one_input_models(r: A.Run) -> DataFrame:
    """MOD1-MOD6: two logistic models of one input each on the same rows, and the one that is alone the best."""
    train, validation = _development(r)
    found = r.steps.keep(models.compare(train, validation, [models.Candidate("mean", ("win_mean",)), models.Candidate("count", ("win_count",))]), "evidence")
    best = models.select_best(found, "pr_area").select("candidate", F.lit(True).alias("best"))
    return _rounded(found.join(best, "candidate", "left").withColumn("best", F.coalesce("best", F.lit(False))), "pr_area")


@query(_ONE_INPUT + "SELECT asset, cycle_id, y AS failure_within, dense_rank() OVER (ORDER BY s DESC) AS place FROM sc WHERE part = 'validation' AND candidate = 'mean'", kept=A.VIEW)
def validation_order(r: A.Run) -> DataFrame:
    """MOD7: the place of each validation row's score among the distinct scores, from the largest down."""
    train, validation = _development(r)
    way = models.direction(models.fit(train, ["win_mean"]))
    means = features.mean_in_order(validation, r.sequence(), "value", A.WINDOW, "mean")
    scored = validation.join(means, ["asset", "cycle_id"]).select("asset", "cycle_id", "failure_within", (F.lit(way) * F.col("mean")).alias("score"))
    scored = r.steps.keep(scored, "scored")
    each = scored.groupBy("score").agg(F.lit(1).cast("long").alias("place"))
    return scored.join(windows.running_down(each, [], "score", ["place"]), "score").select("asset", "cycle_id", "failure_within", "place")


@query(_ONE_INPUT + """
, g AS (SELECT s, count(*) AS n, count(*) FILTER (y) AS pos FROM sc WHERE part = 'test' AND candidate = 'mean' GROUP BY 1), c AS (SELECT pos, sum(n) OVER w AS n, sum(pos) OVER w AS tp FROM g WINDOW w AS (ORDER BY s DESC))
SELECT 'test' AS part, sum(pos)::BIGINT AS positives, round(sum(pos * tp / n) / nullif(sum(pos), 0), 6) AS average_precision FROM c HAVING count(*) > 0""", kept=A.VIEW)
def held_out_precision(r: A.Run) -> DataFrame:
    """MOD8, MOD9: average precision of held-out rows under a model fitted on the training rows alone."""
    scored = r.steps.keep(_one_input(r, "win_mean", "test").select("part", "failure_within", "probability"), "scored")
    return _rounded(models.average_precision(scored, ["part"]), "average_precision")


@query("""
SELECT l.asset, l.cycle_id, horizon_status, count(f.record_id) AS n_ahead, min(f.failure_start) AS first_start
FROM lab l LEFT JOIN fail f ON f.asset = l.asset AND f.failure_start > l.prediction_ts AND f.failure_start <= l.horizon_end GROUP BY ALL""", kept=A.LABELS)
def horizon_audit(r: A.Run) -> DataFrame:
    """JN13: every label with the failures in its horizon, counted by an interval join of its own."""
    return audit.horizon_evidence(r.labelled(), r.failures(), A.HORIZON)


@query("SELECT DISTINCT a.asset FROM vw a JOIN vw b USING (asset) WHERE a.part = 'train' AND b.part = 'test' AND a.row_status = 'trainable' AND b.row_status = 'trainable'", kept=A.VIEW)
def cross_partition_assets(r: A.Run) -> DataFrame:
    """SET3."""
    rows = r.view().where("row_status = 'trainable'")
    return models.cross_partition_keys(rows.where("part = 'train'"), rows.where("part = 'test'"), ["asset"])


# --- alerts -----------------------------------------------------------------------------------
def _policies(r: A.Run) -> DataFrame:
    return alerts.policy_grid(r.score_points(), merge_gap_s=MERGE_GAP, cooldown_s=COOLDOWN)


def _alerting(r: A.Run) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Points, policies (written, as every step compares with them) and the tables of ``alerts.detected``."""
    policies = r.steps.keep(_policies(r), "policies")
    return r.score_points(), policies, alerts.detected(r.score_points(), policies, r.steps)


@query("SELECT policy, round(threshold, 9) AS threshold, persistence, 86400::BIGINT AS merge_gap_s, 172800::BIGINT AS cooldown_s FROM pol", alerts=True, kept=A.SCORES)
def alert_policies(r: A.Run) -> DataFrame:
    """ALR9."""
    return _policies(r).withColumn("threshold", F.round("threshold", 9))


@query("SELECT * FROM epi", alerts=True, kept=A.SCORES)
def alert_episodes(r: A.Run) -> DataFrame:
    """ALR1-ALR5."""
    return _alerting(r)[2]["episodes"]


@query("""
SELECT p.policy, (SELECT count(*) FROM sco) AS n_points, coalesce(a.n, 0) AS qualifying_points, coalesce(a.s, 0) AS streaks, coalesce(b.n, 0) AS qualified_streaks, coalesce(c.n, 0) AS merged_episodes,
  coalesce(d.n, 0) AS episodes, coalesce(c.n, 0) - coalesce(d.n, 0) AS suppressed FROM pol p LEFT JOIN (SELECT policy, count(*) AS n, count(*) FILTER (nth = 1) AS s FROM run2 GROUP BY 1) a USING (policy)
LEFT JOIN (SELECT policy, count(*) AS n FROM dra GROUP BY 1) b USING (policy) LEFT JOIN (SELECT policy, count(*) AS n FROM mer GROUP BY 1) c USING (policy) LEFT JOIN (SELECT policy, count(*) AS n FROM epi GROUP BY 1) d USING (policy)""", alerts=True, kept=A.SCORES)
def alert_audit(r: A.Run) -> DataFrame:
    """ALR5's counts."""
    return alerts.episode_audit(*_alerting(r))


@query("SELECT asset, policy, episode, kind FROM cls", alerts=True, kept=A.SCORES)
def alert_kinds(r: A.Run) -> DataFrame:
    """ALR6."""
    return alerts.classified(_alerting(r)[2]["episodes"], r.failures(), A.HORIZON).select("asset", "policy", "episode", "kind")


@query("SELECT *, first_warning_ts IS NOT NULL AS detected, date_sub('second', first_warning_ts, failure_start) AS lead_s FROM evm", alerts=True, kept=A.SCORES)
def alert_event_matches(r: A.Run) -> DataFrame:
    """ALR6."""
    _, policies, found = _alerting(r)
    return alerts.event_matches(found["episodes"], r.failures(), policies, A.HORIZON)


_METRICS = "policy, events, detected, episodes, warnings, insides, false_alerts, operating_days, events - detected AS missed, round(detected / events, 6) AS detection_rate, round(episodes / operating_days, 6) AS episodes_per_day, round(false_alerts / operating_days, 6) AS false_alerts_per_day"


def _metrics(r: A.Run) -> DataFrame:
    points, policies, found = _alerting(r)
    return _rounded(alerts.policy_metrics(points, found["episodes"], r.failures(), policies, A.HORIZON), "detection_rate", "episodes_per_day", "false_alerts_per_day")


@query(f"SELECT {_METRICS} FROM met", alerts=True, kept=A.SCORES)
def alert_metrics(r: A.Run) -> DataFrame:
    """ALR7, PIPE9."""
    return _metrics(r)


@query(f"SELECT {_METRICS} FROM (SELECT *, count(*) OVER () AS c FROM (SELECT *, min(false_alerts) OVER () AS f FROM (SELECT *, max(detected) OVER () AS d FROM met) WHERE detected = d) WHERE false_alerts = f) WHERE c = 1", alerts=True, kept=A.SCORES)
def alert_selection(r: A.Run) -> DataFrame:
    """ALR8."""
    return alerts.select_policy(_metrics(r))


@query("SELECT asset, policy, episode FROM (SELECT *, max(late) OVER (PARTITION BY asset, policy ORDER BY start_ts, episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT *, end_ts + INTERVAL 864000 SECOND AS late FROM epi)) WHERE start_ts <= m OR late < start_ts", alerts=True, kept=A.SCORES)
def alert_order(r: A.Run) -> DataFrame:
    """VAL18: episodes that are made to end ten days late, so that some overlap."""
    late = _alerting(r)[2]["episodes"].withColumn("end_ts", add_seconds(F.col("end_ts"), 864_000))
    return alerts.episode_order(late).select("asset", "policy", "episode")


@query("""
, x AS (SELECT policy, episodes, operating_days, events, detected FROM met)
SELECT 'metrics' AS audited, count(*) AS n_rows, rule, 0::BIGINT AS violations FROM x, (VALUES ('kinds_add_up'), ('events_add_up'), ('rate_in_range'), ('operating_days_in_period')) v(rule) GROUP BY 3
UNION ALL SELECT 'broken metrics', count(*), rule, count(*) FILTER (CASE rule WHEN 'kinds_add_up' THEN policy LIKE '%n1' WHEN 'events_add_up' THEN policy LIKE 'p9%-n2' WHEN 'rate_in_range' THEN false ELSE true END)
FROM x, (VALUES ('kinds_add_up'), ('events_add_up'), ('rate_in_range'), ('operating_days_in_period')) v(rule) GROUP BY 3""", alerts=True, kept=A.SCORES)
def alert_metric_audit(r: A.Run) -> DataFrame:
    """VAL18: the policies' metrics reconcile; metrics broken by rule do not."""
    found = r.steps.keep(_metrics(r).crossJoin(F.broadcast(alerts.most_operating_days(r.score_points()))), "metrics")
    rules = alerts.metric_rules(F.col("most_days"))
    broken = found.withColumns(
        {
            "episodes": F.col("episodes") + F.when(F.col("policy").endswith("n1"), 1).otherwise(0),
            "missed": F.col("missed") + F.when(F.col("policy").endswith("n2"), 1).otherwise(0),
            "operating_days": F.col("most_days") + 1,
        }
    )
    return audit.violations(found, rules, "metrics").unionByName(audit.violations(broken, rules, "broken metrics"))


@query(f"""
, s AS (SELECT probability, l.failure_within AS pos FROM sco JOIN lab l USING (asset, cycle_id) WHERE l.failure_within IS NOT NULL),
g AS (SELECT probability, count(*) AS n, count(*) FILTER (pos) AS pos FROM s GROUP BY 1), c AS (SELECT pos, sum(n) OVER w AS n, sum(pos) OVER w AS tp FROM g WINDOW w AS (ORDER BY probability DESC)),
ap AS (SELECT round(sum(pos * tp / n) / nullif(sum(pos), 0), 6) AS average_precision FROM c),
ld AS (SELECT policy, round(avg(date_sub('second', first_warning_ts, failure_start)), 3) AS warning_lead_time_s FROM evm GROUP BY 1)
SELECT {_METRICS}, warning_lead_time_s, average_precision, (SELECT count(*) FROM s) AS row_count, (SELECT count(*) FROM s WHERE pos) AS positive_count, (SELECT count(*) FROM s WHERE NOT pos) AS negative_count
FROM met JOIN ld USING (policy), ap""", alerts=True, kept=(*A.SCORES, "labelled"))
def population_aggregates(r: A.Run) -> DataFrame:
    """PIPE10: the sixteen aggregates of the scored population under each policy."""
    points, policies, found = _alerting(r)
    scored = r.steps.keep(points.join(r.labelled().where("failure_within is not null").select("asset", "cycle_id", "failure_within"), ["asset", "cycle_id"]), "scored")
    metrics = alerts.policy_metrics(points, found["episodes"], r.failures(), policies, A.HORIZON)
    matches = alerts.event_matches(found["episodes"], r.failures(), policies, A.HORIZON)
    out = _rounded(alerts.aggregates(scored, metrics, matches), "detection_rate", "episodes_per_day", "false_alerts_per_day", "average_precision")
    return out.withColumn("warning_lead_time_s", F.round("warning_lead_time_s", 3))

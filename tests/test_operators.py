"""Boundary cases of single operators on hand-built frames."""

from __future__ import annotations

import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from condmon.operators import alerts, audit, cycles, features, labels, models, profiles, quality, snapshots, windows
from condmon.operators.intervals import points_in_intervals
from condmon.operators.selection import percentiles_of, spreads_of

T0 = dt.datetime(2024, 1, 1)
LOG = "asset long, idx long, ts timestamp_ntz, value double, active byte, record_id string"


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def log(spark, rows):
    return spark.createDataFrame([(a, i, at(s), v, on, f"{a}-{i}") for a, i, s, v, on in rows], LOG).withColumn(quality.REASONS, F.expr("cast(array() as array<string>)"))


def by(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_gap_breaks_a_cycle(spark):
    rows = [(1, 1, 0, 1.0, 1), (1, 2, 10, 1.0, 1), (1, 3, 20, 1.0, 0), (1, 4, 30, 1.0, 0), (1, 5, 40, 1.0, 1), (1, 6, 100, 1.0, 1), (1, 7, 110, 1.0, 0), (1, 9, 120, 1.0, 1)]
    got = by(cycles.derive(quality.sequence(log(spark, rows), "asset", 1, 20)), "start_record_id", "start_type", "stop_record_id", "n_observations", "right_censored", "duration_s")
    assert got[0] == ("1-1", "left_censored", "1-3", 2, False, 20)
    assert got[1] == ("1-5", "observed", None, 1, True, None)
    assert got[2] == ("1-6", "left_censored", "1-7", 1, False, 10)
    assert got[3] == ("1-9", "left_censored", None, 1, True, None)


def test_later_rows_change_no_earlier_cycle(spark):
    rng = random.Random(4)
    rows = [(a, i, 10 * i, 1.0, rng.randint(0, 1)) for a in (1, 2) for i in range(60)]
    derive = lambda r: {x["cycle_id"]: x for x in cycles.derive(quality.sequence(log(spark, r), "asset", 1, 20)).collect()}
    early, late = derive([r for r in rows if r[1] < 40]), derive(rows)
    assert set(early) <= set(late)
    assert all(late[k] == v for k, v in early.items() if not v["right_censored"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 400), st.sampled_from([None, 0, 1])), min_size=1, max_size=60), st.integers(5, 90))
def test_chunked_windows_equal_plain_ones(spark, items, chunk):
    seen, rows = set(), []
    for k, (a, s, v) in enumerate(items):
        if (a, s) not in seen:
            seen.add((a, s))
            rows.append((a, k, at(s), None if v is None else float(v)))
    df = spark.createDataFrame(rows, "asset long, idx long, ts timestamp_ntz, value double")
    rows.sort(key=lambda r: (r[0], r[2]))
    last, previous = {}, {}
    for a in (1, 2):
        held = before = None
        for r in (r for r in rows if r[0] == a):
            held = r[3] if r[3] is not None else held
            last[r[1]], previous[r[1]] = held, before
            before = r[1]
    got = windows.carry_last(df, ["asset"], "ts", ["ts"], F.col("value"), "held", chunk)
    assert {r["idx"]: r["held"] for r in got.collect()} == last
    got = windows.previous_row(df, ["asset"], "ts", ["ts"], ["idx"], "p", chunk)
    assert {r["idx"]: r["p"] and r["p"]["idx"] for r in got.collect()} == previous
    got = windows.running(df, ["asset"], "ts", ["ts"], {"total": ("sum", F.col("value")), "top": ("max", F.col("idx"))}, True, chunk)
    for r in got.collect():
        earlier = [x for x in rows if x[0] == r["asset"] and x[2] < r["ts"]]
        assert (r["total"], r["top"]) == (sum(x[3] or 0 for x in earlier), max((x[1] for x in earlier), default=None))
    got = windows.numbered(df, ["asset"], "ts", ["ts"], "nth", chunk).collect()
    assert {r["idx"]: r["nth"] for r in got} == {x[1]: 1 + sum(y[0] == x[0] and y[2] < x[2] for y in rows) for x in rows}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 300), st.sampled_from([None, 1.0, -2.0, 7.5])), min_size=1, max_size=40), st.lists(st.integers(0, 330), min_size=1, max_size=8), st.integers(2, 120), st.integers(1, 20))
def test_tiles_equal_plain_windows(spark, items, times, seconds, tiles):
    log = spark.createDataFrame([(a, at(s), v) for a, s, v in items], "asset long, ts timestamp_ntz, value double")
    points = spark.createDataFrame([(a, at(t)) for a in (1, 2) for t in times] + [(1, None)], "asset long, t timestamp_ntz")
    aggregates = {"n": ("count", F.col("value")), "low": ("min", F.col("value")), "top": ("max", F.col("value")), "mid": ("mean", F.col("value")), "first": ("min", F.col("ts"))}
    got = {(r["asset"], r["t"]): r for r in windows.trailing(points, "t", log, ["asset"], "ts", seconds, aggregates, tiles).collect()}
    for a in (1, 2):
        for t in set(times):
            inside = [(s, v) for b, s, v in items if b == a and t - seconds < s <= t]
            values = [v for _, v in inside if v is not None]
            r = got.pop((a, at(t)), None)
            assert (r is None) == (not inside)
            if r:
                assert (r["n"], r["low"], r["top"]) == (len(values), min(values, default=None), max(values, default=None))
                assert r["first"] == at(min(s for s, _ in inside)) and r["seen"] == any(s == t for s, _ in inside)
                assert r["mid"] is None if not values else abs(r["mid"] - sum(values) / len(values)) < 1e-9
    assert not got


def test_percentiles_of_small_and_odd_groups(spark):
    rng = random.Random(3)
    rows = [(g, None if rng.random() < 0.1 else float(rng.choice([rng.random(), 1.0, 2.0]))) for g in ("a", "b", None) for _ in range(rng.randint(1, 90))] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["n"], r["p"]) for r in percentiles_of(df, "x", ["g"], (0.0, 0.05, 0.5, 0.99, 1.0)).collect()}
    want = {r["g"]: (r["n"], r["p"]) for r in df.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, (0.0, 0.05, 0.5, 0.99, 1.0)))).alias("p")).collect()}
    assert set(got) == set(want)
    for g, (n, p) in want.items():
        assert got[g][0] == n and (p is None and got[g][1] == [None] * 5 or all(abs(a - b) < 1e-9 for a, b in zip(got[g][1], p)))
    assert percentiles_of(df.where("g = 'none'"), "x", [], (0.5,)).first()["p"] in ([], [None])


def test_percentiles_of_ten_million_rows_in_one_group(spark):
    n = 10_000_000
    # A permutation of 0 to n - 1, with one value put in for a tenth of them.
    x = F.pmod(F.col("id") * 7_368_787 + 12_345, F.lit(n))
    df = spark.range(0, n, 1, 16).select(F.lit("g").alias("g"), F.when(x < n // 10, n // 10).otherwise(x).cast("double").alias("x"))
    shares = (0.0, 0.001, 0.05, 0.5, 0.999, 1.0)
    found = percentiles_of(df, "x", ["g"], shares)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in plan and " percentile(" not in plan
    got = found.first()
    assert got["n"] == n
    for s, p in zip(shares, got["p"]):
        assert abs(p - max(n // 10, s * (n - 1))) < 1e-6, (s, p)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 40), st.booleans()), min_size=1, max_size=120), st.integers(2, 9))
def test_sums_over_ranges_of_values(spark, items, parts):
    df = spark.createDataFrame([(g, v / 4, p) for g, v, p in items], "g string, v double, p boolean").groupBy("g", "v").agg(F.count("*").alias("n"), F.count_if("p").alias("tp"))
    for r in windows.running_down(df, ["g"], "v", ["n", "tp"], parts).collect():
        above = [p for g, v, p in items if g == r["g"] and v / 4 >= r["v"]]
        assert (r["n"], r["tp"]) == (len(above), sum(above))


def test_window_bounds_to_the_microsecond(spark):
    times = [-900.000001, -900, -899.999999, -1, 0, 0.000001]
    df = log(spark, [(1, k, s + 1000, 1.0, 1) for k, s in enumerate(times)])
    points = spark.createDataFrame([(1, "c", at(1000)), (1, "open", None), (1, "unseen", at(5000))], "asset long, cycle_id string, prediction_ts timestamp_ntz")
    got = by(features.signal_window(points, df, "value", 900), "cycle_id", "win_count", "win_status")
    assert got == [("c", 3, "available"), ("open", 0, "missing_prediction_boundary"), ("unseen", 0, "missing_prediction_observation")]


def test_horizon_boundaries(spark):
    names = ["at_start", "at_horizon", "past_horizon", "inside", "censored", "open", "two"]
    stops = [100, 200, 299, 1010, 1950, None, 3000]
    rows = [(k, n, at(0), None if s is None else at(s), s is None) for k, (n, s) in enumerate(zip(names, stops, strict=True))]
    df = spark.createDataFrame(rows, "asset long, cycle_id string, start_ts timestamp_ntz, stop_ts timestamp_ntz, right_censored boolean")
    events = [(0, "e0", 1, at(100), at(150)), (1, "e1", 2, at(300), at(310)), (2, "e2", 3, at(399.000001), at(400)), (3, "e3", 4, at(1000), at(1020)), (3, "e4", 5, at(1050), at(1060)), (6, "b", 7, at(3050), at(3060)), (6, "a", 6, at(3050), at(3051)), (6, "c", 8, at(3040), at(3041))]
    failures = spark.createDataFrame(events, "asset long, record_id string, source_row long, failure_start timestamp_ntz, failure_end timestamp_ntz")
    ends = spark.createDataFrame([(k, at(2000 if k < 6 else 9000)) for k in range(7)], "asset long, label_observation_end timestamp_ntz")
    got = {r["cycle_id"]: (r["horizon_status"], r["matched_record_id"], r["seconds_to_failure"]) for r in labels.label(df, failures, ends, 100).collect()}
    assert got == {
        "at_start": ("inside_failure_interval", None, None),
        "at_horizon": ("positive", "e1", 100),
        "past_horizon": ("negative", None, None),
        "inside": ("inside_failure_interval", None, None),
        "censored": ("horizon_censored", None, None),
        "open": ("missing_prediction_boundary", None, None),
        "two": ("positive", "c", 40),
    }
    checked = labels.label(df, failures, ends, 100)
    assert checked.count() == 7
    assert {r["rule"] for r in audit.violations(checked, audit.horizon_rules(), "l").where("violations > 0").collect()} == set()
    broken = checked.withColumn("failure_within", F.lit(True))
    assert "undecided_has_no_target" in {r["rule"] for r in audit.violations(broken, audit.horizon_rules(), "l").where("violations > 0").collect()}
    assert audit.violating_rows(broken, audit.horizon_rules(), ["cycle_id"]).count() == 5


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 90)), min_size=1, max_size=15), st.lists(st.integers(0, 400), min_size=1, max_size=15), st.integers(1, 120))
def test_interval_join_meets_each_pair_once(spark, spans, times, bin_seconds):
    p = spark.createDataFrame([(1, k, at(t)) for k, t in enumerate(times)], "asset long, p long, ts timestamp_ntz")
    i = spark.createDataFrame([(1, k, at(a), at(a + n)) for k, (a, n) in enumerate(spans)], "asset long, i long, a timestamp_ntz, b timestamp_ntz")
    got = points_in_intervals(p, i, ["asset"], "ts", F.col("a"), F.col("b"), bin_seconds, F.col("ts").between(F.col("a"), F.col("b")))
    assert by(got, "p", "i") == sorted((k, j) for k, t in enumerate(times) for j, (a, n) in enumerate(spans) if a <= t <= a + n)


def loop_episodes(points, threshold, persistence, gap, cooldown):
    streaks, now = [], []
    for p in sorted(points):
        if p[2] >= threshold:
            now.append(p)
        elif now:
            streaks, now = [*streaks, now], []
    streaks += [now] if now else []
    merged = []
    for s in (s for s in streaks if len(s) >= persistence):
        if merged and s[persistence - 1][0] <= merged[-1][1] + gap:
            merged[-1] = (merged[-1][0], max(merged[-1][1], s[-1][0]), merged[-1][2] + len(s))
        else:
            merged.append((s[persistence - 1][0], s[-1][0], len(s)))
    kept = []
    for m in merged:
        if not kept or m[0] >= kept[-1][1] + cooldown:
            kept.append(m)
    return kept


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from([0.1, 0.5, 0.9]), min_size=1, max_size=50), st.integers(1, 3), st.integers(0, 40), st.integers(0, 200), st.sampled_from([15, 60, 10_000]))
def test_episodes_equal_a_loop(spark, scores, persistence, gap, cooldown, chunk):
    points = [(10 * k + (k * k) % 7, f"c{k:03}", s) for k, s in enumerate(scores)]
    df = spark.createDataFrame([(1, c, at(t), s) for t, c, s in points], "asset long, cycle_id string, prediction_ts timestamp_ntz, probability double")
    policies = spark.createDataFrame([("x", 0.5, persistence, gap, cooldown)], "policy string, threshold double, persistence int, merge_gap_s long, cooldown_s long")
    got = [((r["start_ts"] - T0).total_seconds(), (r["end_ts"] - T0).total_seconds(), r["support"]) for r in alerts.episodes(df, policies, chunk_seconds=chunk).orderBy("episode").collect()]
    assert got == loop_episodes(points, 0.5, persistence, gap, cooldown)


def test_long_cooldown_chains(spark):
    """Two hundred episodes in one cluster, of which every third is retained; written rounds of pointers."""
    points = [(10 * k, f"c{k:04}", 0.9 if k % 2 else 0.1) for k in range(400)]
    df = spark.createDataFrame([(a, c, at(t), s) for a in (1, 2) for t, c, s in points], "asset long, cycle_id string, prediction_ts timestamp_ntz, probability double")
    policies = spark.createDataFrame([("x", 0.5, 1, 0, 50), ("y", 0.5, 1, 0, 0)], "policy string, threshold double, persistence int, merge_gap_s long, cooldown_s long")
    got = alerts.episodes(df, policies, chunk_seconds=700).orderBy("asset", "policy", "episode").collect()
    for a in (1, 2):
        for p, cooldown in (("x", 50), ("y", 0)):
            mine = [((r["start_ts"] - T0).total_seconds(), (r["end_ts"] - T0).total_seconds(), r["support"]) for r in got if (r["asset"], r["policy"]) == (a, p)]
            assert mine == loop_episodes(points, 0.5, 1, 0, cooldown)
    plan = alerts.streaks(df, policies)._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan


def test_duplicates_mark_every_member_but_no_null(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (1, None), (1, None)], "asset long, idx long").withColumn(quality.REASONS, F.expr("cast(array() as array<string>)"))
    got = by(quality.duplicate_reasons(df, [["asset", "idx"]]).withColumn("n", F.size(quality.REASONS)).fillna(-1), "asset", "idx", "n")
    assert got == [(1, -1, 0), (1, -1, 0), (1, 5, 1), (1, 5, 1), (2, 5, 0)]


def test_eligibility_fails_closed(spark):
    f = spark.createDataFrame([(1, k, s) for k, s in (("a", "available"), ("b", "available"), ("c", "available"), ("d", "missing_prediction_observation"), ("e", "strange"), ("f", None))], "asset long, cycle_id string, win_status string")
    c = spark.createDataFrame([(1, "a", 5), (1, "b", 20), (1, "d", 1), (1, "c", None)], "asset long, cycle_id string, window_gap_s long")
    got = {r["cycle_id"]: (r["eligibility_status"], list(r["eligibility_reasons"])) for r in features.eligibility(f, c, 20).collect()}
    assert got == {
        "a": ("eligible", []),
        "b": ("ineligible", ["material_window_gap"]),
        "c": ("ineligible", ["missing_or_invalid_coverage_context"]),
        "d": ("ineligible", ["feature_missing_prediction_observation"]),
        "e": ("ineligible", ["unsupported_feature_status"]),
        "f": ("ineligible", ["unsupported_feature_status"]),
    }


def test_selection_wants_one_best(spark):
    rows = [("a", 2, 5), ("b", 3, 9), ("c", 3, 4), ("d", 1, 0)]
    names = "policy string, detected long, false_alerts long"
    assert [r["policy"] for r in alerts.select_policy(spark.createDataFrame(rows, names)).collect()] == ["c"]
    assert alerts.select_policy(spark.createDataFrame([*rows, ("e", 3, 4)], names)).count() == 0
    assert [r["policy"] for r in models.select_best(spark.createDataFrame(rows, names), "false_alerts", largest=False).collect()] == ["d"]


def test_test_rows_are_never_fitted(spark):
    rows = [(1, f"c{k}", at(86_400 * k), "trainable", k % 3 == 0, float(k % 5)) for k in range(30)]
    df = spark.createDataFrame(rows, "asset long, cycle_id string, prediction_ts timestamp_ntz, row_status string, failure_within boolean, x double")
    cut = models.development_rows(df, ["x"], "2024-01-21 00:00:00")
    assert cut.count() == 20
    part = snapshots.partition(F.col("prediction_ts"), "2024-01-11 00:00:00", "2024-01-21 00:00:00")
    train = cut.withColumn("part", part).where("part = 'train'")
    a = models.predict(models.fit(train, ["x"]), df, ["x"]).orderBy("cycle_id").collect()
    changed = df.withColumn("x", F.when(F.col("prediction_ts") >= F.lit("2024-01-21").cast("timestamp_ntz"), 99.0).otherwise(F.col("x")))
    again = models.development_rows(changed, ["x"], "2024-01-21 00:00:00").withColumn("part", part).where("part = 'train'")
    b = models.predict(models.fit(again, ["x"]), df, ["x"]).orderBy("cycle_id").collect()
    assert [r["probability"] for r in a] == [r["probability"] for r in b]


def test_key_coverage(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "k long") for ks in ([1, 2, 2, 3], [2, 3, 4, 4]))
    assert snapshots.key_coverage(a, b, ["k"]).first().asDict() == {"in_both": 2, "only_left": 1, "only_right": 1, "repeated_left": 1, "repeated_right": 1}


def test_points_look_up_only_the_levels_in_use(spark):
    p = spark.createDataFrame([(1, k, at(60 * k)) for k in range(200)], "asset long, p long, ts timestamp_ntz")
    short = [(1, k, at(600 * k), at(600 * k + 180)) for k in range(5)]
    for more, levels in (([], 1), ([(1, 9, at(0), at(6000))], 2)):
        i = spark.createDataFrame(short + more, "asset long, i long, a timestamp_ntz, b timestamp_ntz")
        got = points_in_intervals(p, i, ["asset"], "ts", F.col("a"), F.col("b"), 60, F.col("ts").between(F.col("a"), F.col("b")))
        assert by(got, "p", "i") == sorted((k, j) for k in range(200) for _, j, a, b in short + more if a <= at(60 * k) <= b)
        assert points_in_intervals(p, i, ["asset"], "ts", F.col("a"), F.col("b"), 60, F.lit(True)).select("p", "i").distinct().count() < 2 * got.count() + 60 * levels


def test_long_intervals_take_coarse_bins(spark):
    p = spark.createDataFrame([(1, k, at(86_400 * k)) for k in range(0, 500, 7)], "asset long, p long, ts timestamp_ntz")
    i = spark.createDataFrame([(1, 0, at(0), at(86_400 * 400)), (1, 1, at(100), at(700_000)), (1, 2, None, at(5))], "asset long, i long, a timestamp_ntz, b timestamp_ntz")
    got = points_in_intervals(p, i, ["asset"], "ts", F.col("a"), F.col("b"), 1, F.col("ts").between(F.col("a"), F.col("b")))
    assert by(got, "p", "i") == sorted([(k, 0) for k in range(0, 401, 7)] + [(k, 1) for k in range(7, 9, 7)])


def test_whole_table_rules(spark):
    df = spark.createDataFrame([(1, "v1", "a"), (1, "v1", "b"), (2, "v2", "a"), (3, None, "a")], "k long, v string, w string")
    got = {r["rule"]: r["violations"] for r in audit.table_rules(df, ["k"], ["v"], "t", {"w": "a"}).collect()}
    assert got == {"unique_key": 1, "one_lineage": 3, "w_is_a": 1}
    other = df.where("k > 1").select("k")
    assert audit.same_population(df, other, ["k"], "t").first()["violations"] == 1


def test_average_precision_without_positives(spark):
    df = spark.createDataFrame([("a", 0.5, False), ("b", 0.5, True), ("b", 0.7, False)], "part string, probability double, failure_within boolean")
    assert {r["part"]: r["average_precision"] for r in models.average_precision(df, ["part"]).collect()} == {"a": None, "b": 0.5}


def test_operating_days_are_bounded_by_assets_and_period(spark):
    rules = [alerts.metric_rules(F.col("most_days"))[3]]
    points = spark.createDataFrame([(a, a, at(86_400 * d), 0.5) for a in range(40) for d in range(10)] + [(0, 99, at(86_400 * 10), 0.5)], "asset long, cycle_id long, prediction_ts timestamp_ntz, probability double")
    for some, days, most in ((points, 401, 440), (points.where("asset = 0"), 11, 11), (points.limit(0), 0, 0)):
        bound = alerts.most_operating_days(some)
        assert bound.first()["most_days"] == most
        for operating_days, bad in ((days, 0), (most + 1, 1), (0, int(most > 0))):
            assert audit.violations(bound.withColumn("operating_days", F.lit(operating_days)), rules, "t").first()["violations"] == bad


def nth_of(values, share):
    """The least value that is not below the share (in percent) of all."""
    ordered = sorted(v for v in values if v is not None)
    return ordered[max(-(-len(ordered) * share // 100), 1) - 1] if ordered else None


def test_spreads_are_values_of_their_group(spark):
    rng = random.Random(7)
    rows = [("many", rng.randint(0, 10**6), k) for k in range(90_000)] + [("few", rng.randint(0, 9), None) for _ in range(20)] + [("none", None, None), (None, 5, 1)]
    df = spark.createDataFrame(rows, "g string, x long, y long")
    got = {r["g"]: (r["n"], r["_x"], r["_y"]) for r in spreads_of(df, {"_x": "x", "_y": "y"}, ["g"], (0.05, 0.5, 0.95)).collect()}
    assert set(got) == {"many", "few", "none", None}
    for g, (n, *found) in got.items():
        own = [r for r in rows if r[0] == g]
        assert n == len(own)
        assert found == [[nth_of([r[k] for r in own], share) for share in (5, 50, 95)] for k in (1, 2)]
    empty = spreads_of(df.where("g = 'x'"), {"_x": "x"}, [], (0.5,)).collect()
    assert [(r["n"], r["_x"]) for r in empty] == [(0, None)]


def many_windows(spark, n=200_003):
    """Windows with their rows in plain Python; counts and spans are permutations of one another."""
    columns = {"asset": "id % 97", "cycle_id": "cast(id as string)", "win_count": f"id * 7919 % {n}", "span_s": f"id * 104729 % {n}", "internal_gap_count": "id % 2", "max_internal_gap_s": "if(id % 2 = 1, 86400 + id, null)", "window_gap_s": "if(id % 2 = 1, 86400 + id, 0)"}
    plain = [(k * 7919 % n, k * 104729 % n, k % 2 == 1, 86_400 + k if k % 2 else 0) for k in range(n)]
    return spark.range(n).selectExpr(*[f"{x} as {c}" for c, x in columns.items()]), plain


def test_policies_count_by_exact_bounds(spark):
    df, plain = many_windows(spark)
    label_rows = df.select("asset", "cycle_id", F.when(F.col("span_s") % 2 == 0, "positive").otherwise("negative").alias("horizon_status"))
    policies = [("thin", True, None), ("gap", False, 100_000), ("either", True, 100_000)]
    got = {r["policy"]: (r["kept"], r["excluded"], r["kept_positive"]) for r in profiles.coverage_policies(df, label_rows, profiles.tail_bounds(df), policies).collect()}
    low_c, low_s = (nth_of([r[k] for r in plain], 5) for k in (0, 1))
    for name, tail, gap in policies:
        kept = [s for c, s, _, g in plain if not (tail and (c < low_c or s < low_s) or gap and g >= gap)]
        assert got[name] == (len(kept), len(plain) - len(kept), sum(s % 2 == 0 for s in kept))


def test_tail_overlap_counts_by_exact_bounds(spark):
    df, plain = many_windows(spark)
    got = profiles.tail_overlap(df, profiles.tail_bounds(df)).first().asDict()
    low_c, low_s = (nth_of([r[k] for r in plain], 5) for k in (0, 1))
    marked = [(c < low_c, s < low_s, gap, longest) for c, s, gap, longest in plain]
    gaps = [longest for c, s, gap, longest in marked if gap and not (c or s)]
    assert got == {
        "both": sum(c and s for c, s, _, _ in marked),
        "count_only": sum(c and not s for c, s, _, _ in marked),
        "span_only": sum(s and not c for c, s, _, _ in marked),
        "neither": sum(not (c or s) for c, s, _, _ in marked),
        "gap_and_tail": sum(gap and (c or s) for c, s, gap, _ in marked),
        "gap_only": len(gaps),
        "tail_only": sum(not gap and (c or s) for c, s, gap, _ in marked),
        "count_only_with_gap": sum(gap and c and not s for c, s, gap, _ in marked),
        "gap_only_least_s": min(gaps),
        "gap_only_most_s": max(gaps),
    }


def test_context_profile_gives_exact_percentiles(spark):
    n = 120_011
    times = {"duration": 7919, "previous": 104729, "idle": 15485863}
    view = spark.range(n).selectExpr("if(id % 3 = 0, 'available', 'other') as context_status", f"id * {times['duration']} % {n} as context_duration_s", f"if(id % 2 = 0, id * {times['previous']} % {n}, null) as context_previous_duration_s", f"if(id % 3 = 0, id * {times['idle']} % {n}, null) as context_previous_idle_s")
    got = {r["context_status"]: r for r in profiles.context_profile(view).collect()}
    keys = {"available": range(0, n, 3), "other": [k for k in range(n) if k % 3]}
    assert {s: r["n"] for s, r in got.items()} == {s: len(ks) for s, ks in keys.items()}
    for status, ks in keys.items():
        for name, step, every in (("duration", times["duration"], 1), ("previous", times["previous"], 2), ("idle", times["idle"], 3)):
            assert [got[status][f"{name}_p{q}"] for q in (5, 50, 95)] == [nth_of([k * step % n for k in ks if k % every == 0], q) for q in (5, 50, 95)]


def test_window_support_gives_exact_percentiles(spark):
    df, plain = many_windows(spark)
    expected = {"n": len(plain)} | {f"{name}_p{q}": nth_of([r[k] for r in plain], q) for k, name in enumerate(("count", "span")) for q in (5, 50, 95)}
    assert profiles.support(df).first().asDict() == expected
    assert profiles.support(df.where("asset < 0")).first().asDict() == dict.fromkeys(expected) | {"n": 0}


def test_cycles_of_under_a_second_are_no_violation(spark):
    rows = [(1, 1, 0, 1.0, 0), (1, 2, 10, 1.0, 1), (1, 3, 10.4, 1.0, 0), (1, 4, 15, 1.0, 1), (1, 5, 20, 1.0, 0), (1, 6, 25, 1.0, 1)]
    groups = cycles.inspection_groups(cycles.derive(quality.sequence(log(spark, rows), "asset", 1, 20)), ["asset"])
    assert by(groups.where("not right_censored"), "min_duration_s", "max_duration_s", "n_cycles") == [(0, 5, 2)]
    found = lambda df: {r["rule"]: r["violations"] for r in audit.violations(df, cycles.group_rules(), "t").collect()}
    assert set(found(groups).values()) == {0}
    backward = groups.withColumn("min_duration_s", F.when(~F.col("right_censored"), -1))
    assert {rule for rule, n in found(backward).items() if n} == {"ordered_durations"}


def test_means_add_up_in_the_order_of_the_log(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(0, 100), 2) for _ in range(400)]
    rows = [(1, k, 10 * (k // 2), v, 1) for k, v in enumerate(values)]
    rows[7] = (1, 7, 30, None, 1)
    points = spark.createDataFrame([(1, str(s), at(s)) for s in (0, 45, 400, 1990)] + [(2, "no value", at(0))], "asset long, cycle_id string, prediction_ts timestamp_ntz")
    got = {r["cycle_id"]: r["mean"] for r in features.mean_in_order(points, log(spark, rows).repartition(7), "value", 200, "mean").collect()}
    expected = {}
    for s in (0, 45, 400, 1990):
        own = [v for _, _, t, v, _ in rows if s - 200 < t <= s and v is not None]
        total = 0.0
        for v in own:
            total += v
        expected[str(s)] = total / len(own)
    assert got == expected

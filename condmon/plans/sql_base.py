"""Common table expressions that repeat the adapters and core operators in SQL."""

BASE = r"""
WITH tel0 AS (
  SELECT user_id AS asset, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, ts, value,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS second, (event_type IN ('click', 'view', 'purchase'))::TINYINT AS active,
         'e' || event_id AS record_id, event_id, event_type FROM events),
tel AS (SELECT * EXCLUDE (event_type) FROM tel0 WHERE event_type <> 'signup'),
fail AS (SELECT user_id AS asset, 'f' || event_id AS record_id, event_id AS source_row, ts AS failure_start, ts + INTERVAL 1 HOUR AS failure_end
         FROM events WHERE event_type = 'error' AND value > 60),
seq AS (SELECT t.*, p.idx AS previous_idx, p.ts AS previous_ts, date_sub('second', p.ts, t.ts) AS interval_s,
               coalesce(date_sub('second', p.ts, t.ts) >= 86400, false) AS forward_gap
        FROM tel t LEFT JOIN tel p ON p.asset = t.asset AND p.idx + 1 = t.idx),
flg AS (SELECT s.*, s.active = 1 AS is_active,
               coalesce(s.active = 1 AND p.active = 0 AND NOT s.forward_gap, false) AS is_start,
               coalesce(s.active = 0 AND p.active = 1 AND NOT s.forward_gap, false) AS is_stop,
               s.active = 1 AND (p.active IS NULL OR s.forward_gap) AS is_left_censored
        FROM seq s LEFT JOIN tel p ON p.asset = s.asset AND p.idx = s.previous_idx),
anc AS (SELECT *, last_value(CASE WHEN is_start OR is_left_censored THEN record_id END IGNORE NULLS) OVER w AS anchor,
               last_value(CASE WHEN is_start THEN 'observed' WHEN is_left_censored THEN 'left_censored' END IGNORE NULLS) OVER w AS atype
        FROM flg WINDOW w AS (PARTITION BY asset ORDER BY ts, idx ROWS UNBOUNDED PRECEDING)),
seg AS (SELECT *, sha256('cycle-v1|' || anchor) AS cycle_id FROM anc WHERE (is_active OR is_stop) AND anchor IS NOT NULL),
cyc0 AS (SELECT asset, cycle_id, max(anchor) AS start_record_id, max(atype) AS start_type, max(CASE WHEN record_id = anchor THEN ts END) AS start_ts,
                max(CASE WHEN is_stop THEN record_id END) AS stop_record_id, max(CASE WHEN is_stop THEN ts END) AS stop_ts,
                count(*) FILTER (is_active) AS n_observations FROM seg GROUP BY 1, 2),
cyc AS (SELECT *, stop_ts IS NULL AS right_censored, date_sub('second', start_ts, stop_ts) AS duration_s FROM cyc0),
ctx0 AS (SELECT *, lag(cycle_id) OVER w AS p_id, lag(start_type) OVER w AS p_type, lag(stop_ts) OVER w AS p_stop, lag(duration_s) OVER w AS p_duration
         FROM cyc WINDOW w AS (PARTITION BY asset ORDER BY start_ts, cycle_id)),
ctx1 AS (SELECT *, NOT right_censored AND start_type = 'observed' AS complete, p_type = 'observed' AND p_stop IS NOT NULL AND p_duration IS NOT NULL AS whole,
                date_sub('second', p_stop, start_ts) AS idle FROM ctx0),
ctx AS (SELECT asset, cycle_id, 'cycle-context-v1' AS context_version,
               CASE WHEN right_censored THEN 'missing_prediction_boundary' WHEN start_type = 'left_censored' THEN 'left_censored_current_cycle'
                    WHEN NOT complete THEN 'incomplete_current_cycle' WHEN p_id IS NULL THEN 'missing_previous_cycle'
                    WHEN NOT whole THEN 'incomplete_previous_cycle' WHEN idle < 0 THEN 'invalid_previous_interval' ELSE 'available' END AS context_status,
               CASE WHEN complete THEN duration_s END AS context_duration_s, p_id AS context_previous_cycle_id,
               CASE WHEN whole THEN p_duration END AS context_previous_duration_s, CASE WHEN complete AND idle >= 0 THEN idle END AS context_previous_idle_s
        FROM ctx1),
pts AS (SELECT c.*, 'horizon-v1' AS horizon_version, 172800::BIGINT AS horizon_s, label_observation_end,
               CASE WHEN NOT right_censored THEN stop_ts END AS prediction_ts, CASE WHEN NOT right_censored THEN stop_ts + INTERVAL 172800 SECOND END AS horizon_end
        FROM cyc c JOIN (SELECT asset, max(ts) AS label_observation_end FROM tel GROUP BY 1) USING (asset)),
ins AS (SELECT DISTINCT p.asset, cycle_id FROM pts p JOIN fail f ON p.asset = f.asset AND prediction_ts BETWEEN failure_start AND failure_end),
nxt AS (SELECT p.asset, cycle_id, min({'s': failure_start, 'r': source_row, 'i': record_id, 'e': failure_end}) AS n FROM pts p
        JOIN fail f ON p.asset = f.asset AND failure_start > prediction_ts AND failure_start <= horizon_end AND failure_start <= label_observation_end GROUP BY 1, 2),
lab0 AS (SELECT p.*, CASE WHEN i.cycle_id IS NULL THEN n END AS n,
                CASE WHEN prediction_ts IS NULL THEN 'missing_prediction_boundary' WHEN i.cycle_id IS NOT NULL THEN 'inside_failure_interval'
                     WHEN n IS NOT NULL THEN 'positive' WHEN horizon_end <= label_observation_end THEN 'negative' ELSE 'horizon_censored' END AS horizon_status
         FROM pts p LEFT JOIN ins i USING (asset, cycle_id) LEFT JOIN nxt USING (asset, cycle_id)),
lab AS (SELECT * EXCLUDE (n), CASE horizon_status WHEN 'positive' THEN true WHEN 'negative' THEN false END AS failure_within, n.i AS matched_record_id,
               n.r AS matched_source_row, n.s AS matched_start, n.e AS matched_end, date_sub('second', prediction_ts, n.s) AS seconds_to_failure FROM lab0),
win0 AS (SELECT p.asset, p.cycle_id, p.prediction_ts, count(t.value) AS win_count, min(t.ts) FILTER (t.value IS NOT NULL) AS win_first_ts,
                max(t.ts) FILTER (t.value IS NOT NULL) AS win_last_ts, min(t.value) AS win_min, avg(t.value) AS win_mean, max(t.value) AS win_max,
                bool_or(t.ts = p.prediction_ts) AS seen, count(t.value - t.second) AS diff_count, avg(t.value - t.second) AS diff_mean,
                avg(abs(t.value - t.second)) AS diff_mean_abs, max(abs(t.value - t.second)) AS diff_max_abs
         FROM pts p LEFT JOIN tel t ON t.asset = p.asset AND t.ts > p.prediction_ts - INTERVAL 259200 SECOND AND t.ts <= p.prediction_ts GROUP BY 1, 2, 3),
win AS (SELECT *, CASE WHEN prediction_ts IS NULL THEN 'missing_prediction_boundary' WHEN NOT coalesce(seen, false) THEN 'missing_prediction_observation'
                       ELSE 'available' END AS win_status, prediction_ts - INTERVAL 259200 SECOND AS win_window_start FROM win0),
cov AS (SELECT w.*, date_sub('second', win_first_ts, win_last_ts) AS span_s, date_sub('second', win_window_start, win_first_ts) AS lead_s,
               s.forward_gap AS first_follows_gap, s.interval_s AS preceding_interval_s,
               (SELECT count(*) FROM seq g WHERE g.asset = w.asset AND g.forward_gap AND g.ts > w.win_first_ts AND g.ts <= w.prediction_ts) AS internal_gap_count,
               (SELECT max(g.interval_s) FROM seq g WHERE g.asset = w.asset AND g.forward_gap AND g.ts > w.win_first_ts AND g.ts <= w.prediction_ts) AS max_internal_gap_s
        FROM win w LEFT JOIN seq s ON s.asset = w.asset AND s.ts = w.win_first_ts WHERE win_status = 'available'),
eli0 AS (SELECT w.*, c.cycle_id IS NOT NULL AND c.lead_s >= 0 AND c.first_follows_gap IS NOT NULL AS valid,
                greatest(CASE WHEN c.first_follows_gap THEN c.lead_s ELSE 0 END, coalesce(c.max_internal_gap_s, 0)) AS longest
         FROM win w LEFT JOIN cov c USING (asset, cycle_id)),
eli AS (SELECT *, CASE WHEN win_status = 'available' AND valid THEN longest END AS max_window_gap_s,
               CASE WHEN win_status = 'available' AND valid AND longest < 86400 THEN 'eligible' ELSE 'ineligible' END AS eligibility_status,
               CASE WHEN win_status = 'missing_prediction_boundary' THEN 'feature_missing_prediction_boundary'
                    WHEN win_status = 'missing_prediction_observation' THEN 'feature_missing_prediction_observation'
                    WHEN NOT coalesce(valid, false) THEN 'missing_or_invalid_coverage_context' WHEN longest >= 86400 THEN 'material_window_gap' ELSE '' END AS eligibility_reasons
        FROM eli0),
vw0 AS (SELECT e.asset, e.cycle_id, e.prediction_ts, e.win_status, e.win_count, e.win_mean, e.eligibility_status, l.horizon_status, l.failure_within, l.matched_record_id,
               l.seconds_to_failure, c.context_status, c.context_duration_s, c.context_previous_idle_s, c.context_previous_duration_s
        FROM eli e JOIN lab l USING (asset, cycle_id) JOIN ctx c USING (asset, cycle_id)),
vw AS (SELECT *, CASE WHEN eligibility_status = 'eligible' AND horizon_status IN ('positive', 'negative') AND context_status = 'available' THEN 'trainable' ELSE 'excluded' END AS row_status,
              array_to_string(list_filter([CASE WHEN eligibility_status = 'ineligible' THEN 'feature_ineligible' END,
                CASE WHEN horizon_status = 'horizon_censored' THEN 'horizon_censored' END, CASE WHEN horizon_status = 'inside_failure_interval' THEN 'inside_failure_interval' END,
                CASE WHEN horizon_status = 'missing_prediction_boundary' THEN 'missing_prediction_boundary' END,
                CASE WHEN context_status <> 'available' THEN 'cycle_context_unavailable' END], lambda x: x IS NOT NULL), ',') AS exclusion_reasons,
              CASE WHEN prediction_ts < TIMESTAMP '2024-01-15' THEN 'train' WHEN prediction_ts < TIMESTAMP '2024-01-22' THEN 'validation'
                   WHEN prediction_ts IS NOT NULL THEN 'test' END AS part FROM vw0),
bnds AS (SELECT quantile_disc(win_count, 0.05) AS low_count, quantile_disc(span_s, 0.05) AS low_span FROM cov),
raw AS (SELECT asset, record_id, event_id,
               CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 1 ELSE idx END AS idx,
               CASE WHEN event_id % 83 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ts,
               CASE WHEN event_id % 79 = 0 OR event_id % 73 = 0 THEN NULL ELSE value END AS value,
               CASE WHEN event_id % 71 = 0 THEN 2 ELSE active END AS active_number, event_id % 67 = 0 AS corrupt, 'src' || (asset % 3) AS source FROM tel),
raw2 AS (SELECT *, idx IS NOT NULL AND count(*) OVER (PARTITION BY asset, idx) > 1 AS dup_idx, ts IS NOT NULL AND count(*) OVER (PARTITION BY asset, ts) > 1 AS dup_ts FROM raw),
raw3 AS (SELECT *, CASE WHEN idx IS NOT NULL AND ts IS NOT NULL AND NOT dup_idx AND NOT dup_ts THEN idx END AS fit FROM raw2),
ann AS (SELECT r.*, p.ts AS previous_ts, date_sub('second', p.ts, r.ts) AS interval_s, coalesce(date_sub('second', p.ts, r.ts) >= 86400, false) AS forward_gap,
               list_filter([CASE WHEN r.corrupt THEN 'malformed_csv' END, CASE WHEN r.idx IS NULL THEN 'invalid_idx' END, CASE WHEN r.ts IS NULL THEN 'invalid_ts' END,
                 CASE WHEN r.value IS NULL THEN 'invalid_value' END, CASE WHEN r.value NOT BETWEEN 0 AND 450 THEN 'out_of_range_value' END,
                 CASE WHEN r.active_number NOT IN (0, 1) THEN 'invalid_domain_active' END, CASE WHEN r.dup_idx THEN 'duplicate_idx' END,
                 CASE WHEN r.dup_ts THEN 'duplicate_ts' END, CASE WHEN date_sub('second', p.ts, r.ts) < 0 THEN 'out_of_order_ts' END], lambda x: x IS NOT NULL) AS reasons
        FROM raw3 r LEFT JOIN raw3 p ON p.asset = r.asset AND p.fit + 1 = r.fit),
sco AS (SELECT asset, cycle_id, prediction_ts, least(round(win_mean / 500, 9), 1.0) AS probability FROM win WHERE win_status = 'available' AND win_mean IS NOT NULL),
cut AS (SELECT quantile_cont(probability, [0.9, 0.95, 0.99]) AS t FROM sco),
pol AS (SELECT name || '-n' || n AS policy, t[k] AS threshold, n AS persistence FROM cut, (VALUES (1, 'p90'), (2, 'p95'), (3, 'p99')) s(k, name), (VALUES (1), (2)) m(n)),
run AS (SELECT s.*, policy, persistence, probability >= threshold AS over,
               sum((probability < threshold)::INT) OVER (PARTITION BY asset, policy ORDER BY prediction_ts, cycle_id ROWS UNBOUNDED PRECEDING) AS run FROM sco s, pol),
run2 AS (SELECT *, row_number() OVER (PARTITION BY asset, policy, run ORDER BY prediction_ts, cycle_id) AS nth FROM run WHERE over),
dra AS (SELECT asset, policy, min({'t': prediction_ts, 'c': cycle_id}) FILTER (nth >= persistence) AS s, max({'t': prediction_ts, 'c': cycle_id}) AS e, count(*) AS support,
               count(*) - persistence + 1 AS alert_points, max(probability) AS peak FROM run2 GROUP BY asset, policy, run, persistence HAVING count(*) >= persistence),
mer0 AS (SELECT *, coalesce(s.t > max(e.t) OVER (PARTITION BY asset, policy ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 86400 SECOND, true)::INT AS fresh FROM dra),
mer1 AS (SELECT *, sum(fresh) OVER (PARTITION BY asset, policy ORDER BY s ROWS UNBOUNDED PRECEDING) AS grp FROM mer0),
mer AS (SELECT asset, policy, grp, min(s) AS s, max(e) AS e, sum(support)::BIGINT AS support, sum(alert_points)::BIGINT AS alert_points, count(*) AS n_streaks, max(peak) AS peak FROM mer1 GROUP BY 1, 2, 3),
"""

#: Greedy cooldown: walks the merged episodes of each asset and policy in order.
COOLDOWN = r"""
cool AS (
  WITH RECURSIVE walk AS (
    SELECT asset, policy, grp, true AS kept, e.t AS last_end FROM mer WHERE grp = 1
    UNION ALL
    SELECT m.asset, m.policy, m.grp, m.s.t >= w.last_end + INTERVAL 172800 SECOND, CASE WHEN m.s.t >= w.last_end + INTERVAL 172800 SECOND THEN m.e.t ELSE w.last_end END
    FROM walk w JOIN mer m ON m.asset = w.asset AND m.policy = w.policy AND m.grp = w.grp + 1)
  SELECT * FROM walk),
epi AS (SELECT m.asset, m.policy, row_number() OVER (PARTITION BY m.asset, m.policy ORDER BY m.s) AS episode, s.c AS start_cycle_id, s.t AS start_ts, e.c AS end_cycle_id, e.t AS end_ts,
               support, alert_points, n_streaks, peak FROM mer m JOIN cool USING (asset, policy, grp) WHERE kept),
cls AS (SELECT e.*, CASE WHEN EXISTS (SELECT 1 FROM fail f WHERE f.asset = e.asset AND start_ts >= failure_start - INTERVAL 172800 SECOND AND start_ts < failure_start) THEN 'warning'
                         WHEN EXISTS (SELECT 1 FROM fail f WHERE f.asset = e.asset AND start_ts BETWEEN failure_start AND failure_end) THEN 'inside' ELSE 'false_alert' END AS kind FROM epi e),
evm AS (SELECT f.asset, p.policy, f.record_id, f.failure_start, min(e.start_ts) AS first_warning_ts, count(e.episode) AS n_warnings
        FROM fail f CROSS JOIN pol p LEFT JOIN epi e ON e.asset = f.asset AND e.policy = p.policy AND e.start_ts >= f.failure_start - INTERVAL 172800 SECOND AND e.start_ts < f.failure_start
        GROUP BY 1, 2, 3, 4),
met AS (SELECT p.policy, coalesce(ev.events, 0) AS events, coalesce(ev.detected, 0) AS detected, coalesce(k.episodes, 0) AS episodes, coalesce(k.warnings, 0) AS warnings,
               coalesce(k.insides, 0) AS insides, coalesce(k.false_alerts, 0) AS false_alerts, (SELECT count(DISTINCT (asset, prediction_ts::DATE)) FROM sco) AS operating_days
        FROM pol p LEFT JOIN (SELECT policy, count(*) AS events, count(*) FILTER (first_warning_ts IS NOT NULL) AS detected FROM evm GROUP BY 1) ev USING (policy)
        LEFT JOIN (SELECT policy, count(*) AS episodes, count(*) FILTER (kind = 'warning') AS warnings, count(*) FILTER (kind = 'inside') AS insides,
                          count(*) FILTER (kind = 'false_alert') AS false_alerts FROM cls GROUP BY 1) k USING (policy)),
"""


def with_base(body: str, alerts: bool = False) -> str:
    return (BASE + (COOLDOWN if alerts else "")).rstrip().rstrip(",") + "\n" + body

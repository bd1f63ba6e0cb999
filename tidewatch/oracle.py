"""The same queries as SQL that DuckDB runs on the same tables.

A query names the common table expressions that it needs; ``_with`` puts them before it with what they need themselves.
"""

from __future__ import annotations

import re

from tidewatch.config import Fusion, Rate
from tidewatch.functions import logs
from tidewatch.queries import CHANGE, DEDUP, DRIFT, EMIT, END, HALFLIFE, NOW, SECONDS, START, TICK
from tidewatch.sources.telemetry import TELEMETRY_SQL

A = Rate().alpha
B = 1.0 - A
D = DRIFT
FU = Fusion()


def R(x: str, d: int) -> str:
    return f"(floor(({x}) * {float(10**d)} + 0.5) / {float(10**d)})"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


S = SECONDS
CTE: dict[str, str] = {"tele": TELEMETRY_SQL}

_AGG = """count(*) AS event_count, CAST(sum(payload_bytes) AS BIGINT) AS payload_sum, sum(abs(amount)) AS amount_sum, count(amount) AS amount_n,
  count(*) FILTER (error) AS error_count, count(*) FILTER (is_malformed) AS malformed_count, min(row(t, event_id, rep)) AS first"""
CTE["grain"] = f"""grain AS (
  SELECT CAST(t // {S} * {S} AS BIGINT) AS bucket, 'global' AS entity_type, 'global' AS entity_id, {_AGG} FROM tele GROUP BY 1
  UNION ALL SELECT CAST(t // {S} * {S} AS BIGINT), 'payer', payer_id, {_AGG} FROM tele WHERE payer_id IS NOT NULL GROUP BY 1, 3
  UNION ALL SELECT CAST(t // {S} * {S} AS BIGINT), 'client_ip', client_ip, {_AGG} FROM tele WHERE client_ip IS NOT NULL GROUP BY 1, 3)"""
CTE["feat"] = f"""feat AS (
  SELECT *, {R('payload_sum / event_count', 1)} AS mean_payload, CASE WHEN amount_n > 0 THEN {R('amount_sum / amount_n', 2)} ELSE 0.0 END AS mean_amount,
    {R('error_count / event_count', 4)} AS error_ratio FROM grain)"""
_M = "event_count mean_payload error_ratio".split()
CTE["ew_mean"] = (
    f"ew_rows AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY bucket) AS i FROM feat WHERE entity_type <> 'client_ip'), ew_mean AS (SELECT *, "
    + ", ".join(f"pow({B!r}, i) * sum(CASE WHEN i = 1 THEN {m} / {B!r} ELSE {A!r} * {m} * pow({B!r}, -i) END) OVER w AS {m}_mean" for m in _M)
    + " FROM ew_rows WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY i)), ew_delta AS (SELECT *, "
    + ", ".join(f"CASE WHEN i > 1 THEN {m} - lag({m}_mean) OVER w END AS {m}_d" for m in _M)
    + " FROM ew_mean WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY i)), ew AS (SELECT *, "
    + ", ".join(f"coalesce(pow({B!r}, i) * sum(CASE WHEN i > 1 THEN {A!r} * {m}_d * {m}_d * pow({B!r}, -(i - 1)) END) OVER w, 0.0) AS {m}_var" for m in _M)
    + " FROM ew_delta WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY i))"
)
_FLOOR = {"event_count": "greatest(1.0, 0.1 * m)", "mean_payload": "greatest(20.0, 0.1 * m)", "error_ratio": "0.05"}


def _z(m: str) -> str:
    mean, var = f"lag({m}_mean) OVER w", f"lag({m}_var) OVER w"
    return f"CASE WHEN i <= 2 THEN 0.0 ELSE ({m} - {mean}) / greatest(sqrt(greatest({var}, 0.0)), {_FLOOR[m].replace('m)', f'({mean}))')}) END AS {m}_z"


CTE["zs"] = f"zs AS (SELECT *, i - 1 AS n, {', '.join(map(_z, _M))} FROM ew WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY i))"
CTE["rate_score"] = f"""rate_flag AS (
  SELECT *, CASE WHEN event_count_z > 3 THEN 'rate_spike' WHEN mean_payload_z > 3 THEN 'payload_anomaly' WHEN error_ratio_z > 3 THEN 'error_ratio_spike' END AS alert_type, n < 15 AS warming_up,
    {R("greatest(CASE WHEN event_count_z > 3 THEN least(1.0, event_count_z / 6) ELSE 0.0 END, CASE WHEN mean_payload_z > 3 THEN least(1.0, mean_payload_z / 6) ELSE 0.0 END, CASE WHEN error_ratio_z > 3 THEN least(1.0, error_ratio_z / 6) ELSE 0.0 END)", 4)} AS score,
    concat_ws('; ', CASE WHEN event_count_z > 3 THEN printf('rate_z=%.1f>3', event_count_z) END, CASE WHEN mean_payload_z > 3 THEN printf('payload_z=%.1f>3', mean_payload_z) END,
      CASE WHEN error_ratio_z > 3 THEN printf('error_ratio_z=%.1f>3', error_ratio_z) END) AS reasons
  FROM zs), rate_score AS (
  SELECT *, alert_type IS NOT NULL AND n >= 15 AS is_anomalous FROM rate_flag
  WHERE entity_type = 'global' OR (alert_type IS NOT NULL AND n >= 15) OR event_count >= 3)"""
CTE["cohort"] = f"""ip_rows AS (
  SELECT bucket, entity_id, event_count, first, row_number() OVER (ORDER BY bucket, first, entity_id) AS i FROM feat WHERE entity_type = 'client_ip'
), ip_mean AS (SELECT *, pow({B!r}, i) * sum(CASE WHEN i = 1 THEN event_count / {B!r} ELSE {A!r} * event_count * pow({B!r}, -i) END) OVER (ORDER BY i) AS m FROM ip_rows
), ip_delta AS (SELECT *, CASE WHEN i > 1 THEN event_count - lag(m) OVER (ORDER BY i) END AS d FROM ip_mean
), ip_ew AS (SELECT *, coalesce(pow({B!r}, i) * sum(CASE WHEN i > 1 THEN {A!r} * d * d * pow({B!r}, -(i - 1)) END) OVER (ORDER BY i), 0.0) AS v FROM ip_delta
), ip_last AS (SELECT bucket, max(i) AS n, max_by(m, i) AS mean, max_by(v, i) AS var FROM ip_ew GROUP BY 1
), cohort AS (SELECT bucket, coalesce(lag(n) OVER w, 0) AS n, coalesce(lag(mean) OVER w, 0.0) AS mean, coalesce(lag(var) OVER w, 0.0) AS var FROM ip_last WINDOW w AS (ORDER BY bucket))"""
CTE["cohort_score"] = f"""cohort_z AS (
  SELECT f.*, c.n, CASE WHEN c.n < 2 THEN 0.0 ELSE (event_count - mean) / greatest(sqrt(var), 1.0, 0.5 * mean) END AS z FROM feat f JOIN cohort c USING (bucket) WHERE entity_type = 'client_ip'
), cohort_score AS (SELECT *, {R('least(1.0, abs(z) / 6)', 4)} AS score FROM cohort_z WHERE z > 3 AND event_count >= 10 AND n >= 150)"""
CTE["rate_docs"] = f"""rate_docs AS (
  SELECT bucket, entity_type, entity_id, event_count, score, alert_type, reasons, is_anomalous, first, 'rate' AS model, bucket + {S} AS t FROM rate_score
  UNION ALL SELECT bucket, 'client_ip', entity_id, event_count, score, 'rate_spike', printf('cohort_rate_z=%.1f>3', z), true, first, 'rate', bucket + {S} FROM cohort_score)"""


def _severity(x: str = "score") -> str:
    return f"CASE WHEN {x} >= 0.9 THEN 'high' WHEN {x} >= 0.65 THEN 'medium' ELSE 'low' END"


CTE["rate_alerts"] = f"""rate_alerts AS (SELECT * FROM (
  SELECT t, alert_type, {_severity()} AS severity, entity_type, entity_id, score, model AS source, printf('%s for %s %s scored %.2f (%d events)', alert_type, entity_type, entity_id, score, event_count) AS summary,
    row_number() OVER (PARTITION BY bucket ORDER BY score DESC, CASE entity_type WHEN 'global' THEN 0 WHEN 'payer' THEN 1 ELSE 2 END, first, entity_id) AS rank
  FROM rate_docs WHERE is_anomalous AND alert_type IS NOT NULL AND event_count >= 10) WHERE rank <= 5)"""

_G = _quoted(logs.GATEWAY)
_part = lambda i: f"regexp_extract(log_message, {_G}, {i})"
_masked = f'method || \' \' || path || \' \' || code || \' "\' || msg || \'"\''
for _p, _m in logs.MASKS:
    _masked = f"regexp_replace({_masked}, {_quoted(_p)}, '{_m}', 'g')"
CTE["line"] = f"""line_parts AS (
  SELECT *, {_part(1)} AS log_ip, nullif({_part(2)}, '-') AS log_payer, {_part(4)} AS method, {_part(5)} AS path, CAST({_part(6)} AS INTEGER) AS code,
    CAST({_part(7)} AS BIGINT) AS nbytes, CAST({_part(8)} AS BIGINT) AS latency, {_part(9)} AS msg
  FROM tele WHERE client_ip IS NOT NULL AND regexp_matches(log_message, {_G})
), line_family AS (
  SELECT *, CASE WHEN regexp_matches(path, {_quoted(logs.TRAVERSAL)}) THEN 'path_traversal' WHEN regexp_matches(path, {_quoted(logs.SQLI)}) THEN 'sqli_probe'
    WHEN regexp_matches(path, {_quoted(logs.SCANNER)}) THEN 'scanner_probe' WHEN code = 401 OR starts_with(msg, 'authentication failed') THEN 'auth_failure'
    WHEN path = '{logs.ROUTE}' AND code = 402 THEN 'declined' WHEN path = '{logs.ROUTE}' AND code = 400 THEN 'schema_reject' WHEN path = '{logs.ROUTE}' THEN 'route'
    WHEN regexp_matches(path, {_quoted(logs.BALANCE)}) THEN 'balance' WHEN regexp_matches(path, {_quoted(logs.STATUS)}) THEN 'status'
    WHEN regexp_matches(path, {_quoted(logs.SETTLEMENT)}) THEN 'settlement' ELSE 'other' END AS family, {_masked} AS template
  FROM line_parts
), line AS (
  SELECT *, CASE WHEN family IN ('sqli_probe', 'path_traversal', 'scanner_probe') THEN 2 WHEN family = 'auth_failure' OR (family = 'other' AND code >= 400) THEN 1 ELSE 0 END AS level FROM line_family)"""
_n = lambda f: f"count(*) FILTER (family = '{f}')"
CTE["win"] = f"""win_counts AS (
  SELECT CAST(t // {S} * {S} AS BIGINT) AS bucket, client_ip, count(*) AS window_events, count(DISTINCT template) AS distinct_templates, {_n('sqli_probe')} AS n_sqli, {_n('path_traversal')} AS n_traversal,
    {_n('auth_failure')} AS n_auth_fail, {_n('scanner_probe')} AS n_scanner, {_n('schema_reject')} AS n_schema_reject, {_n('other')} AS n_other,
    count(*) FILTER (family = 'other' AND level = 1) AS n_suspicious_other, count(*) FILTER (family IN ('route', 'declined', 'balance', 'status', 'settlement')) AS benign_n,
    count(*) FILTER (code >= 400) AS err_n, min(row(t, event_id, rep)) AS first,
    max(CASE WHEN family = 'auth_failure' THEN coalesce(TRY_CAST(nullif(regexp_extract(msg, '\\(attempt (\\d+)\\)', 1), '') AS INTEGER), 0) ELSE 0 END) AS max_auth_attempt
  FROM line GROUP BY 1, 2
), win AS (
  SELECT *, benign_n / window_events AS benign_ratio, n_auth_fail / window_events AS auth_fail_ratio, err_n / window_events AS err_4xx_ratio,
    CASE WHEN n_sqli + n_traversal + n_scanner > 0 OR n_auth_fail >= 3 THEN 2 WHEN n_auth_fail > 0 OR n_suspicious_other > 0 THEN 1 ELSE 0 END AS rule_level FROM win_counts)"""
_count = lambda f, c: f"CASE WHEN {c} > 0 THEN printf('template={f} count=%d', {c}) END"
CTE["content_score"] = f"""content_all AS (
  SELECT *, CASE rule_level WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS model_score, rule_level = 2 AS is_anomalous FROM win
), content_score AS (
  SELECT *, {R("CASE WHEN rule_level = 2 THEN greatest(model_score, least(1.0, 0.85 + 0.03 * (n_sqli + n_traversal + n_scanner + CASE WHEN n_auth_fail >= 3 THEN n_auth_fail ELSE 0 END))) ELSE model_score END", 4)} AS score,
    concat_ws('; ', {_count('sqli_probe', 'n_sqli')}, {_count('path_traversal', 'n_traversal')}, {_count('scanner_probe', 'n_scanner')}, {_count('auth_failure', 'n_auth_fail')}, {_count('other', 'n_suspicious_other')},
      CASE WHEN auth_fail_ratio > 0 THEN printf('auth_fail_ratio=%.2f', auth_fail_ratio) END, CASE WHEN NOT is_anomalous AND model_score >= 0.4 THEN printf('model=suspicious score=%.2f', model_score) END) AS reasons
  FROM content_all WHERE is_anomalous OR rule_level >= 1 OR window_events >= 3)"""
CTE["content_docs"] = f"""content_docs AS (
  SELECT bucket, 'client_ip' AS entity_type, client_ip AS entity_id, CAST(NULL AS BIGINT) AS event_count, score, 'log_classification' AS alert_type, reasons, is_anomalous, first, 'content' AS model, bucket + {S} AS t FROM content_score)"""
CTE["content_alerts"] = f"""content_alerts AS (SELECT * FROM (
  SELECT t, alert_type, {_severity()} AS severity, entity_type, entity_id, score, model AS source, printf('log content of %s scored %.2f', entity_id, score) AS summary,
    row_number() OVER (PARTITION BY bucket ORDER BY score DESC, first, entity_id) AS rank FROM content_docs WHERE is_anomalous) WHERE rank <= 5)"""


def _payers(name: str, seconds: int, cap: float) -> str:
    return f"""{name} AS (SELECT CAST(t // {seconds} * {seconds} AS BIGINT) AS bucket, payer_id AS payer, count(*) AS event_count, sum(least(abs(amount), {cap})) AS amount_sum, count(DISTINCT payee_id) AS distinct_payees
  FROM tele WHERE payer_id IS NOT NULL GROUP BY 1, 2)"""


def _grid(name: str, payers: str) -> str:
    return f"""{name} AS (SELECT f.payer, b.bucket, coalesce(p.event_count, 0) AS event_count, coalesce(p.amount_sum, 0.0) AS amount_sum, coalesce(p.distinct_payees, 0) AS distinct_payees
  FROM (SELECT payer, min(bucket) AS first FROM {payers} GROUP BY 1) f JOIN (SELECT DISTINCT bucket FROM {payers}) b ON b.bucket >= f.first LEFT JOIN {payers} p ON p.payer = f.payer AND p.bucket = b.bucket)"""


CTE["grid"] = _payers("payer_all", S, 1e6) + ", " + _grid("grid", "payer_all")
CTE["day_grid"] = _payers("payer_day", 86400, 1e6) + ", " + _grid("day_grid", "payer_day")


def _chart(x: str, floor: str, m: str) -> tuple[str, str, str]:
    """z, S and whether the baseline learns, from the previous row's p.<name>_<m>."""
    z = f"CASE WHEN p.n_{m} >= 2 THEN greatest(-3.0, least(3.0, ({x} - p.mean_{m}) / greatest(sqrt(greatest(p.var_{m}, 0.0)), {floor}))) ELSE 0.0 END"
    s = f"CASE WHEN c.i < 30 THEN 0.0 ELSE least(greatest(0.0, p.s_{m} + ({z}) - 0.75), 12.0) END"
    return z, s, f"(c.i < 30 OR ({s}) < 5.0)"


def _drift() -> str:
    slow, fast = 1 - 0.5 ** (1 / 240), 1 - 0.5 ** (1 / 5)
    series = {"v": ("CAST(c.event_count AS DOUBLE)", "greatest(1.0, sqrt(greatest(p.mean_v, 0.25)))"), "a": ("c.amount_sum", f"greatest({D.amount_floor}, 0.35 * p.mean_a)")}
    first, step = [], []
    for m, (x, floor) in series.items():
        first.append(f"1 AS n_{m}, {x.replace('c.', '')} AS mean_{m}, 0.0::DOUBLE AS var_{m}, 0.0::DOUBLE AS s_{m}, 0 AS run_{m}, 0.0::DOUBLE AS e_{m}, CAST(NULL AS BIGINT) AS since_{m}")
        z, s, learn = _chart(x, floor, m)
        rate = f"CASE WHEN p.n_{m} + 1 <= 30 THEN 1.0 / (p.n_{m} + 1) ELSE {slow!r} END"
        d = f"({x} - p.mean_{m})"
        step.append(
            f"CASE WHEN {learn} THEN p.n_{m} + 1 ELSE p.n_{m} END, CASE WHEN {learn} THEN p.mean_{m} + ({rate}) * {d} ELSE p.mean_{m} END, "
            f"CASE WHEN {learn} THEN (1.0 - ({rate})) * (p.var_{m} + ({rate}) * {d} * {d}) ELSE p.var_{m} END, {s}, CASE WHEN ({s}) > 0 THEN p.run_{m} + 1 ELSE 0 END, "
            f"p.e_{m} + {fast!r} * (({z}) - p.e_{m}), CASE WHEN ({s}) > 0 THEN coalesce(p.since_{m}, c.bucket) END"
        )
    return f"""cells AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY payer ORDER BY bucket) AS i FROM grid
), fold AS (
  SELECT payer, bucket, i, event_count, amount_sum, {', '.join(first)} FROM cells WHERE i = 1
  UNION ALL SELECT c.payer, c.bucket, c.i, c.event_count, c.amount_sum, {', '.join(step)} FROM fold p JOIN cells c ON c.payer = p.payer AND c.i = p.i + 1
), fold_start AS (SELECT *, least(since_v, since_a) AS opened, coalesce(least(since_v, since_a), bucket) AS window_start FROM fold
), fold_run AS (SELECT *, count(*) FILTER (opened IS NULL OR opened = bucket) OVER (PARTITION BY payer ORDER BY i) AS episode FROM fold_start
), drift AS (
  SELECT payer, bucket, i, s_v AS s_volume, s_a AS s_amount, run_v AS run_volume, run_a AS run_amount, e_v AS ewma_volume, e_a AS ewma_amount, mean_v AS mean_volume, mean_a AS mean_amount, window_start,
    CASE WHEN opened IS NULL THEN 0 ELSE CAST(sum(event_count) OVER w AS BIGINT) END AS exc_events, CASE WHEN opened IS NULL THEN 0.0 ELSE sum(amount_sum) OVER w END AS exc_amount,
    {R('least(1.0, greatest(s_v, s_a) / 12.0)', 4)} AS score,
    i >= 30 AND ((s_v >= 6 AND run_v >= 6 AND e_v >= 0.9 AND s_a >= 6 AND run_a >= 6 AND e_a >= 0.9) OR (s_v >= 10 AND run_v >= 6 AND e_v >= 0.9)) AS is_anomalous
  FROM fold_run WINDOW w AS (PARTITION BY payer, episode ORDER BY i))"""


CTE["drift"] = _drift()
CTE["drift_docs"] = f"""drift_docs AS (
  SELECT bucket, 'payer' AS entity_type, payer AS entity_id, CAST(NULL AS BIGINT) AS event_count, score, 'slow_exfiltration' AS alert_type, 'cusum' AS reasons, is_anomalous, 'drift' AS model, bucket + {S} AS t
  FROM drift WHERE is_anomalous OR greatest(s_volume, s_amount) >= 2)"""
CTE["drift_alerts"] = f"""drift_alerts AS (SELECT * FROM (
  SELECT bucket + {S} AS t, 'slow_exfiltration' AS alert_type, {_severity()} AS severity, 'payer' AS entity_type, payer AS entity_id, score, 'drift' AS source, '' AS summary,
    row_number() OVER (PARTITION BY bucket ORDER BY score DESC, payer) AS rank FROM drift WHERE is_anomalous) WHERE rank <= 5)"""
CTE["docs"] = """docs AS (
  SELECT bucket, entity_type, entity_id, event_count, score, alert_type, reasons, is_anomalous, model, t FROM rate_docs
  UNION ALL SELECT bucket, entity_type, entity_id, event_count, score, alert_type, reasons, is_anomalous, model, t FROM content_docs
  UNION ALL SELECT bucket, entity_type, entity_id, event_count, score, alert_type, reasons, is_anomalous, model, t FROM drift_docs)"""
CTE["gated"] = "gated AS (SELECT *, CASE WHEN NOT is_anomalous OR score <= 0 THEN 'benign' WHEN event_count < 10 THEN 'below_floor' ELSE 'folded' END AS disposition FROM docs)"
CTE["hits"] = """hits AS (
  SELECT *, weight * least(score, 1.0) AS claim,
    CASE WHEN reasons LIKE 'rate_z%' OR reasons LIKE 'cohort_rate_z%' THEN 'rate_spike' WHEN reasons LIKE 'payload_z%' THEN 'payload_anomaly' WHEN reasons LIKE 'error_ratio%' THEN 'error_ratio_spike'
      WHEN reasons LIKE 'template=%' THEN regexp_extract(reasons, '^template=(\\S*)', 1) WHEN reasons LIKE 'cusum%' THEN 'slow_exfiltration' ELSE reasons END AS tag
  FROM (SELECT *, CASE model WHEN 'rate' THEN 0.55 WHEN 'content' THEN 0.60 WHEN 'drift' THEN 0.50 ELSE 0.40 END AS weight FROM gated WHERE disposition = 'folded'))"""
CTE["ticks"] = f"ticks AS (SELECT {START} + k * {TICK} AS tick FROM (SELECT unnest(range(0, {(END - START) // TICK + 1})) AS k))"
CTE["states"] = f"""contrib AS (
  SELECT tick, entity_type, entity_id, model, any_value(weight) AS weight, max(claim * pow(2.0, (t - tick) / {HALFLIFE})) AS value FROM ticks JOIN hits ON t <= tick AND tick <= t + {int(30 * HALFLIFE)} GROUP BY ALL
), state_sums AS (SELECT tick, entity_type, entity_id, sum(value) AS base, count(*) FILTER (value >= 0.05) AS active_models FROM contrib GROUP BY ALL
), states AS (SELECT *, least(1.0, base * CASE WHEN active_models >= 2 THEN 1 + 0.25 * (active_models - 1) ELSE 1.0 END) AS entity_score FROM state_sums)"""
CTE["pic"] = f"""pic AS (SELECT tick, {R('least(1.0, max(entity_score) + 0.05 * ln(1 + greatest(0, count(*) - 1)))', 4)} AS global_score, count(*) AS lit_entities, max(active_models) AS corroboration
  FROM states WHERE entity_score >= 0.05 GROUP BY 1)"""
CTE["levels"] = """level_rows AS (SELECT tick, coalesce(global_score, 0.0) AS g FROM ticks LEFT JOIN pic USING (tick)
), latches AS (SELECT *, coalesce(last_value(CASE WHEN g >= 0.75 THEN true WHEN g < 0.55 THEN false END IGNORE NULLS) OVER w, false) AS c, coalesce(last_value(CASE WHEN g >= 0.40 THEN true WHEN g < 0.25 THEN false END IGNORE NULLS) OVER w, false) AS e
  FROM level_rows WINDOW w AS (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), level_named AS (SELECT tick, g AS global_score, CASE WHEN c THEN 'critical' WHEN e THEN 'elevated' ELSE 'normal' END AS level FROM latches
), levels AS (SELECT *, coalesce(lag(level) OVER (ORDER BY tick), 'normal') AS previous, row_number() OVER (ORDER BY tick) AS i FROM level_named)"""
CTE["monitor"] = f"""monitor AS (
  SELECT CAST(step + k * {S // 6} AS BIGINT) AS t, CAST(sum(n) AS BIGINT) AS errors FROM (SELECT t // {S // 6} * {S // 6} AS step, count(*) AS n FROM tele WHERE error GROUP BY 1), (SELECT unnest(range(1, 7)) AS k)
  GROUP BY 1 HAVING sum(n) > 30)"""
CTE["emitted"] = f"""emit AS (
  SELECT tick, i, tick AS since, 0.0::DOUBLE AS last, false AS emitted, CAST(NULL AS BIGINT) AS window_start, global_score, level FROM levels WHERE i = 1
  UNION ALL SELECT l.tick, l.i, CASE WHEN go THEN l.tick ELSE l.since END, CASE WHEN go THEN l.global_score ELSE l.last END, go, l.since, l.global_score, l.level FROM (
    SELECT n.tick, n.i, p.since, p.last, n.global_score, n.level, n.level <> n.previous OR n.tick - p.since >= {EMIT} OR abs(n.global_score - p.last) >= {FU.emit_delta} AS go FROM emit p JOIN levels n ON n.i = p.i + 1) l
), emitted AS (SELECT * FROM emit WHERE emitted)"""
CTE["all_docs"] = """all_docs AS (SELECT entity_type, event_count, score, is_anomalous, model, t FROM docs
  UNION ALL SELECT 'global', NULL, global_score, level <> 'normal', 'fused', tick FROM emitted)"""
_AC = "t, alert_type, severity, entity_type, entity_id, score, source"
CTE["alerts"] = f"""alerts AS (SELECT {_AC} FROM rate_alerts UNION ALL SELECT {_AC} FROM content_alerts UNION ALL SELECT {_AC} FROM drift_alerts
  UNION ALL SELECT t, 'error_rate_spike', 'medium', 'global', 'global', NULL, 'monitor' FROM monitor
  UNION ALL SELECT tick, 'threat_level_change', CASE level WHEN 'critical' THEN 'high' WHEN 'elevated' THEN 'medium' ELSE 'low' END, 'global', 'global', global_score, 'fused' FROM levels WHERE level <> previous)"""
CTE["sent"] = f"""keyed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, alert_type ORDER BY t, source) AS i FROM alerts
), throttle AS (
  SELECT *, t AS anchor, true AS sent, 0 AS held, 0 AS suppressed_prior FROM keyed WHERE i = 1
  UNION ALL SELECT k.*, CASE WHEN k.t - p.anchor >= {DEDUP + 1} THEN k.t ELSE p.anchor END, k.t - p.anchor >= {DEDUP + 1}, CASE WHEN k.t - p.anchor >= {DEDUP + 1} THEN 0 ELSE p.held + 1 END,
    CASE WHEN k.t - p.anchor >= {DEDUP + 1} THEN p.held ELSE 0 END
  FROM throttle p JOIN keyed k ON k.entity_type = p.entity_type AND k.entity_id = p.entity_id AND k.alert_type = p.alert_type AND k.i = p.i + 1
), sent AS (SELECT * FROM throttle)"""
CTE["vec"] = "vec AS (SELECT bucket, entity_id, first, ln(1 + event_count) AS log_count, mean_payload, error_ratio, CAST(malformed_count AS DOUBLE) AS malformed FROM feat WHERE entity_type = 'payer')"
_V = "log_count mean_payload error_ratio malformed".split()


def _std(name: str, rows: str, res: str) -> str:
    one = ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s" for c in _V)
    return f"{name} AS (SELECT bucket, entity_id, {', '.join(f'({c} - {c}_m) / {c}_s AS {c}' for c in _V)} FROM {rows}, (SELECT {one} FROM {res}))"


_RES = "ORDER BY bucket DESC, first DESC, entity_id LIMIT"
CTE["truth"] = f"""truth AS (SELECT CAST(t // {S} * {S} AS BIGINT) AS bucket, client_ip, bool_or(is_attack) AS attack, list(DISTINCT attack_pattern) FILTER (attack_pattern IS NOT NULL) AS kinds FROM tele GROUP BY 1, 2
), judged AS (SELECT t.*, coalesce(f.is_anomalous, false) AS flagged FROM truth t LEFT JOIN content_score f ON f.bucket = t.bucket AND f.client_ip = t.client_ip)"""
CTE["samples"] = """sample_days AS (SELECT event_type, t // 86400 AS day, count(*) AS n FROM tele GROUP BY 1, 2
), samples AS (SELECT event_type, CAST(day * 86400 AS BIGINT) AS t, CAST(sum(n) OVER (PARTITION BY event_type, day // 10 ORDER BY day) AS BIGINT) AS counter FROM sample_days)"""
CTE["lags"] = """lag_days AS (SELECT event_type, t // 86400 AS day, count(*) AS n, count(*) FILTER (event_id % 50 <> 0) AS m FROM tele GROUP BY 1, 2
), lag_sent AS (SELECT event_type, (day + 1) * 86400 AS t, sum(n) OVER (PARTITION BY event_type ORDER BY day) AS sent FROM lag_days
), lag_consumed AS (SELECT event_type, day * 86400 + 129600 AS t, sum(m) OVER (PARTITION BY event_type ORDER BY day) AS consumed FROM lag_days
), lags AS (SELECT s.event_type, CAST(s.t AS BIGINT) AS t, CAST((s.sent - (SELECT min_by(sent, t) FROM lag_sent x WHERE x.event_type = s.event_type)) - (c.consumed - (SELECT min_by(consumed, t) FROM lag_consumed x WHERE x.event_type = s.event_type)) AS BIGINT) AS lag
  FROM lag_sent s ASOF LEFT JOIN lag_consumed c ON s.event_type = c.event_type AND s.t >= c.t)"""

NEEDS = {
    "grain": ["tele"], "feat": ["grain"], "ew_mean": ["feat"], "zs": ["ew_mean"], "rate_score": ["zs"], "cohort": ["feat"], "cohort_score": ["cohort"], "rate_docs": ["rate_score", "cohort_score"],
    "rate_alerts": ["rate_docs"], "line": ["tele"], "win": ["line"], "content_score": ["win"], "content_docs": ["content_score"], "content_alerts": ["content_docs"], "grid": ["tele"], "day_grid": ["tele"],
    "drift": ["grid"], "drift_docs": ["drift"], "drift_alerts": ["drift"], "docs": ["rate_docs", "content_docs", "drift_docs"], "gated": ["docs"], "hits": ["gated"], "states": ["hits", "ticks"], "pic": ["states"],
    "levels": ["pic", "ticks"], "monitor": ["tele"], "alerts": ["rate_alerts", "content_alerts", "drift_alerts", "monitor", "levels"], "emitted": ["levels"], "all_docs": ["docs", "emitted"], "sent": ["alerts"], "vec": ["feat"], "truth": ["content_score"], "samples": ["tele"], "lags": ["tele"],
}


def _cusum_reason(name: str) -> str:
    return f"CASE WHEN s_{name} >= 2 OR is_anomalous THEN 'cusum_{name}=' || printf('%.1f', {R(f's_{name}', 1)}) || CASE WHEN s_{name} >= 6 THEN '>6' ELSE '' END END"


def _with(needs: str, select: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    parts = [CTE[n].strip() for n in order]
    recursive = "RECURSIVE " if any(re.search(r"\bfold p JOIN|\bthrottle p JOIN|\bemit p JOIN", p + select) for p in parts) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + select


def _hist(since: int, until: int, step: int, more: str = "") -> str:
    first = since // step * step
    return f"""SELECT CAST(s.bucket AS BIGINT) AS bucket, coalesce(total, 0) AS total, coalesce(declined, 0) AS declined, coalesce(errors, 0) AS errors, coalesce(attacks, 0) AS attacks
FROM (SELECT unnest(range({first}, {until} + 1, {step})) AS bucket) s LEFT JOIN (
  SELECT t // {step} * {step} AS bucket, count(*) AS total, count(*) FILTER (status = 'declined') AS declined, count(*) FILTER (error) AS errors, count(*) FILTER (is_attack) AS attacks
  FROM tele WHERE t BETWEEN {since} AND {until} GROUP BY 1) h ON h.bucket = s.bucket{more}"""


def _terms(key: str, n: int, rel: str = "tele") -> str:
    return f"SELECT {key} AS key, count(*) AS count FROM {rel} WHERE {key} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}"


def _terms_time(key: str, n: int, rel: str = "tele") -> str:
    return f"""SELECT bucket, key, count FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY count DESC, key) AS r FROM (
  SELECT CAST(t // 86400 * 86400 AS BIGINT) AS bucket, {key} AS key, count(*) AS count FROM {rel} WHERE {key} IS NOT NULL GROUP BY 1, 2)) WHERE r <= {n}"""


def _final(kind: str, more: str = "") -> str:
    cols = ", ".join(f"{R(f'max_by({m}_{s}, i)', 6)} AS {m}_{s}" for m in _M for s in ("mean", "var"))
    return _with("ew_mean", f"SELECT entity_id, max(i) AS n, {cols} FROM ew WHERE entity_type = '{kind}'{more} GROUP BY 1")


#: Distances of a row of the named table to all points, as a list beside it: no pair becomes a row.
_DISTANCES = "list_transform(pts, lambda q: sqrt(" + " + ".join(f"({{0}}.{c} - q[{i}]) * ({{0}}.{c} - q[{i}])" for i, c in enumerate(_V, 1)) + "))"


def oracle_sql() -> dict[str, str]:
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN {R(f'({a}) / ({b})', 4)} ELSE 0.0 END"
    q = {
        "normalized_events": _with("tele", "SELECT event_id || '-' || rep AS event_id, t, event_type, payer_id, payee_id, client_ip, channel, amount, status, error, is_malformed, is_attack, attack_pattern, log_message FROM tele"),
        "traffic_overview_1h": _with("tele", _hist(NOW - 3600, NOW, 30)),
        "traffic_overview_24h": _with("tele", _hist(NOW - 86400, NOW, 600)),
        "traffic_whole_buckets": _with("tele", _hist(NOW - 21600, NOW, 180, f" WHERE s.bucket < {NOW // 180 * 180}")),
        "traffic_totals": _with("tele", f"SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(declined) AS BIGINT) AS declined, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(attacks) AS BIGINT) AS attacks FROM ({_hist(NOW - 86400, NOW, 600)})"),
        "traffic_daily": _with("tele", _hist(START, END - 1, 86400)),
        "top_payers": _with("tele", _terms("payer_id", 5)),
        "top_client_ips": _with("tele", _terms("client_ip", 5)),
        "top_attack_patterns": _with("tele", _terms("attack_pattern", 6)),
        "channel_breakdown": _with("tele", _terms("channel", 10)),
        "event_counters": _with("tele", "SELECT 'Total' AS name, count(*) AS count FROM tele UNION ALL SELECT 'Attack', count(*) FROM tele WHERE is_attack UNION ALL SELECT 'Malformed', count(*) FROM tele WHERE is_malformed"),
        "volume_by_event_type": _with("tele", _terms_time("event_type", 3)),
        "attack_patterns_over_time": _with("tele", _terms_time("attack_pattern", 4)),
        "error_rate_over_time": _with("tele", f"SELECT bucket, total, errors, CASE WHEN total > 0 THEN {R('errors / total', 4)} ELSE 0.0 END AS error_rate FROM ({_hist(START, END - 1, S)})"),
        "entity_case_events": _with("tele", f"SELECT t, event_id, rep, event_type, channel, {R('amount', 2)} AS amount, status, client_ip, payer_id FROM tele WHERE payer_id = 'user-7' ORDER BY t DESC, event_id DESC, rep DESC LIMIT 20"),
        "retention_candidates": _with("tele", f"SELECT t // 86400 AS day, count(*) AS rows FROM tele GROUP BY 1 HAVING day < {NOW // 86400 - 7}"),
        "bucket_grains": _with("grain", f"SELECT bucket, entity_type, entity_id, event_count, payload_sum, {R('amount_sum', 2)} AS amount_sum, amount_n, error_count, malformed_count FROM grain"),
        "bucket_features": _with("feat", f"SELECT bucket, entity_type, entity_id, event_count, mean_payload, {R('mean_amount', 2)} AS mean_amount, error_ratio, malformed_count FROM feat"),
        "ew_baseline_global": _final("global"),
        "ew_baseline_payer": _final("payer"),
        "baseline_lookup": _final("payer", " AND entity_id IN ('user-1', 'user-7')"),
        "rate_z_scores": _with("zs", f"SELECT bucket, entity_type, entity_id, n, {', '.join(f'{R(f'{m}_z', 6)} AS {m}_z' for m in _M)} FROM zs"),
        "rate_scores": _with("rate_score", "SELECT bucket, entity_type, entity_id, event_count, score, alert_type, reasons, is_anomalous, warming_up FROM rate_score"),
        "ip_cohort_states": _with("cohort", f"SELECT bucket, n, {R('mean', 6)} AS mean, {R('var', 6)} AS var FROM cohort"),
        "ip_cohort_scores": _with("cohort_score", f"SELECT bucket, entity_id, event_count, {R('z', 6)} AS z, score FROM cohort_score"),
        "rate_alerts_top5": _with("rate_alerts", "SELECT t, alert_type, severity, entity_type, entity_id, score, rank FROM rate_alerts"),
        "standardized_vectors": _with("vec", f", res AS (SELECT * FROM vec {_RES} 4000), {_std('z', 'vec', 'res')} SELECT bucket, entity_id, {', '.join(f'{R(c, 6)} AS {c}' for c in _V)} FROM z"),
        "knn_distance_ratio": _with(
            "vec",
            f""", res AS (SELECT * FROM vec WHERE bucket < {END - 86400} {_RES} 400), late AS (SELECT * FROM vec WHERE bucket >= {END - 86400}), {_std('z', 'late', 'res')}, {_std('p', 'res', 'res')}
, near AS (SELECT z.bucket, z.entity_id, sqrt({' + '.join(f'(z.{c} - p.{c}) * (z.{c} - p.{c})' for c in _V)}) AS d FROM z, p), ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket, entity_id ORDER BY d) AS r FROM near)
SELECT bucket, entity_id, {R('avg(d)', 6)} AS mean_distance FROM ranked WHERE r <= 5 GROUP BY 1, 2""",
        ),
        "knn_ratio_all": _with(
            "vec",
            f""", res AS (SELECT * FROM vec {_RES} 4000), {_std('z', 'vec', 'res')}, {_std('p', 'res', 'res')}, points AS MATERIALIZED (SELECT list([{', '.join(_V)}]) AS pts FROM p)
, ref AS MATERIALIZED (SELECT greatest(quantile_cont(list_avg(list_sort({_DISTANCES.format('p')})[2:6]), 0.99), 1e-6) AS p99, count(*) AS n FROM p, points)
SELECT bucket, entity_id, CASE WHEN n < 200 THEN 0.0 ELSE {R(f"list_avg(list_sort({_DISTANCES.format('z')})[1:5]) / p99", 6)} END AS ratio FROM z, points, ref""",
        ),
        "log_parse": _with("line", "SELECT event_id, rep, log_ip, log_payer, method, path, code, nbytes, latency, msg, family, level FROM line"),
        "log_families": _with("line", "SELECT family, level, count(*) AS lines FROM line GROUP BY 1, 2"),
        "template_mask_counts": _with("line", "SELECT template, count(*) AS lines FROM line GROUP BY 1"),
        "content_window_features": _with("win", f"SELECT bucket, client_ip, window_events, distinct_templates, n_sqli, n_traversal, n_auth_fail, n_scanner, n_schema_reject, n_other, n_suspicious_other, max_auth_attempt, {', '.join(f'{R(c, 6)} AS {c}' for c in ('benign_ratio', 'auth_fail_ratio', 'err_4xx_ratio'))} FROM win"),
        "content_template_counts": _with("line", f"SELECT bucket, client_ip, string_agg(family || '=' || n, ',' ORDER BY family) AS template_counts FROM (SELECT CAST(t // {S} * {S} AS BIGINT) AS bucket, client_ip, family, count(*) AS n FROM line GROUP BY 1, 2, 3) GROUP BY 1, 2"),
        "content_scores": _with("content_score", "SELECT bucket, client_ip, window_events, rule_level, score, is_anomalous, reasons FROM content_score"),
        "content_alerts": _with("content_alerts", "SELECT t, entity_id, severity, score, rank FROM content_alerts"),
        "payer_buckets": f"WITH {TELEMETRY_SQL.strip()}, {_payers('p', S, 100.0)} SELECT bucket, payer, event_count, {R('amount_sum', 2)} AS amount_sum, distinct_payees FROM p",
        "drift_grid_zero_filled": _with("grid", f"SELECT payer, bucket, event_count, {R('amount_sum', 2)} AS amount_sum, distinct_payees FROM grid"),
        "drift_cusum": _with("drift", f"SELECT payer, bucket, i, {', '.join(f'{R(c, 4)} AS {c}' for c in ('s_volume', 's_amount', 'ewma_volume', 'ewma_amount', 'mean_volume'))}, run_volume, run_amount, window_start, exc_events, is_anomalous FROM drift"),
        "drift_alerts": _with("drift_alerts", "SELECT t, entity_id, severity, score, rank FROM drift_alerts"),
        "drift_top": _with("drift", f"SELECT payer, i, {R('s_max', 4)} AS s_max FROM (SELECT payer, max(i) AS i, max_by(greatest(s_volume, s_amount), i) AS s_max FROM drift GROUP BY 1) ORDER BY 3 DESC, 1 LIMIT 10"),
        "drift_evidence": _with("drift", f"SELECT payer, count(*) AS buckets, max(exc_events) AS events, {R('max(exc_amount)', 2)} AS amount, {R('max(greatest(s_volume, s_amount))', 4)} AS peak FROM drift WHERE is_anomalous GROUP BY 1"),
        "drift_amplitude": _with("day_grid", f"SELECT payer AS entity, count(*) AS n, {R(f'(avg(event_count) FILTER (bucket >= {CHANGE}) - avg(event_count) FILTER (bucket < {CHANGE})) / nullif(stddev_pop(event_count) FILTER (bucket < {CHANGE}), 0)', 6)} AS shift_sigma FROM day_grid GROUP BY 1"),
        "drift_worst": _with("drift", f"SELECT payer, i, {R('s_volume', 4)} AS s_volume, {R('s_amount', 4)} AS s_amount FROM (SELECT *, row_number() OVER (PARTITION BY payer ORDER BY i DESC) AS r FROM drift) WHERE r = 1 ORDER BY greatest(drift.s_volume, drift.s_amount) DESC, payer LIMIT 1".replace("drift.s_", "s_")),
        "drift_tracked": _with("drift", "SELECT count(*) AS tracked, count(*) FILTER (seen >= 30) AS warm FROM (SELECT payer, max(i) AS seen FROM drift GROUP BY 1)"),
        "drift_rejected_payers": _with("grid", "SELECT payer, first FROM (SELECT payer, min(bucket) AS first, row_number() OVER (ORDER BY min(bucket), payer) AS place FROM payer_all GROUP BY 1) WHERE place > 40"),
        "drift_first_flagged": _with("drift", "SELECT payer, min(bucket) AS first_bucket, min(i) AS after, count(*) AS buckets FROM drift WHERE is_anomalous GROUP BY 1"),
        "entity_cases": _with(
            "ew_mean drift",
            f""", seen AS (SELECT payer_id AS entity_id, count(*) AS events, max(t) AS last_seen FROM tele WHERE payer_id IS NOT NULL GROUP BY 1
), base AS (SELECT entity_id, max(i) AS n, {R('max_by(event_count_mean, i)', 6)} AS mean_events FROM ew WHERE entity_type = 'payer' GROUP BY 1
), chart AS (SELECT payer AS entity_id, {R('max_by(s_volume, i)', 4)} AS s_volume, {R('max_by(s_amount, i)', 4)} AS s_amount, max(i) AS i FROM drift GROUP BY 1)
SELECT entity_id, n, mean_events, s_volume, s_amount, i, events, last_seen FROM seen LEFT JOIN base USING (entity_id) LEFT JOIN chart USING (entity_id)""",
        ),
        "scores_by_model": _with("all_docs", "SELECT model, count(*) AS docs, count(*) FILTER (is_anomalous) AS anomalous FROM all_docs GROUP BY 1"),
        "max_score_over_time": _with("all_docs", "SELECT CAST(t // 86400 * 86400 AS BIGINT) AS bucket, entity_type, max(score) AS max_score FROM all_docs GROUP BY 1, 2"),
        "fusion_gate_of_all": _with("all_docs", "SELECT model, CASE WHEN model = 'fused' THEN 'self' WHEN NOT is_anomalous OR score <= 0 THEN 'benign' WHEN event_count < 10 THEN 'below_floor' ELSE 'folded' END AS disposition, count(*) AS docs FROM all_docs GROUP BY 1, 2"),
        "drift_documents": _with("drift", f"SELECT bucket, payer, score, is_anomalous, {R('ratio', 4)} AS mean_amount_ratio, concat_ws('; ', {_cusum_reason('volume')}, {_cusum_reason('amount')}, CASE WHEN is_anomalous AND ratio > 1 THEN 'cumulative_amount_drift=+' || printf('%.0f', floor((ratio - 1) * 100 + 0.5)) || '%' END, CASE WHEN is_anomalous THEN 'sustained=' || greatest(run_volume, run_amount) || 'm' END) AS reasons FROM (SELECT *, CASE WHEN exc_events > 0 AND mean_volume > 0 AND mean_amount > 0 THEN (exc_amount / exc_events) / (mean_amount / mean_volume) ELSE 0.0 END AS ratio FROM drift) WHERE is_anomalous OR greatest(s_volume, s_amount) >= 2"),
        "drift_alert_summaries": _with("drift", f"SELECT bucket + {S} AS t, payer AS entity_id, exc_events || ' events moving ' || format('{{:,}}', CAST(round_even(exc_amount, 0) AS BIGINT)) || ' IDR accumulated over ' || greatest(1, (bucket + {S} - window_start) // 60) || ' min' AS summary FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, payer) AS rank FROM drift WHERE is_anomalous) WHERE rank <= 5"),
        "rate_alert_windows": _with("rate_alerts", f"SELECT t, entity_type, entity_id, alert_type, strftime(make_timestamp((CAST(t AS BIGINT) - {S}) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS window_start, summary FROM rate_alerts"),
        "fusion_gate": _with("gated", "SELECT model, disposition, count(*) AS docs FROM gated GROUP BY 1, 2"),
        "fusion_gate_replayed": _with("docs", f"SELECT model, CASE WHEN NOT is_anomalous OR score <= 0 THEN 'benign' WHEN {NOW} - t > 300 THEN 'stale' WHEN event_count < 10 THEN 'below_floor' ELSE 'folded' END AS disposition, count(*) AS docs FROM docs GROUP BY 1, 2"),
        "fusion_contributor_tags": _with(
            "states",
            """, tagged AS (SELECT tick, entity_type, entity_id, model, max_by(tag, t) AS tag FROM ticks JOIN hits ON t <= tick GROUP BY ALL)
SELECT tick, model, max(row(least(1.0, value / weight), tag)).tag AS tag FROM (SELECT tick, entity_type, entity_id, model, value, weight, tag FROM contrib JOIN states USING (tick, entity_type, entity_id) JOIN tagged USING (tick, entity_type, entity_id, model) WHERE entity_score >= 0.05 AND value >= 0.05) GROUP BY 1, 2""".replace("max(row(least(1.0, value / weight), tag)).tag", "max({'c': least(1.0, value / weight), 'tag': tag}).tag"),
        ),
        "service_health": _with("tele", f"SELECT event_type AS service, {END} - max(t) AS lag, CASE WHEN max(t) < {END} - 43200 THEN 'offline' WHEN count(*) FILTER (error) > count(*) / 2 THEN 'error' WHEN count(*) < 100 THEN 'warming' WHEN {END} - max(t) > 0 THEN 'degraded' ELSE 'ok' END AS state FROM tele GROUP BY 1"),
        "fusion_contributions": _with("hits", f"SELECT entity_type, entity_id, model, t, {R('claim', 6)} AS claim, tag, {R(f'(SELECT max(h.claim * pow(2.0, (h.t - hits.t) / {HALFLIFE})) FROM hits h WHERE h.entity_type = hits.entity_type AND h.entity_id = hits.entity_id AND h.model = hits.model AND h.t <= hits.t)', 6)} AS value FROM hits"),
        "fusion_entity_scores": _with("states", f"SELECT tick, entity_type, entity_id, active_models, {R('entity_score', 6)} AS entity_score FROM states WHERE entity_score >= 0.05"),
        "fusion_contributors": _with("states", f"SELECT tick, model, {R('max(least(1.0, value / weight))', 4)} AS claim FROM contrib JOIN states USING (tick, entity_type, entity_id) WHERE entity_score >= 0.05 AND value >= 0.05 GROUP BY 1, 2"),
        "fusion_top_entities": _with("states", f"SELECT tick, rank, entity_type, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY {R('entity_score', 6)} DESC, entity_type, entity_id) AS rank FROM states WHERE entity_score >= 0.05 AND entity_type <> 'global') WHERE rank <= 5"),
        "fusion_global_score": _with("pic", "SELECT tick, global_score, lit_entities, corroboration FROM pic"),
        "corroborated_entities": _with("states", "SELECT entity_type, entity_id, count(*) AS ticks, max(active_models) AS models FROM states WHERE entity_score >= 0.05 AND active_models >= 2 GROUP BY 1, 2"),
        "threat_levels": _with("levels", "SELECT tick, global_score, level FROM levels"),
        "threat_transitions": _with("levels", "SELECT tick AS at, previous AS from_level, level AS to_level, global_score FROM levels WHERE level <> previous"),
        "threat_emissions": _with("emitted", "SELECT tick, window_start, global_score, level FROM emitted"),
        "level_change_alerts": _with("levels", "SELECT tick AS t, CASE level WHEN 'critical' THEN 'high' WHEN 'elevated' THEN 'medium' ELSE 'low' END AS severity, global_score AS score, printf('Threat level %s -> %s (score %.2f)', previous, level, global_score) AS summary FROM levels WHERE level <> previous"),
        "threat_snapshots": _with(
            "levels",
            f""", loud AS (SELECT tick, string_agg(model, ',' ORDER BY claim DESC, model) AS contributors FROM (
  SELECT tick, model, {R('max(least(1.0, value / weight))', 4)} AS claim FROM contrib JOIN states USING (tick, entity_type, entity_id) WHERE entity_score >= 0.05 AND value >= 0.05 GROUP BY 1, 2) GROUP BY 1
), strong AS (SELECT tick, string_agg(entity_type || ':' || entity_id, ',' ORDER BY rank) AS entities FROM (
  SELECT *, row_number() OVER (PARTITION BY tick ORDER BY {R('entity_score', 6)} DESC, entity_type, entity_id) AS rank FROM states WHERE entity_score >= 0.05 AND entity_type <> 'global') WHERE rank <= {FU.top} GROUP BY 1)
SELECT tick, l.global_score, level, coalesce(max(CASE WHEN level <> previous THEN tick END) OVER (ORDER BY tick), min(tick) OVER ()) AS since, coalesce(lit_entities, 0) AS lit_entities,
  coalesce(corroboration, 0) AS corroboration, coalesce(contributors, '') AS contributors, coalesce(entities, '') AS entities
FROM levels l LEFT JOIN pic USING (tick) LEFT JOIN loud USING (tick) LEFT JOIN strong USING (tick)""",
        ),
        "suspects": _with(
            "states",
            f""", spoken AS (SELECT tick, entity_type, entity_id, model, arg_max(tag, claim * pow(2.0, (t - tick) / {HALFLIFE})) AS tag, max(claim * pow(2.0, (t - tick) / {HALFLIFE})) AS value
  FROM ticks JOIN hits ON t <= tick AND tick <= t + {int(30 * HALFLIFE)} GROUP BY 1, 2, 3, 4
), why AS (SELECT tick, entity_type, entity_id, string_agg(model || ':' || coalesce(tag, ''), ',' ORDER BY model) AS reasons FROM spoken WHERE value >= 0.05 GROUP BY 1, 2, 3
), strong AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY {R('entity_score', 6)} DESC, entity_type, entity_id) AS rank FROM states WHERE entity_score >= 0.05 AND entity_type <> 'global')
SELECT tick, rank, entity_type, entity_id, coalesce(reasons, '') AS reasons FROM strong LEFT JOIN why USING (tick, entity_type, entity_id) WHERE rank <= {min(6, FU.top)}""",
        ),
        "threat_history": _with("levels", "SELECT min(global_score) AS min, max(global_score) AS max, max_by(global_score, tick) AS latest, count(*) AS points FROM (SELECT * FROM levels ORDER BY tick DESC LIMIT 120)"),
        "alerts_by_severity": _with("alerts", _terms_time("severity", 3, "alerts")),
        "alerts_by_type": _with("alerts", _terms("alert_type", 10, "alerts")),
        "alert_ids": _with("alerts", "SELECT t, source, sha256(concat_ws('|', source, alert_type, entity_type, coalesce(entity_id, ''), CAST(CAST(t AS BIGINT) AS VARCHAR))) AS alert_id FROM alerts"),
        "alert_feed": _with("alerts", f", day AS (SELECT * FROM alerts WHERE t > {NOW - 86400} AND t <= {NOW}) SELECT t, alert_type, severity, entity_type, entity_id, source, (SELECT count(*) FROM day) AS total FROM day ORDER BY t DESC, entity_type, entity_id, alert_type, source LIMIT 30"),
        "alert_dedup": _with("sent", "SELECT t, alert_type, entity_type, entity_id, sent, suppressed_prior FROM sent"),
        "dedup_stats": _with("sent", "SELECT alert_type, count(*) FILTER (sent) AS sent, count(*) FILTER (NOT sent) AS suppressed FROM sent GROUP BY 1"),
        "monitor_summaries": _with("monitor", f"SELECT errors || ' errors in the last {S} s' AS key, count(*) AS count, max(t) AS latest FROM monitor GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 15").replace("HAVING sum(n) > 30", "HAVING sum(n) > 20"),
        "pulse": _with(
            "drift monitor",
            f""", traffic AS ({_hist(NOW - 86400, NOW, 600)}), payers AS (SELECT payer, max(i) AS seen FROM drift GROUP BY 1)
SELECT (SELECT CAST(sum(total) AS BIGINT) FROM traffic) AS total, (SELECT CAST(sum(errors) AS BIGINT) FROM traffic) AS errors, (SELECT CAST(sum(attacks) AS BIGINT) FROM traffic) AS attacks,
  (SELECT count(*) FROM payers) AS tracked, (SELECT count(*) FROM payers WHERE seen >= 30) AS warm, (SELECT count(*) FROM monitor) AS alerts, (SELECT max(errors) FROM monitor) AS most""",
        ).replace("HAVING sum(n) > 30", "HAVING sum(n) > 20"),
        "error_monitor_sliding": _with("monitor", f"SELECT t, errors, errors || ' errors in the last {S} s' AS summary FROM monitor"),
        "notification_text": _with(
            "monitor",
            f""", m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t) AS i FROM monitor), throttle AS (
  SELECT t, errors, i, t AS anchor, true AS sent, 0 AS held, 0 AS prior FROM m WHERE i = 1
  UNION ALL SELECT k.t, k.errors, k.i, CASE WHEN k.t - p.anchor >= {DEDUP + 1} THEN k.t ELSE p.anchor END, k.t - p.anchor >= {DEDUP + 1}, CASE WHEN k.t - p.anchor >= {DEDUP + 1} THEN 0 ELSE p.held + 1 END,
    CASE WHEN k.t - p.anchor >= {DEDUP + 1} THEN p.held ELSE 0 END FROM throttle p JOIN m k ON k.i = p.i + 1)
SELECT t, '[MEDIUM] error_rate_spike global:global - ' || errors || ' errors in the last {S} s' || CASE WHEN prior > 0 THEN ' (+' || prior || ' suppressed)' ELSE '' END AS message FROM throttle WHERE sent""",
        ).replace("WITH tele", "WITH RECURSIVE tele", 1),
        "confusion_metrics": _with("truth", f"SELECT tp, fp, fn, tn, {rate('tp', '(tp + fp)')} AS precision, {rate('tp', '(tp + fn)')} AS recall, {rate('2 * tp', '(2 * tp + fp + fn)')} AS f1, {rate('fp', '(fp + tn)')} AS fp_rate FROM (SELECT count(*) FILTER (attack AND flagged) AS tp, count(*) FILTER (NOT attack AND flagged) AS fp, count(*) FILTER (attack AND NOT flagged) AS fn, count(*) FILTER (NOT attack AND NOT flagged) AS tn FROM judged)"),
        "family_recall": _with("truth", f"SELECT kind, count(*) AS windows, count(*) FILTER (flagged) AS found, {R('count(*) FILTER (flagged) / count(*)', 4)} AS recall FROM (SELECT unnest(kinds) AS kind, flagged FROM judged) GROUP BY 1"),
        "counter_rates": _with("samples", f"SELECT event_type, t, counter, CASE WHEN counter >= lag(counter) OVER w THEN {R('(counter - lag(counter) OVER w) / (t - lag(t) OVER w)', 6)} END AS rate FROM samples WINDOW w AS (PARTITION BY event_type ORDER BY t)"),
        "counter_rate_total": _with("samples", f"SELECT t, {R('sum(rate)', 6)} AS total_rate FROM (SELECT t, CASE WHEN counter >= lag(counter) OVER w THEN {R('(counter - lag(counter) OVER w) / (t - lag(t) OVER w)', 6)} END AS rate FROM samples WINDOW w AS (PARTITION BY event_type ORDER BY t)) GROUP BY t"),
        "counter_throughput": _with("samples", "SELECT event_type, max(t) - min(t) AS span, max_by(counter, t) - min_by(counter, t) AS counter_delta FROM samples GROUP BY 1"),
        "consumer_lag": _with("lags", "SELECT event_type, t, lag FROM lags"),
        "consumer_drained": _with(
            "lags",
            """, steps AS (SELECT *, coalesce(abs(lag - lag(lag) OVER (PARTITION BY event_type ORDER BY t)) < 40, false) AS still FROM lags
), isl AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY t) AS island FROM steps
), runs AS (SELECT event_type, t, count(*) FILTER (still) OVER (PARTITION BY event_type, island ORDER BY t) AS streak FROM isl
), found AS (SELECT event_type, t, 'flat' AS how FROM runs WHERE streak >= 4 UNION ALL SELECT event_type, t, 'gone' FROM lags WHERE lag <= 2)
SELECT event_type, min(t) AS t, min_by(how, row(t, how)) AS how FROM found GROUP BY 1""",
        ),
        "growth_streaks": _with("samples", ", g AS (SELECT *, coalesce(counter > lag(counter) OVER (PARTITION BY event_type ORDER BY t), false) AS up FROM samples), isl AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY t) AS island FROM g), s AS (SELECT event_type, t, count(*) FILTER (up) OVER (PARTITION BY event_type, island ORDER BY t) AS streak FROM isl) SELECT * FROM s WHERE streak >= 3"),
    }
    # a run in two parts is one run
    return q | {f"{name}_resumed": q[name] for name in ("rate_z_scores", "ew_baseline_payer", "ip_cohort_states", "drift_cusum", "alert_dedup", "threat_levels", "threat_emissions")}

"""The registered queries in DuckDB SQL, over the same tables, as an independent check."""

from __future__ import annotations

SCENARIO = "profile, policy, sensor"
STREAM = "device_id, sensor"
EVENT_JSON = """'{"ts":' || ts_ns || ',"seq":' || seq || ',"device_id":"' || device_id || '","sensor":"' || sensor
 || '","val":' || val::varchar || ',"pred":' || pred::varchar || ',"res":' || res::varchar || ',"tau":' || tau::varchar
 || ',"kbits":' || kbits || ',"profile":"' || profile || '","policy":"' || policy || '"'"""
DECISION_JSON = """'{"ts":' || ts_ns || ',"device_id":"' || device_id || '","state_aoi":' || state_aoi::varchar
 || ',"state_res":' || state_res::varchar || ',"state_res_var":' || state_res_var::varchar || ',"state_loss":'
 || state_loss::varchar || ',"state_q_len":' || state_q_len || ',"tau":' || tau::varchar || ',"kbits":' || kbits
 || ',"reward":' || reward::varchar || '}'"""


def _size(topic: str, payload_bytes: str, qos: str = "1") -> str:
    rest = f"(2 + strlen({topic}) + CASE WHEN {qos} > 0 THEN 2 ELSE 0 END + {payload_bytes})"
    return (
        f"(1 + CASE WHEN {rest} <= 127 THEN 1 WHEN {rest} <= 16383 THEN 2 WHEN {rest} <= 2097151 THEN 3 "
        f"WHEN {rest} <= 268435455 THEN 4 END + {rest})::BIGINT"
    )


EVENT_TOPIC = "('edge/' || device_id || '/' || sensor || '/event')"
EVENT_BYTES = _size(EVENT_TOPIC, f"strlen({EVENT_JSON} || '}}')")

VIEWS = {
    "samples": """
SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, 'dev-' || user_id AS device_id,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'mic_rms' ELSE 'temp' END AS sensor,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN -value / 4 ELSE value / 4 END AS x,
  CASE user_id % 3 WHEN 0 THEN 'slow_10kbps' WHEN 1 THEN 'delay_loss' ELSE 'cellular_var' END AS profile,
  CASE WHEN user_id % 9 < 3 THEN 'periodic' WHEN user_id % 9 < 6 THEN 'fixed_tau' ELSE 'adaptive' END AS policy
FROM events""",
    "telemetry": """
SELECT seq, ts_ns, device_id, sensor, x AS val, coalesce(px, x) AS pred, abs(x - coalesce(px, x)) AS res,
  CASE WHEN sensor = 'mic_rms' THEN 3.0::DOUBLE ELSE 0.2::DOUBLE END AS tau,
  CASE WHEN sensor = 'mic_rms' THEN 6 ELSE 8 END AS kbits, profile, policy
FROM (SELECT *, lag(x) OVER (PARTITION BY device_id, sensor ORDER BY ts_ns, seq) AS px FROM samples)""",
    "arrivals": """
SELECT t.*, c.copy_no, ts_ns + 300000000 + (seq % 7) * 50000000 + c.copy_no * 2000000000 AS t_recv_ns
FROM telemetry t, (SELECT 0 AS copy_no UNION ALL SELECT 1) c WHERE c.copy_no = 0 OR t.seq % 20 = 0""",
    "temp_samples": "SELECT seq, ts_ns, device_id, sensor, x AS celsius, seq % 11 <> 0 AS valid FROM samples WHERE sensor = 'temp'",
    "policy_log": """
SELECT seq, ts_ns, device_id, sensor, (seq % 7000)::DOUBLE AS state_aoi, res AS state_res, res * res AS state_res_var,
  (seq % 10) / 100.0::DOUBLE AS state_loss, seq % 60 AS state_q_len, (seq % 12)::INT AS arm,
  (seq % 5000)::DOUBLE AS out_aoi_ms, res / 4 AS out_mae, (seq % 900)::DOUBLE AS out_rate_bps
FROM telemetry""",
    "decisions": """
SELECT seq, ts_ns, device_id, state_aoi, state_res, state_res_var, state_loss, state_q_len, 0.5::DOUBLE AS tau, 8 AS kbits,
  0.0::DOUBLE AS reward, ts_ns + 250000000 AS t_recv_ns FROM policy_log""",
    "queue": """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status,
  (o_orderkey % 8)::INT AS attempts, epoch_us(o_orderdate) * 1000 AS available_at_ns,
  epoch_us(o_orderdate) * 1000 + 5000000000 AS last_attempt_ns FROM orders""",
    "clock_pairs": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) AS rtc_us,
  epoch_us(l_shipdate) + (l_orderkey % 9 - 4) * 1000000 AS system_us FROM lineitem""",
    "pcm": "SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 60000)::INT) AS pcm FROM embeddings",
    "outcomes": """
SELECT *, 1.0::DOUBLE AS x0, state_aoi / 1000.0::DOUBLE AS x1, abs(state_res) AS x2, greatest(state_res_var, 0.0::DOUBLE) AS x3,
  least(greatest(state_loss, 0.0::DOUBLE), 1.0::DOUBLE) AS x4, greatest(state_q_len, 0) / 50.0::DOUBLE AS x5,
  -(out_aoi_ms / 1000.0::DOUBLE + out_mae + out_rate_bps / 1024.0::DOUBLE) AS reward FROM policy_log""",
}
NEEDS = {
    "telemetry": ["samples"], "arrivals": ["telemetry"], "temp_samples": ["samples"], "policy_log": ["telemetry"],
    "decisions": ["policy_log"], "outcomes": ["policy_log"],
}


def _with(views: list[str], body: str, recursive: bool = False) -> str:
    """Put the views a query uses, and those they use, in front of it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    heads = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v].strip()})" for v in order)
    body = body.strip()
    if body.startswith("WITH"):
        return f"WITH {'RECURSIVE ' * recursive}{heads},\n{body[4:].lstrip()}"
    return f"WITH {heads}\n{body}"


def _select(views: list[str], body: str) -> str:
    return _with(views, body)


FIRST_ARRIVALS = """
  SELECT * FROM arrivals
  QUALIFY row_number() OVER (PARTITION BY profile, policy, device_id, sensor, seq ORDER BY ts_ns, t_recv_ns) = 1"""


def _summary_ctes(source: str, group: str = SCENARIO, prefix: str = "") -> str:
    """CTEs ending in ``summary``: unrounded measures per group of the deduplicated event table ``source``."""
    on = " AND ".join(f"t.{c.strip()} = a.{c.strip()}" for c in group.split(","))
    return f"""
gaps AS (SELECT {group}, ts_ns - lag(ts_ns) OVER (PARTITION BY {group}, device_id ORDER BY ts_ns, seq) AS gap FROM {source}),
ordered AS (SELECT {group}, gap, row_number() OVER w AS m, sum(gap::HUGEINT) OVER w - gap AS below,
    count(*) OVER g AS n, sum(gap::HUGEINT) OVER g AS total FROM gaps WHERE gap IS NOT NULL
  WINDOW w AS (PARTITION BY {group} ORDER BY gap ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY {group})),
p95 AS (SELECT {group}, arg_min((0.95::DOUBLE * total::DOUBLE - below::DOUBLE) / (n - m + 1), m) / 1e6::DOUBLE AS aoi_p95_ms
  FROM ordered WHERE total > 0 AND below::DOUBLE + gap::DOUBLE * (n - m + 1) >= 0.95::DOUBLE * total::DOUBLE GROUP BY {group}),
means AS (SELECT {group}, sum(gap::HUGEINT * gap)::DOUBLE / (2 * sum(gap::HUGEINT)::DOUBLE) / 1e6::DOUBLE AS aoi_mean_ms
  FROM gaps GROUP BY {group} HAVING sum(gap) > 0),
totals AS (SELECT {group}, count(*) AS n_events, (max(ts_ns) - min(ts_ns)) / 1e9::DOUBLE AS span,
    sum({EVENT_BYTES}) AS bytes, avg(abs(res)) AS mae_event_mean, quantile_cont(abs(res), 0.95) AS mae_event_p95,
    avg(kbits) AS kbits_mean FROM {source} GROUP BY {group}),
summary AS (SELECT {', '.join('t.' + c.strip() for c in group.split(','))}, n_events,
    CASE WHEN n_events >= 2 THEN span ELSE 'nan'::DOUBLE END AS duration_s,
    CASE WHEN n_events >= 2 AND span > 0 THEN bytes / span ELSE 'nan'::DOUBLE END AS rate_Bps,
    coalesce(aoi_mean_ms, 'nan'::DOUBLE) AS aoi_mean_ms, coalesce(aoi_p95_ms, 'nan'::DOUBLE) AS aoi_p95_ms,
    mae_event_mean, mae_event_p95, kbits_mean
  FROM totals t LEFT JOIN means a ON {on} LEFT JOIN p95 b ON {on.replace(' a.', ' b.').replace('= a.', '= b.')})"""


ROUNDED_SUMMARY = """n_events, round(duration_s, 6) AS duration_s, round(rate_Bps, 9) AS rate_Bps,
  round(aoi_mean_ms, 3) AS aoi_mean_ms, round(aoi_p95_ms, 3) AS aoi_p95_ms, round(mae_event_mean, 6) AS mae_event_mean,
  round(mae_event_p95, 6) AS mae_event_p95, round(kbits_mean, 6) AS kbits_mean"""
RANK = "CASE policy WHEN 'periodic' THEN 0 WHEN 'fixed_tau' THEN 1 WHEN 'adaptive' THEN 2 ELSE 3 END"


def _on_summary(body: str) -> str:
    return _with(["arrivals"], f"WITH firsts AS ({FIRST_ARRIVALS}),{_summary_ctes('firsts')}\n{body}")


def _text(c: str, decimals: int) -> str:
    return f"CASE WHEN isnan({c}) THEN 'NaN' ELSE printf('%.{decimals}f', {c}) END"


def _gap_groups(source_gaps: str) -> str:
    return f"""
ordered AS (SELECT {SCENARIO}, gap, row_number() OVER w AS m, sum(gap::HUGEINT) OVER w AS upto,
    count(*) OVER g AS n, sum(gap::HUGEINT) OVER g AS total FROM {source_gaps} WHERE gap IS NOT NULL
  WINDOW w AS (PARTITION BY {SCENARIO} ORDER BY gap ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY {SCENARIO})),
tries AS (SELECT {SCENARIO}, n - m + 1 AS i, n, (0.95::DOUBLE * total::DOUBLE - (total - upto + gap)::DOUBLE) / (n - m + 1) AS a
  FROM ordered WHERE total > 0),
loop AS (SELECT {SCENARIO}, greatest(arg_min(a, i), 0.0::DOUBLE) / 1e6::DOUBLE AS aoi_p95_loop_ms
  FROM (SELECT t.*, o.gap FROM tries t LEFT JOIN ordered o ON t.profile = o.profile AND t.policy = o.policy
        AND t.sensor = o.sensor AND o.m = t.i + 1)
  WHERE i = n OR a <= gap GROUP BY {SCENARIO})"""


PER_DEVICE_GAPS = f"""gaps AS (SELECT {SCENARIO}, ts_ns - lag(ts_ns) OVER (PARTITION BY {SCENARIO}, device_id ORDER BY ts_ns, seq) AS gap
  FROM telemetry)"""
MEAN = "sum(gap::HUGEINT * gap)::DOUBLE / (2 * sum(gap::HUGEINT)::DOUBLE) / 1e6::DOUBLE"


def _trigger_ctes(settings: list[dict]) -> str:
    """CTEs ending in ``sent``: every setting of the list replayed row by row."""
    rows = ", ".join(
        "({i}, {sensor}, '{name}', {alpha}::DOUBLE, {tau}::DOUBLE, {kbits}, {hb}, {guard}::BIGINT, {every})".format(
            i=i,
            sensor="NULL" if s.get("sensor") is None else f"'{s['sensor']}'",
            name=s.get("name", ""),
            alpha=s["alpha"],
            tau=s["tau"],
            kbits=s["kbits"],
            hb="NULL::BIGINT" if s.get("hb") is None else f"{s['hb']}::BIGINT",
            guard=s.get("guard", 0),
            every=str(s.get("every", False)).lower(),
        )
        for i, s in enumerate(settings)
    )
    decide = """CASE WHEN g.every THEN 'periodic'
      WHEN g.guard > 0 AND r.last_sent IS NOT NULL AND g.ts_ns - r.last_sent < g.guard THEN NULL
      WHEN abs(g.x - r.forecast) > g.tau THEN 'residual'
      WHEN g.hb IS NOT NULL AND (r.last_sent IS NULL OR g.ts_ns - r.last_sent >= g.hb) THEN 'heartbeat' END"""
    return f"""
settings(setting, for_sensor, setting_name, alpha, tau, kbits, hb, guard, every) AS (VALUES {rows}),
graded AS MATERIALIZED (SELECT s.*, t.* FROM (
    SELECT *, row_number() OVER (PARTITION BY {STREAM} ORDER BY ts_ns, seq) AS rn FROM samples) s
  JOIN settings t ON t.for_sensor IS NULL OR t.for_sensor = s.sensor),
run AS (
  SELECT setting, device_id, sensor, rn, seq, ts_ns, x, x AS pred, 0.0::DOUBLE AS res, x AS forecast,
    CASE WHEN every THEN 'periodic' ELSE 'bootstrap' END AS reason, ts_ns AS last_sent
  FROM graded WHERE rn = 1
  UNION ALL
  SELECT setting, device_id, sensor, rn, seq, ts_ns, x, before AS pred, abs(x - before) AS res,
    alpha * x + (1.0::DOUBLE - alpha) * before AS forecast, reason,
    CASE WHEN reason IS NULL THEN last_sent ELSE ts_ns END AS last_sent
  FROM (SELECT g.*, r.forecast AS before, r.last_sent, {decide} AS reason
        FROM run r JOIN graded g ON g.setting = r.setting AND g.device_id = r.device_id AND g.sensor = r.sensor
          AND g.rn = r.rn + 1)),
sent AS (SELECT r.setting, r.device_id, r.sensor, r.seq, r.ts_ns, r.pred, r.res, r.reason, g.setting_name, g.profile, g.tau,
    g.kbits, CASE WHEN g.every THEN 'periodic' ELSE 'fixed_tau' END AS policy,
    {_quantized('r.x', 'g.kbits', "CASE WHEN r.sensor = 'mic_rms' THEN -80.0::DOUBLE ELSE 0.0::DOUBLE END",
                "CASE WHEN r.sensor = 'mic_rms' THEN 0.0::DOUBLE ELSE 50.0::DOUBLE END")} AS val
  FROM run r JOIN graded g ON g.setting = r.setting AND g.device_id = r.device_id AND g.sensor = r.sensor AND g.rn = r.rn
  WHERE r.reason IS NOT NULL)"""


def _step(k: str, lo: str, hi: str) -> str:
    return f"(({hi} - {lo}) / (pow(2.0::DOUBLE, {k}) - 1))"


def _code(x: str, k: str, lo: str, hi: str) -> str:
    top = f"(pow(2.0::DOUBLE, {k}) - 1)"
    return (
        f"CASE WHEN {x} <= {lo} THEN 0.0::DOUBLE WHEN {x} >= {hi} THEN {top} ELSE "
        f"least(greatest(floor(({x} - {lo}) / {_step(k, lo, hi)} + 0.5::DOUBLE), 0.0::DOUBLE), {top}) END"
    )


def _quantized(x: str, k: str, lo: str, hi: str) -> str:
    return f"({lo} + ({_code(x, k, lo, hi)}) * {_step(k, lo, hi)})"


LO = "CASE WHEN sensor = 'mic_rms' THEN -80.0::DOUBLE ELSE 0.0::DOUBLE END"
HI = "CASE WHEN sensor = 'mic_rms' THEN 0.0::DOUBLE ELSE 50.0::DOUBLE END"
DAY_NS = 86_400_000_000_000
TRIGGERS = [
    {"sensor": "mic_rms", "alpha": 0.2, "tau": 15.0, "kbits": 6, "hb": 2 * DAY_NS},
    {"sensor": "temp", "alpha": 0.5, "tau": 12.0, "kbits": 8, "hb": DAY_NS, "guard": 7_200_000_000_000},
]
SWEEP = [
    {"name": "a20_t5", "alpha": 0.2, "tau": 5.0, "kbits": 6, "hb": 3 * DAY_NS},
    {"name": "a20_t20", "alpha": 0.2, "tau": 20.0, "kbits": 6, "hb": 3 * DAY_NS},
    {"name": "a50_t20", "alpha": 0.5, "tau": 20.0, "kbits": 8},
    {"name": "all", "alpha": 0.2, "tau": 0.0, "kbits": 8, "every": True},
]
# The same double arithmetic in the same order, so no rounding is needed.
SENT_COLUMNS = "device_id, sensor, ts_ns, seq, val, pred, res, tau, kbits, policy, reason"

ACCOUNTED = f"""accounted AS (
  SELECT device_id, sensor, seq, arg_min(ts_ns, t_recv_ns) AS ts_ns, min(t_recv_ns) AS t_recv_ns,
    arg_min(bytes, t_recv_ns) AS first_bytes, sum(bytes)::BIGINT AS mqtt_size_bytes, count(*) - 1 AS copies_dropped,
    max(t_recv_ns) AS last_recv_ns, false AS dup_flag, any_value(profile) AS profile, any_value(policy) AS policy
  FROM (SELECT *, {EVENT_BYTES} AS bytes FROM arrivals) GROUP BY device_id, sensor, seq)"""
ACCOUNT_COLUMNS = "device_id, sensor, seq, ts_ns, t_recv_ns, first_bytes, mqtt_size_bytes, copies_dropped, dup_flag"

GOOD_EVENTS = f"""SELECT seq, ts_ns, device_id, sensor, val, pred, res, tau, kbits, profile, policy, NULL::BIGINT AS aoi_ms, t_recv_ns,
  {EVENT_BYTES} AS mqtt_bytes, round((t_recv_ns - ts_ns - 20000000) / 1e6::DOUBLE, 6) AS arrival_age_ms
FROM arrivals WHERE seq % 31 <> 0 AND seq % 37 <> 0 AND seq % 41 <> 0 AND seq % 43 <> 0 AND seq % 47 <> 0"""

CROSSINGS = "crossings AS (SELECT * FROM telemetry WHERE res > CASE WHEN sensor = 'temp' THEN 8.0 ELSE tau END OR seq % 50 = 0)"
HELD = f"""{CROSSINGS},
held AS (SELECT s.seq, s.x, s.profile, s.policy, s.sensor, (
    SELECT arg_max(c.val, (c.ts_ns, c.seq)) FROM crossings c
    WHERE c.device_id = s.device_id AND c.sensor = s.sensor AND c.ts_ns <= s.ts_ns) AS restored FROM samples s)"""

_A = [(i, j) for i in range(6) for j in range(6)]


def model_digits(i: int, j: int = 0) -> int:
    """Decimals of a model sum: where the exact sum cannot be a tie, and above what doubles lose in adding up."""
    return 8 if 3 not in (i, j) or 0 in (i, j) else 3


FITTED = f"""fitted AS (SELECT sensor, arm, count(*) AS tries,
  {', '.join(f"sum(x{i} * x{j}) + {1.0 if i == j else 0.0}::DOUBLE AS a{i}{j}" for i, j in _A)},
  {', '.join(f"sum(reward * x{i}) AS b{i}" for i in range(6))} FROM outcomes GROUP BY sensor, arm)"""
# Gauss-Jordan on [A | b | I], one pivot per step; A is symmetric and positive definite.
_MATRIX = "[" + ", ".join(
    "[" + ", ".join([f"a{i}{j}" for j in range(6)] + [f"b{i}"] + [f"{1.0 if i == j else 0.0}::DOUBLE" for j in range(6)]) + "]"
    for i in range(6)
) + "]"
SOLVED = f"""{FITTED},
steps AS (
  SELECT sensor, arm, 1 AS k, {_MATRIX} AS m FROM fitted
  UNION ALL
  SELECT sensor, arm, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k
      THEN list_transform(row, lambda v: v / row[k])
      ELSE list_transform(row, lambda v, j: v - row[k] * m[k][j] / m[k][k]) END)
  FROM steps WHERE k <= 6),
solved AS (SELECT f.*, s.m FROM fitted f JOIN steps s ON s.sensor = f.sensor AND s.arm = f.arm AND s.k = 7)"""
_X = [f"o.x{i}" for i in range(6)]
_THETA_X = " + ".join(f"s.m[{i + 1}][7] * {_X[i]}" for i in range(6))
_QUADRATIC = " + ".join(f"{_X[i]} * s.m[{i + 1}][{j + 8}] * {_X[j]}" for i, j in _A)
SCORES = f"""{SOLVED},
scores AS (SELECT o.seq, o.sensor, s.arm, ({_THETA_X}) + 0.75::DOUBLE * sqrt(greatest({_QUADRATIC}, 0.0::DOUBLE)) AS score
  FROM outcomes o JOIN solved s ON s.sensor = o.sensor)"""

NOW = 852_076_800_000_000_000
DELAY_1_60 = "least(60.0::DOUBLE, 1.0::DOUBLE * pow(2.0::DOUBLE, greatest(attempts - 1, 0)))"

_DIGEST_LINE = f"""n || '. ' || sensor || ', ' || policy || ' on ' || profile || ': MAE=' || {_text('mae_event_mean', 3)} || ' [P95 '
  || {_text('mae_event_p95', 3)} || '], rate=' || {_text('rate_Bps', 1)} || ' B/s, age ' || {_text('aoi_mean_ms', 1)} || ' ms [P95 '
  || {_text('aoi_p95_ms', 1)} || ' ms], ' || {_text('kbits_mean', 2)} || ' bits, ' || n_events || ' messages'"""
_REPORT_LINE = f"""'| ' || profile || ' | ' || policy || ' | ' || sensor || ' | ' || n_events || ' | ' || {_text('duration_s', 1)}
  || ' | ' || {_text('rate_Bps', 1)} || ' | ' || {_text('aoi_mean_ms', 1)} || ' | ' || {_text('aoi_p95_ms', 1)} || ' | '
  || {_text('mae_event_mean', 3)} || ' | ' || {_text('mae_event_p95', 3)} || ' | ' || {_text('kbits_mean', 2)} || ' |'"""
NUMBERED = f"rounded AS (SELECT {SCENARIO}, {ROUNDED_SUMMARY} FROM summary), numbered AS (SELECT *, row_number() OVER (ORDER BY profile, {RANK}, policy, sensor) AS n, count(*) OVER () AS all_rows FROM rounded)"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["dedup_first"] = _select(["arrivals"], """
SELECT device_id, sensor, seq, ts_ns, t_recv_ns, copy_no, round(val, 6) AS val FROM arrivals
QUALIFY row_number() OVER (PARTITION BY device_id, sensor, seq ORDER BY ts_ns, t_recv_ns) = 1""")
    sql["dedup_accounting"] = _with(["arrivals"], f"WITH {ACCOUNTED} SELECT {ACCOUNT_COLUMNS} FROM accounted")
    sql["collector_totals"] = _with(["arrivals", "decisions"], f"""WITH {ACCOUNTED}
SELECT sum(mqtt_size_bytes)::BIGINT AS bytes_total_including_dups, sum(copies_dropped)::BIGINT AS dup_messages_dropped,
  sum(mqtt_size_bytes - first_bytes)::BIGINT AS dup_bytes_dropped, count(*) AS events_unique,
  least(min(t_recv_ns), (SELECT min(t_recv_ns) FROM decisions)) AS first_recv_ns,
  greatest(max(last_recv_ns), (SELECT max(t_recv_ns) FROM decisions)) AS last_recv_ns,
  (SELECT count(*) FROM decisions) AS decisions_count FROM accounted""")

    sql["event_gaps"] = _select(["telemetry"], f"""
SELECT device_id, sensor, seq, ts_ns - lag(ts_ns) OVER (PARTITION BY {STREAM} ORDER BY ts_ns, seq) AS gap_ns FROM telemetry""")
    sql["aoi_mean"] = _with(["telemetry"], f"WITH {PER_DEVICE_GAPS} SELECT {SCENARIO}, round({MEAN}, 3) AS aoi_mean_ms FROM gaps GROUP BY {SCENARIO}")
    sql["aoi_percentile"] = _on_summary(f"SELECT {SCENARIO}, round(aoi_p95_ms, 3) AS aoi_p95_ms FROM summary")
    sql["aoi_percentile_loop"] = _with(["telemetry"], f"""WITH {PER_DEVICE_GAPS},{_gap_groups('gaps')}
SELECT {SCENARIO}, round(aoi_p95_loop_ms, 3) AS aoi_p95_loop_ms FROM loop""")
    by_stream = _summary_ctes("telemetry", STREAM).replace(f"PARTITION BY {STREAM}, device_id", f"PARTITION BY {STREAM}")
    sql["aoi_mean_and_p95"] = _with(["telemetry"], f"""WITH {by_stream}
SELECT {STREAM}, round(aoi_mean_ms, 3) AS aoi_mean_ms, round(aoi_p95_ms, 3) AS aoi_p95_ms FROM summary WHERE NOT isnan(aoi_mean_ms)""")
    sql["aoi_arrival_order"] = _with(["arrivals"], f"""WITH raw AS (SELECT {SCENARIO},
    ts_ns - lag(ts_ns) OVER (PARTITION BY {SCENARIO}, device_id ORDER BY t_recv_ns, seq, copy_no) AS gap FROM arrivals),
gaps AS (SELECT * FROM raw WHERE gap >= 0),{_gap_groups('gaps')},
means AS (SELECT {SCENARIO}, {MEAN} AS aoi_mean_ms FROM gaps GROUP BY {SCENARIO})
SELECT {SCENARIO}, round(aoi_mean_ms, 3) AS aoi_mean_ms, round(aoi_p95_loop_ms, 3) AS aoi_p95_loop_ms
FROM means JOIN loop USING ({SCENARIO})""")
    sql["online_var"] = _select(["samples"], f"""
SELECT {STREAM}, count(x) AS n, round(avg(x), 11) AS mean, round(coalesce(var_samp(x), 'nan'::DOUBLE), 6) AS var,
  round(coalesce(stddev_samp(x), 'nan'::DOUBLE), 6) AS std FROM samples GROUP BY {STREAM}""")

    sql["event_wire_bytes"] = _select(["telemetry"], f"SELECT seq, {EVENT_BYTES} AS mqtt_bytes FROM telemetry")
    sql["decision_wire_bytes"] = _select(["decisions"], f"""
SELECT seq, {_size("('policy/' || device_id || '/decision')", f"strlen({DECISION_JSON})")} AS mqtt_bytes FROM decisions""")
    doc_topic = "('edge/doc-' || doc_id || '/' || lang || '/event')"
    sql["publish_size"] = f"""SELECT doc_id, {doc_topic} AS topic, (doc_id % 3)::INT AS qos,
  {_size(doc_topic, 'strlen(text)', '(doc_id % 3)')} AS mqtt_bytes FROM documents"""
    sql["remaining_length_bytes"] = """SELECT doc_id, size, CASE WHEN size <= 127 THEN 1 WHEN size <= 16383 THEN 2
  WHEN size <= 2097151 THEN 3 WHEN size <= 268435455 THEN 4 END AS n
FROM (SELECT doc_id, pow(n_chars::DOUBLE, 1 + doc_id % 4)::BIGINT AS size FROM documents)"""
    sql["topic_of"] = _select(["telemetry"], f"SELECT seq, {EVENT_TOPIC} AS event_topic, 'policy/' || device_id || '/decision' AS decision_topic FROM telemetry")
    with_age = f"{EVENT_JSON} || CASE WHEN seq % 3 = 0 THEN ',\"aoi_ms\":' || (seq % 1000) ELSE '' END || '}}'"
    sql["encode_events"] = _select(["telemetry"], f"SELECT seq, {with_age} AS payload, strlen({with_age})::BIGINT AS n_bytes FROM telemetry")
    sql["encode_decisions"] = _select(["decisions"], f"SELECT seq, {DECISION_JSON} AS payload, strlen({DECISION_JSON})::BIGINT AS n_bytes FROM decisions")
    sql["decode_events"] = _select(["arrivals"], GOOD_EVENTS)
    sql["quarantine"] = _select(["arrivals"], f"""
SELECT {EVENT_TOPIC} AS topic, t_recv_ns, CASE WHEN seq % 31 = 0 THEN 'not a JSON object' WHEN seq % 37 = 0
  THEN 'tau missing from message' WHEN seq % 41 = 0 THEN 'no val' ELSE 'no kbits' END AS reasons FROM arrivals
WHERE seq % 47 <> 0 AND (seq % 31 = 0 OR seq % 37 = 0 OR seq % 41 = 0 OR seq % 43 = 0)""")
    sql["quarantine_packets"] = _select(["arrivals"], f"""
SELECT {EVENT_TOPIC} AS topic, t_recv_ns, concat_ws('; ', CASE WHEN seq % 31 = 0 THEN 'not a JSON object' WHEN seq % 37 = 0
  THEN 'tau missing from message' WHEN seq % 41 = 0 THEN 'no val' WHEN seq % 43 = 0 THEN 'no kbits' END,
  CASE WHEN t_recv_ns // 1000000 % 7 = 0 THEN 'qos not 0, 1 or 2' WHEN t_recv_ns // 1000000 % 7 = 1 THEN 'dup with qos 0' END) AS reasons
FROM arrivals WHERE seq % 47 <> 0 AND (seq % 31 = 0 OR seq % 37 = 0 OR seq % 41 = 0 OR seq % 43 = 0 OR t_recv_ns // 1000000 % 7 < 2)""")
    sql["decode_decisions"] = _select(["decisions"], """
SELECT t_recv_ns, ts_ns, device_id, state_aoi, round(state_res, 9) AS state_res, round(state_res_var, 9) AS state_res_var,
  state_loss, state_q_len, tau, kbits, reward FROM decisions""")
    sql["route_messages"] = _select(["arrivals"], """
SELECT CASE WHEN seq % 47 = 0 THEN 'ignored' ELSE 'event' END AS kind, count(*) AS n FROM arrivals GROUP BY 1""")

    sql["validate_events"] = _select(["telemetry"], """
SELECT seq AS id, concat_ws('; ', CASE WHEN seq % 59 = 0 THEN 'no tau' END, CASE WHEN seq % 71 = 0 THEN 'ts out of range' END,
  CASE WHEN seq % 79 = 0 THEN 'seq out of range' END, CASE WHEN seq % 31 <> 0 AND seq % 29 = 0 THEN 'device_id empty' END,
  CASE WHEN seq % 31 = 0 THEN 'device_id with /' END, CASE WHEN seq % 37 = 0 THEN 'sensor not one of mic_rms, temp' END,
  CASE WHEN seq % 43 = 0 THEN 'policy not one of periodic, fixed_tau, adaptive' END,
  CASE WHEN seq % 41 = 0 THEN 'profile not one of slow_10kbps, delay_loss, cellular_var' END,
  CASE WHEN seq % 47 = 0 THEN 'val not finite' END, CASE WHEN seq % 53 = 0 THEN 'res not finite' END,
  CASE WHEN seq % 61 = 0 OR seq % 67 = 0 THEN 'kbits out of range' END,
  CASE WHEN seq % 73 = 0 THEN 'aoi_ms negative' END) AS reasons FROM telemetry""")
    sql["validate_decisions"] = _select(["decisions"], """
SELECT seq AS id, concat_ws('; ', CASE WHEN seq % 61 = 0 THEN 'no reward' END, CASE WHEN seq % 31 = 0 THEN 'device_id with /' END,
  CASE WHEN seq % 37 = 0 THEN 'state_aoi not finite' END, CASE WHEN seq % 43 <> 0 AND seq % 47 = 0 THEN 'state_loss not finite' END,
  CASE WHEN seq % 41 = 0 THEN 'state_res_var negative' END, CASE WHEN seq % 43 = 0 THEN 'state_loss out of range' END,
  CASE WHEN seq % 53 = 0 THEN 'state_q_len negative' END, CASE WHEN seq % 59 = 0 THEN 'kbits out of range' END) AS reasons
FROM decisions""")
    sql["validate_topic"] = """
WITH t AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'edge/+/' || lang WHEN doc_id % 5 = 0 THEN text
    ELSE 'edge/' || lang END AS topic, doc_id % 4 AS qos, doc_id % 2 = 0 AS dup FROM documents)
SELECT doc_id, concat_ws('; ', CASE WHEN topic IS NULL OR topic = '' THEN 'topic empty' END,
  CASE WHEN contains(topic, '+') OR contains(topic, '#') THEN 'topic with wildcard' END,
  CASE WHEN strlen(topic) > 65535 THEN 'topic too long' END,
  CASE WHEN n_chars < 0 THEN 'payload size negative' END,
  CASE WHEN qos NOT IN (0, 1, 2) THEN 'qos not 0, 1 or 2' END, CASE WHEN qos = 0 AND dup THEN 'dup with qos 0' END,
  CASE WHEN 2 + strlen(topic) + CASE WHEN qos > 0 THEN 2 ELSE 0 END + n_chars > 268435455 THEN 'packet too long' END) AS reasons
FROM t"""

    sql["scenario_summary"] = _on_summary(f"SELECT {SCENARIO}, {ROUNDED_SUMMARY} FROM summary")
    sql["run_report"] = sql["scenario_summary"]
    head = [
        "# Scenario summary", "", "Error figures are residuals at sent events, not the error of the restored series.", "",
        "| profile | policy | sensor | events | duration s | rate B/s | AoI mean ms | AoI p95 ms | MAE mean | MAE p95 | bits |",
        "|---|---|---|---:|---:|---:|---:|---:|---:|---:|---:|",
    ]
    fixed = ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(head))
    sql["report_lines"] = _on_summary(f""", {NUMBERED}
SELECT n + {len(head) - 1} AS line_no, {_REPORT_LINE} AS line FROM numbered
UNION ALL SELECT * FROM (VALUES {fixed}) h(line_no, line)""").replace("\n, rounded", ",\nrounded")
    sql["digest_lines"] = _on_summary(f""", {NUMBERED}
SELECT n + 1 AS line_no, {_DIGEST_LINE} AS line FROM numbered WHERE n <= 10
UNION ALL SELECT 0, '**Telemetry summary**'
UNION ALL SELECT 1, 'Top ' || least(count(*), 10) || ' of ' || count(*) || ' rows.' FROM summary
UNION ALL SELECT 12, 'Left out: ' || (count(*) - 10) FROM summary HAVING count(*) > 10""").replace("\n, rounded", ",\nrounded")
    sql["top_scenarios"] = _on_summary(f"""SELECT {SCENARIO}, n_events, round(duration_s, 6) AS duration_s FROM summary
ORDER BY profile, {RANK}, policy, sensor LIMIT 5""")
    sql["scenario_count"] = _select(["samples"], f"SELECT count(*) AS scenarios FROM (SELECT DISTINCT {SCENARIO} FROM samples)")

    coded = f"coded AS (SELECT *, (seq % 16 + 1)::INT AS kbits, {LO} AS lo, {HI} AS hi FROM samples)"
    sql["quantize_readings"] = _with(["samples"], f"""WITH {coded}
SELECT seq, kbits, round({_quantized('x', 'kbits', 'lo', 'hi')}, 6) AS q, ({_code('x', 'kbits', 'lo', 'hi')})::INT AS code,
  x <= lo OR x >= hi AS saturated, round({_step('kbits', 'lo', 'hi')}, 9) AS step FROM coded""")
    sql["dequantize_readings"] = _with(["samples"], f"""WITH {coded},
moved AS (SELECT *, ({_code('x', 'kbits', 'lo', 'hi')})::INT + CASE WHEN seq % 13 = 0 THEN 65536 ELSE 0 END AS code FROM coded)
SELECT seq, code, CASE WHEN code <= pow(2, kbits) - 1 THEN round(lo + code * {_step('kbits', 'lo', 'hi')}, 6) END AS value FROM moved""")
    lo, hi = "-0.25::DOUBLE", "0.25::DOUBLE"
    sql["quantize_array"] = f"""
SELECT vec_id, array_to_string(list_transform(embedding, lambda e: ({_code('e::DOUBLE', '5', lo, hi)})::INT), ' ') AS codes,
  round(list_sum(list_transform(embedding, lambda e: {_quantized('e::DOUBLE', '5', lo, hi)})), 6) AS value_sum FROM embeddings"""
    sql["quantization_report"] = _with(["samples"], f"""WITH
depths(sensor, kbits) AS (VALUES ('mic_rms', 4), ('mic_rms', 6), ('mic_rms', 8), ('temp', 6), ('temp', 8), ('temp', 10)),
graded AS (SELECT s.sensor, d.kbits, s.x, {LO.replace('sensor', 's.sensor')} AS lo, {HI.replace('sensor', 's.sensor')} AS hi
  FROM samples s JOIN depths d ON d.sensor = s.sensor)
SELECT sensor, kbits, count(*) AS n, round(avg((x <= lo OR x >= hi)::INT), 9) AS saturated_share,
  round(avg(abs(x - {_quantized('x', 'kbits', 'lo', 'hi')})), 7) AS mean_abs_error,
  round(max(abs(x - {_quantized('x', 'kbits', 'lo', 'hi')})), 7) AS max_abs_error FROM graded GROUP BY sensor, kbits""")

    sql["send_on_delta"] = _with(["samples"], f"WITH {_trigger_ctes(TRIGGERS)} SELECT {SENT_COLUMNS} FROM sent", recursive=True)
    sql["stream_send_on_delta"] = sql["send_on_delta"]
    stream_window = f"(PARTITION BY {STREAM} ORDER BY ts_ns, seq)"
    sql["carry_forward"] = _with(["temp_samples"], f"""WITH kept AS (SELECT *, CASE WHEN valid OR row_number() OVER {stream_window} = 1
    THEN celsius END AS stored FROM temp_samples)
SELECT seq, valid, last_value(stored IGNORE NULLS) OVER (PARTITION BY {STREAM} ORDER BY ts_ns, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown FROM kept""")
    sql["persistence_forecast"] = _select(["samples"], f"SELECT seq, lag(x) OVER {stream_window} AS forecast FROM samples")
    sql["assign_seq"] = _select(["samples"], f"SELECT seq, row_number() OVER {stream_window} + 99 AS new_seq FROM samples")
    sql["ar1_rls_fit"] = _with(["samples"], f"""WITH pairs AS (SELECT {STREAM}, x, lag(x) OVER {stream_window} AS x1,
    row_number() OVER (PARTITION BY {STREAM} ORDER BY ts_ns DESC, seq DESC) - 1 AS age FROM samples),
sums AS (SELECT {STREAM}, count(*) AS n_pairs, sum(pow(0.99::DOUBLE, age) * x * x1) AS up, sum(pow(0.99::DOUBLE, age) * x1 * x1) AS down
  FROM pairs WHERE x1 IS NOT NULL GROUP BY {STREAM})
SELECT {STREAM}, n_pairs, round(CASE WHEN down > 0 THEN up / down ELSE 1.0 END, 6) AS a FROM sums""")
    sql["ar1_rls_update"] = sql["ar1_rls_update_cut"] = _with(["samples"], f"""WITH pairs AS (SELECT seq, {STREAM}, x, lag(x) OVER {stream_window} AS x1,
    row_number() OVER {stream_window} AS n FROM samples),
sums AS (SELECT seq, {STREAM}, n, x, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM pairs WHERE n = 1
  UNION ALL SELECT p.seq, p.device_id, p.sensor, p.n, p.x, 0.99::DOUBLE * s.up + p.x * p.x1, 0.99::DOUBLE * s.down + p.x1 * p.x1
  FROM sums s JOIN pairs p ON p.device_id = s.device_id AND p.sensor = s.sensor AND p.n = s.n + 1),
known AS (SELECT seq, x, CASE WHEN down > 0 THEN up / down ELSE 1.0 END AS a FROM sums)
SELECT seq, round(a, 6) AS a, round(a * x, 6) AS forecast FROM known""", recursive=True)
    sql["read_mixed_logs"] = _select(["telemetry"], f"SELECT seq, ts_ns, {STREAM}, val, pred, kbits, profile, policy FROM telemetry")
    sql["calibrate"] = _with(["temp_samples"], """WITH c AS (SELECT seq, valid, 1.5::DOUBLE * celsius - 0.75::DOUBLE AS c FROM temp_samples)
SELECT seq, round(c, 6) AS celsius, valid AND c >= 1.0 AND c <= 60.0 AS valid FROM c""")
    sql["clock_drift"] = _with(["clock_pairs"], """WITH d AS (SELECT *, abs(system_us - rtc_us) / 1e6::DOUBLE AS drift_s FROM clock_pairs)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rtc_us, drift_s, drift_s <= 2 AS synced,
  CASE WHEN drift_s <= 2 THEN 'none' WHEN system_us < rtc_us THEN 'step_system' ELSE 'step_rtc' END AS action FROM d""")
    sql["parse_temp_readings"] = _with(["samples"], """WITH t AS (SELECT seq, floor(x * 1000)::BIGINT AS milli, floor(x)::BIGINT AS whole
  FROM samples WHERE sensor = 'temp')
SELECT seq, CASE WHEN seq % 17 <> 0 THEN milli / 1000.0::DOUBLE END AS w1_c, seq % 17 <> 0 AND seq % 13 <> 0 AS w1_valid,
  CASE WHEN seq % 19 = 0 THEN NULL WHEN seq % 2 = 0 THEN CASE WHEN milli > 200 THEN milli / 1000.0::DOUBLE ELSE milli::DOUBLE END
    WHEN whole + 0.5 > 200 THEN (whole + 0.5::DOUBLE) / 1000.0::DOUBLE ELSE whole + 0.5::DOUBLE END AS plain_c,
  seq % 19 <> 0 AS plain_valid FROM t""")
    frames = """frames AS (SELECT vec_id, n AS frame_no, list_slice(pcm, n * 20 + 1, n * 20 + 20) AS frame
  FROM (SELECT vec_id, pcm, unnest(range(len(pcm) // 20)) AS n FROM pcm))"""
    sql["frame_audio"] = _with(["pcm"], f"WITH {frames} SELECT vec_id, frame_no::INT AS frame_no, array_to_string(frame, ' ') AS frame FROM frames")
    sql["frame_rms_dbfs"] = _with(["pcm"], f"""WITH {frames}
SELECT vec_id, frame_no::INT AS frame_no, round(20 * log10(greatest(sqrt(list_sum(list_transform(frame,
    lambda s: (s / 32768.0::DOUBLE) * (s / 32768.0::DOUBLE))) / 20), 1e-12::DOUBLE)) + 3.0::DOUBLE, 6) AS dbfs,
  round(len(list_filter(frame, lambda s: abs(s) >= 8191)) / 20.0::DOUBLE, 6) AS clip_ratio FROM frames""")

    sql["arrival_age"] = _select(["arrivals"], "SELECT seq, copy_no, round((t_recv_ns - ts_ns - 400000000) / 1e6::DOUBLE, 6) AS aoi_ms FROM arrivals")
    sql["age_clamped"] = _select(["clock_pairs"], """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rtc_us,
  round(greatest(0.0::DOUBLE, (system_us / 1e6::DOUBLE - rtc_us / 1e6::DOUBLE) * 1000.0::DOUBLE), 6) AS age_ms FROM clock_pairs""")
    sql["iso_to_epoch"] = "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN round(epoch_us(ts) / 1e6::DOUBLE, 6) END AS epoch_s FROM events"

    sql["backlog_stats"] = _select(["queue"], """SELECT count(*) FILTER (status = 0) AS queued, count(*) FILTER (status = 1) AS inflight,
  count(*) AS total, coalesce(min(id) FILTER (status = 0), 0) AS next_id FROM queue""")
    sql["pending_count"] = _select(["queue"], "SELECT count(*) AS pending FROM queue WHERE status IN (0, 1)")
    sql["ready_messages"] = _select(["queue"], f"SELECT * FROM queue WHERE status = 0 AND available_at_ns <= {NOW} ORDER BY id LIMIT 25")
    sql["stuck_messages"] = _select(["queue"], f"""
SELECT *, {NOW} + ({DELAY_1_60} * 1e9)::BIGINT AS next_available_ns FROM queue WHERE status = 1 AND {NOW} - last_attempt_ns >= 20000000000""")
    sql["retry_delay"] = _select(["queue"], """
SELECT id, attempts, least(20.0::DOUBLE, 0.5::DOUBLE * pow(2.0::DOUBLE, greatest(attempts - 1, 0))) AS delay_s FROM queue""")

    sql["scenario_coverage"] = _with(["telemetry"], """WITH
grid AS (SELECT p AS profile, m AS policy FROM (SELECT unnest(['slow_10kbps', 'delay_loss', 'cellular_var']) AS p),
  (SELECT unnest(['periodic', 'fixed_tau', 'adaptive']) AS m)),
seen AS (SELECT profile, policy, count(DISTINCT floor(ts_ns / (16 * 86400 * 1e9::DOUBLE))) AS n_runs, count(*) AS n_events
  FROM telemetry GROUP BY profile, policy)
SELECT g.profile || '__' || g.policy AS name, g.profile, g.policy, coalesce(n_runs, 0) AS n_runs, coalesce(n_events, 0) AS n_events,
  greatest(3 - coalesce(n_runs, 0), 0) AS missing_runs FROM grid g LEFT JOIN seen s ON s.profile = g.profile AND s.policy = g.policy""")

    def gain(c: str) -> str:
        return f"CASE WHEN b.{c} > 0 AND b.{c} < 'inf'::DOUBLE THEN (b.{c} - c.{c}) / b.{c} * 100.0::DOUBLE ELSE 'nan'::DOUBLE END"

    gains = {"rate": ("rate_Bps", 60), "aoi": ("aoi_mean_ms", 30), "mae": ("mae_event_mean", -10)}
    columns = ", ".join(f"round({gain(c)}, 6) AS {m}_gain_pct, {gain(c)} >= {goal} AS {m}_goal_met" for m, (c, goal) in gains.items())
    sql["improvement_vs_baseline"] = _on_summary(f"""SELECT c.profile, c.sensor, c.policy, {columns}
FROM summary c JOIN summary b ON b.profile = c.profile AND b.sensor = c.sensor AND b.policy = 'periodic' WHERE c.policy <> 'periodic'""")
    sql["pareto_front"] = _on_summary(f"""SELECT {SCENARIO}, round(rate_Bps, 9) AS rate_Bps, round(aoi_mean_ms, 3) AS aoi_mean_ms
FROM summary p WHERE NOT EXISTS (SELECT 1 FROM summary q WHERE q.sensor = p.sensor AND q.rate_Bps <= p.rate_Bps
  AND q.aoi_mean_ms <= p.aoi_mean_ms AND (q.rate_Bps < p.rate_Bps OR q.aoi_mean_ms < p.aoi_mean_ms))""")
    sql["reconstruct_hold"] = _with(["telemetry"], f"WITH {HELD} SELECT seq, x, restored FROM held")
    sql["full_series_mae"] = _with(["telemetry"], f"""WITH {HELD} SELECT {SCENARIO}, count(restored) AS n_readings,
  round(avg(abs(x - restored)), 6) AS mae_full, round(max(abs(x - restored)), 6) AS max_error FROM held GROUP BY {SCENARIO}""")
    sweep_group = "setting_name, profile, policy, sensor"
    sql["policy_sweep"] = _with(["samples"], f"""WITH {_trigger_ctes(SWEEP)},{_summary_ctes('sent', sweep_group)}
SELECT {sweep_group}, {ROUNDED_SUMMARY} FROM summary""", recursive=True)

    sql["bandit_context"] = _select(["outcomes"], "SELECT seq, " + ", ".join(f"round(x{i}, 9) AS x{i}" for i in range(6)) + " FROM outcomes")
    sql["bandit_reward"] = _select(["outcomes"], "SELECT seq, round(reward, 11) AS reward FROM outcomes")
    sql["bandit_fit"] = _with(["outcomes"], f"WITH {FITTED} SELECT sensor, arm, tries, " + ", ".join(
        [f"round(a{i}{j}, {model_digits(i, j)}) AS a{i}{j}" for i, j in _A]
        + [f"round(b{i}, {4 if i else 11}) AS b{i}" for i in range(6)]) + " FROM fitted")
    sql["bandit_theta"] = _with(["outcomes"], f"WITH {SOLVED} SELECT sensor, arm, tries, " + ", ".join(
        [f"round(m[{i + 1}][7], 6) AS theta{i}, round(a{i}{i}, {model_digits(i, i)}) AS d{i}" for i in range(6)]) + " FROM solved", recursive=True)
    sql["bandit_score"] = _with(["outcomes"], f"WITH {SCORES} SELECT seq, arm, round(score, 6) AS score FROM scores", recursive=True)
    sql["bandit_choose"] = _with(["outcomes"], f"""WITH {SCORES} SELECT seq, sensor, arm AS chosen_arm, round(score, 6) AS best_score
FROM scores QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, arm) = 1""", recursive=True)

    sql["stream_events"] = sql["decode_events"]
    unique = "SELECT device_id, sensor, seq, ts_ns, round(val, 6) AS val FROM telemetry"
    sql["stream_dedup"] = sql["stream_dedup_watermark"] = _select(["telemetry"], unique)
    sql["stream_dedup_accounting"] = sql["dedup_accounting"]
    sql["stream_dedup_accounting_watermark"] = f"""SELECT * FROM ({sql["dedup_accounting"]}) a
WHERE ts_ns // 1000000 <= (SELECT max(epoch_us(ts)) // 1000 - 86400000 FROM events)"""
    sql["event_log_round_trip"] = _with(["arrivals"], f"""WITH {ACCOUNTED} SELECT {SCENARIO}, count(*) AS n,
  sum(mqtt_size_bytes)::BIGINT AS bytes, max(t_recv_ns) AS last_recv_ns FROM accounted GROUP BY {SCENARIO}""")
    sql["stream_decisions"] = sql["decision_log_round_trip"] = sql["decode_decisions"]
    sql["collector_meta"] = sql["collector_totals"].replace(
        "SELECT sum(mqtt_size_bytes)", "SELECT 'run-1' AS run_id, 20000000::BIGINT AS clock_offset_ns, sum(mqtt_size_bytes)"
    )
    sql["summary_file"] = _on_summary(f"SELECT row_number() OVER (ORDER BY profile, {RANK}, policy, sensor) AS line_no, {SCENARIO}, {ROUNDED_SUMMARY} FROM summary")
    sql["log_rows_in_order"] = _select(["telemetry"], """
SELECT device_id, sensor, seq, row_number() OVER (PARTITION BY device_id, sensor ORDER BY ts_ns, seq) AS position FROM telemetry""")
    keys = f"{SCENARIO}, device_id"
    sql["stream_aoi"] = _with(["arrivals"], f"""WITH steps AS (
  SELECT {keys}, ts_ns, ts_ns - lag(ts_ns) OVER w AS gap, row_number() OVER w AS i, count(*) OVER (PARTITION BY {keys}) AS rows
  FROM arrivals WINDOW w AS (PARTITION BY {keys} ORDER BY t_recv_ns, seq, copy_no)),
shifted AS (SELECT {keys}, gap, greatest(0, length(bin(gap)) - 11) AS shift FROM steps WHERE gap >= 0),
bins AS (SELECT {keys}, ((gap >> shift) << shift) AS low, ((gap >> shift) << shift) + (1::BIGINT << shift) - 1 AS high,
  count(*) AS n, sum(gap) AS s FROM shifted GROUP BY ALL),
running AS (SELECT *, sum(n) OVER g AS n_all, sum(s) OVER g AS s_all, sum(n) OVER o - n AS n_below, sum(s) OVER o - s AS s_below
  FROM bins WINDOW g AS (PARTITION BY {keys}), o AS (PARTITION BY {keys} ORDER BY low)),
reached AS (SELECT *, (0.95::DOUBLE * s_all::DOUBLE - s_below) / (n_all - n_below) AS age FROM running
  WHERE s_all > 0 AND (s_below + s + high::HUGEINT * (n_all - n_below - n))::DOUBLE >= 0.95::DOUBLE * s_all::DOUBLE),
p95 AS (SELECT {keys}, min_by(least(age, high), low) / 1e6::DOUBLE AS aoi_p95_ms FROM reached GROUP BY {keys}),
means AS (SELECT {keys}, count(gap) FILTER (gap >= 0) AS n_gaps, max(ts_ns) FILTER (i = rows) AS last_ts_ns,
  sum(gap::HUGEINT * gap) FILTER (gap >= 0)::DOUBLE / nullif(2 * sum(gap) FILTER (gap >= 0), 0)::DOUBLE / 1e6::DOUBLE AS aoi_mean_ms
  FROM steps GROUP BY {keys})
SELECT {keys}, n_gaps, last_ts_ns, round(aoi_mean_ms, 3) AS aoi_mean_ms, round(aoi_p95_ms, 3) AS aoi_p95_ms
FROM means LEFT JOIN p95 USING ({keys})""")
    for name in ("send_on_delta", "policy_sweep", "event_gaps", "carry_forward", "reconstruct_hold", "log_rows_in_order"):
        sql[f"{name}_cut"] = sql[name]  # cutting streams changes no result
    return sql

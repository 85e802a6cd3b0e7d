"""The same results in plain SQL, for checking the catalog against another engine."""

from __future__ import annotations

from riskengine.schema import DEVICE_VELOCITY, DISTINCT_COUNTS, FEATURES, PAYER_VELOCITY

TXN = """txn AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, event_id, ts, epoch_us(ts) AS us,
         'u' || user_id AS payer_id, 'd' || json_extract_string(props, '$.k') AS device_id,
         'merchant_' || event_type || '@upi' AS payee_vpa, value AS amount,
         CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END AS is_fraud,
         ts + to_hours(CAST(6 + event_id * 37 % 66 AS INT)) AS label_ts,
         round(value / 500, 6) AS score, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date
  FROM events)"""

ORD = """txn AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, o_orderdate AS ts,
         epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us,
         CAST(o_custkey % 50 AS VARCHAR) AS payer_id, o_orderpriority AS device_id,
         o_orderpriority || o_orderstatus AS payee_vpa, o_totalprice AS amount,
         CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS is_fraud,
         o_orderdate + to_hours(CAST(6 + o_orderkey * 37 % 66 AS INT)) AS label_ts
  FROM orders)"""

GATED = TXN + """, gated AS (
  SELECT CASE WHEN event_id % 67 = 0 THEN CAST(event_id + 1 AS VARCHAR) ELSE transaction_id END AS transaction_id,
         ts, device_id, is_fraud,
         CASE WHEN event_id % 97 = 0 THEN 0.0::DOUBLE WHEN event_id % 101 = 0 THEN 2e6::DOUBLE ELSE amount END AS amount,
         CASE WHEN event_id % 89 = 0 THEN 'USD' ELSE 'INR' END AS currency,
         CASE WHEN event_id % 83 = 0 THEN NULL ELSE payer_id END AS payer_id,
         CASE WHEN event_id % 79 = 0 THEN NULL WHEN event_id % 73 = 0 THEN ts ELSE label_ts END AS label_ts,
         CASE WHEN is_fraud = 1 THEN (CASE WHEN event_id % 2 = 0 THEN 'ring' ELSE 'spike' END) END AS fraud_pattern
  FROM txn)"""


def _span(n: str) -> str:
    return {"5min": "5 MINUTE", "1h": "1 HOUR", "24h": "24 HOUR", "10min": "10 MINUTE", "3d": "3 DAY"}[n]


def _win(part: str, n: str) -> str:
    return (f"OVER (PARTITION BY {part} ORDER BY ts RANGE BETWEEN INTERVAL {_span(n)} PRECEDING "
            "AND INTERVAL 1 MICROSECOND PRECEDING)")


def _counts(part: str, prefix: str, names: tuple[str, ...], sums: bool) -> str:
    out = []
    for n in names:
        out.append(f"count(*) {_win(part, n)} AS {prefix}_count_{n}")
        if sums:
            out.append(f"round(coalesce(sum(amount) {_win(part, n)}, 0), 4) AS {prefix}_sum_{n}")
    return ", ".join(out)


def _first_peer(inner: str, part: str, out: str) -> str:
    return (f"first_value({inner}) OVER (PARTITION BY {part}, ts ORDER BY transaction_id "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {out}")


def _distinct(part: str, value: str, rows: int, name: str) -> str:
    return (f"count(DISTINCT {value}) OVER (PARTITION BY {part} ORDER BY ts, transaction_id "
            f"ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING) AS {name}")


RISK = """risk AS (
  SELECT t.transaction_id, count(h.transaction_id) AS payer_past_fraud_count_30d
  FROM txn t LEFT JOIN txn h ON h.payer_id = t.payer_id AND h.is_fraud = 1
   AND h.ts >= t.ts - INTERVAL 30 DAY AND h.ts < t.ts AND h.label_ts < t.ts
  GROUP BY t.transaction_id)"""


def _features(src: str) -> str:
    return f"""{src}, {RISK}, w AS (
  SELECT transaction_id, ts, payer_id, device_id,
    {_counts('payer_id', 'payer_txn', ('5min', '1h', '24h'), True)},
    {_counts('device_id', 'device_txn', ('1h', '24h'), False)},
    {_distinct('device_id', 'payer_id', 1000, 'dd')}, {_distinct('payer_id', 'payee_vpa', 1000, 'pd')}
  FROM txn), feat AS (
  SELECT w.* EXCLUDE (ts, payer_id, device_id, dd, pd),
    {_first_peer('dd', 'device_id', 'device_distinct_payers_7d')},
    {_first_peer('pd', 'payer_id', 'payer_distinct_payees_7d')}, payer_past_fraud_count_30d
  FROM w JOIN risk USING (transaction_id))"""


# what has arrived with each drop: one copy of the rows per drop, in which keys and ids carry its number
DELAYED = """raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate::TIMESTAMP AS ts, epoch_us(o_orderdate::TIMESTAMP) AS us,
    CAST(o_custkey % 50 AS VARCHAR) AS payer, o_orderpriority AS device, o_orderpriority || o_orderstatus AS payee_vpa,
    CASE WHEN o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 OR o_orderkey % 41 = 0 THEN NULL ELSE o_totalprice END AS amount,
    CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS is_fraud, o_orderdate + to_hours(CAST(6 + o_orderkey * 37 % 66 AS INT)) AS label_ts,
    least(3, (date_diff('day', DATE '1992-01-01', o_orderdate::DATE)
      + CASE WHEN o_orderkey % 9 = 0 THEN 45 WHEN o_orderkey % 7 = 0 THEN 10 ELSE 0 END) // 700) AS arrival FROM orders),
p AS (SELECT payer, arrival, max(max(us)) OVER (PARTITION BY payer ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
      FROM raw GROUP BY payer, arrival),
v AS (SELECT device, arrival, max(max(us)) OVER (PARTITION BY device ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
      FROM raw GROUP BY device, arrival),
txn AS (SELECT s || '|' || id AS transaction_id, s || '|' || payer AS payer_id, s || '|' || device AS device_id, raw.* FROM raw, range(4) t(s)
        WHERE arrival <= s)"""


def _unordered(select: str, lateness_us: int = 20 * 86400 * 10**6) -> str:
    return f"""WITH {_features(DELAYED)}, shown AS (
  SELECT feat.* EXCLUDE (transaction_id), id AS transaction_id, payer AS payer_id, us,
    coalesce(us < p.newest - {lateness_us}, false) OR coalesce(us < v.newest - {lateness_us}, false) AS is_late
  FROM raw JOIN feat ON feat.transaction_id = raw.arrival || '|' || id JOIN p USING (payer, arrival) JOIN v USING (device, arrival))
{select}"""


def _forest(trees: int = 100, sample: int = 256, seed: int = 42) -> str:
    """The forest grown level by level on ``feat``, and ``anomaly``: each row's score."""
    cols = PAYER_VELOCITY + DEVICE_VELOCITY + DISTINCT_COUNTS
    depth, each = (sample - 1).bit_length(), range(1, len(cols) + 1)

    def draw(text):
        return f"('0x' || substr(md5('{seed}:' || {text}), 1, 13))::BIGINT"

    def node_draw(what):
        return f"{draw(f"tree || ':' || node || ':{what}'")} / 4503599627370496.0::DOUBLE"

    def path(n):
        return f"(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1)::DOUBLE / {n} END)"
    parts = [f"x AS MATERIALIZED (SELECT transaction_id, [{', '.join(c + '::DOUBLE' for c in cols)}] AS x FROM feat)",
             f"pool AS (SELECT * FROM x QUALIFY row_number() OVER (ORDER BY {draw('transaction_id')}, transaction_id) <= {trees * sample})",
             f"""l0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, x FROM pool, range({trees}) t(tree) QUALIFY row_number() OVER (
               PARTITION BY tree ORDER BY {draw("tree || ':' || transaction_id")}, transaction_id) <= {sample})"""]
    for d in range(depth + 1):
        low, high = (", ".join(f"{f}(x[{i}])" for i in each) for f in ("min", "max"))
        parts.append(f"""i{d} AS MATERIALIZED (SELECT *, list_filter(range(1, {len(cols) + 1}), lambda i: hi[i] > lo[i]) AS varies
          FROM (SELECT tree, node, count(*) AS n, [{low}] AS lo, [{high}] AS hi FROM l{d} GROUP BY tree, node))""")
        if d < depth:
            parts.append(f"""c{d} AS MATERIALIZED (SELECT tree, node, f, lo[f] + {node_draw('cut')} * (hi[f] - lo[f]) AS cut
              FROM (SELECT *, varies[1 + floor({node_draw('feature')} * len(varies))::INT] AS f FROM i{d} WHERE n > 1 AND len(varies) > 0))""")
            parts.append(f"""l{d + 1} AS MATERIALIZED (SELECT l.tree, CASE WHEN x[f] <= cut THEN 2 * l.node ELSE 2 * l.node + 1 END AS node, x
              FROM l{d} l JOIN c{d} c ON l.tree = c.tree AND l.node = c.node)""")
    parts.append("inside AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM c{d}" for d in range(depth)) + ")")
    ends = " UNION ALL ".join(f"SELECT tree, node, {d} + {path('n')} AS steps FROM i{d}" + (f" ANTI JOIN c{d} USING (tree, node)" if d < depth else "") for d in range(depth + 1))
    parts.append(f"leaves AS MATERIALIZED ({ends})")
    parts.append(f"w0 AS (SELECT transaction_id, x, tree, 1::BIGINT AS node FROM x, range({trees}) t(tree))")
    for d in range(depth):
        parts.append(f"""w{d + 1} AS (SELECT transaction_id, x, w.tree, CASE WHEN f IS NULL THEN w.node WHEN x[f] <= cut THEN 2 * w.node ELSE 2 * w.node + 1 END AS node
          FROM w{d} w LEFT JOIN inside i ON w.tree = i.tree AND w.node = i.node)""")
    parts.append(f"""raw AS MATERIALIZED (SELECT transaction_id, pow(2.0::DOUBLE, -(sum(steps) / {trees}) / {path(f'{sample}.0::DOUBLE')}) AS raw
      FROM w{depth} JOIN leaves USING (tree, node) GROUP BY transaction_id)""")
    parts.append("""anomaly AS (SELECT transaction_id, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS anomaly_score FROM raw)""")
    return ", ".join(parts)


# alerts at budget b: the ceil(b * n) best of each day
def _alerts(b: float, src: str = TXN) -> str:
    return f"""{src}, al AS (
  SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY score DESC, ts, transaction_id)
            <= ceil({b}::DOUBLE * count(*) OVER (PARTITION BY event_date)) AS alert
  FROM txn)"""


def _guard(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0::DOUBLE END)"


def _daily(b: float) -> str:
    return f"""{_alerts(b)}, c AS (
  SELECT event_date, count(*) AS num_transactions, count(*) FILTER (alert) AS num_alerts,
    count(*) FILTER (alert AND is_fraud = 1) AS tp, count(*) FILTER (alert AND is_fraud = 0) AS fp,
    count(*) FILTER (NOT alert AND is_fraud = 1) AS fn, count(*) FILTER (NOT alert AND is_fraud = 0) AS tn
  FROM al GROUP BY event_date), daily AS (
  SELECT *, num_alerts::DOUBLE / num_transactions AS alert_rate, tp + fn AS total_fraud,
    fp + tn AS total_legit, {_guard('tp', 'tp + fp')} AS precision,
    {_guard('tp', 'tp + fn')} AS recall, {_guard('fp', 'fp + tn')} AS false_alert_rate
  FROM c)"""


def _round(sql_cols: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in sql_cols.split())


_RATES = ("round(threshold, 4) AS threshold, round(actual_alert_rate, 4) AS actual_alert_rate, "
          f"round({_guard('tp', 'tp + fp')}, 4) AS precision, round({_guard('tp', 'tp + fn')}, 4) AS recall, "
          f"round({_guard('fp', 'fp + tn')}, 4) AS false_alert_rate, tp AS true_positives, "
          "fp AS false_positives, fn AS false_negatives, tn AS true_negatives, tp + fn AS total_fraud, "
          "tp AS fraud_caught, fn AS fraud_missed, tp + fp AS total_flagged")

_CELLS = """count(*) FILTER (alert AND is_fraud = 1) AS tp, count(*) FILTER (alert AND is_fraud = 0) AS fp,
    count(*) FILTER (NOT alert AND is_fraud = 1) AS fn, count(*) FILTER (NOT alert AND is_fraud = 0) AS tn"""


def _curve(budgets: str) -> str:
    return f"""{TXN}, b AS (SELECT unnest({budgets}::DOUBLE[]) AS alert_budget), al AS (
  SELECT txn.*, alert_budget,
    row_number() OVER (PARTITION BY alert_budget, event_date ORDER BY score DESC, ts, transaction_id)
      <= ceil(alert_budget * count(*) OVER (PARTITION BY alert_budget, event_date)) AS alert
  FROM txn CROSS JOIN b), cells AS (
  SELECT alert_budget, min(score) FILTER (alert) AS threshold,
    count(*) FILTER (alert)::DOUBLE / count(*) AS actual_alert_rate, {_CELLS}
  FROM al GROUP BY alert_budget), curve AS (SELECT alert_budget, {_RATES} FROM cells)"""


_COST = """50000.0::DOUBLE AS avg_fraud_loss, 500.0::DOUBLE AS investigation_cost,
  fraud_caught * 50000.0::DOUBLE AS fraud_prevented_value, fraud_missed * 50000.0::DOUBLE AS fraud_losses,
  total_flagged * 500.0::DOUBLE AS investigation_costs,
  fraud_caught * 50000.0::DOUBLE - total_flagged * 500.0::DOUBLE AS net_savings,
  round(CASE WHEN total_flagged > 0 THEN fraud_caught * 50000.0::DOUBLE / (total_flagged * 500.0::DOUBLE) - 1
        ELSE 0.0::DOUBLE END, 4) AS roi"""

_CURVE_POINTS = """pts AS (
  SELECT score, count(*) AS n, sum(is_fraud) AS pos FROM txn GROUP BY score), cum AS (
  SELECT score, n, pos, sum(n) OVER w AS n_above, sum(pos) OVER w AS pos_above,
    sum(n) OVER () AS total_n, sum(pos) OVER () AS total_pos
  FROM pts WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_AUC = """sum(pos * ((total_n - total_pos) - (n_above - pos_above) + (n - pos) / 2.0::DOUBLE))
      / (max(total_pos)::DOUBLE * (max(total_n) - max(total_pos)))"""
_AP = "sum(pos * (pos_above::DOUBLE / n_above)) / max(total_pos)"

_SALT = "'upi_phase1_v1|'"

RAW = """raw AS (
  SELECT o_orderkey AS k, o_totalprice AS amount, o_orderkey * 61 AS dt,
    CASE WHEN o_orderkey % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_fraud, o_custkey AS card1, o_orderstatus AS card4,
    CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS card6, substr(o_orderpriority, 1, 1) AS product,
    CASE WHEN o_orderkey % 4 = 0 THEN 'dev' || (o_custkey % 100) END AS device
  FROM orders), shaped AS (
  SELECT CAST(k AS VARCHAR) AS transaction_id, amount,
    epoch_us(TIMESTAMP '2025-01-01') + dt * 1000000 AS event_us,
    epoch_us(TIMESTAMP '2025-01-01') + dt * 1000000 + 48 * 3600000000 AS label_us,
    is_fraud, 'INR' AS currency,
    substr(sha256('upi_phase1_v1|' || card1 || '|' || card4 || '|' || coalesce(card6, '')), 1, 12) AS payer_id,
    'merchant_' || product || '@upi' AS payee_vpa,
    CASE WHEN device IS NULL THEN 'unknown_device'
      ELSE substr(sha256('upi_phase1_v1|dev|' || device), 1, 12) END AS device_id, k
  FROM raw), shape AS (SELECT *, 'user_' || payer_id || '@upi' AS payer_vpa FROM shaped)"""

DIRTY = """dirty AS (
  SELECT event_id AS i, CASE WHEN event_id % 41 = 0 THEN NULL ELSE epoch_us(ts) END AS event_us,
    CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 23 = 0 THEN -value
         WHEN event_id % 29 = 0 THEN 0.0::DOUBLE ELSE value END AS amount,
    CASE WHEN event_id % 31 = 0 THEN 'USD' ELSE 'INR' END AS currency, 'user_' || user_id || '@upi' AS payer_vpa,
    CASE WHEN event_id % 43 = 0 THEN NULL ELSE event_type || '@upi' END AS payee_vpa,
    json_extract_string(props, '$.k') AS device_id, user_id AS V1
  FROM events), judged AS (
  SELECT *, [CASE WHEN event_us IS NULL THEN 'event_timestamp: not a timestamp' END,
    CASE WHEN amount IS NULL THEN 'amount: not a double' END,
    CASE WHEN payee_vpa IS NULL THEN 'payee_vpa: missing' END] AS base,
    CASE WHEN amount < 0 THEN 'amount: must not be negative' END AS loose,
    [CASE WHEN amount <= 0 THEN 'amount: must be positive' END,
     CASE WHEN currency <> 'INR' THEN 'currency: only INR is supported' END] AS strict
  FROM dirty), why AS (
  SELECT *, list_filter(list_append(base, loose), lambda x: x IS NOT NULL) AS r_loose,
    list_filter(list_concat(base, strict), lambda x: x IS NOT NULL) AS r_strict FROM judged)"""

SPLIT = """d AS (SELECT min(us) AS min_us, max(us) AS max_us, max(us) - 7 * 86400000000 AS test_start_us,
    max(us) - 7 * 86400000000 - 3600000000 AS train_end_us FROM txn), s AS (
  SELECT txn.*, test_start_us, CASE WHEN us >= test_start_us THEN 'test'
    WHEN us < train_end_us AND epoch_us(label_ts) < test_start_us THEN 'train' ELSE 'excluded' END AS split
  FROM txn CROSS JOIN d)"""


def _rule(suite: str, pos: int, rule: str, column: str, bad: str, total: str = "count(*)") -> str:
    return (f"SELECT '{suite}' AS suite, {pos} AS position, '{rule}' AS rule, '{column}' AS \"column\", "
            f"CAST({bad} AS BIGINT) AS unexpected, {total} AS total FROM gated")


def _quality() -> str:
    t, b = "transactions", "business_logic"
    rules = [_rule(t, i, "column_exists", c, "0", "1::BIGINT") + " LIMIT 1" for i, c in enumerate(
        ("transaction_id", "amount", "event_timestamp", "payer_id", "currency"))]
    rules = [f"({r})" for r in rules]
    rules += [
        _rule(t, 5, "between", "amount", "count(*) FILTER (amount < 0.01)"),
        f"({_rule(t, 6, 'type_is', 'transaction_id', '0', '1::BIGINT')} LIMIT 1)",
        _rule(t, 7, "unique", "transaction_id",
              "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM gated GROUP BY transaction_id) WHERE n > 1)"),
        _rule(t, 8, "greater_than_event_timestamp", "label_available_timestamp", "count(*) FILTER (label_ts <= ts)"),
        _rule(t, 9, "not_null", "label_available_timestamp", "count(*) FILTER (label_ts IS NULL)"),
        _rule(b, 0, "between", "amount", "count(*) FILTER (amount < 0 OR amount > 1000000)"),
        _rule(b, 1, "in_set", "currency", "count(*) FILTER (currency NOT IN ('INR'))"),
        _rule(b, 2, "not_null", "payer_id", "count(*) FILTER (payer_id IS NULL)")]
    return f"""WITH {GATED}, r AS ({' UNION ALL '.join(rules)})
SELECT *, round(100.0::DOUBLE * unexpected / total, 4) AS pct, unexpected = 0 AS success FROM r"""


def _ranges() -> str:
    from riskengine.schema import DEVICE_VELOCITY, DISTINCT_COUNTS, FEATURES, PAYER_VELOCITY
    parts = [f"""SELECT '{c}' AS feature, round(min({c})::DOUBLE, 4) AS min_value, round(max({c})::DOUBLE, 4) AS max_value,
      round(avg({c}), 4) AS avg_value, count(*) FILTER ({c} < 0) AS n_negative,
      count(*) FILTER ({c} IS NULL) AS n_null FROM feat""" for c in FEATURES]
    return f"WITH {_features(TXN)} " + " UNION ALL ".join(parts)


def _report() -> str:
    at = """chosen AS (SELECT *, {cost} FROM curve WHERE alert_budget = 0.01)""".format(cost=_COST)
    base = ["threshold", "actual_alert_rate", "precision", "recall", "false_alert_rate", "true_positives",
            "false_positives", "false_negatives", "true_negatives", "total_fraud", "fraud_caught",
            "fraud_missed", "total_flagged"]
    extra = ["avg_fraud_loss", "investigation_cost", "fraud_prevented_value", "fraud_losses",
             "investigation_costs", "net_savings", "roi"]
    parts = [f"SELECT 'ranking' AS section, '{m}' AS metric, round(({e})::DOUBLE, 4) AS value FROM cum"
             for m, e in (("labelled", "max(total_n)"), ("positives", "max(total_pos)"),
                          ("roc_auc", _AUC), ("pr_auc", _AP))]
    parts += [f"SELECT 'budget', '{m}', round({m}::DOUBLE, 4) FROM chosen" for m in ["alert_budget", *base, *extra]]
    parts += [f"SELECT 'curve@' || alert_budget, '{m}', round({m}::DOUBLE, 4) FROM curve" for m in base]
    return f"WITH {_curve('[0.001, 0.005, 0.01, 0.02, 0.05]')}, {_CURVE_POINTS}, {at} " + " UNION ALL ".join(parts)


_SLICE = """p AS (SELECT payer_id, max(ts) AS pt FROM txn GROUP BY payer_id), sl AS (
  SELECT t.payer_id, t.transaction_id, p.pt, t.amount FROM txn t JOIN p ON t.payer_id = p.payer_id
   AND t.ts >= p.pt - INTERVAL 24 HOUR AND t.ts < p.pt)"""

_ROLL = """num AS (SELECT *, list(score) OVER (PARTITION BY payee_vpa ORDER BY ts, transaction_id
    ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) AS recent FROM txn), thr AS (
  SELECT *, CASE WHEN len(recent) < 50 THEN 0.95::DOUBLE
    ELSE list_sort(recent, 'DESC')[CAST(greatest(1, least(ceil(0.01::DOUBLE * len(recent)), len(recent))) AS BIGINT)]
    END AS alert_threshold FROM num)"""


def _sequential(src: str) -> str:
    """The recursion itself, row by row (not the closed form the Spark job uses)."""
    return f"""n AS (
  SELECT transaction_id, payee_vpa || event_date AS g,
    row_number() OVER (PARTITION BY payee_vpa, event_date ORDER BY ts, transaction_id) AS daily_count,
    CASE WHEN score >= alert_threshold THEN 1 ELSE 0 END AS cand FROM {src}), q AS (
  SELECT *, CAST(greatest(1, floor(daily_count * 0.01::DOUBLE)) AS BIGINT) AS daily_budget FROM n), run AS (
  SELECT g, 1::BIGINT AS i, 0::BIGINT AS before,
    CASE WHEN cand = 1 THEN 1 ELSE 0 END::BIGINT AS issued FROM q WHERE daily_count = 1
  UNION ALL
  SELECT q.g, q.daily_count, run.issued,
    CASE WHEN q.cand = 1 AND run.issued < q.daily_budget THEN run.issued + 1 ELSE run.issued END
  FROM run JOIN q ON q.g = run.g AND q.daily_count = run.i + 1), seq AS (
  SELECT q.transaction_id, q.daily_count, q.daily_budget, run.issued > run.before AS should_alert,
    q.cand = 1 AND run.before >= q.daily_budget AS budget_exceeded,
    greatest(0, q.daily_budget - run.before) AS alert_budget_remaining
  FROM q JOIN run ON run.g = q.g AND run.i = q.daily_count)"""


def _spikes() -> str:
    return f"""WITH {ORD}, h AS (
  SELECT *, count(*) OVER (PARTITION BY payer_id ORDER BY ts RANGE BETWEEN INTERVAL 10 DAY PRECEDING
    AND INTERVAL 1 MICROSECOND PRECEDING) AS before FROM txn), hit AS (
  SELECT *, lag(us) OVER (PARTITION BY payer_id ORDER BY ts, transaction_id) AS prev FROM h WHERE before >= 3), b AS (
  SELECT *, CAST(sum(CASE WHEN us - prev > 864000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY payer_id
    ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS burst FROM hit)
SELECT payer_id, burst, min(us) AS first_hit_us, max(us) AS last_hit_us, count(*) AS n_hits,
  max(before) + 1 AS peak_txns FROM b GROUP BY payer_id, burst"""


SQL: dict[str, str] = {
    "payer_velocity": f"""WITH {TXN} SELECT transaction_id, payer_id,
      {_counts('payer_id', 'payer_txn', ('5min', '1h', '24h'), True)} FROM txn""",
    "payer_velocity_custom_windows": f"""WITH {TXN} SELECT transaction_id, payer_id,
      {_counts('payer_id', 'payer_txn', ('10min', '3d'), True)} FROM txn""",
    "device_velocity": f"""WITH {TXN} SELECT transaction_id, device_id,
      {_counts('device_id', 'device_txn', ('1h', '24h'), False)} FROM txn""",
    "payer_velocity_inclusive_orders": f"""WITH {ORD} SELECT transaction_id, payer_id,
      count(*) OVER w - 1 AS payer_txn_count_24h, round(sum(amount) OVER w - amount, 4) AS payer_txn_sum_24h
      FROM txn WINDOW w AS (PARTITION BY payer_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)""",
    "device_distinct_payers": f"""WITH {ORD}, w AS (SELECT transaction_id, ts, device_id,
      {_distinct('device_id', 'payer_id', 1000, 'x')} FROM txn)
      SELECT transaction_id, {_first_peer('x', 'device_id', 'device_distinct_payers_7d')} FROM w""",
    "payer_distinct_payees": f"""WITH {TXN}, w AS (SELECT transaction_id, ts, payer_id,
      {_distinct('payer_id', 'payee_vpa', 1000, 'x')} FROM txn)
      SELECT transaction_id, {_first_peer('x', 'payer_id', 'payer_distinct_payees_7d')} FROM w""",
    "device_distinct_last20": f"""WITH {TXN}, w AS (SELECT transaction_id, ts, device_id,
      {_distinct('device_id', 'payer_id', 20, 'x')} FROM txn)
      SELECT transaction_id, {_first_peer('x', 'device_id', 'device_distinct_last20')} FROM w""",
    "distinct_payees_7d_range": f"""WITH {TXN} SELECT transaction_id,
      count(DISTINCT payee_vpa) OVER (PARTITION BY payer_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING
      AND INTERVAL 1 MICROSECOND PRECEDING) AS distinct_payees_7d FROM txn""",
    "risk_history": f"WITH {TXN}, {RISK} SELECT * FROM risk",
    "risk_history_orders": f"WITH {ORD}, {RISK} SELECT * FROM risk",
    "full_features": f"WITH {_features(TXN)} SELECT * FROM feat",
    "full_features_orders": f"WITH {_features(ORD)} SELECT * FROM feat",
    "full_features_hot_keys": f"WITH {_features(ORD)} SELECT * FROM feat",
    "history_slice": f"""WITH {TXN}, {_SLICE} SELECT payer_id, transaction_id, epoch_us(pt) AS probe_us, amount FROM sl""",
    "history_slice_totals": f"""WITH {TXN}, p AS (SELECT payer_id, max(ts) AS pt FROM txn GROUP BY payer_id)
      SELECT p.payer_id, count(t.transaction_id) AS txn_count, round(coalesce(sum(t.amount), 0), 4) AS txn_sum
      FROM p LEFT JOIN txn t ON t.payer_id = p.payer_id AND t.ts >= pt - INTERVAL 1 DAY AND t.ts < pt GROUP BY p.payer_id""",
    "history_totals_hot": f"""WITH {ORD}, p AS (SELECT transaction_id, ts AS pt, CASE WHEN transaction_id::BIGINT % 300 <> 0 THEN payer_id ELSE 'nobody' END AS asked
        FROM txn WHERE transaction_id::BIGINT % 100 = 0)
      SELECT p.transaction_id, asked, count(t.transaction_id) AS txn_count, round(coalesce(sum(t.amount), 0), 4) AS txn_sum
      FROM p LEFT JOIN txn t ON t.payer_id = asked AND t.ts >= pt - INTERVAL 365 DAY AND t.ts < pt GROUP BY p.transaction_id, asked""",
    "daily_alerts": f"WITH {_alerts(0.01)} SELECT transaction_id, event_date, alert FROM al",
    "daily_alerts_orders": f"""WITH {ORD}, t2 AS (SELECT transaction_id, date_trunc('month', ts) AS ts,
        floor(amount / 60000) / 10 AS score, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS event_date FROM txn)
      SELECT transaction_id, event_date,
        row_number() OVER (PARTITION BY event_date ORDER BY score DESC, ts, transaction_id)
        <= ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY event_date)) AS alert FROM t2""",
    "alert_day_stats": f"""WITH {_alerts(0.01)} SELECT event_date, count(*) AS num_transactions,
      CAST(ceil(0.01::DOUBLE * count(*)) AS BIGINT) AS budget_quota, count(*) FILTER (alert) AS num_alerts,
      round(count(*) FILTER (alert)::DOUBLE / count(*), 4) AS alert_rate,
      round(min(score) FILTER (alert), 4) AS threshold FROM al GROUP BY event_date""",
    "alert_policy_summary": f"""WITH {_alerts(0.01)} SELECT count(*) FILTER (alert) AS total_alerts,
      round(count(*) FILTER (alert)::DOUBLE / count(*), 4) AS alert_rate,
      round(count(*) FILTER (alert)::DOUBLE / count(*) / 0.01::DOUBLE, 4) AS budget_utilized,
      round(min(score) FILTER (alert), 4) AS threshold_used, count(DISTINCT event_date) AS days_processed FROM al""",
    "budget_threshold": f"""WITH {TXN}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn,
      count(*) OVER () AS n FROM txn)
      SELECT 0.01::DOUBLE AS alert_budget, n, rn AS k, round(score, 4) AS threshold FROM r
      WHERE rn = ceil(0.01::DOUBLE * n)""",
    "rolling_threshold": f"WITH {TXN}, {_ROLL} SELECT transaction_id, payee_vpa, round(alert_threshold, 6) AS alert_threshold FROM thr",
    "sequential_budget": f"""WITH RECURSIVE {TXN}, t AS (SELECT *, 0.15::DOUBLE AS alert_threshold FROM txn),
      {_sequential('t')} SELECT * FROM seq""",
    "online_policy": f"""WITH RECURSIVE {TXN}, {_ROLL}, {_sequential('thr')}
      SELECT transaction_id, should_alert, budget_exceeded, daily_count FROM seq""",
    "risk_tiers": f"""WITH {TXN} SELECT transaction_id, CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high'
      WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_tier FROM txn""",
    "unusable_scores": f"""WITH RECURSIVE {TXN}, u AS (SELECT * REPLACE (CASE WHEN event_id % 10 IN (3, 7) THEN '-inf'::DOUBLE ELSE score END AS score) FROM txn),
      t AS (SELECT *, 0.15::DOUBLE AS alert_threshold FROM u), {_sequential('t')},
      al AS (SELECT *, score >= 0.3 AS alert FROM u), c AS (SELECT {_CELLS} FROM al),
      day AS (SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY score DESC, us, transaction_id) AS rn,
        count(*) OVER (PARTITION BY event_date) AS n FROM u)
      SELECT CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS what,
        count(*) AS n FROM u GROUP BY 1
      UNION ALL SELECT unnest(['tp', 'fp', 'fn', 'tn']), unnest([tp, fp, fn, tn]) FROM c
      UNION ALL SELECT 'issued', count(*) FILTER (should_alert) FROM seq
      UNION ALL SELECT 'unusable in daily top', count(*) FILTER (rn <= ceil(0.95::DOUBLE * n) AND isinf(score)) FROM day""",
    "daily_metrics": f"""WITH {_daily(0.01)} SELECT event_date, num_transactions, num_alerts, tp, fp, fn, tn, total_fraud,
      total_legit, {_round('alert_rate precision recall false_alert_rate')} FROM daily""",
    "cumulative_metrics": f"""WITH {_daily(0.01)}, g AS (SELECT count(*) AS total_days,
      CAST(sum(num_transactions) AS BIGINT) AS total_transactions, CAST(sum(total_fraud) AS BIGINT) AS total_fraud,
      CAST(sum(num_alerts) AS BIGINT) AS total_alerts, CAST(sum(tp) AS BIGINT) AS total_caught,
      CAST(sum(fn) AS BIGINT) AS total_missed, CAST(sum(fp) AS BIGINT) AS total_false_positives,
      round(coalesce(avg(precision) FILTER (num_alerts > 0), 0), 4) AS average_daily_precision,
      round(coalesce(stddev_pop(precision) FILTER (num_alerts > 0), 0), 4) AS std_daily_precision,
      round(coalesce(avg(recall) FILTER (total_fraud > 0), 0), 4) AS average_daily_recall,
      round(coalesce(stddev_pop(recall) FILTER (total_fraud > 0), 0), 4) AS std_daily_recall FROM daily)
      SELECT *, round({_guard('total_caught', 'total_caught + total_false_positives')}, 4) AS overall_precision,
      round({_guard('total_caught', 'total_caught + total_missed')}, 4) AS overall_recall,
      round({_guard('total_alerts', 'total_transactions')}, 4) AS overall_alert_rate FROM g""",
    "budget_adherence": f"""WITH {_daily(0.01)} SELECT event_date, round(alert_rate, 4) AS alert_rate,
      round(0.0085::DOUBLE, 4) AS budget, round(alert_rate - 0.0085::DOUBLE, 4) AS violation FROM daily
      WHERE alert_rate > 0.0085::DOUBLE * 1.2::DOUBLE""",
    "quota_adherence": f"""WITH {_daily(0.01)} SELECT event_date, num_transactions, num_alerts, tp, fp, fn, tn, total_fraud,
      total_legit, {_round('alert_rate precision recall false_alert_rate')},
      CAST(ceil(0.0085::DOUBLE * num_transactions) AS BIGINT) AS budget_quota FROM daily
      WHERE num_alerts > ceil(0.0085::DOUBLE * num_transactions)""",
    "backtest_summary": f"""WITH {_daily(0.01)} SELECT min(event_date) || ' to ' || max(event_date) AS period,
      count(*) AS days_processed, CAST(sum(num_transactions) AS BIGINT) AS total_transactions,
      round({_guard('sum(tp + fn)', 'sum(num_transactions)')}, 4) AS fraud_rate,
      round({_guard('sum(tp)', 'sum(tp + fp)')}, 4) AS overall_precision,
      round({_guard('sum(tp)', 'sum(tp + fn)')}, 4) AS overall_recall,
      CAST(sum(tp) AS BIGINT) AS fraud_caught, CAST(sum(fn) AS BIGINT) AS fraud_missed,
      CASE WHEN count(*) FILTER (alert_rate > 0.0085::DOUBLE * 1.2::DOUBLE) > 0
        THEN count(*) FILTER (alert_rate > 0.0085::DOUBLE * 1.01::DOUBLE) ELSE 0 END AS alert_budget_violations FROM daily""",
    "cumulative_savings": f"""WITH {_daily(0.01)}, s AS (SELECT event_date, tp * 50000.0::DOUBLE AS prevented,
      num_alerts * 500.0::DOUBLE AS cost FROM daily)
      SELECT *, prevented - cost AS net_savings, sum(prevented - cost) OVER (ORDER BY event_date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_savings FROM s""",
    "precision_at_budget_daily": f"WITH {_curve('[0.01]')} SELECT * FROM curve",
    "precision_at_budget_global": f"""WITH {TXN}, th AS (SELECT quantile_cont(score, 0.99) AS threshold FROM txn), al AS (
      SELECT txn.*, threshold, score >= threshold AS alert FROM txn CROSS JOIN th), cells AS (
      SELECT threshold, count(*) FILTER (alert)::DOUBLE / count(*) AS actual_alert_rate, {_CELLS} FROM al GROUP BY threshold)
      SELECT 0.01::DOUBLE AS alert_budget, {_RATES} FROM cells""",
    "budget_curve": f"WITH {_curve('[0.001, 0.005, 0.01, 0.02, 0.05]')} SELECT * FROM curve",
    "best_budget": f"""WITH {_curve('[0.001, 0.005, 0.01, 0.02, 0.05]')} SELECT * FROM curve
      WHERE true_positives >= 0.2 * total_flagged ORDER BY alert_budget DESC LIMIT 1""",
    "cost_benefit": f"WITH {_curve('[0.01]')} SELECT *, {_COST} FROM curve",
    "roc_pr_auc": f"""WITH {TXN}, {_CURVE_POINTS} SELECT CAST(max(total_n) AS BIGINT) AS labelled,
      CAST(max(total_pos) AS BIGINT) AS positives, round({_AUC}, 4) AS roc_auc, round({_AP}, 4) AS pr_auc FROM cum""",
    "recall_at_precision": f"""WITH {TXN}, {_CURVE_POINTS}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.5]::DOUBLE[]) AS target_precision),
      ok AS (SELECT target_precision, score, pos_above, total_pos FROM cum CROSS JOIN t
      WHERE pos_above::DOUBLE / n_above >= target_precision), best AS (
      SELECT *, row_number() OVER (PARTITION BY target_precision ORDER BY pos_above DESC, score DESC) AS rn FROM ok)
      SELECT target_precision, round(pos_above::DOUBLE / total_pos, 4) AS recall, round(score, 4) AS threshold
      FROM best WHERE rn = 1""",
    "confusion_at_threshold": f"""WITH {TXN}, al AS (SELECT *, score >= 0.3 AS alert FROM txn), c AS (SELECT {_CELLS} FROM al), p AS (
      SELECT *, {_guard('tp', 'tp + fp')} AS pr, {_guard('tp', 'tp + fn')} AS rc FROM c)
      SELECT 0.3::DOUBLE AS threshold, tp, fp, fn, tn, round(pr, 4) AS precision, round(rc, 4) AS recall,
      round({_guard('2 * pr * rc', 'pr + rc')}, 4) AS f1, round({_guard('tp + tn', 'tp + fp + fn + tn')}, 4) AS accuracy FROM p""",
    "exact_percentiles": f"""WITH {TXN}, q AS (SELECT unnest([0.0, 0.25, 0.5, 0.95, 0.99, 1.0]::DOUBLE[]) AS quantile,
      unnest(quantile_cont(amount, [0.0, 0.25, 0.5, 0.95, 0.99, 1.0])) AS value FROM txn)
      SELECT quantile, round(value, 4) AS value FROM q""",
    "service_summary": f"""WITH {TXN} SELECT count(*) AS total_requests, count(*) FILTER (score > 0.2) AS total_alerts,
      count(*) FILTER (payee_vpa = 'merchant_error@upi') AS error_count, round(avg(amount), 4) AS avg_latency_ms,
      round(count(*) FILTER (score > 0.2)::DOUBLE / count(*), 4) AS alert_rate,
      round(quantile_cont(amount, 0.5), 4) AS p50_latency_ms, round(quantile_cont(amount, 0.95), 4) AS p95_latency_ms,
      round(quantile_cont(amount, 0.99), 4) AS p99_latency_ms,
      round(count(*) / greatest((max(us) - min(us)) / 1e6::DOUBLE, 1.0), 4) AS requests_per_second,
      (SELECT round(count(*) FILTER (score > 0.2)::DOUBLE / count(*), 4) FROM txn WHERE event_date = (SELECT max(event_date) FROM txn)) AS daily_budget_utilization
      FROM txn""",
    "score_by_class": f"""WITH {TXN} SELECT is_fraud, count(*) AS n, round(avg(score), 4) AS mean_score,
      round(stddev_samp(score), 4) AS std_score, round(min(score), 4) AS min_score, round(max(score), 4) AS max_score
      FROM txn GROUP BY is_fraud""",
    "tier_distribution": f"""WITH {TXN} SELECT CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high'
      WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_tier, count(*) AS n,
      count(*) FILTER (is_fraud = 1) AS frauds FROM txn GROUP BY 1""",
    "evaluation_report": _report(),
    "standardise_upi": f"WITH {RAW} SELECT * EXCLUDE (k) FROM shape",
    "generate_dataset": f"""WITH {RAW} SELECT shape.* EXCLUDE (k) REPLACE (
      CASE WHEN o_orderstatus = 'F' THEN is_fraud END AS is_fraud), c_mktsegment AS id_12
      FROM shape JOIN orders ON o_orderkey = k LEFT JOIN customer ON c_custkey = k""",
    "payer_fingerprint": f"""WITH h AS (SELECT *, substr(sha256({_SALT} || o_custkey || '|' || o_orderstatus || '|'
      || o_orderpriority), 1, 12) AS payer_id FROM orders)
      SELECT o_orderkey, payer_id, 'user_' || payer_id || '@upi' AS payer_vpa,
      CASE WHEN o_orderkey % 4 = 0 THEN substr(sha256('upi_phase1_v1|dev|' || o_orderpriority), 1, 12)
      ELSE 'unknown_device' END AS device_id, 'merchant_' || o_orderstatus || '@upi' AS payee_vpa FROM h""",
    "identity_merge": """SELECT o_orderkey AS "TransactionID", o_custkey, o_totalprice, c_name, c_acctbal
      FROM orders LEFT JOIN customer ON o_orderkey = c_custkey""",
    "identity_key_check": """SELECT (SELECT count(*) FROM orders) AS n_before,
      (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey) AS n_after""",
    "normalise_vpa": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR)
      WHEN event_id % 3 = 1 THEN event_type || '.' || user_id ELSE user_id || '@bank' END AS payer_id,
      CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch FROM events""",
    "contract_valid": f"""WITH {DIRTY} SELECT CAST(i AS VARCHAR) AS transaction_id, event_us, round(amount, 4) AS amount,
      currency, payer_vpa, payee_vpa, device_id, V1 FROM why WHERE len(r_loose) = 0""",
    "contract_rejects": f"""WITH {DIRTY} SELECT CAST(i AS VARCHAR) AS transaction_id, array_to_string(r_loose, '; ') AS reasons
      FROM why WHERE len(r_loose) > 0""",
    "contract_strict": f"""WITH {DIRTY} SELECT CAST(i AS VARCHAR) AS transaction_id, array_to_string(r_strict, '; ') AS reasons
      FROM why WHERE len(r_strict) > 0""",
    "quality_report": _quality(),
    "event_gate": f"""WITH {GATED} SELECT transaction_id,
      amount > 0 AND currency = 'INR' AND (label_ts IS NULL OR label_ts > ts) AS passed FROM gated""",
    "fraud_summary": f"""WITH {GATED} SELECT fraud_pattern, count(*) AS n, count(*) FILTER (is_fraud = 1) AS frauds,
      round(avg(is_fraud), 4) AS fraud_rate FROM gated GROUP BY fraud_pattern""",
    "table_profile": f"""WITH {GATED} SELECT count(*) AS n_rows, count(DISTINCT transaction_id) AS n_ids,
      CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_day,
      count(is_fraud) AS n_labelled, count(*) FILTER (is_fraud = 1) AS n_fraud FROM gated""",
    "dataset_validation": f"""WITH {GATED}
      SELECT 'unique' AS rule, CAST((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM gated GROUP BY transaction_id)
        WHERE n > 1) AS BIGINT) AS unexpected, count(*) AS total FROM gated UNION ALL
      SELECT 'greater_than_event_timestamp', count(*) FILTER (label_ts <= ts), count(*) FROM gated UNION ALL
      SELECT 'not_null', count(*) FILTER (ts IS NULL), count(*) FROM gated UNION ALL
      SELECT 'increasing', count(*) FILTER (ts < before), count(*) FROM (
        SELECT ts, lag(ts) OVER (ORDER BY device_id, ts, transaction_id) AS before FROM gated) UNION ALL
      SELECT 'fraud_total', count(*) FILTER (is_fraud = 1), count(*) FROM gated""",
    "order_rules": """WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS amount FROM orders),
      t AS (SELECT count(*) AS n, count(*) FILTER (o_orderdate < before) AS bad FROM (SELECT *, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS before FROM o)),
      a AS (SELECT count(*) AS n, count(*) FILTER (amount < before) AS bad FROM (SELECT *, lag(amount) OVER (ORDER BY o_orderkey) AS before FROM o WHERE amount IS NOT NULL)),
      e(position, rule, "column", unexpected, total, mostly) AS (SELECT 0, 'increasing', 'number', 0, n, 1.0::DOUBLE FROM t
        UNION ALL SELECT 1, 'increasing', 'event_timestamp', bad, n, 1.0::DOUBLE FROM t UNION ALL SELECT 2, 'increasing', 'event_timestamp', bad, n, 0.45::DOUBLE FROM t
        UNION ALL SELECT 3, 'increasing', 'amount', bad, n, 0.6::DOUBLE FROM a UNION ALL SELECT 4, 'not_null', 'amount', t.n - a.n, t.n, 1.0::DOUBLE FROM t, a)
      SELECT 'order' AS suite, position, rule, "column", unexpected, total, round(100.0::DOUBLE * unexpected / total, 4) AS pct,
        total - unexpected >= mostly * total AS success FROM e""",
    "label_delay_stats": f"""WITH {GATED}, h AS (SELECT (epoch_us(label_ts) - epoch_us(ts)) / 3600000000.0::DOUBLE AS h FROM gated)
      SELECT count(h) AS n, round(avg(h), 4) AS avg_hours, round(min(h), 4) AS min_hours, round(max(h), 4) AS max_hours,
      count(*) FILTER (h <= 0) AS not_after_event FROM h""",
    "feature_ranges": _ranges(),
    "monotonicity_violations": f"""WITH {_features(TXN)} SELECT transaction_id FROM feat
      WHERE transaction_id::BIGINT % 89 = 0 OR payer_txn_count_5min > payer_txn_count_1h OR payer_txn_count_1h > payer_txn_count_24h
      OR device_txn_count_1h > device_txn_count_24h""",
    "consistency_check": f"""WITH {_features(TXN)}, t AS (SELECT count(*) AS n_transactions, avg(is_fraud) AS fr FROM txn),
      f AS (SELECT count(*) AS n_features FROM feat)
      SELECT n_transactions, round(fr, 4) AS fraud_rate, n_features, n_transactions = n_features AS rows_match,
      true AS columns_match, fr BETWEEN 0 AND 0.2 AS fraud_rate_in_band FROM t CROSS JOIN f""",
    "split_dates": f"""WITH {TXN}, {SPLIT} SELECT min_us, max_us, 0::BIGINT AS null_times, train_end_us, test_start_us,
      CAST(floor((train_end_us - min_us) / 86400000000) AS BIGINT) AS train_days, 7 AS min_train_days FROM d""",
    "temporal_split": f"WITH {TXN}, {SPLIT} SELECT transaction_id, split FROM s WHERE split <> 'excluded'",
    "split_stats": f"""WITH {TXN}, {SPLIT} SELECT split, count(*) AS n, count(is_fraud) AS labelled,
      count(*) FILTER (is_fraud = 1) AS frauds, count(*) FILTER (is_fraud = 0) AS legit,
      count(is_fraud)::DOUBLE / count(*) >= 0.8 AS enough_labels FROM s GROUP BY split""",
    "leakage_report": f"""WITH {TXN}, {SPLIT}, f AS (SELECT min(us) AS t FROM s WHERE split = 'test')
      SELECT 'time_overlap' AS "check", count(*) AS violations FROM s, f WHERE split = 'train' AND us >= t UNION ALL
      SELECT 'late_labels', count(*) FROM s WHERE split = 'train' AND epoch_us(label_ts) >= test_start_us UNION ALL
      SELECT 'shared_ids', count(*) FROM (SELECT transaction_id FROM s WHERE split = 'train'
        INTERSECT SELECT transaction_id FROM s WHERE split = 'test')""",
    "validation_tail": f"""WITH {TXN}, {SPLIT}, tr AS (SELECT *, row_number() OVER (ORDER BY us DESC) AS rn,
      count(*) OVER () AS n FROM s WHERE split = 'train'), cut AS (
      SELECT us AS c FROM tr WHERE rn = greatest(1, floor(n * 0.2::DOUBLE)))
      SELECT transaction_id, us >= c AS is_validation FROM tr CROSS JOIN cut""",
    "device_rings": f"""WITH {TXN} SELECT device_id, count(DISTINCT payer_id) AS n_payers, count(*) AS n_txns,
      count(*) FILTER (is_fraud = 1) AS n_fraud FROM txn GROUP BY device_id HAVING count(DISTINCT payer_id) >= 3""",
    "ring_members": f"""WITH {TXN}, r AS (SELECT device_id, count(DISTINCT payer_id) AS n_payers FROM txn GROUP BY device_id
      HAVING count(DISTINCT payer_id) >= 3) SELECT device_id, payer_id, count(*) AS n_txns, max(n_payers) AS n_payers
      FROM txn JOIN r USING (device_id) GROUP BY device_id, payer_id""",
    "active_payers": f"""WITH {TXN} SELECT payer_id, count(*) AS n_legit FROM txn WHERE is_fraud = 0
      GROUP BY payer_id HAVING count(*) >= 10""",
    "velocity_spikes": _spikes(),
    "velocity_spikes_hot": _spikes(),
    "night_anomalies": f"""WITH {TXN}, g AS (SELECT payer_id, count(*) AS n_txns,
      count(*) FILTER (hour(ts) BETWEEN 2 AND 4) AS n_night,
      count(*) FILTER (hour(ts) BETWEEN 2 AND 4 AND is_fraud = 1) AS n_night_fraud FROM txn GROUP BY payer_id)
      SELECT *, round(n_night::DOUBLE / n_txns, 4) AS night_share FROM g WHERE n_night > 0""",
    "pattern_members": f"""WITH {GATED} SELECT DISTINCT fraud_pattern, payer_id, device_id,
      CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM gated WHERE fraud_pattern = 'ring'""",
    "batch_stream_diff": f"""WITH {TXN} SELECT transaction_id,
      CASE WHEN payee_vpa = 'merchant_error@upi' THEN '<row>' ELSE 'amount' END AS "column" FROM txn
      WHERE payee_vpa = 'merchant_error@upi' OR amount <> floor(amount)""",
    "union_train_test": f"""WITH {TXN} SELECT transaction_id, amount, payee_vpa,
      CASE WHEN payee_vpa <> 'merchant_view@upi' THEN is_fraud::DOUBLE END AS is_fraud FROM txn""",
    "top_scores": f"""WITH {TXN} SELECT transaction_id, score AS fraud_probability FROM txn
      ORDER BY score DESC, transaction_id LIMIT 10""",
    "first_by_time": f"WITH {ORD} SELECT transaction_id, payer_id FROM txn ORDER BY ts, transaction_id LIMIT 100",
    "labelled_rows": f"""WITH {TXN} SELECT transaction_id,
      CASE WHEN payee_vpa <> 'merchant_view@upi' THEN 'labelled' ELSE 'unlabelled' END AS part FROM txn""",
    "training_table": f"""WITH {_features(TXN)} SELECT transaction_id, payer_id, payee_vpa, round(amount, 4) AS amount,
      'INR' AS currency, payer_txn_count_24h, device_txn_count_24h, is_fraud FROM feat JOIN txn USING (transaction_id)""",
    "distinct_devices": f"WITH {TXN} SELECT DISTINCT payer_id, device_id FROM txn",
    "id_overlap": f"""WITH {TXN} SELECT transaction_id FROM txn
      WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""",
    "scaled_features": f"""WITH {TXN} SELECT transaction_id,
      round((amount - avg(amount) OVER ()) / stddev_pop(amount) OVER (), 4) AS amount,
      round((score - avg(score) OVER ()) / stddev_pop(score) OVER (), 4) AS fraud_probability FROM txn""",
    "aligned_matrix": f"""WITH {TXN} SELECT transaction_id, CASE WHEN event_id % 11 = 0 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS "V2",
      CASE WHEN event_id % 7 <> 0 THEN round(amount, 4) ELSE 0.0::DOUBLE END AS amount,
      CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE round(amount, 4) END AS "V1", 0.0::DOUBLE AS "V9" FROM txn""",
    "class_weight": f"""WITH {TXN} SELECT count(*) FILTER (is_fraud = 0) AS n_legit, count(*) FILTER (is_fraud = 1) AS n_fraud,
      round(count(*) FILTER (is_fraud = 0)::DOUBLE / count(*) FILTER (is_fraud = 1), 4) AS weight FROM txn""",
    "label_encode": f"""WITH {TXN}, v AS (SELECT DISTINCT 'payee_vpa' AS "column", payee_vpa AS value FROM txn UNION ALL
      SELECT DISTINCT 'device_id', CASE WHEN event_id % 13 <> 0 THEN device_id ELSE '__MISSING__' END FROM txn)
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code FROM v""",
    "encoded_rows": f"""WITH {TXN}, t AS (SELECT transaction_id, ts, payee_vpa,
      CASE WHEN amount > 5 THEN device_id || '/' || payee_vpa ELSE '__MISSING__' END AS pair FROM txn),
      early AS (SELECT * FROM t WHERE ts < TIMESTAMP '2024-01-10'),
      a AS (SELECT pair, dense_rank() OVER (ORDER BY pair) - 1 AS code FROM (SELECT DISTINCT pair FROM early)),
      b AS (SELECT payee_vpa, dense_rank() OVER (ORDER BY payee_vpa) - 1 AS code FROM (SELECT DISTINCT payee_vpa FROM early))
      SELECT transaction_id, coalesce(a.code, (SELECT code FROM a WHERE pair = '__MISSING__'), 0) AS pair_code,
      coalesce(b.code, 0) AS payee_code FROM t LEFT JOIN a USING (pair) LEFT JOIN b USING (payee_vpa)""",
    "anomaly_scores": f"WITH {_features(TXN)}, {_forest()} SELECT transaction_id, round(anomaly_score, 4) AS anomaly_score FROM anomaly",
    "anomaly_top_precision": f"""WITH {_features(TXN)}, {_forest()}, r AS (
      SELECT anomaly_score AS s, is_fraud, row_number() OVER (ORDER BY anomaly_score DESC) AS n, count(*) OVER () AS total
      FROM anomaly JOIN txn USING (transaction_id))
      SELECT count(*) AS n_flagged, round(avg(is_fraud), 4) AS precision FROM r
      WHERE s >= (SELECT min(s) FROM r WHERE n <= ceil(0.01::DOUBLE * total))""",
    "anomaly_contract": "SELECT * FROM (VALUES " + ", ".join(
        [f"('{c}', '{'missing' if c == 'payer_txn_sum_1h' else 'used'}')" for c in PAYER_VELOCITY + DEVICE_VELOCITY + DISTINCT_COUNTS]
        + [f"('{c}', 'forbidden')" for c in ("payer_past_fraud_count_30d", "is_fraud")])
        + """) AS v("column", state), (SELECT count(*) AS n_rows FROM events)""",
    "model_inputs": """SELECT c AS "column", 'numeric' AS kind, count(*) AS n_values FROM events, (VALUES """ + ", ".join(
        f"('{c}')" for c in [*FEATURES, "amount"]) + ") AS v(c) GROUP BY c",
    "model_node_tables": f"""WITH {TXN}, {SPLIT} SELECT model, stage, count(*) AS n_compared, 0 AS n_one_sided, 0 AS n_rows_different,
      0 AS n_cells_different FROM s, (VALUES ('forest', 'trained'), ('forest', 'loaded'), ('boosted', 'trained'), ('boosted', 'loaded'))
      AS v(model, stage) WHERE split = 'test' GROUP BY model, stage""",
    "backtest_range": f"""WITH {_daily(0.01)} SELECT event_date, num_transactions, num_alerts, tp, fp, fn, tn, total_fraud,
      total_legit, {_round('alert_rate precision recall false_alert_rate')} FROM daily
      WHERE event_date BETWEEN '2024-01-08' AND '2024-01-14'""",
    "stream_features_parity": f"WITH {_features(TXN)} SELECT * FROM feat",
    "stream_parity_differences": """SELECT 'streamed' AS against, count(*) AS n_compared, 0 AS n_one_sided, 0 AS n_rows_different,
      0 AS n_cells_different FROM events
      UNION ALL SELECT 'damaged', count(*) FILTER (event_id % 97 <> 0), count(*) FILTER (event_id % 97 = 0),
      count(*) FILTER (event_id % 97 <> 0 AND (event_id % 50 = 0 OR event_id % 61 = 0)),
      count(*) FILTER (event_id % 97 <> 0 AND event_id % 50 = 0) + count(*) FILTER (event_id % 97 <> 0 AND event_id % 61 = 0) FROM events""",
    "stream_out_of_order": _unordered("SELECT transaction_id, is_late, " + ", ".join(
        f"CASE WHEN NOT is_late THEN {c} END AS {c}" for c in FEATURES) + " FROM shown"),
    "stream_late_rows": _unordered("SELECT payer_id, count(*) AS n_late, min(us) AS first_us FROM shown WHERE is_late GROUP BY payer_id"),
    "stream_label_feed": f"WITH {_features(TXN)} SELECT * FROM feat",
    "stream_alert_policy": f"""WITH RECURSIVE {TXN}, {_ROLL}, {_sequential('thr')}
      SELECT transaction_id, should_alert, budget_exceeded, daily_count FROM seq""",
    "stream_daily_metrics": f"""WITH {TXN} SELECT event_date, count(*) AS total_requests,
      count(*) FILTER (score > 0.2) AS total_alerts, count(*) FILTER (payee_vpa = 'merchant_error@upi') AS error_count,
      round(avg(score), 4) AS avg_score, round(avg(amount), 4) AS avg_latency_ms,
      round(quantile_cont(round(amount, 3), 0.5), 4) AS p50_latency_ms, round(quantile_cont(round(amount, 3), 0.95), 4) AS p95_latency_ms,
      round(quantile_cont(round(amount, 3), 0.99), 4) AS p99_latency_ms,
      round(count(*) / greatest((max(us) - min(us)) / 1e6::DOUBLE, 1.0), 4) AS requests_per_second,
      round(count(*) FILTER (score > 0.2)::DOUBLE / count(*), 4) AS daily_budget_utilization FROM txn GROUP BY event_date""",
    "stream_gate": f"""WITH {GATED} SELECT transaction_id FROM gated
      WHERE NOT (amount > 0 AND currency = 'INR' AND (label_ts IS NULL OR label_ts > ts))""",
    "stream_deduplicated": f"WITH {TXN} SELECT transaction_id, amount FROM txn",
    "stream_seek": f"WITH {TXN} SELECT transaction_id FROM txn WHERE ts >= TIMESTAMP '2024-01-20'",
    "stream_keyed_features": f"WITH {_features(TXN)} SELECT * FROM feat",
    "csv_to_table": f"""WITH {TXN} SELECT transaction_id, us AS event_us, payer_id, round(amount, 4) AS amount,
      event_date FROM txn""",
    "csv_with_time_format": f"WITH {TXN} SELECT transaction_id, us AS event_us, round(amount, 4) AS amount FROM txn",
    "feature_sink": f"""WITH {TXN} SELECT transaction_id, payer_id,
      {_counts('payer_id', 'payer_txn', ('5min', '1h', '24h'), True)} FROM txn""",
    "replaced_column": f"WITH {TXN} SELECT transaction_id, device_id AS payer_id FROM txn",
    "raw_column_families": f"""WITH {TXN} SELECT unnest(['V1', 'id-02', 'R_emaildomain']) AS "column",
      unnest([count(amount), count(payer_id), count(payee_vpa)]) AS n FROM txn""",
    "sampled_rows": f"WITH {TXN} SELECT transaction_id, amount FROM txn ORDER BY md5(transaction_id || ':42'), transaction_id LIMIT 100",
    "one_day_scan": f"""WITH {TXN} SELECT transaction_id, round(amount, 4) AS amount FROM txn
      WHERE event_date = '2024-01-15'""",
    "report_round_trip": f"""WITH {_daily(0.01)} SELECT event_date, num_transactions, num_alerts, tp, fp, fn, tn, total_fraud,
      total_legit, {_round('alert_rate precision recall false_alert_rate')} FROM daily""",
    "sorted_table": "SELECT 1.0::DOUBLE AS lowest_share, true AS in_order, count(*) AS n FROM events",
}
SQL["encoded_rows_joined"] = SQL["encoded_rows"]

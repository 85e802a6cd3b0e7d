"""Row builders and brute-force yardsticks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

TXN = ("transaction_id string, event_timestamp timestamp, payer_id string, device_id string, payee_vpa string, "
       "amount double, is_fraud int, label_available_timestamp timestamp")
US = timedelta(microseconds=1)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def fixture_a(t1_fraud=False, label="10:30"):
    day = "2024-01-01 "
    rows = [("t1", "10:00:00", 10.0), ("t2", "10:01:00", 20.0), ("t3", "10:02:00", 30.0), ("t4", "10:10:00", 100.0)]
    return [(i, at(day + t), "user_A", "device_X", f"merchant_{n}@upi", a, int(t1_fraud and i == "t1"),
             at(day + (label if i == "t1" else "10:30") + ":00"))
            for n, (i, t, a) in enumerate(rows, 1)]


def fixture_b():
    rows = [("t1", "01 10:00", "u1", "d1", "m1@upi", 100.0, 0, "02 10:00"),
            ("t2", "01 10:01", "u1", "d1", "m2@upi", 200.0, 0, "02 10:05"),
            ("t3", "01 10:10", "u2", "d2", "m3@upi", 300.0, 1, "01 10:11"),
            ("t4", "01 10:20", "u2", "d2", "m1@upi", 50.0, 0, "02 10:20")]
    return [(i, at(f"2024-01-{t}"), p, d, v, a, f, at(f"2024-01-{x}")) for i, t, p, d, v, a, f, x in rows]


def messy(n=600, seed=3, payers=4, devices=3, null_share=0.1):
    """Few keys, many equal times, NULL keys, labels before and long after events."""
    r = random.Random(seed)
    base = datetime(2024, 1, 1)
    out = []
    for i in range(n):
        ts = base + timedelta(hours=r.randrange(0, 24 * 45))
        delay = r.choice([-5, 0, 6, 48, 71, 24 * 40])
        out.append((f"x{i:05d}", ts,
                    None if r.random() < null_share else f"u{r.randrange(payers)}",
                    None if r.random() < null_share else f"d{r.randrange(devices)}",
                    None if r.random() < 0.05 else f"m{r.randrange(12)}",
                    round(r.uniform(1, 500), 2), r.choice([0, 0, 1, None]),
                    None if r.random() < 0.1 else ts + timedelta(hours=delay)))
    return out


def brute(rows, last_rows=1000):
    """Features straight from their definitions, one row at a time."""
    out = {}
    for tid, ts, payer, device, payee, amount, fraud, label in rows:
        past_p = [] if payer is None else sorted((x for x in rows if x[2] == payer and x[1] < ts), key=lambda x: (x[1], x[0]))
        past_d = [] if device is None else sorted((x for x in rows if x[3] == device and x[1] < ts), key=lambda x: (x[1], x[0]))
        f = {}
        for name, secs in (("5min", 300), ("1h", 3600), ("24h", 86400)):
            win = [x for x in past_p if x[1] >= ts - timedelta(seconds=secs)]
            f[f"payer_txn_count_{name}"] = len(win)
            f[f"payer_txn_sum_{name}"] = sum(x[5] for x in win)
            if name != "5min":
                f[f"device_txn_count_{name}"] = len([x for x in past_d if x[1] >= ts - timedelta(seconds=secs)])
        f["device_distinct_payers_7d"] = len({x[2] for x in past_d[-last_rows:] if x[2] is not None})
        f["payer_distinct_payees_7d"] = len({x[4] for x in past_p[-last_rows:] if x[4] is not None})
        f["payer_past_fraud_count_30d"] = len([
            x for x in past_p if x[6] == 1 and x[7] is not None and x[7] < ts and x[1] >= ts - timedelta(days=30)])
        out[tid] = f
    return out


def assert_same(got: dict, want: dict):
    assert set(got) == set(want)
    for tid, f in want.items():
        for name, v in f.items():
            assert abs(got[tid][name] - v) < 1e-6, (tid, name, got[tid][name], v)

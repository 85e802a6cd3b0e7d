import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import TXN, US, assert_same, at, brute, fixture_a, fixture_b, messy
from riskengine.operators import heat, history
from riskengine.operators.features import build_features
from riskengine.schema import FEATURE_SCHEMA, assert_feature_schema


def feats(spark, rows, **kw):
    return {r["transaction_id"]: r.asDict() for r in build_features(spark.createDataFrame(rows, TXN), **kw).collect()}


def test_velocity_sees_only_the_past(spark):
    got = feats(spark, fixture_a())
    assert got["t3"]["payer_txn_count_5min"] == 2
    assert got["t3"]["payer_txn_sum_5min"] == 30
    assert got["t3"]["payer_txn_count_1h"] == 2
    assert got["t1"]["payer_txn_count_24h"] == 0


@pytest.mark.parametrize("label,risk", [("10:05", 0), ("10:01", 1)])
def test_fraud_counts_only_after_its_label(spark, label, risk):
    assert feats(spark, fixture_a(True, label))["t3"]["payer_past_fraud_count_30d"] == risk


def test_small_parity_table(spark):
    got = feats(spark, fixture_b())
    assert got["t4"]["payer_past_fraud_count_30d"] == 1
    assert got["t2"]["payer_txn_sum_5min"] == 100
    assert got["t4"]["payer_txn_count_5min"] == 0
    assert got["t4"]["payer_txn_count_1h"] == 1


def test_window_edge_is_inclusive_and_ties_are_blind(spark):
    t = at("2024-01-02 00:00:00")
    rows = [("a", t - timedelta(minutes=5), "u", "d", "m", 1.0, 0, t), ("b", t - timedelta(minutes=5) - US, "u", "d", "m", 2.0, 0, t),
            ("c", t, "u", "d", "m", 4.0, 0, t), ("d", t, "u", "d", "m", 8.0, 0, t)]
    got = feats(spark, rows)
    assert got["c"]["payer_txn_sum_5min"] == got["d"]["payer_txn_sum_5min"] == 1.0
    assert got["c"]["payer_txn_sum_1h"] == 3.0


def test_cold_path_equals_definitions(spark):
    rows = messy()
    assert_same(feats(spark, rows), brute(rows))


def test_hot_path_equals_definitions(spark):
    rows = messy()
    df = spark.createDataFrame(rows, TXN)
    hour = 3600 * 10**6
    hot = {}
    for key in ("payer_id", "device_id"):
        p = heat.profile_keys(df, key, hot_rows=50)
        assert None in p.hot and len(p.hot) > 2  # the NULL group is hot too
        hot[key] = heat.KeyProfile(p.hot, heat.HOT_ROWS, 7 * hour)
    got = feats(spark, rows, payer_profile=hot["payer_id"], device_profile=hot["device_id"])
    assert_same(got, brute(rows))


def test_running_path_for_large_unproven_keys(spark):
    rows = messy(300)
    wide = heat.KeyProfile((), 10**9)
    assert_same(feats(spark, rows, payer_profile=wide, device_profile=wide), brute(rows))


@pytest.mark.parametrize("hot", [False, True])
def test_last_rows_bound(spark, hot):
    rows = messy(400, payers=2)
    df = spark.createDataFrame(rows, TXN)
    profile = heat.KeyProfile(("d0", "d1"), heat.HOT_ROWS, 24 * 3600 * 10**6) if hot else heat.KeyProfile()
    out = history.distinct_last_rows(df, "device_id", "payee_vpa", "n", rows=7, profile=profile).collect()
    for r in out:
        past = [] if r["device_id"] is None else sorted(
            (x for x in rows if x[3] == r["device_id"] and x[1] < r["event_timestamp"]), key=lambda x: (x[1], x[0]))
        assert r["n"] == len({x[4] for x in past[-7:] if x[4]})


@pytest.mark.parametrize("hot", [False, True])
def test_distinct_over_a_span(spark, hot):
    rows = messy(400, payers=2)
    df = spark.createDataFrame(rows, TXN)
    profile = heat.KeyProfile(("u0",), heat.HOT_ROWS, 24 * 3600 * 10**6) if hot else heat.KeyProfile()
    out = history.distinct_in_span(df, "payer_id", "payee_vpa", "n", seconds=3 * 86400, profile=profile).collect()
    for r in out:
        t = r["event_timestamp"]
        want = {x[4] for x in rows if r["payer_id"] is not None and x[2] == r["payer_id"] and x[4]
                and t - timedelta(days=3) <= x[1] < t}
        assert r["n"] == len(want)


@pytest.mark.parametrize("hot", [False, True])
def test_inclusive_mode_counts_peers_but_not_itself(spark, hot):
    rows = messy(300, payers=2)
    df = spark.createDataFrame(rows, TXN)
    profile = heat.KeyProfile(("u0", "u1"), heat.HOT_ROWS, 24 * 3600 * 10**6) if hot else heat.KeyProfile()
    for r in history.payer_velocity(df, {"24h": 86400}, inclusive=True, profile=profile).collect():
        t = r["event_timestamp"]
        win = [x for x in rows if r["payer_id"] is not None and x[2] == r["payer_id"]
               and t - timedelta(days=1) <= x[1] <= t and x[0] != r["transaction_id"]]
        assert r["payer_txn_count_24h"] == len(win)
        assert abs(r["payer_txn_sum_24h"] - sum(x[5] for x in win)) < 1e-6


def test_future_rows_change_nothing(spark):
    rows = messy(300)
    cut = sorted(x[1] for x in rows)[200]
    early = [x for x in rows if x[1] <= cut]
    all_, some = feats(spark, rows), feats(spark, early)
    for tid, f in some.items():
        assert f == all_[tid]


def test_sentinel_device_can_be_left_out(spark):
    rows = [(a, b, c, "unknown_device", *rest) for a, b, c, _, *rest in fixture_a()]
    assert feats(spark, rows)["t4"]["device_txn_count_1h"] == 3
    assert feats(spark, rows, sentinel_mode="null")["t4"]["device_txn_count_1h"] == 0


def test_dense_spans_are_cut_where_their_rows_lie(spark, monkeypatch):
    """All rows of a key within a minute, and one time with many rows: no slice holds more, but for rows of one time."""
    monkeypatch.setattr(heat, "SLICE_ROWS", 30)
    r = random.Random(2)
    t = datetime(2024, 1, 1, 12)
    rows = [(f"x{i:04d}", t + timedelta(microseconds=r.randrange(10**6) if i % 4 else 5), r.choice(["u0", "u0", "u0", "u1"]), r.choice(["d0", "d1"]), f"m{r.randrange(9)}",
             round(r.uniform(1, 9), 2), int(i % 9 == 0), t + timedelta(microseconds=r.randrange(2 * 10**6))) for i in range(400)]
    df = spark.createDataFrame(rows, TXN)
    profiles = {k: heat.profile_keys(df, k, hot_rows=1) for k in ("payer_id", "device_id")}
    got = feats(spark, rows, payer_profile=profiles["payer_id"], device_profile=profiles["device_id"])
    assert_same(got, brute(rows))
    places = df.select("payer_id", F.unix_micros("event_timestamp").alias("us"))
    sizes = heat.time_slices(places, ["payer_id"], "us", 900 * 10**6)(places).groupBy("payer_id", "_slice").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("us").alias("times")).collect()
    assert all(x.n <= 45 or x.n - x.times > 20 for x in sizes) and len(sizes) > 10
    order = heat.time_slices(places, ["payer_id"], "us", 900 * 10**6)(places).groupBy("payer_id", "_slice").agg(F.min("us").alias("a"), F.max("us").alias("b")).collect()
    for k in ("u0", "u1"):
        own = sorted((x._slice, x.a, x.b) for x in order if x.payer_id == k)
        assert all(x[2] < y[1] for x, y in zip(own, own[1:]))


def test_more_hot_keys_than_a_list_holds(spark):
    rows = messy(300, payers=40, devices=25)
    df = spark.createDataFrame(rows, TXN)
    profiles = {k: heat.profile_keys(df, k, hot_rows=2, max_keys=3) for k in ("payer_id", "device_id")}
    for k, i in (("payer_id", 2), ("device_id", 3)):
        p = profiles[k]
        assert len(p.hot) == 3 and None in p.hot and p.bitmap is not None and p.cold_bound == 2
        counts = {}
        for x in rows:
            counts[x[i]] = counts.get(x[i], 0) + 1
        flags = {x[0]: x[1] for x in p.flagged(df.select(k).distinct(), k).select(k, "_hot").collect()}
        assert all(flags[v] for v, n in counts.items() if n > 2 and v is not None)
    got = feats(spark, rows, payer_profile=profiles["payer_id"], device_profile=profiles["device_id"])
    assert_same(got, brute(rows))


@pytest.mark.parametrize("sliced", [False, True])
def test_history_totals_without_pairs(spark, sliced):
    r = random.Random(6)
    t = datetime(2024, 1, 1)
    rows = [(f"h{i}", r.choice(["a", "b", None]), t + timedelta(minutes=r.randrange(300)), r.choice([1.5, 2.25, None, float("inf")])) for i in range(150)]
    probes = [(i, r.choice(["a", "b", "c", None]), t + timedelta(minutes=r.randrange(400))) for i in range(60)] + [(99, "a", None)]
    h = spark.createDataFrame(rows, "transaction_id string, who string, event_timestamp timestamp, amount double")
    p = spark.createDataFrame(probes, "n int, who string, probe_timestamp timestamp")
    profile = heat.KeyProfile(("a", "b", None), heat.HOT_ROWS, 7 * 60 * 10**6) if sliced else heat.KeyProfile()
    out = history.history_totals(h, p, "who", 3600, profile=profile)
    got = {x.n: (x.txn_count, x.txn_sum) for x in out.collect()}
    for n, who, at in probes:
        own = [x for x in rows if who is not None and x[1] == who and at is not None and at - timedelta(hours=1) <= x[2] < at]
        assert got[n] == (len(own), sum(x[3] for x in own if x[3] and x[3] < 1e9)), (n, who, at)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() or sliced


def test_history_slice_is_half_open(spark):
    df = spark.createDataFrame(fixture_a(), TXN)
    probes = spark.createDataFrame([("user_A", at("2024-01-01 10:02:00"))], "payer_id string, probe_timestamp timestamp")
    got = history.history_slice(df, probes, "payer_id", 120).collect()
    assert sorted(r["transaction_id"] for r in got) == ["t1", "t2"]


def test_feature_table_is_closed(spark):
    df = build_features(spark.createDataFrame(fixture_a(), TXN))
    assert df.columns == FEATURE_SCHEMA.names
    with pytest.raises(ValueError):
        assert_feature_schema(df.withColumn("more", df["payer_txn_count_1h"]))


def test_one_exchange_per_entity(spark):
    df = spark.createDataFrame(fixture_a(), TXN)
    plan = build_features(df, payer_profile=heat.KeyProfile(), device_profile=heat.KeyProfile())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2


def test_profile_bounds_the_other_keys(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 30 + [("c",)] * 20 + [("d",)] * 2, "k string")
    assert heat.profile_keys(df, "k", hot_rows=10) == heat.KeyProfile(("a", "b", "c"), 10)
    few = heat.profile_keys(df, "k", hot_rows=10, max_keys=2)
    assert (few.hot, few.cold_bound) == (("a", "b"), 10)
    flags = {r.k: r._hot for r in few.flagged(df.select("k").distinct(), "k").collect()}
    assert flags["a"] and flags["b"] and flags["c"]  # the third one by the bitmap

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import TXN, fixture_a, messy
from riskengine.functions.identity import UNKNOWN_DEVICE, payer_of_address
from riskengine.functions.timing import is_night
from riskengine.operators import compare, contracts, detect, heat, quality, split
from riskengine.sources import etl, tables


def sha12(text):
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def raw(spark):
    return spark.createDataFrame(
        [(1, 10.0, 86400, 1, 1000, None, "W", "Windows"), (2, 20.0, 90000, 0, 1000, 150, "C", None), (3, 5.0, 1, 0, None, None, None, "")],
        "TransactionID long, TransactionAmt double, TransactionDT long, isFraud int, card1 int, card2 int, "
        "ProductCD string, DeviceInfo string")


def test_raw_to_payment_shape(spark):
    got = {r["transaction_id"]: r for r in etl.to_payment_shape(etl.standardise(raw(spark), True)).collect()}
    one = got[1]
    assert one["event_timestamp"] == datetime(2025, 1, 2)
    assert one["label_available_timestamp"] == datetime(2025, 1, 4)
    assert one["payer_id"] == sha12("upi_phase1_v1|1000|") and one["payer_vpa"] == f"user_{one['payer_id']}@upi"
    assert one["device_id"] == sha12("upi_phase1_v1|dev|Windows")
    assert got[2]["device_id"] == got[3]["device_id"] == UNKNOWN_DEVICE
    assert got[2]["payee_vpa"] == "merchant_C@upi" and got[3]["payee_vpa"] is None
    assert one["currency"] == "INR"


def test_generated_set_has_unlabelled_test_rows(spark, tmp_path):
    ident = spark.createDataFrame([(1, "a")], "TransactionID long, id_12 string")
    test = raw(spark).drop("isFraud", "card2").withColumn("TransactionID", F.col("TransactionID") + 10)
    out = etl.generate_dataset(raw(spark), ident, test, ident)
    assert out.count() == 6 and out.filter("is_fraud IS NULL").count() == 3
    assert out.filter("id_12 = 'a'").count() == 1
    tables.write_transactions(out, str(tmp_path / "t"))
    tables.write_transactions(out, str(tmp_path / "t"))  # drop and reload
    back = tables.read_transactions(spark, str(tmp_path / "t"), start="2025-01-02", end="2025-01-02")
    assert back.count() == 4
    assert "PartitionFilters: [isnotnull(event_date" in back._jdf.queryExecution().executedPlan().toString()


def test_identity_key_must_be_unique(spark):
    ident = spark.createDataFrame([(1,), (1,)], "TransactionID long")
    with pytest.raises(ValueError):
        etl.assert_row_preserving(ident)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(fixture_a(), TXN)
    tables.write_csv(df, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    tables.write_report(df, str(tmp_path / "j"))
    assert tables.read_report(spark, str(tmp_path / "j"), df.schema).count() == 4


def test_addresses(spark):
    df = spark.createDataFrame([("user_abc@upi",), ("shop.1@bank",), ("user_x@bank",)], "v string")
    assert [r[0] for r in df.select(payer_of_address("v")).collect()] == ["abc", "shop.1", "x@bank"]


def test_night_hours(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 1, h, m),) for h, m in ((1, 59), (2, 0), (4, 59), (5, 0))], "t timestamp")
    assert [r[0] for r in df.select(is_night("t")).collect()] == [False, True, True, False]


def test_names_and_families(spark):
    df = spark.createDataFrame([(1, None, 2, 3, "x")], "`id-01` int, id_01 int, V1 int, card1 int, P_emaildomain string")
    assert tables.normalize_names(df).first()["id_01"] == 1
    assert tables.raw_columns(df, ["V", "card", "email"]) == ["V1", "card1", "P_emaildomain"]
    swapped = tables.replace_column(df, "V1", "card1")
    assert swapped.first()["card1"] == "2" and "V1" not in swapped.columns


def test_contract_coerces_and_keeps_the_rest(spark):
    df = spark.createDataFrame([("TXN_12345", "2025-01-01T12:00:00", "500.00", "USER@UPI", "SHOP@UPI", "DEV_999", 1.0, 55)],
                               "transaction_id string, event_timestamp string, amount string, payer_vpa string, payee_vpa string, "
                               "device_id string, V1 double, `id-01` int")
    valid, bad = contracts.enforce(df)
    r = valid.first()
    assert bad.count() == 0 and r["event_timestamp"] == datetime(2025, 1, 1, 12) and r["amount"] == 500.0
    assert (r["payer_vpa"], r["payee_vpa"], r["currency"], r["V1"], r["id-01"]) == ("user@upi", "shop@upi", "INR", 1.0, 55)


def test_contract_rejects_with_reasons(spark):
    cols = "transaction_id string, event_timestamp string, amount string, currency string, payer_vpa string, payee_vpa string, device_id string"
    rows = [("a", "2025-01-01", "-1", "INR", "p", "q", "d"), ("b", "never", "x", None, "p", None, "d"), ("c", "2025-01-01", "0", "USD", "p", "q", "d")]
    df = spark.createDataFrame(rows, cols)
    why = {r["transaction_id"]: r["reject_reasons"] for r in contracts.enforce(df)[1].collect()}
    assert why == {"a": ["amount: must not be negative"],
                   "b": ["event_timestamp: not a timestamp", "amount: not a double", "currency: missing", "payee_vpa: missing"]}
    strict = {r["transaction_id"] for r in contracts.enforce(df, strict=True)[1].collect()}
    assert strict == {"a", "b", "c"}
    missing = contracts.enforce(df.drop("device_id"))
    assert missing[0].count() == 0 and missing[1].count() == 3


def test_event_gate_uses_all_conditions(spark):
    t = datetime(2025, 1, 1)
    rows = [("ok", 1.0, "INR", t + timedelta(hours=1)), ("unlabelled", 1.0, "INR", None), ("amount", 0.0, "INR", t + timedelta(hours=1)),
            ("currency", 1.0, "USD", None), ("label", 1.0, "INR", t), ("null", None, "INR", None)]
    df = spark.createDataFrame([(i, t, a, c, x) for i, a, c, x in rows],
                               "i string, event_timestamp timestamp, amount double, currency string, label_available_timestamp timestamp")
    passed, stopped = contracts.gate_events(df)
    assert {r["i"] for r in passed.collect()} == {"ok", "unlabelled"} and stopped.count() == 4


def test_quality_gate(spark):
    good = spark.createDataFrame(messy(50, null_share=0), TXN).filter(
        "label_available_timestamp > event_timestamp").withColumn("currency", F.lit("INR"))
    report = quality.quality_report(good)
    assert report.count() == 13 and quality.gate(report)
    bad = good.withColumn("amount", F.when(F.col("payer_id") == "u1", 0.0).otherwise(F.col("amount"))).drop("currency")
    with pytest.raises(ValueError, match="between"):
        quality.gate(quality.quality_report(bad))
    failed = {(r["rule"], r["column"]) for r in quality.quality_report(bad).filter("NOT success").collect()}
    assert ("column_exists", "currency") in failed and ("in_set", "currency") in failed


def test_order_is_judged_across_files(spark, tmp_path):
    import random
    r = random.Random(1)
    values = [r.choice([None, i // 3, i // 3 - r.randrange(5)]) for i in range(200)] + [None] * 5 + [3, None]
    cuts = [0, 40, 41, 41, 90, 150, 200, 205, 207]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame([(v,) for v in values[a:b]], "v int").coalesce(1).write.parquet(str(tmp_path / f"p/part={n}"))
    df = quality.with_places(spark.read.parquet(str(tmp_path / "p")))
    held = [v for v in values if v is not None]
    falls = sum(b < a for a, b in zip(held, held[1:]))
    got = quality.out_of_order(df, "v").first()
    assert (got.unexpected, got.total) == (falls, len(held)) and falls > 5
    share = 1 - falls / len(held)
    report = quality.quality_report(df, {"s": [quality.increasing("v"), quality.increasing("v", share - 0.01), quality.increasing("v", share + 0.01),
                                               quality.increasing("part")]}).orderBy("position").collect()
    assert [x.success for x in report] == [False, True, False, True]
    assert quality.out_of_order(df.limit(0), "v").first() == (0, 0)


def test_file_order(spark, tmp_path):
    df = spark.createDataFrame([(i, i) for i in range(100)] + [(100, 5)], "i int, v int").orderBy("i").coalesce(1)
    df.write.parquet(str(tmp_path / "p"))
    r = quality.file_order(spark.read.parquet(str(tmp_path / "p")), "v", mostly=0.98).first()
    assert abs(r["increasing_share"] - 100 / 101) < 1e-9 and r["success"]


def test_split_and_leakage(spark):
    t = datetime(2025, 1, 1)
    rows = [(f"t{d}", t + timedelta(days=d), "p", "d", "m", 1.0, d % 2, t + timedelta(days=d, hours=48)) for d in range(60)]
    df = spark.createDataFrame(rows, TXN)
    dates = split.calculate_split(df, test_days=30)
    train, test = split.temporal_split(df, dates)
    # day 29 is the test start; labels of days 27 and 28 arrive too late
    assert {r["transaction_id"] for r in train.collect()} == {f"t{d}" for d in range(27)}
    assert test.count() == 31
    assert split.validate_no_leakage(train, test, dates)
    with pytest.raises(ValueError, match="shared_ids=1"):
        split.validate_no_leakage(train, test.unionByName(train.limit(1)), dates)
    with pytest.raises(ValueError, match="too small"):
        split.calculate_split(df, test_days=55)
    tail = split.validation_tail(train, 0.2).filter("is_validation").collect()
    assert {r["transaction_id"] for r in tail} == {f"t{d}" for d in range(22, 27)}


def test_compare_frames(spark):
    a = spark.createDataFrame([("1", 1.0, "x"), ("2", 2.0, None), ("3", 3.0, "z")], "transaction_id string, v double, s string")
    b = spark.createDataFrame([("1", 1.000001, "x"), ("2", 2.1, None), ("4", 3.0, "z")], "transaction_id string, v double, s string")
    got = {(r["transaction_id"], r["column"]) for r in compare.compare_frames(a, b).collect()}
    assert got == {("2", "v"), ("3", "<row>"), ("4", "<row>")}


@pytest.mark.parametrize("hot", [False, True])
def test_velocity_spikes(spark, hot):
    t = datetime(2025, 1, 1)
    rows = [(f"a{i}", t + timedelta(seconds=30 * i), "u", "d", "m", 1.0, 0, t) for i in range(10)]
    rows += [(f"b{i}", t + timedelta(hours=5, seconds=20 * i), "u", "d", "m", 1.0, 0, t) for i in range(12)]
    rows += [(f"c{i}", t + timedelta(minutes=4 * i), "v", "d", "m", 1.0, 0, t) for i in range(30)]
    profile = heat.KeyProfile(("u",), heat.HOT_ROWS, 60 * 10**6) if hot else None
    got = detect.velocity_spikes(spark.createDataFrame(rows, TXN), profile=profile).orderBy("first_hit_us").collect()
    assert [(r["payer_id"], r["n_hits"], r["peak_txns"]) for r in got] == [("u", 1, 10), ("u", 3, 12)]


def test_rings(spark):
    t = datetime(2025, 1, 1)
    rows = [(f"{d}{p}", t, p, d, "m", 1.0, 1, t) for d, ps in (("d1", "abcd"), ("d2", "ab")) for p in ps]
    df = spark.createDataFrame(rows, TXN)
    assert [(r["device_id"], r["n_payers"]) for r in detect.shared_devices(df, 3).collect()] == [("d1", 4)]
    assert {r["payer_id"] for r in detect.ring_members(df, 3).collect()} == set("abcd")


def test_heavy_day_gets_more_writers(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [(f"t{i}", t + timedelta(minutes=i % 60), "p", "d", "m", 1.0, 0, t) for i in range(200)]
    rows += [("u", t + timedelta(days=1), "p", "d", "m", 1.0, 0, t)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # would merge such small writers
    try:
        tables.write_transactions(spark.createDataFrame(rows, TXN), str(tmp_path / "t"), rows_per_file=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    day = tmp_path / "t" / "event_date=2025-01-01"
    assert len(list(day.glob("*.parquet"))) > 1
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 201
    assert all(r["success"] for r in quality.file_order(back.filter("event_date = '2025-01-01'"), "event_timestamp").collect())

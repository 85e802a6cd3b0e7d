import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import TXN, assert_same, brute, messy
from riskengine.models import anomaly, nodes, preparation, supervised
from riskengine.plans import scoring, training
from riskengine.operators.features import build_features
from riskengine.streaming import keyed, policy, source
from riskengine.streaming.features import FeatureStream
from test_alerts_metrics import SCORED, fold


def blobs(spark, n=1500, seed=0):
    r = random.Random(seed)
    t = datetime(2025, 1, 1)
    rows = []
    for i in range(n):
        y = int(r.random() < 0.1)
        rows.append((f"t{i:05d}", t + timedelta(hours=i), t + timedelta(hours=i + 48), r.gauss(4 if y else 0, 1), r.gauss(0, 1),
                     r.choice(["a", "b", None]) if not y else "c", y))
    return spark.createDataFrame(rows, "transaction_id string, event_timestamp timestamp, label_available_timestamp timestamp, "
                                       "x double, y double, kind string, is_fraud int")


def test_forest_finds_the_outliers(spark, tmp_path):
    df = blobs(spark)
    forest = anomaly.train_forest(df, ["x", "y"], trees=30, sample=128)
    rows = forest.score(df).select("transaction_id", "anomaly_score", "is_fraud").collect()
    s = np.array([r["anomaly_score"] for r in rows])
    assert s.min() == 0.0 and s.max() == 1.0
    fraud = np.array([r["is_fraud"] for r in rows]) == 1
    assert s[fraud].mean() > s[~fraud].mean() + 0.1
    forest.save(spark, str(tmp_path / "f"))
    again = anomaly.IsolationForest.load(spark, str(tmp_path / "f")).score(df)
    assert {r["transaction_id"]: r["anomaly_score"] for r in again.collect()} == {
        r["transaction_id"]: r["anomaly_score"] for r in rows}
    same = anomaly.train_forest(df.repartition(7), ["x", "y"], trees=30, sample=128)
    assert same.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        forest.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    imp = {r["feature"]: r["importance"] for r in anomaly.permutation_importance(forest, df, rows=300).collect()}
    assert set(imp) == {"x", "y"} and min(imp.values()) > 0


def test_importance_covers_all_rows_in_any_number_of_slices(spark, monkeypatch):
    train = blobs(spark, 400)
    forest = anomaly.train_forest(train, ["x", "y"], trees=5, sample=64)
    seen = []
    raw = forest.raw_scores
    monkeypatch.setattr(forest, "raw_scores", lambda df, x, out: (seen.append(df), raw(df, x, out))[1])
    big = spark.range(25_000).select(F.col("id").cast("string").alias("transaction_id"), (F.col("id") % 7).cast("double").alias("x"),
                                     (F.col("id") % 5).cast("double").alias("y"))
    imp = {r["feature"]: r["importance"] for r in anomaly.permutation_importance(forest, big).collect()}
    assert set(imp) == {"x", "y"} and min(imp.values()) > 0
    paired = seen[0]
    assert paired.count() == paired.select("_id").distinct().count() == 25_000
    assert paired.select("_s").distinct().count() == 2


def test_constant_rows_score_one(spark):
    df = spark.createDataFrame([(str(i), 1.0) for i in range(20)], "transaction_id string, x double")
    assert {r["anomaly_score"] for r in anomaly.train_forest(df, ["x"], trees=3).score(df).collect()} == {1.0}


def test_anomaly_contract(spark):
    df = blobs(spark, 20)
    with pytest.raises(ValueError):
        anomaly.check_contract(df)
    assert anomaly.check_contract(df, ["x"]) == ["is_fraud", "label_available_timestamp"]


def test_scaler_rejects_nulls_and_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = preparation.scale(df, preparation.fit_scaler(df, ["a", "b"])).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        preparation.fit_scaler(df.withColumn("a", F.lit(None).cast("double")), ["a"])


def test_encoder_sends_unseen_to_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    enc = preparation.fit_encoder(train, ["c"])
    test = spark.createDataFrame([("a",), ("b",), (None,), ("zzz",)], "c string")
    assert [r["c"] for r in enc.transform(test).collect()] == [1.0, 2.0, 0.0, 0.0]
    joined = preparation.fit_encoder(train, ["c"], max_categories=1)
    assert joined.large == ("c",)
    got = joined.transform(test.withColumn("i", F.monotonically_increasing_id())).orderBy("i").collect()
    assert [r["c"] for r in got] == [1.0, 2.0, 0.0, 0.0]


def test_codes_are_dense_in_order_over_many_ranges(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("a"), (F.col("id") % 3).cast("string").alias("b"),
                                  F.when(F.col("id") % 7 != 0, F.col("id") % 40).alias("c"))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = preparation.category_codes(df, ["a", "b", "c"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for c in "abc":
        own = sorted((r.value, r.code) for r in rows if r.column == c)
        assert [code for _, code in own] == list(range(len(own)))
        assert {v for v, _ in own} == {str(x[c]) if x[c] is not None else preparation.MISSING for x in df.select(c).distinct().collect()}


def test_a_model_with_a_joined_category_survives_saving(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(preparation, "MAX_CATEGORIES", 1)
    df = blobs(spark, 400)
    fit = preparation.fit_encoder
    monkeypatch.setattr(supervised, "fit_encoder", lambda rows, cols: fit(rows, cols, 1))
    model = supervised.train_supervised(df, maxIter=2, maxDepth=2)
    assert model.encoder.large == ("kind",)
    model.save(spark, str(tmp_path / "m"))
    back = supervised.SupervisedModel.load(spark, str(tmp_path / "m"))
    assert sorted(back.predict(df).collect()) == sorted(model.predict(df).collect())


def test_forest_depends_on_the_lowest_draws_only(spark):
    """One rule at every size: a table of the pool's rows and one a thousand times as large grow the same trees."""
    cols = ["x", "y"]
    table = lambda n: spark.range(n).select(F.col("id").cast("string").alias("transaction_id"), (F.col("id") * 37 % 101).cast("double").alias("x"),
                                            (F.col("id") * 53 % 997).cast("double").alias("y"))
    large = table(100_000).withColumn("u", anomaly.drawn(42, "transaction_id"))
    pool = large.orderBy("u").limit(5 * 20)
    few, many = (anomaly.train_forest(t, cols, trees=5, sample=20) for t in (pool.drop("u"), large.drop("u")))
    assert few.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(many.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    small = anomaly.train_forest(table(30), cols, trees=5, sample=20)  # fewer rows than the pool: each tree draws its own 20
    assert small.sample == 20 and len({tuple(g.threshold) for _, g in small.nodes.groupby("tree")}) == 5


def test_node_tables_give_the_models_scores(spark, tmp_path):
    df = blobs(spark, 300)
    forest = anomaly.train_forest(df, ["x", "y"], trees=7, sample=32)
    want = {r.transaction_id: r.anomaly_score for r in forest.score(df).collect()}
    got = {r.transaction_id: r.anomaly_score for r in nodes.forest_scores(df, forest, nodes.forest_nodes(spark, forest)).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    model = supervised.train_supervised(df, maxIter=4, maxDepth=3)
    model.save(spark, str(tmp_path / "m"))
    want = {r.transaction_id: r.fraud_probability for r in model.predict(df).collect()}
    table = nodes.boosted_nodes(spark, str(tmp_path / "m"))
    got = {r.transaction_id: r.fraud_probability for r in nodes.boosted_scores(df, model, table).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert table.select("tree").distinct().count() == 4


def test_supervised_round_trip(spark, tmp_path):
    df = blobs(spark)
    assert set(preparation.model_columns(df)) == {"x", "y", "kind"}
    model = supervised.train_supervised(df, maxIter=5, maxDepth=3)
    got = {r["transaction_id"]: r["fraud_probability"] for r in model.predict(df).collect()}
    y = {r["transaction_id"]: r["is_fraud"] for r in df.collect()}
    assert len(got) == 1500
    assert np.mean([got[t] for t in got if y[t]]) > 0.7 > 0.4 > np.mean([got[t] for t in got if not y[t]])
    model.save(spark, str(tmp_path / "m"))
    back = supervised.SupervisedModel.load(spark, str(tmp_path / "m"))
    assert {r["transaction_id"]: r["fraud_probability"] for r in back.predict(df).collect()} == got
    ranks = model.importance().orderBy("rank").collect()
    assert {r["feature"] for r in ranks} == {"x", "y", "kind"} and ranks[0]["importance"] >= ranks[-1]["importance"]


def test_training_plan_and_backtest(spark, tmp_path):
    done = training.run_training(blobs(spark), two_stage=False, test_days=15, maxIter=5, maxDepth=3, output=str(tmp_path / "o"))
    auc = {r["metric"]: r["value"] for r in done.report.filter("section = 'ranking'").collect()}["roc_auc"]
    assert auc > 0.9
    out = scoring.run_backtest(done.test_scores, "2025-02-20", "2025-02-25", 0.1)
    assert out["daily"].count() == 6
    assert supervised.SupervisedModel.load(spark, str(tmp_path / "o/model")).features == ["x", "y", "kind"]


def drops(rows, schema, spark, path, parts):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    step = -(-len(rows) // parts)
    cuts = [0]
    while cuts[-1] < len(rows):  # rows of equal time arrive together
        end = min(len(rows), cuts[-1] + step)
        while end < len(rows) and rows[end][1] == rows[end - 1][1]:
            end += 1
        cuts.append(end)
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(path)


def arriving(spark, batches, schema, path):
    """One file per micro-batch, in this order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return source.read_events(spark, path, spark.createDataFrame([], schema).schema, 1)


def test_stream_features_equal_definitions(spark, tmp_path):
    rows = messy(240)
    drops(rows, TXN, spark, str(tmp_path / "in"), 3)
    stream = FeatureStream(spark, str(tmp_path / "out"))
    stream.run(source.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], TXN).schema, 1), str(tmp_path / "cp"))
    assert stream.read("features").select("batch_id").distinct().count() == 3
    assert_same({r["transaction_id"]: r.asDict() for r in stream.read("features").collect()}, brute(rows))


def test_stream_repeats_late_rows_and_restart(spark, tmp_path):
    """Rows sent twice appear once; rows behind by more than the lateness are late; later rows see them all the same."""
    rows = sorted(messy(200, seed=5), key=lambda r: (r[1], r[0]))
    stray = [rows[i] for i in (3, 40, 95, 110)]
    first, second, third = [r for r in rows[:120] if r not in stray], rows[112:150] + stray, rows[150:]
    events = arriving(spark, [first, second], TXN, str(tmp_path / "in"))
    stream = FeatureStream(spark, str(tmp_path / "out"), lateness_seconds=3 * 86400)
    stream.run(events, str(tmp_path / "cp"))
    events = arriving(spark, [third], TXN, str(tmp_path / "in"))
    stream.run(events, str(tmp_path / "cp"))  # goes on from the checkpoint
    got = {r["transaction_id"]: r.asDict() for r in stream.read("features").collect()}
    late = {r["transaction_id"] for r in stream.read("late").collect()}
    assert stream.read("late").columns == [*spark.createDataFrame([], TXN).columns, "batch_id"]
    assert stream.read("rows").count() == len(rows) == len(got) + len(late)

    def newest(key, value):
        return max((r[1] for r in first if r[key] == value and value is not None), default=None)
    behind = lambda r: any((n := newest(k, r[k])) is not None and r[1] < n - timedelta(days=3) for k in (2, 3))
    assert late == {r[0] for r in stray if behind(r)} and late
    full, early = brute(rows), brute(first)
    sent = {r[0] for r in first}
    assert_same(got, {i: (early if i in sent else full)[i] for i in got})  # messy has no late rows in the third drop


def test_unusable_amounts_count_and_sum_as_in_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(f"t{i}{k}", t + timedelta(hours=20 * i), f"u{k}", "d", "m", a, 0, None)
            for k, odd in enumerate([float("inf"), float("-inf"), float("nan"), 1e300, None])
            for i, a in enumerate([1.0, odd, 2.25, 3.1, 4.0])]
    rows.sort(key=lambda r: r[1])
    stream = FeatureStream(spark, str(tmp_path / "out"))
    stream.run(arriving(spark, [rows[:10], rows[10:]], TXN, str(tmp_path / "in")), str(tmp_path / "cp"))
    got = sorted(stream.read("features").drop("batch_id").collect())
    assert got == sorted(build_features(spark.createDataFrame(rows, TXN)).collect())
    for k in range(5):
        assert [r.payer_txn_sum_24h for r in got if r.transaction_id.endswith(str(k))] == [0.0, 1.0, 0.0, 2.25, 3.1]


def test_labels_of_a_stream_of_their_own(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(f"t{i}", t + timedelta(days=2 * i), "u", f"d{i}", "m", 1.0, None, None) for i in range(6)]
    known = "transaction_id string, payer_id string, event_timestamp timestamp, label_available_timestamp timestamp"
    said = [[("t0", "u", rows[0][1], t + timedelta(days=3))], [("t1", "u", rows[1][1], t + timedelta(days=5)), ("t1", "u", rows[1][1], t + timedelta(days=5))],
            [(None, None, rows[1][1], t), ("t2", "u", rows[2][1], None)]]
    labels = arriving(spark, said, known, str(tmp_path / "labels"))
    stream = FeatureStream(spark, str(tmp_path / "out"), labels=labels)
    stream.run(arriving(spark, [rows[:2], rows[2:4], rows[4:]], TXN, str(tmp_path / "in")), str(tmp_path / "cp"))
    got = {r.transaction_id: r.payer_past_fraud_count_30d for r in stream.read("features").collect()}
    assert got == {"t0": 0, "t1": 0, "t2": 1, "t3": 2, "t4": 2, "t5": 2}


def test_a_micro_batch_reads_no_history(spark, tmp_path):
    """The folder of what was found is written, never read, while a stream without a model runs."""
    import shutil
    rows = sorted(messy(150), key=lambda r: (r[1], r[0]))
    stream = FeatureStream(spark, str(tmp_path / "out"))
    stream.run(arriving(spark, [rows[:100]], TXN, str(tmp_path / "in")), str(tmp_path / "cp"))
    shutil.move(tmp_path / "out" / "rows", tmp_path / "aside")
    stream.run(arriving(spark, [rows[100:]], TXN, str(tmp_path / "in")), str(tmp_path / "cp"))
    want = brute(rows)
    got = {r["transaction_id"]: r.asDict() for r in stream.read("features").collect()}
    assert_same(got, {i: want[i] for i in got})
    assert len(got) >= 50


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_stream_policy_equals_the_loop(spark, tmp_path):
    r = random.Random(9)
    rows = [(f"t{i:04d}", datetime(2025, 6, 1) + timedelta(minutes=7 * i), round(r.random(), 2), 0) for i in range(600)]
    drops(rows, SCORED, spark, str(tmp_path / "in"), 3)
    schema = spark.createDataFrame([], SCORED).schema
    events = source.read_events(spark, str(tmp_path / "in"), schema, 1).withColumn("seg", F.lit("all"))
    source.append_to(policy.alert_stream(events, "seg", 0.02, window=120), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = fold(rows, 0.02, 120)
    assert len(got) == 600
    for g in got:
        assert (g["alert_threshold"], g["daily_count"], g["daily_budget"], g["should_alert"], g["budget_exceeded"]) == want[g["transaction_id"]]


def test_keyed_stream_features(spark, tmp_path):
    rows = messy(240)
    drops(rows, TXN, spark, str(tmp_path / "in"), 3)
    schema = spark.createDataFrame([], TXN).schema
    keyed.use_rocksdb(spark)
    events = source.read_events(spark, str(tmp_path / "in"), schema, 1)
    source.append_to(keyed.keyed_features(events), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert_same({r["transaction_id"]: r.asDict() for r in spark.read.parquet(str(tmp_path / "out")).collect()}, brute(rows))


def test_keyed_stream_counts_more_than_a_thousand_rows_of_a_key(spark, tmp_path):
    r = random.Random(2)
    t = datetime(2024, 1, 1)
    early = [(f"e{i:04d}", t + timedelta(hours=i), "u0", "d0", f"m{i}", 5.0, 1, t + timedelta(hours=i + 1)) for i in range(20)]
    t += timedelta(days=10)
    rows = early + [(f"x{i:04d}", t + timedelta(seconds=50 * i), "u0", "d0", f"m{r.randrange(1400)}", round(r.uniform(1, 9), 2),
                     int(i % 40 == 0), t + timedelta(seconds=50 * i + 600)) for i in range(1500)]
    drops(rows, TXN, spark, str(tmp_path / "in"), 3)
    schema = spark.createDataFrame([], TXN).schema
    keyed.use_rocksdb(spark)
    events = source.read_events(spark, str(tmp_path / "in"), schema, 1)
    source.append_to(keyed.keyed_features(events), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {x["transaction_id"]: x.asDict() for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert max(x["payer_txn_count_24h"] for x in got.values()) == 1499
    assert max(x["payer_past_fraud_count_30d"] for x in got.values()) > 50
    assert_same(got, brute(rows))


def test_alert_policy_in_chunks_of_a_segment(spark, tmp_path):
    r = random.Random(19)
    rows = [(f"t{i:04d}", datetime(2025, 6, 1) + timedelta(minutes=31 * (i // 2)), round(r.random(), 2), 0) for i in range(300)]
    drops(rows, SCORED, spark, str(tmp_path / "in"), 2)
    events = source.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], SCORED).schema, 1).withColumn("seg", F.lit("all"))
    source.append_to(policy.alert_stream(events, "seg", 0.02, window=120, chunk=37), str(tmp_path / "cp"), str(tmp_path / "out"))
    want = fold(rows, 0.02, 120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 300
    for g in got:
        assert (g["alert_threshold"], g["daily_count"], g["daily_budget"], g["should_alert"], g["budget_exceeded"]) == want[g["transaction_id"]]


def test_drops_are_as_many_files_each_and_computed_once(spark, tmp_path, monkeypatch):
    """A large drop is written by several tasks, and one trigger still takes all of it and nothing of the next."""
    from riskengine import catalog
    monkeypatch.setattr(catalog, "LEAST_ROWS", 100)
    df = spark.range(0, 900, 1, 4).select(F.col("id").alias("x"), (F.col("id") % 3).alias("slot"))
    files = catalog._dropped([d.drop("slot") for d in catalog._parted(df, F.col("slot"), 3)], str(tmp_path / "in"))
    assert files == catalog.DROP_FILES > 1
    seen = []
    events = source.read_events(spark, str(tmp_path / "in"), df.drop("slot").schema, files)
    source.run_to_end(events, str(tmp_path / "cp"), lambda b, i: seen.append(sorted(r.x for r in b.collect())))
    assert seen == [list(range(k, 900, 3)) for k in range(3)]
    few = catalog._dropped([df.where("x < 9"), df], str(tmp_path / "few"))
    assert few == 1


def test_large_keys_are_hot_in_tables_of_any_size(spark, sf, monkeypatch):
    from riskengine import catalog
    limits = []
    profile = catalog.heat.profile_keys

    def spy(df, key, hot_rows=None, **kw):
        limits.append(hot_rows)
        return profile(df, key, hot_rows, **kw)
    monkeypatch.setattr(catalog.heat, "profile_keys", spy)
    monkeypatch.setattr(catalog.heat, "HOT_ROWS", 20)
    catalog.QUERIES["full_features_hot_keys"](spark, sf)
    assert len(limits) == 2 and max(limits) <= 20

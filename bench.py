"""Headline timings. Prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query is
run to completion into a sink that keeps nothing; the session is warmed up first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession, functions as F

from riskengine import catalog
from riskengine.fixtures import txn_events, txn_lineitem
from riskengine.operators import history
from riskengine.operators.features import build_features
from riskengine.operators.heat import profile_keys
from riskengine.plans.flagship import feature_backtest

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SMALL = "/root/testdata/sf0.001"

NARROW = ["transaction_id", "event_timestamp", "payer_id", "device_id", "payee_vpa", "amount"]


def lineitem(fn):
    """The baseline's steps at the baseline's size: 600,000 rows at sf0.1."""
    return lambda spark, d: fn(txn_lineitem(spark, d))


def distinct_counts(t):
    """Both distinct-count features; keys are counted on the base rows."""
    devices, payers = profile_keys(t, "device_id"), profile_keys(t, "payer_id")
    both = history.distinct_last_rows(t.select(*NARROW), "device_id", "payer_id", "dp", profile=devices)
    return history.distinct_last_rows(both, "payer_id", "payee_vpa", "pp", profile=payers)


HEADLINES = {
    "payer_velocity_600k": lineitem(lambda t: history.payer_velocity(t.select(*NARROW))),
    # twenty payers: windows of a thousand rows and more
    "payer_velocity_dense_600k": lineitem(lambda t: history.payer_velocity(t.select(*NARROW).withColumn(
        "payer_id", F.concat(F.lit("u"), F.substring("payer_id", 2, 9).cast("long") % 20)))),
    "device_velocity_600k": lineitem(lambda t: history.device_velocity(t.select(*NARROW))),
    "distinct_counts_600k": lineitem(distinct_counts),
    "risk_history_600k": lineitem(lambda t: history.risk_history(t.select(
        "transaction_id", "event_timestamp", "payer_id", "is_fraud", "label_available_timestamp"))),
    "full_features_600k": lineitem(build_features),
    "distinct_7d_range_600k": lineitem(lambda t: history.distinct_in_span(
        t.select(*NARROW), "device_id", "payer_id", "d7")),
    "feature_backtest": feature_backtest,
    **{name: catalog.QUERIES[name] for name in (
        "full_features", "full_features_orders", "history_totals_hot", "anomaly_scores", "daily_alerts", "daily_metrics", "budget_curve", "roc_pr_auc",
        "exact_percentiles", "rolling_threshold", "sequential_budget", "standardise_upi", "contract_rejects",
        "quality_report", "device_rings", "velocity_spikes", "temporal_split", "batch_stream_diff")},
}


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    catalog.QUERIES["full_features"](spark, SMALL).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in HEADLINES.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(SF_DIR).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()

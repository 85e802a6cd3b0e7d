"""Alert policy over a scored stream: rolling threshold and sequential daily budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskengine.functions.timing import SECOND, event_date, micros
from riskengine.operators import rolling
from riskengine.operators.alerts import BUDGET, FALLBACK_THRESHOLD, MIN_SCORES, RECENT_SCORES
from riskengine.operators.metrics import LATENCY_QUANTILES, ratio

_OUT = ("transaction_id string, segment string, _us long, fraud_probability double, alert_threshold double, "
        "daily_count long, daily_budget long, should_alert boolean, budget_exceeded boolean")
_HELD = pa.schema([("transaction_id", pa.string()), ("_us", pa.int64()), ("_day", pa.string()), ("fraud_probability", pa.float64())])
CHUNK = 50_000  # rows of a segment worked at once
_STATE = "scores array<double>, days array<string>, counts array<long>, issued array<long>"


def alert_stream(scored: DataFrame, segment: str, budget: float = BUDGET, *, window: int = RECENT_SCORES,
                 min_scores: int = MIN_SCORES, fallback: float = FALLBACK_THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """Alert decisions per segment, in (time, id) order within each micro-batch.

    State per segment: the last ``window`` scores, and two counters for each event
    date, which are kept for good, so that a late row never finds a fresh quota. A segment is worked by one task per
    micro-batch, ``chunk`` rows at a time; its ids wait in Arrow and its other columns in arrays of numbers.
    """
    rows = scored.select(F.col("transaction_id").cast("string"), F.col(segment).cast("string").alias("segment"),
                         micros("event_timestamp").alias("_us"),
                         event_date("event_timestamp").cast("string").alias("_day"),
                         F.col("fraud_probability").cast("double"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, days, counts, issued = state.get if state.exists else ([], [], [], [])
        counters = {d: (n, a) for d, n, a in zip(days, counts, issued)}
        t = pa.concat_tables([pa.Table.from_pandas(f, schema=_HELD, preserve_index=False) for f in frames if len(f)])
        t = t.set_column(2, "_day", pc.dictionary_encode(t["_day"].combine_chunks(), null_encoding="encode"))
        order = pc.sort_indices(t.select(["_us", "transaction_id"]), sort_keys=[("_us", "ascending"), ("transaction_id", "ascending")])
        for at in range(0, len(order), chunk):
            rows = t.take(order.slice(at, chunk))
            score = rows["fraud_probability"].to_numpy()
            score = np.where(np.isnan(score), float("-inf"), score)
            known = np.concatenate([np.array(recent, np.float64), score])
            limit = rolling.thresholds(known, window, budget, min_scores, fallback)[len(recent):]
            wanted = (score > float("-inf")) & (score >= limit)  # no alert without a usable score, as in batch
            count, quota, total, before = (np.zeros(len(score), np.int64) for _ in range(4))
            day = rows["_day"].combine_chunks()
            for code in np.unique(day.indices.to_numpy()):
                places, name = np.flatnonzero(day.indices.to_numpy() == code), day.dictionary[int(code)].as_py()
                seen, done = counters.get(name, (0, 0))
                count[places] = seen + np.arange(1, len(places) + 1)
                quota[places] = np.maximum(1, (count[places] * budget).astype(np.int64))
                total[places] = rolling.issued_so_far(wanted[places], quota[places], done)
                before[places] = np.concatenate([[done], total[places][:-1]])
                counters[name] = (int(count[places[-1]]), int(total[places[-1]]))
            alert = total > before
            recent = known[-window:].tolist()
            yield pd.DataFrame({"transaction_id": rows["transaction_id"].to_pandas(), "segment": key[0], "_us": rows["_us"].to_numpy(),
                                "fraud_probability": score, "alert_threshold": limit, "daily_count": count, "daily_budget": quota,
                                "should_alert": alert, "budget_exceeded": wanted & ~alert})
        last = sorted(counters, key=lambda d: (d is None, d or ""))
        state.update((recent, last, [counters[d][0] for d in last], [counters[d][1] for d in last]))

    done = rows.groupBy("segment").applyInPandasWithState(
        step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    return done.withColumn("event_timestamp", F.timestamp_micros("_us")).drop("_us")


def daily_service_metrics(scored: DataFrame, score: str = "fraud_probability", alert: str = "alert", *, error: str = "error",
                          latency: str = "latency_ms", resolution: int = 3) -> DataFrame:
    """Per event day, as a tumbling window: volume, rate, alerts, errors, scores, latencies and how much of the day was alerted.

    Latency percentiles are exact for latencies rounded to ``resolution`` digits of a millisecond: the state of
    a day is how often each of them occurred, added up in the tasks before it is merged.
    """
    ms = F.round(F.col(latency).cast("double"), resolution)
    us = micros("event_timestamp")
    total, alerts = F.col("total_requests"), F.col("total_alerts")
    marks = [F.col("_q")[i].alias(f"p{int(q * 100)}_latency_ms") for i, q in enumerate(LATENCY_QUANTILES)]
    return (scored.withWatermark("event_timestamp", "1 day")
            .groupBy(F.window("event_timestamp", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("total_requests"), F.count(F.when(F.col(alert), 1)).alias("total_alerts"),
                 F.count(F.when(F.col(error), 1)).alias("error_count"), F.avg(score).alias("avg_score"),
                 F.avg(latency).alias("avg_latency_ms"), F.percentile(ms, list(LATENCY_QUANTILES)).alias("_q"),
                 ((F.max(us) - F.min(us)) / SECOND).alias("_span"))
            .select(F.to_date("w.start").cast("string").alias("event_date"), "total_requests", "total_alerts", "error_count",
                    "avg_score", "avg_latency_ms", *marks, (total / F.greatest("_span", F.lit(1.0))).alias("requests_per_second"),
                    ratio(alerts, total).alias("daily_budget_utilization")))

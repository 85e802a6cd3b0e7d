"""What an entity's past looked like strictly before each transaction.

Every feature here asks how many of an entity's earlier facts are *active* at
time T. Each fact is active on an interval (start, end] of microseconds:

* velocity over a window w:  (us, us + w]
* distinct over the last n:  (us, min(next time of the same value, time of the n-th later row)]
* distinct over a span w:    (us, min(next time of the same value, us + w)]
* label-delayed risk:        (max(us, label time), us + 30 days]

so the feature is (starts before T) - (ends before T): a running sum over a
merged event stream, linear after the sort, with no self join and no set per
row. Rows with equal times never see each other. All keys, light or hot, take the
same arithmetic: money is summed as whole units and billionths (rounded there), so
sums are exact in any order. An amount that is NaN, infinite or beyond 2^53 counts
as NULL: the row is counted and adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.functions.timing import DAY, HOUR, SECOND, micros
from riskengine.operators.heat import KeyProfile, by_heat, next_time, nth_later, prefix_sums, profile_keys
from riskengine.session import materialise

PAYER_WINDOWS = {"5min": 300, "1h": 3600, "24h": 86400}
DEVICE_WINDOWS = {"1h": 3600, "24h": 86400}
LAST_ROWS = 1000
RISK_DAYS = 30
FRACTION = 10**9          # money is summed in whole units and billionths
LARGEST = float(1 << 53)  # amounts beyond it have no exact unit


@dataclass(frozen=True)
class Active:
    """A fact counted on (start, end]; NULL end means for ever, false ``when`` never.

    The weight, where there is one, is the same column for all facts of a table.
    """

    name: str
    start: Column
    end: Column
    when: Column
    weight: Column | None = None


def _active_totals(rows: DataFrame, key: str, facts: list[Active],
                   slice_us: int | None) -> DataFrame:
    """Add every fact's active total at each row's own time."""
    kept = [c for c in rows.columns if c != key]
    row_type = rows.select(F.struct(*kept).alias("r")).schema["r"].dataType
    spans: dict[str, list[Active]] = {}
    for f in facts:
        spans.setdefault(f"{f.start}|{f.end}|{f.when}", []).append(f)

    # kind 0 is the row itself, and starts the spans in its flags: it cannot see its
    # own time, so no separate event is needed. Other starts are odd kinds, ends even.
    measures: dict[str, Column] = {}
    weights: dict[str, Column] = {}
    flags, more = F.lit(0), []

    def event(pos, kind, row=None, flags=None):
        return F.struct(pos.cast("long").alias("pos"), F.lit(kind).cast("byte").alias("kind"),
                        (F.lit(0) if flags is None else flags).cast("int").alias("flags"),
                        (F.lit(None) if row is None else row).cast(row_type).alias("row"))

    for i, group in enumerate(spans.values()):
        f = group[0]
        live = f.when & F.col(key).isNotNull() & (f.end.isNull() | (f.end > f.start))
        sign = F.when(F.col("_kind") == 2 * i + 2, -1)
        if str(f.start) == str(F.col("_us")):
            flags = flags + F.when(live, 1 << i).otherwise(0)
            sign = sign.when(F.col("_flags").bitwiseAND(1 << i) != 0, 1)
        else:
            more.append(F.when(live, event(f.start, 2 * i + 1)))
            sign = sign.when(F.col("_kind") == 2 * i + 1, 1)
        more.append(F.when(live & f.end.isNotNull(), event(f.end, 2 * i + 2)))
        for g in group:
            if g.weight is None:
                measures[g.name] = sign
            else:
                whole = F.floor(g.weight)
                weights["_whole"], weights["_part"] = whole, F.round((g.weight - whole) * FRACTION).cast("long")
                measures[g.name] = sign * F.col("_whole")
                measures[f"{g.name}__part"] = sign * F.col("_part")

    def stream(row):
        # NULL entries are dropped after the explode: that stays in generated code
        events = F.array(event(F.col("_us"), 0, row, flags), *more)
        return (rows.select(key, *[w.alias(n) for n, w in weights.items()], F.explode(events).alias("_e"))
                .filter(F.col("_e").isNotNull())
                .select(key, *weights, F.col("_e.pos").alias("_pos"), F.col("_e.kind").alias("_kind"),
                        F.col("_e.flags").alias("_flags"), F.col("_e.row").alias("_row")))

    seen = prefix_sums(stream(F.struct(*kept)), [key], "_pos", measures, slice_us,
                       light=stream(None).drop("_row")).filter(F.col("_row").isNotNull())

    def total(f):
        n = F.coalesce(F.col(f.name), F.lit(0))
        if f.weight is None:
            return n.cast("long").alias(f.name)
        return (n + F.coalesce(F.col(f"{f.name}__part"), F.lit(0)) / F.lit(float(FRACTION))).alias(f.name)

    return seen.select(key, "_row.*", *[total(f) for f in facts])


@dataclass(frozen=True)
class EntityFeatures:
    """The features wanted for one entity column."""

    key: str
    counts: tuple[tuple[str, int], ...] = ()          # (output, window seconds)
    sums: tuple[tuple[str, int], ...] = ()
    distinct: tuple[tuple[str, str, str, int], ...] = ()  # (output, value, "rows"|"seconds", bound)
    risk: tuple[tuple[str, int], ...] = ()            # (output, days)
    inclusive: bool = False                           # velocity also counts rows of equal time

    @property
    def longs(self):
        return [n for n, _ in self.counts] + [d[0] for d in self.distinct] + [n for n, _ in self.risk]

    @property
    def outputs(self):
        return self.longs + [n for n, _ in self.sums]

    @property
    def places_by_key(self) -> bool:
        """Whether a window over the key alone comes before those over (key, value)."""
        return any(d[2] == "rows" for d in self.distinct)


def usable_amount(amount: str) -> Column:
    a = F.col(amount).cast("double")
    return F.when(~F.isnan(a) & (F.abs(a) <= LARGEST), a)


def in_parts(amount: Column) -> Column:
    """The amount as it is summed: whole units and rounded billionths."""
    return F.floor(amount) + F.round((amount - F.floor(amount)) * FRACTION).cast("long") / F.lit(float(FRACTION))


def _entity(rows: DataFrame, spec: EntityFeatures, id_col: str, amount: str, slice_us: int | None) -> DataFrame:
    facts: list[Active] = []
    always = F.lit(True)
    us = F.col("_us")
    helpers = [f"_{h}{i}" for i in range(len(spec.distinct)) for h in ("nth", "again")]
    for i, (_, _, unit, bound) in enumerate(spec.distinct):
        if unit == "rows":
            rows = nth_later(rows, [spec.key], "_us", id_col, bound, f"_nth{i}", slice_us)
        else:
            rows = rows.withColumn(f"_nth{i}", us + bound * SECOND)
    start = us - 1 if spec.inclusive else us
    for name, seconds in spec.counts:
        facts.append(Active(name, start, us + seconds * SECOND, always))
    for name, seconds in spec.sums:
        facts.append(Active(name, start, us + seconds * SECOND, always, usable_amount(amount)))
    if slice_us is None and spec.distinct and not spec.places_by_key:
        rows = rows.repartition(F.col(spec.key))  # else (key, value) would be shuffled first
    for i, (name, value, _, _) in enumerate(spec.distinct):
        rows = next_time(rows, [spec.key, value], "_us", id_col, f"_again{i}", slice_us)
        facts.append(Active(name, us, F.least(f"_nth{i}", f"_again{i}"), F.col(value).isNotNull()))
    for name, days in spec.risk:
        label = micros("label_available_timestamp")
        facts.append(Active(name, F.greatest(us, label), us + days * DAY,
                            F.coalesce((F.col("is_fraud") == 1) & label.isNotNull(), F.lit(False))))
    if slice_us is not None and spec.distinct:
        rows = materialise(rows, "facts")
    if facts:
        rows = _active_totals(rows, spec.key, facts, slice_us)
    if spec.inclusive:
        own = {n: F.col(n) - F.when(F.col(spec.key).isNotNull(), 1).otherwise(0)
               for n, _ in spec.counts}
        own |= {n: F.col(n) - F.when(F.col(spec.key).isNotNull(), F.coalesce(in_parts(usable_amount(amount)), F.lit(0.0)))
                .otherwise(0.0) for n, _ in spec.sums}
        rows = rows.withColumns(own)
    return rows.drop(*helpers)


def entity_features(df: DataFrame, spec: EntityFeatures, *, id_col: str = "transaction_id",
                    ts_col: str = "event_timestamp", amount: str = "amount",
                    profile: KeyProfile | None = None) -> DataFrame:
    """Add the features of ``spec`` to every row of ``df``.

    Without a profile the keys are counted first. Rows of hot keys are read several
    times and written to the shared folder between passes: give this a stored table
    or a cheap projection of one. Project ``df`` to the columns
    needed before calling: all of them travel through the shuffle.
    """
    profile = profile or profile_keys(df, spec.key)
    rows = df if "_us" in df.columns else df.withColumn("_us", micros(ts_col))

    def zeros(d):
        return d.withColumns({n: F.lit(0).cast("long") for n in spec.longs}
                             | {n: F.lit(0.0) for n, _ in spec.sums})

    out = by_heat(rows, spec.key, profile,
                  cold=lambda d: _entity(d, spec, id_col, amount, None),
                  hot=lambda d: _entity(d, spec, id_col, amount, profile.slice_us),
                  null=zeros)
    keep = [*df.columns, *spec.outputs]
    return out.select(*dict.fromkeys(keep))


def payer_velocity(df: DataFrame, windows: dict[str, int] | None = None, *, inclusive: bool = False,
                   key: str = "payer_id", **kw) -> DataFrame:
    """Count and sum of the payer's transactions in [T - w, T), for every window."""
    windows = windows or PAYER_WINDOWS
    return entity_features(df, EntityFeatures(
        key, counts=tuple((f"payer_txn_count_{n}", s) for n, s in windows.items()),
        sums=tuple((f"payer_txn_sum_{n}", s) for n, s in windows.items()), inclusive=inclusive), **kw)


def device_velocity(df: DataFrame, windows: dict[str, int] | None = None, *,
                    key: str = "device_id", **kw) -> DataFrame:
    windows = windows or DEVICE_WINDOWS
    return entity_features(df, EntityFeatures(
        key, counts=tuple((f"device_txn_count_{n}", s) for n, s in windows.items())), **kw)


def distinct_last_rows(df: DataFrame, key: str, value: str, out: str, rows: int = LAST_ROWS,
                       **kw) -> DataFrame:
    """Distinct values among the entity's last ``rows`` rows strictly before T."""
    return entity_features(df, EntityFeatures(key, distinct=((out, value, "rows", rows),)), **kw)


def distinct_in_span(df: DataFrame, key: str, value: str, out: str, seconds: int = 7 * 86400,
                     **kw) -> DataFrame:
    """Distinct values of the entity in [T - span, T)."""
    return entity_features(df, EntityFeatures(key, distinct=((out, value, "seconds", seconds),)), **kw)


def risk_history(df: DataFrame, days: int = RISK_DAYS, out: str = "payer_past_fraud_count_30d", *,
                 key: str = "payer_id", **kw) -> DataFrame:
    """Frauds of the payer with event in [T - days, T) whose label was known before T."""
    return entity_features(df, EntityFeatures(key, risk=((out, days),)), **kw)


def history_slice(history: DataFrame, probes: DataFrame, key: str, seconds: int, *,
                  ts_col: str = "event_timestamp", probe_ts: str = "probe_timestamp",
                  probe_key: str | None = None) -> DataFrame:
    """The rows of ``history`` in [T - w, T) of each probe's entity.

    An interval join: both sides carry the window-sized time bucket as part of
    the equi key, so a hot entity spreads over its buckets and a probe meets two.
    """
    probe_key = probe_key or key
    width = seconds * SECOND
    p = probes.withColumns({"_pt": micros(probe_ts), "_pk": F.col(probe_key)})
    p = p.withColumn("_bucket", F.explode(F.array(F.floor(F.col("_pt") / width),
                                                  F.floor(F.col("_pt") / width) - 1)))
    added = [c for c in probes.columns if c not in history.columns]
    p = p.select("_pk", "_pt", "_bucket", *added)
    h = history.withColumns({"_us": micros(ts_col)})
    h = h.withColumn("_hb", F.floor(F.col("_us") / width))
    cond = ((F.col(key) == F.col("_pk")) & (F.col("_hb") == F.col("_bucket"))
            & (F.col("_us") >= F.col("_pt") - width) & (F.col("_us") < F.col("_pt")))
    return h.join(p, cond).drop("_us", "_hb", "_pk", "_pt", "_bucket")


def history_totals(history: DataFrame, probes: DataFrame, key: str, seconds: int, *, ts_col: str = "event_timestamp",
                   probe_ts: str = "probe_timestamp", probe_key: str | None = None, amount: str = "amount",
                   profile: KeyProfile | None = None) -> DataFrame:
    """Every probe with ``txn_count`` and ``txn_sum`` of its entity's history in [T - w, T); zeros if there is none.

    No probe meets a row: rows and probes of an entity lie in one order of time, in which each row starts and
    ends to count, and a probe reads the running totals. Hot entities are cut into time slices.
    """
    facts = history.select(F.col(key).alias("_entity"), micros(ts_col).alias("_us"), F.col(amount).cast("double").alias("_amount"),
                           F.lit(False).alias("_asks"))
    asked = probes.select(F.col(probe_key or key).alias("_entity"), micros(probe_ts).alias("_us"), F.lit(True).alias("_asks"),
                          F.struct(*probes.columns).alias("_probe"))
    rows = facts.unionByName(asked, allowMissingColumns=True)
    us, counts = F.col("_us"), ~F.col("_asks") & F.col("_us").isNotNull()
    totals = [Active("txn_count", us, us + seconds * SECOND, counts),
              Active("txn_sum", us, us + seconds * SECOND, counts, usable_amount("_amount"))]
    profile = profile or profile_keys(rows, "_entity")
    out = by_heat(rows, "_entity", profile,
                  cold=lambda d: _active_totals(d, "_entity", totals, None),
                  hot=lambda d: _active_totals(d, "_entity", totals, profile.slice_us),
                  null=lambda d: d.withColumns({"txn_count": F.lit(0).cast("long"), "txn_sum": F.lit(0.0)}))
    return out.filter("_asks").select("_probe.*", "txn_count", "txn_sum")


def slice_totals(rows: DataFrame, *by: str, amount: str = "amount") -> DataFrame:
    """Count and sum of a slice; an empty slice gives zeros."""
    aggs = [F.count(F.lit(1)).alias("txn_count"),
            F.coalesce(F.sum(amount), F.lit(0.0)).alias("txn_sum")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)

"""Online features from per-key state, row by row as events arrive.

Two chained stateful operators, payer then device. The state of a key is a log of its rows in
time order, cut into pieces (:mod:`timelog`), and two logs of the times at which its frauds
begin and cease to count. Every feature is a difference of prefix totals or a look at the rows
just before a place, so a row reads the heads of the logs and a few pieces, not its windows:
a key with millions of rows a day costs as much per row as one with hundreds.

Rows may arrive out of order. A row at most ``lateness`` behind the newest row of its payer
and its device (in earlier micro-batches) gets the features of all that has arrived; an older
one is marked ``is_late``, as part of what it needs may be forgotten. Late rows are remembered
like others where a later row can need them. A repeat (same payer, time and id; same device,
if there is no payer) is ignored while the row is remembered. NULL keys have no history.

A key remembers the rows of its longest window and its last 1000 rows, both counted from the
newest row less the lateness, and frauds until they cease to count; it forgets when its next
rows arrive. Needs the RocksDB state store (``use_rocksdb``).

Keys are worked by the group: a group is one of ``GROUPS`` numbers a key hashes to, so the cost of
frames, sorting and Arrow is paid once for many light keys. The rows of a heavy key are taken in
time order, ``CHUNK`` at a time, and it forgets after each; a chunk sees what the chunks before it
left, which is all that can count for it. What rows only pass on waits in a spooled file, so of a
micro-batch only a few numbers a row are held.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskengine.functions.timing import DAY, SECOND, micros
from riskengine.operators.features import DEVICE_SPEC, INPUTS, PAYER_SPEC
from riskengine.operators.history import FRACTION, EntityFeatures, usable_amount
from riskengine.schema import FEATURE_SCHEMA
from riskengine.streaming.timelog import SIZE, Log, Store, distinct_before

ROWS, STARTS, ENDS = 0, 1, 2  # the logs of a key
GROUPS = 1024             # part of the state's layout: a checkpoint keeps to it
CHUNK = 50_000            # rows of a key taken at once
SPOOL_BYTES = 32 << 20    # of a group's rows in memory; more go to a local file
OUT_ROWS = 10_000

# heads and pieces are stored as JSON: one short text passes to the state store faster than nested lists
_HEAD = T.StructType([T.StructField("head", T.StringType())])
_PIECE = T.StructType([T.StructField("piece", T.StringType())])
_KEY = T.StructType([T.StructField("key", T.StringType())])
_PIECE_KEY = T.StructType([*_KEY.fields, T.StructField("log", T.IntegerType()), T.StructField("number", T.LongType())])
_OLDEST = -2**62
#: What the operators add to the rows on their way (names that a pandas frame of rows keeps).
_HELPERS = ["rk_us", "rk_id", "rk_whole", "rk_part", "rk_known", "rk_is_label"]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class KeyHistory:
    """The logs of one key: takes rows in, tells their features, forgets what no later row needs."""

    def __init__(self, spec: EntityFeatures, lateness_us: int, store: Store, head: tuple | None, size: int = SIZE):
        self.spec, self.lateness = spec, lateness_us
        self.newest, self.cut, self.begun, self.ceased, *heads = head or (None, _OLDEST, 0, 0, None, None, None)
        self.rows, self.starts, self.ends = (Log(store, k, h, plain=k != ROWS, size=size) for k, h in enumerate(heads))
        self.velocity = max((s for _, s in (*spec.counts, *spec.sums)), default=0) * SECOND
        self.risk = max((d for _, d in spec.risk), default=0) * DAY
        self.bound = max((d[3] for d in spec.distinct), default=0)

    def take(self, us, tie, value, whole, part, known, is_label, unique) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Rows sorted by (us, tie): (which are new, which are late, their features)."""
        late = us < (_OLDEST if self.newest is None else self.newest - self.lateness)
        events = ~is_label
        fits = np.flatnonzero(events & (us > self.cut))
        new = events.copy()
        new[fits] = self.rows.insert({"us": us[fits], "tie": tie[fits], "value": value[fits], "whole": whole[fits], "part": part[fits]}, unique[fits])
        if self.risk:
            self._frauds(us[new | is_label], tie[new | is_label], known[new | is_label])
        found = self._features(us)
        if events.any():
            self.newest = max(int(us[events].max()), _OLDEST if self.newest is None else self.newest)
        return new, late, found

    def _frauds(self, us, tie, known) -> None:
        begin = np.maximum(us, known)
        counts = (known < np.iinfo(np.int64).max) & (begin < us + self.risk)
        begin, end, tie = begin[counts], us[counts] + self.risk, tie[counts]
        kept = _OLDEST if self.newest is None else self.newest - self.lateness  # what lies before is in the totals
        blank = lambda t, x: {"us": t, "tie": x, "value": np.zeros(0, object), "whole": np.zeros(0, np.int64), "part": np.zeros(0, np.int64)}
        for log, t, total in ((self.starts, begin, "begun"), (self.ends, end, "ceased")):
            old = t < kept
            setattr(self, total, getattr(self, total) + int(old.sum()))
            order = np.lexsort((tie[~old].astype(str), t[~old]))
            log.insert(blank(t[~old][order], tie[~old][order]), np.ones(len(order), dtype=bool))

    def _features(self, us: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        spans = sorted({s for _, s in (*self.spec.counts, *self.spec.sums)})
        (place, whole, part), *before = zip(*(np.split(c, 1 + len(spans)) for c in self.rows.before(np.concatenate([us, *(us - s * SECOND for s in spans)]))))
        windows = dict(zip(spans, before))
        for name, s in self.spec.counts:
            out[name] = place - windows[s][0]
        for name, s in self.spec.sums:
            out[name] = (whole - windows[s][1]) + (part - windows[s][2]) / float(FRACTION)
        for name, _, _, bound in self.spec.distinct:
            out[name] = distinct_before(self.rows, place, bound)
        for name, _ in self.spec.risk:
            out[name] = self.begun + self.starts.before(us)[0] - self.ceased - self.ends.before(us)[0]
        return out

    def forget(self) -> None:
        if self.newest is not None:
            kept = self.newest - self.lateness
            place = int(self.rows.before(np.array([kept]))[0][0]) - self.bound
            _, last = self.rows.drop(kept - self.velocity, place)
            self.cut = self.cut if last is None else last
            for log, total in ((self.starts, "begun"), (self.ends, "ceased")):
                rows, _ = log.drop(kept, 2**62)
                setattr(self, total, getattr(self, total) + rows)

    def save(self) -> tuple:
        self.forget()
        return (self.newest, self.cut, self.begun, self.ceased, self.rows.save(), self.starts.save(), self.ends.save())


class KeyStore:
    """The pieces of one key: beside its head while each log has one at most, else in ``table`` by (key, log, number)."""

    def __init__(self, key: str, table, heads: list[tuple], beside: list[tuple]):
        self.key, self.table = key, table
        self.beside = {(int(log), int(number)): tuple(piece) for log, number, *piece in beside}
        self.in_table = self._places(heads) - set(self.beside)
        self.written: dict[tuple, tuple] = {}
        self.removed: set[tuple] = set()

    @staticmethod
    def _places(heads: list[tuple]) -> set[tuple]:
        return {(log, int(number)) for log, head in enumerate(heads) for number in head[0]}

    def store(self) -> Store:
        return Store(self.get, self.written.__setitem__, self.removed.add)

    def get(self, at: tuple) -> tuple | None:
        if at in self.beside:
            return self.beside[at]
        stored = self.table.getValue((self.key, *at))
        return stored and tuple(json.loads(stored[0]))

    def save(self, heads: list[tuple]) -> list[tuple]:
        """Write the pieces, now that the heads of the logs are known; those to be kept beside them."""
        now = self._places(heads)
        light = all(len(head[0]) <= 1 for head in heads)
        kept = [(*at, *(self.written.get(at) or self.get(at))) for at in sorted(now)] if light else []
        for at in self.in_table & (self.removed | now if light else self.removed):
            self.table.removeKey((self.key, *at))
        if not light:
            for at in now:
                piece = self.written.get(at) or self.beside.get(at)
                if piece is not None:
                    self.table.updateValue((self.key, *at), (json.dumps(piece),))
        return kept


class HistoryState(StatefulProcessor):
    """Emits every new row with its features; its key is the group ``rk_group`` of the spec's keys."""

    def __init__(self, spec: EntityFeatures, lateness_us: int, arriving: pa.Schema, columns: list[str]):
        self.spec, self.lateness, self.arriving, self.columns = spec, lateness_us, arriving, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getMapState("heads", _KEY, _HEAD)
        self.pieces = handle.getMapState("pieces", _PIECE_KEY, _PIECE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        narrow = list(dict.fromkeys([self.spec.key, "payer_id", self.spec.distinct[0][1], *_HELPERS]))
        parts = []
        with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as spool:
            with pa.ipc.new_stream(spool, self.arriving) as out:
                for f in rows:
                    batch = pa.RecordBatch.from_pandas(f, schema=self.arriving, preserve_index=False)
                    out.write_batch(batch)
                    parts.append(batch.select(narrow))
            if not parts:
                return
            new, late, found = self._found(pa.Table.from_batches(parts))
            parts.clear()
            spool.seek(0)
            at, frames = 0, []
            for batch in pa.ipc.open_stream(spool):
                mine = slice(at, at + batch.num_rows)
                at += batch.num_rows
                pdf = batch.to_pandas()
                pdf["is_late"] = pdf["is_late"].to_numpy(bool) | late[mine]
                out = pd.concat([pdf, pd.DataFrame({n: c[mine] for n, c in found.items()})], axis=1)
                frames.append(out.loc[new[mine], self.columns])
                if sum(map(len, frames)) >= OUT_ROWS:
                    yield pd.concat(frames)
                    frames = []
            if frames:
                yield pd.concat(frames)

    def _found(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """For rows of many keys: (which are new, which are late, their features)."""
        spec, n = self.spec, t.num_rows
        keys = pc.dictionary_encode(t[spec.key].combine_chunks())
        code = pc.fill_null(keys.indices, -1)
        order = pc.sort_indices(pa.table({"key": code, "us": t["rk_us"], "id": t["rk_id"]}),
                                sort_keys=[("key", "ascending"), ("us", "ascending"), ("id", "ascending")]).to_numpy()  # a stable sort
        code = code.to_numpy()[order]
        # a row without a time comes last among those of its key and lies before all times
        numbers = {c: pc.fill_null(t[c], int(np.iinfo(np.int64).min)).to_numpy() for c in ("rk_us", "rk_whole", "rk_part", "rk_known")}
        is_label = t["rk_is_label"].to_numpy()
        tie, value = t["rk_id"].combine_chunks(), t[spec.distinct[0][1]].combine_chunks()
        # the payer tells repeats from new rows; the device does so for rows without a payer
        unique = np.ones(n, dtype=bool) if spec.key == "payer_id" else t["payer_id"].is_null().to_numpy()
        new, late = ~is_label, np.zeros(n, dtype=bool)
        sums = {name for name, _ in spec.sums}
        found = {c: np.zeros(n, np.float64 if c in sums else np.int64) for c in spec.outputs}
        edges = np.flatnonzero(np.diff(code)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n]):
            if code[a] < 0:
                continue  # NULL has no history
            key = keys.dictionary[int(code[a])].as_py()
            stored = self.heads.getValue((key,))
            *head, beside = json.loads(stored[0]) if stored else (None, [])
            head = head if stored else None
            kept = KeyStore(key, self.pieces, head[4:] if head else [], beside)
            state = KeyHistory(spec, self.lateness, kept.store(), head)
            for c in range(a, b, CHUNK):
                if c > a:
                    state.forget()
                mine = order[c:min(c + CHUNK, b)]
                us, whole, part, known = (v[mine] for v in numbers.values())
                places = pa.array(mine)
                new[mine], late[mine], got = state.take(us, tie.take(places).to_numpy(False), value.take(places).to_numpy(False),
                                                        whole, part, known, is_label[mine], unique[mine])
                for name, v in got.items():
                    found[name][mine] = v
            head = state.save()
            self.heads.updateValue((key,), (json.dumps([*head, kept.save(head[4:])]),))
        return new, late, found

    def close(self) -> None:
        pass


def _stage(df: DataFrame, spec: EntityFeatures, lateness_us: int) -> DataFrame:
    fields = list(df.schema.fields)
    fields += [T.StructField(n, T.LongType()) for n in spec.longs]
    fields += [T.StructField(n, T.DoubleType()) for n, _ in spec.sums]
    out = T.StructType(fields)
    # NULL keys need no state: they go to all groups
    group = F.pmod(F.when(F.col(spec.key).isNull(), F.xxhash64("rk_id")).otherwise(F.xxhash64(spec.key)), F.lit(GROUPS)).cast("int")
    arriving = to_arrow_schema(df.schema)
    return df.withColumn("rk_group", group).groupBy("rk_group").transformWithStateInPandas(
        HistoryState(spec, lateness_us, arriving, out.names), outputStructType=out, outputMode="Append", timeMode="None")


def keyed_rows(events: DataFrame, lateness_seconds: int = 0, labels: DataFrame | None = None) -> DataFrame:
    """All columns of the events with their features and ``is_late``.

    A label that travels with its row counts from its own time. ``labels`` may bring more of
    them later: a stream of (transaction_id, payer_id, event_timestamp, label_available_timestamp)
    of rows found to be frauds.
    """
    amount = usable_amount("amount")
    whole = F.floor(amount)
    known = F.when((F.col("is_fraud") == 1) & F.col("label_available_timestamp").isNotNull(), micros("label_available_timestamp"))
    never = F.lit(int(np.iinfo(np.int64).max))
    ids = F.coalesce(F.col("transaction_id").cast("string"), F.lit(""))
    helpers = {"rk_us": micros("event_timestamp"), "rk_id": ids, "rk_whole": F.coalesce(whole, F.lit(0)).cast("long"),
               "rk_part": F.coalesce(F.round((amount - whole) * FRACTION), F.lit(0)).cast("long"),
               "rk_known": F.coalesce(known, never), "rk_is_label": F.lit(False), "is_late": F.lit(False)}
    events = events.withColumn("transaction_id", F.col("transaction_id").cast("string"))
    # pandas has no NULL in numbers and few times: what is only passed on travels as text
    numbers = [f.name for f in events.schema if isinstance(f.dataType, T.NumericType)]
    times = [f.name for f in events.schema if isinstance(f.dataType, T.TimestampType)]
    packed = {c: F.col(c).cast("string") for c in numbers} | {c: micros(c).cast("string") for c in times}
    rows = events.withColumns(helpers).withColumns(packed)
    if labels is not None:
        said = labels.select(ids.alias("transaction_id"), F.col("payer_id").cast("string"), micros("event_timestamp").alias("rk_us"), ids.alias("rk_id"),
                             F.lit(0).cast("long").alias("rk_whole"), F.lit(0).cast("long").alias("rk_part"),
                             F.coalesce(micros("label_available_timestamp"), never).alias("rk_known"), F.lit(True).alias("rk_is_label"), F.lit(False).alias("is_late"))
        rows = rows.unionByName(said, allowMissingColumns=True)
    late_us = lateness_seconds * SECOND
    done = _stage(_stage(rows, PAYER_SPEC, late_us), DEVICE_SPEC, late_us).drop(*_HELPERS)
    return done.withColumns({c: F.col(c).cast(events.schema[c].dataType) for c in numbers}
                            | {c: F.timestamp_micros(F.col(c).cast("long")) for c in times})


def keyed_features(events: DataFrame, lateness_seconds: int = 0) -> DataFrame:
    """The feature table of an event stream, without late rows."""
    rows = keyed_rows(events.select(*INPUTS), lateness_seconds)
    return rows.where(~F.col("is_late")).select(*FEATURE_SCHEMA.names)

"""The state of a key against its definition: every order of arrival, repeats, ties, and how much of it is read."""

import random
from collections import Counter

import numpy as np
import pytest

from riskengine.operators.features import DEVICE_SPEC, PAYER_SPEC
from riskengine.operators.history import EntityFeatures
from riskengine.streaming.keyed import KeyHistory
from riskengine.streaming.timelog import Log, Store, distinct_before

NEVER = np.iinfo(np.int64).max
S, D = 10**6, 86400 * 10**6
SMALL = EntityFeatures("k", counts=(("n60", 60), ("n600", 600)), sums=(("s60", 60), ("s600", 600)),
                       distinct=(("d", "v", "rows", 7),), risk=(("r", 1),))


class Kept(dict):
    """Pieces in memory, with what was read and written."""

    def __init__(self):
        self.reads, self.writes = 0, 0

    def store(self):
        def get(k):
            self.reads += 1
            return self[k]

        def put(k, v):
            self.writes += 1
            self[k] = v
        return Store(get, put, lambda k: self.pop(k))


def plain(rows, spec, us):
    """Features at ``us`` from all ``rows`` (us, id, value, units, known)."""
    past = sorted((r for r in rows if r[0] < us), key=lambda r: (r[0], r[1]))
    out = {}
    for name, s in spec.counts:
        out[name] = sum(r[0] >= us - s * S for r in past)
    for name, s in spec.sums:
        out[name] = float(sum(r[3] for r in past if r[0] >= us - s * S))
    for name, _, _, bound in spec.distinct:
        out[name] = len({r[2] for r in past[-bound:] if r[2] is not None})
    for name, days in spec.risk:
        out[name] = sum(r[4] < us and r[0] >= us - days * D for r in past)
    return out


def feed(batch, spec, kept, head, lateness=0, size=5):
    batch = sorted(batch, key=lambda r: (r[0], r[1]))
    col = lambda i, t=np.int64: np.array([r[i] for r in batch], t)
    state = KeyHistory(spec, lateness, kept.store(), head, size)
    new, late, found = state.take(col(0), col(1, object), col(2, object), col(3), np.zeros(len(batch), np.int64), col(4), np.zeros(len(batch), dtype=bool), np.ones(len(batch), dtype=bool))
    return batch, new, late, found, state.save()


def made(r, n, span, step=1):
    return [(r.randrange(span) * step, f"i{i:04d}", r.choice(["a", "b", "c", "d", "e", None]), r.randrange(1, 99),
             r.choice([NEVER, NEVER, 0, r.randrange(3 * span) * step])) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_rows_in_order_equal_the_definition(seed):
    r = random.Random(seed)
    rows = sorted(made(r, 300, 4000, S), key=lambda x: x[0])
    kept, head, arrived, i = Kept(), None, [], 0
    while i < len(rows):
        j = i + r.randrange(1, 20)
        while j < len(rows) and rows[j][0] == rows[j - 1][0]:
            j += 1
        batch, new, late, found, head = feed(rows[i:j], SMALL, kept, head)
        arrived += batch
        assert new.all() and not late.any()
        for k, x in enumerate(batch):
            assert {n: v[k] for n, v in found.items()} == plain(arrived, SMALL, x[0])
        i = j
    assert sum(log == 0 for log, _ in kept) < 30  # what no later row needs is forgotten


@pytest.mark.parametrize("seed", range(6))
def test_rows_out_of_order_are_right_or_late(seed):
    """A row within the lateness has the features of all that arrived; later rows see late ones."""
    r = random.Random(50 + seed)
    rows = [(x[0] + r.choice([0, 0, 0, r.randrange(800)]) * S, *x) for x in made(r, 300, 5000, S)]
    rows = [x[1:] for x in sorted(rows, key=lambda x: x[0])]
    lateness, kept, head, arrived, n_late, i = 300 * S, Kept(), None, [], 0, 0
    while i < len(rows):
        j = i + r.randrange(1, 25)
        newest = max((x[0] for x in arrived), default=-1)
        batch, new, late, found, head = feed(rows[i:j], SMALL, kept, head, lateness)
        arrived += batch
        for k, x in enumerate(batch):
            assert late[k] == (x[0] < newest - lateness)
            if not late[k]:
                assert {n: v[k] for n, v in found.items()} == plain(arrived, SMALL, x[0]), (seed, x)
        n_late += late.sum()
        i = j
    assert n_late > 0


def test_repeats_are_ignored_while_they_are_remembered():
    r = random.Random(4)
    rows = made(r, 40, 30, S)
    kept = Kept()
    batch, new, _, _, head = feed(rows + rows[:10], SMALL, kept, None)
    assert new.sum() == 40
    _, new, _, found, head = feed(rows[5:25] + [(100 * S, "x", "a", 1, NEVER)], SMALL, kept, head, 50 * S)
    assert new.sum() == 1 and found["n600"][-1] == 40


def test_many_rows_of_one_time_keep_their_order():
    ids = [f"{i:03d}" for i in range(200)]
    r = random.Random(1)
    r.shuffle(ids)
    kept, head = Kept(), None
    for a in range(0, 200, 9):
        _, new, _, _, head = feed([(7 * S, i, i, 1, NEVER) for i in ids[a:a + 9]], SMALL, kept, head)
        assert new.all()
    log = Log(kept.store(), 0, head[4], size=5)
    assert log.values(0, 200).tolist() == sorted(ids)
    _, _, _, found, _ = feed([(8 * S, "z", None, 1, NEVER)], SMALL, kept, head)
    assert (found["n60"][0], found["s60"][0], found["d"][0]) == (200, 200.0, 7)


def test_a_key_with_a_million_rows_a_day_reads_no_more_than_a_light_one():
    def per_row(rate):  # rows a second; two days
        kept, head, per_batch, n = Kept(), None, 200, 0
        r = random.Random(2)
        total = int(2 * 86400 * rate)
        step = 2 * D // total
        times = np.arange(total, dtype=np.int64) * step
        # a state of two days, then micro-batches are measured
        state = KeyHistory(PAYER_SPEC, 0, kept.store(), None)
        state.take(times, times.astype(str).astype(object), np.array([f"m{i % 50}" for i in range(total)], object), np.ones(total, np.int64),
                   np.zeros(total, np.int64), np.full(total, NEVER), np.zeros(total, dtype=bool), np.ones(total, dtype=bool))
        head = state.save()
        kept.reads = kept.writes = 0
        for b in range(5):
            us = times[-1] + (1 + b * per_batch + np.arange(per_batch)) * step
            state = KeyHistory(PAYER_SPEC, 0, kept.store(), head)
            _, _, found = state.take(us, us.astype(str).astype(object), np.array(["m1"] * per_batch, object), np.ones(per_batch, np.int64), np.zeros(per_batch, np.int64),
                                     np.full(per_batch, NEVER), np.zeros(per_batch, dtype=bool), np.ones(per_batch, dtype=bool))
            head = state.save()
            want = -(-D // step) if D % step else D // step
            assert abs(int(found["payer_txn_count_24h"][-1]) - want) <= 1
            n += per_batch
        return (kept.reads + kept.writes) / n, len(head[4][0])
    light, few = per_row(0.05)
    heavy, many = per_row(11)
    assert heavy < 2 * light + 0.05 and heavy < 0.1  # pieces per row
    assert many < 1.2 * 11 * 86400 / 512 + 5 and few >= 1


def test_distinct_values_before_places_far_apart():
    r = random.Random(3)
    kept = Kept()
    log = Log(kept.store(), 0, None, size=16)
    values = [r.choice(["a", "b", "c", "d", None]) for _ in range(3000)]
    us = np.arange(3000)
    log.insert({"us": us, "tie": us.astype(str).astype(object), "value": np.array(values, object), "whole": us, "part": us}, us >= 0)
    head = log.save()
    log = Log(kept.store(), 0, head, size=16)
    kept.reads = 0
    places = np.array([0, 5, 2999, 3000, 6, 1500])
    got = distinct_before(log, places, 10)
    assert got.tolist() == [len({v for v in values[max(0, p - 10):p] if v is not None}) for p in places]
    assert kept.reads < 12  # not what lies between


def test_sums_and_counts_against_all_rows():
    r = np.random.default_rng(1)
    kept, head = Kept(), None
    us = r.integers(0, 1000, 4000)
    whole, part = r.integers(-9, 9, 4000), r.integers(0, 10**9, 4000)
    for a in range(0, 4000, 137):
        log = Log(kept.store(), 0, head, size=32)
        m = np.arange(a, min(a + 137, 4000))
        m = m[np.lexsort((m.astype(str), us[m]))]
        log.insert({"us": us[m], "tie": m.astype(str).astype(object), "value": np.array([None] * len(m), object), "whole": whole[m], "part": part[m]}, m < 0)
        head = log.save()
    log = Log(kept.store(), 0, head, size=32)
    x = r.integers(-5, 1010, 300)
    n, w, p = log.before(x)
    assert n.tolist() == [int((us < t).sum()) for t in x]
    assert w.tolist() == [int(whole[us < t].sum()) for t in x] and p.tolist() == [int(part[us < t].sum()) for t in x]
    assert sum(Counter(len(v[0]) for v in kept.values()).values()) == len(log.piece)


def test_the_device_has_no_sums_or_frauds():
    rows = [(i * S, str(i), f"p{i % 3}", 1, 0) for i in range(20)]
    _, _, _, found, _ = feed(rows, DEVICE_SPEC, Kept(), None)
    assert set(found) == {"device_txn_count_1h", "device_txn_count_24h", "device_distinct_payers_7d"}
    assert found["device_distinct_payers_7d"].tolist() == [0, 1, 2] + [3] * 17


class Table(dict):
    """A map state of the operator."""
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]  # only what is there is removed


def test_a_group_of_keys_in_chunks_equals_each_key_at_once(monkeypatch):
    """A heavy key is never taken whole, and what a chunk leaves is all that the next one needs."""
    import pandas as pd
    import pyarrow as pa

    from riskengine.streaming import keyed
    r = random.Random(4)
    columns = {"transaction_id": pa.string(), "payer_id": pa.string(), "device_id": pa.string(), "payee_vpa": pa.string(), "rk_us": pa.int64(),
               "rk_id": pa.string(), "rk_whole": pa.int64(), "rk_part": pa.int64(), "rk_known": pa.int64(), "rk_is_label": pa.bool_(), "is_late": pa.bool_()}

    def rows(n, first, key):
        us = sorted(first + r.randrange(3 * D) // (D // 50) * (D // 50) for _ in range(n))
        ids = [f"{key}{first}-{r.randrange(n)}" for _ in range(n)]  # some come twice
        return [(i, key, "d", f"m{r.randrange(9)}", t, i, r.randrange(50), 0, t + r.randrange(D) if r.random() < .3 else NEVER, False, False)
                for t, i in zip(us, ids)]
    batches = [rows(400, k * 2 * D, "a") + rows(7, k * 2 * D, "b") + rows(5, k * 2 * D, None) for k in range(3)]
    arriving = pa.schema(list(columns.items()))

    def run(chunk, out_rows):
        sizes = []
        take = KeyHistory.take

        def spy(self, us, *rest):
            sizes.append(len(us))
            return take(self, us, *rest)
        monkeypatch.setattr(keyed, "CHUNK", chunk)
        monkeypatch.setattr(keyed, "OUT_ROWS", out_rows)
        monkeypatch.setattr(keyed, "SPOOL_BYTES", chunk)
        monkeypatch.setattr(KeyHistory, "take", spy)
        state = keyed.HistoryState(PAYER_SPEC, D, arriving, [*columns, *PAYER_SPEC.outputs])
        state.heads, state.pieces = Table(), Table()
        out = []
        for batch in batches:
            frames = [pd.DataFrame(batch[k::3], columns=list(columns)) for k in range(3)]
            frames[2] = frames[2].assign(rk_us=frames[2]["rk_us"].where(frames[2]["payer_id"] != "b"))  # rows without a time
            out += [f for f in state.handleInputRows((1,), iter(frames), None)]
        monkeypatch.setattr(KeyHistory, "take", take)
        return sorted(map(tuple, pd.concat(out).astype(object).where(lambda d: d.notna(), None).values.tolist()), key=str), sizes, out

    whole, _, _ = run(10**6, 10**6)
    parts, sizes, frames = run(30, 50)
    assert parts == whole and max(sizes) == 30 and len(frames) > 6
    assert len({x[0] for x in whole if x[1] == "a"}) > 300 and sum(x[1] is None for x in whole) == 15

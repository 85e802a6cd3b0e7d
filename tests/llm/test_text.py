"""Memory that Python workers hold while they work and when they wait for the next task."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa

from riskengine.llm import shingles, text


def resident() -> float:
    with open("/proc/self/status") as f:
        return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024


def test_worker_gives_back_what_a_task_freed():
    """200 MB in arrays below the size that the allocator maps apart, and one in use above them."""
    def task(batches):
        for _ in batches:
            held = [np.ones(8000) for _ in range(3200)]
            kept.append(np.ones(8000))
            yield len(held)
            del held

    kept = []
    before = resident()
    assert list(text.tidy(task)(iter([1]))) == [3200]
    assert resident() - before < 60


def test_task_that_stops_early_gives_back(monkeypatch):
    calls = []
    monkeypatch.setattr(text, "give_back", lambda: calls.append(1))
    rows = text.tidy(lambda batches: (x for x in batches))(iter([1, 2]))
    assert next(rows) == 1
    rows.close()
    assert calls == [1]


def test_shingles_of_a_large_batch_take_little_beside_it():
    column = pa.array([" ".join(f"w{i}" for i in range(j, j + 400)) for j in range(0, 800_000, 400)])
    few = [s.tolist() for s in shingles.sets(column[:50])]
    tracemalloc.start()
    rows = sum(1 for _ in shingles.sets(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 12e6
    assert few == [next(shingles.sets(column[i:i + 1])).tolist() for i in range(50)]

"""A key's rows in time order, in pieces of bounded size, with running totals.

A window [T - w, T) holds what came before T less what came before T - w, so every count and
sum of a window is a difference of two prefix totals. The head of a log lists its pieces (first
and last place, rows, sums); a prefix total needs the head and at most one piece, however many
rows the window holds. Rows may be inserted anywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

SIZE = 512  # rows of a piece

#: Columns of a piece and of a head, in the order in which they are stored.
PIECE = (("us", "bigint"), ("tie", "string"), ("value", "string"), ("whole", "bigint"), ("part", "bigint"))
HEAD = (("piece", "bigint"), ("first", "bigint"), ("first_tie", "string"), ("last", "bigint"), ("n", "bigint"), ("whole", "bigint"), ("part", "bigint"))


@dataclass
class Store:
    """Where pieces are kept: by (log, number)."""

    get: Callable[[tuple], tuple | None]
    put: Callable[[tuple, tuple], None]
    remove: Callable[[tuple], None]


def _column(values, kind: str) -> np.ndarray:
    return np.array(values, np.int64) if kind == "bigint" else np.array(values, object)


def _groups(numbers: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(number, its places in ascending order), by number."""
    order = np.argsort(numbers, kind="stable")
    found, first = np.unique(numbers[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, first[1:])))


class Log:
    """Rows in the order of (us, tie). ``plain`` logs keep times and ties only."""

    def __init__(self, store: Store, number: int, head: tuple | None, plain: bool = False, size: int = SIZE):
        self.store, self.number, self.plain, self.size = store, number, plain, size
        head = head or tuple([] for _ in HEAD)
        for (name, kind), values in zip(HEAD, head):
            setattr(self, name, list(values) if kind == "string" else np.array(values, np.int64))
        self.loaded: dict[int, dict[str, np.ndarray]] = {}
        self.changed: set[int] = set()
        self.gone: set[int] = set()
        self.stored = set(self.piece.tolist())
        self.free = max(self.stored, default=-1) + 1

    # -- pieces

    def rows_of(self, i: int) -> dict[str, np.ndarray]:
        p = int(self.piece[i])
        if p not in self.loaded:
            stored = self.store.get((self.number, p))
            self.loaded[p] = {name: _column(v, kind) for (name, kind), v in zip(PIECE, stored)}
        return self.loaded[p]

    def save(self) -> tuple:
        """Write what changed; the head, to be kept by the caller."""
        for p in self.gone & self.stored:
            self.store.remove((self.number, p))
        for p in self.changed - self.gone:
            self.store.put((self.number, p), tuple(self.loaded[p][name].tolist() for name, _ in PIECE))
        return tuple(list(getattr(self, name)) if kind == "string" else getattr(self, name).tolist() for name, kind in HEAD)

    def _replace(self, i: int, j: int, rows: dict[str, np.ndarray]) -> None:
        """The pieces [i, j) become ``rows``, cut anew; the first keeps its number."""
        old = [int(p) for p in self.piece[i:j]]
        cuts = range(0, len(rows["us"]), self.size)
        numbers = (old + [self.free + k for k in range(len(cuts))])[:len(cuts)]
        self.free = max(self.free, *(n + 1 for n in numbers)) if numbers else self.free
        self.gone |= set(old) - set(numbers)
        entry: dict[str, list] = {name: [] for name, _ in HEAD}
        for number, a in zip(numbers, cuts):
            part = self._at(rows, slice(a, a + self.size))
            self.loaded[number] = part
            self.changed.add(number)
            for name, v in zip(entry, (number, part["us"][0], part["tie"][0], part["us"][-1], len(part["us"]),
                                       0 if self.plain else part["whole"].sum(), 0 if self.plain else part["part"].sum())):
                entry[name].append(v)
        for name, kind in HEAD:
            have = getattr(self, name)
            setattr(self, name, [*have[:i], *entry[name], *have[j:]] if kind == "string" else np.concatenate([have[:i], np.array(entry[name], np.int64), have[j:]]))

    # -- rows

    def insert(self, rows: dict[str, np.ndarray], unique: np.ndarray) -> np.ndarray:
        """Add rows sorted by (us, tie); those marked ``unique`` whose (us, tie) is there already are left out. Which were added."""
        us, tie = rows["us"], rows["tie"]
        added = np.ones(len(us), dtype=bool)
        if not len(us):
            return added
        if not len(self.piece):
            target = np.zeros(len(us), np.int64)
        else:
            lo, hi = np.searchsorted(self.first, us, "left"), np.searchsorted(self.first, us, "right")
            target = hi - 1
            for r in np.flatnonzero(hi > lo):  # pieces that start at this very time: the tie decides
                while target[r] >= lo[r] and self.first_tie[target[r]] > tie[r]:
                    target[r] -= 1
            target = np.maximum(target, 0)
        for i, mine in reversed(_groups(target)):  # from the end, so that earlier places stay
            new = self._at(rows, mine)
            old = self.rows_of(i) if len(self.piece) else {k: v[:0] for k, v in new.items()}
            both = {k: np.concatenate([old[k], new[k]]) for k in new}
            names = both["tie"].astype(str)
            order = np.lexsort((names, both["us"]))
            if unique[mine].any():
                only = np.concatenate([np.zeros(len(old["us"]), dtype=bool), unique[mine]])[order]  # a stable sort puts what was there first
                same = np.zeros(len(order), dtype=bool)
                same[1:] = only[1:] & (both["us"][order][1:] == both["us"][order][:-1]) & (names[order][1:] == names[order][:-1]) & (names[order][1:] != "")
                added[mine[order[same] - len(old["us"])]] = False
                order = order[~same]
            self._replace(i, min(i + 1, len(self.piece)), self._at(both, order))
        return added

    def _at(self, rows: dict[str, np.ndarray], places) -> dict[str, np.ndarray]:
        """Some of the rows; the columns that a plain log lacks stay empty."""
        return {k: v if self.plain and k not in ("us", "tie") else v[places] for k, v in rows.items()}

    def before(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, sum of whole, sum of part) at times strictly before each of ``x``."""
        at = np.searchsorted(self.first, x, "left") - 1
        total = [np.concatenate([[0], np.cumsum(c)]) for c in (self.n, self.whole, self.part)]
        inside = (at >= 0) & (x <= np.where(at >= 0, self.last[np.maximum(at, 0)], 0)) if len(self.piece) else np.zeros(len(x), dtype=bool)
        out = [t[np.where(inside, at, at + 1)] for t in total]
        for i, mine in _groups(np.where(inside, at, -1)):
            if i < 0:
                continue
            rows = self.rows_of(i)
            k = np.searchsorted(rows["us"], x[mine], "left")
            out[0][mine] += k
            if not self.plain:
                for o, c in ((1, "whole"), (2, "part")):
                    out[o][mine] += np.concatenate([[0], np.cumsum(rows[c])])[k]
        return tuple(out)

    def values(self, a: int, b: int) -> np.ndarray:
        """The values of the rows at places [a, b)."""
        ends = np.cumsum(self.n)
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left")) + 1
        if a >= b:
            return np.zeros(0, object)
        start = int(ends[i] - self.n[i])
        return np.concatenate([self.rows_of(k)["value"] for k in range(i, min(j, len(self.piece)))])[a - start:b - start]

    def drop(self, time: int, place: int) -> tuple[int, int | None]:
        """Forget leading pieces that end before ``time`` and before ``place``: (rows, the last time forgotten)."""
        k, ends = 0, np.cumsum(self.n)
        while k < len(self.piece) and self.last[k] < time and ends[k] <= place:
            k += 1
        if not k:
            return 0, None
        rows, last = int(self.n[:k].sum()), int(self.last[k - 1])
        for p in self.piece[:k].tolist():
            self.gone.add(p)
            self.loaded.pop(p, None)
        for name, _ in HEAD:
            setattr(self, name, getattr(self, name)[k:])
        return rows, last


def distinct_before(log: Log, places: np.ndarray, bound: int) -> np.ndarray:
    """For each place, the distinct values other than NULL among the ``bound`` rows before it."""
    out = np.zeros(len(places), np.int64)
    order = np.argsort(places, kind="stable")
    sorted_places = places[order]
    # places far apart are worked apart, so that what lies between them is not read
    for run in np.split(np.arange(len(order)), np.flatnonzero(np.diff(sorted_places) > bound) + 1):
        if not len(run):
            continue
        p = sorted_places[run]
        lo, hi = max(0, int(p[0]) - bound), int(p[-1])
        values = log.values(lo, hi)
        seen: dict = {}
        later = np.full(len(values), hi - lo)
        for i, v in enumerate(values.tolist()):
            if v is not None:
                if v in seen:
                    later[seen[v]] = i
                seen[v] = i
        held = np.array([i for i, v in enumerate(values.tolist()) if v is not None], np.int64)
        # row i counts for the places (i, min(i + bound, the next row of its value)]
        steps = np.zeros(hi - lo + 2, np.int64)
        np.add.at(steps, held + 1, 1)
        np.add.at(steps, np.minimum(held + bound, later[held]) + 1, -1)
        out[order[run]] = np.cumsum(steps)[p - lo]
    return out

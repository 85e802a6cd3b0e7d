"""The k-th largest of the last rows, for all rows at once."""

from __future__ import annotations

import numpy as np


def kth_largest_of_last(scores: np.ndarray, window: int, k: np.ndarray) -> np.ndarray:
    """For each place i, the ``k[i]``-th largest of ``scores[i - window + 1 : i + 1]``, cut at the start.

    Scores become rank codes. From the highest bit of a code down, the rows are parted into those
    without and those with the bit, each in their old order, so the rows of any stretch that agree in
    the bits so far stay a stretch. Counting the bit in it tells on which side the k-th largest lies.
    One pass of array operations per bit serves all places; there is no step per row.
    """
    values, code = np.unique(scores, return_inverse=True)
    if not len(values):
        return np.zeros(0)
    hi = np.arange(1, len(code) + 1)
    lo = np.maximum(hi - window, 0)
    left, found = np.asarray(k, np.int64).copy(), np.zeros(len(code), np.int64)
    for b in range(int(len(values) - 1).bit_length() - 1, -1, -1):
        with_bit = (code >> b & 1).astype(bool)
        before = np.concatenate([[0], np.cumsum(with_bit)])
        high = before[hi] - before[lo]
        up = left <= high  # among the higher ones
        zeros = len(code) - before[-1]
        lo, hi = np.where(up, zeros + before[lo], lo - before[lo]), np.where(up, zeros + before[hi], hi - before[hi])
        left = np.where(up, left, left - high)
        found |= up.astype(np.int64) << b
        code = np.concatenate([code[~with_bit], code[with_bit]])
    return values[found]


def thresholds(scores: np.ndarray, window: int, budget: float, min_scores: int, fallback: float) -> np.ndarray:
    """The policy's threshold at each place: the ceil(budget n)-th largest of the last n <= window scores, NaN as the lowest."""
    s = np.where(np.isnan(scores), -np.inf, scores)
    n = np.minimum(np.arange(1, len(s) + 1), window)
    k = np.clip(np.ceil(budget * n), 1, n).astype(np.int64)
    return np.where(n < min_scores, fallback, kth_largest_of_last(s, window, k))


def issued_so_far(wanted: np.ndarray, quota: np.ndarray, before: int) -> np.ndarray:
    """Alerts issued up to each row, itself included: a wanted one is issued while fewer than ``quota`` (never falling) are."""
    running = np.cumsum(wanted)
    return np.minimum(before + running, running + np.minimum.accumulate(quota - running))

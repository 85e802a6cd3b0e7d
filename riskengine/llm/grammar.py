"""Re-Pair grammar compression of token ids, in numpy: the format of one block.

Frequent pairs of neighbouring ids are replaced by new ids (nonterminals), round by
round, until no pair occurs often enough to pay for its rule. Each rule keeps the
length of what it expands to, so any range can be decoded without expanding the rest.

A block as bytes, little-endian: magic ``RPG1``; uint32 first nonterminal, uint32 number of
rules, uint32 length of the sequence, uint8 bytes an id (2 or 4) and three zero bytes;
rules (two ids each); expansion lengths (uint32 each); the sequence.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIIB3x")
LEAST = 24         # times a pair must occur in a block
SLOT_BITS = 16     # of the hashed pair counts that tell which pairs are worth a sort


def frequent_pairs(seq: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left << 32 | right) with at least ``least`` places, most frequent first; and all places
    that may hold one.

    A hashed count picks the places worth sorting; the counts of those are exact.
    """
    pair = seq[:-1].astype(np.uint64)
    pair <<= np.uint64(32)
    pair |= seq[1:]
    slot = pair * np.uint64(0x9E3779B97F4A7C15)
    slot >>= np.uint64(64 - SLOT_BITS)
    slot = slot.view(np.int64)
    heavy = np.bincount(slot, minlength=1 << SLOT_BITS) >= least
    at = np.flatnonzero(heavy[slot])
    kept = np.sort(pair[at])
    first = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]])) if len(kept) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(kept)]]))
    many = count >= least
    pairs, count = kept[first][many], count[many]
    order = np.argsort(-count, kind="stable")  # pairs of equal counts stay in their order
    return pairs[order], at


def compress(ids: np.ndarray, least: int = LEAST) -> bytes:
    """Encode ids (below 2^31). Any input is allowed, also an empty one."""
    seq = ids.astype(np.uint32)
    first = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = []
    total = 0
    while len(seq) > 1:
        pairs, at = frequent_pairs(seq, least)
        # a pair joins this round if no better pair ends where it starts or starts where it ends
        left, right = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        chosen = independent(left, right)
        if not len(chosen):
            break
        new_left, new_right = left[chosen], right[chosen]
        by_pair = np.argsort(pairs[chosen])
        table = pairs[chosen][by_pair]
        opens, closes = np.zeros((2, first + total), dtype=bool)
        opens[new_left], closes[new_right] = True, True
        at = at[opens[seq[at]]]
        at = at[closes[seq[at + 1]]]  # few places are left to look up
        here = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        k = np.minimum(np.searchsorted(table, here), len(table) - 1)
        hit = table[k] == here
        at, k = at[hit], k[hit]
        # equal ids in a row (a a a): every second place of a run
        if len(at):
            run = np.concatenate([[True], np.diff(at) != 1])
            begin = np.flatnonzero(run)
            nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(at)]])))
            at, k = at[nth % 2 == 0], k[nth % 2 == 0]
        seq[at] = (first + total + by_pair[k]).astype(np.uint32)
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([new_left, new_right], axis=1))
        total += len(chosen)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    lengths = np.ones(total, np.uint32)
    done = 0
    for part in rules:  # a rule refers to earlier rounds only
        lengths[done:done + len(part)] = sum(length_of(part[:, i], first, lengths) for i in (0, 1))
        done += len(part)
    width = 2 if first + total <= 1 << 16 else 4
    kind = np.dtype("<u2" if width == 2 else "<u4")
    return b"".join([HEAD.pack(MAGIC, first, total, len(seq), width), table.astype(kind).tobytes(),
                     lengths.astype("<u4").tobytes(), seq.astype(kind).tobytes()])


def independent(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indices of pairs, best first, whose occurrences cannot overlap those of another chosen pair:
    an id that opens a chosen pair closes none, and the other way round (but a a stands alone)."""
    role: dict[int, int] = {}
    out = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        if a == b:
            if a not in role:
                role[a] = 3
                out.append(i)
        elif role.get(a, 1) == 1 and role.get(b, 2) == 2:
            role[a], role[b] = 1, 2
            out.append(i)
    return np.array(out, np.int64)


def length_of(ids: np.ndarray, first: int, lengths: np.ndarray) -> np.ndarray:
    new = ids >= first
    out = np.ones(len(ids), np.uint32)
    out[new] = lengths[ids[new].astype(np.int64) - first]
    return out


def unpack(block: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    magic, first, total, n, width = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a grammar block")
    kind = np.dtype("<u2" if width == 2 else "<u4")
    at = HEAD.size
    rules = np.frombuffer(block, kind, 2 * total, at).reshape(-1, 2)
    at += rules.nbytes
    lengths = np.frombuffer(block, "<u4", total, at)
    at += lengths.nbytes
    return first, rules, lengths, np.frombuffer(block, kind, n, at)


def expand(seq: np.ndarray, first: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids behind the symbols: rules are written out once and gathered."""
    new = seq >= first
    if not new.any():
        return seq.astype(np.uint32)
    if int(lengths.sum(dtype=np.int64)) > 4 * int(length_of(seq, first, lengths).sum(dtype=np.int64)) + (1 << 16):
        # rules too long to write out all of them: one level at a time
        at = np.cumsum(1 + new) - 1
        out = np.empty(int(at[-1]) + 1, np.uint32)
        out[at[~new]] = seq[~new]
        pair = rules[seq[new].astype(np.int64) - first]
        out[at[new] - 1], out[at[new]] = pair[:, 0], pair[:, 1]
        return expand(out, first, rules, lengths)
    full: list[tuple[int, ...]] = []
    for a, b in rules.tolist():
        full.append((full[a - first] if a >= first else (a,)) + (full[b - first] if b >= first else (b,)))
    flat = np.fromiter((x for f in full for x in f), np.uint32, int(lengths.sum(dtype=np.int64)))
    ends = np.cumsum(lengths, dtype=np.int64)
    source = np.concatenate([flat, seq[~new].astype(np.uint32)])
    size, begin = np.ones(len(seq), np.int64), np.empty(len(seq), np.int64)
    rule = seq[new].astype(np.int64) - first
    size[new], begin[new] = lengths[rule], ends[rule] - lengths[rule]
    begin[~new] = len(flat) + np.arange(len(seq) - len(rule))
    stop = np.cumsum(size)
    return source[np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]))]


def decompress(block: bytes) -> np.ndarray:
    first, rules, lengths, seq = unpack(block)
    return expand(seq, first, rules, lengths)


def decode_range(block: bytes, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a block: only the symbols that cover the range are expanded."""
    first, rules, lengths, seq = unpack(block)
    if stop <= start or not len(seq):
        return np.zeros(0, np.uint32)
    ends = np.cumsum(length_of(seq, first, lengths), dtype=np.int64)
    a = int(np.searchsorted(ends, start, side="right"))
    b = int(np.searchsorted(ends, stop, side="left"))
    before = int(ends[a - 1]) if a else 0
    return expand(seq[a:b + 1], first, rules, lengths)[start - before:stop - before]

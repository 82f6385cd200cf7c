"""Two-stage suffix sorting in NumPy.

A suffix is of type B if it is smaller than its successor (the suffix one byte later), else of type A.
Only B suffixes are sorted directly; the A suffixes are induced from them by one scan of the first-byte
buckets in ascending order: when a suffix is met, its predecessor, if of type A, takes the next free
place of its own bucket. Each bucket is scanned as a whole (runs of one byte in rounds), so the scan is
256 vector steps. Order is exact to `depth` bytes; suffixes that agree that far are in any order.
"""

from __future__ import annotations

import numpy as np


def big_endian_words(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as one big-endian number; zeros after the end."""
    x = np.zeros(len(t) + 8, np.uint64)
    x[: len(t)] = t
    for shift, bits in ((1, 8), (2, 16), (4, 32)):
        y = x << np.uint64(bits)
        y[:-shift] |= x[shift:]
        x = y
    return x[: len(t)]


def type_b(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one isn't."""
    n = len(t)
    out = np.zeros(n, np.bool_)
    if n > 1:
        change = np.flatnonzero(t[1:] != t[:-1])  # t[i] differs from t[i + 1]
        up = np.zeros(len(change) + 1, np.bool_)
        up[:-1] = t[change] < t[change + 1]
        out[:] = up[np.searchsorted(change, np.arange(n))]
    return out


def _sort_directly(pos: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their suffixes' first `depth` bytes: by 8 bytes at a time, only ties going on."""
    n = len(words)
    order = pos[np.argsort(words[pos], kind="stable")]
    group = np.zeros(len(order), np.int64)
    w = words[order]
    group[1:] = np.cumsum(w[1:] != w[:-1])
    live = np.arange(len(order))
    at = 8
    while at < depth:
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        keep = size[group] > 1
        live, group = live[keep], group[keep]
        if not len(live):
            break
        p = order[live] + at
        w = np.where(p < n, words[np.minimum(p, n - 1)], 0)
        k = np.lexsort((w, group))
        order[live] = order[live[k]]
        w, group = w[k], group[k]
        new = np.ones(len(k), np.bool_)
        new[1:] = (w[1:] != w[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        at += 8
    return order


def two_stage(t: np.ndarray, wanted: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """The wanted positions (a mask) in the order of their suffixes' first `depth` bytes."""
    n = len(t)
    if words is None:
        words = big_endian_words(t)
    b = type_b(t)
    # An A suffix is induced from its successor, so the next B suffix after a wanted one is needed, with all between.
    change = np.flatnonzero(b)
    following = np.append(change, n)[np.searchsorted(change, np.arange(n))]
    need = np.zeros(n + 2, np.int32)
    want = np.flatnonzero(wanted)
    np.add.at(need, want, 1)
    np.add.at(need, np.minimum(following[want], n) + 1, -1)
    inside = np.cumsum(need)[:n] > 0
    is_a = inside & ~b
    direct = _sort_directly(np.flatnonzero(inside & b), words, depth)
    first = np.searchsorted(t[direct], np.arange(257))  # direct is in order of its first bytes
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and is_a[n - 1]:
        induced[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        part = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        parts = []
        while len(part):
            parts.append(part)
            pred = part - 1
            pred = pred[pred >= 0]
            part = pred[is_a[pred] & (t[pred] == c)]
        parts.append(direct[first[c] : first[c + 1]])
        here = np.concatenate(parts)
        if not len(here):
            continue
        out.append(here)
        pred = here - 1
        pred = pred[pred >= 0]
        pred = pred[is_a[pred] & (t[pred] > c)]
        if len(pred):
            byte = t[pred]
            k = np.argsort(byte, kind="stable")
            pred, byte = pred[k], byte[k]
            cut = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for piece in np.split(pred, cut):
                induced[t[piece[0]]].append(piece)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def adjacent_common(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the order the common prefix with the place before, in whole words of 8 bytes, at most depth."""
    n = len(words)
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        p, q = order[live] + at, order[live - 1] + at
        ok = (p < n) & (q < n)
        same = words[np.minimum(p, n - 1)] == words[np.minimum(q, n - 1)]
        live = live[ok & same]
        lcp[live] = at + 8
        if not len(live):
            break
    return lcp

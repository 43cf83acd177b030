"""Suffix arrays over byte strings in numpy: refinement after Larsson and Sadakane, common prefixes after Kasai, merging by binary search."""

from __future__ import annotations

import numpy as np

WORD = 8


def suffix_array(body: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` bytes that follow each (zeros beyond the end); equal ones stay together.

    Ranks of h bytes give ranks of up to 2h by a sort on (rank here, rank h further on). Only positions whose group still has
    more than one member are sorted again.
    """
    n = len(body)
    if not n:
        return np.empty(0, np.int64)
    padded = np.concatenate([body, np.zeros(depth + WORD, np.uint8)])
    words = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    order = np.argsort(words)
    head = np.concatenate(([True], words[order[1:]] != words[order[:-1]]))
    rank = np.zeros(n + depth, np.int64)  # beyond the end: the rank of nothing
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = first + 1
    h = WORD
    while h < depth:
        step = min(h, depth - h)
        alone = head & np.append(head[1:], True)
        places = (~alone).nonzero()[0]
        if not len(places):
            break
        who = order[places]
        key = rank[who] * (n + 1) + rank[who + step]
        by = np.argsort(key)
        order[places] = who[by]
        key = key[by]
        head[places] = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(head[places], places, 0))
        rank[order[places]] = first + 1
        h += step
    return order


def common_prefixes(body: np.ndarray, order: np.ndarray, depth: int, stride: int = WORD) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, ``depth`` at most.

    Kasai: in text order a suffix shares at least one byte less with its neighbour than the suffix before it did with its own. The
    rule carries over ``stride`` positions at a time here: those at multiples of it are compared from nothing, the rest from what
    the position before leaves them. Suffixes that agree in all ``depth`` bytes have no order, and leave nothing to the next.
    """
    n = len(body)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([body, np.zeros(2 * depth + 2 * WORD, np.uint8)])
    words = np.ndarray((n + 2 * depth,), "<u8", padded.tobytes(), strides=(1,))
    shared = np.zeros(n, np.int64)

    def compare(at: np.ndarray) -> None:
        at = at[before[at] >= 0]
        while len(at):
            known = shared[at]
            differ = words[at + known] ^ words[before[at] + known]
            same = np.where(differ == 0, WORD, np.bitwise_count((differ & -differ) - np.uint64(1)) // 8)
            shared[at] = np.minimum(known + same, depth)
            at = at[(same == WORD) & (shared[at] < depth)]

    anchors = np.arange(0, n, stride)
    compare(anchors)
    for k in range(1, stride):
        rest = np.arange(k, n, stride)
        left = shared[rest - 1]
        shared[rest] = np.where(left < depth, np.maximum(left - 1, 0), 0)
        shared[rest[before[rest] < 0]] = 0
        compare(rest)
    return shared[order]


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of (distinct strings, number) in one, with the least number of each string; places are found by binary search."""
    runs = [r for r in runs if len(r[0])]
    if not runs:
        return np.empty(0, "S1"), np.empty(0, np.int64)
    while len(runs) > 1:
        runs = [_two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    (long, low), (short, other) = sorted((a, b), key=lambda r: -len(r[0]))
    at = np.searchsorted(long, short)
    same = at < len(long)
    same[same] = long[at[same]] == short[same]
    low = low.copy()
    low[at[same]] = np.minimum(low[at[same]], other[same])
    return np.insert(long, at[~same], short[~same]), np.insert(low, at[~same], other[~same])

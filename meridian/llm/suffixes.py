"""Suffix order and common prefixes of a shard by external induced sorting.

Sorted seeds (the suffixes that start a rising stretch after a falling one) induce the order of all falling suffixes in one
ascending scan and of all rising ones in one descending scan. A scan pops its queue bucket by bucket: a tuple
(position, source, common prefix) of a suffix pushes its left neighbour into the bucket of that
neighbour's first symbol, so tuples leave the queue in suffix order. The queue keeps whole blocks of tuples
and moves them to disk beyond a memory bound. Common prefixes follow by induction as well: two
neighbours share one symbol more than the least common prefix between their sources.

The seeds are sorted by a first induction that orders their substrings, then by names of these in the
shorter string that the seeds form, doubled until ``cap`` symbols are covered: beyond it order is not needed.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

SYMBOLS = 257  # 0 ends a unit, byte b is b + 1


class BucketQueue:
    """Priority queue over small integer keys whose tuples are pushed in order; blocks beyond ``most`` tuples go to disk."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.held = folder, most, 0
        self.blocks: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
        self.spilled = [False] * SYMBOLS
        self.name = f"{folder}/{id(self)}"

    def push(self, keys: np.ndarray, tuples: np.ndarray) -> None:
        """tuples: one row each, in queue order within a key."""
        order = np.argsort(keys, kind="stable")
        keys, tuples = keys[order], tuples[order]
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            self.blocks[keys[a]].append(tuples[a:b])
        self.held += len(keys)
        if self.held > self.most:
            for key, blocks in enumerate(self.blocks):
                if blocks:
                    with open(f"{self.name}-{key}", "ab") as f:
                        for block in blocks:
                            block.tofile(f)
                    self.spilled[key], self.blocks[key] = True, []
            self.held = 0

    def pop(self, key: int) -> np.ndarray:
        blocks, self.blocks[key] = self.blocks[key], []
        self.held -= sum(map(len, blocks))
        if self.spilled[key]:
            blocks.insert(0, np.fromfile(f"{self.name}-{key}", np.int64).reshape(-1, 2))
            os.unlink(f"{self.name}-{key}")
            self.spilled[key] = False
        return np.concatenate(blocks) if blocks else np.zeros((0, 2), np.int64)


def rising(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last is not."""
    n = len(text)
    change = np.zeros(n, np.int8)
    change[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    change[-1] = -1
    at = np.where(change != 0, np.arange(n), n)
    return change[np.minimum.accumulate(at[::-1])[::-1]] > 0


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of pairs of suffixes, at most ``cap``; ``text`` has cap + 8 symbols of padding."""
    out = np.full(len(a), cap, np.int64)
    live = np.arange(len(a))
    for at in range(0, cap, 8):
        x, y = text[a[live, None] + at + np.arange(8)], text[b[live, None] + at + np.arange(8)]
        differ = x != y
        stop = differ.any(axis=1)
        out[live[stop]] = at + differ[stop].argmax(axis=1)
        live = live[~stop]
        if not len(live):
            break
    return np.minimum(out, cap)


def _scan(text, padded, up, starts, cap, folder, most, lcp, fixed, fixed_lcp, descending):
    """One inducing scan. ``starts``: tuples pushed first; ``fixed``: per symbol the suffixes that are known, in scan order.

    Returns per symbol the induced suffixes in scan order and their common prefix with the one before.
    """
    queue = BucketQueue(folder, most)
    if len(starts):
        queue.push(text[starts], np.stack([starts, np.full(len(starts), -1)], axis=1))
    total = len(text) + 1
    shared, done = np.zeros(total if lcp else 0, np.uint8), 0
    found, prefix = [], []
    for symbol in range(SYMBOLS - 1, -1, -1) if descending else range(SYMBOLS):
        current, before, parts, values = queue.pop(symbol), None, [], []
        while len(current):
            pos, source = current[:, 0], current[:, 1]
            if lcp:
                value = np.zeros(len(pos), np.int64)
                sources = source if before is None else np.r_[before, source]
                if len(sources) > 1:
                    low = np.minimum.reduceat(shared[: max(0, sources[-1]) + 1], np.maximum(sources[:-1] + 1, 0))
                    value[len(pos) - len(low) :] = np.minimum(low.astype(np.int64) + 1, cap)
                    if sources[0] < 0:  # the shard's last suffix ends after one symbol
                        value[len(pos) - len(low)] = 1
                before = source[-1]
                shared[done : done + len(pos)] = value
                values.append(value)
            parts.append(pos)
            current = _push(queue, text, up, pos, done, symbol, descending, True)
            done += len(pos)
        mine = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        found.append(mine)
        prefix.append(np.concatenate(values) if values else np.zeros(0, np.int64))
        known = fixed[symbol]
        if len(known):
            if lcp:
                value = fixed_lcp[symbol].copy()
                value[0] = common(padded, mine[-1:], known[:1], cap)[0] if len(mine) else 0
                shared[done : done + len(known)] = value
            _push(queue, text, up, known, done, symbol, descending, False)
            done += len(known)
    return (found[::-1], prefix[::-1]) if descending else (found, prefix)


def _push(queue, text, up, pos, done, symbol, descending, induced):
    """Push the left neighbours of one run; returns those that belong to the same bucket, to be taken next."""
    source = np.arange(done, done + len(pos))
    inside = pos > 0
    left, source = pos[inside] - 1, source[inside]
    fine = up[left] == descending
    left, source = left[fine], source[fine]
    keys = text[left]
    same = keys == symbol
    if induced and same.any():
        again = np.stack([left[same], source[same]], axis=1)
        left, source, keys = left[~same], source[~same], keys[~same]
    else:
        again = np.zeros((0, 2), np.int64)
    if len(left):
        queue.push(keys, np.stack([left, source], axis=1))
    return again


def _by_symbol(text: np.ndarray, pos: np.ndarray, *more: np.ndarray) -> list[list[np.ndarray]]:
    order = np.argsort(text[pos], kind="stable")
    edges = np.searchsorted(text[pos][order], np.arange(SYMBOLS + 1))
    return [[x[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in (pos[order], *(m[order] for m in more))]


def _induce(text, padded, up, seeds, cap, folder, most, lcp, seed_lcp):
    """Order of all suffixes from ordered seeds, and common prefixes with the one before if asked for."""
    last = np.array([len(text) - 1])
    fixed, fixed_lcp = _by_symbol(text, seeds, seed_lcp)
    falling, falling_lcp = _scan(text, padded, up, last, cap, folder, most, lcp, fixed, fixed_lcp, False)
    back = [x[::-1] for x in falling]
    back_lcp = [np.r_[0, x[:0:-1]] if len(x) else x for x in falling_lcp]
    risen, risen_lcp = _scan(text, padded, up, last[:0], cap, folder, most, lcp, back, back_lcp, True)
    order = [part for c in range(SYMBOLS) for part in (falling[c], risen[c][::-1])]
    if not lcp:
        return np.concatenate(order), None
    prefix = []
    for c in range(SYMBOLS):
        one, two = falling_lcp[c], np.r_[0, risen_lcp[c][:0:-1]] if len(risen_lcp[c]) else risen_lcp[c]
        if len(one) and len(two):
            two[0] = common(padded, falling[c][-1:], risen[c][-1:], cap)[0]
        prefix += [one, two]
    return np.concatenate(order), np.concatenate(prefix)


def suffix_order(text: np.ndarray, cap: int, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (symbols below SYMBOLS) in order of their first ``cap`` symbols at least, and their common prefixes, capped."""
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int64)
    up = rising(text)
    seeds = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    padded = np.concatenate([text, np.zeros(cap + 8, text.dtype)])
    with tempfile.TemporaryDirectory(prefix="spark-") as folder:
        if len(seeds) > 1:
            first, _ = _induce(text, padded, up, seeds, cap, folder, most, False, seeds)
            is_seed = np.zeros(n, bool)
            is_seed[seeds] = True
            seeds = _sort_seeds(text, up, seeds, first[is_seed[first]], cap)
        seed_lcp = np.zeros(len(seeds), np.int64)
        if len(seeds) > 1:
            seed_lcp[1:] = common(padded, seeds[:-1], seeds[1:], cap)
        return _induce(text, padded, up, seeds, cap, folder, most, True, seed_lcp)


def _sort_seeds(text, up, seeds, by_substring, cap):
    """Seeds in suffix order: equal substrings get equal names, and ranks of the string of names are doubled."""
    m = len(seeds)
    ends = np.append(seeds[1:], len(text) - 1)
    code = (text.astype(np.uint64) * np.uint64(2) + up) * np.uint64(0x9E3779B97F4A7C15)
    base = 0xD6E8FEB86659FD93
    power = np.ones(len(text) + 1, np.uint64)
    power[1:] = np.uint64(base)
    power = np.cumprod(power)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((code ^ (code >> np.uint64(29))) * power[:-1], out=total[1:])
    number = np.zeros(len(text), np.int64)
    number[seeds] = np.arange(m)
    which = number[by_substring]
    a, size = seeds[which], ends[which] - seeds[which]
    # equal substrings have equal sums once both are shifted to the larger start
    value = total[a + size + 1] - total[a]
    x, y = value[:-1] * power[np.maximum(a[1:] - a[:-1], 0)], value[1:] * power[np.maximum(a[:-1] - a[1:], 0)]
    new = (size[1:] != size[:-1]) | (x != y) | (which[1:] == m - 1) | (which[:-1] == m - 1)
    rank = np.zeros(m, np.int64)
    rank[which] = np.r_[0, np.cumsum(new)] + 1
    order, step = which, 1
    while rank[order[-1]] < m and step < cap:
        after = np.zeros(m, np.int64)
        after[: m - step] = rank[step:]
        key = rank * (m + 1) + after
        order = np.argsort(key, kind="stable")
        rank[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)] + 1
        step *= 2
    return seeds[order]

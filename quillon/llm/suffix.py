"""Suffix arrays in numpy: by prefix doubling, or by induced sorting where long strings repeat.

Doubling sorts the suffixes by their first symbols, as many as fit a word, then by twice
as many in each round; suffixes that are apart already take no part. A round is one sort
of those left, so the time is that of a few sorts where few repeats are long. Texts that
keep many suffixes together beyond ``DEEP`` symbols are sorted by induction, which
takes no longer for long repeats.

The scan that induces suffixes from sorted ones is done in blocks: a block ends
where the first suffix that it induces goes, so all entries of a block are final
when it is read, and a block is a few array operations. Suffixes that begin with runs
of one symbol induce each other within their own bucket; where the scan comes to the
bucket, all of them are placed at once, in the order in which the scan would meet
them. Time is linear in the text but for the number of blocks, which is small for
bytes and about the square root of the length for long names.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 16
#: Pairs of substrings that are compared one by one.
FEW = 64
#: Symbols beyond which doubling goes on only if it has to deal with less than an eighth of the suffixes.
DEEP = 256


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (numbers from 0) in their order; an end sorts before any symbol."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    if (order := _doubled(text)) is not None:
        return order
    return _by_induction(text)


def _by_induction(text: np.ndarray) -> np.ndarray:
    t = np.concatenate((text.astype(np.int64) + 1, [0]))
    return _sorted(t, int(t.max()) + 1)[1:].astype(np.int64)


def _doubled(text: np.ndarray) -> np.ndarray | None:
    """By prefix doubling; nothing if too many suffixes agree in more than ``DEEP`` symbols."""
    n, bits = len(text), (int(text.max()) + 1).bit_length()
    depth = 63 // bits
    symbols = np.concatenate((text.astype(np.int64) + 1, np.zeros(depth, dtype=np.int64)))
    key = symbols[:n].copy()
    for k in range(1, depth):
        key <<= bits
        key |= symbols[k : k + n]
    order = np.argsort(key)
    slot, some = np.arange(n), order  # of the suffixes that are left, in the order so far
    key = key[order]
    rank = np.zeros(n + 1, dtype=np.int64)  # the first slot of those alike, from 1; an end is 0
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        rank[some] = np.repeat(slot[at] + 1, size)
        order[slot] = some
        left = np.repeat(size > 1, size)
        slot, some = slot[left], some[left]
        if not len(some):
            return order
        if depth > DEEP and 8 * len(some) > n:
            return None
        key = rank[some] * (n + 1) + rank[np.minimum(some + depth, n)]
        by = np.argsort(key)
        some, key = some[by], key[by]
        depth *= 2


def _sorted(t: np.ndarray, symbols: int) -> np.ndarray:
    """As above; ``t`` ends with a zero that it has nowhere else."""
    t = t.astype(np.uint16 if symbols <= 1 << 16 else np.int32)  # numpy sorts 16 bits by radix
    s_type = _classify(t)
    lms = np.flatnonzero(s_type & np.concatenate(([False], ~s_type[:-1]))).astype(np.int32)
    ends = np.cumsum(np.bincount(t, minlength=symbols))
    change = np.concatenate(([True], t[1:] != t[:-1]))
    run = np.arange(len(t), dtype=np.int32) - np.maximum.accumulate(np.where(change, np.arange(len(t), dtype=np.int32), 0))
    by_substring = _induce(t, s_type, ends, run, lms)
    leftmost = np.zeros(len(t), dtype=bool)
    leftmost[lms] = True
    order = by_substring[leftmost[by_substring]]
    names, kinds = _names(t, lms, order)
    if kinds < len(lms):
        order = lms[_sorted(names, kinds)]
    return _induce(t, s_type, ends, run, order)


def _classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; equal symbols are as what follows them."""
    step = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
    return np.concatenate((step[np.minimum(at, len(step) - 1)] > 0, [True]))


def _induce(t: np.ndarray, s_type: np.ndarray, ends: np.ndarray, run: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, in order if ``lms`` is: larger ones from the left, smaller ones from the right.

    ``run`` holds how many symbols directly before each place equal its own.
    """
    n = len(t)
    sa = np.full(n, -1, dtype=np.int32)
    of = t[lms]
    rank = _rank_from_end(of)
    sa[ends[of] - 1 - rank] = lms
    heads = np.concatenate(([0], ends[:-1]))
    _scan(sa, t, ~s_type, heads, run, +1)
    sa[ends[of] - 1 - rank] = -1  # the leftmost ones, but the end, are induced again from the right
    sa[0] = n - 1
    _scan(sa, t, s_type, ends, run, -1)
    return sa


def _rank_from_end(of: np.ndarray) -> np.ndarray:
    """How many later entries have the same value."""
    order = np.argsort(of, kind="stable")
    sorted_ = of[order]
    last = np.searchsorted(sorted_, sorted_, side="right") - 1
    rank = np.empty(len(of), dtype=np.int64)
    rank[order] = last - np.arange(len(of))
    return rank


def _scan(sa: np.ndarray, t: np.ndarray, wanted: np.ndarray, edges: np.ndarray, run: np.ndarray, way: int) -> None:
    """Places each wanted predecessor of an entry at the next slot of its symbol, scanning in one direction.

    ``edges`` are the ends of the buckets that the scan comes to first.
    """
    n, block = len(sa), 256
    slots = edges.copy()
    with_runs = np.unique(t[(run > 0) & wanted])
    stops = (edges[with_runs] - (way < 0))[::way].tolist()
    with_runs = with_runs[::way].tolist()
    k = 0  # of the next bucket whose runs are to be placed
    p = 0 if way > 0 else n - 1
    while 0 <= p < n:
        if k < len(stops) and p == stops[k]:
            _place_runs(sa, run, edges, slots, with_runs[k], way)
            k += 1
        q = min(n, p + block) if way > 0 else max(-1, p - block)
        if k < len(stops):
            q = min(q, stops[k]) if way > 0 else max(q, stops[k])
        entries = sa[p:q] if way > 0 else (sa[p:q:-1] if q >= 0 else sa[p::-1])
        at = np.flatnonzero(entries > 0)
        before = entries[at] - 1
        symbol = t[before]
        use = wanted[before] & (symbol != t[before + 1])
        at, before, symbol = at[use], before[use], symbol[use]
        used = len(entries)
        if len(at):
            order = np.argsort(symbol, kind="stable")
            sorted_ = symbol[order]
            first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
            start = np.flatnonzero(first)
            rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            slot = slots[sorted_] + rank if way > 0 else slots[sorted_] - 1 - rank
            nearest = int(slot.min() - p) if way > 0 else int(p - slot.max())
            if nearest < used:
                used = nearest
                keep = at[order] < used
                order, slot, sorted_ = order[keep], slot[keep], sorted_[keep]
            sa[slot] = before[order]
            np.add.at(slots, sorted_, way) if len(sorted_) < 64 else _advance(slots, sorted_, way)
        p += way * used
        block = min(_BLOCK, max(64, 2 * used))


def _place_runs(sa: np.ndarray, run: np.ndarray, edges: np.ndarray, slots: np.ndarray, symbol: int, way: int) -> None:
    """Places what the entries of a bucket induce in it: the suffixes one symbol longer of all entries, then those two symbols longer, and so on."""
    entries = sa[edges[symbol] : slots[symbol]] if way > 0 else sa[slots[symbol] : edges[symbol]][::-1]
    entries = entries[run[entries] > 0]
    longer = run[entries]
    total = int(longer.sum())
    if not total:
        return
    more = np.arange(total) - np.repeat(np.cumsum(longer) - longer, longer) + 1
    found = (np.repeat(entries, longer) - more)[np.argsort(more, kind="stable")]
    if way > 0:
        sa[slots[symbol] : slots[symbol] + total] = found
    else:
        sa[slots[symbol] - total : slots[symbol]] = found[::-1]
    slots[symbol] += way * total


def _advance(slots: np.ndarray, sorted_: np.ndarray, way: int) -> None:
    start = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    slots[sorted_[start]] += way * np.diff(np.append(start, len(sorted_)))


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """The string of the ranks of the leftmost-smaller substrings, in text order, and how many differ."""
    length = np.zeros(len(t), dtype=np.int32)
    length[lms] = np.append(np.diff(lms) + 1, 1)  # up to and with the next one's first symbol
    a, b = order[:-1], order[1:]
    equal = length[a] == length[b]
    left = np.flatnonzero(equal)
    d = 0
    while len(left):
        if len(left) <= FEW:  # long ones are few
            for k in left.tolist():
                equal[k] = np.array_equal(t[a[k] + d : a[k] + length[a[k]]], t[b[k] + d : b[k] + length[a[k]]])
            break
        left = left[length[a[left]] > d]
        differ = t[a[left] + d] != t[b[left] + d]
        equal[left[differ]] = False
        left = left[~differ]
        d += 1
    name = np.concatenate(([0], np.cumsum(~equal)))
    of = np.empty(len(t), dtype=np.int32)
    of[order] = name
    return of[lms], int(name[-1]) + 1


def permuted_lcp(text: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each place of ``text`` (bytes): how long its suffix agrees with the one before it in ``sa``, at most ``cap``.

    In the order of the text, not of the array. Eight bytes are compared at a time,
    for as long as they agree.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((text.astype(np.uint8), np.zeros(cap + 16, dtype=np.uint8)))
    word = np.zeros(n + cap + 8, dtype=np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, dtype=np.int64)
    left = np.flatnonzero(before >= 0)
    for d in range(0, cap, 8):
        differ = word[left + d] ^ word[before[left] + d]
        end = np.full(len(left), 8)
        some = np.flatnonzero(differ)
        low = differ[some] & (~differ[some] + np.uint64(1))
        end[some] = np.bitwise_count(low - np.uint64(1)) // 8
        out[left] += end
        left = left[end == 8]
    room = n - np.maximum(np.arange(n), before)  # what was added behind the text does not count
    return np.minimum(np.minimum(out, room), cap)

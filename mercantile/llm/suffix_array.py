"""Suffix arrays by induced sorting, and the permuted common prefixes.

Suffixes are classified (S: smaller than the next one, L: larger); the leftmost S of each run
(LMS) are sorted by their substrings, named, and ordered by the suffix array of the reduced
string of names, which is made in the same way, unless all names differ; L suffixes are induced
from them in one ascending sweep over the buckets, S suffixes in one descending sweep. Each level
is at most half as long as the one above, so the work is linear. Over small alphabets a bucket's
entries are handled as arrays, runs of one value at once; over the large ones of reduced strings,
one by one.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to which buckets are handled as arrays.
SMALL = 1024
#: Length of an LMS substring from which it is compared by itself.
LONG = 256


def kinds(t: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last value must be the unique smallest."""
    step = np.flatnonzero(t[1:] != t[:-1])
    end = np.concatenate([step, [len(t) - 1]])
    rising = np.concatenate([t[step] < t[step + 1], [True]])
    return np.repeat(rising, np.diff(np.concatenate([[-1], end])))


def induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in the order induced by the given order of the LMS ones (sorted by value)."""
    return (induce_buckets if size <= SMALL else induce_each)(t, s_type, lms, size)


def induce_buckets(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    lms_at = np.searchsorted(t[lms], np.arange(size + 1)) if len(lms) else np.zeros(size + 1, np.int64)
    step = np.concatenate([[True], t[1:] != t[:-1]])
    run_start = np.maximum.accumulate(np.where(step, np.arange(len(t)), 0))

    def deal(x: np.ndarray, want_s: bool, own: int, into: list[list[np.ndarray]]) -> None:
        """Puts those before the suffixes x into their buckets, but for bucket ``own``."""
        pred = x[x > 0] - 1
        c = t[pred]
        take = (s_type[pred] == want_s) & (c != own)
        pred, c = pred[take], c[take]
        order = np.argsort(c, kind="stable")
        c, pred = c[order], pred[order]
        cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]])) if len(c) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            into[int(c[a])].append(pred[a:b])

    def with_runs(x: np.ndarray) -> np.ndarray:
        """The suffixes, then those one place before in the same run of values, and so on."""
        before = x - run_start[x]
        if not before.any():
            return x
        size = before + 1
        rounds = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return (np.repeat(x, size) - rounds)[np.argsort(rounds, kind="stable")]

    held: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size):
        if held[c]:
            held[c] = [with_runs(np.concatenate(held[c]))]
            deal(held[c][0], False, c, held)
        own = lms[lms_at[c] : lms_at[c + 1]]
        if len(own):
            deal(own, False, c, held)
    large = [x[0] if x else lms[:0] for x in held]
    small: list[list[np.ndarray]] = [[] for _ in range(size)]
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        # S suffixes, from the largest; then the L suffixes of the bucket, from the largest
        mine = with_runs(np.concatenate(small[c])) if small[c] else lms[:0]
        if len(mine):
            deal(mine, True, c, small)
        if len(large[c]):
            deal(large[c][::-1], True, c, small)
        if c == 0:
            mine = np.array([len(t) - 1])
        out += [mine, large[c][::-1]]
    return np.concatenate(out)[::-1]


def induce_each(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    n = len(t)
    count = np.bincount(t, minlength=size)
    end = np.cumsum(count)
    # the LMS suffixes at the ends of their buckets, in the given order
    own = np.bincount(t[lms], minlength=size) if len(lms) else np.zeros(size, np.int64)
    place = np.repeat(end - own, own) + np.arange(len(lms)) - np.repeat(np.cumsum(own) - own, own)
    filled = np.full(n, n, np.int64)
    filled[place] = lms
    order, head, tail = filled.tolist(), (end - count).tolist(), end.tolist()
    # the value before each suffix, if that is an L or an S suffix; place n is empty
    before = np.concatenate([[-1], t[:-1], [-1]])
    small = np.concatenate([[False], s_type[:-1], [False]])
    for_large, for_small = np.where(small, -1, before).tolist(), np.where(small, before, -1).tolist()
    for i in order:  # grows ahead of the loop
        c = for_large[i]
        if c >= 0:
            k = head[c]
            order[k] = i - 1
            head[c] = k + 1
    for i in reversed(order):
        c = for_small[i]
        if c >= 0:
            tail[c] = k = tail[c] - 1
            order[k] = i - 1
    order[0] = n - 1
    return np.array(order, np.int64)


def suffix_array(t: np.ndarray, size: int, first: int = 1) -> np.ndarray:
    """t: values below ``size``, the last one 0 and the only 0. Values below ``first`` end a
    string: each counts as different from all others."""
    n = len(t)
    s_type = kinds(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if not len(lms):
        return induce(t, s_type, lms, size)
    by_value = lms[np.argsort(t[lms], kind="stable")]
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = induce(t, s_type, by_value, size)
    order = order[is_lms[order]]
    # names: equal LMS substrings share one
    nxt = np.full(n, n - 1)
    nxt[lms[:-1]] = lms[1:]
    length = nxt[order] - order + 1
    same = np.concatenate([[False], (length[1:] == length[:-1]) & (t[order[1:]] >= first)])
    # long ones, of which there are few, whole; the others value by value, all at once
    for q in np.flatnonzero(same & (length > LONG)).tolist():
        same[q] = np.array_equal(t[order[q] : order[q] + length[q]], t[order[q - 1] : order[q - 1] + length[q]])
    live, k = np.flatnonzero(same & (length <= LONG)), 0
    while len(live):
        done = k >= length[live]
        live = live[~done]
        equal = t[order[live] + k] == t[order[live - 1] + k]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
    name = np.zeros(n, np.int64)
    name[order] = np.cumsum(~same)
    rank, m = name[lms], len(lms)
    kinds_of_names = int(rank.max())
    if kinds_of_names == m:
        return induce(t, s_type, lms[np.argsort(rank)], size)
    # nothing is compared beyond a name that occurs once, so those after one are left out
    single = np.bincount(rank)[rank] == 1
    held = np.flatnonzero(~single | np.concatenate([[False], ~single[:-1]]))
    kept = rank[held]
    used = np.zeros(kinds_of_names + 1, np.int64)
    used[kept] = 1
    used = np.cumsum(used)
    below = held[suffix_array(np.append(used[kept], 0), int(used[-1]) + 1)[1:]]
    # names in order; within a name, the order from below
    below = np.concatenate([below, np.flatnonzero(np.bincount(held, minlength=m) == 0)])
    return induce(t, s_type, lms[below[np.argsort(rank[below], kind="stable")]], size)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, cap: int, first: int = 1) -> np.ndarray:
    """For each position, the length (up to ``cap``) it shares with the suffix before it in the
    array, up to a value below ``first``. Only irreducible positions (preceded by different
    values) are compared, four values at once; the others share one value less than the position
    before."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (phi[1:] <= 0) | (t[:-1] != t[np.maximum(phi[1:], 1) - 1]) | (t[:-1] < first)
    at = np.flatnonzero(fresh)
    common = np.zeros(len(at), np.int64)
    ahead = np.concatenate([t.astype(np.uint64), np.zeros(3, np.uint64)])
    four = ahead[:n] | ahead[1 : n + 1] << np.uint64(16) | ahead[2 : n + 2] << np.uint64(32) | ahead[3 : n + 3] << np.uint64(48)
    # where the values from ``first`` on end after each position
    ends = np.append(np.flatnonzero(t < first), n)
    live = np.flatnonzero(phi[at] >= 0)
    i, j = at[live], phi[at[live]]
    # a reducible position takes its predecessor's length less one, so compare beyond the cap
    most = cap + np.diff(np.append(at, n))[live]
    most = np.minimum(most, np.minimum(ends[np.searchsorted(ends, i)] - i, ends[np.searchsorted(ends, j)] - j))
    k = 0
    while len(live):
        go = most > k
        common[live[~go]] = most[~go]
        live, i, j, most = live[go], i[go], j[go], most[go]
        unlike = four[i + k] ^ four[j + k]
        stop = unlike != 0
        x = unlike[stop]
        lanes = (x & np.uint64(0xFFFF) == 0).astype(np.int64)
        lanes += x & np.uint64(0xFFFFFFFF) == 0
        lanes += x & np.uint64(0xFFFFFFFFFFFF) == 0
        common[live[stop]] = np.minimum(k + lanes, most[stop])
        live, i, j, most = live[~stop], i[~stop], j[~stop], most[~stop]
        k += 4
    src = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    out = common[np.cumsum(fresh) - 1] - (np.arange(n) - src)
    return np.minimum(np.maximum(out, 0), cap)

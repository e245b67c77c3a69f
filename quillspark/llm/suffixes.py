"""Suffix order of a text: down to a bounded length by prefix doubling (repeated), or whole, a bucket at a time, by a difference cover (buckets).

A difference cover D of the residues modulo v has for any two residues a shift that takes both into D. The suffixes that
begin at the residues of D are ranked first: by their first v bytes, then by doubling. All other suffixes are sorted a
bucket of a range of first bytes at a time; ties beyond v bytes are resolved by the ranks at the shift that takes both
suffixes into the cover. So the memory beside text, ranks and keys is that of a bucket, however long the ties are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Perfect difference sets, by their modulus.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def shifts(v: int) -> np.ndarray:
    """shift[a, b]: the least t with (a + t) % v and (b + t) % v both in the cover."""
    cover = np.zeros(v, bool)
    cover[list(COVERS[v])] = True
    a = np.arange(v)
    return np.array([[int(np.flatnonzero(cover[(i + a) % v] & cover[(j + a) % v])[0]) for j in range(v)] for i in range(v)])


def heads(text: np.ndarray, ends: np.ndarray, at: np.ndarray, v: int) -> list[np.ndarray]:
    """The first v bytes of the suffixes at at, as integers of 7 bytes each, a byte raised by one; 0 beyond the string's end (ends: end of each position's string)."""
    out = []
    for first in range(0, v, 7):
        key = np.zeros(len(at), np.uint64)
        for k in range(first, min(v, first + 7)):
            place = at + k
            inside = place < ends
            key = key * np.uint64(257) + np.where(inside, text[np.minimum(place, len(text) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        out.append(key)
    return out


def dense(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense ranks) of rows by columns, the first one first."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return order, ranks


def cover_ranks(text: np.ndarray, ends_of: np.ndarray, v: int) -> np.ndarray:
    """rank[p]: place of the suffix at p among those of the cover (-1: not of it), for the text and v positions behind it. A suffix ends with its string; equal ones follow their strings."""
    n = len(text)
    cover = np.zeros(v, bool)
    cover[list(COVERS[v])] = True
    at = np.flatnonzero(np.resize(cover, n + v))
    inside = at < n
    ends = np.where(inside, ends_of[np.minimum(at, n - 1)] if n else 0, 0)
    keys = heads(text, ends, at, v) if n else [np.zeros(len(at), np.uint64)]
    _, rank = dense(*keys)
    number = np.full(n + v, -1, np.int64)
    number[at] = np.arange(len(at))
    step = v
    while len(at) and int(rank.max()) + 1 < len(at):
        after = at + step
        there = inside & (after < ends)  # else the string is over: its end is below all, in order of the strings
        follow = np.where(there, rank[number[np.minimum(after, n + v - 1)]] + len(at), np.where(inside, 0, -1))
        _, now = dense(rank, follow, np.where(there, 0, at))
        rank, step = now, step * 2
    out = np.full(n + v, -1, np.int64)
    out[at] = rank
    return out


def buckets(text: np.ndarray, ends_of: np.ndarray, at: np.ndarray, v: int = 13, size: int = 1 << 16) -> Iterator[np.ndarray]:
    """The suffixes at the positions at in order, a bucket of about size (or of one key) at a time."""
    if not len(at):
        return
    rank, shift = cover_ranks(text, ends_of, v), shifts(v)
    lead = heads(text, ends_of[at], at, min(v, 7))[0]
    cuts = np.unique(np.sort(lead)[size::size])
    which = np.searchsorted(cuts, lead, side="right")
    for k in range(len(cuts) + 1):
        yield _sorted(text, ends_of, at[which == k], rank, shift, v)


def _sorted(text: np.ndarray, ends_of: np.ndarray, at: np.ndarray, rank: np.ndarray, shift: np.ndarray, v: int) -> np.ndarray:
    order, group = dense(*heads(text, ends_of[at], at, v))
    at, group = at[order], group[order]
    sizes = np.bincount(group)
    tied = np.flatnonzero((sizes[group] > 1) & (ends_of[at] - at >= v))  # what ends before is equal as a whole, and stands in order of the strings
    if not len(tied):
        return at
    p, g, residue = at[tied], group[tied], at[tied] % v
    wide = np.int64(len(rank) + 1)
    lists = []
    for a in range(v):  # suffixes of one residue: any shift into the cover orders them
        own = np.flatnonzero(residue == a)
        lists.append(own[np.argsort(g[own] * wide + rank[p[own] + shift[a, a]], kind="stable")])
    below = np.zeros(len(tied), np.int64)  # how many of its group stand before a suffix
    starts = np.searchsorted(g, g)  # g ascends
    for a in range(v):
        for b in range(v):
            x, y = lists[a], lists[b]
            if not len(x) or not len(y):
                continue
            if a == b:
                before = np.arange(len(x))
                first = np.searchsorted(g[x], g[x])
            else:
                t = shift[a, b]
                before = np.searchsorted(g[y] * wide + rank[p[y] + t], g[x] * wide + rank[p[x] + t])
                first = np.searchsorted(g[y], g[x])
            below[x] += before - first
    out = np.empty_like(p)
    out[starts + below] = p
    at[tied] = out
    return at


def _groups(key: np.ndarray, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, numbers of their groups): at by key, without the groups that lie in one document."""
    order = np.argsort(key)
    key, at = key[order], at[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size, who = np.diff(np.r_[begin, len(at)]), d[at]
    several = np.minimum.reduceat(who, begin) < np.maximum.reduceat(who, begin)
    return at[np.repeat(several, size)], np.repeat(np.cumsum(several)[several] - 1, size[several])


def repeated(text: np.ndarray, ends: np.ndarray, d: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group numbers) of the suffixes, ordered by their first length (8 at least) bytes, which several documents share.

    Prefix doubling that stops at length bytes: suffixes by their first 8 bytes, then by the ranks of two halves of twice
    the width. A suffix whose half lies in one document only can't be shared and leaves. ends: end of each byte's string.
    """
    width = 8
    at = np.flatnonzero(ends - np.arange(len(text)) >= width)
    if not len(at):
        return at, at
    key = np.ndarray((len(text) - width + 1,), ">u8", np.ascontiguousarray(text).data, 0, (1,))[at].astype(np.uint64)
    at, group = _groups(key, at, d)
    while width < length:
        step = min(width, length - width)
        rank = np.full(len(text) + step, -1, np.int64)
        rank[at] = group
        width += step
        at = np.flatnonzero((rank[: len(text)] >= 0) & (rank[step:] >= 0) & (ends - np.arange(len(text)) >= width))
        if not len(at):
            return at, at
        at, group = _groups(rank[at] << 32 | rank[at + step], at, d)
    return at, group

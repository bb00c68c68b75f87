"""Suffix arrays with common prefixes by external induced sorting, arrays and queues in files.

Suffixes that start a rise after a fall (LMS) are sorted by their substrings, named, and sorted whole by
recursion on the names; all others are induced from them, first those that begin a fall (L), in ascending
order, then those that begin a rise (S), descending. Induction runs a priority queue whose key is a suffix's
first symbol: entries with equal symbols leave in the order they came, so the queue is one first-in
first-out segment of a file for each symbol, written at the tail and read at the head. An entry is a tuple
of position and common prefix with the entry before it; the prefix of two induced neighbours is one more
than the least prefix between the entries that induced them. A symbol that only one entry begins with has
its place from the start.

The queue is emptied in bulk: all segments up to the first that still misses entries leave in one batch,
which numpy turns into the entries it induces. Common prefixes are capped, as only whether they reach the
cap is wanted; so each takes a byte or two, and suffixes that agree that far may stand in any order.

Every array whose length goes with the text (symbols, types, LMS positions, names, seeds, queues and their heads)
comes from a Pool: beyond `memory` bytes it is a file mapped into memory, and is worked on BATCH entries at a time,
so a shard may be far larger than memory. Recursion ends with names that are all different, or few enough (BASE)
to be ordered in memory by trebling the length that ranks stand for.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Entries worked on at a time, and names few enough for memory (at most 2^21 - 2, as three ranks make a key).
BATCH, BASE = 1 << 18, 1 << 17
#: Batches of so many entries at most leave the queue an entry at a time.
FEW = 48


class Pool:
    """Arrays in memory up to a number of bytes each, else in files of a folder of its own, which go when it is closed."""

    def __init__(self, memory: int = 1 << 20):
        self.memory, self.dir, self.files = memory, None, 0

    def path(self) -> str:
        if self.dir is None:
            self.dir = tempfile.mkdtemp(prefix="lattica-sa-")
        self.files += 1
        return os.path.join(self.dir, str(self.files))

    def empty(self, n: int, dtype) -> np.ndarray:
        """An array of zeros. A file has no name any more once it is mapped, so its space is free as soon as the array is."""
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.zeros(n, dtype)
        path = self.path()
        out = np.asarray(np.memmap(path, dtype, "w+", shape=(n,)))
        os.unlink(path)
        return out

    def close(self) -> None:
        if self.dir is not None:
            shutil.rmtree(self.dir, ignore_errors=True)
            self.dir = None

    def __enter__(self) -> Pool:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of x[lo..hi], both included, for each range: by a table of powers of two as far as the longest range needs."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    n, top = len(x), int(level.max())
    table = np.empty((top + 1, n), x.dtype)
    table[0] = x
    for k in range(top):
        step = 1 << k
        np.minimum(table[k, : n - step], table[k, step:], out=table[k + 1, : n - step])
    flat, row = table.ravel(), level.astype(np.int64) * n
    return np.minimum(flat[row + lo], flat[row + hi + 1 - (1 << level.astype(np.int64))])


def _blocks(n: int):
    """Bounds of BATCH entries each."""
    return ((a, min(n, a + BATCH)) for a in range(0, n, BATCH))


def _offsets(counts: np.ndarray, pool: Pool) -> np.ndarray:
    out = pool.empty(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def _wide(n: int):
    return np.int32 if n < 1 << 31 else np.int64


def _least_type(cap: int):
    return np.uint8 if cap < 255 else np.uint16


def _count(key: np.ndarray, at: np.ndarray | None, member: np.ndarray | None, sigma: int, pool: Pool) -> np.ndarray:
    """How often each symbol stands in key, at some places or where member says."""
    out = pool.empty(sigma, np.int64)
    for a, b in _blocks(len(key) if at is None else len(at)):
        x = key[a:b] if at is None else key[at[a:b]]
        x = x[member[a:b]] if member is not None else x
        if sigma > 4 * len(x):  # few of many symbols
            u, c = np.unique(x, return_counts=True)
            out[u] += c
        else:
            out += np.bincount(x, minlength=sigma)
    return out


def induce(key: np.ndarray, member: np.ndarray, counts: np.ndarray, seeds: np.ndarray, seed_counts: np.ndarray, seed_lcp: np.ndarray | None, run: np.ndarray | None, sigma: int, cap: int, pool: Pool, last: int = -1) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes i with member[i], in order of key, from `seeds` in that order; counts tell how many of each begin with each symbol.

    Of equal first symbols members come before seeds. A suffix i that leaves induces i - 1 if that is a
    member. seed_lcp: common prefix of each seed with the seed before it; None to sort without prefixes.
    run: how often each suffix's first symbol repeats, capped. last: a member that nothing induces, alone in
    the last segment.
    """
    n = len(key)
    begin = _offsets(counts, pool)
    out = pool.empty(int(begin[-1]), _wide(n))
    small = _least_type(cap)
    top = small(255 if cap < 255 else 65535)
    lcps = pool.empty(int(begin[-1]), small) if seed_lcp is not None else None
    fill = pool.empty(sigma, np.int64)
    if last >= 0:
        out[-1] = last
        fill[-1] = 1
    seed_begin = _offsets(seed_counts, pool)
    since = pool.empty(sigma, small)  # least prefix after the last entry that induced into each segment
    live = np.zeros(0, np.int64)  # where `since` is not 0: only while one symbol lasts
    shared = pool.empty(sigma, bool)  # symbols whose members wait for their turn
    np.greater(counts, 1, out=shared)
    single = any((counts[a:b] == 1).any() for a, b in _blocks(sigma - (last >= 0)))  # the last has its place
    for a, b in _blocks(n) if single else ():
        alone = np.flatnonzero(member[a:b] & ~shared[key[a:b]]) + a
        out[begin[key[alone]]] = alone
        fill[key[alone]] = 1
    missing = pool.empty(sigma, np.int64)
    np.subtract(counts, fill, out=missing)

    def fade(least: int) -> None:
        nonlocal live
        if least:
            since[live] = np.minimum(since[live], least)
        elif len(live):
            since[live] = 0
            live = live[:0]

    def leave_few(pos: list[int], lcp: list[int] | None) -> None:
        """As leave(), an entry at a time: calls of numpy cost more than a few entries do."""
        nonlocal live
        low, own = int(top), {}  # least prefix so far, and after the last entry into each segment
        for e, p in enumerate(pos):
            if lcp is not None:
                l = lcp[e]
                low = min(low, l)
                for d, x in own.items():
                    if l < x:
                        own[d] = l
            if not p or not member[p - 1]:
                continue
            d = int(key[p - 1])
            if not shared[d]:
                continue
            before = int(fill[d])
            to = int(begin[d]) + before
            out[to] = p - 1
            if lcp is not None:
                x = own[d] if d in own else min(int(since[d]), low)
                lcps[to] = min(x, cap - 1) + 1 if before else 0
                own[d] = int(top)
            fill[d] = before + 1
            missing[d] -= 1
        if lcp is not None and pos:
            fade(low)
            stays = [d for d, x in own.items() if x and not since[d]]
            for d, x in own.items():
                since[d] = x
            if stays:
                live = np.append(live, stays)

    def leave(pos: np.ndarray, lcp: np.ndarray | None) -> None:
        nonlocal live
        if len(pos) <= FEW:
            leave_few(pos.tolist(), None if lcp is None else lcp.tolist())
            return
        q = pos - 1
        d = key[q]
        ok = member[q]
        ok &= shared[d]
        if not pos.all():
            ok[pos == 0] = False
        at = np.flatnonzero(ok)
        if not len(at):
            if lcp is not None and len(live):
                fade(int(lcp.min()))
            return
        d = d[at]
        m = len(d)
        if d.dtype == np.int32:  # a plain sort of symbols and places is faster than a stable one of symbols
            both = (d.astype(np.int64) << 32) | np.arange(m)
            both.sort()
            d, order = both >> 32, both & 0xFFFFFFFF
        else:
            order = np.argsort(d, kind="stable")
            d = d[order]
        at = at[order]
        new = np.empty(m, bool)
        new[0] = True
        np.not_equal(d[1:], d[:-1], out=new[1:])
        first = np.flatnonzero(new)
        group = d[first]
        size = np.empty(len(first), np.int64)
        np.subtract(first[1:], first[:-1], out=size[:-1])
        size[-1] = m - first[-1]
        before = fill[group]
        to = np.repeat(begin[group] + before - first, size)
        to += np.arange(m)
        out[to] = q[at]
        if lcp is not None:
            low = int(lcp.min())
            v = np.zeros(m, small)
            np.logical_not(new, out=new)
            if low == 0:  # what nothing separates from the entry before that went there shares more than that
                part = np.cumsum(lcp == 0)[at]
                new[1:] &= part[1:] == part[:-1]
            k = np.flatnonzero(new)
            if len(k):
                v[k] = _least(lcp, at[k - 1] + 1, at[k])
            v[first] = np.minimum(since[group], np.minimum.accumulate(lcp)[at[first]])
            np.minimum(v, cap - 1, out=v)
            v += small(1)
            v[first[before == 0]] = 0
            lcps[to] = v
            fade(low)
            rest = np.empty(len(lcp) + 1, small)
            rest[-1] = top
            np.minimum.accumulate(lcp[::-1], out=rest[-2::-1])
            after = rest[at[first + size - 1] + 1]
            stays = group[(after > 0) & (since[group] == 0)]  # others are live already
            since[group] = after
            if len(stays):
                live = np.append(live, stays)
        fill[group] = before + size
        missing[group] -= size

    c, read = 0, 0
    while c < sigma:
        if missing[c]:
            a, b = int(begin[c]) + read, int(begin[c] + fill[c])
            b = min(b, a + BATCH)
            if a == b:
                raise RuntimeError("a segment of the queue stays short")
            leave(out[a:b].astype(np.int64), np.array(lcps[a:b]) if lcps is not None else None)
            read = b - int(begin[c])
            continue
        y, step = c + 1, 256
        most = begin[c] + seed_begin[c] + BATCH
        while y < sigma:
            part = missing[y : y + step]
            stop = np.flatnonzero(part)
            room = np.searchsorted(begin[y + 1 : y + step + 1] + seed_begin[y + 1 : y + step + 1], most, side="right")
            got = min(len(part), int(stop[0]) if len(stop) else len(part), int(room))
            y += got
            if got < len(part):
                break
            step = min(2 * step, BATCH)
        lo, hi, slo, shi = int(begin[c]) + read, int(begin[y]), int(seed_begin[c]), int(seed_begin[y])
        if y == c + 1:  # one segment may be larger than a batch
            for a in range(lo, hi, BATCH):
                leave(out[a : min(hi, a + BATCH)].astype(np.int64), np.array(lcps[a : min(hi, a + BATCH)]) if lcps is not None else None)
            for a in range(slo, shi, BATCH):
                s = seeds[a : min(shi, a + BATCH)].astype(np.int64)
                l = None
                if lcps is not None:
                    l = np.array(seed_lcp[a : min(shi, a + BATCH)])
                    if a == slo:
                        l[0] = min(int(run[out[hi - 1]]), int(run[s[0]])) if hi > begin[c] else 0
                leave(s, l)
        elif hi - lo + shi - slo <= FEW:
            l, m, s = None, out[lo:hi], seeds[slo:shi]
            ends = [*zip(key[m].tolist(), m.tolist(), strict=True)], [*zip(key[s].tolist(), s.tolist(), strict=True)]
            line = sorted([(k, 0, e) for e, (k, _) in enumerate(ends[0])] + [(k, 1, e) for e, (k, _) in enumerate(ends[1])])
            if lcps is not None:
                given, l = (lcps[lo:hi].tolist(), seed_lcp[slo:shi].tolist()), []
                before = (c, 0, int(out[lo - 1])) if read else (-1, 0, 0)  # the entry that left last: symbol, kind, position
                for k, kind, e in line:
                    at = ends[kind][e][1]
                    if not kind or before[:2] == (k, 1):
                        l.append(given[kind][e])
                    else:  # the first seed of a symbol, after its last member if there is one
                        l.append(min(int(run[before[2]]), int(run[at])) if before[0] == k else 0)
                    before = k, kind, at
            leave_few([ends[kind][e][1] for _, kind, e in line], l)
        else:
            m, s = out[lo:hi].astype(np.int64), seeds[slo:shi].astype(np.int64)
            km, ks = key[m], key[s]
            at_m = np.arange(len(m)) + np.searchsorted(ks, km, side="left")
            at_s = np.arange(len(s)) + np.searchsorted(km, ks, side="right")
            pos = np.empty(len(m) + len(s), np.int64)
            pos[at_m], pos[at_s] = m, s
            l = None
            if lcps is not None:
                l = np.empty(len(pos), small)
                l[at_m] = lcps[lo:hi]
                l[at_s] = seed_lcp[slo:shi]
                if len(s):
                    head = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1])))
                    before = np.searchsorted(km, ks[head], side="right") - 1  # the last member of the symbol, if any
                    has = (before >= 0) & (km[np.maximum(before, 0)] == ks[head]) if len(km) else np.zeros(len(head), bool)
                    edge = np.zeros(len(head), small)
                    edge[has] = np.minimum(run[m[before[has]]], run[s[head[has]]])
                    if read and head[0] == 0 and ks[0] == c and not has[0]:
                        edge[0] = min(int(run[out[lo - 1]]), int(run[s[0]]))
                    l[at_s[head]] = edge
            leave(pos, l)
        c, read = y, 0
    return out, lcps


def _compare(t: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes a and b, known to reach start, up to cap."""
    out = np.minimum(start, cap).astype(np.int64)
    live = np.flatnonzero(out < cap)
    n = len(t)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = (x < n) & (y < n)
        same[same] = t[x[same]] == t[y[same]]
        live = live[same]
        out[live] += 1
        live = live[out[live] < cap]
    return out


def _treble(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of names by their first cap / 2 names or more, and how many each shares with the one before, at most.

    A rank stands for h names; three of them make the key for 3 h. Ranks stay below 2^21, as names number at most BASE.
    """
    n = len(names)
    ranks, steps = [names.astype(np.int64)], [1]
    want = max(1, (cap + 1) // 2)
    order, last = None, None
    while steps[-1] < want:
        r, h = ranks[-1], steps[-1]
        key = r << 42
        if h < n:
            key[: n - h] |= (r[h:] + 1) << 21
        if 2 * h < n:
            key[: n - 2 * h] |= r[2 * h :] + 1
        order = np.argsort(key)
        k = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(k[1:] != k[:-1], out=new[1:])
        last = int(new[-1])
        r = np.empty(n, np.int64)
        r[order] = new
        ranks.append(r)
        steps.append(3 * h)
        if last == n - 1:
            break
    if order is None:
        order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for r, step in zip(ranks[::-1], steps[::-1], strict=True):
        wide = np.append(r, -1)
        for _ in range(2 if step < steps[-1] else 1):
            same = (wide[a] == wide[b]) & (b < n) & (a < n)
            k = np.flatnonzero(same)
            if not len(k):
                break
            shared[1 + k] += step
            a[k] = np.minimum(a[k] + step, n)
            b[k] = np.minimum(b[k] + step, n)
    return order, shared


def _types(t: np.ndarray, cap: int, pool: Pool) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix rises (S type, by the next symbol that differs), and how often its first symbol repeats, capped."""
    n = len(t)
    rise, run = pool.empty(n, bool), pool.empty(n, _least_type(cap))
    rise[-1], run[-1] = True, 1
    end, up = n - 1, True  # of the block after: where its first symbol ends, and its type
    for a, b in reversed(list(_blocks(n - 1))):
        x = np.array(t[a : b + 1])
        at = np.arange(a, b)
        at[x[:-1] == x[1:]] = n
        at = np.minimum.accumulate(at[::-1])[::-1]
        within = at < n
        r = np.empty(b - a, bool)
        i = at[within] - a
        r[within] = x[i] < x[i + 1]
        r[~within] = up
        at[~within] = end
        rise[a:b] = r
        run[a:b] = np.minimum(at - np.arange(a, b) + 1, cap)
        end, up = int(at[0]), bool(r[0])
    return rise, run


def _names(t: np.ndarray, order: np.ndarray, lms: np.ndarray, number: np.ndarray, pool: Pool) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings by position, from their order; and how many there are."""
    m = len(lms)
    reduced, name = pool.empty(m, _wide(m)), -1

    def length(k: np.ndarray) -> np.ndarray:
        return np.where(k + 1 < m, lms[np.minimum(k + 1, m - 1)].astype(np.int64) - lms[k] + 1, 1)

    before = None
    for a, b in _blocks(m):
        x = order[a:b].astype(np.int64)
        k = number[x].astype(np.int64)
        size = length(k)
        p = np.concatenate(([x[0]], x[:-1])) if before is None else np.concatenate(([before[0]], x[:-1]))
        s = np.concatenate(([-1 if before is None else before[1]], size[:-1]))
        equal = size == s
        live, off = np.flatnonzero(equal), 0
        while len(live):
            ok = t[p[live] + off] == t[x[live] + off]
            equal[live[~ok]] = False
            off += 1
            live = live[ok]
            live = live[off < size[live]]
        own = name + np.cumsum(~equal)
        reduced[k] = own
        name, before = int(own[-1]), (int(x[-1]), int(size[-1]))
    return reduced, name + 1


def suffix_array(t: np.ndarray, sigma: int, cap: int, pool: Pool, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of t (symbols below sigma; the last is 0 and occurs once) and common prefixes with the suffix before, capped."""
    n = len(t)
    small, wide = _least_type(cap), _wide(n)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, small)
    rise, run = _types(t, cap, pool)
    fall, mirrored, is_lms = pool.empty(n, bool), pool.empty(n, t.dtype), pool.empty(n, bool)
    m = 0
    for a, b in _blocks(n):
        np.logical_not(rise[a:b], out=fall[a:b])
        np.subtract(t.dtype.type(sigma - 1), t[a:b], out=mirrored[a:b])
        is_lms[a:b] = rise[a:b]
        is_lms[max(a, 1) : b] &= ~rise[max(a, 1) - 1 : b - 1]
        if a == 0:
            is_lms[0] = False
        m += int(np.count_nonzero(is_lms[a:b]))
    lms, number, seeds = pool.empty(m, wide), pool.empty(n, wide), pool.empty(m, wide)
    done = 0
    for a, b in _blocks(n):
        x = np.flatnonzero(is_lms[a:b]) + a
        lms[done : done + len(x)] = x
        number[x] = np.arange(done, done + len(x))
        done += len(x)

    # order of LMS substrings, from that of their first symbols
    falls, rises, starts = _count(t, None, fall, sigma, pool), _count(t, None, rise, sigma, pool), _count(t, lms, None, sigma, pool)
    at = _offsets(starts, pool)
    for a, b in _blocks(m):
        x = np.array(lms[a:b])
        k = t[x]
        o = np.argsort(k, kind="stable")
        k, x = k[o], x[o]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(first, len(k)))
        seeds[np.repeat(at[k[first]] - first, size) + np.arange(len(k))] = x
        at[k[first]] += size
    down, _ = induce(t, fall, falls, seeds, starts, None, None, sigma, cap, pool)
    up, _ = induce(mirrored, rise, rises[::-1], down[::-1], falls[::-1], None, None, sigma, cap, pool, last=n - 1)
    order, done = pool.empty(m, wide), 0
    for a, b in reversed(list(_blocks(len(up)))):
        x = up[a:b][::-1]
        x = x[is_lms[x]]
        order[done : done + len(x)] = x
        done += len(x)
    del down, up, is_lms
    reduced, distinct = _names(t, order, lms, number, pool)
    del number

    seed_lcp = pool.empty(m, small)
    if distinct < m:
        sub, known = _treble(np.array(reduced), cap) if m <= base else suffix_array(reduced, distinct, cap, pool, base)
        for a, b in _blocks(m):
            seeds[a:b] = lms[sub[a:b]]
    else:
        sub, known, seeds = None, None, order
    for a, b in _blocks(m):
        lo = max(a, 1)
        if lo >= b:
            continue
        x, y = seeds[lo - 1 : b - 1].astype(np.int64), seeds[lo:b].astype(np.int64)
        reach = np.zeros(b - lo, np.int64)
        if sub is not None:
            k = sub[lo:b].astype(np.int64)
            reach = lms[np.minimum(k + known[lo:b], m - 1)].astype(np.int64) - lms[k]
        seed_lcp[lo:b] = _compare(t, x, y, reach, cap)

    del sub, known, reduced, order
    # all suffixes
    down, down_lcp = induce(t, fall, falls, seeds, starts, seed_lcp, run, sigma, cap, pool)
    back = pool.empty(len(down), small)
    back[1:] = down_lcp[:0:-1]
    up, up_lcp = induce(mirrored, rise, rises[::-1], down[::-1], falls[::-1], back, run, sigma, cap, pool, last=n - 1)
    del mirrored, back, seeds, seed_lcp, lms
    falls_to, rises_to = _offsets(falls, pool), _offsets(rises, pool)
    sa, lcp = pool.empty(n, wide), pool.empty(n, small)
    for a, b in _blocks(len(down)):
        x = np.array(down[a:b])
        place = np.arange(a, b) + rises_to[t[x]]
        sa[place], lcp[place] = x, down_lcp[a:b]
    last = len(up)
    for a, b in _blocks(last):
        x = up[last - b : last - a][::-1]
        place = np.arange(a, b) + falls_to[t[x].astype(np.int64) + 1]
        sa[place] = x
        lcp[place[max(1 - a, 0) :]] = up_lcp[last - b + 1 : last - max(a, 1) + 1][::-1]
    for a, b in _blocks(sigma):  # where the rising suffixes of a symbol follow the falling ones
        k = np.flatnonzero((falls[a:b] > 0) & (rises[a:b] > 0)) + a
        edge = falls_to[k] + rises_to[k] + falls[k]
        lcp[edge] = np.minimum(run[sa[edge - 1]], run[sa[edge]])
    return sa, lcp

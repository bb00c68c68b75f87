"""Exact repeats of WIDTH bytes across all texts, by suffix arrays built shard by shard.

Sharding: every window of WIDTH bytes is assigned to the least-hashed GRAM bytes in it (its anchor; the
leftmost, of equals). Equal windows have equal anchors, so windows fall into runs of neighbours with one
anchor, and a run's text, with what its last window needs, can go to its anchor's shard. Only anchors that
occur twice matter. Runs with equal text are sent once, with their number. Neighbouring runs share WIDTH - 1 bytes;
those that are the only text of their anchors go as one string, up to CHAIN windows, as no other shard asks for any
of them, so what texts have in common for long is sorted about once instead of four times. An anchor with more than HOT
different runs is split again by what all windows of a narrow range around it have in common, so that no
anchor, however common, makes a task grow without bound.

Detection: a shard's runs form one text, whose suffix array and common prefixes suffix.py builds by external
induced sorting: text, arrays and queues go to files, so a task holds a batch of entries and a few numbers for each
run, whatever the size of its shard. Those files are a worker's own and go with its shard. Suffixes that share WIDTH bytes stand together; a window is repeated if the runs in its
group stand for two or more places. Repeated windows are mapped back to every place of their run.

Edge cases: null text is empty; texts shorter than WIDTH bytes have no window; matches never cross rows;
overlapping repeats inside one text count; rows that repeat an id and text count as separate places (so all of
their windows are repeated); a null id is an id like any other; an empty table gives an empty result. Other
columns pass through cut(); names beginning with _ps_ are reserved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, env_threads, shared_dir
from .suffix import BATCH, Pool, suffix_array
from .textvec import _PLAIN, U, _powers, buffers, mix, slices

WIDTH, GRAM = 200, 64
#: Most different runs of one anchor in a shard before it is split by ranges of RANGE windows, and of 1 after that.
HOT, RANGES = 1024, (16, 1)
#: Bytes of text of one suffix array, unless one anchor has more; bytes of one array, or of text, that stay in memory.
#: Sorting a shard takes arrays of some 40 bytes for each of its own, all of them in files.
SHARD, MEMORY = 1 << 20, 1 << 18
#: Windows of neighbouring runs that go to a shard as one string.
CHAIN = 1 << 15
#: Bytes of a long row, and of short ones, whose runs are found at a time: blocks whose arrays stay in a core's cache.
SEGMENT, BLOCK = 1 << 20, 1 << 15
_RUN = "id long, k long, m long, ph long, p int, n int"


def _sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_PLAIN[b] * up[: len(b)], out=total[1:])
    return total, down


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours."""
    step = 1
    while 2 * step <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def runs_of(b: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of rows laid end to end in b (ends: where each ends): row, start, windows, anchor hash and text hash of each run."""
    none = np.zeros(0, np.int64)
    if len(b) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    total, down = _sums(b)
    h = mix((total[gram:] - total[:-gram]) * down[: len(b) - gram + 1])
    low = U((1 << 24) - 1)
    where = (_least((h & ~low) | np.arange(len(h), dtype=np.uint64), width - gram + 1) & low).astype(np.int64)
    row = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))[: len(where)]
    fits = np.arange(len(where)) + width <= ends[row]
    first = fits.copy()
    first[1:] &= ~fits[:-1] | (where[1:] != where[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    edge = np.flatnonzero(fits[:-1] & (~fits[1:] | first[1:])) if len(fits) > 1 else none
    stop = np.append(edge, len(fits) - 1) if fits[-1] else edge
    n = stop - start + 1
    end = start + n + width - 1
    return row[start], start, n, h[where[start]], mix((total[end] - total[start]) * down[start] + n.astype(np.uint64))


def _segments(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows, long rows in segments that overlap by WIDTH - 1: bytes, ends, row numbers and where each begins in its row."""
    for i, j in slices(off, BLOCK):
        if j - i == 1 and off[j] - off[i] > SEGMENT:
            for a in range(int(off[i]), int(off[j]), SEGMENT):
                e = min(int(off[j]), a + SEGMENT + WIDTH - 1)
                yield data[a:e], np.array([e - a]), np.array([i]), np.array([a - off[i]])
        else:
            yield data[off[i] : off[j]], off[i + 1 : j + 1] - off[i], np.arange(i, j), np.zeros(j - i, np.int64)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    env_threads()
    for b in batches:
        ids, ks = b.column(0), b.column(1)
        data, off = buffers(b.column(2))
        for text, ends, rows, at in _segments(data, off):
            row, start, n, m, ph = runs_of(text, ends)
            begins = np.concatenate(([0], ends[:-1]))
            r = pa.array(rows[row])
            p = start - begins[row] + at[row]
            yield pa.RecordBatch.from_arrays([ids.take(r), ks.take(r), pa.array(m.view(np.int64)), pa.array(ph.view(np.int64)), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "k", "m", "ph", "p", "n"])


def _merge(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that spans s..e cover."""
    if not len(s):
        return s, e
    o = np.argsort(s, kind="stable")
    s, e = s[o], np.maximum.accumulate(e[o])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


class _Shard:
    """Different byte strings, each standing for a number of places: their bytes in a file beyond `memory`, a few numbers for each in memory."""

    def __init__(self, memory: int):
        self.pool = Pool(memory)
        self.memory, self.size = memory, 0
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.file = None
        self.numbers: list[tuple[np.ndarray, ...]] = []
        self.more: list[tuple[np.ndarray, ...]] = []

    def add(self, rows: pa.RecordBatch) -> None:
        """Rows m, ph, n, c, piece, more (may be missing); those that repeat the last row's m, ph and n, of which a repeated row has several, are left out."""
        m, ph, n, c = (rows.column(k).to_numpy() for k in range(4))
        data, off = buffers(rows.column(4))
        new = np.concatenate(([True], (m[1:] != m[:-1]) | (ph[1:] != ph[:-1]) | (n[1:] != n[:-1])))
        if self.numbers:
            last = self.numbers[-1]
            new[0] = (m[0], ph[0], n[0]) != (last[0][-1], last[1][-1], last[2][-1])
        if not new.any():
            return
        size = np.diff(off)
        self._spool(data if new.all() else data[np.repeat(new, size)])
        count = np.zeros(len(m), np.int64)
        if rows.num_columns > 5:
            more = rows.column(5)
            count = more.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            of = np.repeat(new, count)
            self.more.append(tuple(x.to_numpy()[of] for x in more.flatten().flatten()))
        self.numbers.append((m[new], ph[new], n[new], c[new], size[new], count[new]))

    def runs(self) -> tuple[np.ndarray, ...]:
        """The runs of all strings: string, where it begins there, m, ph, n."""
        m, ph, n, _, _, count = (np.concatenate(x) for x in zip(*self.numbers, strict=True))
        head = np.cumsum(count + 1) - count - 1  # where the first run of each string stands
        rest = np.ones(len(m) + int(count.sum()), bool)
        rest[head] = False
        out = []
        for k, x in enumerate((m, ph, n.astype(np.int64))):
            y = np.empty(len(rest), np.int64)
            y[head] = x
            if self.more:
                y[rest] = np.concatenate([more[k] for more in self.more])
            out.append(y)
        before = np.cumsum(out[2]) - out[2]
        return np.repeat(np.arange(len(m)), count + 1), before - np.repeat(before[head], count + 1), *out

    def _spool(self, data: np.ndarray) -> None:
        self.size += len(data)
        self.parts.append(data)
        self.held += len(data)
        if self.held > self.memory:
            if self.file is None:
                self.file = open(self.pool.path(), "w+b")
            for x in self.parts:
                self.file.write(x)
            self.parts, self.held = [], 0

    def bytes_(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint8)
        for x in self.parts:
            self.file.write(x)
        self.file.flush()
        self.parts, self.held = [], 0
        return np.asarray(np.memmap(self.file, np.uint8, "r", shape=(self.size,)))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.pool.close()


def repeats(data: np.ndarray, size: np.ndarray, weight: np.ndarray, width: int = WIDTH, memory: int = MEMORY, pool: Pool | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different byte strings laid end to end, each standing for `weight` places: the spans that repeated strings of `width` bytes cover, as string, start and end."""
    if pool is None:
        with Pool(memory) as pool:
            return repeats(data, size, weight, width, memory, pool)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    n = int(begin[-1]) + 1
    t = pool.empty(n, np.uint16)
    first = begin[:-1] - np.arange(len(size))  # where each string begins in data
    for i, j in slices(begin, BATCH):  # 0 ends the text, 1 each string
        x = np.ones(int(begin[j] - begin[i]), np.uint16)
        inside = np.ones(len(x), bool)
        inside[begin[i + 1 : j + 1] - begin[i] - 1] = False
        x[inside] = data[first[i] : first[j - 1] + size[j - 1]]
        x[inside] += 2
        t[begin[i] : begin[j]] = x
    sa, lcp = suffix_array(t, 258, width, pool)
    del t
    again = pool.empty(n, bool)
    a = 0
    while a < n:  # groups of suffixes that share `width` symbols
        b = min(n, a + BATCH)
        while b < n and lcp[b] >= width:  # a group is taken whole
            b += 1
        pos = sa[a:b].astype(np.int64)
        new = np.flatnonzero(lcp[a:b] < width)
        of = np.searchsorted(begin, pos, side="right") - 1
        inside = of < len(size)  # all but the end of the text
        of[~inside] = 0
        fits = inside & (pos - begin[of] + width <= size[of])
        w = np.where(fits, weight[of], 0)
        # all of a group begin alike, so either all fit or none does
        many = np.add.reduceat(w, new) >= 2
        again[pos[np.repeat(many, np.diff(np.append(new, len(pos))))]] = True
        a = b
    del sa, lcp
    spans: list[np.ndarray] = []
    last = np.zeros(0, np.int64)  # the span that the next block may continue: string, start, end
    for a in range(0, n, BATCH):
        s = np.flatnonzero(again[a : a + BATCH]) + a
        if not len(s):
            continue
        of = np.searchsorted(begin, s, side="right") - 1
        s -= begin[of]
        new = np.concatenate(([True], (s[1:] - s[:-1] > width) | (of[1:] != of[:-1])))
        f = np.flatnonzero(new)
        got = np.stack([of[f], s[f], s[np.append(f[1:] - 1, len(s) - 1)] + width])
        if len(last) and last[0] == got[0, 0] and got[1, 0] <= last[2]:
            got[1, 0] = last[1]
        elif len(last):
            spans.append(last[:, None])
        spans.append(got[:, :-1])
        last = got[:, -1]
    if len(last):
        spans.append(last[:, None])
    of, s, e = np.concatenate(spans, axis=1) if spans else np.zeros((3, 0), np.int64)
    return of, s, e


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows m, ph, n, c, piece, more (may be missing) sorted by m, ph, n: spans for those runs that have repeated windows. Whole anchors make a shard."""
    env_threads()
    shard = _Shard(MEMORY)

    def done() -> pa.RecordBatch:
        _, _, _, c, size, _ = (np.concatenate(x) for x in zip(*shard.numbers, strict=True))
        string, off, m, ph, n = shard.runs()
        try:
            of, s, e = repeats(shard.bytes_(), size, c, pool=shard.pool)
        finally:
            shard.close()
        # each run's part of its string's spans
        lo = np.searchsorted(of, string, side="left")
        many = np.searchsorted(of, string, side="right") - lo
        run = np.repeat(np.arange(len(string)), many)
        at = np.arange(len(run)) + np.repeat(lo - np.cumsum(many) + many, many)
        s, e = np.maximum(s[at] - off[run], 0), np.minimum(e[at] - off[run], n[run] + WIDTH - 1)
        whole = e - s >= WIDTH  # holds a window of the run
        run, s, e = run[whole], s[whole], e[whole]
        has = np.unique(run)
        ends = pa.array(np.append(np.searchsorted(run, has), len(run)).astype(np.int32))
        spans = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["s", "e"]))
        return pa.RecordBatch.from_arrays([pa.array(m[has]), pa.array(ph[has]), pa.array(n[has].astype(np.int32)), spans], ["m", "ph", "n", "spans"])

    for b in batches:
        at = 0
        while at < b.num_rows:
            m = b.column(0).to_numpy()
            off = buffers(b.column(4))[1]
            # as many rows as fill the shard, then to the end of their anchor
            stop = min(b.num_rows, at + 1 + int(np.searchsorted(off[at + 1 :] - off[at], SHARD - shard.size)))
            if shard.size >= SHARD:
                if m[at] != shard.numbers[-1][0][-1]:
                    yield done()
                    shard = _Shard(MEMORY)
                    continue
                other = np.flatnonzero(m[at:] != m[at])
                stop = at + int(other[0]) if len(other) else b.num_rows
            shard.add(b.slice(at, stop - at))
            at = stop
    if shard.numbers:
        yield done()


def _apart(rows: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, bytes]]:
    """m, ph, n, c, piece of every run, those laid together too: they get here if rows repeat an id and text that often."""
    for m, ph, n, c, piece, *more in zip(*(x.to_pylist() for x in rows.columns), strict=True):
        yield m, ph, n, c, piece[: n + WIDTH - 1]
        at = n
        for r in (more[0] or ()) if more else ():
            yield r["m"], r["ph"], r["n"], c, piece[at : at + r["n"] + WIDTH - 1]
            at += r["n"]


def _refine(width: int):
    """Cut the runs of hot anchors by ranges of `width` windows; the new anchor hashes what all windows of the range share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        for b in batches:
            cols = ([], [], [], [], [], [], [], [], [])
            for m, ph, n, c, piece in _apart(b):
                x = np.frombuffer(piece, np.uint8)
                total, down = _sums(x)
                if width == 1:
                    starts, lengths = np.arange(n), np.ones(n, np.int64)
                    lo, hi = starts, starts + WIDTH
                else:
                    h = mix((total[GRAM:] - total[:-GRAM]) * down[: len(x) - GRAM + 1])
                    low = U((1 << 24) - 1)
                    q = int(np.argmin((h[: n + WIDTH - GRAM] & ~low)[max(0, n - 1) : WIDTH - GRAM + 1])) + max(0, n - 1)
                    step = (q - np.arange(n)) // width
                    new = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1])))
                    starts, lengths = new, np.diff(np.append(new, n))
                    lo = q - width * step[new]
                    hi = lo - width + 1 + WIDTH
                key = mix((total[hi] - total[lo]) * down[lo] + U(width) + (U(0) if width == 1 else (q - lo).astype(np.uint64)))
                end = starts + lengths + WIDTH - 1
                own = mix((total[end] - total[starts]) * down[starts] + lengths.astype(np.uint64))
                for k, (s, l) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                    for col, v in zip(cols, (m, ph, n, s, int(key[k].view(np.int64)), int(own[k].view(np.int64)), l, c, piece[s : s + l + WIDTH - 1]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["m", "ph", "n", "off", "m2", "ph2", "n2", "c", "piece"])

    return run


def _slice_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of compressed texts and their runs p, n, m, ph, c, alone: the strings for the shards. Neighbouring runs that are alone
    make one string, called by the first, standing for the least number of any; more tells the others."""
    env_threads()
    for b in batches:
        lists = b.column(1)
        size = lists.value_lengths().fill_null(0).to_numpy()
        row = np.repeat(np.arange(b.num_rows), size)
        p, n, m, ph, c, alone = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        if not len(p):
            continue
        o = np.lexsort((p, row))
        p, n, m, ph, c, alone = (x[o] for x in (p, n, m, ph, c, alone))
        joins = alone[1:] & alone[:-1] & (row[1:] == row[:-1]) & (p[1:] == p[:-1] + n[:-1])
        new = np.concatenate(([True], ~joins))
        part = (p - p[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]) // CHAIN
        new[1:] |= part[1:] != part[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        start, stop, of = p[first].tolist(), (p[last] + n[last] + WIDTH - 1).tolist(), row[first].tolist()
        texts = b.column(0)
        pieces, held, text = [], -1, b""
        for r, x, y in zip(of, start, stop, strict=True):
            if r != held:
                held, text = r, _inflate(texts[r].as_py())
            pieces.append(text[x:y])
        ends = pa.array(np.append(0, np.cumsum(last - first)).astype(np.int32))
        more = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x[~new]) for x in (m, ph, n)], ["m", "ph", "n"]))
        yield pa.RecordBatch.from_arrays([pa.array(m[first]), pa.array(ph[first]), pa.array(n[first]), pa.array(np.minimum.reduceat(c, first)), pa.array(pieces, pa.binary()), more], ["m", "ph", "n", "c", "piece", "more"])


_PIECE = "m long, ph long, n int, c long, piece binary, more array<struct<m:long,ph:long,n:int>>"
_SPANS = "m long, ph long, n int, spans array<struct<s:int,e:int>>"


def _detect(pieces: DataFrame, scratch: Scratch, level: int = 0) -> DataFrame:
    """pieces: m, ph, n, c, piece and, for runs laid together, more, kept as a table. Spans of repeated windows in each run."""
    search = lambda p: p.repartition("m").sortWithinPartitions("m", "ph", "n").mapInArrow(_search, _SPANS)
    if level == len(RANGES):
        return scratch.keep(search(pieces), f"spans-{level}")
    hot = scratch.keep(pieces.groupBy("m").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > HOT).select("m"), f"hot-{level}")
    if hot.isEmpty():
        return scratch.keep(search(pieces), f"spans-{level}")
    spans = scratch.keep(search(pieces.join(hot, "m", "left_anti").select(*pieces.columns)), f"spans-{level}")
    cut = scratch.keep(pieces.join(hot, "m", "left_semi").select(*pieces.columns).mapInArrow(_refine(RANGES[level]), "m long, ph long, n int, off int, m2 long, ph2 long, n2 int, c long, piece binary"), f"cut-{level}")
    once = cut.groupBy("m2", "ph2", "n2").agg(F.sum("c").alias("c"), F.min("piece").alias("piece"))
    often = cut.groupBy("m2").agg(F.sum("c").alias("c2")).where("c2 > 1").select("m2")
    smaller = scratch.keep(once.join(often, "m2").select(F.col("m2").alias("m"), F.col("ph2").alias("ph"), F.col("n2").alias("n"), "c", "piece"), f"pieces-{level + 1}")
    found = _detect(smaller, scratch, level + 1).select(F.col("m").alias("m2"), F.col("ph").alias("ph2"), F.col("n").alias("n2"), "spans")
    back = cut.select("m", "ph", "n", "off", "m2", "ph2", "n2").join(found, ["m2", "ph2", "n2"])
    back = back.groupBy("m", "ph", "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("spans", lambda x: F.struct((x["s"] + F.col("off")).alias("s"), (x["e"] + F.col("off")).alias("e"))))))).alias("spans"))
    back = scratch.keep(back, f"back-{level}")
    for step in (f"cut-{level}", f"pieces-{level + 1}", f"spans-{level + 1}", f"back-{level + 1}"):
        scratch.drop(step)
    return spans.union(back)


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).cast("string").alias("t"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Scratch]:
    """(id, k, spans): for texts with repeats, spans of bytes in any order, possibly overlapping; k hashes id and text."""
    scratch = Scratch(docs.sparkSession, "passages")
    shared_dir(docs.sparkSession)
    keyed = _keys(docs, id_col, text_col)
    runs = scratch.keep(keyed.mapInArrow(_find_runs, _RUN), "runs")
    # kept as a table, so that the join that follows can split a common anchor
    twice = scratch.keep(runs.groupBy("m").agg(F.count(F.lit(1)).alias("c"), ((F.min("ph") == F.max("ph")) & (F.min("n") == F.max("n"))).alias("alone")).where("c > 1").select("m", "alone"), "twice")
    places = scratch.keep(runs.join(twice, "m").select("id", "k", "m", "ph", "p", "n", "alone"), "places")
    for step in ("runs", "twice"):
        scratch.drop(step)
    once = places.groupBy("m", "ph", "n", "alone").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "k", "p")).alias("r"))
    asked = once.groupBy("r.id", "r.k").agg(F.collect_list(F.struct("r.p", "n", "m", "ph", "c", "alone")).alias("runs"))
    fetched = _deflated(keyed, "t").join(asked, ["id", "k"]).select("t", "runs")
    pieces = scratch.keep(fetched.mapInArrow(_slice_runs, _PIECE), "pieces")
    spans = _detect(pieces, scratch)
    placed = places.join(spans, ["m", "ph", "n"]).select("id", "k", F.transform("spans", lambda x: F.struct((x["s"] + F.col("p")).alias("s"), (x["e"] + F.col("p")).alias("e"))).alias("spans"))
    out = scratch.keep(placed.groupBy("id", "k").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeated")
    for step in ("places", "pieces", "spans-0", "back-0"):
        scratch.drop(step)
    return out, scratch


def _inflate(z: bytes | None) -> bytes:
    return zstandard.decompress(z) if z else b""


def _deflated(df: DataFrame, col: str) -> DataFrame:
    """The column's texts as compressed bytes, for a cheaper shuffle."""
    names = df.columns
    n = names.index(col)
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == col else f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = pa.array([None if x is None else z.compress(x.encode("utf-8", "surrogatepass")) for x in part.column(n).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([texts if c == n else part.column(c) for c in range(part.num_columns)], names)

    return df.mapInArrow(run, schema)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their repeats removed: text_col is what is left, and _ps_bytes, _ps_removed, _ps_spans and _ps_sha256 tell of it.

    The digest is of the bytes left; where a cut splits a character, its remaining bytes are dropped from the text alone.
    """
    spans, _ = repeated(docs, id_col, text_col)
    columns = docs.columns
    keyed = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("_ps_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_ps_k"))
    joined = _deflated(keyed, text_col).join(spans.select(F.col("id").alias("_ps_id"), F.col("k").alias("_ps_k"), F.col("spans").alias("_ps_s")), ["_ps_id", "_ps_k"], "left").select(*columns, "_ps_s")
    n = columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema) + ", _ps_bytes long, _ps_removed long, _ps_spans long, _ps_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts, sizes, removed, counts, digests = [], [], [], [], []
                for z, spans_ in zip(part.column(n).to_pylist(), part.column(len(columns)).to_pylist(), strict=True):
                    raw = _inflate(z)
                    s, e = _merge(np.array([x["s"] for x in spans_ or ()], np.int64), np.array([x["e"] for x in spans_ or ()], np.int64))
                    kept = b"".join(raw[a:c] for a, c in zip(np.concatenate(([0], e)).astype(int), np.append(s, len(raw)).astype(int), strict=True))
                    texts.append(None if z is None else kept.decode("utf-8", "ignore"))
                    sizes.append(len(raw))
                    removed.append(int((e - s).sum()))
                    counts.append(len(s))
                    digests.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if c == n else part.column(c) for c in range(len(columns))), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], [*columns, "_ps_bytes", "_ps_removed", "_ps_spans", "_ps_sha256"])

    return joined.mapInArrow(run, schema)

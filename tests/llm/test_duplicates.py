import hashlib
import random

import numpy as np
import pytest

from lattica.llm import components, neardup, passages, suffix
from lattica.llm.common import Scratch

from .helpers import documents, empty, frame, prose, words


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def groups(rows, k, percent):
    """Component of each id by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block, k, percent", [(500, 4, 80), (3, 4, 80), (500, 5, 80), (4, 2, 60)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, block, k, percent):
    """Small blocks take the path of families cut in several blocks, all with lists."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    if block < 500:
        monkeypatch.setattr(neardup, "TILE_ROWS", block)
        monkeypatch.setattr(neardup, "FEW", 0)
    rows = documents()
    got = neardup.near_duplicates(frame(spark, rows), k=k, percent=percent).collect()
    want = groups(rows, k, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_needed_matches():
    t = neardup.needed(80, 128, 1e-9)
    rng = np.random.default_rng(0)
    assert 60 < t < 90 and (rng.binomial(128, 0.8, 10**6) >= t).all()


def test_large_family_in_blocks(spark, monkeypatch):
    """A family of many blocks and two groups that only a pair across blocks can join."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 5)
    monkeypatch.setattr(neardup, "TILE_ROWS", 7)
    monkeypatch.setattr(neardup, "FEW", 3)
    rng = random.Random(5)
    base = prose(rng, 60).split()
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(i % 9):
            w[(7 * j + i) % 60] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), k=3, percent=70).collect()}
    assert got == {i: c for i, (_, c) in groups(rows, 3, 70).items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 101), (7, 7), (3, 4)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 101: 50}


def test_suffix_arrays():
    """Against sorting all suffixes; arrays in files, and recursion to the end, too."""
    rng = np.random.default_rng(1)
    for trial in range(150):
        n, s = int(rng.integers(1, 90)), int(rng.integers(1, 5))
        body = rng.integers(1, s + 1, n) if trial % 3 else np.tile(rng.integers(1, s + 1, int(rng.integers(1, 7))), 20)[:n]
        t, cap = np.append(body, 0).astype(np.uint16), int(rng.choice([3, 7, 200]))
        with suffix.Pool(64 if trial % 2 else 1 << 20) as pool:
            sa, lcp = suffix.suffix_array(t, int(t.max()) + 1, cap, pool, base=int(rng.choice([0, 1 << 20])))
            sa, lcp = np.array(sa), np.array(lcp)
        texts = [tuple(t[i : i + cap]) for i in sa]
        assert sorted(sa) == list(range(len(t))) and texts == sorted(texts)
        for a, b, h in zip(texts[:-1], texts[1:], lcp[1:], strict=True):
            assert h == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_suffix_arrays_by_entries_and_by_batches(monkeypatch):
    """Few entries leave the queue one by one, more at once, and blocks may end anywhere: all give what sorting suffixes gives."""
    rng = np.random.default_rng(2)
    for trial in range(60):
        n, s = int(rng.integers(1, 400)), int(rng.integers(1, 6))
        body = rng.integers(1, s + 1, n)
        if trial % 3 == 0:  # copies with changes, as near duplicates have them
            body = np.tile(body[: int(rng.integers(1, 60))], 1 + n // 20)[:n]
            body[rng.integers(0, len(body), 3)] = 1
        t, cap = np.append(body, 0).astype((np.uint16, np.int32)[trial % 2]), int(rng.choice([2, 7, 200, 300]))
        want = sorted(tuple(t[i : i + cap]) for i in range(len(t)))
        base, seen = int(rng.choice([0, 1 << 20])), []
        for few, batch in ((0, 1 << 18), (0, 13), (3, 1 << 18), (3, 13), (1 << 30, 1 << 18), (1 << 30, 13)):
            monkeypatch.setattr(suffix, "FEW", few)
            monkeypatch.setattr(suffix, "BATCH", batch)
            with suffix.Pool(64 if trial % 2 else 1 << 20) as pool:
                sa, lcp = suffix.suffix_array(t, int(t.max()) + 1, cap, pool, base=base)
                seen.append((np.array(sa), np.array(lcp)))
            assert [tuple(t[i : i + cap]) for i in seen[-1][0]] == want and sorted(seen[-1][0]) == list(range(len(t)))
        for _, lcp in seen:
            for a, b, h in zip(want[:-1], want[1:], lcp[1:], strict=True):
                assert h == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_few_entries_of_a_queue_are_cheap(monkeypatch):
    """Names of texts that differ here and there leave the queue a few at a time, which is not worth a sort by numpy each."""
    rng = np.random.default_rng(3)
    t = np.append(np.concatenate([rng.integers(2, 200, 300), rng.integers(2, 200, 400)] * 3), 0).astype(np.uint16)
    calls, plain = [], np.argsort
    monkeypatch.setattr(suffix.np, "argsort", lambda *a, **k: calls.append(1) or plain(*a, **k))
    with suffix.Pool() as pool:
        suffix.suffix_array(t, 258, 200, pool, base=0)
    assert len(calls) < 100


def removed(rows, width):
    seen, out = {}, []
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for p in range(len(b) - width + 1):
            seen[b[p : p + width]] = seen.get(b[p : p + width], 0) + 1
    for i, b in raw:
        hit = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                hit[p : p + width] = b"\1" * width
        spans = sum(1 for p in range(len(hit)) if hit[p] and not (p and hit[p - 1]))
        out.append((i, len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1024, 1])
def test_repeats_are_those_of_all_windows(spark, monkeypatch, hot):
    """hot = 1 takes every anchor through both refinements."""
    monkeypatch.setattr(passages, "HOT", hot)
    rows = documents(2)
    got = passages.cut(frame(spark, rows)).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r._ps_bytes, r._ps_removed, r._ps_spans, r._ps_sha256) for r in got), key=key) == sorted(removed(rows, passages.WIDTH), key=key)
    assert got[0].asDict().keys() >= {"id", "k", "m", "spans", "lang"}
    for r in got:  # the text left, but for characters cut in two
        assert (r.text is None) == (r._ps_bytes == 0 and dict(rows)[r.doc_id] is None)


def test_neighbouring_runs_of_copies_go_together(spark, monkeypatch):
    """What copies have in common is sorted about once, though every 200 bytes of it may have places of their own."""
    rng = random.Random(22)
    text = prose(rng, 9000, 10**6)
    half, other = text[: len(text) // 2], prose(rng, 200, 10**6)
    near = text[:9000] + " changed " + text[9000:]
    rows = [(1, text), (2, text), (3, other + half + " " + other), (4, other + " " + near), (4, None), (None, text[-5000:]), (6, text[100:400] * 2)]
    plain, sizes = passages._detect, []

    def detect(pieces, scratch, level=0):
        sizes.append(pieces.selectExpr("sum(length(piece))").collect()[0][0])
        return plain(pieces, scratch, level)

    monkeypatch.setattr(passages, "_detect", detect)
    got = passages.cut(frame(spark, rows)).collect()
    assert len(text) > 1.5 * passages.CHAIN and sizes[0] < 1.5 * (len(text) + len(other))
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r._ps_bytes, r._ps_removed, r._ps_spans, r._ps_sha256) for r in got), key=key) == sorted(removed(rows, passages.WIDTH), key=key)


def test_repeats_of_nothing(spark):
    assert passages.cut(empty(spark)).count() == 0
    assert passages.cut(frame(spark, [(1, "short"), (2, None)])).selectExpr("sum(_ps_removed)").collect()[0][0] == 0


def test_long_rows_in_segments(monkeypatch):
    monkeypatch.setattr(passages, "SEGMENT", 700)
    rng = random.Random(3)
    import pyarrow as pa

    text = prose(rng, 900)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["id", "k", "t"])
    whole = sorted((p + i) for b in passages._find_runs(iter([batch])) for p, n in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True) for i in range(n))
    assert whole == list(range(len(text) - passages.WIDTH + 1))


def test_repeats_come_through_files_and_recursion(spark, monkeypatch):
    """What cut() finds in shards above the bound of memory: arrays are files, names are sorted by recursion, and no file stays."""
    import os
    import tempfile

    rng = random.Random(21)
    shared = prose(rng, 300, 10**6)
    rows = [(i, prose(rng, 9000, 10**6) + " " + shared + " " + prose(rng, 9000, 10**6)) for i in range(14)]
    import pyarrow as pa

    pieces = sorted((7, i, len(t) - passages.WIDTH + 1, 1, t.encode()) for i, t in rows)
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*pieces, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["m", "ph", "n", "c", "piece"])
    assert sum(len(x[4]) for x in pieces) > 1.5 * passages.MEMORY
    depths, files = [], []
    plain, closed = suffix.suffix_array, suffix.Pool.close

    def sorted_(t, sigma, cap, pool, base=suffix.BASE):
        depths.append(len(t))
        return plain(t, sigma, cap, pool, base)

    def close(pool):
        files.append((pool.files, pool.dir))
        closed(pool)

    monkeypatch.setattr(suffix, "suffix_array", sorted_)
    monkeypatch.setattr(passages, "suffix_array", sorted_)
    monkeypatch.setattr(suffix.Pool, "close", close)
    got = [r for b in passages._search(iter([batch])) for r in b.to_pylist()]
    assert len(depths) >= 2 and depths[0] > depths[1] > suffix.BASE  # names were sorted by the same function
    assert files[0][0] > 20 and files[0][1].startswith(tempfile.gettempdir()) and not os.path.exists(files[0][1])
    spans = {r["ph"]: [(x["s"], x["e"]) for x in r["spans"]] for r in got}
    for i, t in rows:  # the shared words, and what texts may have in common next to them
        (s, e), at = spans[i][0], t.index(shared)
        assert len(spans[i]) == 1 and at - 8 <= s <= at and at + len(shared) <= e <= at + len(shared) + 8
    # and the whole operator agrees with windows counted one by one, with next to nothing in memory
    monkeypatch.undo()
    monkeypatch.setattr(passages, "BATCH", 97)
    text = np.frombuffer(b"".join(x[4] for x in pieces[:2]), np.uint8)[:30000]
    parts = [text[:9000], text[4000:9500], text[9000:20000], text[19000:]]
    size = np.array([len(x) for x in parts])
    few = passages.repeats(np.concatenate(parts), size, np.array([1, 1, 1, 1]), memory=100)
    seen = {}
    for x in parts:
        for p in range(len(x) - 199):
            seen[bytes(x[p : p + 200])] = seen.get(bytes(x[p : p + 200]), 0) + 1
    for k, x in enumerate(parts):
        hit = np.zeros(len(x), bool)
        for p in range(len(x) - 199):
            if seen[bytes(x[p : p + 200])] > 1:
                hit[p : p + 200] = True
        mine = np.zeros(len(x), bool)
        for _, s, e in [z for z in zip(*few, strict=True) if z[0] == k]:
            mine[s:e] = True
        assert (mine == hit).all()


def test_lists_name_all_that_reach_the_threshold():
    """Candidates by prefix and skip merging against counting all coordinates of all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 31, neardup.SIZE)
    sig = np.where(rng.random((300, neardup.SIZE)) < rng.uniform(0.3, 1, (300, 1)), base, rng.integers(0, 1 << 31, (300, neardup.SIZE))).astype(np.int32)
    t = pa.table({"id": np.arange(300), "n": np.full(300, 50), "label": np.arange(300), "text": [""] * 300, "sig": pa.array(list(sig), pa.list_(pa.int32()))})
    b = neardup._Block(t, 4, 80, neardup.needed())
    for a in range(300):
        at, count = b.candidates(a, np.ones(300, bool))
        want = (sig == sig[a]).sum(1)
        want[a] = 0
        assert sorted(at) == list(np.flatnonzero(want >= neardup.needed())) and (count == want[at]).all()


def test_a_large_family_without_links(spark):
    """Ten thousand pages of one template, none within the threshold of another but for planted pairs: each goes to a few tiles, in bounded time."""
    import time

    rng = random.Random(6)
    base = prose(rng, 129, 10**9)
    rows = [(i, f"{base} {prose(rng, 72, 10**9)}") for i in range(10_000)]
    for i in range(0, 10_000, 500):
        rows[i + 499] = (i + 499, rows[i][1].rsplit(" ", 3)[0] + " a b c")
    began = time.time()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert time.time() - began < 240
    assert {r.doc_id: r.component_id for r in got if r.component_id != r.doc_id} == {i + 499: i for i in range(0, 10_000, 500)}


def test_rows_that_repeat_an_id(spark):
    """One id with two texts has the links of both, so what is near either is one group."""
    rng = random.Random(9)
    a, b, c = (prose(rng, 60, 10**6) for _ in range(3))
    near = lambda t: "x " + t
    rows = [(7, a), (7, b), (1, near(a)), (3, near(b)), (9, c), (9, c), (4, near(c)), (5, b), (8, "short"), (8, None), (6, "alone here")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), k=4).collect())
    assert got == [(1, 1, True), (3, 1, False), (4, 4, True), (5, 1, False), (6, 6, True), (7, 1, False), (7, 1, False), (8, 8, True), (8, 8, True), (9, 4, False), (9, 4, False)]

import gzip
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import ann, decontaminate, html, licenses, mixing, warc

from .helpers import documents, empty, frame, prose, words

# --- mixing


def level(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing again and again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_copies(spark, seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([1, 3, 30, 200]))) for i in range(600)] + documents(seed)[24:28] + [(None, "a b"), (5, "a b c")]
    docs = frame(spark, rows, ["big"] * 9 + ["small", None, "tiny"])
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and mixing.mix(docs).columns == [*docs.columns, "size", "source_size", "target", "copies"]
    sizes = {}
    for r in got:
        assert r["size"] == len(words(r.text))
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = level(sizes)
    for s, n in sizes.items():
        own = [r for r in got if r.source == s]
        taken = sum(r["size"] * r.copies for r in own)
        assert all(r.source_size == n and math.isclose(r.target, want[s]) and 0 <= r.copies <= 3 for r in own)
        assert abs(taken - want[s]) <= 4 * max(r["size"] for r in own)
    key = lambda rs: sorted((repr(r.doc_id), r["size"], r.copies) for r in rs)
    assert key(mixing.mix(docs.repartition(7)).collect()) == key(got)
    assert mixing.emit(mixing.mix(docs)).count() == sum(r.copies for r in got)


def test_mixing_of_nothing(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert [r.copies for r in mixing.mix(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]


# --- pages


def test_generated_pages_are_told_apart():
    w = html.weights()
    wrong = total = 0
    for page, labels in html.generated(80, seed=77):
        bs = html.blocks(page)
        assert len(bs) == len(labels)
        wrong += sum(a != b for a, b in zip(html.label(bs, w), labels, strict=True))
        total += len(labels)
    assert wrong <= total * 0.01


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>T</h1><p>a &amp; b<br>c&#233;<p>d</article>", "T a & b cé d"),
        ("<nav><a href=x>m</a></nav><article><p>One two three. </p><aside>no</aside><script>var a='<p>x</p>';</script><p>Four.</p></article><footer>f</footer>", "One two three. Four."),
        ("<article><p>x <b>bold<i>er</p><!-- <p>no</p> --><p>y < z</p></article>", "x bolder y < z"),
        ("<article><p>one</p><div class=\"comments\"><p>Nice text indeed.</p></div><form><label>n</label></form></article>", "one"),
        ("<head><title>t</title><style>p{}</style></head><body><main><p>kept\n\t text</p></main></body>", "kept text"),
        ("<article><p>unclosed", "unclosed"),
        ("<article><p>a</p><script>never closed", "a"),
        ("", ""), (None, ""), ("<<<>>", None), ("<p", None), ("&nbsp;", ""),
    ],
)
def test_main_text(page, text):
    got = html.main_text(page, html.weights())
    assert text is None or got == text


def test_extract(spark):
    rows = [(1, "u", "<article><p>a</p></article>"), (1, "u", "<article><p>a</p></article>"), (None, None, None), (2, "v", "<article><p>" + "w " * 50000 + "</p></article>")]
    got = html.extract(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted(((r.page_id, r.url, len(r.text)) for r in got), key=repr) == sorted([(1, "u", 1), (1, "u", 1), (None, None, 0), (2, "v", 99999)], key=repr)


def test_min_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 7)
        s, t = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(html.min_cut(s, t, edges)), best)


# --- archives


@pytest.fixture
def pages(spark):
    rng = random.Random(2)
    body = [prose(rng, 60) for _ in range(20)]
    rows = [(i, f"http://h/{i}", body[i % 20]) for i in range(60)] + [(70, None, None), (71, "http://x\r\nWARC-Type: warcinfo", ""), (72, "u", "short"), (73, "u", "short"), (None, "n", body[0]), (74, "é", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1 é" * 9), (75, "u", prose(rng, 40000))]
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, first string"), rows


@pytest.mark.parametrize("split", ["100000000", "3000", "90"])
def test_archives_round_trip(spark, pages, tmp_path, split):
    df, rows = pages
    warc.write_warc(warc.to_records(df), str(tmp_path / "a"))
    back = warc.read_warc(spark, str(tmp_path / "a"), payload="all", split=split).collect()
    assert len(back) == len(rows)
    raw = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    for r in back:
        b = raw[r.page_id]
        again = len(b) >= 100 and first[b.decode()] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[b.decode()]) if again else ("response", None))
        assert r.payload_bytes == len(b) and (again or bytes(r.payload) == b)
    assert len({r.offset for r in back if r.file == back[0].file}) == sum(r.file == back[0].file for r in back)


def test_plain_archives_and_pushdown(spark, pages, tmp_path):
    df, rows = pages
    out = tmp_path / "x.warc"
    out.write_bytes(b"".join(warc.record(r.asDict() | {"payload": bytes(r.payload)}) for r in warc.to_records(df).collect()))
    for split in ("100000000", "2500", "77"):
        got = warc.read_warc(spark, str(out), split=split)
        assert got.count() == len(rows)
        some = got.where("record_type = 'revisit' and page_id in (40, 41) and target_uri like 'http://h/4%'")
        assert sorted(r.page_id for r in some.collect()) == [40, 41]
    reader = warc.WarcReader({"path": str(out)})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 3), warc.In(("page_id",), (1, 2))]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    assert warc.read_warc(spark, str(out), payload="none", types="response").where("payload is not null").count() == 0


def test_foreign_and_damaged_archives(spark, pages, tmp_path):
    df, rows = pages
    made = [warc.record(r.asDict() | {"payload": bytes(r.payload)}) for r in warc.to_records(df).collect()]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in made))  # no skip lengths
    assert warc.read_warc(spark, str(tmp_path / "f.warc.gz"), split="2000").count() == len(rows)
    (tmp_path / "g.warc").write_bytes(b"".join(made[:3]) + made[3][:80])
    assert warc.read_warc(spark, str(tmp_path / "g.warc")).count() == 3
    (tmp_path / "none").mkdir()
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


# --- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[300:420] = x[299]  # a very common vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (None, rows[3][1]), (1080, [None] * 16), (1100, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd + rows[:5]], "vec_id long, embedding array<float>, id int")
    got = {}
    for r in ann.neighbours(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 20))
    d, hit = x.astype(np.float64), 0
    for q, rs in got.items():
        s = d @ d[q]
        rs.sort()
        assert [r for r, _, _ in rs] == list(range(1, 21)) and all(math.isclose(v, s[i], rel_tol=1e-12) for _, i, v in rs)
        assert [(-v, i) for _, i, v in rs] == sorted((-v, i) for _, i, v in rs) and q not in [i for _, i, _ in rs]
        best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        hit += len(set(best) & {i for _, i, _ in rs})
    assert hit / (20 * len(got)) >= 0.95
    few = ann.neighbours(df.where("vec_id < 4"), F.col("id") % 2 == 0).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (0, 3), (2, 1), (2, 2), (2, 3)]
    assert ann.neighbours(df.where("false"), F.col("id") % 2 == 0).count() == 0


def test_anisotropic_loss_falls():
    x = np.random.default_rng(1).normal(size=(600, 12)).astype(np.float32)
    book = ann.fit(x, rounds=3)
    plain = ann.fit(x, rounds=0)

    def loss(b):
        codes = b.encode(x)
        r = x - np.concatenate([b.centroids[m][codes[:, m]] for m in range(len(b.centroids))], axis=1)[:, :12]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return float((r**2).sum() + (b.eta - 1) * ((r * u).sum(1) ** 2).sum())

    assert loss(book) < loss(plain)


# --- benchmark items


def test_contamination(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, 25, 3000) + ". The answer is " + prose(rng, 4, 3000)) for i in range(20)] + [(90, None), (91, "")]
    rows = []
    for i in range(150):
        w = prose(rng, rng.randrange(80, 400), 3000).split()
        rows.append((i, " ".join(w)))
    planted = {}
    for i, k in ((3, 0), (10, 5), (77, 5), (149, 19)):
        w = rows[i][1].split()
        at = rng.randrange(len(w))
        rows[i] = (i, " ".join(w[:at] + items[k][1].split() + w[at:]))
        planted[i] = k
    w = items[7][1].split()
    for n in range(0, 16, 3):  # a paraphrase: some words replaced, the answer kept
        w[n] = f"other{n}"
    rows[50] = (50, prose(rng, 60, 3000) + " " + " ".join(w) + " " + prose(rng, 60, 3000))
    planted[50] = 7
    rows += documents(3)[24:34] + [rows[3]]
    docs = frame(spark, [(i if n < 150 else (None if i is None else i + 1000), t) for n, (i, t) in enumerate(rows)])
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, id int")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(planted.items()) | {(1003, 0)}
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len(planted) - 1
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0 and decontaminate.clean(docs, bench.where("item_id > 80")).count() == len(rows)


def test_contamination_of_frequent_items(spark):
    """An item that a third of all documents hold, among rare words of other items."""
    rng = random.Random(12)
    items = [(i, prose(rng, 30, 10**6)) for i in range(40)]
    others = " ".join(t for i, t in items if i).split()
    rows = []
    for i in range(150):
        w = [rng.choice(others) if rng.random() < 0.7 else f"x{rng.randrange(9999)}" for _ in range(rng.randrange(64, 200))]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = items[0][1].split()
        rows.append((i, " ".join(w)))
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in got if r.item_id == 0} == set(range(0, 150, 3))


def test_contamination_is_that_of_all_passages(spark):
    """Against the check of every item about every passage, on words so few that many pairs are near its bounds."""
    rng = random.Random(13)
    items = [(i, prose(rng, rng.choice([3, 8, 20, 70]), 60)) for i in range(12)]
    rows = [(i, prose(rng, rng.randrange(1, 300), 60)) for i in range(40)]
    want = set()
    for i, t in rows:
        h = decontaminate.hashes(pa.array([t]))[0]
        for n, x in items:
            w = decontaminate.hashes(pa.array([x]))[0]
            for at in range(0, len(h), 32):
                region = h[max(0, at - len(w)) : at + 64 + len(w)]
                share = decontaminate.lcs(w, region) / len(w)
                if share >= 0.7 or (share >= 0.6 and np.isin(w, region).mean() >= 0.8):  # without a full stop all is answer
                    want.add((i, n))
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and 0 < len(want) < len(rows) * len(items)


def test_passages_needed_share_enough_words():
    """What goes on to the last check: all passages it can report, and none that shares fewer words than it asks for; in one go or few places at a time."""
    rng = random.Random(15)
    words = decontaminate.hashes(pa.array([prose(rng, rng.choice([3, 8, 20, 70]), 60) for _ in range(12)] + [""]))
    texts = decontaminate.hashes(pa.array([prose(rng, rng.randrange(0, 300), 60) for _ in range(40)]))
    every = decontaminate.Vocabulary(np.unique(np.concatenate(words)))
    needed = decontaminate.Needed(every, np.zeros(len(every.words), np.int64), words)
    found, allowed = set(), set()
    for i, h in enumerate(texts):
        for n, w in enumerate(words):
            for win in range(-(-len(h) // 32) if len(w) else 0):
                region = h[max(0, win * 32 - len(w)) : win * 32 + 64 + len(w)]
                if decontaminate.lcs(w, region) / len(w) >= 0.6:
                    found.add((i, n, win))
                if sum((Counter(w.tolist()) & Counter(region.tolist())).values()) / len(w) >= 0.6:
                    allowed.add((i, n, win))
    h, of = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    got = list(zip(*(x.tolist() for x in needed.passages(h, of)), strict=True))
    assert found < set(got) <= allowed and len(got) == len(set(got))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontaminate, "PLACES", 50)
        assert list(zip(*(x.tolist() for x in needed.passages(h, of)), strict=True)) == got


def test_sums_of_rows():
    rng = np.random.default_rng(16)
    for longest in (1, 5, 64, 65, 300):
        n = np.append(rng.integers(1, longest + 1, 40), longest)
        bound = np.concatenate(([0], np.cumsum(n)))
        col, v, x = rng.integers(0, 9, bound[-1]), rng.normal(size=bound[-1]), rng.normal(size=(9, 3))
        assert np.allclose(decontaminate._sums(bound, col, v, x), [v[a:b] @ x[col[a:b]] for a, b in zip(bound[:-1], bound[1:], strict=True)])
    assert decontaminate._sums(np.zeros(1, np.int64), col[:0], v[:0], x).shape == (0, 3)


def test_contamination_of_long_items(spark):
    """Copies of items of many windows have a window's cosine, in one block or several."""
    rng = random.Random(14)
    items = [(i, " ".join(f"w{i}x{x}" for x in range(n))) for i, n in enumerate((40, 64, 65, 500, 9000))]
    rows = [(i, prose(rng, 70) + " " + t + " " + prose(rng, 70)) for i, t in items] + [(9, prose(rng, 900))]
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in items}
    assert all(r.cosine > 0.8 and r.lcs == 1 for r in got)


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]


# --- licenses


def test_licenses(spark):
    prose_ = "Some words about nothing in particular. And more of them"
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/x.py", prose_), ("a/b/y.py", prose_ + ".\n# Licensed under the Apache License, Version 2.0.\n" + prose_), ("a/b/z.py", prose_), ("a/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("a/c/d/e.py", None), ("q/x.py", "We discuss a license here with many other words that have nothing to do with it at all"), (None, prose_), ("a/c/d/e.py", None), ("top.py", "")]
    df = spark.createDataFrame([(i, p, t, "z") for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.license, r.origin, r.inherited_from) for r in licenses.scan(df, F.col("path"), F.col("path").endswith("LICENSE")).collect()}
    mit, gpl = ("MIT", "inherited", "a"), ("GPL-3.0", "inherited", "a/c")
    assert got == {0: ("MIT", "own", None), 1: mit, 2: ("Apache-2.0", "own", None), 3: mit, 4: ("GPL-3.0", "own", None), 5: gpl, 6: (None, "none", None), 7: (None, "none", None), 8: gpl, 9: (None, "none", None)}
    assert licenses.scan(df.where("false"), F.col("path"), F.lit(False)).count() == 0


_APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.
"""
_GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble
"""


def test_license_files_tags_and_rows_without_ids(spark):
    """Whole licence files, openings of long ones, SPDX tags of known and unknown licenses, null and repeated ids."""
    whole = dict((n, t) for n, t in licenses.TEMPLATES if len(t) > 400)
    prose_ = "Some words about nothing in particular."
    rows = [
        (1, "a/LICENSE", "Copyright (c) 2020 Some Holder\n\n" + whole["MIT"], "MIT"),
        (2, "b/LICENSE", "Copyright 2020 Holder.\n" + whole["BSD-2-Clause"], "BSD-2-Clause"),
        (3, "c/LICENSE", "Copyright 2020 Holder.\n" + whole["BSD-3-Clause"], "BSD-3-Clause"),
        (4, "d/LICENSE", "Copyright (c) 2021, Holder\n\n" + whole["ISC"], "ISC"),
        (5, "e/LICENSE", _APACHE + prose_ * 50, "Apache-2.0"), (6, "f/COPYING", _GPL + prose_ * 50, "GPL-3.0"),
        (7, "g/x.c", "/* SPDX-License-Identifier: MIT */\nint main;", "MIT"), (8, "g/y.c", "// SPDX-License-Identifier: Apache-2.0\n" + prose_, "Apache-2.0"), (9, "g/z.c", "# SPDX-License-Identifier: Foo-1.3\n", "Foo-1.3"),
        (None, "h/LICENSE", "Released under the MIT License.", "MIT"), (None, "i/LICENSE", "Licensed under CC BY 4.0.", "CC-BY-4.0"), (None, "h/a.py", prose_, "MIT"),
        (10, "j/LICENSE", "Licensed under the Apache License, Version 2.0.", "Apache-2.0"), (10, "k/LICENSE", "This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), (10, "k/b.py", None, "GPL-2.0"),
        (11, "l/long.txt", prose_ + " " + prose(random.Random(1), 30_000) + "\nReleased under the MIT License.\n" + prose(random.Random(2), 30_000), "MIT"), (12, "m/none.txt", prose_, None),
    ]
    df = spark.createDataFrame([(i, p, t, p) for i, p, t, _ in rows], "doc_id long, path string, text string, _row string")
    got = licenses.scan(df, F.col("path"), F.col("path").rlike("LICENSE|COPYING")).collect()
    assert sorted((r.path, r.license) for r in got) == sorted((p, want) for _, p, _, want in rows)
    assert all((r.doc_id, r.path) in {(i, p) for i, p, _, _ in rows} for r in got)
    more = licenses.scan(df.limit(1), F.col("path"), F.lit(True), templates=(("Own-1", "a wholly different licence text of our own"),)).collect()
    assert more[0].license is None


def test_contamination_in_several_blocks(spark, monkeypatch):
    """Blocks of few windows and chunks of little text find what one block finds: every planted copy, of items of 5 to 2,000 words."""
    rng = random.Random(17)
    items = [(i, prose(rng, n, 10**6)) for i, n in enumerate((5, 8, 30, 64, 100, 200, 300, 400, 500, 600, 1000, 2000))]
    rows = [(i, prose(rng, 90, 10**6) + " " + t + " " + prose(rng, 90, 10**6)) for i, t in items] + [(100 + i, prose(rng, 200, 10**6)) for i in range(20)]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i) for i, _ in items}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK", 40)
    monkeypatch.setattr(decontaminate, "CHUNK_CHARS", 30_000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want


def test_recall_of_the_cosine_search(spark, monkeypatch):
    """Passages found by cosine alone, against the cosines of all passages and items computed plainly."""
    rng = random.Random(18)
    items = [(i, prose(rng, rng.randrange(20, 60), 800)) for i in range(30)]
    rows = []
    for i in range(120):
        w = prose(rng, rng.randrange(30, 150), 800).split()
        t = dict(items)[i % 30].split()
        rows.append((i, " ".join(w[: len(w) // 2] + t[: rng.randrange(len(t))] + w[len(w) // 2 :])))
    items.sort(key=lambda x: str(x[0]))  # the operator's own order
    words_ = decontaminate.hashes(pa.array([t for _, t in items]))
    texts = decontaminate.hashes(pa.array([t for _, t in rows]))
    names = np.unique(np.concatenate(words_))
    df = np.array([sum(w in set(t.tolist()) for t in texts) for w in names.tolist()])
    monkeypatch.setattr(decontaminate, "COMMON", 1.0)
    idf = np.log((len(rows) + 1) / (df + 1)) + 1e-3
    row = lambda h: np.bincount(np.searchsorted(names, h[np.isin(h, names)]), minlength=len(names)) * idf
    unit = lambda x: x / max(float(np.sqrt((x * x).sum())), 1e-30)
    q = np.stack([unit(row(w)) for w in words_])
    want = {(i, n) for i, h in enumerate(texts) for at in range(0, len(h), 32) for n in np.flatnonzero(q @ unit(row(h[at : at + 64])) >= decontaminate.COSINE + 0.02)}
    seen = {}
    plain_ = decontaminate._search
    monkeypatch.setattr(decontaminate, "_search", lambda *a: seen.setdefault("found", plain_(*a)))
    decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.id, r.n) for r in seen["found"].where(F.col("cosine") >= decontaminate.COSINE).collect()}
    assert len(want) > 40 and len(want & found) >= 0.98 * len(want)


def test_records_of_repeated_and_unnamed_rows(spark, tmp_path):
    """Each row has a record of its own, and of equal payloads one is the response: rows that repeat an id, and rows without one."""
    body, other, third = ("x" * n for n in (150, 160, 170))
    rows = [(5, body), (5, body), (7, body), (None, body), (None, other), (None, other), (9, third), (1, "s"), (1, "s"), (None, None), (None, None)]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    warc.write_warc(warc.to_records(df), str(tmp_path / "a"))
    back = warc.read_warc(spark, str(tmp_path / "a"), payload="all").collect()
    assert len(back) == len(rows) == len({r.record_id for r in back})
    kinds = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in back), key=repr)
    assert kinds == sorted([(5, 150, "response", None), (5, 150, "revisit", 5), (7, 150, "revisit", 5), (None, 150, "revisit", 5), (None, 160, "response", None), (None, 160, "revisit", None), (9, 170, "response", None), (1, 1, "response", None), (1, 1, "response", None), (None, 0, "response", None), (None, 0, "response", None)], key=repr)
    ids = {r.record_id: r for r in back}
    assert all(ids[r.refers_to_record].record_type == "response" and ids[r.refers_to_record].payload_digest == r.payload_digest for r in back if r.record_type == "revisit")


def test_mixing_of_rows_without_ids(spark):
    """Rows without an id are spread over cells by their text, and the mix keeps to its targets and repeats itself."""
    rng = random.Random(3)
    docs = frame(spark, [(None, prose(rng, rng.randrange(20, 60))) for _ in range(800)] + [(None, "a b c")] * 50, ["s1", "s2"])
    got = mixing.mix(docs)
    cells = docs.select(*mixing._cell(F.lit(3), F.lit(None).cast("long"), F.col("text"))).distinct().count()
    assert cells > 200 and got.count() == 850
    one = got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.max("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 250 for r in one)
    again = mixing.mix(docs.repartition(5), columns=["text"])
    assert sorted(r.copies for r in again.collect()) == sorted(r.copies for r in got.collect())


def test_neighbours_over_blocks(spark, monkeypatch):
    """Several blocks of rows and of queries, a thirtieth of each reranked: against brute force, and scores exact to the bit."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 1500)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 70)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 32))
    x = (centre[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    ix = ann.index(df, ids=11)
    got = {}
    for r in ann.search(ix, ix.vectors.where("id % 30 = 0"), 10, rerank=50).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    d, hit = x.astype(np.float64), 0
    assert set(got) == set(range(0, 6000, 30))
    for q, rs in got.items():
        s = (d * d[q]).sum(1)
        assert sorted(rs) == list(range(1, 11)) and all(v == s[i] for i, v in rs.values())
        s[q] = -np.inf
        best = np.lexsort((np.arange(6000), -s))[:10]
        hit += len(set(best.tolist()) & {i for i, _ in rs.values()})
    assert hit >= 0.9 * 10 * len(got)
    every = ann.search(ix, ix.vectors.where("id = 30"), 10, rerank=6000).collect()
    s = (d * d[30]).sum(1)
    s[30] = -np.inf
    assert [r.vec_id for r in sorted(every, key=lambda r: r["rank"])] == np.lexsort((np.arange(6000), -s))[:10].tolist()

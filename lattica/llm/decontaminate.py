"""Benchmark decontamination by latent semantic retrieval.

1. The vocabulary is that of the benchmark's words; document frequencies are counted over all documents, and
   words in more than COMMON of them weigh nothing (each item keeps its RAREST words at least).
2. Documents become passages: windows of WINDOW words, half overlapping, as sparse TF-IDF rows.
3. A randomised SVD runs over all passages: each task multiplies its rows by a block of random, then
   orthonormal, columns and back (A^T A Q), rows of the product are summed by word, and the driver factors the
   sum. Items are taken BLOCK windows at a time, over those windows' words, so the driver holds BLOCK * WINDOW words
   times BLOCK + EXTRA numbers at most, whatever the benchmark. The benchmark's own rows take part with half of the total
   weight, so no item drops out of the latent space, whose rank is at least a block's number of items.
4. Items become passages too: one of all words up to WINDOW, windows like the documents' above. Those and the
   documents' passages are compared by cosine there, in blocks; pairs at COSINE or above are candidates.
   So is every passage about which enough of an item's rarest words stand, however often the item leaks: what
   step 5 reports shares PARAPHRASE of the item's words, so only the other words of those can be missing. An
   item keeps as many of its rarest words for this as leave LEAST or a SHARE of its words to be found. Those passages
   are then counted out where the text is at hand: words about one that are the item's, whatever their order, bound
   the common subsequence of step 5 from above, so what falls short of PARAPHRASE goes no further.
5. Candidates are checked on all words: the longest common subsequence of the item and the words about the
   passage covers VERBATIM of the item, or PARAPHRASE of it while ANSWER of the words of the item's answer (its
   last sentence) occur there too.

Texts are read for CHUNK items (or CHUNK_CHARS of their text) at a time, so what the driver holds and sends is
bounded for any benchmark but for a single item's text; each block of windows is searched before the next.

Edge cases: null or empty texts have no passage; a passage without weighted words has a cosine of 0; an item of
a few words is found wherever PARAPHRASE of them stand in order about a passage, as step 5 says; items that are null or without words match nothing; rows that
repeat an id and text are reported once; a null id is an id like any other; equal items are all reported; an
empty table on either side gives an empty result. Only ids and texts are read; clean() passes other columns
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, env_threads, partitions
from .textvec import NOT_ALNUM, U, Words, buffers, mix, slices

WINDOW, COMMON, RAREST = 64, 0.02, 4
CHUNK, CHUNK_CHARS, BLOCK, EXTRA = 8192, 32 << 20, 256, 8
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.4, 0.7, 0.6, 0.8
LEAST, SHARE = 4, 8
_BITS = 20
#: Words about passages that are compared with items' words at a time; entries of a row that are added up before others.
PLACES, PIECE = 1 << 18, 64


def hashes(texts: pa.Array) -> list[np.ndarray]:
    data, off = buffers(texts)
    out = []
    for i, j in slices(off):
        w = Words(data, off, i, j, space=NOT_ALNUM)
        out += [w.hash[a:b] for a, b in zip(w.of[:-1], w.of[1:], strict=True)]
    return out


class Vocabulary:
    """Sorted word hashes, found by way of a table of their low bits."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.some = np.zeros(1 << _BITS, bool)
        self.some[words & U((1 << _BITS) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in h words of the vocabulary stand, and which."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.some[h & U((1 << _BITS) - 1)])
        k = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        ok = self.words[k] == h[at]
        return at[ok], k[ok]


class Needed:
    """For each item its rarest words, and how many of their places at least stand about any passage that step 5 can report.

    Also all words of all items with their numbers, a hash for each pair of item and word; pairs that share one only let more pass.
    """

    def __init__(self, every: Vocabulary, df: np.ndarray, words: list[np.ndarray]):
        self.reach = np.array([-(-len(w) // (WINDOW // 2)) for w in words], np.int64)  # halves of a window by which the words about it exceed it
        self.least = np.ones(len(words), np.int64)
        items, own = [], []
        for n, w in enumerate(words):
            if not len(w):
                continue
            u, count = np.unique(np.searchsorted(every.words, w), return_counts=True)
            o = np.argsort(df[u], kind="stable")
            total = np.cumsum(count[o])
            spare = len(w) - int(np.ceil(PARAPHRASE * len(w) - 1e-9))  # words of the item that may be missing
            take = min(len(o), 1 + int(np.searchsorted(total, spare + max(LEAST, len(w) // SHARE))))
            self.least[n] = total[take - 1] - spare
            items.append(np.full(take, n))
            own.append(u[o[:take]])
        item, word = np.concatenate(items), np.concatenate(own)
        used, word = np.unique(word, return_inverse=True)
        o = np.argsort(word, kind="stable")
        self.vocabulary = Vocabulary(every.words[used])
        self.item, self.bound = item[o], np.searchsorted(word[o], np.arange(len(used) + 1))
        self.size = np.array([len(w) for w in words], np.int64)
        self.salt = mix(np.arange(1, len(words) + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
        pairs, self.times = np.unique(np.concatenate([w + self.salt[n] for n, w in enumerate(words)]), return_counts=True)
        self.pairs = Vocabulary(pairs)

    def share(self, h: np.ndarray, of: np.ndarray, doc: np.ndarray, item: np.ndarray, win: np.ndarray) -> np.ndarray:
        """What share of the item's words the words about each passage hold, in any order, equal ones as often as both have them; 0 where it is under PARAPHRASE."""
        at, size = win * (WINDOW // 2), self.size[item]
        lo = of[doc] + np.maximum(0, at - size)
        n = np.minimum(of[doc + 1], of[doc] + at + WINDOW + size) - lo
        out = np.zeros(len(doc))
        bound = np.concatenate(([0], np.cumsum(n)))
        for i, j in slices(bound, PLACES):
            of_row = np.repeat(np.arange(j - i), n[i:j])
            x = h[np.arange(bound[j] - bound[i]) + np.repeat(lo[i:j] - bound[i:j] + bound[i], n[i:j])]
            x += np.repeat(self.salt[item[i:j]], n[i:j])
            hit, pair = self.pairs.find(x)
            row = of_row[hit]
            enough = np.bincount(row, minlength=j - i) / size[i:j] >= PARAPHRASE  # a first bound, without a sort
            some = enough[row]
            key, count = np.unique(row[some] * len(self.times) + pair[some], return_counts=True)
            both = np.minimum(count, self.times[key % len(self.times)])
            got = np.bincount(key // len(self.times), both, minlength=j - i) / size[i:j]
            out[i:j] = np.where(got >= PARAPHRASE, got, 0)
        return out

    def passages(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of documents with words h[of[r]:of[r + 1]]: document, item and number of each passage about which enough words stand, in order.

        Enough are so many of the rarest words that step 5 could report it, and so many of all words.
        """
        at, k = self.vocabulary.find(h)
        many = np.diff(self.bound)[k]
        item = self.item[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - self.bound[k], many)]
        at = np.repeat(at, many)
        doc = np.searchsorted(of, at, side="right") - 1
        o = np.lexsort((at, item, doc))
        at, item, doc = at[o], item[o], doc[o]
        half = (at - of[doc]) // (WINDOW // 2)
        last = np.arange(len(at)) + self.least[item] - 1  # the fewest places that are enough: from here to there
        ok = last < len(at)
        i, j = np.flatnonzero(ok), last[ok]
        ok = (doc[i] == doc[j]) & (item[i] == item[j]) & (half[j] - half[i] <= 2 * self.reach[item[i]] + 1)
        i, j = i[ok], j[ok]
        if not len(i):
            return i, i, i
        lo = np.maximum(0, half[j] - 1 - self.reach[item[i]])
        hi = np.minimum(half[i] + self.reach[item[i]], (of[doc[i] + 1] - of[doc[i]] - 1) // (WINDOW // 2))
        # passages of one document and item are given once: ranges begin where the last ended, as both ends rise
        same = np.concatenate(([False], (doc[i][1:] == doc[i][:-1]) & (item[i][1:] == item[i][:-1])))
        lo[same] = np.maximum(lo[same], hi[np.flatnonzero(same) - 1] + 1)
        n = np.maximum(0, hi - lo + 1)
        doc, item, win = np.repeat(doc[i], n), np.repeat(item[i], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        ok = self.share(h, of, doc, item, win) > 0
        return doc[ok], item[ok], win[ok]


def _postings(docs: DataFrame, vocabulary: Vocabulary, needed: Needed) -> DataFrame:
    """id, k, for the document's words of the vocabulary their positions and numbers, and items and numbers of the passages about which enough words stand."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        v, needed = sent.value
        for b in batches:
            data, off = buffers(b.column(2))
            for i, j in slices(off):
                w = Words(data, off, i, j, space=NOT_ALNUM)
                at, k = v.find(w.hash)
                bound = np.searchsorted(at, w.of)
                doc, item, win = needed.passages(w.hash, w.of)
                near = np.searchsorted(doc, np.arange(j - i + 1))
                rows = np.flatnonzero(np.diff(bound) + np.diff(near))
                if not len(rows):
                    continue
                p = (at - np.repeat(w.of[:-1], np.diff(bound))).astype(np.int32)
                r = pa.array(rows + i)
                lists = []
                for edge, values in ((bound, (p, k)), (near, (item, win))):
                    ends = pa.array(np.append(edge[:-1][rows], len(values[0])).astype(np.int32))
                    lists += [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in values]
                yield pa.RecordBatch.from_arrays([b.column(0).take(r), b.column(1).take(r), *lists], ["id", "k", "p", "w", "item", "win"])

    return docs.mapInArrow(run, "id long, k long, p array<int>, w array<int>, item array<int>, win array<int>")


def _frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Documents with each word of the vocabulary, and documents in all."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        v = sent.value
        df, n = np.zeros(len(v.words), np.int64), 0
        for b in batches:
            n += b.num_rows
            data, off = buffers(b.column(0))
            for i, j in slices(off):
                w = Words(data, off, i, j, space=NOT_ALNUM)
                at, k = v.find(w.hash)
                row = np.searchsorted(w.of, at, side="right") - 1
                once = np.unique(row * len(v.words) + k)
                df += np.bincount(once % max(1, len(v.words)), minlength=len(df))[: len(df)]
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1), pa.int32()), pa.array(np.append(df[has], n), pa.int64())], ["w", "n"])

    got = docs.select("t").mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # a row for each benchmark word at most
    df = np.zeros(len(vocabulary.words), np.int64)
    n = 0
    for r in got:
        if r["w"] < 0:
            n = r["n"]
        else:
            df[r["w"]] = r["n"]
    return df, n


def passages(p: pa.ListArray, w: pa.ListArray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows with any weight, of all rows at once: row and number of each, bounds in entries, columns, and unit-length values."""
    half = WINDOW // 2
    n = np.diff(p.offsets.to_numpy()).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    lo, hi = int(p.offsets[0].as_py()) if len(n) else 0, int(p.offsets[-1].as_py()) if len(n) else 0
    win = p.values.to_numpy()[lo:hi].astype(np.int64) // half
    col = w.values.to_numpy()[lo:hi].astype(np.int64)
    back = np.flatnonzero(win > 0)  # a word stands in the window that begins in its half, and in the one before
    doc, col, win = np.concatenate((doc, doc[back])), np.concatenate((col, col[back])), np.concatenate((win, win[back] - 1))
    order = np.lexsort((col, win, doc))
    doc, col, win = doc[order], col[order], win[order]
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(1, np.int64), z, np.zeros(0)
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (win[1:] != win[:-1])))
    word = np.flatnonzero(fresh | np.concatenate(([True], col[1:] != col[:-1])))
    count = np.diff(np.append(word, len(doc)))  # equal words of a window add up before its length is taken
    v = weight[col[word]] * count
    first = np.flatnonzero(fresh[word])
    bound = np.append(first, len(word))
    size = np.sqrt(np.add.reduceat(v * v, first))
    return doc[word][first], win[word][first], bound, col[word], v / np.maximum(np.repeat(size, np.diff(bound)), 1e-30)


def _rows(b: pa.RecordBatch, weight: np.ndarray, local: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Passages of a batch of postings, some documents at a time, as bounds, columns and values: of unit length over all words, then cut to those that `local` numbers."""
    for at in range(0, b.num_rows, 2000):
        part = b.slice(at, 2000)
        _, _, bound, col, v = passages(part.column(2), part.column(3), weight)
        yield _cut(bound, local[col], v)[1:]


def _cut(bound: np.ndarray, col: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which passages have a column that is not -1, and bounds, columns and values of those."""
    keep = col >= 0
    n = np.add.reduceat(keep.astype(np.int64), bound[:-1]) if len(col) else np.zeros(0, np.int64)
    return np.flatnonzero(n), np.concatenate(([0], np.cumsum(n[n > 0]))), col[keep], v[keep]


def _sums(bound: np.ndarray, col: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row the sum of v times x[col] over its entries bound[r]..bound[r + 1], of which it has some: first entries of all rows at once, then second ones."""
    pieces = -(-np.diff(bound) // PIECE)
    begin = np.cumsum(pieces) - pieces
    start = np.repeat(bound[:-1] - begin * PIECE, pieces) + np.arange(pieces.sum()) * PIECE
    size = np.minimum(np.repeat(bound[1:], pieces) - start, PIECE)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    sums = np.zeros((len(size), x.shape[1]), x.dtype)
    for k, m in enumerate(np.searchsorted(-size, -np.arange(size[0] if len(size) else 0)).tolist()):
        part = x[col[start[:m] + k]]
        part *= v[start[:m] + k, None]
        sums[:m] += part
    out = np.empty_like(sums)
    out[order] = sums
    return out if len(out) == len(pieces) else np.add.reduceat(out, begin, axis=0)


def _normal(postings: DataFrame, weight: np.ndarray, local: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """A^T A q over all passages, and how many they are: tasks give rows by word, which are summed by word before they reach the driver."""
    sc = postings.sparkSession.sparkContext
    sent = sc.broadcast((weight, local, q.astype(np.float32)))
    wide = q.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        weight, local, q = sent.value
        out = np.zeros(q.shape, np.float32)
        rows, alone = 0, np.zeros(len(q), np.float64)
        for b in batches:
            for bound, col, v in _rows(b, weight, local):
                n = np.diff(bound)
                if not len(n):
                    continue
                rows += len(n)
                one = bound[:-1][n == 1]
                alone += np.bincount(col[one], v[one] ** 2, minlength=len(alone))  # one word: the product is its own row
                more = np.repeat(n > 1, n)
                n, col, v = n[n > 1], col[more], v[more].astype(np.float32)
                if not len(n):
                    continue
                z = _sums(np.concatenate(([0], np.cumsum(n))), col, v, q)
                o = np.argsort(col, kind="stable")
                c = col[o]
                first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                row = np.repeat(np.arange(len(n)), n)[o]
                out[c[first]] += _sums(np.append(first, len(c)), row, v[o], z)
        out += (alone[:, None] * q).astype(np.float32)
        has = np.flatnonzero(np.abs(out).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1), pa.int32()), pa.array([*(out[c].tobytes() for c in has), np.float64(rows).tobytes()], pa.binary())], ["w", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, np.float64 if c < 0 else np.float32).astype(np.float64)
                sums[c] = sums[c] + x if c in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["w", "v"])

    got = postings.mapInArrow(multiply, "w int, v binary").repartition(partitions(postings.sparkSession), "w").mapInArrow(add, "w int, v binary").collect()
    out, rows = np.zeros((len(q), wide)), 0.0
    for r in got:
        if r["w"] < 0:
            rows = float(np.frombuffer(r["v"])[0])
        else:
            out[r["w"]] = np.frombuffer(r["v"])
    return out, rows


def latent(postings: DataFrame, weight: np.ndarray, local: np.ndarray, items: np.ndarray, seed: int = 5) -> np.ndarray:
    """Right singular vectors (words of the items, rank) of all passages with the items (unit rows) as half of the weight. local: the items' number of each word, or -1."""
    rank = min(items.shape[1], len(items) + EXTRA)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(items.shape[1], rank)))[0]
    y = None
    for _ in range(2):  # one power iteration
        y, rows = _normal(postings, weight, local, q)
        own = items.T @ (items @ q)
        y += own * max(1.0, rows / max(1, len(items)))
        last, q = q, np.linalg.qr(y)[0]
    b = last.T @ y
    values, u = np.linalg.eigh((b + b.T) / 2)
    return last @ u[:, np.argsort(-values)]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of `a` at a time in one large integer."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = at.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _windows(words: np.ndarray) -> list[np.ndarray]:
    """All words up to WINDOW as one; else windows of WINDOW words, half overlapping, to the last word."""
    half = WINDOW // 2
    return [words[at : at + WINDOW] for at in range(0, max(1, len(words) - half), half)]


def _answer(text: str) -> str:
    parts = [x for x in text.replace("\n", " ").split(". ") if x.strip()]
    return parts[-1] if parts else ""


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item found in it: id, item, cosine, lcs (share of the item's words), answer (share of its answer's), kind."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    scratch = Scratch(spark, "decontaminate")
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).cast("string").alias("t"))
    total = benchmark.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.col(item_text).cast("string"))), F.lit(0)).alias("c")).collect()[0]
    chunks = max(1, -(-total["n"] // CHUNK), -(-total["c"] // CHUNK_CHARS))
    out = None
    for c in range(chunks):
        part = benchmark.where(F.pmod(F.xxhash64(F.col(item_col), F.col(item_text)), F.lit(chunks)) == c) if chunks > 1 else benchmark
        items = part.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).collect()  # CHUNK or so, by the split above
        items = sorted((r for r in items if r["t"]), key=lambda r: (str(r["i"]), r["t"]))
        found = _chunk(keyed, [(r["i"], r["t"]) for r in items], scratch, c)
        if found is not None:
            out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, `{item_col}` {item_kind}, cosine double, lcs double, answer double, kind string")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("item").cast(item_kind).alias(item_col), "cosine", "lcs", "answer", "kind").distinct()


def _chunk(keyed: DataFrame, items: list[tuple], scratch: Scratch, c: int) -> DataFrame | None:
    sc = keyed.sparkSession.sparkContext
    words = hashes(pa.array([t for _, t in items], pa.string()))
    answers = hashes(pa.array([_answer(t) for _, t in items], pa.string()))
    live = [n for n, w in enumerate(words) if len(w)]
    if not live:
        return None
    every = Vocabulary(np.unique(np.concatenate([words[n] for n in live])))
    df, n_docs = _frequencies(keyed.select("id", "k", "t"), every)
    if not n_docs:
        return None
    kept = df <= max(1.0, COMMON * n_docs)
    windows = [(n, w) for n in live for w in _windows(words[n])]
    for _, w in windows:
        own = np.unique(np.searchsorted(every.words, w))
        kept[own[np.argsort(df[own], kind="stable")][:RAREST]] = True
    idf = np.log((n_docs + 1) / (df[kept] + 1)) + 1e-3
    vocabulary = Vocabulary(every.words[kept])
    every_posting = scratch.keep(_postings(keyed, vocabulary, Needed(every, df, words)), f"postings-{c}")
    postings = every_posting.select("id", "k", "p", "w").repartition(partitions(keyed.sparkSession))
    found = None
    for a in range(0, len(windows), BLOCK):
        some = windows[a : a + BLOCK]
        names = np.array([n for n, _ in some])
        columns = [vocabulary.find(w)[1] for _, w in some]
        used = np.unique(np.concatenate(columns))  # the words of these windows
        local = np.full(len(idf), -1, np.int32)
        local[used] = np.arange(len(used))
        rows = np.zeros((len(some), len(used)))
        for r, k in enumerate(columns):
            np.add.at(rows[r], local[k], idf[k])
        rows /= np.maximum(np.sqrt((rows**2).sum(1, keepdims=True)), 1e-30)
        v = latent(postings, idf, local, rows)
        z = rows @ v
        z /= np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-30)
        part = _search(every_posting.repartition(partitions(keyed.sparkSession)), idf, local, names, v.astype(np.float32), z.astype(np.float32))
        if len(windows) > BLOCK:  # so that no more than one block's vectors are held
            part = scratch.keep(part, f"found-{c}-{a}")
        found = part if found is None else found.union(part)
    near = found.groupBy("id", "k").agg(F.collect_list(F.struct("n", "win", "cosine")).alias("c"))  # windows of one document times items above the cut
    near = scratch.keep(near, f"candidates-{c}")
    sent = sc.broadcast((items, words, answers))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        items, words, answers = sent.value
        half = WINDOW // 2
        for b in batches:
            cols = ([], [], [], [], [], [])
            for ident, text, cands in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                h = hashes(pa.array([text.as_py()], pa.string()))[0]
                best: dict[int, tuple] = {}
                seen = set()
                for x in sorted(cands, key=lambda x: -x["cosine"]):
                    n = x["n"]
                    if (n, x["win"]) in seen or n in best and best[n][0] == 1:  # nothing is better
                        continue
                    seen.add((n, x["win"]))  # again from another block, with windows of the same item
                    item, answer = words[n], answers[n]
                    a = max(0, x["win"] * half - len(item))
                    region = h[a : x["win"] * half + WINDOW + len(item)]
                    share = lcs(item, region) / len(item)
                    if share < PARAPHRASE:
                        continue
                    told = float(np.isin(answer, region).mean()) if len(answer) else 1.0
                    kind = "verbatim" if share >= VERBATIM else "paraphrase" if told >= ANSWER else None
                    if kind and (n not in best or (share, x["cosine"]) > best[n][:2]):
                        best[n] = (share, x["cosine"], told, kind)
                for n, (share, cosine, told, kind) in sorted(best.items()):
                    for col, v in zip(cols, (ident, str(items[n][0]) if items[n][0] is not None else None, cosine, share, told, kind), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.string()), *(pa.array(x, pa.float64()) for x in cols[2:5]), pa.array(cols[5], pa.string())], ["id", "item", "cosine", "lcs", "answer", "kind"])

    # by sorting at any size: how many candidates there are goes with the documents
    joined = keyed.join(near.hint("merge"), (keyed["id"].eqNullSafe(near["id"])) & (keyed["k"] == near["k"])).select(keyed["id"], keyed["t"], near["c"])
    id_kind = keyed.schema["id"].dataType.simpleString()
    return joined.mapInArrow(check, f"id {id_kind}, item string, cosine double, lcs double, answer double, kind string")


def _search(postings: DataFrame, weight: np.ndarray, local: np.ndarray, names: np.ndarray, v: np.ndarray, z: np.ndarray) -> DataFrame:
    """Passages and items whose cosine in the latent space reaches COSINE, and those of the postings' last columns."""
    sent = postings.sparkSession.sparkContext.broadcast((weight, local, names, v, z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        weight, local, names, v, z = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                doc, win, bound, col, val = passages(part.column(2), part.column(3), weight)
                own, bound, col, val = _cut(bound, local[col], val)
                doc, win = doc[own], win[own]
                # unit length is that of the passage's words, so what falls outside the latent space counts against it
                cos = _sums(bound, col, val.astype(np.float32), v) @ z.T if len(doc) else np.zeros((0, len(names)), np.float32)
                # of the windows of one item, which stand together, the best
                first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
                cos, own = np.maximum.reduceat(cos, first, axis=1), names[first]
                r, n = np.nonzero(cos >= COSINE)
                found = [doc[r], own[n], win[r], cos[r, n]]
                count = np.diff(part.column(4).offsets.to_numpy())
                item, w = part.column(4).flatten().to_numpy(), part.column(5).flatten().to_numpy().astype(np.int64)
                d = np.repeat(np.arange(part.num_rows), count)
                n = np.minimum(np.searchsorted(own, item), len(own) - 1)
                here = own[n] == item
                d, w, n = d[here], w[here], n[here]
                c = np.zeros(len(d), np.float32)
                if len(doc):
                    key = (doc << 32) + win  # in order, as passages are
                    r = np.minimum(np.searchsorted(key, (d << 32) + w), len(key) - 1)
                    c = np.where(key[r] == (d << 32) + w, cos[r, n], 0)
                new = c < COSINE
                doc, n, win, c = (np.concatenate((x, y[new])) for x, y in zip(found, (d, own[n], w, c), strict=True))
                r = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(r), b.column(1).take(r), pa.array(n.astype(np.int32)), pa.array(win.astype(np.int32)), pa.array(c.astype(np.float64))], ["id", "k", "n", "win", "cosine"])

    return postings.mapInArrow(run, "id long, k long, n int, win int, cosine double")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no item was found, as they were."""
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_dc_id")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_dc_id"]), "left_anti")

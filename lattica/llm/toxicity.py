"""Toxicity: a convolutional text classifier trained in numpy.

Words (lower-cased runs of letters and digits) are hashed into embedding tables, twice whole and once for
each of two prefixes, which stand for stems; filters of several widths run over the whole text, their
maxima feed a logistic output. Embeddings start at zero, so a word never trained on adds nothing, however
long the text. The model is fitted on the driver on at most
TRAIN_ROWS labelled documents, chosen by a hash of the id; every other step covers all rows. Thresholds
are calibrated by language on a part of the labelled rows kept out of the fit; the score itself sees
nothing but the text.

Edge cases: null or empty text, or one without words, gets the score of no words; a null id passes
through; repeated rows score alike; with no labelled rows of either class the score is the share of
toxic labels (0 without labels); an empty table gives an empty result. Only id, text and lang are read,
so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, env_threads
from .textvec import NOT_ALNUM, U, Words, buffers, slices

#: Bound of the labelled sample that the classifier is fitted on.
TRAIN_ROWS = 6000
WIDTHS, FILTERS, DIM, BITS = (1, 2, 3), 8, 8, 20
#: Lengths in bytes of the prefixes, and the (column, shift) of each table's bucket in a word's hashes.
PREFIXES, PLACES = (4, 6), ((0, 0), (0, 32), (1, 0), (1, 32))
#: Passes over the sample: enough to see STEPS documents, between the bounds.
STEPS, EPOCHS, BATCH, RATE, DECAY, DROP = 60000, (6, 80), 32, 0.1, 1e-3, 0.3
WIDE = DIM * len(PLACES)
THRESHOLD = 0.3
PAD = max(WIDTHS) - 1


def word_ids(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of rows: the first row, word hashes, and the bounds of the rows in them."""
    data, off = buffers(text)
    for i, j in slices(off):
        w = Words(data, off, i, j, space=NOT_ALNUM)
        low = U(0xFFFFFFFF)
        yield i, np.stack([w.hash, (w.prefix_hash(PREFIXES[0]) & low) | (w.prefix_hash(PREFIXES[1]) << U(32))], axis=1), w.of


@dataclass
class Model:
    """index: hash bucket to row of `table`, row 0 for buckets without training; kernel: by width, (width * WIDE, FILTERS)."""

    table: list[np.ndarray]
    index: list[np.ndarray]
    kernel: list[np.ndarray]
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def embed(self, h: np.ndarray) -> np.ndarray:
        mask = U((1 << BITS) - 1)
        return np.concatenate([t[i[(h[:, c] >> U(s)) & mask]] for t, i, (c, s) in zip(self.table, self.index, PLACES, strict=True)], axis=1)

    def padded(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings with PAD zero rows after each document, and where documents begin."""
        n = np.diff(of)
        start = of[:-1] + PAD * np.arange(len(n))
        x = np.zeros((len(h) + PAD * len(n), WIDE), np.float32)
        x[np.arange(len(h)) + np.repeat(PAD * np.arange(len(n)), n)] = self.embed(h)
        return x, start

    def pooled(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Maxima over each document of every rectified filter. A window that begins in the padding sees zeros."""
        parts = []
        for w, k, s in zip(WIDTHS, self.kernel, self.shift, strict=True):
            parts.append(np.maximum(np.maximum.reduceat(_convolve(x, start, w, k), start, axis=0) + s, 0))
        return np.concatenate(parts, axis=1)

    def logits(self, h: np.ndarray, of: np.ndarray) -> np.ndarray:
        return self.pooled(*self.padded(h, of)) @ self.out + self.bias if len(of) > 1 else np.zeros(0)

    def scores(self, h: np.ndarray, of: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(of) - 1, self.constant)
        z = self.scale[0] * self.logits(h, of).astype(np.float64) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _convolve(x: np.ndarray, start: np.ndarray, w: int, k: np.ndarray) -> np.ndarray:
    """Filters over all windows of w rows. Those that begin in the padding are 0, as what follows it is another document."""
    z = x @ k[:WIDE]
    for d in range(1, w):
        z[:-d] += x[d:] @ k[WIDE * d : WIDE * (d + 1)]
    ends = np.append(start[1:], len(x))
    z[(ends[:, None] - 1 - np.arange(PAD)).ravel()] = 0
    return z


def fit(texts: list[np.ndarray], y: np.ndarray, lang: list[str | None], seed: int = 7) -> Model:
    """Train on word hashes and labels. A fifth of the rows is kept out for calibration."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return Model([], [], [], [], np.zeros(0), 0.0, constant=float(y.mean()) if len(y) else 0.0)
    mask = U((1 << BITS) - 1)
    table, index = [], []
    for c, s in PLACES:
        some = np.zeros(1 << BITS, bool)
        for t in texts:
            some[(t[:, c] >> U(s)) & mask] = True
        used = np.flatnonzero(some)
        i = np.zeros(1 << BITS, np.int32)
        i[used] = np.arange(1, len(used) + 1)
        index.append(i)
        table.append(np.zeros((len(used) + 1, DIM), np.float32))
    kernel = [rng.normal(0, 0.5 / np.sqrt(w), (w * WIDE, FILTERS)).astype(np.float32) for w in WIDTHS]
    m = Model(table, index, kernel, [np.zeros(FILTERS, np.float32) + 0.01 for _ in WIDTHS], np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32), float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))))
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    params = [*m.kernel, *m.shift, m.out]
    grown = [np.full(p.shape, 1e-2, np.float32) for p in params]
    seen = [np.full(t.shape, 1e-2, np.float32) for t in m.table]
    b_seen = 1e-2
    weight = np.where(y > 0, min(4.0, 0.5 / max(y.mean(), 1e-3)), 1.0)
    for _ in range(min(EPOCHS[1], max(EPOCHS[0], STEPS // len(train)))):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            h = np.concatenate([texts[r] for r in rows])
            of = np.concatenate(([0], np.cumsum([len(texts[r]) for r in rows])))
            x, start = m.padded(h, of)
            own = np.arange(len(h)) + np.repeat(PAD * np.arange(len(rows)), np.diff(of))
            x[own[rng.random(len(h)) < DROP]] = 0  # so that no word hides behind another
            ends = np.append(start[1:], len(x))
            pool, best = [], []
            for w, k, s in zip(WIDTHS, m.kernel, m.shift, strict=True):
                z = _convolve(x, start, w, k)
                top = np.stack([a + z[a:b].argmax(0) for a, b in zip(start, ends, strict=True)])
                best.append(top)
                pool.append(z[top, np.arange(FILTERS)] + s)
            raw = np.concatenate(pool, axis=1)
            act = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-(act @ m.out + m.bias)))
            g = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grads: list[np.ndarray] = []
            dact = np.outer(g, m.out) * (raw > 0)
            dk, ds, dx = [], [], np.zeros_like(x)
            for n, (w, k) in enumerate(zip(WIDTHS, m.kernel, strict=True)):
                da, top = dact[:, n * FILTERS : (n + 1) * FILTERS], best[n]
                ds.append(da.sum(0))
                gk = np.zeros_like(k)
                for d in range(w):
                    at_d = np.minimum(top + d, len(x) - 1)
                    inside = (top + d < ends[:, None])[..., None]  # no further than the document's padding
                    gk[WIDE * d : WIDE * (d + 1)] = np.einsum("bf,bfe->ef", da, x[at_d] * inside)
                    np.add.at(dx, at_d.ravel(), (da[..., None] * k[WIDE * d : WIDE * (d + 1)].T[None] * inside).reshape(-1, WIDE))
                dk.append(gk)
            grads = [*dk, *ds, act.T @ g]
            for q, gq, acc in zip(params, grads, grown, strict=True):
                gq = gq + DECAY * q
                acc += gq * gq
                q -= RATE * gq / np.sqrt(acc)
            gb = float(g.sum())
            b_seen += gb * gb
            m.bias -= RATE * gb / np.sqrt(b_seen)
            moved = np.flatnonzero(np.abs(dx[own]).sum(1))
            for n, (c, s) in enumerate(PLACES):
                to = m.index[n][(h[moved, c] >> U(s)) & mask]
                to, inv = np.unique(to, return_inverse=True)
                gt = np.zeros((len(to), DIM), np.float32)
                np.add.at(gt, inv, dx[own[moved], n * DIM : (n + 1) * DIM])
                gt += DECAY * m.table[n][to]
                seen[n][to] += gt * gt
                m.table[n][to] -= RATE * gt / np.sqrt(seen[n][to])
    _calibrate(m, [texts[r] for r in held], y[held], [lang[r] for r in held])
    for n in range(len(PLACES)):  # words that never won a maximum need no row
        live = np.flatnonzero(np.abs(m.table[n]).sum(1) > 0)
        new = np.zeros(len(m.table[n]), np.int32)
        new[live] = np.arange(1, len(live) + 1)
        m.index[n] = new[m.index[n]]
        m.table[n] = np.concatenate([np.zeros((1, DIM), np.float32), m.table[n][live]])
    return m


def _calibrate(m: Model, texts: list[np.ndarray], y: np.ndarray, lang: list[str | None]) -> None:
    """A logistic curve over the held-out logits, then for each language the cut of fewest errors, nearest to THRESHOLD, within 0.2 to 0.6."""
    if not len(y) or y.min() == y.max():
        return
    z = np.concatenate([m.logits(t, np.array([0, len(t)])) for t in texts]).astype(np.float64)
    a, b = 1.0, 0.0
    soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))  # keeps the curve finite where classes separate
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = np.maximum(p * (1 - p), 0.05)  # a bound from below on the curvature: no step overshoots
        g = np.array([np.sum((p - soft) * z), np.sum(p - soft)])
        hess = np.array([[np.sum(w * z * z) + 1e-3, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, g)
    m.scale = (float(max(a, 0.1)), float(b))
    p = 1 / (1 + np.exp(-np.clip(m.scale[0] * z + m.scale[1], -40, 40)))
    grid = np.linspace(0.2, 0.6, 41)
    for k in {x for x in lang if x is not None}:
        own = np.array([x == k for x in lang])
        if own.sum() >= 30 and y[own].sum() >= 20:
            errors = np.array([np.sum((p[own] >= t) != (y[own] > 0)) for t in grid])
            best = grid[errors == errors.min()]
            m.thresholds[k] = float(best[np.argmin(np.abs(best - THRESHOLD))])


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on the `rows` labelled documents first by a hash of their id, among those that `usable` admits."""
    env_threads()
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        chosen = chosen.where(usable)
    chosen = chosen.groupBy(F.col(id_col).alias("_tx_id")).agg(F.max(label_col).cast("int").alias("_tx_y"))
    chosen = chosen.orderBy(F.xxhash64("_tx_id"), "_tx_id").limit(rows)
    # a bounded number of rows, so the small side can be sent to all
    found = docs.select(F.col(id_col).alias("_tx_id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).join(F.broadcast(chosen), "_tx_id").select("_tx_id", "_tx_y", "l", "t")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [h[of[r] : of[r + 1]].tobytes() for _, h, of in word_ids(b.column(3)) for r in range(len(of) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), b.column(2), pa.array(hs, pa.binary())], ["i", "y", "l", "h"])

    got = found.mapInArrow(words, "i long, y int, l string, h binary").toArrow()  # `rows` rows at most
    got = got.combine_chunks()
    hs = got["h"].chunk(0) if got.num_rows else pa.array([], pa.binary())
    data, off = buffers(hs)
    order = sorted(range(got.num_rows), key=lambda r: (got["i"][r].as_py(), int(off[r + 1] - off[r])))
    texts = [data[off[r] : off[r + 1]].view(np.uint64).reshape(-1, 2) for r in order]
    y, lang = got["y"].to_numpy().astype(np.float64), got["l"].to_pylist()
    return fit(texts, y[order] if len(order) else y, [lang[r] for r in order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and score, in [0, 1]."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        m = sent.value
        for b in batches:
            parts = [m.scores(h, of) for _, h, of in word_ids(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_tx_t")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose score stays under their language's threshold (THRESHOLD for others); all columns, as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    t, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        m = sent.value
        for b in batches:
            parts = [m.scores(h, of) for _, h, of in word_ids(b.column(t))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            cut = np.array([m.thresholds.get(x, THRESHOLD) for x in b.column(lang).to_pylist()])
            yield b.filter(pa.array(s < cut, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc32_of_id(id_col) % 4 == 2, F.lit(False))

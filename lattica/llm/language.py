"""Language identification by a multilingual mixture, fitted to each document by expectation-maximisation.

Training counts hashed byte trigrams of words (with their edges) by language over all labelled documents.
A word's likelihood in a language is the product of its trigrams'. For a document, EM estimates the share
of its words from each language; languages are then ordered by share, the sets of the first 1, 2, ... are
fitted, and the set with the best penalised log-likelihood is kept: each further language must gain
PENALTY * log(words + 1) / 2. As no likelihood exceeds that of each word in its best language, a document's sets
end where the penalty alone is more than the best set lacks. The prediction is the language with the largest
share, and the score that share.

Edge cases: null text, or text without a letter, gives `und` with score 0 and no languages; empty training
data gives `und` for all; languages that tie go by name; a null id passes through; repeated rows are
predicted alike; an empty table gives an empty result. Only id, text and lang are read. The model has a row for
each language, and is held by the driver and every task, so more than LANGUAGES different values of lang are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, env_threads
from .textvec import _LETTERS, NOT_LETTER, Words, buffers, slices

BITS = 15
SMOOTH = 0.2
ROUNDS, PENALTY = 8, 6.0
UNKNOWN = "und"
#: Most languages of a model, whose size goes with their number.
LANGUAGES = 500


def trigrams(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows i..j: a bucket for each byte of a word, the first byte of each word in those, and the words of each row."""
    w = Words(data, off, i, j, hashed=False, space=NOT_LETTER)
    b = np.where(NOT_LETTER[w.data], np.uint8(32), _LETTERS[w.data]).astype(np.uint32)
    before = np.concatenate(([np.uint32(32)], b[:-1]))
    after = np.concatenate((b[1:], [np.uint32(32)]))
    edge = off[i : j + 1] - off[i]
    before[edge[:-1][edge[:-1] < len(b)]] = 32
    after[edge[1:][edge[1:] > 0] - 1] = 32
    h = before * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(32 - BITS)
    inside = np.zeros(len(b) + 1, np.int32)
    inside[w.start] += 1
    np.add.at(inside, w.end, -1)
    keep = np.cumsum(inside[:-1]) > 0
    size = w.end - w.start
    return h[keep], np.concatenate(([0], np.cumsum(size)))[:-1], w.of


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # (buckets, languages)

    def words(self, data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of the words of rows i..j by language, each word's largest set to 0, and the words of each row."""
        g, start, of = trigrams(data, off, i, j)
        if not len(start) or not self.languages:
            return np.zeros((0, len(self.languages)), np.float32), of
        l = np.stack([np.add.reduceat(self.logp[:, k][g], start) for k in range(len(self.languages))], axis=1)
        return l - l.max(1, keepdims=True), of

    def infer(self, like: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares (rows, languages) of the chosen set, zero outside it and for rows without words."""
        n = np.diff(of)
        has = np.flatnonzero(n)
        shares = np.zeros((len(n), len(self.languages)))
        if not len(has) or not self.languages:
            return shares, shares
        p = np.exp(np.maximum(like, -30)).astype(np.float32)
        start, size = of[:-1][has], n[has]
        full = np.full((len(has), len(self.languages)), 1 / len(self.languages))
        full, _ = _em(p, start, size, full)
        order = np.argsort(-full, axis=1, kind="stable")
        best = np.full(len(has), -np.inf)
        chosen = np.zeros_like(full)
        for k in range(1, len(self.languages) + 1):
            fee = PENALTY * (k - 1) * np.log(size + 1) / 2
            on = np.flatnonzero(best < -fee)  # the log-likelihood is 0 at most
            if not len(on):
                break
            allowed = np.zeros((len(on), len(self.languages)))
            np.put_along_axis(allowed, order[on, :k], 1.0, axis=1)
            pi = (full[on] + 1e-6) * allowed
            q = p if len(on) == len(has) else p[np.repeat(best < -fee, size)]
            pi, ll = _em(q, np.cumsum(size[on]) - size[on], size[on], pi / pi.sum(1, keepdims=True), rounds=ROUNDS // 2 if k > 1 else 1)
            ll = ll - fee[on]
            take = ll > best[on]
            best[on[take]], chosen[on[take]] = ll[take], pi[take]
        shares[has] = chosen
        return shares, p


def _em(p: np.ndarray, start: np.ndarray, size: np.ndarray, pi: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(size)), size)
    for _ in range(rounds):
        r = p * pi[row].astype(np.float32)
        total = r.sum(1)
        r /= np.maximum(total, 1e-30)[:, None]
        pi = np.add.reduceat(r, start, axis=0).astype(np.float64) / size[:, None]
    total = (p * pi[row].astype(np.float32)).sum(1)
    return pi, np.add.reduceat(np.log(np.maximum(total, 1e-30)), start).astype(np.float64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram counts by language over every row with a language."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(0).to_pylist()
            data, off = buffers(b.column(1))
            for i, j in slices(off):
                g, start, of = trigrams(data, off, i, j)
                at = np.append(start, len(g))[of]
                for r in range(i, j):
                    own = g[at[r - i] : at[r - i + 1]]
                    if len(own) > 2048:
                        sums[names[r]] = sums.get(names[r], 0) + np.bincount(own, minlength=1 << BITS)
                    elif len(own):
                        np.add.at(sums.setdefault(names[r], np.zeros(1 << BITS, np.int64)), own, 1)
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], ["l", "g", "n"])

    many = rows.select("l").distinct().limit(LANGUAGES + 1).count()
    if many > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    # a row for each language and bucket at most, whatever the corpus
    got = rows.mapInArrow(count, "l string, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got["l"].to_pylist()))
    counts = np.full((1 << BITS, len(languages)), SMOOTH)
    if languages:
        at = {k: n for n, k in enumerate(languages)}
        np.add.at(counts, (got["g"].to_numpy(), np.array([at[x] for x in got["l"].to_pylist()])), got["n"].to_numpy())
    return Model(languages, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32) if languages else counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, lang_pred, score, and the shares of the languages found in it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        m = sent.value
        for b in batches:
            names, scores, mixes = [], [], []
            data, off = buffers(b.column(1))
            for i, j in slices(off, 1 << 18):
                like, of = m.words(data, off, i, j)
                shares, p = m.infer(like, of)
                for r in range(j - i):
                    s = shares[r]
                    if not m.languages or not s.any() or not _letter(data[off[i + r] : off[i + r + 1]]):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        mixes.append([])
                        continue
                    k = int(np.argmax(s))
                    names.append(m.languages[k])
                    scores.append(float(min(1.0, s[k])))
                    mixes.append([(m.languages[x], float(s[x])) for x in np.argsort(-s, kind="stable") if s[x] > 0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64()))], [id_col, "lang_pred", "score", "shares"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_lg_t")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, shares map<string,double>")


def _letter(raw: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a letter; ASCII decides nearly always."""
    low = raw | 0x20
    if np.any((low >= 97) & (low <= 122) & (raw < 128)):
        return True
    return bool(np.any(raw >= 128)) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc32_of_id(id_col) % 5 == 0, F.lit(False))

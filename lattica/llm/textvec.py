"""Words, shingles and their hashes for a whole Arrow column of texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
#: Bytes of text worked on at a time; temporary arrays take about 40 times as much.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on an array that it may overwrite."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(lower: bool) -> np.ndarray:
    chars = np.arange(256, dtype=np.uint64)
    if lower:
        chars[65:91] += U(32)
    return mix((chars + U(1)) * U(0xD6E8FEB86659FD93))


_PLAIN, _LOWER = _table(False), _table(True)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[65:91] += 32
#: All but ASCII letters, digits and bytes of longer characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
NOT_LETTER = NOT_ALNUM.copy()
NOT_LETTER[48:58] = True


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if cache.get("n", -1) < n:
        n = max(n, SLICE + 1)
        with np.errstate(over="ignore"):
            cache["n"] = n
            for k, b in (("up", _B), ("down", _BINV)):
                p = np.ones(n + 1, np.uint64)
                done, step = 1, b
                while done < n + 1:  # doubling: p[done:2 done] = p[:done] * b^done
                    m = min(done, n + 1 - done)
                    p[done : done + m] = p[:m] * U(pow(b, done, 1 << 64))
                    done += m
                cache[k] = p
    return cache["up"], cache["down"]


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or a single row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of rows i..j: bounds in `data`, hashes, and for each row the range of its words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, lower: bool = True, hashed: bool = True, space: np.ndarray = _SPACE):
        lo, hi = int(off[i]), int(off[j])
        b = data[lo:hi]
        rows = off[i : j + 1] - lo
        word = ~space[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[rows] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.data, self.start, self.end = b, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, rows)  # row r has words of[r]..of[r + 1]
        if hashed:
            up, down = _powers(len(b))
            t = (_LOWER if lower else _PLAIN)[b]
            t *= up[: len(b)]
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(t, out=total[1:])
            h = total[self.end] - total[self.start]
            h *= down[self.start]
            self.hash = mix(h)
            self._sums = total, down

    def prefix_hash(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word, or of all if it has fewer."""
        total, down = self._sums
        end = np.minimum(self.end, self.start + n)
        return mix((total[end] - total[self.start]) * down[self.start] + U(n))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each row's k-word shingles, in order, and the bounds of the rows; fewer words: all as one; none: none."""
        n = np.diff(self.of)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        bounds = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.of[:-1], count)
        size = np.repeat(np.minimum(n, k), count)
        h = size.astype(np.uint64) * U(0xA0761D6478BD642F)
        for x in range(k):
            w = self.hash[np.minimum(at + x, max(len(self.hash) - 1, 0))] if len(self.hash) else np.zeros(0, np.uint64)
            w = np.where(size > x, w, U(0))
            h = h * U(0x100000001B3) + w * U((0xE7037ED1A0B428DB * (2 * x + 1)) & 0xFFFFFFFFFFFFFFFF)
        return mix(h), bounds


def distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each range, and the new bounds."""
    parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    w = Words(raw, np.array([0, len(raw)]), 0, 1)
    return np.unique(w.shingles(k)[0])

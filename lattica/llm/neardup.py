"""Near duplicates: a signature-coordinate inverted join.

1. Each document's set of k-word shingles gets a MinHash signature of SIZE coordinates. Equal sets are
   collapsed to one representative first, so exact copies never meet each other.
2. Representatives are posted under every (coordinate, value). A pair at the threshold agrees in at least
   `needed` coordinates but for a chance of MISS; so two such documents share one of their
   SIZE - needed + 1 rarest postings. Only that prefix is merged: lists of values that many unlike
   documents share (a common passage) drop out of it.
3. Each remaining list names its most central document as hub, and a hub's family is all that its lists
   hold. Any pair that shares a prefix posting is in one family. Families are cut in blocks of bounded rows
   and bytes. In a block collisions are counted by merging inverted lists: those of a row's prefix, rarest values
   first, name its candidates; the other coordinates are counted a few at a time, and a candidate that cannot
   reach the match threshold any more is skipped. Pairs at the threshold are confirmed on full shingle sets, for
   each group the best first, until nothing is left that could join two groups.
4. Families of several blocks that are still in more than one component are merged in tiles of TILE_ROWS rows a
   side, leaving out pairs inside the family's main component. So no pair is lost and no list is emitted as pairs;
   of a family without any link, of m documents, each goes to m / TILE_ROWS tiles.

Shingles are compared by 64-bit hashes. MISS bounds the chance that any one link at the very threshold is
not proposed.

Edge cases: null, empty or white-space texts have an empty set and link with nothing; texts of fewer than k
words have one shingle; rows with a null id link with nothing and have a null component; rows that repeat an
id are that one document, which has the links of all its texts; an empty table gives an empty result. Only id
and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, env_threads
from .components import components
from .textvec import U, Words, buffers, distinct, mix, slices

SHINGLE, THRESHOLD = 5, 80
SIZE, MISS = 128, 1e-9
#: Bounds of a block: documents, and shingles of all of them; documents of a tile's side. Blocks up to FEW rows are compared without lists.
BLOCK_ROWS, BLOCK_SHINGLES, TILE_ROWS, FEW = 500, 2_000_000, 2048, 64
#: Coordinates counted between two looks at which candidates can be skipped.
STEP = 32

_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64) * U(2) + U(1)
_ADD = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64)


def needed(percent: int = THRESHOLD, size: int = SIZE, miss: float = MISS) -> int:
    """The most matches that a pair at the threshold reaches but for a chance of `miss`."""
    p, tail = percent / 100, 0.0
    for t in range(size + 1):
        tail += math.comb(size, t) * p**t * (1 - p) ** (size - t)
        if tail > miss:
            return max(t, 1)
    return size


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, tk (a hash of the text), n (set size), two 64-bit digests of the set, and its signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in slices(off):
                w = Words(data, off, i, j)
                d, bounds = distinct(*w.shingles(k))
                n = np.diff(bounds)
                has = np.flatnonzero(n)
                hi, lo = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                sig = np.zeros((j - i, SIZE), np.uint32)
                if len(has):
                    at = bounds[:-1][has]
                    hi[has] = np.add.reduceat(mix(d ^ U(0x5851F42D4C957F2D)), at)
                    lo[has] = np.add.reduceat(mix(d * U(0x9FB21C651E98DF25)), at)
                    for c in range(SIZE):
                        t = d * _MUL[c]
                        t += _ADD[c]
                        sig[has, c] = (np.minimum.reduceat(t, at) >> U(32)).astype(np.uint32)
                arr = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * SIZE, SIZE, dtype=np.int32)), pa.array(sig.view(np.int32).ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), arr], ["id", "tk", "n", "hi", "lo", "sig"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.xxhash64(F.col(text_col).cast("string"))).mapInArrow(run, "id long, tk long, n long, hi long, lo long, sig array<int>")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of equal values in the first `keys` columns, of rows sorted by them."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(new), b.num_rows)
        for x, y in zip(at[:-1], at[1:], strict=True):
            key = tuple(c[x] for c in cols)
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(b.slice(x, y - x))
            last = key
    if kept:
        yield pa.Table.from_batches(kept)


class _Block:
    """The documents of a block, with the labels of the groups known so far."""

    def __init__(self, t: pa.Table, k: int, percent: int, need: int):
        self.id = t["id"].to_numpy()
        self.n = t["n"].to_numpy()
        self.sig = t["sig"].combine_chunks().values.to_numpy().reshape(-1, SIZE) if len(t) else np.zeros((0, SIZE), np.int32)
        self.text, self.k, self.percent, self.need = t["text"], k, percent, need
        self.sets: dict[int, np.ndarray] = {}
        self.label = t["label"].to_numpy().copy()
        self.parts = [np.ascontiguousarray(self.sig[:, c : c + STEP]) for c in range(0, SIZE, STEP)]
        self.rows = None
        if len(self.id) > FEW:
            self._lists()

    def _lists(self) -> None:
        """Inverted lists of the coordinate values in each row's prefix: the values rarest here, in one order for all rows."""
        n = len(self.id)
        token = (np.arange(SIZE, dtype=np.uint64) << U(32)) | self.sig.view(np.uint32)
        _, which, count = np.unique(token, return_inverse=True, return_counts=True)
        rarer = np.empty(len(count), np.int64)
        rarer[np.argsort(count, kind="stable")] = np.arange(len(count))
        prefix = np.sort(rarer[which.reshape(n, SIZE)], axis=1)[:, : SIZE - self.need + 1]
        alone = int(np.count_nonzero(count == 1))  # values of one row come first in the order, and have no list
        self.own = [p[np.searchsorted(p, alone) :] - alone for p in prefix]
        flat = np.concatenate(self.own)
        row = np.repeat(np.arange(n), [len(p) for p in self.own])
        self.rows = row[np.argsort(flat, kind="stable")]
        self.bound = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=len(count) - alone))))

    def shingles(self, r: int) -> np.ndarray:
        if r not in self.sets:
            data, off = buffers(pa.array([self.text[r].as_py()], pa.string()))
            self.sets[r] = np.unique(Words(data, off, 0, 1).shingles(self.k)[0])
        return self.sets[r]

    def linked(self, a: int, others: np.ndarray) -> np.ndarray:
        """Which of the others have a link with a, on full sets."""
        x, sets = self.shingles(a), [self.shingles(int(b)) for b in others]
        size = np.array([len(y) for y in sets])
        every = np.concatenate(sets)
        at = np.minimum(np.searchsorted(x, every), len(x) - 1)
        common = np.add.reduceat((x[at] == every).astype(np.int64), np.cumsum(size) - size)
        return 100 * common >= self.percent * (len(x) + size - common)

    def candidates(self, a: int, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows that `right` admits, those with at least `need` collisions with a, and how many."""
        if self.rows is not None:
            near = np.concatenate([self.rows[self.bound[v] : self.bound[v + 1]] for v in self.own[a]]) if len(self.own[a]) else self.rows[:0]
            hit = np.zeros(len(self.id), bool)
            hit[near] = True
            right = right & hit
        at = np.flatnonzero(right & (self.label != self.label[a]) & (self.n * 100 >= self.percent * self.n[a]) & (self.n[a] * 100 >= self.percent * self.n))
        count, left = np.zeros(len(at), np.int64), SIZE
        for part in self.parts:
            if not len(at):
                break
            count += (part[at] == part[a]).sum(1)
            left -= part.shape[1]
            ok = count + left >= self.need
            at, count = at[ok], count[ok]
        return at, count

    def merge(self, left: np.ndarray, right: np.ndarray, later: bool = False) -> list[tuple[int, int]]:
        """Links found between rows `left` and rows that `right` admits (of those only later ones, if so) that join two labels."""
        found = []
        for a in left:
            admit = right
            if later:
                admit = right.copy()
                admit[: a + 1] = False
            at, count = self.candidates(int(a), admit)
            at = at[np.argsort(-count, kind="stable")]
            while len(at):  # the best of each group at once
                at = at[self.label[at] != self.label[a]]
                best = np.sort(np.unique(self.label[at], return_index=True)[1])
                if not len(best):
                    break
                tried = at[best]
                for b in tried[self.linked(int(a), tried)]:
                    x, y = self.label[a], self.label[b]
                    if x != y:
                        self.label[self.label == max(x, y)] = min(x, y)
                        found.append((int(self.id[a]), int(self.id[b])))
                at = np.delete(at, best)
        return found


_LINKS = "a long, b long"


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])


def _blocks(rows: int) -> F.Column:
    """How many blocks of at most `rows` rows and BLOCK_SHINGLES shingles the rows of a group make."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / rows, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")


def links(scratch: Scratch, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of ids that have a link, enough of them to join all that are linked, as one table or two. reps: node, id, tk, n, sig; texts: id, tk, text."""
    need = needed(percent)
    prefix = SIZE - need + 1
    posted = reps.select("node", F.posexplode("sig").alias("_c", "_v")).select("node", (F.shiftleft(F.col("_c").cast("long"), 32) + F.col("_v").cast("long") + F.lit(1 << 31)).alias("token"))
    # what is joined to lists is kept as a table first, so that the join can split a common value
    shared = scratch.keep(posted.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "shared")
    own = posted.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("own"), F.sum("f").alias("central"))
    # values that no other document has come first in a prefix
    rare = own.withColumn("left", F.lit(prefix - SIZE) + F.size("own")).where("left > 0")
    lists = rare.select("node", "central", F.explode(F.slice("own", F.lit(1), F.col("left"))).alias("p")).select("node", "central", F.col("p.token").alias("token"))
    lists = scratch.keep(lists, "lists")
    hubs = lists.groupBy("token").agg(F.max(F.struct("central", (-F.col("node")).alias("node"))).alias("h"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", (-F.col("h.node")).alias("hub"))
    hubs = scratch.keep(hubs, "hubs")
    family = scratch.keep(lists.join(hubs, "token").select("hub", "node").distinct(), "family")
    for step in ("lists", "hubs", "shared"):
        scratch.drop(step)

    used = family.select("node").distinct()
    rows = reps.select("node", "id", "tk", "n", "sig").join(used, "node").join(texts, ["id", "tk"]).dropDuplicates(["node"])
    rows = scratch.keep(rows.select("node", "id", "n", "sig", "text"), "rows")  # those in a family only
    member = family.join(rows.select("node", "n"), "node")
    total = scratch.keep(member.groupBy("hub").agg(_blocks(BLOCK_ROWS)), "total")
    member = scratch.keep(member.join(total, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"), "blocks"), "member")
    with_hub = member.where("node <> hub").select("hub", "i", "node").union(member.where("node = hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "node"))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hub against all, then all against all of the block."""
        env_threads()
        for t in _grouped(batches, 2):
            b = _Block(t, k, percent, need)
            node, every = t["node"].to_numpy(), np.ones(len(t), bool)
            yield _links(b.merge(np.flatnonzero(node == t["hub"][0].as_py()), every) + b.merge(np.arange(len(t)), every, later=True))

    block = with_hub.join(rows, "node").select("hub", "i", "node", "id", F.col("id").alias("label"), "n", "sig", "text")
    first = scratch.keep(block.repartition("hub", "i").sortWithinPartitions("hub", "i").mapInArrow(star, _LINKS), "links-1")

    # Families of several blocks, in several components: tiles of blocks against blocks, but not inside the main component.
    scratch.drop("family")
    large = member.where("blocks > 1").select("hub", "node")
    if large.isEmpty():
        for step in ("rows", "member", "total"):
            scratch.drop(step)
        return first, None
    labels = components(first, scratch, "cc1").withColumnRenamed("component", "label")
    large = scratch.keep(large.join(rows.select("node", "id", "n"), "node").join(labels, "id", "left").select("hub", "node", "n", F.coalesce("label", "id").alias("label")), "large")
    counts = large.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("hub").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    parts = large.join(main, "hub").select("hub", "node", "label", "n", (F.col("label") == F.col("main")).cast("int").alias("side"))
    cut = parts.groupBy("hub", "side").agg(_blocks(TILE_ROWS))
    number = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("blocks"))), F.lit(0)).cast("int")
    cuts = cut.groupBy("hub").agg(number(0).alias("others"), number(1).alias("mains"))
    parts = parts.join(cuts, "hub").withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 1, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # block i of the others meets block j >= i of the others, and every block (numbered after those) of the main component
    spread = F.when(F.col("side") == 1, F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: F.struct(x.alias("i"), (F.col("others") + F.col("at")).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1), lambda x: F.struct(F.when(x < F.col("others"), F.least(x, F.col("at"))).otherwise(F.col("at")).alias("i"), F.when(x < F.col("others"), F.greatest(x, F.col("at"))).otherwise(x).alias("j")))
    )
    placed = parts.select("hub", "node", "label", "at", "side", F.explode(spread).alias("p")).select("hub", "p.i", "p.j", F.when(F.col("side") == 1, 1).otherwise((F.col("p.i") != F.col("at")).cast("int")).alias("side"), "node", "label")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        for t in _grouped(batches, 3):
            b = _Block(t, k, percent, need)
            side = t["side"].to_numpy()
            same = t["i"][0].as_py() == t["j"][0].as_py()
            yield _links(b.merge(np.flatnonzero(side == 0), (side == 0) if same else (side == 1), later=same))

    block = placed.join(rows, "node").select("hub", "i", "j", "side", "id", "label", "n", "sig", "text")
    second = scratch.keep(block.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(cross, _LINKS), "links-2")
    for step in ("rows", "member", "total", "large"):
        scratch.drop(step)
    return first, second


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """A row per document: id, n_shingles, component_id (smallest id reachable by links), kept (the id is its component's).

    What is returned reads tables of `scratch`, which a caller that gives one can drop when it has written the rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    every = scratch.keep(signatures(docs, id_col, text_col, k), "signatures")
    some = every.where("n > 0 and id is not null")
    sets = some.groupBy("hi", "lo").agg(F.min(F.struct("id", "tk", "n", "sig")).alias("r"))
    # numbered as it is written: a set's number, as its least id may stand for other sets too
    reps = scratch.keep(sets.select("hi", "lo", "r.id", "r.tk", "r.n", "r.sig", F.monotonically_increasing_id().alias("node")), "reps")
    text = F.col(text_col).cast("string")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    first, second = links(scratch, reps, texts, k, percent)
    pairs = first if second is None else first.union(second)
    # an id with several sets joins them
    several = scratch.keep(some.groupBy("id").agg((F.min("hi") != F.max("hi")).alias("h"), (F.min("lo") != F.max("lo")).alias("l")).where("h or l").select("id"), "several")
    if not several.isEmpty():
        mine = some.select("id", "hi", "lo").join(several, "id").join(reps.select("hi", "lo", F.col("id").alias("b")), ["hi", "lo"])
        pairs = pairs.union(mine.select(F.col("id").alias("a"), "b").where("a <> b"))
    found = components(pairs, scratch, "cc")
    for step in ("links-1", "links-2", "several"):
        scratch.drop(step)
    group = reps.join(found, "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("component_id"))
    out = every.select("id", "n", "hi", "lo").join(group, ["hi", "lo"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))

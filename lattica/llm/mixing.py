"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh WEIGHTS in turn and share the whole size of the
corpus; no target exceeds CAP times its source's size, and the excess is shared again by weight. That
fixed point is a water level: target = least(CAP * size, weight * level).

Sampling: every document of a source expects rate = target / source size copies. Documents stand in a
fixed order (size class, then a hash of the id, then size and id), the prefix sum of the rates runs along
it, and a document is emitted once for each integer that offset + prefix sum crosses at it. As the order
follows size, the taken words stay within about one document of the target.

The prefix sum needs no task that holds a source: documents are counted in cells (source, size class,
hash bucket), at most BUCKETS * size classes a source whatever its rows; positions before a cell are sums
over cells, positions within one a row number in a group that hashing keeps small. Texts are read once: rows
with their sizes are written to the shared folder, and so is the one row of each source.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; rows without an id are
placed by a hash of their text, with nulls as empty; repeated rows count as separate documents, and stand in one
cell; an empty table gives an empty result. Other columns pass through, whatever their names (but for _mx_...),
unless equal to an output column, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKETS = 256
#: Size classes for each factor of e, above SMALL words.
STEPS, SMALL = 16, 16
SEED = "lattica-mix"
#: Lehmer's multiplicative generator: 48271 and 2**31 - 1 are its published constants.
MULTIPLIER, MODULUS = 48271, 2147483647


def word_count(text: str) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def _cell(size: Column, ident: Column, text: Column) -> list[Column]:
    cls = F.when(size <= SMALL, size).otherwise(F.floor(F.log(size.cast("double")) * STEPS) + SMALL)
    said = F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 7), 16, 10).cast("long")  # only where there is no id
    name = F.when(ident.isNull(), said).otherwise(ident.cast("long"))
    h = F.pmod(F.pmod(name, F.lit(MODULUS)) * MULTIPLIER, F.lit(MODULUS))
    return [cls.cast("long").alias("_mx_class"), (h % BUCKETS).cast("int").alias("_mx_bucket"), F.when(ident.isNull(), said).alias("_mx_said")]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes: a row for each source, with _mx_key, _mx_source and source_size. Adds target; the table has a row per source, so one task orders it."""
    by_name, by_level = W.orderBy(F.col("_mx_source").asc_nulls_last()), W.orderBy("_mx_q", "_mx_rank")
    every = W.partitionBy(F.lit(0))
    x = sizes.withColumn("_mx_rank", F.row_number().over(by_name) - 1)
    x = x.withColumn("_mx_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_mx_rank") % len(weights) + 1).cast("int")).cast("double"))
    x = x.withColumn("_mx_cap", F.col("source_size").cast("double") * cap).withColumn("_mx_q", F.col("_mx_cap") / F.col("_mx_w"))
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(every).cast("double")
    x = x.withColumn("_mx_level", (total - F.coalesce(F.sum("_mx_cap").over(before), F.lit(0.0))) / F.sum("_mx_w").over(after))
    x = x.withColumn("_mx_level", F.min(F.when(F.col("_mx_level") <= F.col("_mx_q"), F.struct("_mx_q", "_mx_rank", "_mx_level"))).over(every)["_mx_level"])
    return x.withColumn("target", F.least(F.col("_mx_cap"), F.col("_mx_w") * F.col("_mx_level"))).select("_mx_key", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED, columns: list[str] | None = None) -> DataFrame:
    """The documents (some of their columns, or all) with size, source_size, target and copies (how often the mix emits each)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    shown = [c for c in (docs.columns if columns is None else columns)]
    own = ["size", "source_size", "target", "copies"]
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    sized = docs.select(*[docs[c] for c in shown if c not in own], word_count(text_col).alias("size"), key.alias("_mx_key"), docs[id_col].alias("_mx_id"), docs[text_col].alias("_mx_text"))
    sized = sized.select("*", *_cell(F.col("size"), F.col("_mx_id"), F.col("_mx_text"))).drop("_mx_text")
    sized = scratch.keep(sized, "sized")
    cells = sized.groupBy("_mx_key", "_mx_class", "_mx_bucket").agg(F.count(F.lit(1)).alias("_mx_n"), F.sum("size").alias("_mx_words"))
    classes = cells.groupBy("_mx_key", "_mx_class").agg(F.array_sort(F.collect_list(F.struct("_mx_bucket", "_mx_n"))).alias("_mx_cells"), F.sum("_mx_n").alias("_mx_n"), F.sum("_mx_words").alias("_mx_words"))
    whole = classes.groupBy("_mx_key").agg(F.array_sort(F.collect_list(F.struct("_mx_class", "_mx_n", "_mx_cells"))).alias("_mx_classes"), F.sum("_mx_words").alias("source_size"))
    whole = scratch.keep(whole.withColumn("_mx_source", F.when(F.col("_mx_key") != "n", F.expr("substring(_mx_key, 2)"))), "sources")
    level = targets(whole.select("_mx_key", "_mx_source", "source_size"), weights, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_mx_key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    before = lambda xs, i: F.aggregate(F.slice(xs, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["_mx_n"])
    runs = whole.select("_mx_key", "_mx_classes", F.posexplode("_mx_classes").alias("_mx_i", "_mx_x")).select("_mx_key", F.col("_mx_x._mx_class").alias("_mx_class"), before(F.col("_mx_classes"), F.col("_mx_i")).alias("_mx_before"), F.col("_mx_x._mx_cells").alias("_mx_cells"))
    runs = runs.select("_mx_key", "_mx_class", "_mx_before", "_mx_cells", F.posexplode("_mx_cells").alias("_mx_i", "_mx_x"))
    runs = runs.select("_mx_key", "_mx_class", F.col("_mx_x._mx_bucket").alias("_mx_bucket"), (F.col("_mx_before") + before(F.col("_mx_cells"), F.col("_mx_i"))).alias("_mx_before"))
    runs = runs.join(level, "_mx_key").withColumn("_mx_u", offset)
    at = W.partitionBy("_mx_key", "_mx_class", "_mx_bucket").orderBy("size", F.col("_mx_id").asc_nulls_first(), F.col("_mx_said").asc_nulls_first())
    placed = sized.withColumn("_mx_at", F.row_number().over(at)).join(runs, ["_mx_key", "_mx_class", "_mx_bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda p: F.floor(rate * p + F.col("_mx_u"))
    p = F.col("_mx_before") + F.col("_mx_at")
    return placed.select(*[c for c in shown if c not in own], "size", "source_size", "target", (crossed(p) - crossed(p - 1)).cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as mix() says, with `copy` from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, source,
         CASE WHEN doc_id IS NULL THEN ('0x' || substr(md5(coalesce(text, '')), 1, 7))::BIGINT END AS said,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k FROM documents),
cls AS (
  SELECT *, CASE WHEN size <= {SMALL} THEN size ELSE CAST(floor(ln(size::DOUBLE) * {STEPS}) AS BIGINT) + {SMALL} END AS c,
         ((((coalesce(doc_id, said) % {MODULUS} + {MODULUS}) % {MODULUS}) * {MULTIPLIER}) % {MODULUS}) % {BUCKETS} AS h FROM sized),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c, h, size, doc_id NULLS FIRST, said NULLS FIRST) AS p FROM cls),
srcs AS (SELECT k, min(source) AS s, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k),
ranked AS (SELECT *, row_number() OVER (ORDER BY s NULLS LAST) - 1 AS r FROM srcs),
weighed AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][r % {len(WEIGHTS)} + 1] AS DOUBLE) AS w, source_size::DOUBLE * {CAP} AS cap FROM ranked),
levels AS (
  SELECT *, cap / w AS q, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM weighed),
lev AS (SELECT l FROM levels WHERE l <= q ORDER BY q, r LIMIT 1),
aimed AS (SELECT k, source_size, least(cap, w * lev.l) AS target, ('0x' || substr(md5('{SEED}:' || k), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS u FROM levels, lev),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM aimed)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate * p + u) - floor(rate * (p - 1) + u)) AS BIGINT) AS taken
FROM placed JOIN rates USING (k)
"""

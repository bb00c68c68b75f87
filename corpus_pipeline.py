"""A training corpus from `documents`, in five stages, each written and read again before the next.

1. toxicity: rejects documents at or above their language's threshold.
2. near_duplicates: keeps one row of each group, of the smallest id (five-word shingles, similarity 0.8).
3. repeated_passages: removes bytes that repeats of 200 bytes cover.
4. decontamination: rejects documents in which a benchmark item is found.
5. mixing: emits documents as often as the targets of their sources ask, with `copy` from 1.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, mixing, neardup, passages, toxicity
from lattica.llm.common import Scratch, read, released, ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under their language's threshold; the model learns from the labels of documents given."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, with null after all others.

    A document is what has one id and text: rows that repeat both are one, of which the smallest row stays;
    rows with one id and different texts, or without an id, are documents of their own.
    """
    ship(spark)
    scratch = Scratch(spark, "rows")
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    times = keyed.groupBy("_row").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("times"))
    tables = Scratch(spark, "neardup")
    found = neardup.near_duplicates(keyed.select("_row", "text"), "_row", scratch=tables).select("_row", "component_id").distinct()
    # kept as a table, so that the join that follows can split a large group
    groups = scratch.keep(found.join(times, "_row"), "groups")
    tables.drop()
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row"))["_row"].alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = groups.join(first, "component_id").where("_row <> _first").select("_row")
    left = keyed.join(gone, "_row", "left_anti")
    many = groups.where("times > 1").select("_row")
    if many.isEmpty():
        return left.select(*docs.columns)
    one = left.join(many, "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return left.join(many, "_row", "left_anti").select(*docs.columns).union(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages, n_chars counted again; no row goes."""
    ship(spark)
    cut = passages.cut(docs)
    size = F.when(F.col("_ps_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(*docs.columns)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    ship(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of each document taken."""
    ship(spark)
    return mixing.emit(mixing.mix(docs)).select(*docs.columns, "size", "source_size", "target", "copy")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", reject_contaminated),
    ("mixing", mix_sources),
]

#: SQL cannot express stages 1 and 4; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        with released():  # a stage's own tables are not needed once its rows are written
            docs = scratch.keep(stage(spark, docs, sf_dir), f"{n}-{name}")
        if n:
            scratch.drop(f"{n - 1}-{STAGES[n - 1][0]}")
    return docs

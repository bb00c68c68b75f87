"""Queries that SQL can express against it, on the smallest data; the rest against plain versions or held-out rows; and the pipeline."""

import math
import os
import random

import duckdb
import pytest

import corpus_pipeline
from lattica.llm import decontaminate, queries
from lattica.llm.common import Scratch, read, released

from .helpers import frame, prose, words


def plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    rel = con.sql(queries.SQL[name])
    names = list(rel.columns)
    assert sorted(names) == sorted(df.columns)
    got = sorted(([plain(r[c]) for c in sorted(names)] for r in df.collect()), key=repr)
    assert got == sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    n = df.count()
    if name in ("op3_toxicity", "op8_language"):
        assert n == read(spark, folder, "documents").count()
    elif name == "op5_html":
        assert n == read(spark, folder, "pages").count() and df.where("n_chars <> length(text)").count() == 0
    elif name == "op9_ann":
        assert n == 20 * read(spark, folder, "embeddings").where("vec_id % 20 = 0").count()


def test_pipeline(spark, folder):
    docs = read(spark, folder, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder).cache()
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids
        ids = kept
        if name != "mixing":
            assert docs.columns == columns
        if name == "decontamination":
            assert decontaminate.contaminated(docs, read(spark, folder, "benchmark")).count() == 0
        if name == "repeated_passages":
            assert docs.count() == before.count()
        if name == "mixing":
            assert all(r["size"] == len(words(r.text)) and r.copy <= 3 for r in docs.collect())
    before = list(Scratch.made)
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.copy) for r in got.collect()) == sorted((r.doc_id, r.copy) for r in docs.collect())
    # of what the stages wrote, the last table alone is left
    (own,) = [s for s in Scratch.made if s not in before]
    assert os.listdir(own.base.removeprefix("file://")) == ["4-mixing"]


def test_released(spark):
    """Tables made within go at the end, those of before stay, and an error leaves all."""
    held = Scratch(spark, "held")
    kept = held.keep(spark.range(3).toDF("x"), "a")
    with released():
        gone = Scratch(spark, "gone")
        assert gone.keep(kept, "b").count() == 3
    assert kept.count() == 3 and not os.path.exists(gone.base.removeprefix("file://"))
    with pytest.raises(ValueError, match="stop"), released():
        left = Scratch(spark, "left")
        left.keep(kept, "c")
        raise ValueError("stop")
    assert os.path.exists(left.path("c").removeprefix("file://"))


def test_repeated_rows_and_null_ids_through_stages(spark, folder):
    """One row of each group goes on, whole: of repeated rows, of one id with two texts, and of rows without an id."""
    rng = random.Random(15)
    t = [prose(rng, 120) for _ in range(7)]
    near = " ".join(["other", *t[4].split()[1:]])
    rows = [(1, t[0]), (1, t[0]), (2, t[0]), (3, t[1]), (None, t[1]), (None, t[2]), (None, t[2]), (4, t[3]), (4, t[5]), (None, t[4]), (None, near), (5, t[6]), (6, None), (6, None), (7, "")]
    docs = frame(spark, rows)
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats):
        docs = stage(spark, docs, folder)
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert docs.columns == frame(spark, rows).columns and len(got) == 9
        assert set(got) - {(None, t[4]), (None, near)} == {(1, t[0]), (3, t[1]), (None, t[2]), (4, t[3]), (4, t[5]), (5, t[6]), (6, None), (7, "")}


def test_stages_take_awkward_tables(spark, folder):
    """An empty table, null rows and columns that clash pass through every stage that keeps columns."""
    from pyspark.sql import functions as F

    docs = read(spark, folder, "documents").limit(60)
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "text_", "copy_", "component", "node", "hub", "k", "spans", "_v", "score")])
    null = clash.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in clash.schema])
    for given in (clash.where("false"), clash.union(null), null):
        out = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, folder)
            if name != "mixing":
                assert out.columns == given.columns
                out = out.cache()
        assert out.count() >= 0

"""Catalog of a folder of Parquet tables: orders and line items, events, texts, vectors, pages and labels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, ForeignKey, Index, Table, build, infer

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey l_linenumber l_partkey l_suppkey l_quantity", "events": "event_id", "documents": "doc_id", "labels": "doc_id",
    "embeddings": "vec_id", "pages": "page_id", "conversations": "conv_id turn", "benchmark": "item_id",
}
UNIQUE = {"nation": ["n_name"], "customer": ["c_name"], "supplier": ["s_name"], "pages": ["url"]}
INDEXED = {
    "nation": ["n_regionkey"], "customer": ["c_nationkey", "c_mktsegment", "c_acctbal"], "supplier": ["s_nationkey"], "part": ["p_brand", "p_name", "p_size", "p_retailprice"],
    "orders": ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority o_totalprice"], "lineitem": ["l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"],
    "events": ["user_id ts", "event_type"], "documents": ["lang", "n_chars", "source"], "labels": ["quality", "toxic"], "embeddings": ["label"], "conversations": ["role"],
}
FOREIGN = {
    "nation": [("n_regionkey", "region", "r_regionkey")], "customer": [("c_nationkey", "nation", "n_nationkey")], "supplier": [("s_nationkey", "nation", "n_nationkey")],
    "orders": [("o_custkey", "customer", "c_custkey")], "events": [("user_id", "customer", "c_custkey")], "labels": [("doc_id", "documents", "doc_id")],
    "lineitem": [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")],
}


def _table(name: str, df: DataFrame) -> Table:
    indexes = [Index(f"uq_{c}", (c,), unique=True) for c in UNIQUE.get(name, ())] + [Index(f"ix_{c.replace(' ', '_')}", tuple(c.split())) for c in INDEXED.get(name, ())]
    if name == "embeddings":
        indexes.append(Index("vx_embedding", ("embedding",), vector=True))
    out = infer(name, df, KEYS[name].split(), indexes=tuple(indexes), foreign_keys=tuple(ForeignKey((a,), ("", t), (b,)) for a, t, b in FOREIGN.get(name, ())))
    if name == "embeddings":
        out = replace(out, columns=tuple(replace(c, dim=64) if c.name == "embedding" else c for c in out.columns))
    return out


def catalog(spark: SparkSession, folder: str, junctions: bool = True) -> Catalog:
    """The tables, and two junctions of part and supplier: part_supplier holds their pairs, supply adds quantity and lines."""
    read = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES}
    if junctions:
        read["part_supplier"] = read["lineitem"].select("l_partkey", "l_suppkey").distinct()
        read["supply"] = read["lineitem"].groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n_lines"))
    tables = [_table(t, read[t]) for t in TABLES]
    if junctions:
        to = (ForeignKey(("l_partkey",), ("", "part"), ("p_partkey",)), ForeignKey(("l_suppkey",), ("", "supplier"), ("s_suppkey",)))
        for name in ("part_supplier", "supply"):
            tables.append(infer(name, read[name], ("l_partkey", "l_suppkey"), foreign_keys=to, indexes=(Index("ix_supp", ("l_suppkey",)),)))
    return build(tables, {("", t): (lambda df=df: df) for t, df in read.items()})

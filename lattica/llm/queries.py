"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html, language, licenses, mixing, neardup, passages, toxicity, warc
from .common import Scratch, read, ship


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, on 4-word shingles at 0.8: doc_id, n_shingles, component_id, kept."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), k=4)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the default weights: doc_id, size, source_size, target, taken."""
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 200-byte repeats cover: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    cut = passages.cut(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("_ps_bytes").alias("n_bytes"), F.col("_ps_removed").alias("n_removed"), F.col("_ps_spans").alias("n_spans"), F.col("_ps_sha256").alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity: doc_id, held_out, score, predicted."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages: page_id, url, text, n_chars."""
    return html.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which a benchmark item is found: doc_id, item_id, cosine, lcs, answer, kind."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = Scratch(spark, "warc").path("archive")
    warc.write_warc(warc.to_records(read(spark, sf_dir, "pages")), path)
    back = warc.read_warc(spark, path, payload="response")
    whole = F.col("payload").isNotNull()  # responses: measured on what the archive holds
    size = F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score, shares."""
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "shares")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each embedding whose id is divisible by 20, among all others: query_id, rank, vec_id, score."""
    return ann.neighbours(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license of every document, its own or inherited: doc_id, path, license, origin, score, inherited_from."""
    path, opens = licenses.document_path()
    return licenses.scan(read(spark, sf_dir, "documents"), path, opens)


QUERIES = {"op1_neardup": op1_neardup, "op2_passages": op2_passages, "op3_toxicity": op3_toxicity, "op4_mixing": op4_mixing, "op5_html": op5_html, "op6_decontaminate": op6_decontaminate, "op7_warc": op7_warc, "op8_language": op8_language, "op9_ann": op9_ann, "op10_licenses": op10_licenses}
#: The duplicate links of whole texts by brute force over shared shingles, then the closure.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
posts AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM posts a JOIN posts b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sets s JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, s.s
"""

OP2_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
l AS (SELECT doc_id, [md5(x[p:p + 199]) for p in range(1, octet_length(x) - 198)] AS hs FROM b WHERE octet_length(x) >= 200),
w AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS p FROM l),
d AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
i AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM d),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 200 AS e FROM g GROUP BY doc_id, k),
cuts AS (SELECT doc_id, k, e AS f, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY k), 9223372036854775807) AS t FROM s
         UNION ALL SELECT b.doc_id, 0, 1, coalesce(min(a), 9223372036854775807) FROM b LEFT JOIN s USING (doc_id) GROUP BY b.doc_id),
kept AS (SELECT c.doc_id, string_agg(hex(CASE WHEN f > octet_length(x) OR t <= f THEN ''::BLOB ELSE x[f:least(t - 1, octet_length(x))] END), '' ORDER BY k) AS hx FROM cuts c JOIN b USING (doc_id) GROUP BY c.doc_id),
r AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT b.doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(hx)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN r USING (doc_id)
"""

OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS m FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m = page_id THEN NULL ELSE m END AS refers_to FROM f
"""

SQL = {"op1_neardup": OP1_SQL, "op2_passages": OP2_SQL, "op4_mixing": mixing.SQL, "op7_warc": OP7_SQL, "op10_licenses": licenses.SQL}


def queries() -> dict:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    return {k: shipped(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""License scans with DataFrame functions only.

Texts are cut into sentences and lines; those with a licence signal, alone and with the WINDOW - 1 that
follow, and whole licence files, are compared with license templates (whole texts of short licenses, titles and
notices of long ones) by sparse TF-IDF cosine. An SPDX tag names its license itself, known here or not, with a
score of 1. Document frequencies of template words are counted over all documents; words that no template has
count with the largest weight, so prose around a mention lowers its cosine. A file keeps the best license at MATCH
or above; one without takes that of the nearest ancestor directory (its own first) that holds a licence file, by
joins of directory paths.

Texts are read once: what is cut from them, and which template words they have, is written to the shared folder
under a number for each row, which all later steps use instead of the id. What is broadcast has a row for each
word, or word and template, at most; templates are an argument.

Edge cases: null or empty texts have no license of their own, but inherit; a null id is an id like any other, and
rows that repeat an id are files of their own; a null path belongs to no directory and inherits nothing; ties go to
the license first by name; of several licence files in one directory the best match counts; very long texts are
read whole; an empty table gives an empty result. Other columns are dropped; only id, text and path are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .license_texts import TEMPLATES

MATCH, WINDOW = 0.6, 3
SIGNAL = r"(?i)licen[cs]e|copyright|spdx|public domain|permission (?:is hereby|to use|is granted)|redistribution and use|all rights reserved|free software|source code form|provided 'as-is'"
#: The identifier of an SPDX tag; RE2 and Java read both patterns alike.
SPDX = r"(?i)SPDX-License-Identifier:\s*([a-z0-9][a-z0-9.+-]*[a-z0-9+])"
_TOKEN = "[a-z0-9]+"

Templates = tuple[tuple[str, str], ...]


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def vocabulary(templates: Templates = TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in tokens(t)})


def _words(templates: Templates) -> str:
    return ", ".join(f"('{w}')" for w in vocabulary(templates))


def _postings(templates: Templates) -> str:
    return ", ".join(f"({n}, '{name}', '{w}', {tokens(t).count(w)})" for n, (name, t) in enumerate(templates) for w in sorted(set(tokens(t))))


def cut(files: DataFrame, path: Column, is_license_file: Column, id_col: str, text_col: str, templates: Templates = TEMPLATES) -> DataFrame:
    """Each file's number, id, path, directory, whether it is a licence file, template words it has, SPDX tags, and what is compared."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(F.regexp_replace("_ls_text", r"([.!?])[ \t\r]+", "$1\n"), r"\n+")
    seen = lambda x, i: F.when(x.rlike(SIGNAL), F.struct(i.alias("i"), F.array(x, F.array_join(F.slice("_ls_s", i + 1, WINDOW), " ")).alias("x"), F.regexp_extract(x, SPDX, 1).alias("tag")))
    base = files.select(F.col(id_col).alias("_ls_id"), text.alias("_ls_text"), path.alias("_ls_path"), F.coalesce(is_license_file, F.lit(False)).alias("_ls_whole"))
    base = base.withColumn("_ls_s", lines).withColumn("_ls_dir", F.when(F.col("_ls_path").isNotNull(), F.regexp_extract("_ls_path", "^(.*)/[^/]*$", 1)))
    has = F.array_intersect(F.split(F.lower("_ls_text"), "[^a-z0-9]+"), F.array(*map(F.lit, vocabulary(templates))))
    near = F.filter(F.transform("_ls_s", seen), lambda x: x.isNotNull())
    return base.select(F.monotonically_increasing_id().alias("_ls_row"), "_ls_id", "_ls_path", "_ls_dir", "_ls_whole", has.alias("_ls_words"), near.alias("_ls_near"), F.when(F.col("_ls_whole"), F.col("_ls_text")).alias("_ls_all"))


def own_licenses(base: DataFrame, scratch: Scratch, match: float = MATCH, templates: Templates = TEMPLATES) -> DataFrame:
    """Of a table of cut(): a row for each file with a license of its own: _ls_row, license, score."""
    spark = base.sparkSession
    known = spark.sql(f"SELECT col1 AS w FROM VALUES {_words(templates)}")
    df = base.select(F.explode("_ls_words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(float(base.count()))
    top = F.log(n + 1) + 1  # of words that no template has
    words = scratch.keep(known.join(df, "w", "left").select("w", (F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")).coalesce(1), "words")
    postings = spark.sql(f"SELECT col1 AS t, col2 AS license, col3 AS w, col4 AS c FROM VALUES {_postings(templates)}").join(F.broadcast(words), "w").select("t", "license", "w", (F.col("c") * F.col("idf") * F.col("idf")).alias("tw2"), F.pow(F.col("c") * F.col("idf"), 2).alias("sq"))
    postings = scratch.keep(postings.coalesce(1), "postings")
    norms = postings.groupBy("t").agg(F.sqrt(F.sum("sq")).alias("tn"))

    tagged = base.select("_ls_row", F.explode("_ls_near").alias("p")).where("p.tag <> ''").select("_ls_row", F.col("p.tag").alias("license"), F.lit(1.0).alias("score"))
    found = base.select("_ls_row", F.explode("_ls_near").alias("p")).where("p.tag = ''").select("_ls_row", F.col("p.i").alias("i"), F.posexplode("p.x").alias("k", "x"))
    found = found.union(base.where("_ls_all is not null").select("_ls_row", F.lit(-1).alias("i"), F.lit(0).alias("k"), F.col("_ls_all").alias("x")))
    terms = found.select("_ls_row", "i", "k", F.explode(F.regexp_extract_all(F.lower("x"), F.lit(_TOKEN), F.lit(0))).alias("w"))
    terms = scratch.keep(terms.groupBy("_ls_row", "i", "k", "w").agg(F.count(F.lit(1)).alias("tf")), "terms")
    norm = terms.join(F.broadcast(words), "w", "left").groupBy("_ls_row", "i", "k").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", top), 2))).alias("dn"))
    dots = terms.join(F.broadcast(postings), "w").groupBy("_ls_row", "i", "k", "t", "license").agg(F.sum(F.col("tf") * F.col("tw2")).alias("dot"))
    scored = dots.join(F.broadcast(norms), "t").join(norm, ["_ls_row", "i", "k"]).select("_ls_row", "license", F.round(F.col("dot") / (F.col("dn") * F.col("tn")), 6).alias("score")).where(F.col("score") >= match)
    best = scored.union(tagged).groupBy("_ls_row").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("_ls_row", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, path: Column, is_license_file: Column, id_col: str = "doc_id", text_col: str = "text", match: float = MATCH, templates: Templates = TEMPLATES) -> DataFrame:
    """A row per file: id, path, license, origin (own, inherited or none), score of an own license, inherited_from (a directory)."""
    scratch = Scratch(files.sparkSession, "licenses")
    base = scratch.keep(cut(files, path, is_license_file, id_col, text_col, templates), "cut")
    own = own_licenses(base, scratch, match, templates)
    slim = scratch.keep(base.select("_ls_row", "_ls_id", "_ls_path", "_ls_dir", "_ls_whole").join(own, "_ls_row", "left"), "slim")
    holders = slim.where(F.col("_ls_whole") & F.col("license").isNotNull() & F.col("_ls_dir").isNotNull()).groupBy(F.col("_ls_dir").alias("up")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license"))["license"].alias("up_license"))
    parts = F.split("_ls_dir", "/")
    dirs = slim.where("_ls_dir is not null").groupBy("_ls_dir").agg(F.count(F.lit(1)).alias("_"))
    up = dirs.select("_ls_dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("up")))).alias("u")).select("_ls_dir", "u.depth", "u.up")
    nearest = up.join(holders, "up").groupBy("_ls_dir").agg(F.max(F.struct("depth", "up", "up_license")).alias("h")).select("_ls_dir", F.col("h.up").alias("up"), F.col("h.up_license").alias("up_license"))
    # kept as a table, so that the join can split a common directory
    out = slim.join(scratch.keep(nearest, "nearest"), "_ls_dir", "left")
    has, inherits = F.col("license").isNotNull(), F.col("license").isNull() & F.col("up").isNotNull()
    return out.select(F.col("_ls_id").alias(id_col), F.col("_ls_path").alias("path"), F.coalesce("license", "up_license").alias("license"), F.when(has, "own").when(inherits, "inherited").otherwise("none").alias("origin"), "score", F.when(inherits, F.col("up")).alias("inherited_from"))


# How the query names documents, which have no paths: three levels of directories, and LICENSE for those that open with a license.
_OPENS = r"^[^\n]*[Ll]icen[cs]e"


def document_path(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[Column, Column]:
    i = F.col(id_col)
    opens = F.coalesce(F.col(text_col).rlike(_OPENS), F.lit(False))
    where = F.concat_ws("/", F.coalesce(F.col(source_col), F.lit("unknown")), F.floor(i / 1000).cast("string"), F.floor(i / 50).cast("string"))
    return F.concat(where, F.lit("/"), F.when(opens, F.concat(F.lit("LICENSE."), i.cast("string"))).otherwise(F.concat(i.cast("string"), F.lit(".txt")))), opens


_QUOTED = SIGNAL.replace("'", "''")
SQL = rf"""
WITH voc(w) AS (VALUES {_words(TEMPLATES)}),
post(t, license, w, c) AS (VALUES {_postings(TEMPLATES)}),
f AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(regexp_matches(text, '{_OPENS}'), false) AS whole,
        coalesce(source, 'unknown') || '/' || floor(doc_id / 1000)::BIGINT || '/' || floor(doc_id / 50)::BIGINT AS dir FROM documents),
nn AS (SELECT count(*)::DOUBLE AS n FROM f),
docwords AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(x), '{_TOKEN}')) AS w FROM f),
df AS (SELECT voc.w, count(doc_id) AS df FROM voc LEFT JOIN docwords USING (w) GROUP BY voc.w),
idf AS (SELECT w, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, nn),
tpl AS (SELECT t, license, w, idf, c * idf AS tw FROM post JOIN idf USING (w)),
tn AS (SELECT t, sqrt(sum(tw * tw)) AS tn FROM tpl GROUP BY t),
cut AS (SELECT doc_id, string_split_regex(regexp_replace(x, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), '\n+') AS s FROM f),
seg AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM cut),
sig AS (SELECT doc_id, i, s, regexp_extract(s[i], '{SPDX}', 1) AS tag FROM seg WHERE regexp_matches(s[i], '{_QUOTED}')),
win AS (SELECT doc_id, i, 0 AS k, s[i] AS x FROM sig WHERE tag = ''
  UNION ALL SELECT doc_id, i, 1, array_to_string(s[i:i + {WINDOW - 1}], ' ') FROM sig WHERE tag = ''
  UNION ALL SELECT doc_id, 0, 0, x FROM f WHERE whole),
tok AS (SELECT doc_id, i, k, unnest(regexp_extract_all(lower(x), '{_TOKEN}')) AS w FROM win),
tf AS (SELECT doc_id, i, k, w, count(*) AS tf FROM tok GROUP BY ALL),
dn AS (SELECT doc_id, i, k, sqrt(sum((tf * coalesce(idf, ln(n + 1) + 1)) ** 2)) AS dn FROM tf LEFT JOIN idf USING (w), nn GROUP BY ALL),
dots AS (SELECT doc_id, i, k, t, license, sum(tf * idf * tw) AS dot FROM tf JOIN tpl USING (w) GROUP BY ALL),
sc AS (SELECT doc_id, license, round(dot / (dn * tn), 6) AS score FROM dots JOIN dn USING (doc_id, i, k) JOIN tn USING (t)),
every AS (SELECT doc_id, license, score FROM sc WHERE score >= {MATCH} UNION ALL SELECT doc_id, tag, 1.0::DOUBLE FROM sig WHERE tag <> ''),
own AS (SELECT doc_id, license, score FROM every QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
a AS (SELECT f.doc_id, f.dir, f.whole, own.license, own.score FROM f LEFT JOIN own USING (doc_id)),
hold AS (SELECT dir AS up, license AS up_license FROM a WHERE whole AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
dirs AS (SELECT DISTINCT dir, string_split(dir, '/') AS p FROM f),
ups AS (SELECT dir, d, array_to_string(p[1:d], '/') AS up FROM (SELECT dir, p, unnest(range(1, len(p) + 1)) AS d FROM dirs)),
near AS (SELECT dir, up, up_license FROM ups JOIN hold USING (up) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY d DESC) = 1)
SELECT doc_id, dir || '/' || CASE WHEN whole THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS path, coalesce(license, up_license) AS license,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN up IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, score,
  CASE WHEN license IS NULL THEN up END AS inherited_from
FROM a LEFT JOIN near USING (dir)
"""

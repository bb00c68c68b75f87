"""Small corpora with every awkward row, and plain versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, k string, m int, spans string"


def words(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=1, n=60):
    """(doc_id, text): fresh texts, exact and near copies, shared passages, and rows without anything."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    shared = prose(rng, 70)
    out = [(0, base), (1, base), (2, base.upper())]
    for i in range(3, 14):  # near copies with more and more words changed
        w = base.split()
        for _ in range(i - 2):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    out += [(i, prose(rng, rng.randrange(5, 80)) + " " + shared + " " + prose(rng, rng.randrange(5, 80))) for i in range(14, 24)]
    out += [(24, None), (25, ""), (26, " \t\n"), (27, "one two"), (28, "one two"), (29, "One TWO"), (30, "a " * 3000), (31, "é" * 150 + " ü"), (32, "日本語 " * 90), (33, "12 34 !!"), (34, prose(rng, 6000))]
    out += [(i, prose(rng, rng.randrange(1, 200))) for i in range(35, n)]
    return out + [(None, "no id here at all"), (40, dict(out)[40]), (40, dict(out)[40])]


def frame(spark, rows, sources=("s1", "s2", None)):
    """With columns that operators use as names of their own."""
    return spark.createDataFrame([(i, t, ("en", "de", None)[n % 3], sources[n % len(sources)], None if t is None else len(t), n, "k", n, "z") for n, (i, t) in enumerate(rows)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)

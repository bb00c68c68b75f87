import random

import numpy as np
import pytest

from lattica.llm import language, toxicity

from .helpers import documents, empty, frame, prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    bad = ["vileword", "nastyone", "grimterm"]
    rows, labels = [], []
    for i in range(500):
        w = prose(rng, rng.randrange(5, 60)).split()
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, None if i % 97 == 0 else int(toxic)))
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, 0)], "doc_id long, toxic int")


def test_toxicity_held_out(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = {r.doc_id for r in docs.where(toxicity.held_out()).select("doc_id").collect()}
    right = [(got[i] >= 0.3) == (i % 5 == 0) for i in held]
    assert len(held) > 80 and np.mean(right) > 0.95
    again = toxicity.train(docs, labels, ~toxicity.held_out())
    assert {r.doc_id: r.score for r in toxicity.score(docs, again).collect()} == got


def test_toxicity_awkward_rows(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    rows = documents()
    got = toxicity.score(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (24, 25, 26)}
    assert len(blank) == 1 and blank.pop() < 0.3
    kept = toxicity.keep_clean(frame(spark, rows), model)
    assert kept.columns == docs.columns and kept.count() >= len(rows) - 2
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_without_both_labels(spark, labelled):
    docs, labels = labelled
    for some, expected in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.where("false"), 0.0)):
        assert {r.score for r in toxicity.score(docs.limit(5), toxicity.train(docs, some)).collect()} == {expected}


def test_long_text_needs_one_word(spark, labelled):
    """Words never seen add nothing, so length alone is not toxic, and one word in a long text is found."""
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    long = prose(random.Random(9), 20000, 10**9)
    got = [r.score for r in toxicity.score(frame(spark, [(1, long), (2, long + " vileword")]), model).collect()]
    assert got[0] < 0.3 <= got[1]


LANGUAGES = {"aa": "kala mola tiki rapa sona", "bb": "stren grulk bloft wrench plimp", "cc": "éà ñoé üßa çîo òùé"}


def text(rng, code, n):
    return " ".join(rng.choice(LANGUAGES[code].split()) + rng.choice("aeiou") for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(6)
    rows = [(text(rng, c, rng.randrange(3, 40)), c) for c in LANGUAGES for _ in range(60)] + [("nothing", None), (None, "aa")]
    return language.train(spark.createDataFrame(rows, "text string, lang string"))


def test_language_pure_and_mixed(spark, model):
    rng = random.Random(7)
    rows = [(i, text(rng, c, 12), c) for i, c in enumerate(["aa", "bb", "cc"] * 10)]
    mixed = [(100, text(rng, "aa", 60) + " " + text(rng, "bb", 20), "aa")]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i].lang_pred == c and got[i].score > 0.9 and len(got[i].shares) == 1 for i, _, c in rows)
    m = got[100]
    assert m.lang_pred == "aa" and set(m.shares) == {"aa", "bb"} and abs(m.shares["bb"] - 0.25) < 0.05 and abs(m.score - 0.75) < 0.05


def test_language_awkward_rows(spark, model):
    rows = documents()
    got = language.predict(frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        t = [x for i, x in rows if i == r.doc_id][0]
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    assert language.predict(empty(spark), model).count() == 0
    nothing = language.train(empty(spark))
    assert {r.lang_pred for r in language.predict(frame(spark, rows), nothing).collect()} == {"und"}


def test_language_of_many(spark):
    """A document in all of five languages has all five shares, next to documents in one and two."""
    rng = random.Random(8)
    own = {c: [f"{c}{x}{c}" for x in ("ka", "lo", "mi", "tu")] for c in ("qa", "wb", "xc", "yd", "ze")}
    say = lambda c, n: " ".join(rng.choice(own[c]) for _ in range(n))
    model = language.train(spark.createDataFrame([(say(c, 20), c) for c in own for _ in range(20)], "text string, lang string"))
    rows = [(1, " ".join(say(c, 40) for c in own)), (2, say("xc", 40)), (3, say("ze", 40) + " " + say("qa", 20))]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert set(got[1].shares) == set(own) and all(abs(x - 0.2) < 0.02 for x in got[1].shares.values()) and abs(got[1].score - 0.2) < 0.02
    assert set(got[2].shares) == {"xc"} and set(got[3].shares) == {"ze", "qa"}


def test_em_finds_the_maximum(model):
    """Shares found by EM against a search over a grid."""
    rng = np.random.default_rng(0)
    p = np.exp(rng.normal(0, 2, (50, 3))).astype(np.float32)
    pi, ll = language._em(p, np.array([0]), np.array([50]), np.full((1, 3), 1 / 3), rounds=300)
    best = max(float(np.log(p @ np.array([a, b, 1 - a - b])).sum()) for a in np.linspace(0, 1, 51) for b in np.linspace(0, 1, 51) if a + b <= 1)
    assert ll[0] >= best - 1e-3 and abs(pi.sum() - 1) < 1e-6


def test_scores_are_those_of_a_plain_network(spark, labelled):
    """Every window of every filter over looked-up embeddings, word by word, against scores of whole batches."""
    import math

    import pyarrow as pa

    docs, labels = labelled
    model = toxicity.train(docs, labels)
    texts = [r.text for r in docs.limit(25).collect()] + ["", "one", "vileword", "vileword nastyone x"]
    got = [r.score for r in toxicity.score(frame(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()]
    mask = (1 << toxicity.BITS) - 1
    for text, score in zip(texts, got, strict=True):
        (_, h, _), = toxicity.word_ids(pa.array([text]))
        rows = [[v for table, index, (c, s) in zip(model.table, model.index, toxicity.PLACES, strict=True) for v in table[index[(int(w[c]) >> s) & mask]]] for w in h]
        rows += [[0.0] * toxicity.WIDE] * toxicity.PAD
        z = model.bias
        n = 0
        for width, kernel, shift in zip(toxicity.WIDTHS, model.kernel, model.shift, strict=True):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(rows[at + d][e]) * float(kernel[toxicity.WIDE * d + e, f]) for d in range(width) if at + d < len(rows) for e in range(toxicity.WIDE)) for at in range(len(rows)))
                z += max(best + float(shift[f]), 0.0) * float(model.out[n])
                n += 1
        assert math.isclose(score, 1 / (1 + math.exp(-(model.scale[0] * z + model.scale[1]))), abs_tol=2e-4)


def test_toxicity_of_the_given_labels(spark, folder):
    """Held-out rows of the given documents, told apart by a model that never saw them."""
    from lattica.llm.common import read

    big = folder.replace("0.001", "0.01")
    docs, labels = read(spark, big, "documents"), read(spark, big, "labels")
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    got = toxicity.score(docs.where(toxicity.held_out()), model).join(labels, "doc_id").where("toxic is not null").collect()
    hit = np.array([r.score for r in got if r.toxic])
    miss = np.array([r.score for r in got if not r.toxic])
    assert len(hit) > 5 and (hit[:, None] > miss[None]).mean() > 0.7 and (miss >= 0.3).mean() < 0.1


def test_language_of_words_added_one_by_one(spark, model):
    """Predictions of documents in one language against trigram sums word by word, for each language alone."""
    import pyarrow as pa

    from lattica.llm.textvec import buffers

    rng = random.Random(12)
    rows = [(i, text(rng, c, rng.randrange(1, 30))) for i, c in enumerate(["aa", "bb", "cc"] * 12)]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        data, off = buffers(pa.array([t]))
        g, start, _ = language.trigrams(data, off, 0, 1)
        total = [0.0] * len(model.languages)
        for a, b in zip(start, [*start[1:], len(g)], strict=True):
            for k in range(len(total)):
                total[k] += sum(float(model.logp[x, k]) for x in g[a:b])
        assert got[i].lang_pred == model.languages[int(np.argmax(total))]


def test_language_refuses_too_many(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        language.train(spark.createDataFrame([("a b", f"l{i}") for i in range(5)], "text string, lang string"))


def test_language_held_out_accuracy(spark, folder):
    from lattica.llm.common import read

    docs = read(spark, folder.replace("0.001", "0.01"), "documents")
    model = language.train(docs.where(~language.held_out()))
    got = language.predict(docs.where(language.held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95

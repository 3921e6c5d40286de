"""Toxicity: held-out accuracy, and scores that do not depend on what must not be an input."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity

PLAIN = "the of and river stone walks over green hills with an open book near old house some water light".split()


def corpus(n=600, seed=3):
    rng, out = random.Random(seed), []
    for i in range(n):
        words, toxic = [rng.choice(PLAIN) for _ in range(rng.randint(5, 60))], i % 3 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["you idiot", "M0RON!", "zorbling", "zorblings"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    data = corpus()
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in data] + [(9000, None, "fr", 0.0), (9001, "", "fr", 0.0), (None, "x " * 100_000, "", 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in data] + [(5, None, 1), (9000, 0, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_held_out_accuracy_and_odd_rows(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(i, y) for i, _, y in corpus() if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= 0.5) == y for i, y in held])
    assert right > 0.95 and len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    assert got[9000] == got[9001] < 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_labels_of_the_held_out_fold_change_nothing(tables, spark):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    texts = ["you idiot", "green river", "zorbling"]
    assert toxicity.fit(docs, labels).score(texts).tolist() == toxicity.fit(docs, flipped).score(texts).tolist()


def test_without_labels(spark, tables):
    docs = tables[0]
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_isotonic_is_the_least_squares_step_fit():
    x, p = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4, 5, 6], x, p).tolist() == [0, 0.5, 0.5, 0.5, 0.5, 1]


def plain_features(text, lexicons):
    """The features by their definitions, a word at a time."""
    import math
    import re

    words = re.findall(r"[^\W_]+(?:[*@$!|'’][^\W_]+)*", text)
    low = re.findall(r"[^\W_]+(?:[*@$!|'’][^\W_]+)*", text.lower())
    n, chars = max(1, len(low)), max(1, len(text))
    plain = [w if w.isalpha() else "".join({"*": "", "'": ""}.get(c, dict(zip("013457@$!|", "oieastasil", strict=True)).get(c, c)) for c in w) for w in low]
    fixed = [p in toxicity.FIXED for p in plain]
    word = [lexicons.words.get(p, 0.0) for p in plain]
    start = [max([lexicons.starts.get(p[:k], 0.0) for k in (5, 7) if len(p) > k], default=0.0) for p in plain]
    hit = [bool(a or b or c) for a, b, c in zip(fixed, word, start, strict=True)]
    near = sum(h and any(low[j] in toxicity.SECOND_PERSON for j in range(max(0, i - 5), min(len(low), i + 6))) for i, h in enumerate(hit))
    marks = text.count("!") + text.count("?")
    return [
        100 * sum(fixed) / n, sum(fixed), 100 * sum(w > 0 for w in word) / n, sum(w > 0 for w in word), max(word, default=0), 100 * sum(s > 0 for s in start) / n, sum(s > 0 for s in start),
        max(start, default=0), 100 * near / n, sum("A" <= c <= "Z" for c in text) / chars, sum(len(w) > 1 and w.isupper() for w in words) / n, (marks + sum(map(text.count, ".,;:"))) / chars,
        100 * marks / n, 100 * len(re.findall(r"[^\W\d_][0-9*@$!|]+[^\W\d_]", text)) / n, sum(p != w and (f or v > 0) for p, w, f, v in zip(plain, low, fixed, word, strict=True)),
        len(re.findall(r"[^\W\d_]\d+|\d+[^\W\d_]", text)) / n, math.log1p(len(low)),
    ]


def test_features_equal_their_definitions():
    lexicons = toxicity.Lexicons([(0, "zorbling", (0, 9, 0, 9, 1, 0, 0, 9)), (1, "quark", (0, 9, 0, 9, 0, 0, 9, 9)), (0, "rare", (0, 2, 0, 2, 0, 0, 0, 0))], [[50, 20]] * 4, (0, 1, 2, 3))
    assert set(lexicons.words) == {"zorbling"} and set(lexicons.starts) == {"quark"}
    rng = random.Random(8)
    bits = ["you", "your", "idiot", "M0RON!", "m*ron", "zorbling", "quarkish", "quark", "it's", "ÉTÉ", "a1b2", "!!", "?", "x_y", "STOP", "tu", "n00b", "."]
    for text in ["", " ", *(" ".join(rng.choice(bits + PLAIN) for _ in range(rng.randint(1, 60))) for _ in range(60))]:
        assert lexicons.features(text) == pytest.approx(plain_features(text, lexicons))


def test_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (120, 4)).astype(float)
    y = ((x[:, 2] > 4) ^ (rng.random(120) < 0.1)).astype(float)
    tree = toxicity.Trees(x, y, rounds=1, depth=1, least=10)
    g = y - y.mean()
    h = np.full(len(y), y.mean() * (1 - y.mean()))
    best = {}
    for f in range(4):
        for v in np.unique(x[:, f])[1:]:
            left = x[:, f] < v
            if 10 <= left.sum() <= 110:
                best[f, v] = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
    f, v = max(best, key=best.get)
    t = tree.trees[0]
    assert (int(t[0, 0]), tree.edges[f][int(t[0, 1])]) == (f, v)
    left = x[:, f] < v
    assert tree.raw(x) == pytest.approx(tree.base + 0.15 * np.where(left, g[left].sum() / (h[left].sum() + 1), g[~left].sum() / (h[~left].sum() + 1)))


def test_features_of_rows_come_from_the_other_cells(spark, tables):
    """The counts that lexicons are chosen by, against a count on the driver."""
    sample = toxicity.labelled(*tables, 10_000, 1 << 30)
    rows = sample.collect()
    all_rows = [[sum(r["cell"] == c and r["toxic"] == y for r in rows) for y in (0, 1)] for c in range(4)]
    every = (0, 1, 2, 3)
    seen = {(w, e): n for w, e, n in toxicity.presence(sample, all_rows, {every})}
    for (which, entry), n in seen.items():
        found = lambda t: {w[:k] for w in set(toxicity.tokens(t.lower())) for k in (5, 7) if len(w) > k} if which else set(toxicity.tokens(t.lower()))  # noqa: B023, E731
        assert n == tuple(sum(r["cell"] == c and r["toxic"] == y and entry in found(r["text"]) for r in rows) for c in every for y in (0, 1))
    assert {(0, "zorbling"), (1, "zorbl")} <= set(seen)


def test_repeated_rows_and_a_bound_on_bytes(spark, tables):
    docs, labels = tables
    twice = docs.union(docs)
    model = toxicity.fit(twice, labels, size=4_000)
    got = toxicity.score_toxicity(twice, model).groupBy("doc_id").agg({"score": "min", "*": "count"}).collect()
    assert len(got) == 603 and {r["count(1)"] for r in got} == {2}

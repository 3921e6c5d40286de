"""Near-duplicate join against brute force over all pairs."""

import os
import random
import re
from urllib.parse import urlparse

import numpy as np
import pytest

from tessera.llm import common, neardup


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(docs, size, percent):
    sets = []
    for doc, text in docs:
        w = words_of(text)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = docs[i][0], docs[j][0]
            if a is not None and b is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted(((d, len(s), None if d is None else root(d)) for (d, _), s in zip(docs, sets, strict=True)), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghÉé") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    docs, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 80, 200]))]
            if rng.random() < 0.4:
                w[2:2] = passage
        texts.append(w)
        docs.append((i * 3, rng.choice([" ", "\n", " \t"]).join(w)))
    star = [rng.choice(vocabulary) for _ in range(90)]
    for i in range(40):  # a group of near copies, and exact ones
        w = list(star)
        w[i * 2] = f"edit{i // 2}"
        docs.append((1000 + i, " ".join(w).upper() if i % 2 else " ".join(w)))
    return docs + [(5001, None), (5002, ""), (5003, " \n"), (5004, "one"), (5005, "ONE "), (5006, "one two"), (None, docs[0][1]), (0, docs[0][1]), (5007, "x y z w v " * 9000), (5008, "x y z w v " * 8000)]


@pytest.mark.parametrize(("seed", "size", "percent", "block", "block_shingles"), [(1, 4, 85, 2048, 1 << 20), (2, 5, 80, 7, 1 << 20), (3, 4, 85, 16, 100)])
def test_components_equal_brute_force(spark, monkeypatch, seed, size, percent, block, block_shingles):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block_shingles)
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, b"") for i, t in docs], "doc_id long, text string, n int, prefix binary")
    got = neardup.near_duplicates(df, size, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, size, percent)


def test_long_documents_whose_points_have_unlike_numbers_of_groups(spark):
    rng, docs = random.Random(8), []
    vocabulary = [f"w{i}" for i in range(12)]  # few words, so that unlike documents share many shingles
    for n in (480, 530, 990, 1100, 2000, 2200, 4000, 4300, 18000):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for edits in (0, n // 130, n // 45, n // 20):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(["x", "y"])
            docs += [(len(docs), " ".join(w)), (len(docs) + 1, " ".join(w + [rng.choice(vocabulary) for _ in range(n // 12)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = neardup.near_duplicates(df, 4, 85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, 4, 85)


def test_points_bound_the_overlap():
    rng = random.Random(9)
    for n in (300, 520, 1500, 9000):
        a = neardup.shingles(" ".join(str(rng.randrange(400)) for _ in range(n)).encode(), 2)
        b = neardup.np.unique(neardup.np.concatenate([a[: len(a) * 9 // 10], neardup.shingles(" ".join(str(rng.randrange(400)) for _ in range(n // 8)).encode(), 2)]))
        x, y = neardup.group_counts(a), neardup.group_counts(b)
        groups = min(len(x), len(y))
        least = neardup.np.minimum(neardup.folded(x[None], groups), neardup.folded(y[None], groups)).astype(int)
        assert least.sum() >= len(neardup.np.intersect1d(a, b)) and least.max() < neardup.FULL


def test_one_of_each_group_stays(spark):
    docs = corpus(4)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    kept = neardup.keep_one_of_each(df)
    want = sorted(str(d) for (d, _, c) in brute(docs, 5, 80) if d == c)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_rows_with_one_id_and_different_texts_bridge(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (3, b)], "doc_id long, text string")
    assert {tuple(r) for r in neardup.near_duplicates(df, 4, 85).select("doc_id", "component_id").collect()} == {(1, 1), (5, 1), (9, 1), (3, 1)}


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [500, 1000, 4000, 8000, 15000])
def test_points_part_unlike_sets(n):
    """Sets of shingles of their own: were their bounds enough, they would be clusters that grow with the corpus."""
    rng = np.random.default_rng(n)
    points = np.stack([neardup.group_counts(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))) for _ in range(40)])
    assert not list(neardup.tree_pairs(points, np.full(40, n), 80, neardup.Forest(40), np.arange(40)))


def test_tables_of_shingles_go(spark, monkeypatch):
    made = []
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "cut", lambda df: made.append(common.cut(df)) or made[-1])
    docs = [(i, " ".join(f"w{(i % 3, j)}" for j in range(60)) + f" end{i}") for i in range(60)]
    assert neardup.keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).count() == 3
    cut = {c for t in made for c in t.columns}
    left = {c for t in made if os.path.exists(urlparse(t.inputFiles()[0]).path) for c in t.columns}
    assert {"prefix", "point", "found"} <= cut and not {"prefix", "point", "found"} & left


def test_filter_of_ids_lets_all_pass_that_it_holds(spark):
    ids = spark.createDataFrame([(i,) for i in (-5, 0, 7, 1 << 40, None)], "id long")
    held = common.may_hold(ids)
    rows = spark.createDataFrame([(i,) for i in (-5, 0, 7, 1 << 40, *range(100, 400))], "x long").withColumn("held", held(neardup.F.col("x"))).collect()
    assert all(r["held"] for r in rows[:4]) and sum(r["held"] for r in rows) < 10
    none = common.may_hold(ids.where("id = 3"))
    assert not ids.where(none(neardup.F.col("id"))).count()

"""Substring deduplication against brute force; suffix arrays against sorting."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import substrings


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40).map(str.encode), max_size=6), st.integers(1, 50))
def test_suffix_array_and_common_prefixes(parts, depth):
    data = b"".join(parts)
    text, sizes = np.frombuffer(data, np.uint8), np.array([len(p) for p in parts], np.int64)
    order = substrings.suffix_array(text)
    keys = [data[i:] for i in order.tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(data)))
    begins = np.cumsum(sizes) - sizes
    got = substrings.common_prefixes(text, order, begins, begins + sizes, depth)
    for r in range(1, len(data)):
        a, b = data[order[r - 1] :][:depth], data[order[r] :][:depth]
        assert got[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute(docs):
    first, out = {}, []
    for doc, text in docs:
        b = (text or "").encode()
        if doc is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                first[w] = min(first.get(w, doc), doc)
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49) if doc is not None else ():
            if first[b[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def random_docs(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(14) for _ in range(5)] + ["z" * 130, "ab" * 60, prose(300)]
    docs = [(i, " ".join(rng.choice([prose(rng.randint(0, 20)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 30) :]]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    docs += [(i, docs[3][1]) for i in range(80, 110)] + [(200, None), (201, ""), (7, docs[3][1]), (7, docs[3][1]), (None, passages[0] * 2), (-5, passages[1]), (300, "x" * 49), (301, "x" * 50), (302, "x" * 51)]
    return docs


@pytest.mark.parametrize(("seed", "size"), [(1, 8 << 20), (2, 3000), (3, 1200)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, size):
    """In one shard, and in many."""
    monkeypatch.setattr(substrings, "SHARD_BYTES", size)
    docs = random_docs(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, shard string, blob int")
    got = substrings.remove_repeats(df, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(docs)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_last_window_of_a_suffix_array_joins_its_group():
    texts = [b"q" * 3 + bytes(range(65, 115)), bytes(range(65, 115)) + b"r", b"zzzz" * 15]
    best, held = substrings.merged_windows(texts, np.array([5, 7, 1]), np.array([1, 1, 1]))
    assert best[0, 3] == best[1, 0] == 5 and held[0, 3] == 2 and held[0, 0] == 1


def test_a_very_long_text(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcd ") for _ in range(400_000))
    docs = [(1, long), (2, "x" + long[1000:1100] + "y"), (3, long[:60])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (400_000, 0, 0), 2: (102, 100, 1), 3: (60, 60, 1)}

"""Passages of lines against brute force over every pair of adjacent lines."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import lines


def brute_passages(docs):
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        if text is None:
            out.append((doc, None, 0))
            continue
        rows, gone = text.split("\n"), set()
        for i, pair in enumerate(zip(rows, rows[1:], strict=False)):
            gone |= {i, i + 1} if pair in seen else set()
            seen.add(pair)
        out.append((doc, "\n".join(r for i, r in enumerate(rows) if i not in gone), len(gone)))
    return sorted(out, key=str)


def test_short_passages_inside_other_documents_go(spark):
    """Each of 40 passages of two or three lines stands in two documents that have nothing else in common."""
    docs, size = [], 8
    for k in range(40):
        passage = [f"passage {k} line {i}" for i in range(2 + k % 2)]
        for doc in (2 * k, 2 * k + 1):
            own = [f"document {doc} line {i}" for i in range(size)]
            at = (doc * 5) % (size + 1)
            docs.append((doc, "\n".join(own[:at] + passage + own[at:])))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert [i for i in got if ("passage" in got[i]["text"]) != (i % 2 == 0)] == []
    assert all(got[i]["text"].count("document") == size and got[i]["n_chars"] == len(got[i]["text"]) for i in got)


def test_passages_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(40)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "\n\n\n"), (103, "x\nx\nx\ny"), (104, "one"), (None, docs[0][1]), (105, "x\n" * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lines.dedup_passages(df).collect()
    assert sorted(((r["doc_id"], r["text"], r["line_removed"]) for r in rows), key=str) == brute_passages(docs)
    assert lines.dedup_passages(df.limit(0)).count() == 0


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lines, "chunk_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(3)))
    rng = random.Random(6)
    docs = [(i, "\n".join(f"line {rng.randrange(25)}" for _ in range(9))) for i in range(40)]
    rows = lines.dedup_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"], r["line_removed"]) for r in rows), key=str) == brute_passages(docs)


def test_a_heavy_chunk_and_clashing_names(spark):
    """One passage stands in every document; columns with the names that the operator uses itself stay as they are."""
    docs = [(i, f"own {i}\nhead\nfoot\nend {i}", i, i, i, i) for i in range(3000)]
    got = lines.dedup_passages(spark.createDataFrame(docs, "doc_id long, text string, row long, drop long, line_count long, hash long"))
    assert got.columns == ["doc_id", "text", "row", "drop", "line_count", "hash", "dedup_line_count", "line_removed"]
    rows = got.collect()
    assert all(r["row"] == r["drop"] == r["line_count"] == r["hash"] == r["doc_id"] and r["dedup_line_count"] == 4 for r in rows)
    assert [r["doc_id"] for r in rows if "head" in r["text"]] == [0] and sum(r["line_removed"] for r in rows) == 2 * 2999

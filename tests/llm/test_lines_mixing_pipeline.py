"""Line deduplication and mixing against brute force, and the pipeline stage by stage on odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_line_passages import brute_passages

import corpus_pipeline
from tessera.llm import decontaminate, lines, mixing, neardup, queries


def chunks_of(text):
    rows = text.split("\n")
    h = [int(hashlib.md5(r.encode()).hexdigest()[:7], 16) for r in rows]
    f = [(h[i] * 31 + (h[i - 1] if i else 0) * 17) % 1_000_003 % 2 == 0 for i in range(len(rows))]
    out, start = [], 0
    for i in range(len(rows)):
        if i + 1 == len(rows) or (f[i] and not (i and f[i - 1])):
            out.append((start, rows[start : i + 1]))
            start = i + 1
    return out


def brute_lines(docs):
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        if text is None:
            out.append((doc, None))
            continue
        kept = []
        for _, c in chunks_of(text):
            if len(c) >= 2:
                if tuple(c) in seen:
                    continue
                seen.add(tuple(c))
            kept += c
        out.append((doc, "\n".join(kept)))
    return sorted(out, key=str)


def test_repeated_chunks_go(spark):
    rng = random.Random(2)
    pool = [f"line {i} " + "é" * (i % 4) for i in range(60)]
    passages = [[rng.choice(pool) for _ in range(12)] for _ in range(4)]
    docs = [(i, "\n".join(sum((rng.choice([passages[rng.randrange(4)], [rng.choice(pool) for _ in range(rng.randint(1, 5))]]) for _ in range(rng.randint(1, 4))), []))) for i in range(50)]
    docs += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (None, docs[0][1]), (104, "one"), (105, "x\n" * 30_000)]
    df = spark.createDataFrame([(i, t, len(t or ""), "m", 1) for i, t in docs], "doc_id long, text string, n_chars long, marks string, first int")
    got = lines.dedup_lines(df)
    assert got.columns == [*df.columns, "line_count", "line_removed"]
    rows = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == brute_lines(docs)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in rows) and sum(r["line_removed"] for r in rows) > 0
    assert lines.dedup_lines(df.limit(0)).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = dict(zip(names, [3, 1, 2] * len(names)))
    full, left, budget = set(), set(names), 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        at = {s: rest * w[s] / sum(w[t] for t in left) for s in left}
        over = {s for s in left if at[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in full}, **at}
        full, left = full | over, left - over


@pytest.mark.parametrize("n", [1, 2, 7])
def test_targets_and_nearness(spark, n):
    rng = random.Random(n)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])), rng.choice([f"s{k}" for k in range(n)] + ([None] if n > 1 else []))) for i in range(300)] + [(None, None, "s0"), (None, "a b", "s0")]
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, source string, copies int, s string")
    got = mixing.mix_sources(df.select("doc_id", "text", "source")).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["mix_size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["mix_size"]
    want = brute_targets(sizes)
    assert len(got) == len(docs)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 22 for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df.select("doc_id", "text", "source").repartition(3)).collect()), key=str)
    assert mixing.mix_sources(df.select("doc_id", "text", "source").limit(0)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with planted cases: toxic documents, repeated lines, near copies, a benchmark passage, nulls, empty texts."""
    rng, root = random.Random(9), str(tmp_path_factory.mktemp("tables"))
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    docs, labels = [], []
    for i in range(300):
        text = "\n".join(prose(12) for _ in range(4))
        if i % 6 == 0:
            text = text.replace(" ", " you idiot ", 3)
        docs.append([i, text, "en", f"src{i % 3}"])
        if i % 2 == 0:
            labels.append((i, 1, int(i % 6 == 0)))
    passage = prose(30)
    docs[7][1] += "\n" + passage
    near = docs[11][1].split(" ")
    near[5] = "edited"
    docs += [[1000, " ".join(near), "en", "src0"], [1001, docs[11][1], "en", None], [1002, None, None, None], [1003, "", "en", "src0"], [None, prose(50), "en", "src1"]]
    rows = [(*d, None if d[1] is None else len(d[1])) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, {d[0]: d[1] for d in docs}


def test_pipeline_stage_by_stage(spark, small):
    root, texts = small
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, root).write.parquet(f"{root}/stage{k}")
        docs = spark.read.parquet(f"{root}/stage{k}")
        kept[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        gone = {r["doc_id"] for r in before} - set(kept[name])
        if k < 4:
            assert docs.columns == columns
        if name == "toxicity":
            toxic = {i for i in texts if i is not None and i < 300 and i % 6 == 0}
            assert len(gone & toxic) >= 0.95 * len(toxic) and not gone - toxic
        if name == "line_dedup":
            assert not gone and {(r["doc_id"], r["text"]) for r in kept[name].values()} == {x[:2] for x in brute_passages([(r["doc_id"], r["text"]) for r in before])}
        if name == "near_duplicates":
            found = neardup.near_duplicates(spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")).collect()
            assert gone == {r["doc_id"] for r in found if r["doc_id"] is not None and r["doc_id"] != r["component_id"]}
        if name == "decontamination":
            bench = spark.read.parquet(f"{root}/benchmark.parquet")
            hit = decontaminate.find_passages(spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string"), bench)
            assert gone == {r["doc_id"] for r in hit.where("size(runs) > 0").collect()} and 7 in gone
    assert {r["copies"] for r in kept["mixing"].values()} <= {1, 2} and 1002 in kept["decontamination"]


CLASHING = "s whole prefix closes target source_size mix_hash mix_size copies taken row drop d t id th count lost marks hash line_count line_removed _gone component_id n_shingles score toxic items runs n_words".split()


def test_clashing_names_pass_the_pipeline_unchanged(spark, small, tmp_path):
    root, _ = small
    docs = spark.read.parquet(f"{root}/documents.parquet")
    docs.select("*", *(F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in CLASHING)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    plain = corpus_pipeline.run(spark, root)
    assert out.columns == [*docs.columns, *CLASHING, "mix_mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]
    got = out.collect()
    assert all(r[c] == f"{c} {-1 if r['doc_id'] is None else r['doc_id']}" for r in got for c in CLASHING)
    key = lambda r, *names: tuple(str(r[n]) for n in ("doc_id", "text", "n_chars", *names))
    assert sorted(key(r, "mix_copies", "mix_taken") for r in got) == sorted(key(r, "copies", "taken") for r in plain.collect()) != []


def test_pipeline_on_empty_tables(spark, small, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_size", "source_size", "target", "copies", "taken"]


def test_very_long_text_and_repeated_rows_in_the_mix(spark):
    docs = [(1, "w " * 400_000, "a"), (2, "w " * 10, "a"), (2, "w " * 10, "a"), (3, None, "b")]
    got = mixing.mix_documents(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {(r["doc_id"], r["mix_size"], r["copies"]) for r in got if r["doc_id"] != 3} <= {(1, 400_000, 1), (1, 400_000, 2), (2, 10, 1), (2, 10, 2)} and sum(r["doc_id"] == 2 for r in got) in (0, 2)

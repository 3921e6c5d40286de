"""Registered queries over small tables: they read every row and whole texts."""

import hashlib

import duckdb
import numpy as np

from tessera.operators import evaluation
from tessera.plans import registry
from tessera.sources import importers


def test_cosine_topk_asks_every_hundredth_vector(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(350, 8))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).round(3)
    v[120] = v[20] = v[300]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, [1.0, 0.0]), (401, None), (402, [0.6, 0.8]), (403, []), (None, v[0].tolist()), (405, [None, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")

    def cosine(a, b):
        return round(max(0.0, sum(x * y for x, y in zip(a, b, strict=True))), 6) if a and b and len(a) == len(b) and None not in a + b else 0.0

    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["cosine"]) for r in registry.QUERIES["cosine_topk"](spark, str(tmp_path)).collect()}
    want = {}
    for i, x in ((i, x) for i, x in rows if i is not None and i % 100 == 0):
        best = sorted((-cosine(x, y), j) for j, y in rows if j is not None and j != i)[:10]
        want |= {(i, n): (j, -s + 0.0) for n, (s, j) in enumerate(best, 1)}
    assert got == want and {i for i, _ in got} == {0, 100, 200, 300, 400}


def documents(spark, path, texts):
    spark.createDataFrame([(i, t, "en", "src0") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_text_queries_read_behind_word_five(spark, tmp_path):
    """Documents 2 and 44 share kind, scope and owner, and differ behind word five only."""
    d = documents(spark, tmp_path, [(2, "one two three four five alpha beta gamma"), (44, "one two three four five delta")])
    run = lambda q: registry.QUERIES[q](spark, d).collect()
    assert [r["jaccard"] for r in run("token_jaccard_pairs")] == [round(5 / 9, 6)]
    assert {r["token"]: r["grams"] for r in run("char_ngrams")}["gamma"] == "^gam gamm amma mma$"
    terms = {r["id"]: set(r["terms"].split(" ")) for r in run("semantic_terms")}
    assert {"alpha", "beta", "summary"} <= terms["rec_000000002"] and {"delta", "^del"} <= terms["rec_000000044"]


def test_requests_are_whole_benchmark_texts(spark, tmp_path):
    """A word behind the twelfth is the only one that an item has in common with a document."""
    words = [f"ask{i}" for i in range(20)]
    d = documents(spark, tmp_path, [(2, "zulu yankee xray"), (5, "whiskey victor " + words[15])])
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["record_id"]: r["lexical_score"] for r in registry.QUERIES["batch_retrieve"](spark, d).collect()}
    assert got["rec_000000005"] == round(1 / (20 * 3) ** 0.5, 6)
    assert [r["retrieval_count"] for r in registry.QUERIES["eval_hits"](spark, d).collect()] == [len(got)]


def test_both_runs_hold_every_item(spark, tmp_path):
    spark.createDataFrame([(i, "x") for i in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda q: registry.QUERIES[q](spark, str(tmp_path)).collect()
    got = {r["name"]: r["baseline_retrieval_hit"] for r in run("eval_compare")}
    assert got == {f"case_{i}": i * 3 % 4 != 0 for i in range(60)} and run("eval_gate")[0]["total_cases"] == 60


def test_a_case_missing_on_a_side_is_no_hit_there(spark):
    side = lambda *rows: spark.createDataFrame(rows, "name string, retrieval_hit boolean, assembly_hit boolean, seq long")
    got = evaluation.compare(side(("a", True, False, 1), ("b", True, True, 2)), side(("b", True, True, 1), ("c", False, True, 2)))
    want = [("a", True, False, False, False, True, False), ("b", True, True, True, True, False, False), ("c", False, False, False, True, False, True)]
    assert sorted(map(tuple, got.collect())) == want


CUT_OFF = [(1, "<p>Tom &amp; Ann&amp;&amp</p><b>&copy;&quot;&middot; &amp;copy; &cop</b>"), (2, "&notit; &#65;&#x42; &#67 &nosuch; &"), (3, None)]
TEXTS = {1: "Tom & Ann&&amp ©\"· &copy; &cop", 2: "&notit; AB &#67 &nosuch; &", 3: None}


def test_references_that_are_cut_off_stay(spark, tmp_path):
    spark.createDataFrame(CUT_OFF, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["n_chars"], r["text_md5"]) for r in registry.QUERIES["html_text"](spark, str(tmp_path)).collect()}
    assert got == {i: (t and len(t), t and hashlib.md5(t.encode()).hexdigest()) for i, t in TEXTS.items()}


def test_imported_pages_keep_references_that_are_cut_off(spark):
    files = spark.createDataFrame([(f"/in/{i}.html", ".html", h.encode()) for i, h in CUT_OFF if h], "path string, suffix string, content binary")
    got = {r["path"]: (r["status"], r["text"]) for r in importers.import_files(files).collect()}
    assert got == {f"/in/{i}.html": ("imported", t) for i, t in TEXTS.items() if t}


ODD_TEXTS = [None, "", "  ", "\n\t\r\n", "\ufeff", "\ufeffa b", "a ]]> b", "a\x00b", "a\x01b \x07", "a\x0cb", "\ue000 \ue0000041", "a\ufffeb\uffff", "<p>&amp; ]]"]
ODD_PAGES = [None, "", " \n ", "<p></p>", "<script>a</script>", "\ufeff", "\ufeff<p>a</p>", "a ]]> b", "<p>a &amp; b</p>"]


def test_files_without_text_and_with_odd_characters_are_as_the_sql_has_them(spark, tmp_path):
    """Each text as a file of each of the six kinds, and as the one that can't be read."""
    rows = {
        "documents": ([(30 * n + m, t) for n, t in enumerate(ODD_TEXTS) for m in range(7)], "doc_id long, text string"),
        "pages": (list(enumerate(ODD_PAGES)), "page_id long, html string"),
        "orders": ([(1, 1, "O", "1-URGENT"), (2, 1, "", " x  y ")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "customer": ([(1, 'a "q" \\ b', "")], "c_custkey long, c_name string, c_mktsegment string"),
    }
    db = duckdb.connect()
    for name, (values, kinds) in rows.items():
        spark.createDataFrame(values, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = registry.QUERIES["import_files"](spark, str(tmp_path))
    want = {r[0]: r for r in db.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.SQL['import_files']})").fetchall()}
    assert {r["path"]: tuple(r) for r in got.collect()} == want and len(want) == 7 * len(ODD_TEXTS) + len(ODD_PAGES) + 2


def test_an_import_that_is_not_lenient_keeps_xml_that_does_not_parse_and_skips_what_has_no_text(spark):
    rows = [("/in/a.xml", ".xml", b"<r>a\x01</r>"), ("/in/b.xml", ".xml", b"<r>a<b>c</b></r>"), ("/in/c.txt", ".txt", b" "), ("/in/d.txt", ".txt", b"\xef\xbb\xbfa")]
    files = spark.createDataFrame(rows, "path string, suffix string, content binary")
    run = lambda **more: {r["path"][4]: (r["status"], r["text"]) for r in importers.import_files(files, **more).collect()}
    want = {"a": ("imported", "<r>a\x01</r>"), "b": ("imported", "a c"), "c": ("skipped", None), "d": ("imported", "\ufeffa")}
    assert run() == want and run(lenient=True) == want | {"a": ("imported", "a\x01"), "c": ("imported", "")}

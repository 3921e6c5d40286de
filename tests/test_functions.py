"""Expressions against plain Python, and the values that define them."""

import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import Request, Settings
from tessera.functions import structured as J
from tessera.functions import text as X
from tessera.functions import vector as V
from tessera.operators import chunks as C


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first()["x"]


STEMS = {"running": "runn", "tested": "test", "parties": "party", "carried": "carry", "boxes": "box", "development": "develop", "creation": "crea", "is": "is", "ions": "ion", "bed": "bed", "happiness": "happi"}


def test_stems(spark):
    df = spark.createDataFrame(list(STEMS.items()), "t string, want string")
    assert df.select("t", X.stem(F.col("t")).alias("got"), "want").where("got <> want").collect() == []


def test_character_pieces(spark):
    for token, want in (("ab", ["^ab$"]), ("a", ["^a$"]), ("abc", ["^abc", "abc$"])):
        assert one(spark, token, lambda c: X.char_grams(c)) == want


def test_tokens_match_before_lowercasing(spark):
    text = "Ab1 x KELVIN ſtop é9 a_b2 ++ AB1"
    want = sorted({t.lower() for t in re.findall(r"[a-z0-9]{2,}", text, re.IGNORECASE)})
    assert one(spark, text, X.lexical_tokens) == want


def test_white_space_is_unicode(spark):
    assert one(spark, "  a\x1c b\n\x85", X.collapse) == "a b"


def test_terms_hold_related_words(spark):
    got = one(spark, "status", X.semantic_terms)
    assert {"status", "statu", "update", "summary", "^sta", "tus$"} <= set(got) and got == sorted(set(got))


def python_vector(terms, dims=384):
    out = [0.0] * dims
    for t in terms:
        d = hashlib.sha256(t.encode()).digest()
        out[int.from_bytes(d[:4], "big") % dims] += (1 if d[4] % 2 == 0 else -1) * (1 + (d[5] % 11) / 50)
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm if norm else 0.0 for x in out]


def test_hashing_embedder(spark):
    lists = [sorted({f"term{i}" for i in range(300)} | {"status", "ran"}), []]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, lexical_tokens array<string>")
    got = V.embedded(rows, Settings()).withColumn("d", V.dense(F.col("buckets"), F.col("weights"), 384)).orderBy("i").collect()
    terms = one(spark, " ".join(lists[0]), X.semantic_terms)
    assert got[0]["d"] == pytest.approx(python_vector(terms)) and set(got[1]["d"]) == {0.0} and got[1]["buckets"] == []
    assert [set().union(*map(X.terms_of_token, X.tokens_of(" ".join(lists[0]))))] == [set(terms)]


def test_tokens_in_python_and_spark_agree(spark):
    for text in ["", "a bb CC d4 x_y", "İstanbul ırmak Kelvin ſtraße naïve", "Über-cool 3.14 don't", "running ponies studied boxes ab ing ting"]:
        assert X.tokens_of(text) == one(spark, text, X.lexical_tokens)
        assert sorted(set().union(*map(X.terms_of_token, X.tokens_of(text)))) == one(spark, text, X.semantic_terms)


def test_embedders_are_named_by_the_settings(spark):
    with pytest.raises(ValueError, match="unknown embedder"):
        V.embedder(Settings(embedding_backend="none"))
    with pytest.raises(ValueError, match="onnx_model_path"):
        V.embedder(Settings(embedding_backend="onnx"))
    V.register_embedder("counts", lambda settings: lambda lists: [(np.array([0, 1]), np.array([1.0, float(len(x))])) for x in lists])
    rows = V.embedded(spark.createDataFrame([(["a", "b"],)], "lexical_tokens array<string>"), Settings(embedding_backend="counts"))
    assert tuple(rows.first()) == (["a", "b"], [0, 1], [1.0, 2.0])


def test_similarities(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], ["a"]), (["a"], ["b"])], "a array<string>, b array<string>")
    got = df.select(X.overlap(F.col("a"), F.col("b")).alias("o"), X.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [tuple(r) for r in got] == [(2 / 3, 0.5), (0.0, 0.0), (0.0, 0.0)]
    v = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([1.0], [-1.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [r["c"] for r in v.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.6, 0.0, 0.0, 0.0]


def python_windows(text, size=900, overlap=120):
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if text[at:end].strip():
            out.append(text[at:end].strip(" "))
        if end >= len(text):
            break
        at = end - overlap
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 5000))
def test_windows(spark, n):
    text = ("abcdefghi " * 600)[:n]
    assert one(spark, text, lambda c: C.windows(c, Settings())) == python_windows(text)


PAYLOAD = '{"b": {"z": [1, {"name": "N  x"}], "a": true}, "text": " hi ", "n": null, "e": "  ", "f": 1.0, "big": 1e16}'


def test_leaves_keep_document_order(spark):
    got = [tuple(f) for f in one(spark, PAYLOAD, J.extract_fields)]
    assert got == [("b.z[0]", "1", "integer"), ("b.z[1].name", "N x", "string"), ("b.a", "True", "boolean"), ("text", "hi", "string"), ("f", "1.0", "number"), ("big", "1e+16", "number")]
    assert one(spark, "3", J.extract_fields)[0]["path"] == "value" and one(spark, "[[5]]", J.extract_fields)[0]["path"] == "[0][0]"
    assert one(spark, "{oops", J.extract_fields) == [] and one(spark, None, J.extract_fields) == []
    assert one(spark, '{"a": [null, true, {"b": 1.5}]}', J.flatten_text) == "a: None True b: 1.5"


def test_primary_paths_lead_the_text(spark):
    x = spark.createDataFrame([(PAYLOAD,)], "v string").withColumn("f", J.extract_fields(F.col("v")))
    row = x.select(J.primary_paths(F.col("f")).alias("p"), J.structured_text(F.col("f"), J.primary_paths(F.col("f"))).alias("t"), J.structured_text(F.col("f"), J.primary_paths(F.col("f")), F.lit(True)).alias("i")).first()
    assert row["p"] == ["b.z[1].name", "text"] and row["t"].startswith("b.z[1].name: N x text: hi b.z[0]: 1") and row["i"] == "b.z[1].name: N x text: hi"


def test_settings_from_the_environment():
    s = Settings.from_env({"TESSERA_QUERY_TOP_K": "9", "TESSERA_INCLUDE_USER_SCOPE_BY_DEFAULT": "off", "TESSERA_RETENTION_DAYS": " ", "TESSERA_MAX_RECORDS_PER_SCOPE_KIND": "1"})
    assert (s.query_top_k, s.include_user_scope_by_default, s.retention_days, s.group_limit) == (9, False, 45, 4)
    for bad in ({"limit": 0}, {"limit": 101}, {"token_budget": 49}, {"max_age_days": 0}, {"model_target": "x"}, {"kinds": ("x",)}):
        with pytest.raises(ValueError):
            Request("q", **bad)

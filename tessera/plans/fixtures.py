"""Records, requests and runs made of the driver tables, the same way in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.config import KINDS, Request, Settings
from tessera.functions import text as X

AS_OF = datetime(2024, 3, 1)
SETTINGS = Settings()
QUERY = "is the status update of their short draft: reer and anat nteres"
REQUEST = Request(QUERY, session_id="s3", user_id="u1")
BATCH_REQUEST = Request("batch", session_id="s3", user_id="u1", limit=5)
RECORD_COLUMNS = "id kind scope source_type content_class title text user_id session_id source_key source_status content_checksum tags policy created_at token_count_estimate".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records; everything but the text follows from doc_id."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", X.collapse(F.col("text")).alias("text"))
    owner = (F.floor(i / 3) % 20).cast("string")
    scope = pick(("session", "user", "global"), i % 3)
    policy = F.struct(
        pick(("shareable", "shareable", "private", "restricted"), i % 4).alias("confidentiality"),
        F.when(i % 13 == 0, 10).alias("freshness_days"),
        F.when(i % 23 == 0, 20).alias("retention_days"),
        F.when(i % 17 == 0, F.array(F.lit("u1"), F.lit("u2"))).otherwise(F.array().cast("array<string>")).alias("allowed_user_ids"),
        F.array().cast("array<string>").alias("allowed_session_ids"),
        (i % 19 != 0).alias("allow_local_model_egress"),
        (i % 2 == 0).alias("allow_remote_model_egress"),
    )
    return d.select(
        "doc_id",
        F.concat(F.lit("rec_"), F.lpad(i.cast("string"), 9, "0")).alias("id"),
        pick(KINDS, i % 14).alias("kind"),
        scope.alias("scope"),
        F.when(i % 5 == 0, "imported_document").otherwise("direct_text").alias("source_type"),
        F.when(i % 5 == 0, "raw_source").otherwise("normalized_memory").alias("content_class"),
        F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("title"),
        "text",
        F.when(i % 3 == 1, F.concat(F.lit("u"), owner)).alias("user_id"),
        F.when(i % 3 == 0, F.concat(F.lit("s"), owner)).alias("session_id"),
        F.concat("source", F.lit(":"), F.lpad((i % 200).cast("string"), 4, "0")).alias("source_key"),
        F.when(i % 11 == 0, "deleted").when(i % 7 == 0, "superseded").otherwise("active").alias("source_status"),
        X.checksum(F.col("text")).alias("content_checksum"),
        F.array("lang", "source").alias("tags"),
        F.array().cast("array<string>").alias("schema_field_paths"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("structured_json"),
        policy.alias("policy"),
        F.timestamp_micros(F.unix_micros(F.lit(AS_OF)) - ((i % 90) * 86400 + i % 1000) * 1_000_000).alias("created_at"),
        X.token_estimate(F.col("text")).alias("token_count_estimate"),
    )


REC = """
d0 AS (SELECT doc_id, doc_id AS i, lang, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents),
rec AS (SELECT doc_id, 'rec_' || lpad(CAST(i AS VARCHAR), 9, '0') AS id,
  (['user_prompt','normalized_query','assistant_answer','routing_decision','decision_trace','topic_pattern','research_plan','search_query','evidence_summary','research_report','research_finding','user_profile_note','decision_outcome','training_example'])[i % 14 + 1] AS kind,
  (['session','user','global'])[i % 3 + 1] AS scope,
  CASE WHEN i % 5 = 0 THEN 'imported_document' ELSE 'direct_text' END AS source_type,
  CASE WHEN i % 5 = 0 THEN 'raw_source' ELSE 'normalized_memory' END AS content_class,
  array_to_string(string_split(text, ' ')[1:5], ' ') AS title, text,
  CASE WHEN i % 3 = 1 THEN 'u' || CAST(i // 3 % 20 AS VARCHAR) END AS user_id,
  CASE WHEN i % 3 = 0 THEN 's' || CAST(i // 3 % 20 AS VARCHAR) END AS session_id,
  source || ':' || lpad(CAST(i % 200 AS VARCHAR), 4, '0') AS source_key,
  CASE WHEN i % 11 = 0 THEN 'deleted' WHEN i % 7 = 0 THEN 'superseded' ELSE 'active' END AS source_status,
  sha256(text) AS content_checksum, lang, source,
  (['shareable','shareable','private','restricted'])[i % 4 + 1] AS confidentiality,
  CASE WHEN i % 13 = 0 THEN 10 END AS freshness_days, CASE WHEN i % 23 = 0 THEN 20 END AS retention_days,
  i % 17 = 0 AS restricted_users, i % 19 <> 0 AS allow_local, i % 2 = 0 AS allow_remote,
  TIMESTAMP '2024-03-01 00:00:00' - to_seconds((i % 90) * 86400 + i % 1000) AS created_at,
  ((i % 90) * 86400 + i % 1000) / 86400.0 AS age_days,
  CAST(greatest(1, ceil(length(text) / 4.0)) AS INTEGER) AS token_count_estimate FROM d0),
hor AS (SELECT *, coalesce(freshness_days, CASE kind WHEN 'research_report' THEN 60 WHEN 'assistant_answer' THEN 14 WHEN 'topic_pattern' THEN 30 WHEN 'user_profile_note' THEN 120 ELSE 45 END) AS horizon FROM rec)
"""
CHUNKS = """
win AS (SELECT id AS record_id, text, CASE WHEN length(text) <= 900 THEN 1 ELSE 1 + CAST(ceil((length(text) - 900) / 780.0) AS INTEGER) END AS n FROM rec WHERE length(text) > 0),
cut AS (SELECT record_id, k, trim(substr(text, k * 780 + 1, 900)) AS text FROM (SELECT *, unnest(range(0, n)) AS k FROM win)),
chk AS (SELECT record_id || ':' || CAST(row_number() OVER (PARTITION BY record_id ORDER BY k) - 1 AS VARCHAR) AS chunk_id, record_id,
  CAST(row_number() OVER (PARTITION BY record_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, text, CAST(greatest(1, ceil(length(text) / 4.0)) AS INTEGER) AS token_count_estimate FROM cut WHERE text <> '')
"""


def tokens_sql(text: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]{{2,}}')))"


def stem_sql(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '^.{{3,}}(ies|ied)$') THEN regexp_replace({t}, '(ies|ied)$', 'y') ELSE regexp_replace({t}, '^(.{{3,}}?)(ingly|edly|ment|tion|ions|ness|able|ible|ing|ers|ed|es|s)$', '\\1') END"


RELATED = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in X.RELATED.items()) + "}"


def terms_sql(tokens: str) -> str:
    """Distinct terms of a list of tokens, as a list."""
    rel = f"flatten(list_transform({tokens}, lambda t: coalesce(({RELATED})[t], [])))"
    grams = f"flatten(list_transform({tokens}, lambda t: list_transform(range(1, greatest(1, length(t) + 2 - 4 + 1) + 1), lambda p: substr('^' || t || '$', p, 4))))"
    stems = f"list_transform({tokens}, lambda t: {stem_sql('t')})"
    return f"list_sort(list_distinct(list_concat(list_concat({tokens}, {stems}), list_concat(list_concat({rel}, list_transform({rel}, lambda t: {stem_sql('t')})), {grams}))))"


VISIBLE = """
vis AS (SELECT * FROM hor WHERE source_status = 'active' AND age_days <= horizon
  AND CASE scope WHEN 'session' THEN session_id = 's3' WHEN 'user' THEN user_id = 'u1' ELSE true END
  AND allow_local AND NOT (confidentiality = 'private' AND scope = 'global' AND NOT restricted_users))
"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their customer as nested JSON payloads."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    inner = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return x.select("o_orderkey", F.to_json(F.struct(inner.alias("customer"), F.col("o_orderpriority").alias("priority"), F.array(F.col("o_orderstatus"), F.col("o_custkey").cast("string")).alias("codes"))).alias("payload"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as requests: their whole texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.collapse(F.col("text")).alias("query_text"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as benchmark runs of three series."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(pick(("series_a", "series_b", "series_c"), k % 3).alias("series"), (k % 50 + 1).cast("int").alias("run"), ((k % 7) / 8).alias("retrieval_rate"), ((k % 5) / 4).alias("assembly_rate"), ((k % 11) / 2).alias("seconds"))


def eval_run(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    """benchmark items as the cases of one of two runs; each run has all of them."""
    i = F.col("item_id")
    x = table(spark, sf_dir, "benchmark")
    return x.select(F.concat(F.lit("case_"), i.cast("string")).alias("name"), ((i * (3 + which)) % 4 != 0).alias("retrieval_hit"), ((i * (5 + which)) % 3 != 0).alias("assembly_hit"), i.alias("seq"))




def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with every column of schema.RECORD and seq: sixty keys, versions in the order of doc_id."""
    i = F.col("doc_id")
    x = records(spark, sf_dir).withColumn("source_key", F.concat(F.lit("k"), (i % 60).cast("string"))).withColumn("seq", i)
    x = x.withColumn("owner_scope", F.coalesce("session_id", "user_id")).withColumn("metadata", F.expr("cast(map() as map<string,string>)"))
    x = x.withColumn("source_version", F.lit(1)).withColumn("source_status", F.lit("active")).withColumn("lexical_tokens", X.lexical_tokens(F.col("text")))
    kinds = [c.split(maxsplit=1) for c in schema.columns(schema.RECORD)]
    return x.select(*((F.col(n) if n in x.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds), "seq", "doc_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, pages and orders as the files of an import, some of which can't be read."""
    at = lambda kind, i: F.concat(F.lit(f"/in/{kind}"), i.cast("string"))
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    i = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".csv", ".xml", ".bin", ".ndjson"))), (i % 6 + 1).cast("int"))
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<r><a>"), escaped, F.lit("</a><b>end</b></r>"))
    lines = F.concat(F.lit('{"id": '), i.cast("string"), F.lit("}\nnot json\n"))
    content = F.when(i % 6 == 3, xml.cast("binary")).when(i % 6 == 5, lines.cast("binary")).when(i % 30 == 0, F.lit(bytes([255, 254]))).otherwise(F.col("text").cast("binary"))
    docs = d.select(F.concat(at("d", i), suffix).alias("path"), suffix.alias("suffix"), content.alias("content"))
    pages = p.select(F.concat(at("p", F.col("page_id")), F.lit(".html")).alias("path"), F.lit(".html").alias("suffix"), F.col("html").cast("binary").alias("content"))
    orders = payloads(spark, sf_dir).select(F.concat(at("o", F.col("o_orderkey")), F.lit(".json")).alias("path"), F.lit(".json").alias("suffix"), F.col("payload").cast("binary").alias("content"))
    x = docs.union(pages).union(orders)
    return x.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("modified", F.lit(AS_OF))


def run_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """runs, with results of documents for some and case definitions of benchmark items for others."""
    i, j = F.col("doc_id"), F.col("item_id")
    series = lambda k: pick(("series_a", "series_b", "series_c"), k % 3).alias("series")
    results = table(spark, sf_dir, "documents").select(series(i), (i % 40 + 1).cast("int").alias("run"), F.concat(F.lit("case_"), i.cast("string")).alias("name"), (i % 4 != 0).alias("retrieval_hit"), (i % 3 != 0).alias("assembly_hit"), (i % 7).cast("int").alias("retrieval_count"), (i % 500).cast("int").alias("token_count_estimate"))
    cases = table(spark, sf_dir, "benchmark").select(series(j), (j % 50 + 1).cast("int").alias("run"), F.concat(F.lit("case_"), j.cast("string")).alias("name"))
    return runs(spark, sf_dir).select("series", "run").distinct(), results, cases

"""Queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import schema
from tessera.config import Request
from tessera.functions import structured as J
from tessera.functions import text as X
from tessera.functions import vector as V
from tessera.operators import assembly as A
from tessera.operators import chunks as C
from tessera.operators import evaluation as E
from tessera.operators import filters as L
from tessera.operators import ingest as N
from tessera.operators import lifecycle as Y
from tessera.operators import perturb as B
from tessera.operators import retrieval as R
from tessera.operators import workflow as W
from tessera.plans import fixtures as P
from tessera.plans import sql
from tessera.sources import importers as I  # noqa: E741
from tessera.sources import sinks as K

FLAGSHIP = "hybrid_retrieve"
S, NOW, REQ = P.SETTINGS, P.AS_OF, P.REQUEST
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def chunks(spark, d):
    return C.chunk_records(P.records(spark, d), S)


@query
def record_projection(spark, d):
    return P.records(spark, d).select("id", "kind", "scope", "source_type", "content_class", X.blank_to_null(F.col("title")).alias("title"), "user_id", "session_id", "source_key", "source_status", "content_checksum", "token_count_estimate")


@query
def record_summaries(spark, d):
    """All fields of the summaries of stored records; nested ones as text."""
    x = Y.summaries(upserted(spark, d).select(*(c.split()[0] for c in schema.columns(schema.RECORD))))
    plain = "id kind scope source_type content_class title summary user_id session_id source_id source_key source_version source_status external_id content_checksum structured_json".split()
    times = "source_updated_at source_last_synced_at deleted_at created_at".split()
    rest = [F.size("urls").alias("n_urls"), F.array_join("tags", ",").alias("tags"), F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("metadata_keys"), F.col("data_schema").isNull().alias("no_schema"), F.size("structured_fields").alias("n_fields"), F.size("schema_field_paths").alias("n_paths")]
    policy = [F.col("policy")[c].cast("string").alias(c) for c in ("confidentiality", "freshness_days", "retention_days")]
    return x.select(*plain, *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in times), *rest, *policy, F.md5(F.array_join("lexical_tokens", " ").cast("binary")).alias("tokens_md5"))


@query
def chunk_documents(spark, d):
    return chunks(spark, d).select("chunk_id", "record_id", "chunk_index", "token_count_estimate", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def lexical_tokens(spark, d):
    t = X.lexical_tokens(F.col("text"))
    return P.records(spark, d).select("id", t.alias("t")).select("id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query
def stem_tokens(spark, d):
    x = P.records(spark, d).select(F.explode(X.lexical_tokens(F.col("text"))).alias("token")).distinct()
    return x.select("token", X.stem(F.col("token")).alias("stem"))


@query
def char_ngrams(spark, d):
    x = P.records(spark, d).select(F.explode(X.lexical_tokens(F.col("text"))).alias("token")).distinct()
    return x.select("token", F.array_join(X.char_grams(F.col("token")), " ").alias("grams"))


@query
def semantic_terms(spark, d):
    x = P.records(spark, d).select("id", X.semantic_terms(F.concat("text", F.lit(" status draft edit"))).alias("t"))
    return x.select("id", F.size("t").alias("n_terms"), F.array_join("t", " ").alias("terms"))


@query
def hash_embedding(spark, d):
    x = V.embedded(P.records(spark, d).select("id", X.lexical_tokens(F.col("text")).alias("lexical_tokens")), S)
    norm = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w).cast("long")
    entries = F.zip_with("buckets", "weights", lambda b, w: F.concat_ws(":", b.cast("string"), w.cast("long").cast("string")))
    return x.select("id", F.size("buckets").alias("nonzero"), norm.alias("norm_sq"), F.md5(F.array_join(entries, ",").cast("binary")).alias("vector_md5"))


@query
def cosine_topk(spark, d):
    return R.cosine_top_k(P.table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def lexical_overlap(spark, d):
    q = R.strings(X.tokens_of(P.QUERY))
    x = chunks(spark, d).select("chunk_id", F.round(X.overlap(q, X.lexical_tokens(F.col("text"))), 6).alias("lexical_score"))
    return x.where("lexical_score > 0")


@query
def token_jaccard_pairs(spark, d):
    """Records beside up to ten newer ones of their kind, scope and owner, with the Jaccard similarity of their text tokens."""
    per = R.Window.partitionBy("kind", "scope", "owner").orderBy(F.desc("created_at"), "id")
    x = P.records(spark, d).withColumn("owner", Y.owner()).select("id", "kind", "scope", "owner", "created_at", X.lexical_tokens(F.col("text")).alias("t"))
    x = x.withColumn("newer", F.collect_list(F.struct("id", "t")).over(per.rowsBetween(-10, -1))).select("id", "t", F.explode("newer").alias("n"))
    return x.select("id", F.col("n.id").alias("other_id"), F.round(X.jaccard(F.col("t"), F.col("n.t")), 6).alias("jaccard"))


@query
def scope_visibility(spark, d):
    r = Request("x", session_id="s3", user_id="u1", enforce_policy=False, max_age_days=100_000, source_statuses=("active", "superseded", "deleted"))
    return L.visible(P.records(spark, d), r, S, NOW).select("id", "scope", "session_id", "user_id")


@query
def policy_filter(spark, d):
    r = Request("x", session_id="s3", user_id="u3", model_target="hosted", max_age_days=100_000, source_statuses=("active", "superseded", "deleted"))
    return L.with_reason(P.records(spark, d), r, S, NOW).where("excluded like 'policy%'").select("id", "excluded")


@query
def exclusion_counts(spark, d):
    return L.excluded_counts(P.records(spark, d), REQ, S, NOW)


@query
def staleness_filter(spark, d):
    r = P.records(spark, d)
    return r.select("id", L.horizon_days(S).alias("horizon_days"), (F.col("created_at") < L.days_before(NOW, L.horizon_days(S))).alias("stale"))


@query
def metadata_filters(spark, d):
    r = Request("x", session_id="s3", user_id="u1", enforce_policy=False, kinds=("research_report", "research_finding", "user_profile_note", "topic_pattern"), source_types=("direct_text",), content_classes=("normalized_memory",), tags=(" EN", "fr"), confidentialities=("shareable", "private"), source_statuses=("active", "superseded"), max_age_days=100)
    return L.with_reason(P.records(spark, d), r, S, NOW).select("id", F.coalesce("excluded", F.lit("visible")).alias("reason"))


@query
def age_decay(spark, d):
    return P.records(spark, d).select("id", F.round(R.age_decay(S, NOW), 6).alias("decay"))


@query
def keyword_bonus(spark, d):
    tokens = R.strings(["the", "is", "src1", "en", "and"])
    x = P.records(spark, d).withColumn("chunk_index", F.col("doc_id") % 2)
    return x.select("id", F.round(R.keyword_bonus(tokens), 6).alias("bonus"))


@query
def metadata_bonus(spark, d):
    r = Request("x", source_keys=("src1:0001", "src2:0002"), tags=("EN",))
    return P.records(spark, d).select("id", F.round(R.metadata_bonus(r, S), 6).alias("bonus"))


@query
def rerank_scores(spark, d):
    i = F.col("doc_id")
    x = P.records(spark, d).withColumn("semantic_score", (i % 8) / 8).withColumn("lexical_score", (i % 5) / 4).withColumn("keyword_bonus", (i % 3) / 32).withColumn("metadata_bonus", F.lit(0.07))
    return x.select("id", F.round(R.final_score(S, NOW), 6).alias("score"))


@query
def selection_reason(spark, d):
    i = F.col("doc_id")
    x = P.records(spark, d).withColumn("semantic_score", (i % 4) / 4).withColumn("lexical_score", (i % 5) / 4).withColumn("keyword_bonus", (i % 2) / 32)
    return x.select("id", R.selection_reason().alias("reason"))


def retrieved(spark, d, request=REQ):
    r = P.records(spark, d)
    return R.retrieve(r, C.chunk_records(r, S), request, S, NOW)


ITEM = ("chunk_id", "record_id", "kind", "scope", "selection_reason")


def rounded(df, *extra):
    return df.select(*extra, "rank", *ITEM, *(F.round(c, 6).alias(c) for c in ("score", "semantic_score", "lexical_score")))


@query
def hybrid_retrieve(spark, d):
    return rounded(retrieved(spark, d))


@query
def batch_retrieve(spark, d):
    r = P.records(spark, d)
    return rounded(R.retrieve_batch(r, C.chunk_records(r, S), P.cases(spark, d), P.BATCH_REQUEST, S, NOW), "query_id")


@query
def candidate_counts(spark, d):
    r = P.records(spark, d)
    return R.candidate_counts(r, C.chunk_records(r, S), REQ, S, NOW)


@query
def query_results(spark, d):
    return retrieved(spark, d).select("rank", "record_id", "chunk_id", "kind", "scope", "source_type", "content_class", "title", "summary", "source_key", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round("score", 6).alias("score"), "token_count_estimate")


def upserted(spark, d):
    """The store after an upsert of all records into an empty one."""
    new = P.stored(spark, d)
    rows, _ = N.upsert(spark.createDataFrame([], schema.RECORD), new.drop("doc_id"), NOW)
    return rows.withColumn("version_key", F.col("source_key")).withColumn("owner", F.col("owner_scope"))


@query
def upsert_versions(spark, d):
    return upserted(spark, d).select("id", "version_key", "scope", "owner", "source_version", "source_status", F.try_element_at("metadata", F.lit("previous_record_id")).alias("previous_id"))


@query
def latest_source(spark, d):
    return Y.latest(upserted(spark, d)).select("id", "version_key", "scope", "owner", "source_version")


@query
def soft_delete(spark, d):
    x = upserted(spark, d)
    t = x.where(F.substring("version_key", -1, 1) == "7").select("source_key", "scope", "owner").distinct().withColumn("deleted_at", F.lit(NOW))
    return Y.soft_delete(x.drop("owner"), t).select("id", "version_key", "source_version", "source_status", F.col("deleted_at").isNotNull().alias("has_deleted_at"))


@query
def prune_fifo(spark, d):
    return Y.prune_marks(P.records(spark, d), S, NOW).select("id", "prune_reason")


@query
def retention_expiry(spark, d):
    return P.records(spark, d).where(Y.expired(S, NOW)).select("id")


@query
def near_duplicates(spark, d):
    x = P.records(spark, d).withColumn("seq", F.col("doc_id")).withColumn("lexical_tokens", X.lexical_tokens(F.col("text")))
    return Y.near_duplicates(x, S)


@query
def stats_grouping_sets(spark, d):
    return Y.stats(P.records(spark, d))


@query
def list_records(spark, d):
    return Y.list_records(P.records(spark, d), scope="user", limit=50).select("id", "kind", "total")


def assembled(spark, d, mode="research", budget=600):
    request = Request(P.QUERY, session_id="s3", user_id="u1", limit=20, assembly_mode=mode, token_budget=budget)
    return A.assemble(A.gather(retrieved(spark, d, request)), F.lit(P.QUERY), mode, F.lit(budget))


@query
def compress_items(spark, d):
    return assembled(spark, d).select(F.size("items").alias("n_items"), F.size("compressed").alias("n_compressed"), F.array_join(F.transform("compressed", lambda x: x["chunk_id"]), ",").alias("chunk_ids"))


@query
def pack_budget(spark, d):
    return assembled(spark, d).select("used", "omitted_items", "truncation_reason", F.array_join(F.transform("selected", lambda x: x["chunk_id"]), ",").alias("chunk_ids"))


@query
def assembly_sections(spark, d):
    out = None
    for mode in A.SECTIONS:
        x = P.records(spark, d).select(A.section_of(mode, F.col("kind"), F.col("scope")).alias("section"), "token_count_estimate")
        x = x.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(1), "token_count_estimate")).alias("tokens")).select(F.lit(mode).alias("mode"), "section", "n", "tokens")
        out = x if out is None else out.union(x)
    return out


@query
def render_context(spark, d):
    return assembled(spark, d).select("context_text", "token_count_estimate", "omitted_items")


@query
def prepare_context(spark, d):
    x = assembled(spark, d).withColumn("blocks", A.blocks(F.col("sections")))
    return x.select(F.explode("blocks").alias("b"), A.context_summary(F.col("blocks")).alias("summary")).select("b.name", "b.tokens", "b.text", "summary")


@query
def task_envelope(spark, d):
    x = assembled(spark, d).withColumn("blocks", A.blocks(F.col("sections")))
    of = lambda c: F.array_distinct(F.transform("selected", lambda s: s[c]))
    x = W.intent(x, F.lit(P.QUERY), source_types=of("source_type"), kinds=of("kind"), source_refs=of("source_key"))
    notes = L.visible(P.records(spark, d), REQ, S, NOW).where(F.col("kind").isin(*W.NOTE_KINDS))
    x = W.output_contract(x.crossJoin(W.preferences(W.preference_signals(notes))))  # one row each
    lists = (F.array_join(c, "; ").alias(c) for c in ("constraints", "source_refs", "must_include", "must_avoid"))
    return x.select("workflow_type", "action", "target_type", "goal", "output_type", "confidence", *lists, W.objective(F.col("workflow_type"), F.col("target_type"), F.col("action"), F.size("blocks") > 0).alias("objective"))


@query
def html_text(spark, d):
    return P.table(spark, d, "pages").select("page_id", I.html_text(F.col("html")).alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query
def structured_fields(spark, d):
    x = P.table(spark, d, "events").select("event_id", J.extract_fields(F.col("props")).alias("f"))
    return x.select("event_id", F.explode("f").alias("f")).select("event_id", "f.path", "f.value_text", "f.value_type")


@query
def structured_text(spark, d):
    f = J.extract_fields(F.col("payload"))
    x = P.payloads(spark, d).withColumn("f", f)
    return x.select("o_orderkey", J.structured_text(F.col("f"), J.primary_paths(F.col("f"))).alias("text"))


@query
def relational_records(spark, d):
    x = P.payloads(spark, d).withColumn("f", J.extract_fields(F.col("payload")))
    return x.select("o_orderkey", F.explode("f").alias("f")).select("o_orderkey", "f.path", "f.value_text")


@query
def workflow_intent(spark, d):
    x = P.table(spark, d, "conversations").where("role = 'user'")
    return W.intent(x, F.col("text")).select("conv_id", "turn", "workflow_type", "action", "target_type", "goal", "output_type", "confidence", F.array_join("constraints", "; ").alias("constraints"))


@query
def preference_signals(spark, d):
    return W.preferences(W.preference_signals(P.records(spark, d).where(F.col("kind").isin(*W.NOTE_KINDS)), ("scope",))).select("scope", "n", *(f"{s}_hits" for s in W.SIGNALS), *W.PREFERENCES, F.array_join("style_notes", "; ").alias("style_notes"))


@query
def eval_hits(spark, d):
    """Each benchmark item as a case: expected are documents of two sources and the item's first word."""
    r = P.records(spark, d)
    found = R.retrieve_batch(r, C.chunk_records(r, S), P.cases(spark, d), P.BATCH_REQUEST, S, NOW)
    got = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_key", "text"))).alias("g"))
    x = P.cases(spark, d).join(got, "query_id", "left")
    keys = F.coalesce(F.transform("g", lambda e: e["source_key"]), F.array().cast("array<string>"))
    x = x.select("query_id", keys.alias("retrieved_keys"), F.array(F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"), F.lit(":x")), F.lit("src3:x")).alias("expected_keys"), F.array(F.element_at(F.split("query_text", " "), 1)).alias("expected_terms"), F.coalesce(F.array_join(F.transform("g", lambda e: e["text"]), "\n"), F.lit("")).alias("term_text"), F.coalesce(F.size("g"), F.lit(0)).alias("retrieval_count"))
    return E.hits(x).select("query_id", F.greatest(F.col("retrieval_count"), F.lit(0)).alias("retrieval_count"), F.array_join("matched_keys", ",").alias("matched_keys"), F.size("matched_terms").alias("n_terms"), "retrieval_hit", "assembly_hit")


@query
def eval_compare(spark, d):
    return E.compare(P.eval_run(spark, d, 0), P.eval_run(spark, d, 1))


@query
def eval_gate(spark, d):
    a, b = P.eval_run(spark, d, 0), P.eval_run(spark, d, 1)
    x = E.gate(b, E.compare(a, b))
    return x.select("total_cases", F.round("retrieval_hit_rate", 6).alias("retrieval_hit_rate"), F.round("assembly_hit_rate", 6).alias("assembly_hit_rate"), "retrieval_regressions", "assembly_regressions", "passed", F.size("failures").alias("n_failures"))


@query
def tier_report(spark, d):
    x = E.tier_report(P.runs(spark, d))
    return x.select("series", "tier", "runs", *(F.round(c, 6).alias(c) for c in x.columns if "_" in c))


@query
def dataset_profile(spark, d):
    x = E.dataset_profile(P.records(spark, d))
    return x.withColumn("avg_chars", F.round("avg_chars", 6)).withColumn("fields", F.array_join("fields", ","))


@query
def variant_split(spark, d):
    i = F.col("doc_id")
    x = P.records(spark, d).withColumn("structured_json", F.when(i % 4 == 0, F.to_json(F.struct(i.alias("n")))))
    with_data = x.where("structured_json is not null").select("id", F.lit("structured").alias("variant"), "structured_json")
    return with_data.union(x.select("id", F.lit("unstructured").alias("variant"), F.lit(None).cast("string")))


@query
def training_export(spark, d):
    """The lines that the export writes, with their vectors."""
    r = P.records(spark, d).withColumn("lexical_tokens", X.lexical_tokens(F.col("text")))
    x = K.training_lines(V.embedded(r, S), S)
    cols = [F.col(c) for c in ("id", "kind", "scope", "source_type", "content_class", "user_id", "session_id", "source_key", "source_status", "content_checksum", "title", "token_count_estimate")]
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    return x.select("id", F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols)).alias("fields"), "created_at", F.size("lexical_tokens").alias("n_tokens"), F.size("embedding").alias("dims"), F.size(F.filter("embedding", lambda v: v != 0)).alias("nonzero"), F.round(squares, 6).alias("length_sq"))


@query
def audit_rows(spark, d):
    """The row that the log of a request gets."""
    r = P.records(spark, d)
    chunks = C.chunk_records(r, S)
    found = R.of_request(r, chunks, REQ, S, NOW)
    items = R.finished(found, r, chunks, REQ, S, NOW, few=True)
    x = K.audit_row(R.counts_of(found, r, REQ, S, NOW), items, L.visible(r, REQ, S, NOW), L.excluded_counts(r, REQ, S, NOW), REQ, NOW)
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("applied_filters")), lambda k: F.concat(k, F.lit("="), F.array_join(F.element_at(F.col("applied_filters"), k), ","))), "; ")
    why = F.array_join(F.transform(F.array_sort(F.map_keys("excluded_counts")), lambda k: F.concat(k, F.lit("="), F.element_at(F.col("excluded_counts"), k).cast("string"))), "; ")
    seen = F.array_join("visible_record_ids", ",")
    return x.select(
        "audit_id", "query_text", "user_id", "session_id", "model_target", "enforce_policy", shown.alias("applied_filters"), why.alias("excluded_counts"),
        F.size("visible_record_ids").cast("long").alias("n_visible"), F.md5(seen.cast("binary")).alias("visible_md5"),
        *(F.array_join(c, ",").alias(c) for c in ("selected_record_ids", "selected_chunk_ids")),
        *(f"candidate_counts.{c}" for c in ("visible_records", "eligible_chunks", "reranked_candidates")), "retrieval_strategy",
    )


@query
def provenance_items(spark, d):
    """Where each retrieved item comes from."""
    x = K.with_provenance(retrieved(spark, d)).select("rank", "provenance.*")
    return x.select("rank", "record_id", "source_key", "source_status", "content_checksum", "source_type", "content_class", "user_id", "session_id", F.array_join("tags", ",").alias("tags"), "policy.confidentiality", "source_version")


@query
def import_files(spark, d):
    """Texts, payloads and states of files of all kinds."""
    x = I.import_files(P.files(spark, d), lenient=True)
    return x.select("path", "status", "reason", "source_key", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("structured_json").isNotNull().alias("has_data"))


@query
def rare_filters(spark, d):
    """Rules that other queries don't reach: source keys, allowed sessions, and requests of nobody in particular."""
    x = P.records(spark, d)
    allowed = F.when(F.col("doc_id") % 5 == 1, F.array(F.lit("s1"), F.lit("s2"))).otherwise(F.array().cast("array<string>"))
    x = x.withColumn("policy", F.col("policy").withField("allowed_session_ids", allowed))
    keys = tuple(f"src{i}:{n:04d}" for i in range(20) for n in range(0, 200, 2))
    out = None
    for name, r in (("keys", Request("x", session_id="s3", user_id="u1", source_keys=keys, max_age_days=100_000)), ("nobody", Request("x", max_age_days=100_000)), ("session", Request("x", session_id="s2", max_age_days=100_000))):
        part = L.with_reason(x, r, S, NOW).select(F.lit(name).alias("request"), "id", F.coalesce("excluded", F.lit("visible")).alias("reason"))
        out = part if out is None else out.union(part)
    return out


@query
def run_table(spark, d):
    return E.run_table(*P.run_parts(spark, d))


@query
def pruning_report(spark, d):
    k = F.col("s_suppkey")
    x = P.table(spark, d, "supplier").select(P.pick(("structured", "unstructured"), k % 2).alias("variant"), P.pick(("base", "perturbed", "medical"), k % 3).alias("dataset"), (k % 433).alias("active"), (k % 17).alias("pruned"), (k % 433 + k % 17).alias("imported"))
    return E.pruning_report(x).select("variant", "dataset", *(F.round(c, 6).alias(c) for c in ("avg_active", "avg_pruned", "avg_imported", "pruned_percent")))


@query
def cases_for_runs(spark, d):
    """Cases of fifty runs out of the benchmark's items, four of each tier."""
    i = F.col("item_id")
    return E.cases_for_runs(P.table(spark, d, "benchmark").select(i.alias("query_id"), P.pick(tuple(E.TIERS), i % 10).alias("tier")))


@query
def valid_terms(spark, d):
    """The words of benchmark items that any document holds."""
    cases = P.cases(spark, d).select(F.col("query_id").cast("string").alias("name"), F.array_distinct(F.split("query_text", " ")).alias("expected_terms"))
    x = E.valid_terms(cases, P.records(spark, d))
    return x.select("name", F.size("expected_terms").alias("n_terms"), F.array_join("valid_terms", " ").alias("valid_terms"))


@query
def perturbed_dataset(spark, d):
    x = B.perturbed(P.records(spark, d), buckets=4)
    return x.select("id", "scope", "user_id", "session_id", F.array_join("tags", ",").alias("tags"), "source_key", F.md5(F.col("text").cast("binary")).alias("text_md5"), "perturbed", "near_duplicate")


SQL = sql.SQL

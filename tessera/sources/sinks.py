"""Projections that leave the engine: training lines, audit rows, provenance, Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import vector as V

TRAINING = (
    "id kind scope source_type content_class user_id session_id source_id source_key source_version source_status external_id content_checksum "
    "source_updated_at source_last_synced_at deleted_at title summary text token_count_estimate lexical_tokens semantic_terms embedding urls tags "
    "metadata structured_data data_schema structured_fields policy created_at"
).split()
PROVENANCE = (
    "source_key source_version source_status external_id content_checksum source_type content_class source_updated_at source_last_synced_at "
    "deleted_at user_id session_id urls tags metadata structured_json data_schema structured_fields policy"
).split()
TIMES = ("source_updated_at", "source_last_synced_at", "deleted_at", "created_at")


def iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def shown(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string").alias(name)
    return (iso(name) if name in TIMES else F.col(name)).alias(name)


def training_lines(records: DataFrame, settings: Settings) -> DataFrame:
    """The 31 fields of a training line for each record, with its stored vector as a dense one."""
    x = records.withColumnRenamed("structured_json", "structured_data")
    x = x.withColumn("embedding", V.dense(F.col("buckets"), F.col("weights"), max(8, settings.embedding_dimensions)))
    return x.select(*(shown(x, c) for c in TRAINING))


def provenance(items: DataFrame) -> Column:
    """Where an item comes from, as one struct of 20 fields."""
    return F.struct(F.col("record_id"), *(shown(items, c) for c in PROVENANCE))


def with_provenance(items: DataFrame) -> DataFrame:
    return items.withColumn("provenance", provenance(items))


def audit_row(counts: DataFrame, items: DataFrame, visible: DataFrame, excluded: DataFrame, request, created_at) -> DataFrame:
    """One row about a retrieval, also of an empty one. counts has one row; the others are gathered into arrays."""
    ids = lambda df, c, order: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("c")))), lambda x: x["c"]).alias("v"))
    why = excluded.where("reason <> 'visible'").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("excluded_counts"))
    seen = ids(visible, "id", "id").withColumnRenamed("v", "visible_record_ids")
    chosen = ids(items, "record_id", "rank").withColumnRenamed("v", "selected_record_ids").crossJoin(ids(items, "chunk_id", "rank").withColumnRenamed("v", "selected_chunk_ids"))  # one row each
    x = counts.select(F.struct(*counts.columns).alias("candidate_counts")).crossJoin(why).crossJoin(seen).crossJoin(chosen)  # one row each
    filters = F.create_map(*(c for k, v in request.filters().items() for c in (F.lit(k), F.array(*map(F.lit, v)))))
    x = x.withColumn("query_text", F.lit(request.query_text)).withColumn("user_id", F.lit(request.user_id).cast("string")).withColumn("session_id", F.lit(request.session_id).cast("string"))
    x = x.withColumn("model_target", F.lit(request.model_target)).withColumn("enforce_policy", F.lit(request.enforce_policy)).withColumn("applied_filters", filters)
    x = x.withColumn("retrieval_strategy", F.when(F.size("selected_chunk_ids") > 0, "embedding_lexical_rerank").otherwise("semantic_lexical_hybrid")).withColumn("created_at", F.lit(created_at))
    return x.withColumn("audit_id", F.concat(F.lit("audit_"), F.substring(F.sha2(F.concat_ws("|", "query_text", F.col("created_at").cast("string"), F.array_join("selected_chunk_ids", ",")).cast("binary"), 256), 1, 32)))


def markdown_table(df: DataFrame) -> str:
    """A small result, such as the cases of a suite, as a Markdown table."""
    rows = df.collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)])


def behavior_evidence(result: dict, cases: list[dict], results: list[dict]) -> dict:
    """What a run shows: its figures, and for each case what was expected and what was found."""
    defined = {c["name"]: c for c in cases}
    one = lambda r, c: {
        "name": r["name"], "query_text": r["query_text"], "expected_source_keys": list(c.get("expected_source_keys") or []), "matched_source_keys": list(r["matched_keys"] or []),
        "expected_terms": list(c.get("expected_terms") or []), "expected_terms_scope": c.get("expected_terms_scope") or "assembled_context", "matched_expected_terms": list(r["matched_terms"] or []),
        "retrieval_hit": r["retrieval_hit"], "assembly_hit": r["assembly_hit"], "retrieval_count": r["retrieval_count"], "token_count_estimate": r["token_count_estimate"],
    }
    figures = {k: result[k] for k in ("suite_name", "run_id", "total_cases", "retrieval_hits", "assembly_hits", "retrieval_hit_rate", "assembly_hit_rate")}
    return {"evidence_type": "benchmark_run", **figures, "case_evidence": [one(r, defined.get(r["name"], {})) for r in results]}


def benchmark_report(result: dict, tables: dict[str, DataFrame]) -> str:
    """A run as Markdown: its figures, a table under each heading, and the evidence of each case."""
    lines = [f"# {result.get('suite_name', 'benchmark')}", "", *(f"- {k}: {v}" for k, v in result.items() if not isinstance(v, (list, dict)))]
    for name, df in tables.items():
        lines += ["", f"## {name}", "", markdown_table(df)]
    if result.get("skipped_records"):
        lines += ["", "## Skipped", "", *(f"- line {r['line']} ({r['source_key']}): {r['reason']}" for r in result["skipped_records"])]
    evidence = result.get("behavior_evidence", {}).get("case_evidence", [])
    lines += ["", "## Behavior Evidence"] if evidence else []
    for e in evidence:
        said = lambda values: ", ".join(values) or "none"
        lines += ["", f"### Evidence: {e['name']}", "", f"- Request: {e['query_text']}", f"- Retrieval hit: {e['retrieval_hit']} ({e['retrieval_count']} items)", f"- Assembly hit: {e['assembly_hit']} ({e['token_count_estimate']} tokens)"]
        lines += [f"- Expected source keys: {said(e['expected_source_keys'])}; matched: {said(e['matched_source_keys'])}", f"- Expected terms: {said(e['expected_terms'])}; matched: {said(e['matched_expected_terms'])}", f"- Expected terms scope: {e['expected_terms_scope']}"]
    return "\n".join(lines) + "\n"

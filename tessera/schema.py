"""Schemas of stored rows."""

from __future__ import annotations

POLICY = "struct<confidentiality:string,freshness_days:int,retention_days:int,allowed_user_ids:array<string>,allowed_session_ids:array<string>,allow_local_model_egress:boolean,allow_remote_model_egress:boolean>"
DATA_SCHEMA = "struct<schema_name:string,schema_mode:string,root_type:string,field_paths:array<string>,primary_text_paths:array<string>>"
FIELDS = "array<struct<path:string,value_text:string,value_type:string>>"

#: What callers give for a record; everything but text and structured_json has a default.
PAYLOAD = (
    f"id string, text string, structured_json string, kind string, scope string, title string, summary string, user_id string, session_id string, "
    f"source_type string, content_class string, source_id string, source_key string, external_id string, source_updated_at timestamp, "
    f"source_last_synced_at timestamp, urls array<string>, tags array<string>, metadata map<string,string>, declared_schema {DATA_SCHEMA}, policy "
    f"{POLICY}, created_at timestamp, seq long"
)
RECORD = (
    f"id string, kind string, scope string, owner_scope string, source_type string, content_class string, title string, text string, summary "
    f"string, user_id string, session_id string, source_id string, source_key string, source_version int, source_status string, external_id "
    f"string, content_checksum string, source_updated_at timestamp, source_last_synced_at timestamp, deleted_at timestamp, urls array<string>, "
    f"tags array<string>, metadata map<string,string>, structured_json string, data_schema {DATA_SCHEMA}, structured_fields {FIELDS}, "
    f"schema_field_paths array<string>, policy {POLICY}, token_count_estimate int, lexical_tokens array<string>, semantic_terms array<string>, "
    f"buckets array<int>, weights array<double>, created_at timestamp"
)
CHUNK = "chunk_id string, record_id string, chunk_index int, text string, token_count_estimate int, lexical_tokens array<string>, buckets array<int>, weights array<double>"
DEFAULTS = {"kind": "research_finding", "scope": "session", "source_type": "direct_text", "content_class": "raw_source"}
EVAL_RESULT = "run_id string, suite_name string, created_at timestamp, seq int, name string, query_text string, matched_keys array<string>, matched_terms array<string>, retrieval_hit boolean, assembly_hit boolean, retrieval_count int, token_count_estimate int"


def columns(ddl: str) -> list[str]:
    """The 'name type' pairs of a DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return out

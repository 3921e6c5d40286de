"""Scenarios of the service: scopes, versions, duplicates, imports, assembly, workflows, preferences, evaluation, upkeep."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.config import Request, Settings
from tessera.operators import lifecycle as Y
from tessera.service import Service
from tessera.sources import store
from tessera.streaming.ingest import ingest_stream, payload_stream, windowed_counts

NOW = datetime(2024, 3, 1, 12)
SHARED = {"confidentiality": "shareable"}


@pytest.fixture
def service(spark, tmp_path):
    return Service(spark, str(tmp_path / "store"), Settings(), as_of=NOW)


def ask(service, text, **more):
    return service.query(text, **more).collect()


def test_scopes_and_versions(service):
    service.upsert_source(
        {"source_key": "a", "text": "The quarterly forecast of the river project", "scope": "session", "session_id": "s1", "kind": "research_finding"},
        {"source_key": "b", "text": "The quarterly forecast for everyone", "scope": "global", "kind": "research_report", "policy": SHARED},
        {"source_key": "c", "text": "My own quarterly forecast", "scope": "user", "user_id": "u1"},
        {"source_key": "d", "text": "A hidden quarterly forecast", "scope": "global"},
    )
    assert {r["source_key"] for r in ask(service, "quarterly forecast", session_id="s1", user_id="u1")} == {"a", "b", "c"}
    assert {r["source_key"] for r in ask(service, "quarterly forecast", session_id="s2")} == {"b"}
    assert ask(service, "   ") == []
    same = service.upsert_source({"source_key": "a", "text": "The quarterly forecast of the river project", "scope": "session", "session_id": "s1", "title": "ignored"})
    assert same[0]["source_version"] == 1
    new = service.upsert_source({"source_key": "a", "text": "A new forecast of the mountain", "scope": "session", "session_id": "s1"})
    assert (new[0]["source_version"], new[0]["source_status"]) == (2, "active")
    old = service.store.records().where("source_key = 'a' and source_version = 1").first()
    assert old["source_status"] == "superseded"
    assert service.delete_source("a", "session", session_id="s1") == 1 and service.delete_source("a", "session", session_id="s1") == 0
    assert "a" not in {r["source_key"] for r in ask(service, "forecast mountain", session_id="s1")}
    again = service.upsert_source({"source_key": "a", "text": "A new forecast of the mountain", "scope": "session", "session_id": "s1"})
    assert again[0]["source_version"] == 3
    assert service.store.exists("audit") and service.store.generation() == 5


def test_near_duplicates_are_rejected_at_ingest(service):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    assert service.store_record("research_finding", text, session_id="s") is not None
    assert service.store_record("research_finding", text + " ", session_id="s") is None
    assert service.store_record("research_finding", text, session_id="t") is not None
    assert service.store_record("training_example", text, session_id="s") is not None and service.store_record("training_example", text, session_id="s") is not None
    with pytest.raises(ValueError):
        service.store_record("research_finding", " ")


def test_fold_of_near_duplicates_uses_a_bounded_history(spark):
    tokens = [["a", "b", "c"]] + [[f"x{i}"] for i in range(10)] + [["a", "b", "c"], ["x9"]]
    rows = [(str(i), i, "k", "global", None, None, t) for i, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "id string, seq long, kind string, scope string, session_id string, user_id string, lexical_tokens array<string>")
    got = {int(r["id"]) for r in Y.near_duplicates(df, Settings()).where("rejected").collect()}
    assert got == {12}  # the first is out of the last ten by then, x9 is not


def test_structured_data_and_declared_intent(service):
    service.upsert_source({"source_key": "mail", "structured_data": {"subject": "Launch", "body": "We launch in May", "meta": {"pages": [1, 2]}}, "scope": "session", "session_id": "s", "declared_schema": {"schema_name": "email_source", "schema_mode": "declared", "root_type": "object", "field_paths": [], "primary_text_paths": []}})
    r = service.store.records().first()
    assert r["text"].startswith("body: We launch in May subject: Launch") and "pages" in r["lexical_tokens"]
    assert r["data_schema"]["field_paths"] == ["subject", "body", "meta.pages[0]", "meta.pages[1]"]
    got = service.prepare_task_envelope(Request("answer the email", session_id="s", assembly_mode="drafting", token_budget=400))
    assert (got["workflow_type"], got["output_type"], got["target_type"]) == ("reply", "email_reply", "email")
    service.upsert_source({"source_key": "i", "structured_data": {"note": "go north", "secretword": "x"}, "session_id": "s", "declared_schema": {"schema_name": " User_Intent", "schema_mode": "declared"}})
    intent = service.store.records().where("source_key = 'i'").first()
    assert intent["text"] == "note: go north" and "secretword" not in intent["lexical_tokens"]


@pytest.mark.parametrize(
    ("kind", "query", "mode", "want"),
    [
        ("research_finding", "summarize the meeting notes", "assistant", ("summarize", "summary", "note")),
        ("research_report", "research ACME expansion risks", "research", ("research", "report", "research_material")),
        ("research_finding", "rewrite this note to be concise and professional", "drafting", ("rewrite", "rewrite", "note")),
        ("research_finding", "write code to fix the parser", "assistant", ("code", "code", "codebase")),
    ],
)
def test_workflows(service, kind, query, mode, want):
    service.ingest_source({"text": "ACME meeting notes on expansion risks and the parser", "kind": kind, "session_id": "s1", "scope": "session"})
    got = service.prepare_task_envelope(Request(query, user_id="u1", session_id="s1", assembly_mode=mode, token_budget=400))
    assert (got["workflow_type"], got["output_type"], got["target_type"]) == want
    assert got["objective"] and "irrelevant context" in got["must_avoid"]


def test_equal_texts_assemble_to_one_item(service):
    text = "the launch plan of the north office in spring"
    service.upsert_source(*({"source_key": k, "text": text, "session_id": "s", "scope": "session"} for k in ("x", "y")))
    row = service.assemble_context(Request("launch plan", session_id="s")).first()
    assert len(row["items"]) == 2 and len(row["selected"]) == 1 and row["omitted_items"] == 1 and row["truncation_reason"] == "token_budget_reached"
    assert "[1] research_finding (session, direct_text, score=" in row["context_text"] and row["context_text"].startswith("Request: launch plan\nMode: assistant\n\nUse the")
    empty = service.assemble_context(Request("launch plan", session_id="other")).first()
    assert empty["context_text"].endswith("No stored context matched the request.") and empty["omitted_items"] == 0


def test_import(service, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    files = {"a.txt": "plain text", "b.html": "<p>Tom &amp; <b>Ann</b></p><script>x()</script>", "c.xml": "<r><a>one</a><b>two</b></r>", "d.json": '{"title": "T", "n": [1]}', "e.ndjson": '{"k": 1}\nnot json\n{"k": 2}', "f.bin": "x", "g.csv": "a,b\n1,2", "sub/h.md": "deep", "k.txt": "  "}
    for name, text in files.items():
        (d / name).write_text(text)
    (d / "bad.txt").write_bytes(b"\xff\xfe\x00")
    got = {r["path"].rsplit("/", 1)[1]: r for r in service.import_path(str(d), recursive=True, scope="global", kind="research_finding")}
    assert {n for n, r in got.items() if r["status"] == "skipped"} == {"f.bin", "bad.txt", "k.txt"}
    assert got["f.bin"]["reason"] == "path_not_found_or_unsupported" and got["bad.txt"]["reason"] == "unsupported_or_unreadable"
    text = {r["source_key"].rsplit("/", 1)[1]: r["text"] for r in service.store.records().collect()}
    assert text["b.html"] == "Tom & Ann" and text["c.xml"] == "one two" and text["d.json"].startswith("title: T n: 1") and "not json" in text["e.ndjson"] and text["g.csv"] == "a,b 1,2"
    again = service.import_path(str(d), mode="create", scope="global")
    assert {r["reason"] for r in again if r["path"].endswith("a.txt")} == {"duplicate_or_rejected"}


def test_preferences_merge(service):
    first = service.update_workflow_preference(user_id="u1", approved_text="Be concise and direct; take initiative.")
    assert first["brevity_preference"] == "high" and first["autonomy_level"] == "medium_high" and first["style_preferences"] == {"directness": "high"} and first["evidence_count"] == 1
    second = service.update_workflow_preference(user_id="u1", preference_data={"risk_tolerance": "low", "style_notes": ["short mails"], "workflow_defaults": {"reply": {"include_next_step": False}}})
    assert second["brevity_preference"] == "high" and second["risk_tolerance"] == "low" and second["evidence_count"] == 2
    assert second["workflow_defaults"]["reply"]["include_next_step"] is True and "short mails" in second["style_notes"]


def test_prune_stats_and_export(service):
    rows = [{"source_key": f"k{i}", "text": f"note number {i} about topic {i * 7}", "scope": "global", "policy": SHARED, "kind": "user_prompt", "created_at": NOW - timedelta(minutes=i)} for i in range(30)]
    service.upsert_source(*rows, {"source_key": "old", "text": "an old note", "scope": "global", "kind": "search_query", "created_at": NOW - timedelta(days=90)})
    left = {r["source_key"] for r in service.store.records().collect()}
    assert left == {f"k{i}" for i in range(24)} and service.prune()["pruned_records"] == 0
    stats = {(r["dimension"], r["value"]): r["n"] for r in service.stats().collect()}
    assert stats["total", "all"] == stats["kind", "user_prompt"] == 24
    n, path = service.export_training()
    line = json.loads(service.spark.read.text(path).first()[0])
    assert n == 24 and len(line) == 31 and "deleted_at" in line and line["deleted_at"] is None
    listed = service.list_records(kind="user_prompt", limit=2).collect()
    assert [r["source_key"] for r in listed] == ["k0", "k1"] and listed[0]["total"] == 24
    assert service.get_record(listed[0]["id"])["source_key"] == "k0" and service.get_record("none") is None and service.health()["ok"]


def test_evaluation(service, tmp_path):
    data, cases = tmp_path / "d.jsonl", tmp_path / "c.json"
    data.write_text("\n".join(json.dumps({"source_key": f"law:{i:04}", "text": f"ruling {i} on water rights", "session_id": "s", "scope": "session"}) for i in range(3)))
    good = {"name": "hit", "query_text": "water rights ruling", "session_id": "s", "expected_source_keys": ["law:9999"], "expected_terms": ["RIGHTS"]}
    bad = {"name": "miss", "query_text": "water rights", "session_id": "s", "expected_source_keys": ["tax:1"], "expected_terms": ["volcano"], "expected_terms_scope": "retrieved_records"}
    cases.write_text(json.dumps({"name": "suite", "cases": [good, bad]}))
    result, report = service.benchmark_jsonl(str(data), str(cases))
    assert (result["total_cases"], result["retrieval_hit_rate"], result["assembly_hit_rate"]) == (2, 0.5, 0.5) and "| miss | False | False |" in report
    service.save_evaluation_suite("two", [good])
    other = service.run_evaluation_suite("two", run_id="r2")
    compared = {r["name"]: r for r in service.compare_evaluation_runs(result["run_id"], other).collect()}
    assert compared["hit"]["candidate_retrieval_hit"] and not compared["miss"]["candidate_retrieval_hit"] and not compared["miss"]["retrieval_changed"]
    gate = service.gate_evaluation_run(result["run_id"], other)
    assert not gate["passed"] and gate["failures"][0] == "retrieval_hit_rate_below_threshold: actual=0.500 required=0.800" and gate["retrieval_regressions"] == 0
    assert service.gate_evaluation_run("r2")["passed"] and service.list_evaluation_runs().count() == 2
    data.write_text('{"source_key": "a", "text": "x"}\n\n{"text": "y"}')
    with pytest.raises(ValueError, match="line 3 has no source_key"):
        service.benchmark_jsonl(str(data), str(cases))


def test_streaming_ingest(service, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"source_key": "k", "text": "first text", "scope": "global"}))
    ingest_stream(service, payload_stream(service.spark, str(folder)), str(tmp_path / "cp"), once=True).awaitTermination()
    (folder / "2.json").write_text(json.dumps({"source_key": "k", "text": "second text", "scope": "global"}))
    ingest_stream(service, payload_stream(service.spark, str(folder)), str(tmp_path / "cp"), once=True).awaitTermination()
    got = {(r["source_version"], r["source_status"]) for r in service.store.records().collect()}
    assert got == {(1, "superseded"), (2, "active")}


def test_windowed_counts(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "a", 1.0), (datetime(2024, 1, 1, 0, 50), "a", 2.0), (datetime(2024, 1, 1, 1, 0), "b", 4.0)], "ts timestamp, event_type string, value double")
    got = {(r["start"].hour, r["event_type"]): (r["n"], r["total"]) for r in windowed_counts(df).collect()}
    assert got == {(0, "a"): (2, 3.0), (1, "b"): (1, 4.0)}


def test_single_and_batch_retrieval_agree(spark, service):
    service.upsert_source(*({"source_key": f"k{i}", "text": f"the {w} of the {v} river", "scope": "global", "policy": SHARED} for i, (w, v) in enumerate([("bank", "long"), ("mouth", "wide"), ("bed", "dry"), ("source", "short")])))
    from tessera.operators import retrieval as R

    records, chunks = service.store.records(), service.store.chunks()
    texts = spark.createDataFrame([(1, "source of a short river"), (2, "dry bed"), (3, " ")], "query_id long, query_text string")
    both = R.retrieve_batch(records, chunks, texts, Request("x", limit=3), service.settings, NOW)
    for q, text in ((1, "source of a short river"), (2, "dry bed")):
        one = R.retrieve(records, chunks, Request(text, limit=3), service.settings, NOW).select("rank", "chunk_id", F.round("score", 6).alias("s")).collect()
        many = both.where(F.col("query_id") == q).select("rank", "chunk_id", F.round("score", 6).alias("s")).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 3
    assert both.where("query_id = 3").count() == 0


def test_intent_data_takes_part_in_retrieval(service):
    service.upsert_source({"source_key": "a", "text": "harbour logistics in winter", "scope": "global", "policy": SHARED}, {"source_key": "b", "text": "unrelated gardening advice", "scope": "global", "policy": SHARED})
    plain = ask(service, "help me with this")
    data = json.dumps({"goal": "harbour logistics", "secretword": "gardening"})
    declared = {"schema_name": "user_intent", "root_type": "object", "primary_text_paths": ["goal"]}
    score = lambda rows: {r["source_key"]: r["lexical_score"] for r in rows}
    assert not any(score(plain).values())
    assert score(ask(service, "help me with this", intent_json=data))["a"] > 0 and score(ask(service, "help me with this", intent_json=data)).get("b", 0) > 0
    only = score(ask(service, "help me with this", intent_json=data, intent_schema=declared))
    assert only["a"] > 0 and not only.get("b")


def test_declared_schema_and_missing_paths_at_import(service, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"goal": "draft a client update", "tone": "concise"}))
    got = service.import_path(str(tmp_path / "i.json"), scope="global", data_schema={"schema_name": "user_intent", "schema_mode": "declared", "primary_text_paths": ["goal"]})
    assert [r["status"] for r in got] == ["imported"]
    r = service.store.records().first()
    assert r["data_schema"]["schema_name"] == "user_intent" and r["data_schema"]["primary_text_paths"][0] == "goal"
    assert service.import_path(str(tmp_path / "none.txt")) == [{"path": str(tmp_path / "none.txt"), "status": "skipped", "reason": "path_not_found_or_unsupported", "source_key": None}]


def test_benchmark_files_and_skipped_lines(service, tmp_path):
    data, cases = tmp_path / "d.jsonl", tmp_path / "c.json"
    lines = [{"source_key": "profile", "scope": "user", "user_id": "u1", "kind": "user_profile_note", "text": "Client ACME prefers concise Friday status updates."}, {"source_key": "matter", "scope": "session", "session_id": "s1", "text": "ACME-17 discovery is ongoing.", "metadata": {"n": 1}, "structured_data": {"matter": {"code": "X9"}}}, {"source_key": "odd", "kind": "no such kind", "text": "x"}]
    data.write_text("\n".join(map(json.dumps, lines)))
    cases.write_text(json.dumps({"cases": [{"name": "client_update", "query_text": "draft a concise ACME-17 client update", "user_id": "u1", "session_id": "s1", "expected_source_keys": ["profile", "matter"], "expected_terms": ["ACME-17"]}]}))
    result, _ = service.benchmark_jsonl(str(data), str(cases), "private", output_dir=str(tmp_path / "reports"))
    assert (result["imported_records"], result["retrieval_hits"], result["assembly_hits"]) == (2, 1, 1)
    assert result["skipped_records"] == [{"line": 3, "source_key": "odd", "reason": "unknown kind or scope"}]
    evidence = result["behavior_evidence"]["case_evidence"][0]
    assert (evidence["name"], evidence["expected_terms_scope"], evidence["matched_expected_terms"]) == ("client_update", "assembled_context", ["ACME-17"])
    assert json.loads((tmp_path / "reports" / "benchmark-result.json").read_text())["suite_name"] == "private"
    report = (tmp_path / "reports" / "benchmark-report.md").read_text()
    assert "Evidence: client_update" in report and "Expected terms scope: assembled_context" in report and "line 3 (odd)" in report
    matter = service.store.records().where("source_key = 'matter'").first()
    assert "code: X9" in matter["text"] and matter["metadata"]["n"] == "1"


def test_a_change_writes_its_own_rows_alone(service):
    def files(name):
        root = service.store.root.removeprefix("file:")
        return {str(f) for f in Path(root, name).rglob("*.parquet")}

    service.upsert_source(*({"source_key": f"k{i}", "text": f"record number {i} on subject {i * 3}", "scope": "global"} for i in range(20)))
    records, chunks = files("records"), files("chunks")
    service.upsert_source({"source_key": "k3", "text": "another text on something else", "scope": "global"})
    new = sum(service.spark.read.parquet(f).count() for f in files("chunks") - chunks)
    changed = service.spark.read.parquet(*(files("records") - records))
    assert new == 1 and sorted((r["source_key"], r["source_version"], r["source_status"]) for r in changed.collect()) == [("k3", 1, "superseded"), ("k3", 2, "active")]
    for i in range(store.COMPACT + 1):
        service.update_record(service.store.records().where("source_key = 'k5'").first()["id"], source_status="deleted" if i % 2 == 0 else "active")
    assert len(service.store.manifest()["changes"]) <= store.COMPACT and service.store.records().count() == 21
    assert service.store.chunks().count() == 21 and service.store.records().where("source_status = 'deleted'").count() == 1
    with pytest.raises(ValueError):
        service.update_record("x", source_status="gone")


def test_of_two_writers_none_is_lost(service):
    at = service.store.manifest()
    service.upsert_source({"source_key": "a", "text": "the first text", "scope": "global"})
    row = service.store.records()
    with pytest.raises(store.Conflict):
        service.store.commit(at, row)  # saw the generation before
    first, calls = service.store.manifest, []

    def late(*generation):  # another writer comes between reading the manifest and writing
        at = first(*generation)
        if not calls and not generation:
            calls.append(1)
            Service(service.spark, service.store.root, as_of=NOW).upsert_source({"source_key": "b", "text": "the second text", "scope": "global"})
        return at

    service.store.manifest = late
    service.upsert_source({"source_key": "c", "text": "the third text", "scope": "global"})
    service.store.manifest = first
    assert {r["source_key"] for r in service.store.records().collect()} == {"a", "b", "c"}


def test_audited_items_carry_provenance(service):
    service.upsert_source({"source_key": "a", "text": "the river ruling", "scope": "global", "policy": SHARED, "tags": ["law"]})
    r = service.retrieve(Request("river ruling")).first()
    assert service.remove_record("none") is False
    assert r["provenance"]["source_key"] == "a" and r["provenance"]["tags"] == ["law"] and r["provenance"]["source_version"] == 1
    assert service.spark.read.json(f"{service.store.root}/audit").count() == 1
    assert service.remove_record(r["record_id"]) and service.get_record(r["record_id"]) is None and ask(service, "river ruling") == []

"""The engine behind one object: storing, searching and assembling context, evaluation, preferences and upkeep."""

from __future__ import annotations

import json
import time
from dataclasses import asdict
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schema
from tessera.config import KINDS, SCOPES, STATUSES, Request, Settings
from tessera.operators import assembly as A
from tessera.operators import evaluation as E
from tessera.operators import filters as L
from tessera.operators import ingest as N
from tessera.operators import lifecycle as Y
from tessera.operators import retrieval as R
from tessera.operators import workflow as W
from tessera.sources import importers as I  # noqa: E741
from tessera.sources import sinks
from tessera.sources.store import Conflict, Store

PREFERENCE = "user_workflow_preference"
#: How often a change starts again because another writer was first.
RETRIES = 5
BASE_PREFERENCE = {"autonomy_level": "medium", "clarification_preference": "medium", "brevity_preference": "medium", "structure_preference": "medium", "initiative_preference": "medium", "risk_tolerance": "moderate", "evidence_preference": "medium", "style_preferences": {}, "workflow_defaults": {}, "style_notes": [], "evidence_count": 0}


class Service:
    """Every method takes a batch where a batch makes sense; as_of fixes the clock (now by default)."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, as_of: datetime | None = None):
        self.spark, self.settings, self.store, self._as_of = spark, settings or Settings.from_env(), Store(spark, root), as_of

    @property
    def now(self) -> datetime:
        return self._as_of or datetime.now(timezone.utc)

    # --- writing ---------------------------------------------------------------------------------------------------

    def frame(self, payloads: list[dict]) -> DataFrame:
        """Payload dictionaries as rows, in their order; structured_data is JSON-encoded."""
        names = [c.split()[0] for c in schema.columns(schema.PAYLOAD)]
        rows = []
        for i, p in enumerate(payloads):
            if p.get("kind", KINDS[0]) not in KINDS or p.get("scope", SCOPES[0]) not in SCOPES:
                raise ValueError(f"payload {i}: unknown kind or scope")
            p = dict(p, seq=i)
            if p.get("structured_data") is not None:
                p["structured_json"] = json.dumps(p["structured_data"], ensure_ascii=False)
            rows.append({n: p.get(n) for n in names})
        return self.spark.createDataFrame(rows, schema.PAYLOAD)

    def _again(self, write):
        """write(manifest), again from the next generation as long as another writer was first."""
        for _ in range(RETRIES):
            try:
                return write(self.store.manifest())
            except Conflict:
                continue
        raise Conflict(f"{RETRIES} writers in a row were first")

    def _commit(self, at: dict, changed: DataFrame) -> None:
        """Commits changed rows (records and whether they are new) and prunes what is over the limits afterwards.

        What is stored and not changed is read for the columns that pruning needs, and is not written again."""
        stored = self.store.records(at)
        slim = ("id", "scope", "kind", "created_at", "policy")
        untouched = stored.select(*slim).join(changed.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
        gone = Y.prune_marks(untouched.unionByName(changed.select(*slim)), self.settings, self.now).where("prune_reason is not null").select("id").persist()
        pruned = gone.count()
        kept = changed.join(gone.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left_anti")
        self.store.commit(at, kept.drop("new"), gone, N.chunked(kept.where("new"), self.settings))
        if pruned:
            self.store.add(pruned_records_total=pruned)
        gone.unpersist()

    def _add(self, payloads: DataFrame) -> list[dict]:
        """Stores payloads but near duplicates; id and source_key of each stored one, in their order."""

        def write(at: dict) -> list[dict]:
            new = N.drop_near_duplicates(N.prepare(payloads, self.settings, self.now), self.store.records(at), self.settings).persist()
            rows = [r.asDict() for r in new.select("id", "source_key", "seq").orderBy("seq").collect()]  # of the given payloads
            if rows:
                self._commit(at, new.drop("seq").withColumn("new", F.lit(True)))
                if self.settings.training_export_enabled:
                    self.store.append_json("training", sinks.training_lines(new, self.settings).withColumn("created_date", F.to_date("created_at")), "created_date")
            new.unpersist()
            return rows

        return self._again(write)

    def _create(self, payloads: list[dict]) -> list[str]:
        return [r["id"] for r in self._add(self.frame(payloads))]

    def store_record(self, kind: str, text: str, scope: str = "session", **more) -> str | None:
        if not text.strip():
            raise ValueError("text must not be empty")
        ids = self._create([{"kind": kind, "text": text, "scope": scope, "content_class": "normalized_memory", **more}])
        return ids[0] if ids else None

    def ingest_source(self, *payloads: dict) -> list[str]:
        return self._create([{**p, "source_id": p.get("source_key")} for p in payloads])

    def upsert_source(self, *payloads: dict) -> list[dict]:
        """The current versions of the payloads' keys afterwards, in no order."""
        if not all(str(p.get("source_key") or "").strip() for p in payloads):
            raise ValueError("every payload needs a source_key")
        return [r.asDict(True) for r in self.upsert_frame(self.frame([{**p, "source_id": p["source_key"]} for p in payloads])).collect()]

    def upsert_frame(self, payloads: DataFrame) -> DataFrame:
        """upsert_source() for rows of schema.PAYLOAD of any number."""
        new = N.prepare(payloads, self.settings, self.now).where("source_key is not null").persist()

        def write(at: dict) -> DataFrame:
            changed, shown = N.upsert(self.store.records(at), new, self.now)
            changed = changed.persist()
            shown = shown.select("id", "source_key", "scope", "owner_scope", "source_version", "source_status", "content_checksum").persist()
            shown.count()
            self._commit(at, changed)
            changed.unpersist()
            return shown

        try:
            return self._again(write)
        finally:
            new.unpersist()

    def delete_source(self, source_key: str, scope: str = "session", user_id: str | None = None, session_id: str | None = None) -> int:
        """Marks the latest version deleted; how many rows that changed (0 if it is missing or deleted already)."""
        owner = {"session": session_id, "user": user_id}.get(scope)
        t = self.spark.createDataFrame([(source_key.strip(), scope, owner.strip() if owner else None, self.now)], "source_key string, scope string, owner string, deleted_at timestamp")

        def write(at: dict) -> int:
            mine = self.store.records(at).where((F.col("source_key") == source_key.strip()) & (F.col("scope") == scope))
            after = Y.soft_delete(mine, t).where((F.col("source_status") == "deleted") & (F.col("deleted_at") == F.lit(self.now)))
            before = mine.where("source_status <> 'deleted'").select(F.col("id").alias("_id"))
            changed = after.join(before, F.col("id") == F.col("_id"), "left_semi").select(*mine.columns).withColumn("new", F.lit(False)).persist()
            n = changed.count()
            if n:
                self._commit(at, changed)
            changed.unpersist()
            return n

        return self._again(write)

    def update_record(self, record_id: str, source_status: str | None = None, source_last_synced_at: datetime | None = None, source_updated_at: datetime | None = None) -> dict | None:
        """The record after a change of its status or of the times of its source; None if there is no such record."""
        if source_status is not None and source_status not in STATUSES:
            raise ValueError(f"source_status is out of range: {source_status!r}")
        given = {k: v for k, v in (("source_status", source_status), ("source_last_synced_at", source_last_synced_at), ("source_updated_at", source_updated_at)) if v is not None}

        def write(at: dict) -> None:
            row = self.store.records(at).where(F.col("id") == record_id)
            for name, value in given.items():
                row = row.withColumn(name, F.lit(value).cast(row.schema[name].dataType))
            if source_status is not None:
                row = row.withColumn("deleted_at", F.lit(self.now) if source_status == "deleted" else F.lit(None).cast("timestamp"))
            if given and not row.isEmpty():
                self._commit(at, row.withColumn("new", F.lit(False)))

        self._again(write)
        return self.get_record(record_id)

    def remove_record(self, record_id: str) -> bool:
        """Takes a record out of the store, whatever its state; whether there was one."""

        def write(at: dict) -> bool:
            row = self.store.records(at).where(F.col("id") == record_id)
            if row.isEmpty():
                return False
            self.store.commit(at, row.limit(0), row.select("id"))
            return True

        return self._again(write)

    def import_path(self, path: str, recursive: bool = False, mode: str = "upsert", data_schema: dict | None = None, **more) -> list[dict]:
        """A row for each file: path, status (imported, skipped) and the reason for skipping; also for a path that is not there.

        data_schema is the declared schema of every file with structured data."""
        if not I.path_exists(self.spark, path):
            return [{"path": path, "status": "skipped", "reason": "path_not_found_or_unsupported", "source_key": None}]
        found = I.import_files(I.read_files(self.spark, path, recursive)).persist()
        good = found.where("status = 'imported'")
        names = [c.split()[0] for c in schema.columns(schema.PAYLOAD)]
        meta = F.create_map(F.lit("import_path"), "path", F.lit("import_name"), "name", F.lit("import_suffix"), "suffix")
        given = {"source_type": F.lit("imported_document"), "metadata": meta, "source_updated_at": F.col("modified"), "source_id": F.col("source_key"), **{k: F.lit(v) for k, v in more.items()}}
        for name in ("path", "name", "suffix", "modified"):
            given.pop(name, None)
        if data_schema:
            declared = {"schema_mode": "declared", **data_schema}
            kinds = {c.split(":", 1)[0]: c.split(":", 1)[1] for c in schema.DATA_SCHEMA.removeprefix("struct<").removesuffix(">").split(",")}
            value = lambda n, k: F.array(*map(F.lit, declared.get(n) or [])).cast(k) if k.startswith("array") else F.lit(declared.get(n)).cast(k)
            given["declared_schema"] = F.when(F.col("structured_json").isNotNull(), F.struct(*(value(n, k).alias(n) for n, k in kinds.items())))
        rows = good.withColumn("seq", F.row_number().over(Window.orderBy("path")).cast("long"))
        typed = {c.split()[0]: c.split(maxsplit=1)[1] for c in schema.columns(schema.PAYLOAD)}
        rows = rows.select(*((given[n] if n in given else F.col(n) if n in rows.columns else F.lit(None)).cast(typed[n]).alias(n) for n in names))
        kept = {}
        if mode == "upsert":
            self.upsert_frame(rows)
        else:
            kept = {r["source_key"] for r in self._add(rows)}  # of the files of one import
        out = [r.asDict() for r in found.select("path", "status", "reason", "source_key").orderBy("path").collect()]
        for r in out if mode != "upsert" else ():
            if r["status"] == "imported" and r["source_key"] not in kept:
                r |= {"status": "skipped", "reason": "duplicate_or_rejected"}
        return out

    # --- reading ---------------------------------------------------------------------------------------------------

    def get_record(self, record_id: str) -> dict | None:
        row = self.store.get(record_id).first()
        return row.asDict(True) if row else None

    def list_records(self, kind: str | None = None, scope: str | None = None, limit: int = 100) -> DataFrame:
        return Y.list_records(self.store.records(), kind, scope, limit)

    def retrieve(self, request: Request, audit: bool = True) -> DataFrame:
        """The best chunks for a request. With audit the chunks are scored once, for the items and for the log alike."""
        at = self.store.manifest()
        records, chunks, s, now = self.store.records(at), self.store.chunks(at), self.settings, self.now
        if not audit:
            return sinks.with_provenance(R.retrieve(records, chunks, request, s, now))
        found = R.of_request(records, chunks, request, s, now).persist()
        items = R.finished(found, records, chunks, request, s, now, few=True).drop("query_id")
        items = sinks.with_provenance(items)
        items = self.spark.createDataFrame(items.orderBy("rank").collect(), items.schema)  # as many as the request's limit, a hundred at most
        counts = R.counts_of(found, records, request, s, now)
        row = sinks.audit_row(counts, items, L.visible(records, request, s, now), L.excluded_counts(records, request, s, now), request, now)
        self.store.append_json("audit", row)
        found.unpersist()
        return items

    retrieve_context = explain_context_selection = retrieve

    def query(self, query_text: str, **more) -> DataFrame:
        """A flat result of 14 columns."""
        x = self.retrieve(Request(query_text, **more))
        return x.select("record_id", "chunk_id", "kind", "scope", "source_type", "content_class", "title", "text", "summary", "source_key", "score", "semantic_score", "lexical_score", "selection_reason")

    def assemble_context(self, request: Request, audit: bool = True) -> DataFrame:
        gathered = A.gather(self.retrieve(request, audit))
        return A.assemble(gathered, F.lit(request.query_text), request.assembly_mode, F.lit(request.token_budget))

    def prepare_context(self, request: Request) -> DataFrame:
        x = self.assemble_context(request).withColumn("context_blocks", A.blocks(F.col("sections")))
        return x.withColumn("request_summary", F.lit(f"Prepare {request.assembly_mode} context for: {request.query_text}"))

    def preference(self, request: Request) -> dict:
        """The latest visible preference record, else signals of visible notes."""
        seen = L.visible(self.store.records(), request, self.settings, self.now)
        row = seen.where(F.lower(F.trim("data_schema.schema_name")) == PREFERENCE).orderBy(F.desc("created_at"), F.desc("id")).select("structured_json").first()
        if row and row["structured_json"]:
            data = json.loads(row["structured_json"])
            return {k: data.get(k, v) for k, v in BASE_PREFERENCE.items()} | {"evidence_count": int(data.get("evidence_count") or 1)}
        notes = seen.where(F.col("kind").isin(*W.NOTE_KINDS) & (F.col("source_status") == "active"))
        got = W.preferences(W.preference_signals(notes)).first().asDict(True)
        return {k: got.get(k, v) for k, v in BASE_PREFERENCE.items()}

    def prepare_task_envelope(self, request: Request) -> dict:
        x = self.prepare_context(request)
        of = lambda c: F.array_distinct(F.transform("selected", lambda s: s[c]))
        schemas = self.store.records().select(F.col("id").alias("i"), F.lower(F.trim("data_schema.schema_name")).alias("n")).where("n is not null")
        chosen = x.select(F.explode(F.transform("selected", lambda s: s["record_id"])).alias("i")).join(schemas, "i").agg(F.collect_set("n").alias("schemas"))
        x = W.intent(x.crossJoin(chosen), F.lit(request.query_text), F.col("schemas"), of("source_type"), of("kind"), of("source_key"), F.lit(bool(request.intent_json)))  # one row each
        liked = self.preference(request)
        x = x.withColumn("clarification_preference", F.lit(liked["clarification_preference"])).withColumn("initiative_preference", F.lit(liked["initiative_preference"])).withColumn("brevity_preference", F.lit(liked["brevity_preference"]))
        x = W.output_contract(x).withColumn("objective", W.objective(F.col("workflow_type"), F.col("target_type"), F.col("action"), F.size("context_blocks") > 0)).withColumn("context_summary", A.context_summary(F.col("context_blocks")))
        row = x.select("workflow_type", "action", "target_type", "goal", "constraints", "output_type", "confidence", "source_refs", "must_include", "must_avoid", "objective", "context_summary", "context_blocks", "token_count_estimate").first().asDict(True)
        return row | {"query_text": request.query_text, "user_workflow_preference": liked}

    def update_workflow_preference(self, scope: str = "user", user_id: str | None = None, session_id: str | None = None, approved_text: str = "", preference_data: dict | None = None, source_key: str = PREFERENCE) -> dict:
        request = Request(PREFERENCE, user_id=user_id, session_id=session_id, enforce_policy=False)
        merged = W.merge_preference(self.preference(request), preference_data, approved_text)
        self.upsert_source({"source_key": source_key, "kind": "user_profile_note", "scope": scope, "user_id": user_id, "session_id": session_id, "title": "workflow preference", "text": W.preference_text(merged), "structured_data": merged, "declared_schema": {"schema_name": PREFERENCE, "schema_mode": "declared", "root_type": "object", "field_paths": [], "primary_text_paths": []}})
        return merged

    # --- upkeep ----------------------------------------------------------------------------------------------------

    def prune(self) -> dict:
        def write(at: dict) -> tuple[int, DataFrame]:
            _, _, chunks = Y.prune(self.store.records(at), self.store.chunks(at), self.settings, self.now)
            gone = Y.prune_marks(self.store.records(at), self.settings, self.now).where("prune_reason is not null").select("id").persist()
            n, chunks = gone.count(), chunks.persist()
            chunks.count()
            if n:
                self.store.commit(at, self.store.records(at).limit(0), gone)
                self.store.add(pruned_records_total=n)
            gone.unpersist()
            return n, chunks

        n, chunk_ids = self._again(write)
        return {"pruned_records": n, "pruned_chunk_ids": chunk_ids, "pruned_records_total": self.store.count("operations", "pruned_records_total")}

    def stats(self) -> DataFrame:
        return Y.stats(self.store.records())

    def export_training(self) -> tuple[int, str]:
        lines, path = sinks.training_lines(self.store.records(), self.settings), f"{self.store.root}/training_export"
        lines.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return lines.count(), path

    def health(self) -> dict:
        return {"ok": True, "root": self.store.root, "settings": asdict(self.settings)}

    # --- evaluation ------------------------------------------------------------------------------------------------

    def run_evaluations(self, cases: list[dict], suite_name: str = "adhoc", limit: int = 6, run_id: str | None = None) -> str:
        """Evaluates cases against the store and appends the run; its id. Cases that may see the same are one batch."""
        run_id = run_id or f"eval_{suite_name}_{int(self.now.timestamp() * 1e6):x}"
        at = self.store.manifest()
        records, chunks = self.store.records(at), self.store.chunks(at)
        rows = [(i, c["name"], c["query_text"], int(c.get("token_budget") or 1200), list(c.get("expected_source_keys") or []), list(c.get("expected_terms") or []), c.get("expected_terms_scope") or "assembled_context") for i, c in enumerate(cases)]
        asked = self.spark.createDataFrame(rows, "seq int, name string, query_text string, budget int, expected_keys array<string>, expected_terms array<string>, expected_terms_scope string")
        groups: dict[tuple, list[int]] = {}
        for i, c in enumerate(cases):
            groups.setdefault((c.get("session_id"), c.get("user_id"), c.get("model_target") or "local", c.get("include_user_scope"), c.get("include_global_scope")), []).append(i)
        found = None
        for (session, user, target, see_user, see_global), mine in groups.items():
            request = Request("batch", session_id=session, user_id=user, model_target=target, include_user_scope=see_user, include_global_scope=see_global, limit=limit)
            texts = self.spark.createDataFrame([(i, cases[i]["query_text"]) for i in mine], "query_id int, query_text string")
            part = A.gather(R.retrieve_batch(records, chunks, texts, request, self.settings, self.now), ("query_id",))
            found = part if found is None else found.unionByName(part)
        if found is not None:
            x = asked.join(found, F.col("seq") == F.col("query_id"), "left").drop("query_id")
            x = x.withColumn("items", F.coalesce("items", F.expr(f"cast(array() as {found.schema['items'].dataType.simpleString()})")))
            x = A.assemble(x, F.col("query_text"), "assistant", F.col("budget"))
            ids = x.select("seq", F.posexplode(F.array_distinct(F.transform("items", lambda i: i["record_id"]))).alias("place", "record_id"))
            whole = ids.join(records.select(F.col("id").alias("record_id"), F.col("text").alias("whole")), "record_id")
            whole = whole.groupBy(F.col("seq").alias("s")).agg(F.array_sort(F.collect_list(F.struct("place", "whole"))).alias("whole"))  # limit records a case
            x = x.join(whole, F.col("seq") == F.col("s"), "left")
            records_text = F.coalesce(F.array_join(F.transform("whole", lambda w: w["whole"]), "\n"), F.lit(""))
            x = x.withColumn("term_text", F.when(F.col("expected_terms_scope") == "retrieved_records", records_text).otherwise(F.col("context_text")))
            x = x.withColumn("retrieved_keys", F.filter(F.transform("items", lambda i: i["source_key"]), lambda k: F.coalesce(k, F.lit("")) != "")).withColumn("retrieval_count", F.size("items"))
            x = E.hits(x).withColumn("run_id", F.lit(run_id)).withColumn("suite_name", F.lit(suite_name)).withColumn("created_at", F.lit(self.now))
            self.store.append("eval_runs", x.select(*(F.col(c.split()[0]).cast(c.split(maxsplit=1)[1]) for c in schema.columns(schema.EVAL_RESULT))))
        return run_id

    def save_evaluation_suite(self, name: str, cases: list[dict]) -> None:
        self.store.append("eval_suites", self.spark.createDataFrame([(name, json.dumps(cases), self.now)], "suite_name string, cases string, created_at timestamp"))

    def list_evaluation_suites(self) -> DataFrame:
        x = self.store.log("eval_suites", "suite_name string, cases string, created_at timestamp")
        return x.groupBy("suite_name").agg(F.max_by("cases", "created_at").alias("cases"), F.max("created_at").alias("created_at")).orderBy("suite_name")

    def run_evaluation_suite(self, name: str, run_id: str | None = None) -> str:
        row = self.list_evaluation_suites().where(F.col("suite_name") == name).first()
        if row is None:
            raise ValueError(f"no suite {name!r}")
        return self.run_evaluations(json.loads(row["cases"]), name, run_id=run_id)

    def results(self, run_id: str) -> DataFrame:
        return self.store.log("eval_runs", schema.EVAL_RESULT).where(F.col("run_id") == run_id)

    def list_evaluation_runs(self) -> DataFrame:
        x = self.store.log("eval_runs", schema.EVAL_RESULT)
        return x.groupBy("run_id", "suite_name").agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("total_cases"), F.count_if("retrieval_hit").alias("retrieval_hits"), F.count_if("assembly_hit").alias("assembly_hits")).orderBy(F.desc("created_at"), "run_id")

    def compare_evaluation_runs(self, baseline: str, candidate: str) -> DataFrame:
        return E.compare(self.results(baseline), self.results(candidate)).orderBy("name")

    def gate_evaluation_run(self, candidate: str, baseline: str | None = None, **thresholds) -> dict:
        compared = self.compare_evaluation_runs(baseline, candidate) if baseline else None
        return E.gate(self.results(candidate), compared, **thresholds).first().asDict(True)

    def benchmark_jsonl(self, dataset: str, cases_json: str, suite_name: str = "", limit: int = 6, token_budget: int = 1200, output_dir: str | None = None) -> tuple[dict, str]:
        """Upserts a JSON-lines dataset, evaluates a suite against it; the result and its Markdown report.

        Lines of an unknown kind or scope are skipped and listed; a line that is no record stops the load. With
        output_dir both are written there, as benchmark-result.json and benchmark-report.md."""
        began = time.perf_counter()
        suite = I.load_suite(cases_json, suite_name, token_budget)
        rows = I.dataset_payloads(I.load_dataset(self.spark, dataset)).persist()
        bad = ~F.coalesce("kind", F.lit(KINDS[0])).isin(*KINDS) | ~F.coalesce("scope", F.lit(SCOPES[0])).isin(*SCOPES)
        skipped = [{"line": r["seq"], "source_key": r["source_key"], "reason": "unknown kind or scope"} for r in rows.where(bad).select("seq", "source_key").orderBy("seq").collect()]
        good = rows.where(~bad)
        imported = good.count()
        self.upsert_frame(good)
        rows.unpersist()
        self.save_evaluation_suite(suite["name"], suite["cases"])
        run_id = self.run_evaluations(suite["cases"], suite["name"], limit)
        row = self.list_evaluation_runs().where(F.col("run_id") == run_id).first()
        n, retrieved, assembled = (row["total_cases"], row["retrieval_hits"], row["assembly_hits"]) if row else (0, 0, 0)
        result = {"suite_name": suite["name"], "run_id": run_id, "dataset_path": dataset, "cases_path": cases_json, "data_root": self.store.root, "runtime_seconds": 0.0, "imported": imported, "imported_records": imported, "skipped_records": skipped}
        result |= {"total_cases": n, "retrieval_hits": retrieved, "assembly_hits": assembled, "retrieval_hit_rate": round(retrieved / max(1, n), 3), "assembly_hit_rate": round(assembled / max(1, n), 3)}
        details = self.results(run_id).orderBy("seq")
        result["stats"] = {f"{r['dimension']}:{r['value']}": r["n"] for r in self.stats().collect()}
        result["behavior_evidence"] = sinks.behavior_evidence(result, suite["cases"], [r.asDict() for r in details.collect()])  # a suite's cases
        shown = details.select("name", "retrieval_hit", "assembly_hit", "retrieval_count", "token_count_estimate")
        result["runtime_seconds"] = round(time.perf_counter() - began, 3)
        report = sinks.benchmark_report(result, {"Cases": shown, "Records": self.stats()})
        if output_dir:
            out = Path(output_dir)
            out.mkdir(parents=True, exist_ok=True)
            result |= {"output_dir": str(out), "result_path": str(out / "benchmark-result.json"), "report_path": str(out / "benchmark-report.md")}
            (out / "benchmark-report.md").write_text(report, encoding="utf-8")
            (out / "benchmark-result.json").write_text(json.dumps(result, indent=2, default=str, ensure_ascii=False), encoding="utf-8")
        return result, report

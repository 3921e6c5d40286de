"""Command line: python -m tessera.cli --root DIR COMMAND ...; results are printed as JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from tessera.config import Request
from tessera.service import Service
from tessera.sources.importers import json_option


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--root", default=".local/tessera")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options):
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        for x, default in options.items():
            flag = f"--{x.replace('_', '-')}"
            c.add_argument(flag, action="store_true") if default is False else c.add_argument(flag, default=default, type=type(default) if default is not None else str)

    owner = {"scope": "session", "user_id": None, "session_id": None}
    source = {"text": None, "kind": "research_finding", "title": None, "summary": None, "source_type": "direct_text", **owner}
    ask = {"session_id": None, "user_id": None, "limit": 6, "intent_data": None, "intent_schema": None}
    build = {**ask, "assembly_mode": "assistant", "token_budget": 1200}
    command("store", "kind", "text", title=None, summary=None, **owner)
    command("ingest-source", source_key=None, **source)
    command("upsert-source", "source_key", **source)
    command("delete-source", "source_key", **owner)
    command("import-path", "path", kind="research_finding", recursive=False, data_schema=None, **owner)
    command("retrieve-context", "query_text", **ask)
    for name in ("assemble-context", "prepare-context", "prepare-task-envelope"):
        command(name, "query_text", **build)
    command("update-workflow-preference", scope="user", user_id=None, session_id=None, approved_text="", preference_data=None, source_key="user_workflow_preference")
    command("get", "record_id")
    command("list-records", kind=None, scope=None, limit=100)
    for name in ("prune", "stats", "export-training"):
        command(name)
    command("benchmark-jsonl", "dataset_jsonl", "cases_json", suite_name="", limit=6, token_budget=1200, output_dir=None)
    return p


def plain(x):
    if isinstance(x, DataFrame):
        return [json.loads(r) for r in x.toJSON().collect()]
    return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def run(args: argparse.Namespace, service: Service):
    a = {k: v for k, v in vars(args).items() if k not in ("root", "command")}
    name = args.command
    if "query_text" in a:
        data = json_option(a.pop("intent_data"))
        request = Request(a.pop("query_text"), intent_json=json.dumps(data) if data is not None else None, intent_schema=json_option(a.pop("intent_schema")) or None, **a)
        return {"retrieve-context": service.retrieve, "assemble-context": service.assemble_context, "prepare-context": service.prepare_context, "prepare-task-envelope": service.prepare_task_envelope}[name](request)
    if name == "store":
        return {"id": service.store_record(**a)}
    if name == "ingest-source":
        return {"ids": service.ingest_source(a)}
    if name == "upsert-source":
        return service.upsert_source(a)
    if name == "delete-source":
        return {"deleted": service.delete_source(**a)}
    if name == "import-path":
        return service.import_path(**{**a, "data_schema": json_option(a["data_schema"])})
    if name == "update-workflow-preference":
        return service.update_workflow_preference(**{**a, "preference_data": json_option(a["preference_data"])})
    if name == "get":
        return service.get_record(**a)
    if name == "list-records":
        return service.list_records(**a)
    if name == "export-training":
        n, path = service.export_training()
        return {"count": n, "path": path}
    if name == "benchmark-jsonl":
        result, report = service.benchmark_jsonl(a["dataset_jsonl"], a["cases_json"], a["suite_name"], a["limit"], a["token_budget"], a["output_dir"])
        return {**result, "report": report}
    return getattr(service, name)()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(plain(run(args, Service(spark, args.root))), indent=2, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()

"""What a request is for, by ordered rules on its words, and what a user prefers, by signals in their notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Workflows in the order in which they are tried: name, words anywhere in the request, action, output, goal.
RULES = (
    ("reply", ("reply", "answer", "respond"), "draft_response", "message", "produce_sendable_reply"),
    ("rewrite", ("rewrite", "edit", "improve"), "rewrite_content", "rewrite", "produce_improved_revision"),
    ("code", ("code", "fix", "implement", "refactor"), "produce_code", "code", "produce_code_change"),
    ("draft", ("draft", "write", "compose"), "draft_content", "draft", "produce_working_draft"),
    ("summarize", ("summarize", "summary", "recap"), "summarize_context", "summary", "produce_compact_summary"),
    ("research", ("research", "investigate", "look up"), "research_topic", "report", "produce_evidence_backed_report"),
    ("analyze", ("analyze", "review", "inspect", "evaluate"), "analyze_context", "analysis", "produce_actionable_analysis"),
    ("extract", ("extract", "pull", "get fields"), "extract_fields", "structured_data", "produce_structured_extraction"),
    ("plan", ("plan", "next steps", "what should i do next"), "propose_plan", "plan", "produce_next_step_plan"),
    ("decide", ("decide", "choose", "recommend"), "recommend_decision", "recommendation", "produce_recommendation"),
    ("update_record", ("update", "save", "sync"), "update_record", "record_update", "update_system_record"),
)
NOTE_WORDS, DOCUMENT_WORDS = ("note",), ("doc", "file", "pdf")
EVIDENCE_KINDS = ("research_report", "research_finding", "evidence_summary")
# Signals of preference and the words that give them.
SIGNALS = {
    "brevity": ("concise", "brief", "short"),
    "structure": ("bullet", "structured", "outline"),
    "clarify_low": ("best effort", "don't ask", "do not ask"),
    "initiative": ("proactive", "next step", "take initiative"),
    "evidence": ("cite", "source", "evidence"),
    "direct": ("direct", "clear"),
    "warm": ("warm", "friendly"),
    "formal": ("professional", "formal"),
}
NOTES = {"brevity": "prefer concise outputs", "structure": "prefer structured responses when useful", "clarify_low": "prefer best-effort execution over clarification", "initiative": "prefer clear next steps"}
STYLES = {"direct": ("directness", "high"), "warm": ("warmth", "medium"), "formal": ("formality", "medium_high")}
NOTE_KINDS = ("user_profile_note", "decision_outcome", "training_example")
#: Preference fields: value without a signal, the signals that raise it, and to what.
PREFERENCES = {
    "autonomy_level": ("medium", ("initiative", "clarify_low"), "medium_high"),
    "clarification_preference": ("medium", ("clarify_low",), "low"),
    "brevity_preference": ("medium", ("brevity",), "high"),
    "structure_preference": ("medium", ("structure",), "medium_high"),
    "initiative_preference": ("medium", ("initiative",), "high"),
    "evidence_preference": ("medium", ("evidence",), "medium_high"),
}


def any_of(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def by_rule(text: Column, pick, default: str) -> Column:
    out = F.lit(default)
    for rule in reversed(RULES):
        out = F.when(any_of(text, rule[1]), pick(rule)).otherwise(out)
    return out


def none() -> Column:
    return F.array().cast("array<string>")


def intent(x: DataFrame, query: Column, schemas: Column | None = None, source_types: Column | None = None, kinds: Column | None = None, source_refs: Column | None = None, has_intent: Column | None = None) -> DataFrame:
    """x with workflow_type, action, target_type, goal, constraints, output_type, confidence and source_refs of each request.

    What is known of the retrieved context comes as arrays: names of its schemas, source types, kinds, source keys."""
    q, has_intent = F.lower(F.trim(query)), F.lit(False) if has_intent is None else has_intent
    schemas, source_types, kinds, refs = (none() if c is None else c for c in (schemas, source_types, kinds, source_refs))
    x = x.withColumn("workflow_type", by_rule(q, lambda r: r[0], "analyze")).withColumn("action", by_rule(q, lambda r: r[2], "respond"))
    matched = by_rule(q, lambda r: "1", "") == "1"
    w = F.col("workflow_type")
    target = F.when(w == "code", "codebase").when(F.contains(q, F.lit("email")) | F.array_contains(schemas, "email_source"), "email")
    target = target.when(any_of(q, NOTE_WORDS), "note").when(F.array_contains(source_types, "imported_document") | any_of(q, DOCUMENT_WORDS), "document")
    target = target.when((w == "research") & F.arrays_overlap(kinds, F.array(*map(F.lit, EVIDENCE_KINDS))), "research_material").otherwise("context")
    x = x.withColumn("target_type", target)
    t = F.col("target_type")
    goal = F.lit("produce_helpful_result")
    for rule in RULES:
        goal = F.when(w == rule[0], rule[4]).otherwise(goal)
    wanted = F.array_compact(F.array(F.lit("use user workflow preferences"), F.when(any_of(q, SIGNALS["brevity"]), "keep output concise"), F.when(any_of(q, ("source", "citation", "cite", "evidence")), "ground response in evidence"), F.when(w == "reply", "produce a sendable response"), F.when(has_intent, "use provided intent data")))
    sure = F.when(matched, 0.82).otherwise(0.55)
    sure = F.when(t == "email", F.greatest(sure, F.lit(0.88))).when(t.isin("note", "document", "research_material", "codebase"), F.greatest(sure, F.lit(0.84))).otherwise(sure)
    output = F.when((t == "email") & (w == "reply"), "email_reply").otherwise(by_rule(q, lambda r: r[3], "text"))
    x = x.withColumn("goal", goal).withColumn("constraints", wanted).withColumn("output_type", output)
    return x.withColumn("confidence", F.when(has_intent, F.greatest(sure, F.lit(0.9))).otherwise(sure)).withColumn("source_refs", F.slice(F.array_distinct(F.filter(refs, lambda r: r != "")), F.lit(1), F.lit(6)))


def objective(workflow: Column, target: Column, action: Column, has_blocks: Column) -> Column:
    words = F.replace(action, F.lit("_"), F.lit(" "))
    said = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 100)))
    out = F.when((workflow == "reply") & (target == "email"), "Draft a reply to the active email using the user's workflow preferences.")
    for name in ("note", "document"):
        out = out.when(target == name, F.concat(said, F.lit(f" for the active {name} using the retrieved context.")))
    out = out.when(target == "research_material", F.concat(said, F.lit(" using the active research material.")))
    out = out.when(has_blocks, F.concat(said, F.lit(" for the active "), target, F.lit(" using the retrieved context.")))
    return out.otherwise("Produce a useful result for the current user request.")


def preference_signals(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many texts of records give each signal (and n, all records), one row for each of keys."""
    text = F.lower(F.coalesce("text", F.lit("")))
    hits = [F.count_if(any_of(text, words)).alias(f"{name}_hits") for name, words in SIGNALS.items()]
    g = records.groupBy(*keys) if keys else records.groupBy()
    return g.agg(*hits, F.count(F.lit(1)).alias("n"))


def preferences(signals: DataFrame) -> DataFrame:
    """Preference fields, style_notes, style_preferences and workflow defaults out of preference_signals()."""
    hit = lambda name: F.col(f"{name}_hits") > 0
    x = signals
    for field, (plain, names, raised) in PREFERENCES.items():
        seen = F.lit(False)
        for n in names:
            seen = seen | hit(n)
        x = x.withColumn(field, F.when(seen, raised).otherwise(plain))
    styles = F.map_filter(F.create_map(*(c for n, (k, v) in STYLES.items() for c in (F.lit(k), F.when(hit(n), v)))), lambda k, v: v.isNotNull())
    x = x.withColumn("risk_tolerance", F.lit("moderate")).withColumn("style_preferences", styles)
    x = x.withColumn("style_notes", F.array_compact(F.array(*(F.when(hit(n), text) for n, text in NOTES.items()))))
    reply = F.struct(F.lit(True).alias("draft_full_response"), hit("initiative").alias("include_next_step"), hit("clarify_low").alias("prefer_best_effort_over_questions"))
    return x.withColumn("workflow_defaults", F.struct(reply.alias("reply"), F.struct(F.lit(True).alias("summary_first"), hit("evidence").alias("cite_sources")).alias("research"))).withColumn("evidence_count", F.col("n"))


def output_contract(x: DataFrame) -> DataFrame:
    """x (output_type and preference fields) with must_include and must_avoid."""
    need = F.array_compact(F.array(F.lit("match user workflow preferences"), F.when(F.col("clarification_preference") == "low", "make a best-effort attempt before asking questions"), F.when(F.col("initiative_preference") == "high", "include a clear next step when appropriate")))
    return x.withColumn("must_include", need).withColumn("must_avoid", F.array_compact(F.array(F.lit("irrelevant context"), F.when(F.col("brevity_preference") == "high", "unnecessary verbosity"))))


def merge_preference(base: dict, explicit: dict | None = None, approved: str = "") -> dict:
    """A preference after explicit values and the signals of an approved text; one small record, so plain Python.

    Explicit values that are empty change nothing; notes keep their order without repeats; the defaults for reply and
    research follow the merged fields whatever was given."""
    explicit, text, out = dict(explicit or {}), approved.lower().strip(), dict(base)
    hit = {name: any(w in text for w in words) for name, words in SIGNALS.items()}
    for field in (*PREFERENCES, "risk_tolerance"):
        if explicit.get(field) not in (None, ""):
            out[field] = str(explicit[field])
    for field, signal, value in (("brevity_preference", "brevity", "high"), ("clarification_preference", "clarify_low", "low"), ("initiative_preference", "initiative", "high"), ("autonomy_level", "initiative", "medium_high"), ("structure_preference", "structure", "medium_high"), ("evidence_preference", "evidence", "medium_high")):
        if hit[signal]:
            out[field] = value
    given = explicit.get("style_preferences")
    styles = dict(out.get("style_preferences") or {}) | {str(k): str(v) for k, v in (given.items() if isinstance(given, dict) else ()) if v not in (None, "")}
    out["style_preferences"] = styles | {k: v for n, (k, v) in STYLES.items() if hit[n]}
    notes = [*(out.get("style_notes") or []), *(explicit.get("style_notes") or []), *(NOTES[n] for n in ("brevity", "clarify_low", "initiative", "structure") if hit[n])]
    out["style_notes"] = list(dict.fromkeys(str(n) for n in notes if str(n).strip()))
    defaults = {k: dict(v) for k, v in (out.get("workflow_defaults") or {}).items()}
    given = explicit.get("workflow_defaults")
    for name, values in given.items() if isinstance(given, dict) else ():
        defaults[str(name)] = defaults.get(str(name), {}) | (values if isinstance(values, dict) else {})
    defaults["reply"] = {"draft_full_response": True, "include_next_step": out.get("initiative_preference") == "high", "prefer_best_effort_over_questions": out.get("clarification_preference") == "low"}
    defaults["research"] = {"summary_first": True, "cite_sources": out.get("evidence_preference") in ("medium_high", "high")}
    out["workflow_defaults"] = defaults
    out["evidence_count"] = int(out.get("evidence_count") or 0) + bool(approved.strip() or explicit)
    return out


def preference_text(p: dict) -> str:
    names = ("autonomy_level", "clarification_preference", "brevity_preference", "structure_preference", "initiative_preference", "evidence_preference")
    parts = [f"{n.split('_')[0]}: {p[n]}" for n in names] + [f"{k}: {v}" for k, v in sorted((p.get("style_preferences") or {}).items())]
    return ". ".join(x for x in [*parts, *(p.get("style_notes") or [])] if x).strip()

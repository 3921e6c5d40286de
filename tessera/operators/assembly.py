"""Context out of retrieved items: near repeats dropped, a token budget packed, sections built and rendered.

Items arrive as one array per request, at most a hundred in rank order, because dropping and packing depend on what was
kept before; both are folds over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

ALIKE = 0.82
# Sections of each mode in order.
SECTIONS = {
    "planner": ("objective_context", "active_constraints", "reference_memory"),
    "research": ("key_evidence", "supporting_context", "background_memory"),
    "drafting": ("drafting_instructions", "matter_context", "reference_material"),
    "assistant": ("priority_context", "supporting_context", "background_memory"),
}
ITEM = ("rank", "record_id", "chunk_id", "kind", "scope", "source_type", "title", "text", "summary", "source_key", "score", "selection_reason", "token_count_estimate")


def gather(items: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a request with its items (array of structs in rank order)."""
    cols = [F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in ITEM]
    packed = items.select(*keys, F.struct(*cols, X.lexical_tokens(F.col("text")).alias("tokens")).alias("item"))
    return (packed.groupBy(*keys) if keys else packed.groupBy()).agg(F.array_sort(F.collect_list("item")).alias("items"))


def compress(items: Column, like: Column) -> Column:
    """items without those whose tokens are as similar as ALIKE to an item kept before. like: an expression of items' type."""

    def add(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: X.jaccard(k["tokens"], x["tokens"]) >= ALIKE), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(items, F.slice(like, F.lit(1), F.lit(0)), add)


def pack(items: Column, budget: Column) -> Column:
    """struct<used, list>: items that fit the budget, in order; the first always fits, later ones may follow an omission."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(items, F.lit(1), F.lit(0)).alias("list"))

    def add(acc: Column, x: Column) -> Column:
        n = F.greatest(F.lit(1), x["token_count_estimate"]).cast("long")
        fits = (F.size(acc["list"]) == 0) | (acc["used"] + n <= budget)
        return F.when(fits, F.struct((acc["used"] + n).alias("used"), F.concat(acc["list"], F.array(x)).alias("list"))).otherwise(acc)

    return F.aggregate(items, start, add)


def section_of(mode: str, kind: Column, scope: Column) -> Column:
    first, second, third = SECTIONS[mode]
    if mode == "drafting":
        return F.when(kind.isin("user_profile_note", "decision_outcome"), first).when(scope == "session", second).otherwise(third)
    if mode == "planner":
        return F.when(scope.isin("session", "user"), first).when(kind.isin("decision_trace", "routing_decision", "decision_outcome"), second).otherwise(third)
    if mode == "research":
        return F.when(kind.isin("research_report", "research_finding", "evidence_summary"), first).when(scope == "session", second).otherwise(third)
    return F.when(scope.isin("session", "user"), first).when(kind.isin("research_report", "research_finding"), second).otherwise(third)


def sections(items: Column, mode: str) -> Column:
    """array<struct<name, items, tokens>> of the sections that have items, in the mode's order."""

    def of(name: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.filter(items, lambda x: section_of(mode, x["kind"], x["scope"]) == name).alias("items"))

    built = F.array(*map(of, SECTIONS[mode]))
    total = lambda s: F.aggregate(s["items"], F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(1), x["token_count_estimate"]))
    return F.transform(F.filter(built, lambda s: F.size(s["items"]) > 0), lambda s: F.struct(s["name"].alias("name"), s["items"].alias("items"), total(s).alias("tokens")))


def render(query: Column, mode: str, found: Column) -> Column:
    """The context as text: a header, then each section with its items, numbered throughout."""

    def item(x: Column, i: Column) -> Column:
        label = F.when(F.coalesce(x["title"], F.lit("")) != "", x["title"]).otherwise(x["kind"])
        head = F.concat(F.lit("["), i.cast("string"), F.lit("] "), label, F.lit(" ("), x["scope"], F.lit(", "), x["source_type"], F.lit(", score="), F.format_string("%.3f", x["score"]), F.lit(", reason="), x["selection_reason"], F.lit(")"))
        tail = lambda c: F.when(F.coalesce(x[c], F.lit("")) != "", F.concat(F.lit(f"{c}="), x[c]))
        return F.concat(F.array_join(F.array_compact(F.array(head, x["text"], tail("summary"), tail("source_key"))), "\n"), F.lit("\n"))

    def add(acc: Column, s: Column) -> Column:
        lines = F.concat(F.array(F.lit(""), F.concat(F.lit("## "), s["name"])), F.transform(s["items"], lambda x, i: item(x, acc["n"] + i + 1)))
        return F.struct((acc["n"] + F.size(s["items"])).alias("n"), F.concat(acc["lines"], lines).alias("lines"))

    start = F.struct(F.lit(0).alias("n"), F.array(F.concat(F.lit("Request: "), query), F.lit(f"Mode: {mode}"), F.lit(""), F.lit("Use the following context sections when answering:")).alias("lines"))
    body = F.aggregate(found, start, add, lambda acc: F.regexp_replace(F.array_join(acc["lines"], "\n"), r"^\s+|\s+$", ""))
    none = F.concat(F.lit("Request: "), query, F.lit(f"\nMode: {mode}\n\nNo stored context matched the request."))
    return F.when(F.size(found) > 0, body).otherwise(none)


def assemble(gathered: DataFrame, query: Column, mode: str, budget: Column) -> DataFrame:
    """gathered rows with compressed, selected, used, omitted_items, truncation_reason, sections, context_text and token_count_estimate."""
    x = gathered.withColumn("compressed", compress(F.col("items"), F.col("items")))
    x = x.withColumn("packed", pack(F.col("compressed"), budget)).withColumn("selected", F.col("packed.list")).withColumn("used", F.col("packed.used"))
    x = x.withColumn("omitted_items", F.size("items") - F.size("selected")).withColumn("truncation_reason", F.when(F.col("omitted_items") > 0, "token_budget_reached"))
    x = x.withColumn("sections", sections(F.col("selected"), mode)).withColumn("context_text", render(query, mode, F.col("sections")))
    return x.withColumn("token_count_estimate", X.token_estimate(F.col("context_text"))).drop("packed")


def blocks(found: Column) -> Column:
    """array<struct<name, text, tokens>>: each section's texts, a blank line between."""
    text = lambda s: F.array_join(F.transform(F.filter(s["items"], lambda x: F.trim(x["text"]) != ""), lambda x: x["text"]), "\n\n")
    return F.transform(found, lambda s: F.struct(s["name"].alias("name"), text(s).alias("text"), s["tokens"].alias("tokens")))


def context_summary(made: Column) -> Column:
    """The opening of the first three blocks."""
    part = F.transform(F.filter(F.slice(made, F.lit(1), F.lit(3)), lambda b: F.trim(b["text"]) != ""), lambda b: F.concat(b["name"], F.lit(": "), F.trim(F.substring(F.trim(b["text"]), F.lit(1), F.lit(180)))))
    return F.when(F.size(made) == 0, "No relevant stored context was found.").otherwise(F.trim(F.array_join(part, " ")))

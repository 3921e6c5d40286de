"""Which records a request may see, with one reason for each that it may not: the first predicate that fails, in order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Request, Settings


def horizon_days(settings: Settings) -> Column:
    """Days until a record is stale: its policy's, else those of its kind, else the retention."""
    by_kind = {"research_report": settings.stale_research_report_days, "assistant_answer": settings.stale_assistant_answer_days, "topic_pattern": settings.stale_topic_pattern_days, "user_profile_note": settings.stale_user_profile_note_days}
    days = F.col("policy.freshness_days")
    for kind, n in by_kind.items():
        days = F.coalesce(days, F.when(F.col("kind") == kind, n))
    return F.coalesce(days, F.lit(settings.retention_days))


def days_before(as_of: datetime, days: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(as_of)) - days.cast("long") * 86_400_000_000)


def listed(values: Column) -> Column:
    """Trimmed entries that are not blank."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), F.trim), lambda x: x != "")


def exclusion(request: Request, settings: Settings, as_of: datetime) -> Column:
    """The reason for which a record is left out, or null."""
    c, none = F.col, F.lit(None).cast("string")
    user, session = request.user_id or None, request.session_id or None
    users, sessions = listed(c("policy.allowed_user_ids")), listed(c("policy.allowed_session_ids"))
    keys, tags = [k.strip() for k in request.source_keys if k.strip()], [t.strip().lower() for t in request.tags if t.strip()]
    flag = lambda given, default: default if given is None else given
    see_user = flag(request.include_user_scope, settings.include_user_scope_by_default) and user is not None
    see_global = flag(request.include_global_scope, settings.include_global_scope_by_default)
    visible = F.when(c("scope") == "session", F.coalesce(c("session_id") == F.lit(session), F.lit(False)) if session else F.lit(False)).when(c("scope") == "user", F.coalesce(c("user_id") == F.lit(user), F.lit(False)) if see_user else F.lit(False)).otherwise(F.lit(see_global))
    cutoff = days_before(as_of, F.lit(request.max_age_days) if request.max_age_days else horizon_days(settings))
    outside = lambda name, allowed: ~F.coalesce(c(name).isin(*allowed), F.lit(False))
    rules: list[tuple[str, Column]] = []
    if request.kinds:
        rules.append(("kind_filter", outside("kind", request.kinds)))
    if request.source_types:
        rules.append(("source_type_filter", outside("source_type", request.source_types)))
    if request.content_classes:
        rules.append(("content_class_filter", outside("content_class", request.content_classes)))
    if keys:
        rules.append(("source_key_filter", ~F.coalesce(c("source_key"), F.lit("")).isin(*keys)))
    if request.confidentialities:
        rules.append(("confidentiality_filter", outside("policy.confidentiality", request.confidentialities)))
    rules.append(("source_status_filter", outside("source_status", request.source_statuses)) if request.source_statuses else ("inactive_source", c("source_status") != "active"))
    if tags:
        rules.append(("tag_filter", ~F.coalesce(F.arrays_overlap(F.transform("tags", F.lower), F.array(*map(F.lit, tags))), F.lit(False))))
    rules += [("stale", c("created_at") < cutoff), ("scope_visibility", ~visible)]
    if request.enforce_policy:
        level = F.coalesce(c("policy.confidentiality"), F.lit("private"))
        rules.append(("policy_user_not_allowed", (F.size(users) > 0) & (~F.array_contains(users, user) if user else F.lit(True))))
        rules.append(("policy_session_not_allowed", (F.size(sessions) > 0) & (~F.array_contains(sessions, session) if session else F.lit(True))))
        if request.model_target == "hosted":
            rules.append(("policy_remote_egress_denied", ~F.coalesce(c("policy.allow_remote_model_egress"), F.lit(False))))
        else:
            rules.append(("policy_local_egress_denied", ~F.coalesce(c("policy.allow_local_model_egress"), F.lit(True))))
        rules.append(("policy_restricted_context_required", (level == "restricted") & (c("scope") == "global") & F.lit(user is None and session is None)))
        rules.append(("policy_private_global_denied", (level == "private") & (c("scope") == "global") & (F.size(users) == 0) & (F.size(sessions) == 0)))
    reason = none
    for name, fails in reversed(rules):
        reason = F.when(fails, F.lit(name)).otherwise(reason)
    return reason


def with_reason(records: DataFrame, request: Request, settings: Settings, as_of: datetime) -> DataFrame:
    return records.withColumn("excluded", exclusion(request, settings, as_of))


def visible(records: DataFrame, request: Request, settings: Settings, as_of: datetime) -> DataFrame:
    return with_reason(records, request, settings, as_of).where("excluded is null").drop("excluded")


def excluded_counts(records: DataFrame, request: Request, settings: Settings, as_of: datetime) -> DataFrame:
    """(reason, n): how many records each reason leaves out; 'visible' counts the rest."""
    return with_reason(records, request, settings, as_of).groupBy(F.coalesce("excluded", F.lit("visible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))

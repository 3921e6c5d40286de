"""Records over time: versions, deletions, retention, pruning, near duplicates, statistics and lists."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators.filters import days_before


def owner() -> Column:
    """What a record's versions and duplicates are looked for among, beside its scope."""
    return F.when(F.col("scope") == "session", F.trim("session_id")).when(F.col("scope") == "user", F.trim("user_id"))


def latest(records: DataFrame, key: str = "source_key") -> DataFrame:
    """The newest version of each key by scope and owner: version, then creation, then id."""
    newest = Window.partitionBy(key, "scope", owner()).orderBy(F.desc("source_version"), F.desc("created_at"), F.desc("id"))
    return records.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def soft_delete(records: DataFrame, tombstones: DataFrame, key: str = "source_key") -> DataFrame:
    """records after deletions (key, scope, owner, deleted_at): the latest version of each named key is marked deleted,
    unless it is already; older versions keep their state."""
    t = tombstones.select(F.col(key).alias("k"), F.col("scope").alias("s"), F.col("owner").alias("o"), F.col("deleted_at").alias("at"))
    newest = Window.partitionBy(key, "scope", "owner").orderBy(F.desc("source_version"), F.desc("created_at"), F.desc("id"))
    x = records.withColumn("owner", owner()).withColumn("_n", F.row_number().over(newest))
    x = x.join(t, (F.col(key) == F.col("k")) & (F.col("scope") == F.col("s")) & F.col("owner").eqNullSafe(F.col("o")), "left")
    now = (F.col("_n") == 1) & F.col("k").isNotNull() & (F.col("source_status") != "deleted")
    return x.withColumn("deleted_at", F.when(now, F.col("at")).otherwise(F.col("deleted_at"))).withColumn("source_status", F.when(now, "deleted").otherwise(F.col("source_status"))).drop("k", "s", "o", "at", "_n", "owner")


def expired(settings: Settings, as_of: datetime) -> Column:
    return F.col("created_at") < days_before(as_of, F.coalesce("policy.retention_days", F.lit(max(1, settings.retention_days))))


def prune_marks(records: DataFrame, settings: Settings, as_of: datetime) -> DataFrame:
    """records with prune_reason: expired, overflow (beyond the newest of their scope and kind, whatever their status) or null.

    Overflow needs the newest few of a few groups, so each task keeps its own newest and one window ranks those."""
    newest = Window.partitionBy("scope", "kind").orderBy(F.desc("created_at"), F.desc("id"))
    kept = records.select("id", "scope", "kind", "created_at").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= settings.group_limit)
    x = records.join(kept.select(F.col("id").alias("_kept")), F.col("id") == F.col("_kept"), "left")
    return x.withColumn("prune_reason", F.when(expired(settings, as_of), "expired").when(F.col("_kept").isNull(), "overflow")).drop("_kept")


def prune(records: DataFrame, chunks: DataFrame, settings: Settings, as_of: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Surviving records, surviving chunks, and the ids of pruned chunks."""
    marked = prune_marks(records, settings, as_of)
    gone = marked.where("prune_reason is not null").select(F.col("id").alias("record_id"))
    return marked.where("prune_reason is null").drop("prune_reason"), chunks.join(gone, "record_id", "left_anti"), chunks.join(gone, "record_id", "left_semi").select("chunk_id")


#: Kinds that are stored even if they repeat an earlier record, and the columns that the fold over arrivals needs.
KEPT_KINDS = ("training_example", "decision_outcome")
FOLD = ("id", "seq", "kind", "scope", "session_id", "user_id", "lexical_tokens")


def near_duplicates(arrivals: DataFrame, settings: Settings) -> DataFrame:
    """(id, rejected) for arrivals (id, seq, kind, scope, session_id, user_id, lexical_tokens), in the order of seq.

    Rows with a true column stored are history, never rejected. An arrival is rejected if its tokens are as similar as the threshold to one of the last accepted of its kind, scope
    and owner. What is accepted depends on what was before, so a group is a fold; it holds a fixed number of token sets."""
    threshold, lookback = settings.dedup_threshold, max(1, settings.dedup_lookback)

    def fold(batches):
        group, recent = None, []
        for pdf in batches:
            out = []
            for kind, scope, whose, tokens, stored in zip(pdf["kind"], pdf["scope"], pdf["owner"], pdf["lexical_tokens"], pdf["stored"], strict=True):
                if group != (kind, scope, whose):
                    group, recent = (kind, scope, whose), []
                mine = set(tokens)
                near = not stored and kind not in KEPT_KINDS and any(mine and r and len(mine & r) / len(mine | r) >= threshold for r in recent)
                out.append(near)
                if not near:
                    recent = [*recent[-(lookback - 1) :], mine] if lookback > 1 else [mine]
            yield pd.DataFrame({"id": pdf["id"], "rejected": out})

    stored = F.col("stored") if "stored" in arrivals.columns else F.lit(False)
    x = arrivals.withColumn("owner", owner()).select("id", "seq", "kind", "scope", "owner", "lexical_tokens", stored.alias("stored"))
    dealt = x.repartition("kind", "scope", "owner").sortWithinPartitions("kind", "scope", "owner", "seq")
    return dealt.mapInPandas(fold, "id string, rejected boolean")


#: The fields of a record's summary, which is all of a record but its texts and vectors.
SUMMARY = (
    "id kind scope source_type content_class title summary user_id session_id source_id source_key source_version source_status external_id "
    "content_checksum source_updated_at source_last_synced_at deleted_at urls tags metadata structured_json data_schema structured_fields policy "
    "created_at lexical_tokens schema_field_paths"
).split()


def summaries(records: DataFrame) -> DataFrame:
    """What filters and rankings need of records (schema.RECORD)."""
    return records.select(*SUMMARY)


def stats(records: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by kind, scope, source type, content class and status, and the total, in one pass."""
    dims = ("kind", "scope", "source_type", "content_class", "source_status")
    sets = [[d] for d in dims] + [[]]
    g = records.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, dims)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*dims).alias("g"))
    name, value = F.lit("total"), F.lit("all")
    for i, d in enumerate(dims):
        here = F.col("g") == (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i))
        name, value = F.when(here, d).otherwise(name), F.when(here, F.col(d)).otherwise(value)
    return g.select(name.alias("dimension"), value.alias("value"), "n")


def list_records(records: DataFrame, kind: str | None = None, scope: str | None = None, limit: int = 100) -> DataFrame:
    """The newest records of a kind and scope, each with the number there are in all (total)."""
    x = records.where(F.col("kind") == kind) if kind else records
    x = x.where(F.col("scope") == scope) if scope else x
    total = x.agg(F.count(F.lit(1)).alias("total"))
    return x.orderBy(F.desc("created_at"), "id").limit(limit).crossJoin(total)  # limit rows beside one row

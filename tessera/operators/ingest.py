"""From payloads to records: text out of structured data, tokens and terms, checksums, chunks, versions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema
from tessera.config import Settings
from tessera.functions import structured as J
from tessera.functions import text as X
from tessera.functions import vector as V
from tessera.operators import chunks as C
from tessera.operators import lifecycle as Y

NAMED = ("title", "summary", "user_id", "session_id", "source_id", "source_key", "external_id")


def tidy(values: Column) -> Column:
    """Trimmed, non-blank, distinct entries in their order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), F.trim), lambda x: x != ""))


def default_policy(policy: Column) -> Column:
    get = lambda name, default: F.coalesce(policy[name], default).alias(name)
    none = F.array().cast("array<string>")
    return F.struct(get("confidentiality", F.lit("private")), policy["freshness_days"].alias("freshness_days"), policy["retention_days"].alias("retention_days"), get("allowed_user_ids", none), get("allowed_session_ids", none), get("allow_local_model_egress", F.lit(True)), get("allow_remote_model_egress", F.lit(False)))


def content(x: DataFrame) -> DataFrame:
    """x (text, structured_json, declared_schema) with structured_fields, data_schema, analysis (what tokens are taken
    from), and text together with what the structured data says."""
    x = x.withColumn("structured_fields", F.coalesce(J.extract_fields(F.col("structured_json")), F.expr(f"cast(array() as {schema.FIELDS})")))
    declared, has_data = F.col("declared_schema"), F.col("structured_json").isNotNull()
    inferred = F.struct(F.transform("structured_fields", lambda f: f["path"]).alias("field_paths"), J.primary_paths(F.col("structured_fields")).alias("primary_text_paths"))
    paths = J.merged_schema(declared, inferred)
    mode = F.when(declared.isNotNull(), F.coalesce(declared["schema_mode"], F.lit("declared"))).otherwise("inferred")
    root = F.coalesce(declared["root_type"], J.root_type(F.col("structured_json")), F.lit("object"))
    made = F.struct(declared["schema_name"].alias("schema_name"), mode.alias("schema_mode"), root.alias("root_type"), paths["field_paths"].alias("field_paths"), paths["primary_text_paths"].alias("primary_text_paths"))
    x = x.withColumn("data_schema", F.when(has_data | declared.isNotNull(), made))
    intent = F.coalesce((F.col("data_schema.schema_mode") == "declared") & (F.lower(F.trim("data_schema.schema_name")) == J.INTENT), F.lit(False))
    primary = F.coalesce("data_schema.primary_text_paths", F.array().cast("array<string>"))
    generated = J.structured_text(F.col("structured_fields"), primary, intent)
    x = x.withColumn("text", J.combined_text(F.col("text"), generated))
    return x.withColumn("analysis", J.analysis_text(F.col("text"), F.col("structured_fields"), intent))


def prepare(payloads: DataFrame, settings: Settings, as_of: datetime) -> DataFrame:
    """Records of payloads (schema.PAYLOAD) with a seq column; those without any text are left out.

    Ids that are not given come from a hash of key, owner, text and seq, so that running again gives the same."""
    x = payloads
    for name in NAMED:
        x = x.withColumn(name, X.blank_to_null(F.col(name)))
    for name, value in schema.DEFAULTS.items():
        x = x.withColumn(name, F.coalesce(name, F.lit(value)))
    x = content(x).where("text <> ''")
    x = V.embedded(x.withColumn("lexical_tokens", X.lexical_tokens(F.col("analysis"))).drop("analysis"), settings)
    x = x.withColumn("semantic_terms", X.terms_of(F.col("lexical_tokens"))).withColumn("content_checksum", X.checksum(F.col("text")))
    fresh = F.concat(F.lit("rec_"), F.substring(F.sha2(F.concat_ws("\x1f", "source_key", "scope", "user_id", "session_id", "content_checksum", F.col("seq").cast("string")).cast("binary"), 256), 1, 32))
    x = x.withColumn("id", F.coalesce("id", fresh)).withColumn("created_at", F.coalesce("created_at", F.lit(as_of))).withColumn("policy", default_policy(F.col("policy")))
    x = x.withColumn("urls", tidy(F.col("urls"))).withColumn("tags", tidy(F.col("tags"))).withColumn("metadata", F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")))
    x = x.withColumn("owner_scope", Y.owner()).withColumn("source_version", F.lit(1)).withColumn("source_status", F.lit("active")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    x = x.withColumn("token_count_estimate", X.token_estimate(F.col("text"))).withColumn("schema_field_paths", F.coalesce("data_schema.field_paths", F.array().cast("array<string>")))
    return x.select(*(F.col(f.split()[0]) for f in schema.columns(schema.RECORD)), "seq")


def drop_near_duplicates(arrivals: DataFrame, stored: DataFrame, settings: Settings) -> DataFrame:
    """arrivals without those that repeat one of the newest records, stored or accepted before, of their kind, scope and owner."""
    newest = Window.partitionBy("kind", "scope", "owner_scope").orderBy(F.desc("created_at"), F.desc("id"))
    old = stored.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max(1, settings.dedup_lookback))
    both = old.withColumn("seq", -F.col("_n").cast("long")).withColumn("stored", F.lit(True)).select(*Y.FOLD, "stored").union(arrivals.withColumn("stored", F.lit(False)).select(*Y.FOLD, "stored"))
    bad = Y.near_duplicates(both, settings).where("rejected").select("id")
    return arrivals.join(bad, "id", "left_anti")


def upsert(existing: DataFrame, arrivals: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(rows of the store that the upsert adds or alters, with new for those that it adds; the current versions of the
    arrivals' keys afterwards).

    Arrivals follow the latest stored version of their key, scope and owner, in the order of seq. One with the checksum
    of an active version before it changes nothing; others get the next version and supersede it."""
    keys = arrivals.select(F.col("source_key").alias("k"), F.col("scope").alias("s"), F.col("owner_scope").alias("o")).distinct()
    same = (F.col("source_key") == F.col("k")) & (F.col("scope") == F.col("s")) & F.col("owner_scope").eqNullSafe(F.col("o"))
    last = Y.latest(existing.join(keys, same, "left_semi"))
    per = Window.partitionBy("source_key", "scope", "owner_scope").orderBy("seq")
    both = last.withColumn("seq", F.lit(-1).cast("long")).withColumn("old", F.lit(True)).unionByName(arrivals.withColumn("old", F.lit(False)))
    x = both.withColumn("before", F.lag(F.when(F.col("source_status") == "active", F.col("content_checksum")).otherwise("")).over(per))
    x = x.where(F.col("before").isNull() | (F.col("before") != F.col("content_checksum"))).withColumn("previous", F.lag("id").over(per)).withColumn("later", F.lead("id").over(per))
    stored = F.first(F.when(F.col("old"), F.col("source_version")).otherwise(0)).over(per)
    number = F.row_number().over(per) - F.when(F.first("old").over(per), 1).otherwise(0)
    x = x.withColumn("version", (stored + number).cast("int")).withColumn("source_version", F.when(F.col("old"), F.col("source_version")).otherwise(F.col("version")))
    replaced = F.col("later").isNotNull()
    x = x.withColumn("source_status", F.when(replaced, "superseded").otherwise(F.col("source_status"))).withColumn("deleted_at", F.when(~replaced, F.col("deleted_at"))).withColumn("source_last_synced_at", F.when(replaced, F.lit(as_of)).otherwise(F.col("source_last_synced_at")))
    x = x.withColumn("metadata", F.when(~F.col("old") & F.col("previous").isNotNull(), F.map_concat("metadata", F.create_map(F.lit("previous_record_id"), "previous"))).otherwise(F.col("metadata")))
    names = existing.columns
    return x.where("not old or later is not null").select(*names, (~F.col("old")).alias("new")), x.where("later is null").select(*names)


def chunked(records: DataFrame, settings: Settings) -> DataFrame:
    return C.analysed(C.chunk_records(records, settings), settings).select(*(f.split()[0] for f in schema.columns(schema.CHUNK)))

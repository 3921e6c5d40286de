"""Chunks of records: overlapping windows of text with their tokens and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import text as X
from tessera.functions import vector as V


def windows(text: Column, settings: Settings) -> Column:
    """array<string> of the windows of a text, each stripped; the last is the first that reaches the end. Blank ones go."""
    size, step = settings.window
    n = F.when(F.length(text) <= size, 1).otherwise(1 + F.ceil((F.length(text) - size) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.trim(F.substring(text, i * step + 1, F.lit(size))))
    return F.when(F.length(text) > 0, F.filter(cut, lambda c: c != "")).otherwise(F.array().cast("array<string>"))


def chunk_records(records: DataFrame, settings: Settings) -> DataFrame:
    """(chunk_id, record_id, chunk_index, text, token_count_estimate) for each chunk of records (id, text)."""
    x = records.select(F.col("id").alias("record_id"), F.posexplode(windows(F.col("text"), settings)).alias("chunk_index", "text"))
    return x.select(F.concat("record_id", F.lit(":"), F.col("chunk_index").cast("string")).alias("chunk_id"), "record_id", "chunk_index", "text", X.token_estimate(F.col("text")).alias("token_count_estimate"))


def analysed(chunks: DataFrame, settings: Settings) -> DataFrame:
    """chunks with lexical_tokens and their vectors (buckets, weights)."""
    return V.embedded(chunks.withColumn("lexical_tokens", X.lexical_tokens(F.col("text"))), settings)

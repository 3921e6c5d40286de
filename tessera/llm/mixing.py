"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash of its id. Sizes are summed by source and by the leading bits of the hash; the
histogram shows in which bucket a source's budget ends, and only that bucket is split further, until the threshold is
a single hash value. Documents are then kept by comparing their hash to the threshold: nothing is sorted, and a source
that holds most rows is summed before it is shuffled. Thresholds nest: a larger budget keeps all that a smaller one keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, table

#: Hash digits (four bits each) that one histogram resolves, and how many histograms follow each other.
DIGITS, LEVELS = 3, 5
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row a source.

    Sources in code-point order, null last, get the weights in turn and divide share times all sizes; no target exceeds
    most times its source's size, and what is above is shared again by weight. That process ends at the level where the
    sources that are full in order of cap by weight are those whose cap lies below the common level of the rest.
    An empty table gives no rows; a source of size 0 has the target 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("ratio", F.col("cap") / F.col("w"))
    every, upto = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(every))
    x = x.withColumn("cap_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(upto), F.lit(0)))
    x = x.withColumn("full", F.col("cap") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("budget") - F.col("cap_before")))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    left_w = F.col("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), F.lit(0))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * left / left_w))
    return x.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame) -> list[Column]:
    """The columns mix_size (words; null text: 0) and mix_hash (hexadecimal digits of a hash of doc_id) of docs."""
    h = F.substring(F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")), 1, DIGITS * LEVELS)
    return [F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("mix_size"), h.alias("mix_hash")]


def thresholds(slim: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(s, source_size, target, whole, prefix, closes), a row a source: whole copies of everything and the hash up to which one more is taken."""
    slim = slim.select("source", F.col("mix_size").alias("size"), F.col("mix_hash").alias("h"))
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    at = targets.withColumn("whole", whole.cast("long"))
    at = cut(at.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit("")))
    per, upto = Window.partitionBy("s"), Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(1, LEVELS + 1):
        edge = at.select(F.col("source").alias("s"), "prefix", "left")
        here = slim.join(edge, F.col("source").eqNullSafe(F.col("s")) & F.col("h").startswith(F.col("prefix")))
        hist = here.groupBy("s", F.substring("h", 1, DIGITS * level).alias("bucket")).agg(F.sum("size").alias("n"), F.first("left").alias("left"))
        hist = hist.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        # the last bucket that starts within the budget is the boundary: all before it fit whole
        hist = hist.withColumn("last", F.max(F.when(F.col("before") <= F.col("left"), F.col("bucket"))).over(per)).where("bucket = last")
        step = hist.select("s", "bucket", F.col("left") - F.col("before"), "n").toDF("s", "next", "rest", "n")
        old = at.drop("n").withColumnRenamed("left", "old_left").withColumnRenamed("prefix", "old_prefix")
        at = cut(old.join(step, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", F.coalesce("next", "old_prefix").alias("prefix"), F.coalesce("rest", "old_left").alias("left"), F.coalesce("n", F.lit(0)).alias("n")))
    return at.withColumn("closes", F.col("n") - F.col("left") < F.col("left")).withColumnRenamed("source", "s").drop("left", "n")


def mixed(docs: DataFrame, at: DataFrame, most: float) -> DataFrame:
    """Rows with source, mix_size and mix_hash, and source_size, target, copies and taken."""
    more = (F.col("mix_hash") < F.col("prefix")) | ((F.col("mix_hash") == F.col("prefix")) & F.col("closes"))
    copies = F.col("whole") + F.when(more & (F.col("whole") < F.lit(int(most))), 1).otherwise(0)
    out = docs.join(at, docs["source"].eqNullSafe(at["s"])).withColumn("copies", copies.cast("long"))
    return out.withColumn("taken", F.col("mix_size") * F.col("copies")).drop("s", "whole", "prefix", "closes", "mix_hash")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, mix_size, source_size, target, copies, taken): how often the mix takes each row of docs (doc_id, text, source).

    mix_size is the number of words (null text: 0), taken is mix_size times copies. A target of r times its source's size
    takes every document floor(r) times, and those below the hash threshold once more; the document at the threshold is
    taken if that brings the sum nearer to the target. Rows with the same doc_id (null too) share a hash and are taken
    alike. Documents of size 0 are taken 0 words. A very long text is counted as a whole, where it is read. Other columns of docs are not read; an empty table gives an empty result.
    """
    slim = cut(docs.select("doc_id", "source", *sized(docs)))
    return mixed(slim, thresholds(slim, weights, share, most), most)


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs that mix_sources() takes, with all their columns and how often (copies); texts are not shuffled.

    mix_size, source_size, target, copies and taken come behind the columns of docs, with mix_ before a name that docs
    has already. Nulls, repeated rows and very long texts are treated as in mix_sources(); an empty table stays empty."""
    slim = cut(docs.select("source", *sized(docs)))
    packed = docs.select(F.struct("*").alias("row"), "source", *sized(docs))
    out = mixed(packed, thresholds(slim, weights, share, most), most).where("copies > 0")
    new = [(c, free_name(docs.columns, c, "mix")) for c in ("mix_size", "source_size", "target", "copies", "taken")]
    return out.select("row.*", *(F.col(c).alias(name) for c, name in new))


def op9_mix_sources(spark, sf_dir):
    """Size, target of its source and words taken of each document, with the weights 3, 1, 2 and a share of 150 %."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
             source_size * CAST(2 AS DOUBLE) AS cap, (sum(source_size) OVER ()) * CAST(1.5 AS DOUBLE) AS budget FROM s),
f AS (SELECT *, sum(w) OVER () AS all_w,
             cap * (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             <= w * (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM w),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, w
        * (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / (all_w - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0))) END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT d.source, h, sum(size) AS n FROM d GROUP BY d.source, h),
c AS (SELECT g.source, g.h, g.n, sum(g.n) OVER (PARTITION BY g.source ORDER BY g.h) AS upto, r.target - r.whole * r.source_size AS left_over
      FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
b AS (SELECT source, max(h) FILTER (WHERE upto - n <= left_over) AS edge FROM c GROUP BY source),
k AS (SELECT c.source, c.h, c.h < b.edge OR (c.h = b.edge AND c.upto - c.left_over < c.left_over - (c.upto - c.n)) AS more FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, r.source_size, r.target, CAST(d.size * (r.whole + CASE WHEN k.more AND r.whole < 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""

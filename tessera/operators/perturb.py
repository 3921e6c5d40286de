"""A perturbed copy of a dataset, to see how retrieval holds up: texts change places, scopes and tags change, near copies come in.

All choices follow from hashes of the id, so the same records always give the same copy, and nothing is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that stand for tags, and words that replace one in a near copy.
TAGS = {"legal": "lawful", "finance": "financial", "compliance": "conformity", "risk": "hazard", "strategy": "plan", "review": "assessment", "quarterly": "q_period", "policy": "guideline", "board": "directors"}
WORDS = ("modified", "updated", "revised", "adjusted", "alternative")
SCOPES, TAGGED = 20, 30  # percent of records whose scope, or whose tags, change
NEAR = 50
#: Texts change places within buckets of about so many records.
BUCKET = 256


def draw(salt: str, key: Column) -> Column:
    """A number from 0 to 2**28 - 1 out of a key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt} "), key).cast("binary")), 1, 7), 16, 10).cast("long")


def perturbed(records: DataFrame, buckets: int | None = None) -> DataFrame:
    """records (id, text, scope, session_id, user_id, tags, source_key, ...) perturbed, with perturbed and near_duplicate.

    NEAR near copies of records, one word of each exchanged, are added with keys of their own. With buckets unset there
    is one for every BUCKET records."""
    key = F.col("id")
    n = buckets or max(1, -(-records.count() // BUCKET))
    x = records.withColumn("_b", draw("bucket", key) % n)
    place = lambda salt: F.row_number().over(Window.partitionBy("_b").orderBy(draw(salt, key), key))
    texts = x.select("_b", place("from").alias("_p"), F.col("text").alias("_text"))
    x = x.withColumn("_p", place("to")).join(texts, ["_b", "_p"]).drop("_b", "_p")
    turned = draw("scope", key) % 100 < SCOPES
    scope = F.col("scope")
    x = x.withColumn("_old", scope).withColumn("scope", F.when(turned, F.when(scope == "session", "user").when(scope == "user", "global").otherwise("session")).otherwise(scope))
    number = (draw("owner", key) % 15 + 1).cast("string")
    user = F.when(turned & (F.col("_old") == "session"), F.concat(F.lit("u_perturbed_"), F.lpad(number, 2, "0"))).when(~turned | (F.col("_old") != "user"), F.col("user_id"))
    session = F.when(turned & (F.col("_old") == "global"), F.concat(F.lit("s_perturbed_"), number)).when(~turned | (F.col("_old") != "session"), F.col("session_id"))
    names = F.create_map(*(F.lit(v) for kv in TAGS.items() for v in kv))
    tags = F.when(draw("tags", key) % 100 < TAGGED, F.transform("tags", lambda t: F.coalesce(F.try_element_at(names, t), t))).otherwise(F.col("tags"))
    x = x.withColumn("user_id", user).withColumn("session_id", session).withColumn("tags", tags).withColumn("text", F.col("_text"))
    x = x.select(*records.columns, F.lit(True).alias("perturbed"), F.lit(False).alias("near_duplicate"))
    few = records.orderBy(draw("near", key), key).limit(NEAR)  # a fixed number of near copies
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    at = (draw("word", key) % F.size(words)).cast("int")
    new = F.concat(F.element_at(F.array(*map(F.lit, WORDS)), (draw("new", key) % len(WORDS) + 1).cast("int")), F.right(F.element_at(words, at + 1), F.lit(2)))
    text = F.when(F.size(words) > 5, F.array_join(F.transform(words, lambda w, i: F.when(i == at, new).otherwise(w)), " ")).otherwise(F.array_join(words, " "))
    copies = few.select(*(text.alias("text") if c == "text" else F.concat(F.lit("near_dup:"), F.col("id")).alias("source_key") if c == "source_key" else F.col(c) for c in records.columns), F.lit(False).alias("perturbed"), F.lit(True).alias("near_duplicate"))
    return x.union(copies)

"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each chosen path written as one conversation.

Paths are enumerated by self-joins that double: after k joins every message knows its ancestor 2**k replies up, so a
thread of n messages takes log2(n) joins. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

# The template. A turn is OPEN role SAYS text CLOSE.
OPEN, SAYS, CLOSE = "<s>", "[INST]", "</s>"


def escape(x: Column) -> Column:
    """Doubles backslashes and puts one behind each < and [, so that no marker can be read inside a text."""
    return F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), r"([<\[])", r"$1\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[])\\|\\(\\)", "$1$2")


def tree_levels(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (conv_id, msg, up) of ancestors 2**k replies up, k = 0, 1, ..., and (conv_id, msg, root, depth, total) for each message.

    total is the sum of scores from the root on. A message whose parent is missing is a root; messages on a cycle, and
    what replies to them, have no root and no row.
    """
    at = messages.alias("a").join(messages.select(F.col("conv_id").alias("c"), F.col("msg").alias("m")).alias("b"), F.col("a.conv_id").eqNullSafe(F.col("c")) & (F.col("a.parent") == F.col("m")), "left")
    known = F.when(F.col("m").isNotNull() & ~F.col("m").eqNullSafe(F.col("msg")), F.col("m"))
    own_cycle = F.col("parent").eqNullSafe(F.col("msg"))
    step = cut(at.where(~own_cycle).select("conv_id", "msg", known.alias("up"), F.when(known.isNull(), F.col("msg")).alias("root"), F.lit(0).cast("long").alias("hops"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")))
    step = step.withColumn("hops", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"))
    longest = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    levels, reach = [], 1
    while True:
        open_rows = step.where("up is not null")
        if open_rows.isEmpty() or reach > 2 * longest:
            break
        levels.append(open_rows.select("conv_id", "msg", "up"))
        above = step.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), F.col("up").alias("u2"), F.col("root").alias("r2"), F.col("hops").alias("h2"), F.col("total").alias("t2"))
        both = open_rows.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("m")))
        moved = both.select("conv_id", "msg", F.col("u2").alias("up"), F.col("r2").alias("root"), (F.col("hops") + F.col("h2")).alias("hops"), (F.col("total") + F.col("t2")).alias("total"))
        step = cut(step.where("up is null").union(moved.select(step.columns)))
        reach *= 2
    return levels, step.where("up is null and root is not null").select("conv_id", "msg", "root", F.col("hops").alias("depth"), "total")


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, depth, role, text): the messages of the branches best root-to-leaf paths of each root.

    Branches rank by mean score, then by length, then by the leaf's id. messages: conv_id, msg, parent, role, text,
    score; msg is unique in its conversation. Null scores count 0. The joins move ids; texts move once, at the end.
    """
    levels, reached = tree_levels(messages.select("conv_id", "msg", "parent", "score"))
    parents = levels[0].select(F.col("conv_id").alias("c"), F.col("up").alias("p")).distinct() if levels else None
    leaves = reached.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("p")), "left_anti") if levels else reached
    rank = Window.partitionBy("conv_id", "root").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "msg")
    path = leaves.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= branches).select("conv_id", F.col("msg").alias("leaf"), "msg")
    path = cut(path)
    for level in reversed(levels):  # ancestors at every distance: the distance's binary digits, largest first
        up = level.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), "up")
        path = cut(path.union(path.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m"))).select("conv_id", "leaf", "up")))
    depth = reached.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), "depth")
    path = path.join(depth, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m"))).select("conv_id", "leaf", "msg", "depth")
    said = messages.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), "role", "text")
    return path.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m"))).select("conv_id", "leaf", "depth", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """(conv_id, leaf, formatted, mask): each path as one string, and for each of its turns the code points under the loss.

    mask has a struct<start, end> a turn, end exclusive; it covers the escaped text of assistant turns and is empty
    (start = end) elsewhere. Null roles and texts are empty.
    """
    x = paths.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", escape(F.coalesce("text", F.lit(""))))
    x = x.withColumn("turn", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAYS), "text", F.lit(CLOSE)))
    upto = Window.partitionBy("conv_id", "leaf").orderBy("depth")
    end = F.sum(F.length("turn").cast("long")).over(upto) - len(CLOSE)
    start = F.when(F.col("role") == "assistant", F.col("end") - F.length("text")).otherwise(F.col("end"))
    x = x.withColumn("end", end).withColumn("part", F.struct("depth", "turn", F.struct(start.alias("start"), "end").alias("loss")))
    x = x.groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return x.select("conv_id", "leaf", F.array_join("parts.turn", "").alias("formatted"), F.col("parts.loss").alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, leaf, turn, role, text, loss): turns parsed out of formatted strings; loss is the unescaped text under the mask."""
    x = formatted.select("conv_id", "leaf", "mask", F.posexplode(F.split("formatted", CLOSE, -1)).alias("turn", "piece")).where(F.col("turn") < F.size("mask"))
    x = x.withColumn("loss", F.element_at("mask", F.col("turn") + 1)).drop("mask")
    before = Window.partitionBy("conv_id", "leaf").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("offset", F.coalesce(F.sum(F.length("piece").cast("long") + len(CLOSE)).over(before), F.lit(0)))
    loss = F.substring(F.col("piece"), (F.col("loss.start") - F.col("offset") + 1).cast("int"), (F.col("loss.end") - F.col("loss.start")).cast("int"))
    role = F.substring_index(F.substring("piece", len(OPEN) + 1, 2**31 - 1), SAYS, 1)
    text = F.substring(F.col("piece"), F.length(role) + len(OPEN) + len(SAYS) + 1, F.length("piece"))
    return x.select("conv_id", "leaf", "turn", unescape(role).alias("role"), unescape(text).alias("text"), unescape(loss).alias("loss"))


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of chosen_paths() from rows (conv_id, turn, role, text) in which each turn answers the one before; ties by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    x = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("msg"))
    return x.select("conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text): what reading the formatted string back gives.

    Rows with a null conv_id form one conversation; null turns come first, repeated rows stay, null roles and texts read as
    empty. A very long text is one value, and the string of a conversation another, which holds all its turns. Other
    columns are not read; an empty table gives an empty result.
    """
    made = cut(format_paths(chosen_paths(cut(threads(conversations)))))
    turn = F.struct("turn", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), "loss")
    back = read_back(made).groupBy(F.col("conv_id").alias("c"), F.col("leaf").alias("l")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    loss = F.array_join("t.loss", "")
    both = made.select("conv_id", "leaf", F.length("formatted").cast("long").alias("formatted_chars")).join(back, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("leaf") == F.col("l")))
    return both.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(F.array_join("t.said", "").cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


PROBE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark, sf_dir):
    """What reading back all formatted conversations gives, with one more whose texts are control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).selectExpr("-1L as conv_id", "explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) as x")
    probe = probe.select("conv_id", "x.turn", "x.role", F.lit(PROBE).alias("text"))
    return format_conversations(rows.unionByName(probe))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, length(role) + length(text) + 13 + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

"""Line deduplication by content-defined chunks of lines.

A rolling hash runs over every two lines that follow each other. Where the same hash stands at another place too, a
chunk goes on; where it doesn't, a chunk ends: boundaries follow from what is repeated alone, so they shift with the
text, and a passage of two lines or more is found wherever it stands and however short it is. Hashes that occur more
than once are compared byte by byte, and all but the first occurrence are removed. dedup_lines() also takes
chunk_bounds(), chunks that don't overlap: a rolling hash over the last two line hashes marks a line, and a chunk ends
behind a marked line that follows an unmarked one. It is cheaper and misses passages that hold no whole chunk.
Only DataFrame functions are used. What is shuffled before the comparison are hashes; texts are shuffled twice, by
sort-merge joins at every size, since neither the marks nor the removals have a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, join_keyed, let, table

#: Lines in the shortest chunk that is removed.
LEAST_LINES = 2
LAST = 2**63 - 1
# Fixed values of the rolling hash: multipliers of this line's and the previous line's hash, and the modulus.
THIS, PREVIOUS, MODULUS = 31, 17, 1_000_003


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunk_bounds(lines: Column) -> Column:
    """array<struct<first, n>>: the first line (from 1) and number of lines of each chunk; every line is in one chunk."""
    place = F.sequence(F.lit(1), F.size(lines))
    earlier = lambda a, i: F.when(i > 1, F.element_at(a, i - 1))

    def marked(h: Column) -> Column:
        return F.transform(place, lambda i: (F.element_at(h, i) * THIS + F.coalesce(earlier(h, i), F.lit(0)) * PREVIOUS) % MODULUS % 2 == 0)

    def ends(f: Column) -> Column:
        return F.filter(place, lambda i: (i == F.size(f)) | (F.element_at(f, i) & ~F.coalesce(earlier(f, i), F.lit(False))))

    def chunks(e: Column) -> Column:
        return F.zip_with(e, F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1)), lambda end, before: F.struct((before + 1).alias("first"), (end - before).alias("n")))

    return let(F.transform(lines, line_hash), lambda h: let(marked(h), lambda f: let(ends(f), chunks)))


def every_chunk(lines: Column) -> Column:
    """array<struct<first, n>>: the LEAST_LINES lines that begin at each line, as far as there are as many."""
    first = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: i <= F.size(lines) - LEAST_LINES + 1)
    return F.transform(first, lambda i: F.struct(i.alias("first"), F.lit(LEAST_LINES).alias("n")))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunk_text(lines: Column, c: Column) -> Column:
    return F.array_join(F.slice(lines, c["first"], c["n"]), "\n")


def chunk_hash(text: Column) -> Column:
    return F.xxhash64(text)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["d"]) & (a["th"] == b["t"])


def removals(docs: DataFrame, chunks) -> DataFrame:
    """(d, t, drop): for rows of docs (doc_id, text) that lose chunks, their doc_id, text hash, and the chunks by place."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))

    found = let(split_lines(F.col("text")), lambda x: F.transform(F.filter(chunks(x), lambda c: c["n"] >= LEAST_LINES), lambda c: F.struct(c["first"].alias("first"), c["n"].alias("n"), chunk_hash(chunk_text(x, c)).alias("hash"))))
    occurs = cut(rows.where("text is not null").select("doc_id", "th", F.explode(found).alias("c")).select("doc_id", "th", "c.*"))
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), "first", "th")
    repeated = occurs.groupBy("hash").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("owner")).where("times > 1")
    marks = join_keyed(occurs, repeated, "hash", occurs.count()).withColumn("keeps", place == F.col("owner"))
    marks = cut(marks.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct("first", "n", "hash", "keeps")).alias("marks")))
    held = rows.join(marks.hint("merge"), same_row(rows, marks)).select("d", "t", "marks", split_lines(F.col("text")).alias("lines"))
    text_of = let(F.col("lines"), lambda x: F.transform("marks", lambda m: F.struct(m["hash"].alias("hash"), m["first"].alias("first"), m["n"].alias("n"), chunk_text(x, m).alias("text"))))
    texts = held.select("d", "t", F.explode(text_of).alias("c")).select("d", "t", "c.*")
    unequal = cut(texts.groupBy("hash").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most").select("hash"))
    gone = marks.select("d", "t", F.explode("marks").alias("m")).where("not m.keeps").select("d", "t", "m.first", "m.n", "m.hash")
    if not unequal.isEmpty():  # one hash for several texts: each text has its own first place
        first = Window.partitionBy("hash", "text").orderBy(F.coalesce(F.col("d").cast("long"), F.lit(LAST)), "first", "t")
        told = texts.join(unequal, "hash").withColumn("place", F.row_number().over(first)).where("place > 1")
        gone = gone.join(unequal, "hash", "left_anti").select("d", "t", "first", "n").union(told.select("d", "t", "first", "n"))
    return cut(gone.groupBy("d", "t").agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("drop")))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """dedup_lines() with every chunk of LEAST_LINES lines: all passages that long go that an earlier place holds.

    A line goes if any chunk that it is in is not the first of its kind, so passages may overlap; of every line that
    goes, an equal one at an earlier place stays. A run of one line that repeats thus keeps its first line.
    """
    return dedup_lines(docs, every_chunk)


def dedup_lines(docs: DataFrame, chunks=chunk_bounds) -> DataFrame:
    """docs with repeated chunks removed from text, all other columns, and the counts line_count and line_removed (with
    dedup_ before a name that docs has already).

    The first occurrence by doc_id (null last) and place stays, also when a chunk repeats inside one document; rows
    equal in doc_id and text count as one and stay alike. Null texts stay null and have no lines; an empty text has one
    line. A very long text is one row of the shuffle and is split as a whole. Chunks whose hashes agree but whose bytes
    differ are told apart. An empty table gives an empty result. n_chars, where docs has it, follows the new text.
    chunks gives the array<struct<first, n>> of an array of lines; chunks that overlap are of one length.
    """
    gone, columns = removals(docs.select("doc_id", "text"), chunks), docs.columns
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("whole"), F.xxhash64("text").alias("th"))
    both = packed.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")

    def kept(x: Column) -> Column:
        begins = F.concat(F.array(F.lit(1)), F.transform("drop", lambda c: c["first"] + c["n"]))
        stops = F.concat(F.transform("drop", lambda c: c["first"]), F.array(F.size(x) + 1))
        return F.array_join(F.flatten(F.zip_with(begins, stops, lambda a, b: F.slice(x, a, F.greatest(b - a, F.lit(0))))), "\n")

    text = F.when(F.col("drop").isNull(), F.col("whole")).otherwise(let(split_lines(F.col("whole")), kept))
    fold = lambda s, c: F.struct((c["first"] + c["n"]).alias("end"), (s["n"] + c["first"] + c["n"] - F.greatest(c["first"], s["end"])).alias("n"))
    lost = F.coalesce(F.aggregate("drop", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), fold, lambda s: s["n"]), F.lit(0)).cast("long")
    count = F.when(F.col("whole").isNull(), 0).otherwise(F.length("whole") - F.length(F.replace("whole", F.lit("\n"), F.lit(""))) + 1).cast("long")
    new = both.select("row", text.alias("new"), count.alias("count"), lost.alias("lost"))
    kinds = {f.name: f.dataType for f in docs.schema}
    values = {"text": F.col("new"), "n_chars": F.length("new").cast(kinds["n_chars"]) if "n_chars" in kinds else None}
    mine = (free_name(columns, "line_count", "dedup"), free_name(columns, "line_removed", "dedup"))
    return new.select(*(values.get(c, F.col("row")[c]).alias(c) for c in columns), F.col("count").alias(mine[0]), F.col("lost").alias(mine[1]))


def op6_line_dedup(spark, sf_dir):
    """Lines and removed lines of each document, and the hash of what is left of its text."""
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line, len(lines) AS n FROM d),
p AS (SELECT *, lead(line) OVER (PARTITION BY r ORDER BY i) AS next FROM l),
g AS (SELECT r, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) > 1 AS gone FROM p WHERE i < n),
k AS (SELECT r, i FROM g WHERE gone UNION SELECT r, i + 1 FROM g WHERE gone),
o AS (SELECT l.r, count(*) AS n_lines, count(k.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE k.i IS NULL), '') AS t
      FROM l LEFT JOIN k ON l.r = k.r AND l.i = k.i GROUP BY l.r)
SELECT d.doc_id, n_lines, n_removed, sha256(t) AS kept_sha256 FROM d JOIN o ON d.r = o.r
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""

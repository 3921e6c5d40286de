"""Retrieval quality: hits of cases, runs compared, gates, and reports by series and tier."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers of difficulty and the runs that belong to them.
TIERS = {
    "trivial": (1, 5), "easy": (6, 10), "moderate_easy": (11, 15), "moderate": (16, 20), "moderate_hard": (21, 25),
    "hard": (26, 30), "harder": (31, 35), "very_hard": (36, 40), "extreme": (41, 45), "maximum": (46, 50),
}


# Of each tier the token budget, the least and most cases of a run, and whether wider scopes are searched.
DIFFICULTY = {
    "trivial": (2000, 3, 5, True), "easy": (1500, 5, 8, True), "moderate_easy": (1200, 8, 12, True), "moderate": (900, 12, 16, True), "moderate_hard": (700, 16, 20, True),
    "hard": (600, 20, 24, True), "harder": (500, 24, 28, False), "very_hard": (400, 28, 32, False), "extreme": (300, 32, 36, False), "maximum": (200, 36, 40, False),
}


def before_colon(key: Column) -> Column:
    return F.element_at(F.split(key, ":"), 1)


def matched_keys(retrieved: Column, expected: Column) -> Column:
    """Retrieved keys that were expected: by the part before the colon if an expected key has one, else as they are."""
    prefixes = F.transform(F.filter(expected, lambda k: F.contains(k, F.lit(":"))), before_colon)
    loose = F.filter(retrieved, lambda k: F.array_contains(prefixes, before_colon(k)))
    return F.array_sort(F.when(F.size(prefixes) > 0, loose).otherwise(F.array_intersect(retrieved, expected)))


def matched_terms(text: Column, expected: Column) -> Column:
    return F.array_sort(F.filter(expected, lambda t: F.contains(F.lower(text), F.lower(t))))


def hits(results: DataFrame) -> DataFrame:
    """results (retrieved_keys, expected_keys, expected_terms, term_text, retrieval_count) with what matched and both hits."""
    x = results.withColumn("matched_keys", matched_keys(F.col("retrieved_keys"), F.col("expected_keys"))).withColumn("matched_terms", matched_terms(F.col("term_text"), F.col("expected_terms")))
    x = x.withColumn("retrieval_hit", F.when(F.size("expected_keys") > 0, F.size("matched_keys") > 0).otherwise(F.col("retrieval_count") > 0))
    return x.withColumn("assembly_hit", F.when(F.size("expected_terms") > 0, F.size("matched_terms") > 0).otherwise(F.col("retrieval_hit")))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(name, hits on both sides, what changed) for two runs (name, retrieval_hit, assembly_hit, seq); a case missing on a
    side is no hit there, and of cases with one name the last counts."""
    side = lambda df, p: df.groupBy("name").agg(*(F.max_by(c, "seq").alias(f"{p}_{c}") for c in ("retrieval_hit", "assembly_hit")))
    x = side(baseline, "baseline").join(side(candidate, "candidate"), "name", "full_outer")
    x = x.select("name", *(F.coalesce(f"{p}_{c}", F.lit(False)).alias(f"{p}_{c}") for p in ("baseline", "candidate") for c in ("retrieval_hit", "assembly_hit")))
    for what in ("retrieval", "assembly"):
        x = x.withColumn(f"{what}_changed", F.col(f"baseline_{what}_hit") != F.col(f"candidate_{what}_hit"))
    return x


def regressions(compared: DataFrame) -> DataFrame:
    return compared.agg(*(F.count_if(F.col(f"baseline_{w}_hit") & ~F.col(f"candidate_{w}_hit")).alias(f"{w}_regressions") for w in ("retrieval", "assembly")))


def gate(candidate: DataFrame, compared: DataFrame | None, least_retrieval: float = 0.8, least_assembly: float = 0.8, most_retrieval: int = 0, most_assembly: int = 0) -> DataFrame:
    """One row: rates of a run, its regressions against a baseline, failures in words, and whether it passed."""
    x = candidate.agg(F.count(F.lit(1)).alias("total_cases"), F.count_if("retrieval_hit").alias("r"), F.count_if("assembly_hit").alias("a"))
    x = x.select("total_cases", ratio(F.col("r"), F.col("total_cases")).alias("retrieval_hit_rate"), ratio(F.col("a"), F.col("total_cases")).alias("assembly_hit_rate"))
    zero = F.lit(0).cast("long")
    x = x.crossJoin(regressions(compared)) if compared is not None else x.withColumn("retrieval_regressions", zero).withColumn("assembly_regressions", zero)  # one row each
    fails = []
    for what, least in (("retrieval", least_retrieval), ("assembly", least_assembly)):
        rate = F.col(f"{what}_hit_rate")
        fails.append(F.when(rate < least, F.concat(F.lit(f"{what}_hit_rate_below_threshold: actual="), F.format_string("%.3f", rate), F.lit(f" required={least:.3f}"))))
    for what, most in (("retrieval", most_retrieval), ("assembly", most_assembly)):
        n = F.col(f"{what}_regressions")
        fails.append(F.when(n > most, F.concat(F.lit(f"{what}_regressions_above_threshold: actual="), n.cast("string"), F.lit(f" allowed={most}"))))
    x = x.withColumn("failures", F.array_compact(F.array(*fails)))
    return x.withColumn("passed", F.size("failures") == 0)


def tier_of(spark) -> DataFrame:
    return spark.createDataFrame([(n, lo, hi) for n, (lo, hi) in TIERS.items()], "tier string, lo int, hi int")


def tier_report(runs: DataFrame) -> DataFrame:
    """Mean, median, least and most of the rates and seconds of runs (series, run, retrieval_rate, assembly_rate, seconds),
    by series and tier, by series, by tier and overall ('all' stands for every one)."""
    tiers = F.broadcast(tier_of(runs.sparkSession))  # ten rows
    x = runs.join(tiers, F.col("run").between(F.col("lo"), F.col("hi")), "left").withColumn("tier", F.coalesce("tier", F.lit("maximum")))
    measures = [f(c).alias(f"{n}_{c}") for c in ("retrieval_rate", "assembly_rate", "seconds") for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    g = x.groupingSets([[F.col("series"), F.col("tier")], [F.col("series")], [F.col("tier")], []], F.col("series"), F.col("tier"))
    return g.agg(F.count(F.lit(1)).alias("runs"), *measures).withColumn("series", F.coalesce("series", F.lit("all"))).withColumn("tier", F.coalesce("tier", F.lit("all")))


def run_table(runs: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """Runs (series, run, ...) with their tier and what their results (series, run, name, retrieval_hit, assembly_hit,
    retrieval_count, token_count_estimate) and case definitions (series, run, name) say; zeros where these are missing."""
    n, tokens = F.col("retrieval_count"), F.col("token_count_estimate")
    measured = results.groupBy("series", "run").agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if("retrieval_hit").alias("retrieval_hits"), F.count_if("assembly_hit").alias("assembly_hits"), F.round(F.avg(n), 1).alias("mean_retrieval_count"),
        F.min(n).alias("min_retrieval_count"), F.max(n).alias("max_retrieval_count"), F.round(F.avg(tokens), 0).alias("mean_assembly_tokens"), F.sum(tokens).alias("total_assembly_tokens"),
    )
    defined = cases.groupBy("series", "run").agg(F.count(F.lit(1)).alias("case_definitions"))
    x = runs.join(measured, ["series", "run"], "left").join(defined, ["series", "run"], "left")
    x = x.na.fill(0, [c for c in (*measured.columns, "case_definitions") if c not in ("series", "run")])
    tiers = F.broadcast(tier_of(runs.sparkSession))  # ten rows
    x = x.join(tiers, F.col("run").between(F.col("lo"), F.col("hi")), "left").drop("lo", "hi")
    return x.withColumn("tier", F.coalesce("tier", F.lit("maximum")))


def pruning_report(runs: DataFrame) -> DataFrame:
    """Mean active, pruned and imported records and the share pruned, by variant and dataset."""
    x = runs.groupBy("variant", "dataset").agg(F.avg("active").alias("avg_active"), F.avg("pruned").alias("avg_pruned"), F.avg("imported").alias("avg_imported"))
    return x.withColumn("pruned_percent", F.when(F.col("avg_imported") > 0, 100 * F.col("avg_pruned") / F.col("avg_imported")).otherwise(0.0))


def dataset_profile(records: DataFrame) -> DataFrame:
    """(kind, scope, n, prefixes, structured, text lengths, fields) by kind and scope; fields are the names of columns that
    any of the records fills."""
    n = F.length("text")
    fields = F.array_sort(F.array_compact(F.array(*(F.when(F.count(c) > 0, c) for c in records.columns))))
    return records.groupBy("kind", "scope").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(before_colon(F.col("source_key"))).alias("prefixes"), F.count_if(F.col("structured_json").isNotNull()).alias("structured"), F.avg(n).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.median(n).alias("median_chars"), fields.alias("fields"))


def drawn(*parts: Column) -> Column:
    """A number from 0 to 2**28 - 1 out of some keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(" ", *parts).cast("binary")), 1, 7), 16, 10).cast("long")


def cases_for_runs(queries: DataFrame, runs: int = 50) -> DataFrame:
    """(run, tier, case, name, query_id, token_budget, wide, terms_scope): the cases of each run out of queries (query_id, tier).

    A run draws from the queries of its tier and of all easier ones, as many as its tier asks for, by a hash of run and
    query, so that the same queries always give the same cases. wide says whether user and global scope are searched."""
    tiers = [(n, name, *TIERS[name], *DIFFICULTY[name]) for n, name in enumerate(TIERS)]
    table = F.broadcast(queries.sparkSession.createDataFrame(tiers, "place int, tier string, lo int, hi int, token_budget int, least int, most int, wide boolean"))  # ten rows
    plan = queries.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run")).join(table, F.col("run").between(F.col("lo"), F.col("hi")))
    wanted = F.col("least") + drawn(F.lit("cases"), F.col("run").cast("string")) % (F.col("most") - F.col("least") + 1)
    pool = queries.join(table.select(F.col("tier").alias("of"), F.col("place").alias("rank")), F.col("tier") == F.col("of")).select("query_id", "rank")
    x = pool.join(F.broadcast(plan.withColumn("wanted", wanted)), F.col("rank") <= F.col("place"))  # fifty rows
    order = Window.partitionBy("run").orderBy(drawn(F.col("run").cast("string"), F.col("query_id").cast("string")), "query_id")
    x = x.withColumn("case", F.row_number().over(order)).where(F.col("case") <= F.col("wanted"))
    name = F.concat(F.lit("run"), F.lpad(F.col("run").cast("string"), 2, "0"), F.lit("_case"), F.lpad(F.col("case").cast("string"), 2, "0"), F.lit("_"), F.col("tier"))
    scope = F.when(F.col("wide"), "assembled_context").otherwise("retrieved_records")
    return x.select("run", "tier", "case", name.alias("name"), "query_id", "token_budget", "wide", scope.alias("terms_scope"))


def valid_terms(cases: DataFrame, records: DataFrame) -> DataFrame:
    """cases (name, expected_terms) with valid_terms, those that any text of records (text) holds.

    Each distinct term is looked for in one pass over the texts; what comes back is one row a term."""
    terms = [r["t"] for r in cases.select(F.explode("expected_terms").alias("t")).distinct().orderBy("t").collect()]  # of the cases of a suite
    if not terms:
        return cases.withColumn("valid_terms", F.array().cast("array<string>"))

    def held(batches):
        open_ = list(terms)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                here = [t for t in open_ if t in text]
                if here:
                    yield pa.RecordBatch.from_arrays([pa.array(here)], ["t"])
                    open_ = [t for t in open_ if t not in set(here)]

    found = records.where("text is not null").select("text").mapInArrow(held, "t string").distinct().agg(F.collect_set("t").alias("known"))  # the terms at most
    return cases.crossJoin(found).withColumn("valid_terms", F.filter("expected_terms", lambda t: F.array_contains("known", t))).drop("known")  # one row

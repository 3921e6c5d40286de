"""Hybrid retrieval: visible chunks scored by meaning, words and keywords, two candidate pools, one ranking.

Chunks are stored with their tokens and vectors. A request, or a block of requests, is one pass over the visible chunks:
each task scores its chunks against all requests of the block with matrix products and keeps what may be in their pools,
so no pair of request and chunk is ever shuffled, and nothing stored is embedded again.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema
from tessera.config import Request, Settings
from tessera.functions import text as X
from tessera.functions import vector as V
from tessera.operators import chunks as C
from tessera.operators import filters, ingest

# Bonuses by scope and kind, and those of the keyword score.
SCOPE_BONUS = {"session": 0.12, "user": 0.08, "global": 0.03}
STRONG_KINDS, GOOD_KINDS = ("research_report", "research_finding"), ("decision_outcome", "topic_pattern", "user_profile_note")
TITLE, TAG, PATH, KEY, OPENING = 0.04, 0.03, 0.04, 0.02, 0.01
DIGITS = 9  # scores are ranked as rounded to so many digits, so that ties do not hang on the order of additions


@dataclass(frozen=True)
class Query:
    """A request's tokens and vector."""

    tokens: list[str]
    buckets: np.ndarray
    weights: np.ndarray


def analyse(texts: list[str], settings: Settings) -> list[Query]:
    """Requests are analysed as records are."""
    tokens = [X.tokens_of(t) for t in texts]
    return [Query(t, b, w) for t, (b, w) in zip(tokens, V.embedder(settings)(tokens), strict=True)]


def query_text(spark, request: Request) -> str:
    """What of a request is looked for: its text and, with intent data, what a record of that data would say beside it."""
    text = request.query_text.strip()
    if not text or (request.intent_json is None and request.intent_schema is None):
        return text
    declared = {"field_paths": [], "primary_text_paths": [], **request.intent_schema} if request.intent_schema else None
    if declared and "schema_mode" not in declared:
        declared["schema_mode"] = "declared"
    names = [c.split(":")[0] for c in schema.DATA_SCHEMA.removeprefix("struct<").removesuffix(">").replace("array<string>", "array").split(",")]
    row = (text, request.intent_json, tuple(declared.get(n) for n in names) if declared else None)
    one = spark.createDataFrame([row], f"text string, structured_json string, declared_schema {schema.DATA_SCHEMA}")
    return ingest.content(one).first()["analysis"]


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def scope_bonus() -> Column:
    return F.when(F.col("scope") == "session", SCOPE_BONUS["session"]).when(F.col("scope") == "user", SCOPE_BONUS["user"]).otherwise(SCOPE_BONUS["global"])


def kind_bonus() -> Column:
    return F.when(F.col("kind").isin(*STRONG_KINDS), 0.15).when(F.col("kind").isin(*GOOD_KINDS), 0.08).otherwise(0.0)


def age_decay(settings: Settings, as_of: datetime) -> Column:
    """From +0.05 while fresh, falling to -0.25 at the horizon."""
    most = filters.horizon_days(settings).cast("double")
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(as_of)) - F.unix_micros("created_at")) / 86400e6)
    start = most * max(0.1, min(0.9, settings.decay_start_pct))
    falling = 0.05 - 0.30 * (age - start) / F.greatest(F.lit(0.001), most - start)
    return F.when(most <= 0, 0.0).when(age <= start, 0.05).when(age >= most, -0.25).otherwise(falling)


def keyword_bonus(tokens: Column) -> Column:
    """Of tokens (array<string>) against title, tags, schema paths and source key; and for opening chunks."""
    source_key = F.lower(F.coalesce("source_key", F.lit("")))
    bonus = F.when(F.arrays_overlap(tokens, X.lexical_tokens(F.col("title"))), TITLE).otherwise(0.0)
    bonus = bonus + F.when(F.arrays_overlap(tokens, F.transform("tags", F.lower)), TAG).otherwise(0.0)
    bonus = bonus + F.when(F.arrays_overlap(tokens, X.lexical_tokens(F.array_join("schema_field_paths", " "))), PATH).otherwise(0.0)
    bonus = bonus + F.when(F.exists(tokens, lambda t: F.contains(source_key, t)), KEY).otherwise(0.0)
    bonus = bonus + F.when(F.col("chunk_index") == 0, OPENING).otherwise(0.0)
    return F.when(F.size(tokens) > 0, bonus).otherwise(0.0)


def metadata_bonus(request: Request, settings: Settings) -> Column:
    w, tags = settings.metadata_bonus_weight, [t.lower() for t in request.tags]
    bonus = F.when(F.col("source_key").isin(*request.source_keys), w).otherwise(0.0) if request.source_keys else F.lit(0.0)
    return bonus + (F.when(F.arrays_overlap(F.transform("tags", F.lower), strings(tags)), w / 2).otherwise(0.0) if tags else F.lit(0.0))


def final_score(settings: Settings, as_of: datetime) -> Column:
    s = settings
    parts = F.col("semantic_score") * s.semantic_score_weight + F.col("lexical_score") * s.lexical_score_weight + F.col("keyword_bonus") * s.keyword_bonus_weight
    return F.round(parts + F.col("metadata_bonus") + kind_bonus() + scope_bonus() + age_decay(settings, as_of), DIGITS)


def selection_reason() -> Column:
    sem, lex, key = F.col("semantic_score"), F.col("lexical_score"), F.col("keyword_bonus")
    mode = F.when((sem >= lex) & (sem > 0), "semantic").when(lex > 0, F.when(key > 0, "lexical_keyword").otherwise("lexical")).otherwise("keyword")
    return F.concat("scope", F.lit("_scope_"), mode, F.lit("_match"))


def joined(records: DataFrame, chunks: DataFrame, request: Request, settings: Settings, as_of: datetime) -> DataFrame:
    """Chunks of visible records with the fields of their record."""
    seen = filters.visible(records, request, settings, as_of).withColumnRenamed("text", "record_text").withColumnRenamed("token_count_estimate", "record_tokens")
    return chunks.join(seen.drop("lexical_tokens", "semantic_terms", "buckets", "weights"), chunks["record_id"] == seen["id"]).drop("id")


def pooled(rows: DataFrame, request: Request, settings: Settings, keys: tuple[str, ...]) -> DataFrame:
    """The best rows by meaning and by words, each with its ranks (semantic_rank, lexical_rank); the union counts a row once."""
    top = request.top(settings)
    limits = {"semantic": max(top, top * settings.semantic_candidate_multiplier), "lexical": max(top, top * settings.lexical_candidate_multiplier)}
    for name in limits:
        order = [F.desc(f"{name}_score"), F.desc("keyword_bonus"), F.desc("created_at"), "record_id", "chunk_index"]
        rows = rows.withColumn(f"{name}_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    near = [F.col(f"{name}_rank") <= n for name, n in limits.items()]
    return rows.where(near[0] | near[1])


def reranked(pool: DataFrame, settings: Settings, as_of: datetime) -> DataFrame:
    """Candidates with a positive final score, and why they were chosen."""
    x = pool.withColumn("score", final_score(settings, as_of)).where("score > 0")
    return x.withColumn("selection_reason", selection_reason())


def ranked(items: DataFrame, limit: int, keys: tuple[str, ...] = ()) -> DataFrame:
    order = [F.desc("score"), F.desc("created_at"), "semantic_rank", "lexical_rank"]
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order))).where(F.col("rank") <= limit)


#: What a pass over the chunks gives: candidates, and for each request and batch of chunks how many were eligible.
FOUND = "query_id long, chunk_id string, record_id string, chunk_index int, created_at timestamp, semantic_score double, lexical_score double, keyword_bonus double, eligible long"
#: Chunks that a task scores at once, requests that one pass scores, and source keys whose words a worker remembers.
ROWS, BATCH, KEYS = 2048, 512, 100_000


class Requests:
    """Requests of a pass: their vectors as a matrix, and which of them ask for a word."""

    def __init__(self, queries: list[tuple[int, Query]], dims: int):
        self.ids = [i for i, _ in queries]
        self.vectors = np.zeros((len(queries), dims))
        for row, (_, q) in zip(self.vectors, queries, strict=True):
            row[q.buckets] = q.weights
        self.lengths = np.sqrt((self.vectors**2).sum(1))
        self.sizes = np.array([len(q.tokens) for _, q in queries], np.float64)
        asked = sorted((t, i) for i, (_, q) in enumerate(queries) for t in q.tokens)
        self.words = sorted({t for t, _ in asked})
        number = {t: n for n, t in enumerate(self.words)}
        self.askers = np.array([i for _, i in asked], np.int64)
        self.edge = np.searchsorted([number[t] for t, _ in asked], np.arange(len(self.words) + 1))
        self.value_set = pa.array(self.words, pa.string())

    def common(self, lists: pa.ListArray) -> np.ndarray:
        """How many of the words of each list (column) each request (row) asks for."""
        out = np.zeros((len(self.ids), len(lists)))
        flat = lists.flatten()
        if len(flat) and len(self.words):
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            word = pc.index_in(flat, self.value_set)
            here = np.flatnonzero(word.is_valid().to_numpy(zero_copy_only=False))
            word, row = word.drop_null().to_numpy(), row[here]
            times = (self.edge[word + 1] - self.edge[word]).astype(np.int64)
            of = np.repeat(self.edge[word] - np.cumsum(times) + times, times) + np.arange(times.sum())
            np.add.at(out, (self.askers[of], np.repeat(row, times)), 1)
        return out


def score_chunks(rows: DataFrame, queries: list[tuple[int, Query]], dims: int, pool: int) -> DataFrame:
    """FOUND for rows (chunk_id, record_id, chunk_index, created_at, tokens, buckets, weights, title_tokens, tags,
    path_tokens, source_key): of each portion of chunks what may be in a request's pools over all rows."""
    asked = Requests(queries, dims)
    names = [f.split()[0] for f in FOUND.split(", ")]

    def key_hits(keys: list[str], inside: dict[str, list[int]]) -> np.ndarray:
        out = np.zeros((len(asked.ids), len(keys)))
        if len(inside) > KEYS:
            inside.clear()
        for j, k in enumerate(keys):
            if k not in inside:
                inside[k] = sorted({int(i) for n, t in enumerate(asked.words) if t in k for i in asked.askers[asked.edge[n] : asked.edge[n + 1]]})
            out[inside[k], j] = KEY
        return out

    def score(batches):
        inside: dict[str, list[int]] = {}
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                yield from portion(whole.slice(start, ROWS), inside)

    def portion(batch, inside):
        n, column = len(batch), {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        dense = np.zeros((n, dims))
        sizes = column["buckets"].value_lengths().to_numpy()
        dense[np.repeat(np.arange(n), sizes), column["buckets"].flatten().to_numpy()] = column["weights"].flatten().to_numpy()
        both = asked.lengths[:, None] * np.sqrt((dense**2).sum(1))[None, :]
        cosine = np.round(np.maximum(0, np.divide(asked.vectors @ dense.T, both, out=np.zeros_like(both), where=both > 0)), DIGITS)
        common, held = asked.common(column["tokens"]), column["tokens"].value_lengths().to_numpy().astype(np.float64)
        lexical = np.round(np.divide(common, np.sqrt(asked.sizes[:, None] * held[None, :]), out=np.zeros_like(common), where=common > 0), DIGITS)
        key = sum((asked.common(column[c]) > 0) * value for c, value in (("title_tokens", TITLE), ("tags", TAG), ("path_tokens", PATH))) + key_hits(column["source_key"].to_pylist(), inside)
        index = column["chunk_index"].to_numpy()
        key = np.round(np.where(asked.sizes[:, None] > 0, key + np.where(index == 0, OPENING, 0.0)[None, :], 0.0), DIGITS)
        eligible = (cosine > 0) | (lexical > 0) | (key > 0)
        newest = -column["created_at"].cast(pa.timestamp("us", tz="UTC")).cast(pa.int64()).to_numpy()
        place = np.empty(n, np.int64)
        place[np.lexsort((index, np.array(column["record_id"].to_pylist())))] = np.arange(n)
        which, at = [], []
        for i in range(len(asked.ids)):
            can, mine = np.flatnonzero(eligible[i]), []
            for s in (cosine[i], lexical[i]):
                near = can[s[can] >= np.partition(s[can], len(can) - pool)[len(can) - pool]] if len(can) > pool else can
                mine.append(near[np.lexsort((place[near], newest[near], -key[i, near], -s[near]))[:pool]])
            found = np.union1d(*mine)
            which.append(np.full(len(found), i))
            at.append(found)
        i, j = np.concatenate(which).astype(np.int64), np.concatenate(at).astype(np.int64)
        ids = np.array(asked.ids, np.int64)
        taken = [column[c].take(pa.array(j)) for c in ("chunk_id", "record_id", "chunk_index", "created_at")]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), *taken, *(pa.array(x[i, j]) for x in (cosine, lexical, key)), pa.nulls(len(i), pa.int64())], names)
        nothing = [pa.nulls(len(ids), t) for t in (pa.string(), pa.string(), pa.int32(), column["created_at"].type, pa.float64(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(ids), *nothing, pa.array(eligible.sum(1).astype(np.int64))], names)

    return rows.mapInArrow(score, FOUND)


def scan(records: DataFrame, chunks: DataFrame, queries: list[tuple[int, Query]], request: Request, settings: Settings, as_of: datetime) -> DataFrame:
    """FOUND for queries, which share the filters of request: one pass. Chunks that are not analysed yet are, if visible."""
    top = request.top(settings)
    pool = max(top * settings.semantic_candidate_multiplier, top * settings.lexical_candidate_multiplier, top)
    seen = filters.visible(records, request, settings, as_of)
    words = {"title_tokens": X.lexical_tokens(F.col("title")), "tags": F.transform("tags", F.lower), "path_tokens": X.lexical_tokens(F.array_join("schema_field_paths", " ")), "source_key": F.lower(F.coalesce("source_key", F.lit("")))}
    seen = seen.select(F.col("id").alias("seen_id"), "created_at", *(F.coalesce(c, F.array().cast("array<string>")).alias(n) if n != "source_key" else c.alias(n) for n, c in words.items()))
    own = [c for c in ("lexical_tokens", "buckets", "weights") if c in chunks.columns] if "buckets" in chunks.columns else ["text"]
    x = chunks.select("chunk_id", "record_id", "chunk_index", *own).join(seen, F.col("record_id") == F.col("seen_id")).drop("seen_id")
    x = x if "buckets" in chunks.columns else C.analysed(x, settings)
    sent = x.select("chunk_id", "record_id", "chunk_index", "created_at", F.col("lexical_tokens").alias("tokens"), "buckets", "weights", *words)
    return score_chunks(sent, queries, max(8, settings.embedding_dimensions), pool)


def finished(found: DataFrame, records: DataFrame, chunks: DataFrame, request: Request, settings: Settings, as_of: datetime, few: bool = False) -> DataFrame:
    """The ranked items of each request (query_id) of a pass. few: there is one request, so that its pools are a few rows."""
    near = pooled(found.where("chunk_id is not null").drop("eligible"), request, settings, ("query_id",)).drop("record_id", "chunk_index", "created_at")
    fields = joined(records, chunks.drop("lexical_tokens", "buckets", "weights"), request, settings, as_of)
    kept = fields.join(F.broadcast(near) if few else near, "chunk_id").withColumn("metadata_bonus", metadata_bonus(request, settings))
    return ranked(reranked(kept, settings, as_of), request.top(settings), ("query_id",))


def of_request(records: DataFrame, chunks: DataFrame, request: Request, settings: Settings, as_of: datetime) -> DataFrame:
    """The pass of one request, whose query_id is 0; over nothing if there is nothing to look for."""
    query = analyse([query_text(records.sparkSession, request)], settings)[0]
    empty = not query.tokens and not len(query.buckets)
    return scan(records.limit(0) if empty else records, chunks.limit(0) if empty else chunks, [(0, query)], request, settings, as_of)


def retrieve(records: DataFrame, chunks: DataFrame, request: Request, settings: Settings, as_of: datetime) -> DataFrame:
    """The best chunks for a request, by rank from 1; none for a blank request. Ties fall to the newer record, then to ranks in the pools."""
    return finished(of_request(records, chunks, request, settings, as_of), records, chunks, request, settings, as_of, few=True).drop("query_id")


def counts_of(found: DataFrame, records: DataFrame, request: Request, settings: Settings, as_of: datetime) -> DataFrame:
    """One row about a request's pass: visible_records, eligible_chunks, semantic_candidates, lexical_candidates, reranked_candidates."""
    top = request.top(settings)
    size = lambda n: F.least(F.col("eligible_chunks"), F.lit(max(top, top * n)))
    visible = filters.visible(records, request, settings, as_of)
    seen = visible.agg(F.count(F.lit(1)).alias("visible_records"))
    eligible = found.agg(F.coalesce(F.sum("eligible"), F.lit(0)).alias("eligible_chunks"))
    near = pooled(found.where("chunk_id is not null").drop("eligible"), request, settings, ("query_id",))
    fields = visible.drop("created_at").withColumn("metadata_bonus", metadata_bonus(request, settings)).withColumnRenamed("id", "record_id")
    final = reranked(fields.join(F.broadcast(near), "record_id"), settings, as_of).agg(F.count(F.lit(1)).alias("reranked_candidates"))  # two pools of one request
    one = seen.crossJoin(eligible).crossJoin(final)  # three rows of one
    return one.select("visible_records", "eligible_chunks", size(settings.semantic_candidate_multiplier).cast("long").alias("semantic_candidates"), size(settings.lexical_candidate_multiplier).cast("long").alias("lexical_candidates"), "reranked_candidates")


def candidate_counts(records: DataFrame, chunks: DataFrame, request: Request, settings: Settings, as_of: datetime) -> DataFrame:
    return counts_of(of_request(records, chunks, request, settings, as_of), records, request, settings, as_of)


def retrieve_batch(records: DataFrame, chunks: DataFrame, texts: DataFrame, request: Request, settings: Settings, as_of: datetime) -> DataFrame:
    """The best chunks for each row of texts (query_id, query_text), which share the filters of request.

    Requests are read in blocks of BATCH; each block is one pass over the chunks."""
    asking = texts.select("query_id", F.trim("query_text").alias("t")).where("t <> ''")
    blocks, out = max(1, -(-asking.count() // BATCH)), None
    for block in range(blocks):
        mine = asking.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()  # BATCH, about
        queries = [(r["query_id"], q) for r, q in zip(mine, analyse([r["t"] for r in mine], settings), strict=True) if q.tokens]
        part = scan(records, chunks, queries, request, settings, as_of) if queries else records.sparkSession.createDataFrame([], FOUND)
        out = part if out is None else out.union(part)
    return finished(out, records, chunks, request, settings, as_of)


#: Rows in a block of vectors and in a block of queries; a task holds one of each and the product of both numbers.
VECTORS, ASKING = 4096, 1024


def cosine_top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, vec_id, cosine, rank): for each row of vectors (vec_id, embedding) with is_query its k best other rows.

    Vectors of unit length are asked for: a cosine is their inner product, not below 0, ranked as rounded to six digits,
    ties to the smaller vec_id. It is 0 between vectors of different lengths, empty or null ones, and where it is no
    number. Blocks of queries meet blocks of all rows; each pair of blocks sends on its k best a query."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    asking = rows.where("asks")
    n_all, n_asking = max(1, -(-rows.count() // VECTORS)), max(1, -(-asking.count() // ASKING))

    def blocks(df: DataFrame, name: str, n: int, other: str, n_other: int) -> DataFrame:
        dealt = df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(f"{name}_block")).agg(F.collect_list(F.struct("id", "v")).alias(name))
        return dealt.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def opened(cell) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, lists = cell.values.flatten()
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return ids.to_numpy(), n, np.cumsum(n) - n, lists.flatten().to_numpy(zero_copy_only=False)

    def score(batches):
        for batch in batches:
            for q, c in zip(batch.column(0), batch.column(1), strict=True):
                (qi, qn, qb, qv), (ci, cn, cb, cv) = opened(q), opened(c)
                cosine = np.zeros((len(qi), len(ci)))
                for dims in np.intersect1d(qn, cn):
                    a, b = np.flatnonzero(qn == dims), np.flatnonzero(cn == dims)
                    if dims:
                        at = np.arange(dims)
                        cosine[np.ix_(a, b)] = qv[qb[a][:, None] + at] @ cv[cb[b][:, None] + at].T
                cosine = np.round(np.maximum(0, np.nan_to_num(cosine, nan=0.0)), 6)
                cosine[qi[:, None] == ci[None, :]] = -np.inf
                out = []
                for i in range(len(qi)):
                    can = np.flatnonzero(cosine[i] > -np.inf)
                    if len(can) > k:
                        can = can[cosine[i, can] >= np.partition(cosine[i, can], -k)[-k]]
                    can = can[np.lexsort((ci[can], -cosine[i, can]))[:k]]
                    out.append((np.full(len(can), qi[i]), ci[can], cosine[i, can]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "cosine"])

    pairs = blocks(asking, "q", n_asking, "c", n_all).join(blocks(rows, "c", n_all, "q", n_asking), ["q_block", "c_block"])
    best = pairs.select("q", "c").mapInArrow(score, "query_id long, vec_id long, cosine double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("rank") <= k)

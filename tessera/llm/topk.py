"""Exact top-k search by inner product in three phases with one uniform threshold a query.

Components become integers floor(scale * x). A score is the sum of LISTS local scores, one for each slice of the
components. Candidates are packed into blocks; blocks of queries and of candidates meet in cells of a grid.
Phase 1 gathers, from every block, the k best entries of each local score list of a query, with their whole scores; the
k-th best of what all blocks gathered is a cutoff that no result can be below.
Phase 2 sends every block the cutoffs of its queries: whoever reaches a cutoff has at least one local score of cutoff /
LISTS or more, so the entries of the local lists that reach this uniform threshold are sufficient, and are collected.
Phase 3 resolves the scores that the collected entries lack, unless the norms of the slices rule them out, and the k best
of all blocks are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: Rows in a block of candidates and of queries, and blocks of either in a cell; with the number of components they bound
#: what a task holds.
CANDIDATES, QUERIES, IN_CELL = 8192, 256, 4
#: Local score lists of a query.
LISTS = 4
#: Sums below this are exact as doubles.
EXACT = float(2**53)
LONG = 2**63 - 1

BLOCK = "dims int, block string, uids binary, ids binary, asks binary, data binary"


def blocks_of(rows: int, asking: bool, scale: int):
    """Packs vectors (id, embedding, asks), or the asking vectors of packed blocks, into blocks of at most rows each."""

    def whole(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.floor(np.clip(x * scale, -np.finfo(float).max, np.finfo(float).max))

    def out(part: list[tuple], dims: int, name: str):
        uids, ids, asks, values = (np.concatenate(x) for x in zip(*part, strict=True))
        cells = [pa.array([x], k) for x, k in ((dims, pa.int32()), (name, pa.string()), *((np.ascontiguousarray(v).tobytes(), pa.binary()) for v in (uids, ids, asks, values)))]
        return pa.RecordBatch.from_arrays(cells, [f.split()[0] for f in BLOCK.split(", ")])

    def vectors(batch, first: int):
        ids, lists, asks = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        begin, flat, uids = lists.offsets.to_numpy(), lists.values.to_numpy(), first + np.arange(len(ids))
        lengths = np.diff(begin)
        for dims in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dims)
            yield dims, (uids[at], ids[at], asks[at].astype(bool), whole(flat[begin[at][:, None] + np.arange(dims)].reshape(len(at), dims)))

    def opened_asking(batch, first: int):
        for row in batch.to_pylist():
            uids, ids, asks, values = opened(row)
            yield row["dims"], (uids[asks], ids[asks], asks[asks], values[asks])

    def pack(batches):
        held: dict[int, list] = {}
        here, number, first = TaskContext.get().partitionId(), 0, TaskContext.get().partitionId() << 36
        for batch in batches:
            for dims, part in (opened_asking if asking else vectors)(batch, first):
                for at in range(0, len(part[0]), rows):
                    piece = tuple(x[at : at + rows] for x in part)
                    if sum(len(p[0]) for p in held.get(dims, ())) + len(piece[0]) > rows:
                        yield out(held.pop(dims), dims, f"{here}.{(number := number + 1)}")
                    held.setdefault(dims, []).append(piece)
            first += len(batch)
        for dims, parts in held.items():
            yield out(parts, dims, f"{here}.{(number := number + 1)}")

    return pack


def opened(row: dict) -> tuple[np.ndarray, ...]:
    uids, ids = (np.frombuffer(row[c], np.int64) for c in ("uids", "ids"))
    return uids, ids, np.frombuffer(row["asks"], bool), np.frombuffer(row["data"], np.float64).reshape(len(ids), row["dims"])


def slices(dims: int) -> list[slice]:
    """The components of each local score list."""
    edge = np.linspace(0, dims, min(LISTS, max(1, dims)) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def local_scores(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The local score lists of each row of q for the rows of c: exact, as doubles where no whole score can pass EXACT,
    else as whole numbers of any size, which cost time for the large rows alone."""
    dims = q.shape[1]
    if dims * np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) < EXACT:
        return [q[:, s] @ c[:, s].T for s in slices(dims)]
    whole = lambda v: np.array([[int(x) for x in row] for row in v.tolist()], object).reshape(v.shape)
    q_big, c_big = (np.abs(v).max(1, initial=0.0) >= (EXACT / dims) ** 0.5 for v in (q, c))
    every, out = np.ones(len(c), bool), []
    for s in slices(dims):
        score = np.zeros((len(q), len(c)), object)
        score[np.ix_(~q_big, ~c_big)] = (q[~q_big, s] @ c[~c_big, s].T).astype(np.int64).astype(object)
        for rows, columns in ((q_big, every), (~q_big, c_big)):
            if rows.any() and columns.any():
                score[np.ix_(rows, columns)] = whole(q[rows, s]) @ whole(c[columns, s]).T
        out.append(score)
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    at = np.arange(len(score))
    if len(at) > k:
        at = at[score >= np.partition(score, len(score) - k)[len(score) - k]]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


FOUND = "uid long, query_id long, vec_id long, score decimal(38,0), bound long"


def found(rows: list[tuple]) -> pa.Table:
    """Rows (uid, query_id, vec_id, score): decimals order scores of any size, bound is the score as far as a long goes."""
    clipped = [(u, q, v, max(-(10**38) + 1, min(10**38 - 1, s)), max(-LONG, min(LONG, s))) for u, q, v, s in rows]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*clipped, strict=True) if clipped else [[]] * 5, kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])


def gather(q: tuple, c: tuple, k: int) -> list[tuple]:
    """Phase 1: of each local score list of a query its k best entries, with their whole scores; the k best of those."""
    (qu, qi, _, qv), (cu, ci, _, cv), out = q, c, []
    local = local_scores(qv, cv)
    for i in range(len(qu)):
        others = np.flatnonzero(cu != qu[i])
        at = np.unique(np.concatenate([others[best(x[i, others], ci[others], k)] for x in local]))
        score = sum(x[i, at] for x in local)
        out += [(int(qu[i]), int(qi[i]), int(ci[at[j]]), int(score[j])) for j in best(score, ci[at], k)]
    return out


def resolve(q: tuple, c: tuple, k: int, cutoffs: dict[int, int]) -> list[tuple]:
    """Phases 2 and 3: entries of the local lists that reach the uniform threshold, then their whole scores."""
    (qu, qi, _, qv), (cu, ci, _, cv), out = q, c, []
    parts = slices(qv.shape[1])
    local = local_scores(qv, cv)
    norms = [[np.sqrt((v[:, s].astype(np.float64) ** 2).sum(1)) for s in parts] for v in (qv, cv)]
    for i in range(len(qu)):
        others, cutoff = cu != qu[i], cutoffs.get(int(qu[i]))
        if cutoff is None:  # fewer than k entries in all
            at = np.flatnonzero(others)
            score = sum(x[i, at] for x in local)
        else:
            sufficient = [x[i] * len(parts) >= cutoff for x in local]  # the local score is at least cutoff / LISTS
            at = np.flatnonzero(others & np.any(sufficient, 0))
            known = sum(np.where(f[at], x[i, at], 0) for f, x in zip(sufficient, local, strict=True))
            # what is missing is below the threshold, and below the product of the norms (with slack for rounding)
            most = sum(np.where(f[at], 0.0, np.minimum(cutoff / len(parts), a[i] * b[at])) for f, a, b in zip(sufficient, *norms, strict=True))
            able = known.astype(np.float64) + most + 1 + 1e-9 * (abs(float(cutoff)) + np.abs(known.astype(np.float64))) >= float(cutoff)
            at, known = at[able], known[able]
            score = known + sum(np.where(f[at], 0, x[i, at]) for f, x in zip(sufficient, local, strict=True))
        out += [(int(qu[i]), int(qi[i]), int(ci[at[j]]), int(score[j])) for j in best(score, ci[at], k)]
    return out


def in_cells(queries: DataFrame, candidates: DataFrame, phase) -> DataFrame:
    """phase(block of queries, block of candidates, cutoffs) for each pair of blocks with as many components.

    The grid has as many rows and columns as keep IN_CELL blocks of either side in a cell: the stated query set against
    all rows. A block of one side is sent once for each row or column of the grid."""
    across, down = (max(1, -(-df.count() // IN_CELL)) for df in (candidates, queries))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("y", place(down)).withColumn("x", every(across))
    c = candidates.withColumn("x", place(across)).withColumn("y", every(down))

    def cell(asking: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        asked = [(opened(row), {x["uid"]: int(x["cutoff"]) for x in row.get("cutoffs") or ()}) for row in asking.to_pylist()]
        for batch in rows.to_batches(max_chunksize=1):  # one block of candidates at a time
            for block in map(opened, batch.to_pylist()):
                out += [r for queries, cutoffs in asked for r in phase(queries, block, cutoffs)]
        return found(out)

    return q.groupBy("dims", "x", "y").cogroup(c.groupBy("dims", "x", "y")).applyInArrow(cell, FOUND)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) with is_query its k best other rows.

    Scores are inner products of floor(scale * x) and exact; one that no long holds is given as the largest (smallest)
    long, and ranked as it is up to 38 digits. A component that no double holds when scaled counts as the largest double.
    Ties go to the smaller vec_id. Rows that share a vec_id are rows of their own, as queries and as candidates. Vectors that are null or hold null or non-finite components, and rows without a vec_id, take no part;
    vectors of different lengths are not compared; a query with fewer than k others gets all of them, and none without
    others. Very long vectors make larger blocks, which are held one pair at a time. Other columns are not read; an
    empty table gives an empty result.
    """
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where("vec_id is not null").where(sound).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    candidates = cut(rows.mapInArrow(blocks_of(CANDIDATES, False, scale), BLOCK))
    queries = cut(candidates.mapInArrow(blocks_of(QUERIES, True, scale), BLOCK).where("length(uids) > 0"))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    gathered = ranked(in_cells(queries, candidates, lambda q, c, _: gather(q, c, k)))
    cutoff = gathered.where(F.col("rank") == k).select("uid", F.col("score").alias("cutoff"))

    def named(batches):
        for batch in batches:
            for row in batch.to_pylist():
                uids = np.frombuffer(row["uids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array([row["block"]] * len(uids), pa.string())], ["uid", "block"])

    asked = queries.select("uids", "block").mapInArrow(named, "uid long, block string")
    per_block = cutoff.join(asked, "uid").groupBy("block").agg(F.collect_list(F.struct("uid", "cutoff")).alias("cutoffs"))  # QUERIES at most
    found_ = in_cells(queries.join(per_block, "block", "left"), candidates, lambda q, c, cutoffs: resolve(q, c, k, cutoffs))
    return ranked(found_).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("bound").alias("score"))


def op2_top_k(spark, sf_dir):
    """The five best other vectors of each vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""

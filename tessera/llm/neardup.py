"""Near-duplicate join: documents whose sets of word shingles overlap, by count vectors in R-trees.

The shingles of a set are hashed into groups, the more the larger the set; the counts by group are a point, and the sum
of the smaller coordinates of two points bounds the overlap of their sets (the finer point is folded to the groups of
the coarser). Points meet by their rarest shingles (two sets that link share one of those; only shingles that two sets
share at all move points), an R-tree over the points of a shingle finds the pairs whose bound suffices, and what survives
is verified on whole sets. Documents with equal sets are one class and travel as one; of the pairs that survive only
enough to connect them are kept, so that a group of copies never becomes all its pairs. What they connect is a cluster;
sets of one cluster are verified in blocks, of which each is looked at alone first, then one set of each group that came
out of that, and only groups that are still apart are compared block by block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, drop_cut, join_keyed, may_hold, mix, runs, shards, span_hashes, table

#: Groups of a set at least, shingles a group at most (on average), and how often groups are doubled to stay below.
#: With more shingles a group, unlike sets have such even counts that the bound no longer parts them: with 32 it came out
#: just at 80 %, and clusters of unlike long sets grew with the corpus, to be verified in the square of their blocks.
GROUPS, PER, LEVELS = 32, 12, 7
LIMITS = np.array([PER * GROUPS << k for k in range(LEVELS - 1)], np.int64)
#: Buckets of shingle hashes whose counts order shingles by rarity: a fixed size, whatever the number of documents.
RARITY_BITS, CHUNKS = 18, 16
#: Members and shingles of a block that is verified at once, points in a node of an R-tree, coordinates compared at once.
BLOCK, BLOCK_SHINGLES, NODE, AT_ONCE = 8192, 1 << 21, 32, 1 << 22
FULL = 255  # a coordinate that stands for any count from here on

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of size words; of the whole sequence if it has fewer words."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    starts, ends = runs(~_SPACE[data])
    if not len(starts):
        return np.zeros(0, np.uint64)
    word, n = span_hashes(data, starts, ends), max(1, len(starts) - size + 1)
    take = min(size, len(starts))
    h = np.full(n, take, np.uint64)
    for i in range(take):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + word[i : i + n])
    return np.unique(h)


def levels(sizes: np.ndarray) -> np.ndarray:
    """How often the groups of sets of these sizes are doubled."""
    return np.searchsorted(LIMITS, sizes)


def group_counts(found: np.ndarray) -> np.ndarray:
    groups = GROUPS << int(levels(np.array([len(found)]))[0])
    return np.minimum(np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups), FULL).astype(np.uint8)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points of more groups as points of fewer: groups that share their low bits are added up."""
    return np.minimum(points.reshape(len(points), -1, groups).sum(1, dtype=np.int64), FULL).astype(np.uint8)


def rarity(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    """How many of a set's rarest shingles must be looked at: a set that links shares one of its own first so many."""
    return n - -(-percent * n // 100) + 1


def enough(overlap, total, percent: int):
    """Whether sets of total elements together that share overlap link: overlap / (total - overlap) >= percent / 100."""
    return overlap * (100 + percent) >= percent * total


def blob(x, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def count_rarity(docs: DataFrame, size: int) -> np.ndarray:
    """How often the shingles of each rarity bucket occur, over all documents (once a document)."""

    def count(batches):
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, rarity(shingles(text, size)), 1)
        yield pa.record_batch([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in total.reshape(CHUNKS, -1)], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(counts, np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    kind, total = "chunk int, counts binary", np.zeros((CHUNKS, (1 << RARITY_BITS) // CHUNKS), np.int64)
    texts = docs.select(F.col("text").cast("binary").alias("text")).where("text is not null")
    for row in texts.mapInArrow(count, kind).repartition(CHUNKS, "chunk").mapInArrow(add, kind).collect():
        total[row["chunk"]] += np.frombuffer(row["counts"], np.int64)
    return total.ravel()


SKETCH = "doc_id long, n int, set_hash binary, point binary, prefix binary"


def sketches(docs: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """Size, hash, count vector and rarest shingles of each document's set."""
    ranks = docs.sparkSession.sparkContext.broadcast(common)  # of fixed size: 2 ** RARITY_BITS counts

    def sketch(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = shingles(text or b"", size)
                n = len(found)
                if not n:
                    out.append((0, None, None, None))
                    continue
                first = np.lexsort((found, ranks.value[rarity(found)]))[: prefix_size(n, percent)]
                out.append((n, hashlib.blake2b(found.tobytes(), digest_size=16).digest(), group_counts(found).tobytes(), found[first].tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n", "set_hash", "point", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(sketch, SKETCH)


# --- R-tree over count vectors -------------------------------------------------------------------------------------


class Forest:
    """Sets of numbers 0 to n - 1 that union by union become one."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            r = self.up[x]
            if (self.up[r] == r).all():
                return r
            self.up[x] = self.up[r]

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Places in a and b of the pairs that connected something."""
        kept = []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            while self.up[x] != x:
                self.up[x] = self.up[self.up[x]]
                x = self.up[x]
            while self.up[y] != y:
                self.up[y] = self.up[self.up[y]]
                y = self.up[y]
            if x != y:
                self.up[max(x, y)] = min(x, y)
                kept.append(i)
        return kept


def may_link(a_hi: np.ndarray, b_hi: np.ndarray, a_n: tuple, b_n: tuple, percent: int) -> np.ndarray:
    """Whether anything in boxes with these upper corners and ranges (low, high) of sizes could link."""
    least = np.minimum(a_hi, b_hi)
    overlap = least.sum(1, dtype=np.int64) + (least == FULL).any(1) * (1 << 40)
    overlap = np.minimum(overlap, np.minimum(a_n[1], b_n[1]))
    sizes = (a_n[1] * 100 >= percent * b_n[0]) & (b_n[1] * 100 >= percent * a_n[0])
    return sizes & enough(overlap, a_n[0] + b_n[0], percent)


def tree_pairs(points: np.ndarray, sizes: np.ndarray, percent: int, forest: Forest, ids: np.ndarray):
    """Pairs of places whose bound lets them link and that connect something new in forest, from an R-tree joined with itself.

    The tree is packed bottom up from points in the order of size and coordinates. Neighbours in that order are tried
    first; node pairs whose members are connected already are not opened.
    """
    order = np.lexsort((*points[:, :GROUPS].T[::-1], sizes))
    points, sizes, ids = points[order], sizes[order], ids[order]
    near = np.flatnonzero(may_link(points[:-1], points[1:], (sizes[:-1],) * 2, (sizes[1:],) * 2, percent))
    for i in forest.join(ids[near], ids[near + 1]):
        yield order[near[i]], order[near[i] + 1]
    levels = [(points, sizes, sizes)]
    while len(levels[-1][0]) > 1:
        hi, low_n, high_n = levels[-1]
        at = np.arange(0, len(hi), NODE)
        levels.append((np.maximum.reduceat(hi, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)))
    a = b = np.zeros(1, np.int64)
    for level in range(len(levels) - 2, -1, -1):
        hi, low_n, high_n = levels[level]
        span = NODE**level  # points below a node of this level
        root = forest.roots(ids)
        at = np.arange(0, len(ids), span)
        low_root, high_root = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
        keep_a, keep_b = [], []
        portion = max(1, AT_ONCE // (NODE * NODE * points.shape[1]))
        for part in range(0, len(a), portion):  # node pairs are opened in bounded portions
            x, y = (np.repeat(v[part : part + portion], NODE * NODE) * NODE for v in (a, b))
            x, y = x + np.tile(np.repeat(np.arange(NODE), NODE), len(x) // NODE**2), y + np.tile(np.arange(NODE), len(y) // NODE)
            ok = (x <= y if level else x < y) & (x < len(hi)) & (y < len(hi))
            x, y = x[ok], y[ok]
            ok = ~((low_root[x] == high_root[x]) & (low_root[y] == high_root[y]) & (low_root[x] == low_root[y]))
            x, y = x[ok], y[ok]
            ok = may_link(hi[x], hi[y], (low_n[x], high_n[x]), (low_n[y], high_n[y]), percent)
            x, y = x[ok], y[ok]
            if level:
                keep_a.append(x)
                keep_b.append(y)
            else:
                for i in forest.join(ids[x], ids[y]):
                    yield order[x[i]], order[y[i]]
        if level:
            a, b = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (keep_a, keep_b))


# --- candidates ----------------------------------------------------------------------------------------------------

SENT = "bucket int, docs binary, owners binary, tokens binary"
SHARED = "part int, bucket int, docs binary, counts binary, tokens binary"
LINKS = "a long, b long"


def send_prefixes(buckets: int):
    """Rarest shingles to the bucket of each: of a batch of sets one row a bucket."""

    def send(batches):
        for batch in batches:
            docs, tokens = batch.column(0).to_numpy(), [np.frombuffer(p, np.uint64) for p in batch.column(1).to_pylist()]
            every = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            of = np.repeat(np.arange(len(docs)), [len(t) for t in tokens])
            bucket = (every % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            bucket, of, low, rows = bucket[by], of[by], (every[by] >> np.uint64(32)).astype(np.uint32), []
            edge = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                sent, owner = np.unique(of[s:e], return_inverse=True)
                rows.append((int(bucket[s]), blob(docs[sent], np.int64), blob(owner, np.uint32), low[s:e].tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["bucket", "docs", "owners", "tokens"])

    return send


def spread(low: np.ndarray, times: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... as often as times[i] says, one after the other."""
    return np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())


def shared_tokens(parts: int):
    """For the sets of a bucket the shingles that another set of the bucket holds too: a row for each part of the sets."""

    def shared(group: pa.Table) -> pa.Table:
        docs, owners, tokens = (np.concatenate([np.frombuffer(x, k) for x in group.column(c).to_pylist()]) for c, k in (("docs", np.int64), ("owners", np.uint32), ("tokens", np.uint32)))
        sent, held = ([len(x) // n for x in group.column(c).to_pylist()] for c, n in (("docs", 8), ("owners", 4)))
        owners = owners.astype(np.int64) + np.repeat(np.cumsum(sent) - sent, held)
        order = np.argsort(tokens, kind="stable")
        low = tokens[order]
        new = np.concatenate(([True], low[1:] != low[:-1]))
        kept = order[~(new & np.append(new[1:], True))]
        kept = kept[np.lexsort((owners[kept], docs[owners[kept]] % parts))]
        whose, first, counts = np.unique(owners[kept], return_index=True, return_counts=True)
        by = np.argsort(first)
        whose, first, counts = whose[by], first[by], counts[by]
        part, rows, bucket = docs[whose] % parts, [], group.column("bucket")[0].as_py()
        edge = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            mine = kept[first[s] : first[e - 1] + counts[e - 1]]
            rows.append((int(part[s]), bucket, blob(docs[whose[s:e]], np.int64), blob(counts[s:e], np.uint32), blob(tokens[mine], np.uint32)))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 3)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=[f.split()[0] for f in SHARED.split(", ")])

    return shared


POINTS = "bucket int, docs binary, sizes binary, points binary, counts binary, tokens binary"
#: Counts take four of eight bits when coded by how often they occur.
CODEC = "zstd"


def unpacked(points: bytes, sizes: np.ndarray) -> bytes:
    """The points of sets of these sizes as send_points() sent them."""
    return pa.decompress(points, int((GROUPS << levels(sizes)).sum()), CODEC, asbytes=True)


def send_points(sets: pa.Table, shared: pa.Table) -> pa.Table:
    """Points of a part of the sets (rep, n, point) with their shared shingles to the buckets, a row a bucket."""
    order = np.argsort(sets.column("rep").to_numpy(), kind="stable")
    reps, sizes, points = sets.column("rep").to_numpy()[order], sets.column("n").to_numpy()[order], sets.column("point").to_pylist()
    points, rows = [points[i] for i in order.tolist()], []
    for r in shared.to_pylist():
        docs, counts, tokens = (np.frombuffer(r[c], k) for c, k in (("docs", np.int64), ("counts", np.uint32), ("tokens", np.uint32)))
        counts = counts.astype(np.int64)
        low = np.searchsorted(reps, docs)
        times = np.searchsorted(reps, docs, "right") - low  # several where a doc_id has several sets
        at, of = spread(low, times), np.repeat(np.arange(len(docs)), times)
        held = tokens[spread((np.cumsum(counts) - counts)[of], counts[of])]
        rows.append((r["bucket"], blob(reps[at], np.int64), blob(sizes[at], np.int32), pa.compress(b"".join(points[i] for i in at.tolist()), CODEC, asbytes=True), blob(counts[of], np.uint32), blob(held, np.uint32)))
    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=[f.split()[0] for f in POINTS.split(", ")])


def link_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


class Points:
    """Points of several levels, by level: of each level its own and those of larger sets, folded, that may link with them."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray, percent: int):
        self.level, self.row, self.matrix = levels(sizes), {}, {}
        begins = np.cumsum(GROUPS << self.level) - (GROUPS << self.level)
        for level in np.unique(self.level).tolist():
            groups, parts, row = GROUPS << level, [], np.full(len(sizes), -1)
            near = self.level == level
            if level < LEVELS - 1:
                near |= (self.level > level) & (sizes * percent <= 100 * LIMITS[level])
            for other in np.unique(self.level[near]).tolist():
                at = np.flatnonzero(near & (self.level == other))
                row[at] = sum(map(len, parts)) + np.arange(len(at))
                parts.append(folded(flat[begins[at][:, None] + np.arange(GROUPS << other)], groups))
            self.row[level], self.matrix[level] = row, np.concatenate(parts)

    def by_level(self, lowest: np.ndarray, *sides: np.ndarray):
        """(level, places) of those whose lowest level is the same and that have a point of it on all sides."""
        for level in np.unique(lowest).tolist():
            at = np.flatnonzero((lowest == level) & np.all([self.row[level][x] >= 0 for x in sides], 0))
            if len(at):
                yield level, at

    def at(self, level: int, x: np.ndarray) -> np.ndarray:
        return self.matrix[level][self.row[level][x]]


def candidates(percent: int):
    def find(group: pa.Table) -> pa.Table:
        docs, sizes, counts, tokens = (np.frombuffer(b"".join(group.column(c).to_pylist()), k) for c, k in (("docs", np.int64), ("sizes", np.int32), ("counts", np.uint32), ("tokens", np.uint32)))
        packed = zip(group.column("points").to_pylist(), group.column("sizes").to_pylist(), strict=True)
        flat = np.frombuffer(b"".join(unpacked(p, np.frombuffer(n, np.int32)) for p, n in packed), np.uint8)
        owners = np.repeat(np.arange(len(docs)), counts)
        order, sizes = np.argsort(tokens, kind="stable"), sizes.astype(np.int64)
        tokens, owners = tokens[order], owners[order]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(tokens)) + 1, [len(tokens)]))
        names, ids = np.unique(docs, return_inverse=True)
        forest, out, points = Forest(len(names)), [], Points(sizes, flat, percent)
        size = np.diff(edge)
        for many in range(2, 9):  # small groups: all their pairs at once, group size by group size
            at = edge[:-1][size == many]
            for i in range(many):
                for j in range(i + 1, many):
                    a, b = owners[at + i], owners[at + j]
                    new = forest.roots(ids[a]) != forest.roots(ids[b])
                    a, b = a[new], b[new]
                    for level, k in points.by_level(np.minimum(points.level[a], points.level[b]), a, b):
                        for k in np.array_split(k, 1 + len(k) * (GROUPS << level) // AT_ONCE):
                            x, y = a[k], b[k]
                            ok = may_link(points.at(level, x), points.at(level, y), (sizes[x],) * 2, (sizes[y],) * 2, percent)
                            x, y = x[ok], y[ok]
                            out += [(int(docs[x[n]]), int(docs[y[n]])) for n in forest.join(ids[x], ids[y])]
        for s, e in zip(edge[:-1][size > 8].tolist(), edge[1:][size > 8].tolist(), strict=True):
            every = owners[s:e]
            for level in np.unique(points.level[every]).tolist():
                rows = every[points.row[level][every] >= 0]
                if len(rows) > 1:
                    out += [(int(docs[rows[x]]), int(docs[rows[y]])) for x, y in tree_pairs(points.at(level, rows), sizes[rows], percent, forest, ids[rows])]
        return link_table(out)

    return find


# --- verification --------------------------------------------------------------------------------------------------


def verify(percent: int):
    def check(group: pa.Table) -> pa.Table:
        """Links between members of one pair of blocks, as many as connect what links; each pair once, on whole sets.
        Members of one group (known) are connected already.

        Overlaps are counted a member at a time: shingles that a quarter of the members hold as a product of matrices,
        the others along their lists of holders."""
        docs, side, known = (group.column(c).to_numpy() for c in ("doc_id", "side", "known"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in group.column("found").chunks for x in chunk]  # views
        order = sorted(range(len(sets)), key=lambda i: (docs[i], len(sets[i])))
        docs, side, known, sets = docs[order], side[order], known[order], [sets[i] for i in order]
        sizes = np.array([len(s) for s in sets], np.int64)
        begins = np.cumsum(sizes) - sizes
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        often = np.flatnonzero(times * 4 > len(sets))
        column = np.full(len(times), -1)
        column[often] = np.arange(len(often))
        usual = column[token] >= 0
        holds = np.zeros((len(sets), len(often)), np.float32)
        holds[owner[usual], column[token[usual]]] = 1
        holders, ends = owner[np.argsort(token, kind="stable")], np.cumsum(times)
        forest, out, both, tile, product = Forest(len(sets)), [], side.max() > 0, -1, None
        by = np.argsort(known, kind="stable")
        same = np.flatnonzero(known[by[1:]] == known[by[:-1]])
        forest.join(by[same], by[same + 1])
        for i in range(len(sets)):
            other = np.flatnonzero(side != side[i]) if both else np.arange(i + 1, len(sets))
            if both and side[i] or not len(other):
                continue
            other = other[(sizes[i] * 100 >= percent * sizes[other]) & (sizes[other] * 100 >= percent * sizes[i])]
            other = other[forest.roots(other) != forest.roots(np.array([i]))[0]]
            if not len(other):
                continue
            if i // 64 != tile:
                tile = i // 64
                product = holds[tile * 64 : tile * 64 + 64] @ holds.T
            rare = token[begins[i] : begins[i] + sizes[i]]
            rare = rare[(column[rare] < 0) & (times[rare] > 1)]
            n = times[rare]
            listed = holders[np.repeat(ends[rare] - np.cumsum(n), n) + np.arange(n.sum())]
            overlap = product[i - tile * 64][other].astype(np.int64) + np.bincount(listed, minlength=len(sets))[other]
            linked = other[enough(overlap, sizes[i] + sizes[other], percent)]
            here = np.full(len(linked), i)
            out += [(int(docs[i]), int(docs[linked[k]])) for k in forest.join(here, linked) if docs[i] != docs[linked[k]]]
        return link_table(out)

    return check


def in_blocks(clusters: DataFrame) -> DataFrame:
    """clusters (id, component, tokens, ...) with blocks and block: about BLOCK members or BLOCK_SHINGLES shingles each."""
    most = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("tokens") / BLOCK_SHINGLES)
    size = clusters.groupBy("component").agg(F.ceil(most).cast("int").alias("blocks"), F.count(F.lit(1)).alias("times"))
    return join_keyed(clusters, size, "component", clusters.count()).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


PLACE = "component", "block", "blocks", "known"


def linked(at: DataFrame, across: bool, percent: int) -> DataFrame:
    """Links (a, b) inside the blocks of sets (doc_id, found, component, block, blocks, known), or across each pair of blocks."""
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))) if across else F.col("block")
    at = at.select("doc_id", "found", "component", "block", "known", other.alias("beside"))
    side = F.when(F.col("block") > F.col("beside"), 1).otherwise(0).alias("side")
    at = at.select("doc_id", "found", "component", "known", F.least("block", "beside").alias("x"), F.greatest("block", "beside").alias("y"), side)
    return at.groupBy("component", "x", "y").applyInArrow(verify(percent), LINKS)


def apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """members of several blocks whose cluster is not yet one group by links, with the group in known."""
    found = components(links).select(F.col("id").alias("i"), F.col("component").alias("group"))
    now = members.join(found, F.col("id") == F.col("i"), "left").withColumn("known", F.coalesce("group", "id")).drop("i", "group")
    open_ = now.groupBy("component").agg(F.min("known").alias("lo"), F.max("known").alias("hi"), F.count(F.lit(1)).alias("times")).where("lo <> hi").select("component", "times")
    return cut(join_keyed(now, open_, "component", members.count()))


def verified_links(docs: DataFrame, clusters: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what links among the documents of each cluster (id, component, tokens).

    No task holds more than two blocks. Clusters of one block are done after it; of larger ones, one member of each group
    that the blocks gave is compared next, so that a large group of copies needs no pair of blocks; groups of one cluster
    that are still apart are compared in all pairs of its blocks."""
    members = cut(in_blocks(clusters).withColumn("known", F.col("id")))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).where(may_hold(members.select("id"))(F.col("doc_id").cast("long")))
    with_text = texts.join(members.select("id", *PLACE).hint("merge"), F.col("doc_id") == F.col("id"))

    def sets_of(batches):
        for batch in batches:
            found = [shingles(t or b"", size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]], ["doc_id", "found", *PLACE])

    sets = with_text.select("doc_id", "text", *PLACE).mapInArrow(sets_of, "doc_id long, found binary, component long, block int, blocks int, known long").where("length(found) > 0")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return cut(linked(sets, False, percent))
    sets = cut(sets)
    links = cut(linked(sets, False, percent))
    of = lambda rows: sets.select("doc_id", "found").join(rows.select(F.col("id").alias("doc_id"), *PLACE), "doc_id")
    rest = apart(large, links)
    of_group = rest.groupBy("component", "known").agg(F.min("id").alias("id")).join(rest.select("id", "tokens"), "id")
    few = cut(in_blocks(of_group.select("id", "component", "tokens", "known")))
    links = cut(links.union(linked(of(few), False, percent)))
    links = cut(links.union(linked(of(apart(rest, links)), True, percent)))
    drop_cut(sets)
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text): documents that links connect.

    Words are runs of other than ASCII white space with A to Z lower-cased; a set has the distinct shingles of size
    words, or the whole sequence if there are fewer, and is empty without words or text. Two documents link when their
    sets are not empty and 100 * intersection >= percent * union; component_id is the smallest doc_id that links reach.
    Documents without shingles link with nothing. A very long text is one set, held at once. Rows that share a doc_id count as one document with several sets; rows
    without a doc_id link with nothing and have a null component_id. Other columns are not read; an empty table gives an
    empty result.
    """
    whole = cut(sketches(docs, size, percent, count_rarity(docs, size)))
    classes = whole.where("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("prefix").alias("prefix"))
    classes = cut(classes)
    known = cut(whole.select("doc_id", "n", "set_hash"))
    drop_cut(whole)
    real = known.where("doc_id is not null and n > 0")
    total = known.where("n > 0").count()
    sent = classes.where("rep is not null").select("rep", "prefix").mapInArrow(send_prefixes(shards(docs.sparkSession)), SENT)
    parts = shards(docs.sparkSession)
    shared = sent.groupBy("bucket").applyInArrow(shared_tokens(parts), SHARED)
    points = classes.where("rep is not null").select(F.pmod("rep", F.lit(parts)).cast("int").alias("part"), "rep", "n", "point")
    met = points.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(send_points, POINTS)
    maybe = components(met.groupBy("bucket").applyInArrow(candidates(percent), LINKS))
    maybe = cut(maybe.join(real.groupBy("doc_id").agg(F.sum("n").alias("tokens")), F.col("id") == F.col("doc_id")).drop("doc_id"))
    whole, classes = classes, cut(classes.select("set_hash", "rep", "times"))
    drop_cut(whole)
    links = verified_links(docs.where("doc_id is not null"), maybe, size, percent)
    repeated = real.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where("lo <> hi").select("doc_id")
    bridges = real.join(repeated, "doc_id").select("set_hash", "doc_id").join(classes.select("set_hash", "rep"), "set_hash")
    found = components(links.union(bridges.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    by_set = classes.select("set_hash", "rep", "times").join(found, F.col("rep") == F.col("id"), "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"), "times")
    out = join_keyed(known.where("n > 0").select("doc_id", "n", "set_hash"), by_set, "set_hash", total)
    own = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return own.union(known.where("n = 0").select("doc_id", F.lit(0).cast("long"), "doc_id"))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that stand for their component: those whose doc_id is
    its smallest, and rows without a doc_id. Of rows that share the doc_id all stay."""
    found = near_duplicates(docs.select("doc_id", "text"), size, percent)
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    packed, held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id")), may_hold(gone)(F.col("id").cast("long"))
    rest = packed.where(held).join(gone.hint("merge"), F.col("id") == F.col("gone"), "left_anti")  # the others stay where they are
    return packed.where(~held).select("row").union(rest.select("row")).select("row.*")


def op8_near_duplicates(spark, sf_dir):
    """Size of its set and component of each document, with four words and a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM g), t AS (SELECT doc_id, unnest(s) AS t FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(c) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
"""

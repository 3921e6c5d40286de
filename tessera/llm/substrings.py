"""Exact substring deduplication with suffix arrays.

Every byte string of LENGTH bytes that two documents share must be found, over all documents, without comparing every
shard with every other. Anchors make that possible: in each window the smallest hash of ANCHOR bytes is selected, so
that equal windows select the same place. Shards send their anchors to merge shards, which find by binary search those
that several documents hold; around these alone the shards cut contexts (all windows through an anchor) and send
each different context once. A merge shard builds the suffix array of its contexts by Larsson-Sadakane refinement and
the common prefixes by Kasai's method, runs of prefixes of LENGTH bytes or more give the smallest doc_id that holds a
window, and the shards remove what a smaller doc_id holds.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, mix, prefix_hashes, runs, table

LENGTH, ANCHOR = 50, 24
REACH = LENGTH - ANCHOR  # bytes of context on either side of an anchor
WIDTH = REACH + 1  # anchors in a window, and windows through an anchor
NONE = np.iinfo(np.int64).max
#: Bytes of text in a shard: what a task holds at once is one of them.
SHARD_BYTES = 10 << 20


# --- suffix arrays -------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of text in the order of the suffixes that begin there.

    The first pass sorts by eight bytes. Each further pass doubles the sorted length: a place is ordered by its group
    and the group of the place behind the sorted length, and only groups of more than one place are sorted again.
    """
    n = len(text)
    ahead = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | ahead[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    group = np.zeros(n + 1, np.int64)  # by place: where its group begins; behind the text comes the smallest
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    group[order], group[n] = first + 1, 0
    h = 8
    while True:
        last = np.append(new[1:], True)
        open_ = np.flatnonzero(~(new & last))  # members of groups of several
        if not len(open_):
            break
        places = order[open_]
        pair = group[places] * (n + 2) + group[np.minimum(places + h, n)]
        by = np.argsort(pair)
        places, pair = places[by], pair[by]
        order[open_] = places
        split = np.ones(len(open_), bool)
        split[1:] = pair[1:] != pair[:-1]
        new[open_] = split
        group[places] = np.maximum.accumulate(np.where(split, open_, 0)) + 1
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For each place of a suffix array how many bytes, most at most, that its suffix shares with the one before it.

    Kasai's method: the prefix of the next place in the text is one byte shorter at worst. The stretches begins:ends of
    the text are walked side by side, one place of each in a step."""
    n = len(order)
    rank, out = np.empty(n, np.int64), np.zeros(n, np.int64)
    rank[order] = np.arange(n)
    ahead = np.concatenate([text, np.zeros(most + 1, np.uint8)])
    longest = np.argsort(begins - ends, kind="stable")  # longest stretches first, so that those still walked lead
    begins, sizes = begins[longest], (ends - begins)[longest]
    shared = np.zeros(len(begins), np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, "left"))
        at = begins[:live] + step
        above = rank[at] > 0
        other = order[np.maximum(rank[at] - 1, 0)]
        s = np.where(above, np.maximum(shared[:live] - 1, 0), 0)
        grow = np.flatnonzero(above)
        while len(grow):
            a, b = at[grow] + s[grow], other[grow] + s[grow]
            grow = grow[(s[grow] < most) & (a < n) & (b < n) & (ahead[a] == ahead[b])]
            s[grow] += 1
        out[rank[at]], shared[:live] = s, s
    return out


# --- anchors and contexts ------------------------------------------------------------------------------------------


def extreme(x: np.ndarray, pick) -> np.ndarray:
    """pick (minimum or maximum) of every WIDTH neighbours."""
    have = 1
    while have * 2 <= WIDTH:
        x, have = pick(x[:-have], x[have:]), have * 2
    return pick(x[: len(x) - (WIDTH - have)], x[WIDTH - have :]) if have < WIDTH else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text; every window of LENGTH bytes holds one, and equal windows the same."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, down = prefix_hashes(data)
    h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(data) - ANCHOR + 1])
    pad = np.zeros(WIDTH - 1, np.uint64)
    at = np.flatnonzero(extreme(np.concatenate([pad, extreme(h, np.minimum), pad]), np.maximum) == h)
    return at, h[at]


def located(h: np.ndarray, buckets: int) -> np.ndarray:
    """Merge shard (upper half) and 32 bits of an anchor's hash; unlike anchors that agree only cost a context."""
    return ((h % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32))


class Shard:
    """The documents of a shard in the order of doc_id and text, which is the same each time it is read."""

    def __init__(self, packed: pa.Table):
        opened, rows = zstandard.ZstdDecompressor(), []
        for blob in packed.column("blob").to_pylist():
            with pa.ipc.open_stream(opened.decompress(blob)) as stream:
                for batch in stream:
                    rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or b""))
        self.ids, self.texts = [r[0] for r in rows], [r[1] or b"" for r in rows]

    def anchors(self):
        """(number of the document, places, hashes) for each document with a doc_id that can hold a window."""
        for i, (doc, text) in enumerate(zip(self.ids, self.texts, strict=True)):
            if doc is not None and len(text) >= LENGTH:
                yield i, *anchors(np.frombuffer(text, np.uint8))

    def contexts(self, common: np.ndarray, buckets: int):
        """Different contexts around common anchors: bytes, places of the anchor in them, merge shards; and for each
        occurrence the context's number, the document and the place."""
        known: dict = defaultdict(count().__next__)
        context, bucket, document, place = [], [], [], []
        for i, at, h in self.anchors():
            where = located(h, buckets)
            spot = np.minimum(np.searchsorted(common, where), max(0, len(common) - 1))
            chosen = common[spot] == where if len(common) else np.zeros(len(at), bool)
            at, where = at[chosen], where[chosen]
            if len(at):
                text, begin = self.texts[i], np.maximum(0, at - REACH)
                cuts = [text[b:e] for b, e in zip(begin.tolist(), (at + LENGTH).tolist(), strict=True)]
                for k in range(int(np.searchsorted(at, REACH))):
                    cuts[k] = cuts[k], int(at[k])  # the anchor stands elsewhere than in other contexts
                context.append(np.fromiter(map(known.__getitem__, cuts), np.int64, len(cuts)))
                bucket.append((where >> np.uint64(32)).astype(np.int64))
                document.append(np.full(len(at), i))
                place.append(begin)
        context, bucket, document, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (context, bucket, document, place))
        _, first = np.unique(context, return_index=True)
        texts = [k[0] if isinstance(k, tuple) else k for k in known]
        inside = np.array([k[1] if isinstance(k, tuple) else REACH for k in known], np.uint8)
        return texts, inside, bucket[first], context, document, place


PACKED = "shard int, blob binary"
MERGE = "bucket int, shard int, a binary, b binary, c binary, d binary"
REPLY = "shard int, kind int, a binary, b binary, c binary"


def blob(x, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def slices(keys: np.ndarray):
    """(key, begin, end) for the runs of equal values in sorted keys."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(keys)], strict=True):
        if b > a:
            yield int(keys[a]), a, b


def as_table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], names=[f for f, _ in fields])


def pack_shards(docs: DataFrame, parts: int) -> DataFrame:
    """Documents as compressed blobs by shard, a hash of doc_id and text; a shard is one part of the data that a task holds."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
        for batch in batches:
            shard = batch.column(2).to_numpy()
            by, out = np.argsort(shard, kind="stable"), []
            dealt = batch.take(pa.array(by))
            for s, a, b in slices(shard[by]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema) as stream:
                    stream.write_batch(pa.record_batch([dealt.column(0).slice(a, b - a), dealt.column(1).slice(a, b - a)], schema=schema))
                out.append((s, press.compress(sink.getvalue().to_pybytes())))
            yield from as_table(out, PACKED).to_batches()

    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), shard.alias("shard")).mapInArrow(pack, PACKED)


def send_anchors(buckets: int):
    def send(group: pa.Table) -> pa.Table:
        seen = [np.unique(located(h, buckets)) for _, _, h in Shard(group).anchors()]
        keys, times = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0))
        shard, out = group.column("shard")[0].as_py(), []
        for b, s, e in slices((keys >> np.uint64(32)).astype(np.int64)):
            low, more = keys[s:e].astype(np.uint32), times[s:e] > 1
            out.append((b, shard, blob(low[~more], np.uint32), blob(low[more], np.uint32), None, None))
        return as_table(out, MERGE)

    return send


def merge_anchors(group: pa.Table) -> pa.Table:
    """Sends back to each shard those of its anchors that two documents or more hold: all runs are merged and searched."""
    rows, bucket = group.to_pylist(), group.column("bucket")[0].as_py()
    once, more = ([np.frombuffer(r[c], np.uint32) for r in rows] for c in "ab")
    keys = np.sort(np.concatenate([*once, *more, *more]))  # those of several documents in one shard count twice
    common = np.unique(keys[1:][keys[1:] == keys[:-1]])
    out = []
    for r, x, y in zip(rows, once, more, strict=True):
        spot = np.minimum(np.searchsorted(common, x), max(0, len(common) - 1))
        mine = np.sort(np.concatenate([x[common[spot] == x] if len(common) else x[:0], y]))
        if len(mine):
            out.append((r["shard"], 0, blob(mine, np.uint32), blob([bucket], np.int64), None))
    return as_table(out, REPLY)


def common_of(replies: list[dict]) -> np.ndarray:
    parts = [np.frombuffer(r["a"], np.uint32).astype(np.uint64) | (np.frombuffer(r["b"], np.int64).astype(np.uint64) << np.uint64(32)) for r in replies if r["kind"] == 0]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def send_contexts(buckets: int):
    def send(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(group) or not len(replies):
            return as_table([], MERGE)
        shard = Shard(group)
        texts, inside, bucket, context, document, _ = shard.contexts(common_of(replies.to_pylist()), buckets)
        ids = np.array([i if i is not None else NONE for i in shard.ids], np.int64)
        low, high = np.full(len(texts), NONE), np.full(len(texts), np.iinfo(np.int64).min)
        np.minimum.at(low, context, ids[document])
        np.maximum.at(high, context, ids[document])
        by, out, press = np.argsort(bucket, kind="stable"), [], zstandard.ZstdCompressor(level=1)
        for b, s, e in slices(bucket[by]):
            mine = by[s:e]
            # number, smallest doc_id, whether another document here holds it too, anchors' places and bytes
            out.append((b, group.column("shard")[0].as_py(), blob(mine, np.uint32), blob(low[mine], np.int64), blob(low[mine] < high[mine], np.uint8), press.compress(pack_bytes([texts[i] for i in mine.tolist()], inside[mine]))))
        return as_table(out, MERGE)

    return send


def pack_bytes(texts: list[bytes], inside: np.ndarray) -> bytes:
    return blob(inside, np.uint8) + blob([len(t) for t in texts], np.uint8) + b"".join(texts)


def merge_contexts(group: pa.Table) -> pa.Table:
    """For every window of every context the smallest doc_id that holds it, sent to the shards as runs of windows.

    Equal windows stand in contexts with the same anchor. Where all contexts of an anchor are one and the same, their
    windows are too; the others go into the suffix array."""
    rows, opened = group.to_pylist(), zstandard.ZstdDecompressor()
    number, low, more = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in zip("abc", (np.uint32, np.int64, np.uint8), strict=True))
    counts = np.array([len(r["a"]) // 4 for r in rows])
    origin = np.repeat([r["shard"] for r in rows], counts)
    known: dict[tuple[bytes, int], int] = defaultdict(count().__next__)
    which: list[int] = []
    for r, n in zip(rows, counts.tolist(), strict=True):
        data, at = opened.decompress(r["d"]), 2 * n
        for place, size in zip(data[:n], data[n : 2 * n], strict=True):
            which.append(known[data[at : at + size], place])
            at += size
    context, texts, anchor = np.array(which, np.int64), [t for t, _ in known], [t[p : p + ANCHOR] for t, p in known]
    sizes = np.array([len(t) for t in texts], np.int64)
    smallest, holders = np.full(len(texts), NONE), np.bincount(context, 1 + more, len(texts))
    np.minimum.at(smallest, context, low)
    grid = np.where(np.arange(WIDTH) + LENGTH <= sizes[:, None], smallest[:, None], NONE)
    shown = (grid < NONE) & (holders > 1)[:, None]
    times = Counter(anchor)
    several = np.flatnonzero(np.array([times[a] > 1 for a in anchor]))
    if len(several):
        best, held = merged_windows([texts[c] for c in several.tolist()], smallest[several], holders[several])
        grid[several], shown[several] = best, held > 1
    flat, on = grid.ravel(), shown.ravel()
    edge = np.ones(len(flat), bool)
    edge[1:] = (flat[1:] != flat[:-1]) | (on[1:] != on[:-1])
    edge[::WIDTH] = True
    starts = np.flatnonzero(edge)
    stops = np.append(starts[1:], len(flat))
    keep = on[starts]
    starts, stops = starts[keep], stops[keep]
    c, a, b, doc = starts // WIDTH, starts % WIDTH, (stops - 1) % WIDTH + 1, flat[starts]
    per = np.searchsorted(c, np.arange(len(texts) + 1))  # runs of a context
    times = (per[1:] - per[:-1])[context]
    sent = np.repeat(np.arange(len(context)), times)
    run = np.arange(len(sent)) - np.repeat(np.cumsum(times) - times, times) + per[context[sent]]
    by = np.argsort(origin[sent], kind="stable")
    sent, run, out = sent[by], run[by], []
    for s, x, y in slices(origin[sent]):
        out.append((s, 1, blob(number[sent[x:y]], np.uint32), blob(doc[run[x:y]], np.int64), blob(np.stack([a[run[x:y]], b[run[x:y]]]), np.uint8)))
    return as_table(out, REPLY)


def merged_windows(texts: list[bytes], smallest: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of each text the smallest doc_id of the texts that hold them, and their holders; by a suffix array."""
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    order = suffix_array(text)
    shared = common_prefixes(text, order, begins, begins + sizes, LENGTH)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(text)) - begins[owner]
    whole = offset + LENGTH <= sizes[owner]  # windows that end inside their context
    valid = np.flatnonzero(whole[order])
    least = np.minimum.reduceat(shared[: valid[-1] + 1], np.concatenate(([0], valid[:-1] + 1)))  # over what stands between
    first = np.ones(len(valid), bool)
    first[1:] = least[1:] < LENGTH
    heads, of = np.flatnonzero(first), np.cumsum(first) - 1
    place = order[valid]
    best = np.minimum.reduceat(smallest[owner[place]], heads)
    held = np.add.reduceat(holders[owner[place]], heads)
    grid, seen = np.full((len(texts), WIDTH), NONE), np.zeros((len(texts), WIDTH), np.int64)
    grid[owner[place], offset[place]], seen[owner[place], offset[place]] = best[of], held[of]
    return grid, seen


def remove_windows(buckets: int, with_text: bool):
    def remove(group: pa.Table, replies: pa.Table) -> pa.Table:
        schema = REMOVED + ", kept binary" * with_text
        if not len(group):
            return as_table([], schema)
        shard, answers = Shard(group), replies.to_pylist()
        sizes = np.array([len(t) for t in shard.texts], np.int64)
        base = np.concatenate(([0], np.cumsum(sizes)))
        edge = np.zeros(base[-1] + 1, np.int32)
        if any(r["kind"] == 1 for r in answers):
            texts, _, _, context, document, place = shard.contexts(common_of(answers), buckets)
            ids = np.array([i if i is not None else -NONE for i in shard.ids], np.int64)
            by = np.argsort(context, kind="stable")
            per = np.searchsorted(context[by], np.arange(len(texts) + 1))
            for r in (r for r in answers if r["kind"] == 1):
                number, doc = np.frombuffer(r["a"], np.uint32).astype(np.int64), np.frombuffer(r["b"], np.int64)
                a, b = np.frombuffer(r["c"], np.uint8).astype(np.int64).reshape(2, -1)
                times = per[number + 1] - per[number]
                run = np.repeat(np.arange(len(number)), times)
                hit = by[np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times) + per[number[run]]]
                later = ids[document[hit]] > doc[run]
                run, hit = run[later], hit[later]
                start = base[document[hit]] + place[hit]
                np.add.at(edge, start + a[run], 1)
                np.add.at(edge, start + b[run] - 1 + LENGTH, -1)
        gone, out = np.cumsum(edge[:-1]) > 0, []
        for i, (doc, text) in enumerate(zip(shard.ids, shard.texts, strict=True)):
            mask = gone[base[i] : base[i + 1]]
            n = int(mask.sum())
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if n else text
            out.append((doc, len(text), n, len(runs(mask)[0]) if n else 0, hashlib.sha256(kept).hexdigest(), kept)[: 5 + with_text])
        return as_table(out, schema)

    return remove


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row of docs (doc_id, text), read as UTF-8 bytes.

    Removed is every byte that a LENGTH-byte string covers which also starts in a document with a smaller doc_id. Null
    texts are empty; repeated rows and rows with one doc_id don't count against each other and give a row each; rows
    without a doc_id keep all their bytes and take none from others. A very long text is held as a whole in its shard,
    which grows by it. Other columns are not read; an empty table gives an empty result. Shards have about SHARD_BYTES
    of text each, so their number grows with the data, and with nothing else.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // SHARD_BYTES))
    packed = lambda: pack_shards(docs, parts).groupBy("shard")
    common = cut(packed().applyInArrow(send_anchors(parts), MERGE).groupBy("bucket").applyInArrow(merge_anchors, REPLY))
    sent = packed().cogroup(common.groupBy("shard")).applyInArrow(send_contexts(parts), MERGE)
    replies = cut(sent.groupBy("bucket").applyInArrow(merge_contexts, REPLY))
    return packed().cogroup(common.union(replies).groupBy("shard")).applyInArrow(remove_windows(parts, with_text), REMOVED + ", kept binary" * with_text)


def op5_substring_dedup(spark, sf_dir):
    """Bytes of each document, how many and how many runs of them go, and the hash of what is left."""
    return remove_repeats(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS p FROM d WHERE length(h) >= 100)),
m AS (SELECT s, min(doc_id) AS least, max(doc_id) AS most FROM w GROUP BY s),
g AS (SELECT DISTINCT r, p + k AS p FROM (SELECT r, p, unnest(range(0, 50)) AS k FROM w JOIN m USING (s) WHERE doc_id > least)),
f AS (SELECT r, count(*) AS n_removed, count(*) FILTER (WHERE new) AS n_spans FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) IS DISTINCT FROM p - 1 AS new FROM g) GROUP BY r),
b AS (SELECT d.r, x.p, substr(h, 2 * x.p + 1, 2) AS c FROM d JOIN f USING (r), LATERAL (SELECT unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS p) x),
k AS (SELECT b.r, string_agg(c, '' ORDER BY b.p) AS h FROM b LEFT JOIN g ON b.r = g.r AND b.p = g.p WHERE g.p IS NULL GROUP BY b.r)
SELECT doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN f.r IS NULL THEN d.h ELSE coalesce(k.h, '') END)) AS kept_sha256
FROM d LEFT JOIN f ON d.r = f.r LEFT JOIN k ON d.r = k.r
"""

"""Benchmark decontamination: suffix arrays over the training text, searched by every suffix of the benchmark.

A shard is a run of documents of one task. Its suffix array holds every word position of the shard in the order of the
words that follow, as far as a window is long; one sort by the first words is refined where they agree. Every suffix of a
benchmark item that holds a window is looked up by two binary searches, which give all its places in the shard; windows
that follow each other in both texts make up the longest verbatim matches. Documents are then judged, or removed.
The benchmark is read in blocks of bounded size, one pass over the documents each: the driver, a plan and a task hold one
block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, runs, span_hashes, table

WINDOW = 10
#: Words in a shard, bytes of benchmark text in a block, and pairs of places that are held at once.
SHARD_WORDS, BLOCK_BYTES, PAIRS = 1 << 20, 2 << 20, 1 << 22

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Text:
    """Texts as words: lower-cased bytes, where words start and end, a hash of each, and the text that each is in."""

    def __init__(self, texts: list[bytes]):
        self.data = _LOWER[np.frombuffer(b"\0".join(texts), np.uint8)]
        self.starts, self.ends = runs(_WORD[self.data])
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.owner = np.searchsorted(np.cumsum(sizes), self.starts, "right")
        self.counts = np.bincount(self.owner, minlength=len(texts))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


class Windows:
    """The windows of a block of benchmark items. Equal windows are one, with the items and offsets that they stand at."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.ids = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.ids)}
        self.item = np.array([number[i] for i, _ in items], np.int64)  # of a row, the number of its id
        text = Text([t for _, t in items])
        self.vocabulary, first, at = np.unique(text.hashes, return_index=True, return_inverse=True)
        self.words = [text.word(i) for i in first.tolist()]
        begin = np.concatenate(([0], np.cumsum(text.counts)))
        length = np.minimum(WINDOW, text.counts)
        row = np.repeat(np.arange(len(items)), np.where(length > 0, text.counts - length + 1, 0))
        offset = np.arange(len(row)) - np.searchsorted(row, row)
        place = begin[row][:, None] + offset[:, None] + np.arange(WINDOW)
        within = np.arange(WINDOW) < length[row][:, None]
        table_ = np.where(within, np.append(at, 0)[np.minimum(place, len(at))], -1)
        self.table, self.of = np.unique(table_, axis=0, return_inverse=True) if len(row) else (table_, np.zeros(0, np.int64))
        self.of = self.of.reshape(-1)
        self.lengths = (self.table >= 0).sum(1)
        by = np.argsort(self.of, kind="stable")  # of each window: from edge[w] to edge[w + 1] the rows and offsets that hold it
        self.rows, self.offsets = row[by], offset[by]
        self.edge = np.searchsorted(self.of[by], np.arange(len(self.table) + 1))


def packed(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Word numbers of WINDOW columns, as many to a key as fit: keys that sort as the words do."""
    per = 63 // bits
    keys = []
    for first in range(0, WINDOW, per):
        part = columns[first : first + per]
        key = np.zeros(len(part[0]), np.int64)
        for c in part:
            key = (key << bits) | c
        keys.append(key)
    return keys


def suffix_array(words: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """All positions of words in the order of the WINDOW words that follow, and their keys in that order.

    The first key sorts; positions that agree in it, and only those, are sorted by the keys behind it."""
    ahead = np.concatenate([words, np.zeros(WINDOW, np.int64)])
    keys = packed([ahead[i : i + len(words)] for i in range(WINDOW)], bits)
    order = np.argsort(keys[0], kind="stable")
    first = keys[0][order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = first[1:] == first[:-1]
    tied = np.flatnonzero(same[:-1] | same[1:])  # in a group of several
    if len(tied) and len(keys) > 1:
        at = order[tied]
        order[tied] = at[np.lexsort([k[at] for k in keys[::-1]])]
    return order, [k[order] for k in keys]


def bisect(keys: list[np.ndarray], want: list[np.ndarray], after: bool) -> np.ndarray:
    """For each wanted row the first place in the sorted keys that isn't below it (after: that is above it)."""
    lo, hi = np.zeros(len(want[0]), np.int64), np.full(len(want[0]), len(keys[0]), np.int64)
    while (active := lo < hi).any():
        mid = np.where(active, (lo + hi) // 2, 0)
        below, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for k, w in zip(keys, want, strict=True):
            here = k[mid]
            below |= same & (here < w)
            same &= here == w
        below |= same & after
        lo, hi = np.where(active & below, mid + 1, lo), np.where(active & ~below, mid, hi)
    return lo


def spread(low: np.ndarray, times: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... as often as times[i] says, one after the other."""
    return np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())


class Shard:
    """Words of some documents, their suffix array, and where windows stand in it."""

    def __init__(self, texts: list[bytes], windows: Windows):
        self.windows, self.text = windows, Text(texts)
        self.unlike = np.zeros(len(self.text.hashes), bool)  # words whose hash alone is a benchmark word's
        while True:
            self.search()
            wrong = self.wrong_words()
            if not len(wrong):
                break
            self.unlike[wrong] = True

    def search(self) -> None:
        w, text = self.windows, self.text
        known, number = np.unique(text.hashes, return_inverse=True)
        bits = int(len(known) + 1).bit_length()
        number = np.where(self.unlike, 0, number + 1)
        place = np.arange(len(number)) + text.owner  # a zero between documents, which matches nothing
        words = np.zeros(len(number) + len(text.counts), np.int64)
        words[place] = number
        self.word_at = np.zeros(len(words), np.int64)  # back from places to words
        self.word_at[place] = np.arange(len(number))
        order, keys = suffix_array(words, bits)
        at = np.minimum(np.searchsorted(known, w.vocabulary), max(0, len(known) - 1))
        mine = np.where(known[at] == w.vocabulary, at + 1, -1) if len(known) else np.full(len(w.vocabulary), -1)
        mine = np.append(mine, 0)  # the last stands for what is behind a short window
        wanted = mine[w.table]
        asked = np.flatnonzero((wanted >= 0).all(1))  # the others hold a word that the shard doesn't have
        low = wanted[asked]
        high = np.where(w.table[asked] < 0, (1 << bits) - 1, low)
        lo, hi = bisect(keys, packed(list(low.T), bits), False), bisect(keys, packed(list(high.T), bits), True)
        self.found, times = asked, hi - lo
        self.window = np.repeat(asked, times)
        self.place = self.word_at[order[spread(lo, times)]]

    def wrong_words(self) -> np.ndarray:
        """Words in found windows whose bytes are not those of the benchmark's word."""
        size = self.windows.lengths[self.window]
        at, word = spread(self.place, size), self.windows.table[np.repeat(self.window, size), spread(np.zeros(len(size), np.int64), size)]
        at, first = np.unique(at, return_index=True)
        word = word[first]
        lengths = np.array([len(x) for x in self.windows.words], np.int64)
        begins = np.cumsum(lengths) - lengths
        want = np.frombuffer(b"".join(self.windows.words), np.uint8)
        n = self.text.ends[at] - self.text.starts[at]
        wrong = n != lengths[word] if len(word) else np.zeros(0, bool)
        good = np.flatnonzero(~wrong)
        differs = self.text.data[spread(self.text.starts[at[good]], n[good])] != want[spread(begins[word[good]], n[good])]
        wrong[np.repeat(good, n[good])[differs]] = True
        return at[wrong]

    def hit(self) -> np.ndarray:
        edge = np.zeros(len(self.text.hashes) + 1, np.int64)
        np.add.at(edge, self.place, 1)
        np.add.at(edge, self.place + self.windows.lengths[self.window], -1)
        return np.cumsum(edge[:-1]) > 0

    def hit_documents(self) -> np.ndarray:
        return np.unique(self.text.owner[self.place])

    def matches(self) -> list[tuple]:
        """For each document: words, hit runs (start, end, start, end, ...), found item ids, and its longest verbatim match
        with one item: words, place in the document, item id, place in the item; of equal ones the first by place, id, place."""
        w, text = self.windows, self.text
        counts, begin = text.counts.tolist(), (np.cumsum(text.counts) - text.counts).tolist()
        out: list[tuple] = [(n, [], [], 0, None, None, None) for n in counts]
        if not len(self.place):
            return out
        order = np.argsort(self.place, kind="stable")
        place, window = self.place[order], self.window[order]
        doc, hit = text.owner[place], self.hit()
        times = w.edge[window + 1] - w.edge[window]
        total = np.cumsum(times)
        start = 0
        while start < len(place):  # whole documents, of about PAIRS pairs of places in document and item
            stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")), start + 1)
            stop = int(np.searchsorted(doc, doc[stop - 1], "right"))
            n = times[start:stop]
            p, d, at = (np.repeat(x[start:stop], n) for x in (place, doc, w.lengths[window]))
            of = spread(w.edge[window[start:stop]], n)
            row, offset = w.rows[of], w.offsets[of]
            by = np.lexsort((p, p - offset, row, d))
            p, d, row, offset, at = p[by], d[by], row[by], offset[by], at[by]
            new = np.ones(len(p), bool)
            new[1:] = (d[1:] != d[:-1]) | (row[1:] != row[:-1]) | (p[1:] - offset[1:] != p[:-1] - offset[:-1]) | (p[1:] != p[:-1] + 1)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(p))) - 1 + at[first]
            item = w.item[row[first]]
            best = np.lexsort((offset[first], item, p[first], -size, d[first]))
            best = best[np.concatenate(([True], np.diff(d[first][best]) > 0))]
            pairs = np.unique(d[first] * len(w.ids) + item)
            items: dict[int, list[str]] = {}
            for x in pairs.tolist():
                items.setdefault(x // len(w.ids), []).append(w.ids[x % len(w.ids)])
            for b in best.tolist():
                i = int(d[first[b]])
                a = begin[i]
                out[i] = (counts[i], np.stack(runs(hit[a : a + counts[i]]), 1).ravel().tolist(), items[i], int(size[b]), int(p[first[b]]) - a, w.ids[item[b]], int(offset[first[b]]))
            start = stop
        return out


def shards_of(texts: list[bytes]):
    """Cuts a list into runs of about SHARD_WORDS words; a very long text is a shard of its own."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) // 4 < SHARD_WORDS):
            size += len(texts[stop]) // 4 + 1
            stop += 1
        yield start, stop
        start = stop


def blocks_of(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Items with a text, and in how many blocks of about BLOCK_BYTES they are read."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = benchmark.select(item.alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, max(1, -(-total // BLOCK_BYTES))


def windows_of(items: DataFrame, blocks: int, block: int) -> Windows:
    rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # BLOCK_BYTES, about, or one item
    return Windows(sorted((r["item_id"], bytes(r["text"])) for r in rows))


FOUND = "n_words long, runs array<int>, items array<string>, longest long, longest_at long, longest_item string, longest_from long"
KINDS = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.int64())
NAMES = [f.split()[0] for f in FOUND.split(", ")]


def pass_over(docs: DataFrame, windows: Windows, hits_only: bool) -> DataFrame:
    """(doc_id, th, what FOUND names) for rows (doc_id, text binary, th): all, or those that hold a window of the block."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)  # a block: BLOCK_BYTES of text, about, or one item

    def search(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for start, stop in shards_of(texts):
                shard = Shard(texts[start:stop], sent.value)
                found = shard.matches()
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), KINDS, strict=True))], ["doc_id", "th", *NAMES])
                yield out.filter(pa.array([bool(f[1]) for f in found])) if hits_only else out

    return docs.mapInArrow(search, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, {FOUND}")


def joined(passes: DataFrame) -> DataFrame:
    """One row (d, t, what FOUND names but n_words) for the passes of a document: runs and items together, the longest match of all."""
    first = F.array_sort(F.collect_list(F.struct((-F.col("longest")).alias("less"), "longest_at", "longest_item", "longest_from")))[0]
    one = passes.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), first.alias("f"))

    def merge(batches):
        for batch in batches:
            out = []
            for cells in batch.column(2).to_pylist():
                pairs = np.array(cells, np.int64).reshape(-1, 2)
                low, high = pairs[np.argsort(pairs[:, 0], kind="stable")].T
                reach = np.maximum.accumulate(high)
                new = np.flatnonzero(np.concatenate(([True], low[1:] > reach[:-1])))
                out.append(np.stack((low[new], np.append(reach[new[1:] - 1], reach[-1])), 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int32())), *batch.columns[3:]], batch.schema.names)

    slim = one.select("d", "t", "runs", "items", (-F.col("f.less")).alias("longest"), "f.longest_at", "f.longest_item", "f.longest_from")
    return slim.mapInArrow(merge, slim.schema)


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, items, longest, longest_at, longest_item, longest_from) for each row of docs (doc_id, text):
    what of benchmark (item_id, text) it holds.

    runs lists start and end of each maximal run of hit words, items the found item ids as strings. longest has the words
    of the longest verbatim match with one item, longest_at the word of the document at which it begins, longest_from the
    word of the item longest_item (0 and nulls without a hit). Null and empty texts have no words; a very long text is a
    shard of its own, held as a whole; an item without words has no window, and a very long item is a block of its own;
    rows of one item id count as one item, each with its own windows, and a null id reads as ''. Repeated rows give a row
    each; other columns aren't read. With an empty benchmark nothing is hit; an empty table gives an empty result.
    """
    items, blocks = blocks_of(benchmark)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th"))
    first = pass_over(rows, windows_of(items, blocks, 0), False)
    if blocks == 1:
        return first.drop("th")
    first = cut(first)
    passes = first.where("size(runs) > 0").dropDuplicates(["doc_id", "th"])
    for block in range(1, blocks):
        passes = passes.union(cut(pass_over(rows, windows_of(items, blocks, block), True).dropDuplicates(["doc_id", "th"])))
    both = first.select("doc_id", "th", "n_words").join(joined(passes), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    none = {"runs": F.expr("cast(array() as array<int>)"), "items": F.expr("cast(array() as array<string>)"), "longest": F.lit(0).cast("long")}
    return both.select("doc_id", "n_words", *(F.coalesce(c, none[c]).alias(c) if c in none else c for c in NAMES[1:]))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, whose text holds no window of the benchmark.

    Each row is judged by its own text. With a benchmark of one block it is judged in the pass that reads it, and nothing
    is shuffled; with more, rows found by any pass are taken out by doc_id and text. Null and empty texts are kept; very
    long texts and items are treated as in find_passages()."""
    items, blocks = blocks_of(benchmark)
    at = docs.columns.index("text")
    if blocks == 1:
        sent = docs.sparkSession.sparkContext.broadcast(windows_of(items, 1, 0))  # BLOCK_BYTES of text, about

        def keep(batches):
            for batch in batches:
                texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
                clean = np.ones(len(texts), bool)
                for start, stop in shards_of(texts):
                    clean[start + Shard(texts[start:stop], sent.value).hit_documents()] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(keep, docs.schema)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th"))
    hits = None
    for block in range(blocks):
        found = cut(pass_over(rows, windows_of(items, blocks, block), True).select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct())
        hits = found if hits is None else hits.union(found)
    packed_ = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    return packed_.join(hits.hint("merge"), F.col("id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_anti").select("row.*")


def op3_decontaminate(spark, sf_dir):
    """What of the benchmark each document holds: words, hit words, items and the longest verbatim match with its places."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size("runs")), F.lit(0).cast("long"), lambda s, i: s + F.element_at("runs", i) * F.when(i % 2 == 0, 1).otherwise(-1))
    n_hit = F.when(F.size("runs") == 0, F.lit(0)).otherwise(n_hit).cast("long")
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"), *NAMES[3:])


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT k, item, p AS o, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS t
       FROM (SELECT k, item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS t
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, p, dw.n, k, item, o FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
h AS (SELECT r, count(DISTINCT p + j) AS n_hit FROM (SELECT r, p, unnest(range(0, n)) AS j FROM m) GROUP BY r),
f AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
c AS (SELECT *, p - row_number() OVER (PARTITION BY r, k, p - o ORDER BY p) AS g FROM m),
v AS (SELECT r, item, count(*) + max(n) - 1 AS longest, min(p) - 1 AS longest_at, min(o) - 1 AS longest_from FROM c GROUP BY r, k, item, p - o, g),
l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY r ORDER BY longest DESC, longest_at, item, longest_from) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest, longest_at, l.item AS longest_item, longest_from
FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r) LEFT JOIN l USING (r)
"""

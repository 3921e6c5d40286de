"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of insult lexicons, closeness of lexicon words to second-person words, and rates of capitals,
punctuation and obfuscation. One lexicon is fixed; the others (words, word beginnings) are those whose presence speaks
for the label among the labelled rows that the fit may use. Words are counted and features computed where the rows are;
what reaches the driver are the counts of words that speak for the label and one row of numbers a labelled row, from
which it grows the trees and calibrates them. Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut, table

# A general lexicon, second-person words and the characters that stand for letters.
INSULTS = "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash scum clown clowns imbecile fool jerk creep garbage filth hate kill ugly shut".split()
SECOND_PERSON = set("you your yours yourself you're ur u du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted tus vosotros".split())
UNMASKED = str.maketrans("013457@$!|", "oieastasil")
NAMES = ("fixed", "fixed_any", "words", "words_any", "word_weight", "starts", "starts_any", "start_weight", "near_you", "capitals", "capital_words", "punctuation", "marks", "masked", "masked_hits", "digits_inside", "length")
TOKEN = re.compile(r"[^\W_]+(?:[*@$!|'’][^\W_]+)*")
MASKED = re.compile(r"[^\W\d_][0-9*@$!|]+[^\W\d_]")
NEAR = 5
#: Labelled rows, and bytes of their texts, that a fit reads at most (in expectation: rows are drawn by a hash of the id).
FIT_ROWS, FIT_BYTES = 6_000, 64 << 20
#: Toxic rows that a lexicon entry is in at least; below that its weight says nothing.
LEAST_ROWS = 5
#: Cells of labelled rows: two folds for calibration by two halves for lexicons. Distinct words a task counts at once.
CELLS, AT_ONCE = 4, 100_000
#: Tokens that a worker remembers the lexicon entries of.
KNOWN = 200_000
START = (5, 7)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


class Lexicons:
    """Words and word beginnings with the weight (log-odds of presence) that the labelled rows of some cells give them."""

    def __init__(self, seen: list[tuple], rows: list[list[int]], cells: tuple[int, ...]):
        """seen: (list, entry, rows with it by cell and label), rows: all rows by cell and label."""
        n = [sum(rows[c][y] for c in cells) for y in (0, 1)]
        self.words, self.starts = {}, {}
        for which, entry, counts in seen:
            k = [sum(counts[2 * c + y] for c in cells) for y in (0, 1)]
            weight, least = odds(k, n)
            if k[1] >= LEAST_ROWS and least > math.log(2):
                (self.starts if which else self.words)[entry] = weight
        self.known: dict[str, tuple] = {}

    def about(self, token: str) -> tuple[bool, bool, float, float]:
        """Whether a lower-case token hides letters, whether it is in the fixed lexicon, and its weights as word and by its beginning."""
        plain = token if token.isalpha() else token.translate(UNMASKED).replace("*", "").replace("'", "")
        start = max((self.starts.get(plain[:k], 0.0) for k in START if len(plain) > k), default=0.0)
        return plain != token, plain in FIXED, self.words.get(plain, 0.0), start

    def features(self, text: str) -> list[float]:
        raw, low, known = tokens(text), tokens(text.lower()), self.known
        hits, fixed, words, starts, hidden, top_word, top_start = [], 0, 0, 0, 0, 0.0, 0.0
        for i, t in enumerate(low):
            a = known.get(t)
            if a is None:
                if len(known) > KNOWN:
                    known.clear()
                a = known[t] = self.about(t)
            if a[1] or a[2] or a[3]:
                hits.append(i)
                fixed, words, starts, hidden = fixed + a[1], words + (a[2] > 0), starts + (a[3] > 0), hidden + (a[0] and (a[1] or a[2] > 0))
                top_word, top_start = max(top_word, a[2]), max(top_start, a[3])
        you = [i for i, t in enumerate(low) if t in SECOND_PERSON] if hits else []
        near, j = 0, 0
        for i in hits:
            while j < len(you) and you[j] < i - NEAR:
                j += 1
            near += j < len(you) and you[j] <= i + NEAR
        n, data = max(1, len(low)), text.encode("utf-8", "replace")
        chars = max(1, len(text))
        per = lambda x: 100.0 * x / n
        marks = data.count(b"!") + data.count(b"?")
        return [
            per(fixed), float(fixed), per(words), float(words), top_word, per(starts), float(starts), top_start, per(near),
            (len(data) - len(data.translate(None, CAPITALS))) / chars, sum(len(t) > 1 and t.isupper() for t in raw) / n, (marks + sum(map(data.count, b".,;:"))) / chars, per(marks),
            per(len(MASKED.findall(text))), float(hidden), (len(INSIDE.findall(text))) / n, math.log1p(len(low)),
        ]


def odds(k: list[int], n: list[int]) -> tuple[float, float]:
    """How much more an entry in k[1] of n[1] toxic and k[0] of n[0] other rows speaks for toxicity, and what it surely does."""
    weight = math.log((k[1] + 0.5) / (max(1, n[1]) + 1)) - math.log((k[0] + 0.5) / (max(1, n[0]) + 1))
    return weight, weight - 2 * math.sqrt(1 / (k[1] + 0.5) + 1 / (k[0] + 0.5))


FIXED = {*INSULTS, *(w + "s" for w in INSULTS)}
CAPITALS = bytes(range(65, 91))
INSIDE = re.compile(r"[^\W\d_]\d+|\d+[^\W\d_]")


class Trees:
    """Gradient-boosted regression trees for the logistic loss, grown on quantile bins of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, least: int = 10, bins: int = 32):
        self.edges = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
        b = self.binned(x)
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base, self.rate, self.trees = math.log(share / (1 - share)), rate, []
        raw = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            tree, add = self.grow(b, y - p, p * (1 - p), depth, least)
            self.trees.append(tree)
            raw += rate * add

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, f, "right") for e, f in zip(self.edges, x.T, strict=True)], 1)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int):
        tree, add, todo = [], np.zeros(len(g)), [(np.arange(len(g)), 0, None)]
        while todo:
            rows, level, parent = todo.pop()
            if parent:
                tree[parent[0]][parent[1]] = len(tree)
            split, total_g, total_h = None, g[rows].sum(), h[rows].sum()
            gain = 1e-6
            for f in range(b.shape[1] if level < depth and len(rows) >= 2 * least else 0):
                size = len(self.edges[f]) + 1
                if size < 2:
                    continue
                n, sg, sh = (np.cumsum(np.bincount(b[rows, f], w, size))[:-1] for w in (None, g[rows], h[rows]))
                score = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                score[(n < least) | (len(rows) - n < least)] = -1
                if len(score) and score.max() > gain:
                    gain, split = float(score.max()), (f, int(score.argmax()))
            value = float(total_g / (total_h + 1))
            tree.append([*(split or (-1, 0)), value, -1, -1])
            if split:
                left = b[rows, split[0]] <= split[1]
                todo += [(rows[~left], level + 1, (len(tree) - 1, 4)), (rows[left], level + 1, (len(tree) - 1, 3))]
            else:
                add[rows] = value
        return np.array(tree), add

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := tree[at, 0] >= 0).any():
                f, edge = tree[at, 0].astype(np.int64), tree[at, 1]
                go = np.where(b[np.arange(len(x)), f] <= edge, tree[at, 3], tree[at, 4]).astype(np.int64)
                at = np.where(inner, go, at)
            out += self.rate * tree[at, 2]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on score (pool adjacent violators), for linear interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, _, hi = blocks.pop()
            v1, n1, lo, _ = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, lo, hi])
    x, p = np.array([e for b in blocks for e in b[2:]]), np.repeat([b[0] for b in blocks], 2)
    keep = np.concatenate(([True], np.diff(x) > 0))
    return x[keep], p[keep]


class Model:
    """Lexicons, trees and calibration (knots)."""

    def __init__(self, lexicons: Lexicons | None, trees: Trees | None, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicons, self.trees, self.knots = lexicons, trees, knots

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.knots[1][0])
        raw = self.trees.raw(np.array([self.lexicons.features(t) for t in texts]).reshape(-1, len(NAMES)))
        spread = 1e-4 / (1 + np.exp(-raw))  # keeps the order of scores inside a calibrated step
        return np.clip(np.interp(raw, *self.knots) + spread, 0.0, 1.0)


def labelled(docs: DataFrame, labels: DataFrame, rows: int, size: int) -> DataFrame:
    """(doc_id string, text, toxic, cell) of the labelled rows that a fit reads."""
    usable = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = usable.count()
    share = min(1.0, rows / max(1, n))
    drawn = lambda part: F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = cut(texts.join(usable.where(drawn(share)), "doc_id"))
    total = got.agg(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0
    got = got.where(drawn(share * size / total)) if total > size else got
    cell = F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")) % CELLS
    return got.select(F.col("doc_id").cast("string"), "text", "toxic", cell.cast("int").alias("cell"))


def presence(rows: DataFrame, all_rows: list[list[int]], subsets: set[tuple[int, ...]]) -> list[tuple]:
    """(list, entry, rows with it by cell and label) of the words (list 0) and word beginnings (1) that the lexicon of one
    of subsets (of cells) holds; the others stay on the executors."""

    def count(batches):
        def out(seen):
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.string()), pa.array([k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["which", "entry", "place", "n"])

        seen: dict[tuple, int] = {}
        for batch in batches:
            for text, y, cell in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                low, place = set(tokens(text.lower())), 2 * cell + y
                for which, found in ((0, low), (1, {w[:n] for w in low for n in START if len(w) > n})):
                    for w in found:
                        seen[which, w, place] = seen.get((which, w, place), 0) + 1
                if len(seen) > AT_ONCE:
                    yield out(seen)
                    seen = {}
        yield out(seen)

    parts = rows.select("text", "toxic", "cell").mapInArrow(count, "which int, entry string, place int, n long")
    sums = [F.sum(F.when(F.col("place") == p, F.col("n")).otherwise(0)).alias(f"n{p}") for p in range(2 * CELLS)]
    holds = F.lit(False)
    for cells in subsets:
        n = [max(1, sum(all_rows[c][y] for c in cells)) for y in (0, 1)]
        k = [sum((F.col(f"n{2 * c + y}") for c in cells), F.lit(0)) for y in (0, 1)]
        weight = F.log((k[1] + 0.5) / (n[1] + 1)) - F.log((k[0] + 0.5) / (n[0] + 1))
        # a hair looser than odds(), which decides on the driver
        holds = holds | ((k[1] >= LEAST_ROWS) & (weight - 2 * F.sqrt(1 / (k[1] + 0.5) + 1 / (k[0] + 0.5)) > math.log(2) - 1e-6))
    kept = parts.groupBy("which", "entry").agg(*sums).where(holds)
    return sorted((r[0], r[1], tuple(r[2:])) for r in kept.collect())


def described(rows: DataFrame, lexicons: dict[tuple[int, ...], Lexicons], views: list[tuple]) -> tuple[np.ndarray, ...]:
    """Cells, labels and features of rows, one block of features for each view: the cells whose lexicon describes a cell's rows."""

    def describe(batches):
        for batch in batches:
            texts, y, cells = (batch.column(i).to_pylist() for i in (1, 2, 3))
            x = [np.array([lexicons[view[c]].features(t) for view in views]).tobytes() for t, c in zip(texts, cells, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(x, pa.binary())], ["doc_id", "toxic", "cell", "x"])

    got = rows.mapInArrow(describe, "doc_id string, toxic int, cell int, x binary").collect()  # a few hundred bytes a row of the sample
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(len(got), len(views), len(NAMES))
    return np.array([r["cell"] for r in got], np.int64), np.array([r["toxic"] for r in got], np.int64), x


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """A model of labels (doc_id, toxic) on docs (doc_id, text), from rows whose crc32(doc_id as text) mod 5 is not 0.

    About rows labelled rows with texts of size bytes at most are read, chosen by a hash of the id; no text reaches the
    driver. A doc_id with several rows or labels counts with the largest label. Null texts are empty, null labels are
    left out. Without labels, or with labels of one kind, every text gets their mean (0 without any).

    Trees learn from rows whose own words did not choose the lexicon that describes them: rows in even cells are described
    by the lexicon of odd ones, and the other way round. Calibration is fitted on scores of a fold whose rows neither
    lexicon nor trees have seen.
    """
    sample = labelled(docs, labels, rows, size)
    all_rows = [[0, 0] for _ in range(CELLS)]
    for r in sample.groupBy("cell", "toxic").count().collect():
        all_rows[r["cell"]][r["toxic"]] = r["count"]
    n = [sum(r[y] for r in all_rows) for y in (0, 1)]
    if not all(n):
        return Model(None, None, (np.zeros(1), np.full(1, float(bool(n[1])))))
    every = tuple(range(CELLS))
    folds = [tuple(c for c in every if c // 2 == k) for k in range(CELLS // 2)]
    rest = [tuple(c for c in every if c not in f) for f in folds]
    halves = lambda cells: [tuple(c for c in cells if c % 2 != h) for h in (0, 1)]  # the lexicon's cells for even and odd rows
    subsets = {every, *halves(every)}.union(*({r, *halves(r)} for r in rest))
    seen = presence(sample, all_rows, subsets)
    lexicons = {cells: Lexicons(seen, all_rows, cells) for cells in subsets}
    views = [{c: halves(every)[c % 2] for c in every}]
    for f, r in zip(folds, rest, strict=True):  # the fold itself by what the rest says, the rest by its other half
        views.append({c: r if c in f else halves(r)[c % 2] for c in every})
    cell, y, x = described(sample, lexicons, views)
    drop_cut(sample)
    score = np.zeros(len(y))
    for k, f in enumerate(folds):
        unseen = np.isin(cell, f)
        if unseen.any() and not unseen.all():
            score[unseen] = Trees(x[~unseen, k + 1], y[~unseen]).raw(x[unseen, k + 1])
    knots, p = isotonic(score, y)
    return Model(lexicons[every], Trees(x[:, 0], y), (knots, np.clip(p, 0.001, 0.999)))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text), in one pass. Null texts are scored as empty ones, repeated
    rows alike, and a very long text as a whole, its tokens held at once; other columns are not read, and an empty table
    gives an empty result."""

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score([t or "" for t in batch.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, whose score is below least; a pass without a shuffle."""
    at = docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            score = model.score([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(score < least))

    return docs.mapInArrow(kept, docs.schema)


def op4_toxicity(spark, sf_dir):
    """Scores of all documents by a model of their labels; rows whose crc32(doc_id) mod 5 is 0 are held out of it."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

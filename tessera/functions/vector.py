"""Vectors: a registry of embedders, the hashing embedder in whole numbers, and similarities.

An embedder turns lists of tokens into sparse vectors (buckets, weights). It runs where the rows are, a batch at a time,
and its vectors are stored beside the tokens, so that a request never embeds what is stored. The hashing embedder adds,
for each term, a signed weight to one of the dimensions. Weights are kept as the integers sign * (50 + byte mod 11),
fiftieths of the weight, so that sums are exact in any order; the factor cancels in cosines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import Settings
from tessera.functions import text as X

Embed = Callable[[list[list[str]]], list[tuple[np.ndarray, np.ndarray]]]
_embedders: dict[str, Callable[[Settings], Embed]] = {}
#: Tokens whose terms a worker remembers; beyond that it starts again.
KNOWN = 200_000


class Hashed:
    """The hashing embedder of one number of dimensions, with the terms of tokens that it has met."""

    def __init__(self, dims: int):
        self.dims, self.numbers, self.coded, self.of_token = dims, {}, [], {}

    def number(self, term: str) -> int:
        n = self.numbers.get(term)
        if n is None:
            n = self.numbers[term] = len(self.coded)
            d = hashlib.sha256(term.encode()).digest()
            self.coded.append((int.from_bytes(d[:4], "big") % self.dims, (1 if d[4] % 2 == 0 else -1) * (50 + d[5] % 11)))
        return n

    def embed(self, lists: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.of_token) > KNOWN:
            self.numbers, self.coded, self.of_token = {}, [], {}
        for token in set().union(*lists) - self.of_token.keys():
            self.of_token[token] = np.array([self.number(t) for t in X.terms_of_token(token)], np.int64)
        bucket, weight = (np.array(c, np.int64) for c in zip(*self.coded, strict=True)) if self.coded else (np.zeros(0, np.int64),) * 2
        out = []
        for tokens in lists:
            terms = np.unique(np.concatenate([self.of_token[t] for t in tokens])) if tokens else np.zeros(0, np.int64)
            dense = np.bincount(bucket[terms], weight[terms], self.dims)
            at = np.flatnonzero(dense)
            out.append((at, dense[at]))
        return out


_hashed: dict[int, Hashed] = {}


def hashing(settings: Settings) -> Embed:
    dims = max(8, settings.embedding_dimensions)
    return lambda lists: _hashed.setdefault(dims, Hashed(dims)).embed(lists)


def onnx(settings: Settings, most: int = 128) -> Embed:
    """A sentence model: mean of the token vectors under the mask, cut to the dimensions, of unit length.

    Both files are named by the settings; each worker opens them once, and only when the first batch comes."""
    model_path, tokenizer_path, dims = settings.onnx_model_path, settings.onnx_tokenizer_path, max(8, settings.embedding_dimensions)
    if not (model_path and tokenizer_path):
        raise ValueError("the onnx embedder needs onnx_model_path and onnx_tokenizer_path")
    opened: list = []

    def embed(lists: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not opened:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_path)
            tokenizer.enable_truncation(most)
            tokenizer.enable_padding()
            opened.extend((onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"]), tokenizer))
        session, tokenizer = opened
        names = {i.name for i in session.get_inputs()}
        coded = tokenizer.encode_batch([" ".join(sorted(set().union(*map(X.terms_of_token, tokens)))) for tokens in lists])
        given = {"input_ids": [c.ids for c in coded], "attention_mask": [c.attention_mask for c in coded], "token_type_ids": [c.type_ids for c in coded]}
        given = {k: np.array(v, np.int64) for k, v in given.items()}
        mask = given["attention_mask"][..., None].astype(np.float32)
        hidden = session.run(None, {k: v for k, v in given.items() if k in names})[0]
        mean = ((hidden * mask).sum(1) / np.maximum(mask.sum(1), 1e-9))[:, :dims]
        unit = (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float64)
        return [(np.arange(len(u)), u) if tokens else (np.zeros(0, np.int64), np.zeros(0)) for u, tokens in zip(unit, lists, strict=True)]

    return embed


def register_embedder(name: str, make: Callable[[Settings], Embed]) -> None:
    """Adds an embedder: make(settings) gives a function from lists of tokens to (buckets, weights), one each."""
    _embedders[name] = make


def embedder(settings: Settings) -> Embed:
    """The embedder that the settings name."""
    if settings.embedding_backend not in _embedders:
        raise ValueError(f"unknown embedder {settings.embedding_backend!r}; known: {sorted(_embedders)}")
    return _embedders[settings.embedding_backend](settings)


register_embedder("hashing", hashing)
register_embedder("onnx", onnx)

#: Rows that are embedded at once.
ROWS = 512


def embedded(rows: DataFrame, settings: Settings, tokens: str = "lexical_tokens") -> DataFrame:
    """rows with the vectors of a column of tokens: buckets array<int> and weights array<double>."""
    embed, at = embedder(settings), rows.columns.index(tokens)
    out = T.StructType([*rows.schema.fields, T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                batch = whole.slice(start, ROWS)
                made = embed([x or [] for x in batch.column(at).to_pylist()])
                edge = pa.array(np.concatenate(([0], np.cumsum([len(b) for b, _ in made]))), pa.int32())
                lists = [pa.ListArray.from_arrays(edge, pa.array(np.concatenate(c).astype(k))) for c, k in zip(zip(*made, strict=True), (np.int32, np.float64), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], out.names)

    return rows.mapInArrow(run, out)


def dense(buckets: Column, weights: Column, dims: int) -> Column:
    """A sparse vector as array<double> of unit length; all zeros for an empty one."""

    @F.pandas_udf("array<double>")
    def run(bucket: pd.Series, weight: pd.Series) -> pd.Series:
        out = np.zeros((len(bucket), dims))
        for row, b, w in zip(out, bucket, weight, strict=True):
            row[b] = w
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        return pd.Series(list(np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)))

    return run(buckets, weights)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two vectors of equal length, not below 0; 0 for empty vectors and unequal lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.greatest(F.lit(0.0), product)).otherwise(F.lit(0.0))

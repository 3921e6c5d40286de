"""Structured payloads: JSON text flattened to leaves in document order, its schema and the text made of it.

Flattening is recursive and keeps the order of keys, which no built-in function does; it runs as an Arrow UDF over JSON
text. All that follows from the leaves is column expressions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import collapse

FIELDS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "value_text", "value_type")]))
# Names of leaves that hold the main text, and the declared schema that shows these alone.
PRIMARY = ("text", "body", "content", "summary", "description", "name", "title", "message", "note", "notes")
INTENT = "user_intent"


def kind_of(value) -> str:
    names = ((bool, "boolean"), (int, "integer"), (float, "number"), (dict, "object"), (list, "array"), (type(None), "null"))
    return next((name for t, name in names if isinstance(value, t)), "string")


def leaves(value, path: str = "") -> list[tuple[str, str, str]]:
    """(path, text, kind) of the leaves of a value, depth first; nulls and blank leaves are left out."""
    out, todo = [], [(value, path)]
    while todo:
        v, p = todo.pop()
        if isinstance(v, dict):
            todo += [(x, f"{p}.{k}" if p else str(k)) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(x, f"{p}[{i}]") for i, x in reversed(list(enumerate(v)))]
        elif v is not None and (text := " ".join(str(v).split())):
            out.append((p or "value", text, kind_of(v)))
    return out


def flat(value) -> str:
    if isinstance(value, dict):
        return " ".join(f"{k}: {flat(v)}" for k, v in value.items())
    return " ".join(map(flat, value)) if isinstance(value, list) else str(value)


def parsed(raw: str | None):
    try:
        return json.loads(raw) if raw is not None else None
    except ValueError:
        return None


@F.pandas_udf(FIELDS)
def extract_fields(raw: pd.Series) -> pd.Series:
    """Leaves of JSON text; none for null, 'null' and what isn't JSON."""
    return raw.map(lambda x: [dict(zip(("path", "value_text", "value_type"), f, strict=True)) for f in leaves(parsed(x))])


@F.pandas_udf(T.StringType())
def flatten_text(raw: pd.Series) -> pd.Series:
    """JSON text as 'key: value' text; null for null and what isn't JSON."""
    return raw.map(lambda x: None if x is None or (v := parsed(x)) is None and x.strip() != "null" else flat(v))


@F.pandas_udf(T.StringType())
def root_type(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else kind_of(parsed(x)))


def leaf_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.element_at(F.split(path, r"\."), -1), r"\["), 1))


def primary_paths(fields: Column) -> Column:
    chosen = F.filter(fields, lambda f: leaf_name(f["path"]).isin(*PRIMARY))
    return F.array_distinct(F.transform(chosen, lambda f: f["path"]))


def structured_text(fields: Column, primary: Column, only_primary: Column | None = None) -> Column:
    """'path: value' of all fields, primary ones first; only_primary leaves the others out if there are primary ones."""
    first = F.filter(fields, lambda f: F.array_contains(primary, f["path"]))
    rest = F.filter(fields, lambda f: ~F.array_contains(primary, f["path"]))
    if only_primary is not None:
        rest = F.when(only_primary & (F.size(primary) > 0), F.slice(rest, F.lit(1), F.lit(0))).otherwise(rest)
    return collapse(F.array_join(F.transform(F.concat(first, rest), lambda f: F.concat(f["path"], F.lit(": "), f["value_text"])), " "))


def combined_text(text: Column, generated: Column) -> Column:
    """text followed by what was generated from the payload, unless text already holds that."""
    own = collapse(F.coalesce(text, F.lit("")))
    more = (own != "") & (generated != "") & ~F.contains(F.lower(own), F.lower(generated))
    return F.when(more, collapse(F.concat(own, F.lit(" "), generated))).when(own != "", own).otherwise(generated)


def analysis_text(combined: Column, fields: Column, declared_intent: Column) -> Column:
    """What tokens and terms are taken from: the combined text and, but for declared intents, the words of the paths."""
    paths = F.array_join(F.transform(fields, lambda f: F.translate(f["path"], ".[]", "   ")), " ")
    return F.when((F.size(fields) > 0) & ~declared_intent, collapse(F.concat(combined, F.lit(" "), paths))).otherwise(combined)


def merged_schema(declared: Column, inferred: Column) -> Column:
    """Declared paths first, then inferred ones; declared and inferred are structs of array field_paths and primary_text_paths."""
    return F.struct(*(F.array_distinct(F.concat(F.coalesce(declared[n], F.array().cast("array<string>")), F.coalesce(inferred[n], F.array().cast("array<string>")))).alias(n) for n in ("field_paths", "primary_text_paths")))

"""Column expressions over text: whitespace, tokens, stems, shingles of characters, terms, sizes and set similarities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(?iu)[a-z0-9]{2,}"
# Related terms, and the suffixes that a stem loses (the longest that leaves three characters).
RELATED = {
    "brief": ["concise", "short"], "concise": ["brief", "short"], "short": ["brief", "concise"],
    "update": ["status", "summary"], "status": ["update", "summary"], "summary": ["update", "status"],
    "email": ["mail", "draft"], "mail": ["email", "draft"], "draft": ["email", "mail"],
    "client": ["customer", "matter"], "matter": ["case", "client"], "case": ["matter"],
    "redline": ["revision", "edit"], "revision": ["redline", "edit"], "edit": ["revision", "redline"],
}
TO_Y = r"^.{3,}(?:ies|ied)$"
SUFFIXES = r"^(.{3,}?)(?:ingly|edly|ment|tion|ions|ness|able|ible|ing|ers|ed|es|s)$"
GRAM = 4


def collapse(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def blank_to_null(text: Column) -> Column:
    short = F.trim(text)
    return F.when(short != "", short)


def lexical_tokens(text: Column) -> Column:
    """Sorted distinct lower-case runs of two or more letters and digits."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def stem(token: Column) -> Column:
    return F.when(token.rlike(TO_Y), F.regexp_replace(token, "(?:ies|ied)$", "y")).otherwise(F.regexp_replace(token, SUFFIXES, "$1"))


def char_grams(token: Column, n: int = GRAM) -> Column:
    """All n-character pieces of ^token$, or that as a whole if it is shorter."""
    framed = F.concat(F.lit("^"), token, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(framed) - n + 1)), lambda i: F.substring(framed, i, F.lit(n)))


def related(token: Column) -> Column:
    table = F.create_map(*(x for word, others in RELATED.items() for x in (F.lit(word), F.array(*map(F.lit, others)))))
    return F.coalesce(F.try_element_at(table, token), F.array().cast("array<string>"))


def terms_of(tokens: Column) -> Column:
    """Sorted distinct terms of tokens: the tokens, their stems, related words and their stems, and character pieces."""
    others = F.flatten(F.transform(tokens, related))
    parts = F.concat(tokens, F.transform(tokens, stem), others, F.transform(others, stem), F.flatten(F.transform(tokens, lambda t: char_grams(t))))
    return F.array_sort(F.array_distinct(parts))


def semantic_terms(text: Column) -> Column:
    return terms_of(lexical_tokens(text))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def checksum(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the geometric mean of the sizes; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when(common > 0, common / F.sqrt(F.size(a).cast("double") * F.size(b))).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


# --- the same for one text in Python, where a task or the driver has it at hand ---------------------------------------

_TOKEN, _TO_Y, _SUFFIXES = re.compile(r"[a-z0-9]{2,}", re.I), re.compile(TO_Y), re.compile(SUFFIXES)


def tokens_of(text: str) -> list[str]:
    """lexical_tokens() of a text."""
    return sorted({t.lower() for t in _TOKEN.findall(text)})


def stem_of(token: str) -> str:
    return token[:-3] + "y" if _TO_Y.match(token) else _SUFFIXES.sub(r"\1", token)


def terms_of_token(token: str) -> set[str]:
    """What a token adds to the terms of a text."""
    framed, others = f"^{token}$", RELATED.get(token, [])
    return {token, stem_of(token), *others, *map(stem_of, others), *(framed[i : i + GRAM] for i in range(max(1, len(framed) - GRAM + 1)))}

"""Secret scans: an Aho-Corasick automaton finds keywords, anchored patterns run only at its hits, checksums decide.

Text is scanned as UTF-8 bytes, in which every pattern below is ASCII; byte offsets become code points for hits only.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import table

#: Kinds in the order in which they are listed; the first three are the base, the others carry a checksum of their own.
KINDS = ("assign", "access", "hex", "hosting_token", "registry_token")
# The keywords and patterns that define each kind.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(rb"[0-9a-f]+")
CHECKED = {"hosting_token": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), "registry_token": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")}
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
DIGITS62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_AS_HEX = bytes.maketrans(bytes(range(256)), bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256)))


def checksum_holds(token: bytes) -> bool:
    """Whether the last six characters of a token are the CRC-32 of the 30 before them, in base 62."""
    body, want = token[4:34], token[34:40]
    n, got = zlib.crc32(body), b""
    for _ in range(6):
        n, r = divmod(n, 62)
        got = DIGITS62[r : r + 1] + got
    return got == want


def build_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for c in "pousr":
        found.add_word(f"gh{c}_", ("hosting_token", 4))
    found.add_word("npm_", ("registry_token", 4))
    found.make_automaton()
    return found


def find_secrets(data: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, by start and then kind; matches of a kind never overlap, and the leftmost wins."""
    hits, spans, free = list(automaton.iter(data.lower().decode("latin-1"))), [], dict.fromkeys(KINDS, 0)
    for last, (kind, length) in sorted(hits, key=lambda h: h[0] - h[1][1]):
        start = last - length + 1
        if start < free[kind]:
            continue
        if m := (ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED[kind]).match(data, start):
            free[kind] = m.end()
            if len(m[1]) >= LEAST_ASSIGNED if kind == "assign" else m.end() - start >= LEAST_ACCESS if kind == "access" else checksum_holds(m[0]):
                spans.append((start, kind, m.end()))
    mapped, at = data.translate(_AS_HEX), 0
    while (at := mapped.find(b"h" * LEAST_HEX, at)) >= 0:  # a run's first 24 characters: nothing before them belongs to it
        end = HEX_RUN.match(data, at).end()
        spans.append((at, "hex", end))
        at = end
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def in_code_points(data: bytes, spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    if data.isascii() or not spans:
        return spans
    places, at, points = {}, 0, 0
    for b in sorted({p for s in spans for p in (s[0], s[2])}):
        points += len(data[at:b].decode())
        places[b], at = points, b
    return [(places[a], kind, places[b]) for a, kind, b in spans]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts by kind, base_sha256 and spans (kind:start:end, in code points).

    Null and empty texts have no spans. Each text, also a very long one, is scanned whole, in one pass that holds one batch;
    a repeated row or doc_id gives a row each time, other columns are not read, and an empty table gives an empty result.
    """

    def scan(batches):
        automaton = build_automaton()
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                spans = in_code_points(data or b"", find_secrets(data or b"", automaton)) if data else []
                base = [s for s in spans if s[1] in KINDS[:3]]
                out.append((*(sum(s[1] == k for s in spans) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "cast(text as binary) as text").mapInArrow(scan, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def op1_secret_scan(spark, sf_dir):
    """Secrets in all documents: counts and digest of base spans, and all spans."""
    return scan_secrets(table(spark, sf_dir, "documents"))

"""Secret scans with multipart credential linking.

Strong patterns are reported as they stand. Weak parts (identifiers, secrets of high entropy, endpoints) are only
candidates: an interval join of the parts within a scope reports a weak one when a complementary part lies in reach.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, free_name, map_rows

#: Strong patterns, with the least length of the part that counts (group 2 of assign).
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Weak parts.
WEAK_ID = re.compile(r"\b(?:client_?id|user(?:name)?|login|account|key_?id|access_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}|\bASIA[A-Z0-9]{16}\b", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"\b(?:https?|jdbc:[a-z]+|amqps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|s3|sftp)://[^\s\"'<>]+|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}", re.I | re.A)
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
SCOPE = 200
ROLE = {"access": "id", "assign": "secret", "hex": "secret", "link_id": "id", "link_secret": "secret", "link_endpoint": "endpoint"}
HINT = re.compile(r"://|[:=]|AKIA|ASIA|[A-Za-z0-9+/_=-]{20}")


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def base(text: str) -> list[tuple[str, int, int]]:
    """The strong spans (kind, start, end): code points, end exclusive, by start and kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX_RUN.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def linked(text: str, strong: list[tuple[str, int, int]], scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """Weak spans that have a complementary part within ``scope`` code points and outside all strong spans."""
    weak = [("link_id", *m.span()) for m in WEAK_ID.finditer(text)] + [("link_endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    weak += [("link_secret", *m.span()) for m in WEAK_SECRET.finditer(text) if entropy(m[0]) >= 3.7 and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    starts, ends = [s[1] for s in sorted(strong, key=lambda s: s[1])], sorted(s[2] for s in strong)
    # a span is free when as many strong spans have ended by its start as have begun before its end
    weak = [w for w in weak if bisect_right(ends, w[1]) == bisect_left(starts, w[2])]
    if not weak:
        return []
    roles: dict[str, tuple[list[int], list[int]]] = {}
    for k, a, b in [*strong, *weak]:
        roles.setdefault(ROLE[k], ([], []))[0].append(a)
        roles[ROLE[k]][1].append(b)
    for a, b in roles.values():
        a.sort()
        b.sort()

    def near(role: str, a: int, b: int) -> bool:
        if role not in roles:
            return False
        begins, finishes = roles[role]
        return bisect_right(begins, b + scope) > bisect_left(finishes, a - scope)

    return [w for w in weak if any(near(r, w[1], w[2]) for r in ({"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)})[ROLE[w[0]]])]


def scan(text: str | None, scope: int = SCOPE) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(strong spans, all spans); null and empty texts have none."""
    if not text or not HINT.search(text):
        return [], []
    strong = base(text)
    return strong, sorted([*strong, *linked(text, strong, scope)], key=lambda s: (s[1], ORDER[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span (overlapping ones joined) replaced by a mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Null and empty texts have no spans, null ids stay null. Repeated rows give a row each; extra columns are not read. An
    empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [scan(t, scope) for t in texts]
        n = [Counter(s[0] for s in b) for b, _ in found]
        cols = [batch.column(0), *(pa.array([c[k] for c in n], pa.int64()) for k in KINDS[:3]), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]), pa.array([joined(a) for _, a in found], pa.string()), pa.array([len(a) - len(b) for b, a in found], pa.int64())]
        names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]
        return pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, scope: int = SCOPE, text_col: str = "text", counted: str | None = None) -> DataFrame:
    """The documents with every span in their text replaced by a mark; other columns, and null texts, as they were.

    counted: a column that holds the text's length and follows it where the text changes.
    """
    name = free_name(docs, "_redacted")
    cleaned = add_columns(docs, text_col, lambda texts: [pa.array([redacted(t, scan(t, scope)[1]) for t in texts], pa.string())], f"{name} string")
    kept = {c: F.col(f"`{c}`") for c in docs.columns}
    if counted in kept:
        kept[counted] = F.when(F.col(name) != F.col(text_col), F.length(name).cast(docs.schema[counted].dataType)).otherwise(kept[counted])
    kept[text_col] = F.col(name)
    return cleaned.select(*(v.alias(c) for c, v in kept.items()))

"""Secret scans: plain patterns, and weak credential parts that count only together.

Every document is scanned on its own, so nothing is shuffled. Besides the plain patterns, weak candidates
are gathered as intervals: access identifiers (user or client names), secret-like strings of mixed
characters, and endpoints (addresses and URLs). An interval join within each scope (a few lines around a
candidate) links them, and only sets with an identifier or endpoint and a secret in one scope are reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .shared import packed, texts, unpacked

#: Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|client_id|account|access_key(?:_id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"\b(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis)://[^\s\"'<>]{4,}|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9.-]{4,})", re.I | re.A)
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.A)
ORDER = ("assign", "access", "hex", "id", "endpoint", "weak")
#: A scope reaches this many characters to either side of a candidate.
REACH = 240


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rank of the kind) of what the plain patterns find."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


def weak_candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts that mean nothing alone: identifiers, endpoints, and mixed strings that no plain pattern took."""
    out = [(m.start(), m.end(), 3) for m in IDENTIFIER.finditer(text)] if "=" in text or ":" in text else []
    out += [(m.start(), m.end(), 4) for m in ENDPOINT.finditer(text)] if "://" in text or "=" in text or ":" in text else []
    if not out and not any(kind == 1 for *_, kind in taken):
        return []
    held = sorted((a, b) for a, b, _ in taken + out)
    starts, furthest = [a for a, _ in held], list(accumulate((b for _, b in held), max))
    for m in MIXED.finditer(text):
        word = m.group()
        if any(c.isdigit() for c in word) and any(c.isupper() for c in word) and any(c.islower() for c in word):
            k = bisect_left(starts, m.end())
            if not (k and furthest[k - 1] > m.start()):
                out.append((m.start(), m.end(), 5))
    return out


def linked(base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """The weak candidates with their complement in scope: a secret needs an identifier or endpoint, and those need a secret."""
    if not weak:
        return []
    secret = sorted([(a, b) for a, b, k in base if k in (0, 2)] + [(a, b) for a, b, k in weak if k == 5])
    names = sorted([(a, b) for a, b, k in base if k == 1] + [(a, b) for a, b, k in weak if k in (3, 4)])

    def near(a: int, b: int, starts: list[int], furthest: list[int]) -> bool:
        k = bisect_right(starts, b + reach)
        return k > 0 and furthest[k - 1] >= a - reach

    secrets_at = [a for a, _ in secret], list(accumulate((b for _, b in secret), max))
    names_at = [a for a, _ in names], list(accumulate((b for _, b in names), max))
    return [(a, b, k) for a, b, k in weak if near(a, b, *(names_at if k == 5 else secrets_at))]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ORDER[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, linked(base, weak_candidates(text, base))


def _scan(batches):
    for part in slices(batches):
        rows = [scan_text(t) for t in part.column("text").to_pylist()]
        kinds = [[k for *_, k in base] for base, _ in rows]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                *(pa.array([ks.count(k) for ks in kinds], pa.int64()) for k in range(3)),
                pa.array([_joined(base) for base, _ in rows], pa.string()),
                pa.array([_joined(base + more) for base, more in rows], pa.string()),
                pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "base_sha256"],
        )


def find_secrets(documents: DataFrame) -> DataFrame:
    """Per document row: counts by plain kind, base_spans, their digest, and all spans (kind:start:end in code points).

    Null and empty texts have none; repeated rows are each scanned; other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    return texts(documents, "doc_id").mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string, base_sha256 string")


def _mask(batches):
    for part in slices(batches):
        out = []
        for text in part.column("text").to_pylist():
            base, more = scan_text(text)
            kept, at = [], 0
            for a, b, k in sorted(base + more):
                if k not in (3, 4):  # names and addresses stay; what they open is masked
                    kept += [text[at:a], "[secret]"] if a >= at else []
                    at = max(at, b)
            text = "".join(kept) + text[at:]
            out.append(text)
        yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def mask_secrets(documents: DataFrame) -> DataFrame:
    """The documents with each secret replaced by a mark; n_chars, where there is one, follows. A null text becomes empty."""
    rows = packed(documents.withColumn("text", F.coalesce("text", F.lit(""))), "text")
    masked = unpacked(rows.mapInArrow(_mask, rows.schema), documents.columns, "text")
    return masked.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else masked

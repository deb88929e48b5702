"""Secret scans: key patterns plus sliding-window Shannon entropy over candidate strings.

Candidates are runs of 20 or more letters, digits and + / _ -. A window of WINDOW characters has a class: ``words``
without a digit, else ``base64`` with one of + / _ = -, ``alnum`` with a letter beyond f, ``hex``; windows without any
letter are numbers and have none. A window is a finding if its entropy reaches its class's threshold and it touches
nothing on the allow-list; the rest of its candidate is judged by its own windows. Overlapping and adjoining findings
are one span.

``find_secrets`` returns one row per span, ``scan_documents`` one row per document.
Null and empty texts have no spans; repeated rows each get their own result.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read, text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_HINT = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Characters in an entropy window.
WINDOW = 20
#: Least entropy (bits a character) of a window of each class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "base64": 3.8, "words": 4.0}
#: What is known not to be secret: examples in manuals, alphabets, identifiers in their usual layout.
ALLOW = re.compile(
    r"(?i:example|sample|placeholder|changeme|dummy|xxxx|0123456789|abcdefghij)|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
)

_DIGIT, _HEX, _LETTER, _MARK = range(4)
_CLASS = {c: _DIGIT for c in "0123456789"} | {c: _HEX for c in "abcdefABCDEF"} | {c: _LETTER for c in "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ"} | {c: _MARK for c in "+/_=-"}
# up to one more: a character comes in before another goes
_CLOG = [0.0] + [k * log2(k) for k in range(1, WINDOW + 2)]
#: For the last bits of the sums.
_SLACK = 1e-9


def entropy_spans(s: str, base: int = 0) -> list[tuple[int, int]]:
    """Spans of ``s`` (shifted by ``base``) covered by windows whose entropy reaches the
    threshold of their class. Counts are updated as the window moves."""
    if len(s) < WINDOW:
        return []
    counts: dict[str, int] = {}
    classes, total, spans, allowed, near = [0, 0, 0, 0], 0.0, [], None, 0
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        total += _CLOG[k + 1] - _CLOG[k]
        counts[c] = k + 1
        classes[_CLASS[c]] += 1
        if i >= WINDOW:
            old = s[i - WINDOW]
            k = counts[old]
            total += _CLOG[k - 1] - _CLOG[k]
            counts[old] = k - 1
            classes[_CLASS[old]] -= 1
        if i >= WINDOW - 1 and (classes[_HEX] or classes[_LETTER]):
            kind = "words" if not classes[_DIGIT] else "base64" if classes[_MARK] else "alnum" if classes[_LETTER] else "hex"
            if log2(WINDOW) - total / WINDOW >= THRESHOLDS[kind] - _SLACK:
                lo, hi = i - WINDOW + 1, i + 1
                if allowed is None:
                    allowed = [m.span() for m in ALLOW.finditer(s)]
                while near < len(allowed) and allowed[near][1] <= lo:  # windows move to the right only
                    near += 1
                if near < len(allowed) and allowed[near][0] < hi:
                    continue
                if spans and base + lo <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], base + hi)
                else:
                    spans.append((base + lo, base + hi))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the pattern matches, leftmost and non-overlapping per kind."""
    out = []
    if ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    more = [(lo, 3, hi) for m in CANDIDATE.finditer(text) for lo, hi in entropy_spans(m[0], m.start())]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: id, kind, start_pos, end_pos (code points, end exclusive) and the matched string."""

    def make():
        def f(ids, texts):
            rows = [(i, KINDS[k], lo, hi, t[lo:hi]) for i, t in zip(ids, texts, strict=True) for lo, k, hi in all_spans(t or "")[1]]
            return tuple(zip(*rows, strict=True)) if rows else ([], [], [], [], [])

        return f

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(src, ["doc_id", "text"], "doc_id bigint, kind string, start_pos bigint, end_pos bigint, secret string", make)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the number of spans of each pattern, a digest of them, and all spans."""

    def make():
        def f(ids, texts):
            out = []
            for i, t in zip(ids, texts, strict=True):
                base, every = all_spans(t)
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                out.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            return tuple(zip(*out, strict=True)) if out else tuple([] for _ in range(7))

        return f

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"
    return map_rows(src, ["doc_id", "text"], schema, make)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))

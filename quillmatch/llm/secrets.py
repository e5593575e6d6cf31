"""7. Secret scans: patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm.common import ship, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGNED = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A window of this many characters must reach the entropy, in bits a character, of its class; a class needs a digit and a letter.
WINDOW = 20
#: Classes from the widest; a run of a class is of this length at least.
CLASSES = (
    (re.compile(r"[0-9A-Za-z+/_-]{20,}={0,2}"), 3.7),
    (re.compile(r"[0-9A-Za-z]{20,}"), 3.6),
    (re.compile(r"[0-9A-Fa-f]{20,}"), 3.0),
)
#: Strings like secrets that are none: UUIDs. Words or numbers joined by marks are none either, as they lack a digit or a letter.
ALLOWED = (re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),)
#: Words of which a run has one only if it stands for a secret and is none.
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|dummy|xxxx|1234567890|abcdefgh")
_NLOGN = [0.0, *(n * log2(n) for n in range(1, WINDOW + 1))]


def windows(s: str, size: int = WINDOW) -> Iterator[float]:
    """Shannon entropy of each window; a step changes two counts and so two terms of the sum."""
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(s):
        if i >= size:  # first out, then in, so no count passes the window's size
            d = s[i - size]
            n = counts[d]
            total += _NLOGN[n - 1] - _NLOGN[n]
            counts[d] = n - 1
        n = counts.get(c, 0)
        total += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        if i >= size - 1:
            yield log2(size) - total / size


def allowed(s: str) -> bool:
    """If the allow-list has the string, though its entropy may be high."""
    return PLACEHOLDER.search(s) is not None or any(a.fullmatch(s) for a in ALLOWED)


def random_looking(s: str, least: float) -> bool:
    """If a window of s, which must have a digit and a letter, has that entropy."""
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return False
    return any(h >= least - 1e-9 for h in windows(s))


def runs(text: str, start: int = 0, end: int | None = None, kind: int = 0) -> Iterator[tuple[int, int]]:
    """Spans, in a part of the text, of runs of a class that look random and are not on the allow-list, the widest class first.

    A run that is none falls into its runs of the next narrower class, which are judged by that class's entropy and are
    looked up on the allow-list by themselves.
    """
    pattern, least = CLASSES[kind]
    for m in pattern.finditer(text, start, len(text) if end is None else end):
        if random_looking(m[0], least) and not allowed(m[0]):
            yield m.span()
        elif kind + 1 < len(CLASSES):
            yield from runs(text, *m.span(), kind + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of pattern matches, in code points, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower() if text.isascii() else None
    if low is None or any(k in low for k in ASSIGNED):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of enough entropy that do not lie within a stretch which base spans, sorted by start, cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for a, b in runs(text):
        i = bisect_right(starts, a) - 1
        if i < 0 or b > ends[i]:
            out.append((a, 3, b))
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text; null is empty."""
    base = base_spans(text or "")
    return base, sorted(base + entropy_spans(text or "", base))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) for every row; spans are kind:start:end by start.

    Spans of one start go by kind. Null and empty texts have no spans; repeated rows give repeated rows, an empty table an empty
    result; other columns are ignored, whatever their names. Rows are scanned where they are read. Of a very long text only its
    spans are kept; the time is in proportion to its length and the number of spans, and a run's window counts take constant memory.
    """
    ship(docs.sparkSession)
    rows = docs.select(doc_id, text)
    kind = rows.schema[doc_id].dataType.simpleString()
    names = [doc_id, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, spans = [], [], []
            for t in b.column(1):
                base, found = scan(t.as_py())
                counts.append([sum(x[1] == k for x in found) for k in range(len(KINDS))])
                shas.append(hashlib.sha256(told(base).encode()).hexdigest())
                spans.append(told(found))
            columns = list(zip(*counts, strict=True)) or [[] for _ in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=names)

    return rows.mapInArrow(run, ", ".join([f"`{doc_id}` {kind}", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"]))


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with a mask for each secret; spans that touch get one."""
    out, at = [], 0
    for a, _, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))

"""Secret scans: base patterns, and multipart credentials by an interval join.

A credential has parts: an identifier, a secret and, often, an endpoint.
Access identifiers and assigned secrets are strong parts; a run of hex digits
is a secret that proves nothing by itself. Weak candidates (a login name, a
bare token, a URL) mean little alone; within a scope (text between blank
lines) each is an interval widened by ``REACH`` that meets those of
complementary parts, or isn't reported: an identifier needs a strong secret,
or any secret and an endpoint; a secret needs a strong identifier, or any
identifier and an endpoint; an endpoint needs an identifier and a secret.
The join sorts each role's parts once and searches them, so it costs
n log n and emits no pairs.

Scanning happens where documents are read. Array operations over blocks of
bytes find the few documents that need the expressions at all.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import SPANS, schema_of, with_text

KINDS = ("assign", "access", "hex", "part_id", "part_secret", "part_endpoint")
#: Code points by which an interval is widened on either side.
REACH = 200
#: Bits per character that a bare token needs.
ENTROPY = 3.5

#: The base expressions (fixed).
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Weak candidates.
LOGIN = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id)["']?\x20{0,8}[:=]\x20{0,8}["']?([A-Za-z0-9._@-]{3,})""", re.A | re.I)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]{1,5})?""")
BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int]


def base(text: str) -> list[Span]:
    """Spans of the three base kinds, in code points, by start."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def weak(text: str, strong: list[Span]) -> list[Span]:
    """Weak candidates, other than those inside strong parts."""
    out = [("part_id", *m.span(1)) for m in LOGIN.finditer(text)]
    out += [("part_endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    for m in TOKEN.finditer(text):
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and _entropy(m[0]) >= ENTROPY:
            out.append(("part_secret", *m.span()))
    starts = sorted((a, b) for _, a, b in strong)
    ends = np.maximum.accumulate([b for _, b in starts]) if starts else []

    def inside(a: int, b: int) -> bool:
        i = bisect_left(starts, (b, 0))
        return i > 0 and ends[i - 1] > a

    return [s for s in out if not inside(s[1], s[2])]


#: Identifiers, secrets and endpoints; strong parts are named with them.
ID, SECRET, PLACE = range(3)
ROLES = {"access": ID, "part_id": ID, "assign": SECRET, "hex": SECRET, "part_secret": SECRET, "part_endpoint": PLACE}
STRONG = ("access", "assign")


def link(text: str, strong: list[Span], candidates: list[Span], reach: int = REACH) -> list[Span]:
    """The weak candidates whose complementary parts are near them in their scope."""
    if not candidates:
        return []
    borders = [m.start() for m in BLANK.finditer(text)]
    parts: dict[tuple[int, int, bool], list[tuple[int, int]]] = {}
    for kind, a, b in strong + candidates:
        for sure in (False, True)[: 1 + (kind in STRONG)]:
            parts.setdefault((bisect_left(borders, a), ROLES[kind], sure), []).append((a, b))
    furthest = {}
    for key, own in parts.items():
        own.sort()
        furthest[key] = np.maximum.accumulate([b for _, b in own]).tolist()

    def near(key: tuple[int, int, bool], a: int, b: int) -> bool:
        own = parts.get(key)
        if not own:
            return False
        i = bisect_left(own, (b + reach + 1, -1))  # those that begin early enough; does any of them end late enough?
        return i > 0 and furthest[key][i - 1] >= a - reach

    out = []
    for kind, a, b in candidates:
        scope, role = bisect_left(borders, a), ROLES[kind]
        others = [r for r in (ID, SECRET, PLACE) if r != role]
        if (role != PLACE and near((scope, others[0], True), a, b)) or all(near((scope, r, False), a, b) for r in others):
            out.append((kind, a, b))
    return out


def scan(text: str) -> list[Span]:
    """All spans of a text: base ones and linked parts, by start, then kind."""
    strong = base(text)
    added = link(text, strong, weak(text, strong))
    return sorted(strong + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_WORDS = ("passw", "secret", "token", "apikey", "api_key", "user", "login", "account", "client")
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True


def likely(text: str) -> bool:
    """Whether any expression can match at all; cheap, and never false where one matches."""
    if "AKIA" in text or "://" in text:
        return True
    low = text.lower()
    if (":" in text or "=" in text) and any(w in low for w in _WORDS):
        return True
    run = _HEX[np.frombuffer(text.encode(), np.uint8)]
    for step in (1, 2, 4, 8):
        run = run[:-step] & run[step:]
    return bool(run.any())


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc`` (a struct of all other columns) and ``spans``, an array of (kind, start, end), by start, then kind.

    Null and empty texts have no spans. Repeated rows each have theirs. An
    empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in scan(text)] if likely(text) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(spans, kind)], ["doc", "spans"])

    given = with_text(docs, text_col)
    return given.mapInArrow(rows, schema_of(given, "doc", spans=SPANS))

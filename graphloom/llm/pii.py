"""PII: base patterns, and a semi-Markov conditional random field.

The field labels whole candidate segments of up to ``MOST_TOKENS`` tokens (or
``MOST_DIGITS`` where each is a digit or two, as in a number that is spelled
out), not single tokens: features look at a segment as a whole (how many
digits, in which groups, a checksum, a domain at its end, the words around
it), and dynamic programming over segment ends chooses boundaries and types
of all entities jointly. Segments that no entity can be (too few digits, or
more than a card has, and no sign of an address) have no score, so text between tokens with digits or address
signs decomposes the problem exactly, and only windows around such tokens
are decoded.

The field is trained here, by gradient ascent on the conditional likelihood
of windows that :func:`examples` writes (formats of each type that the base
patterns know and ones that they do not, among other numbers, dates and
tables of numbers). Base spans
always stand; the field adds entities that no base span touches.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import SPANS, schema_of, with_text

KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"crf_{k}" for k in KINDS)

#: The base expressions (fixed); ``base`` applies them without quadratic searches.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]

#: Bounds of the field.
MOST_TOKENS, EXAMPLES, EPOCHS, RATE, SHRINK = 6, 420, 8, 0.3, 1e-3
#: Digits that an entity has at least, without a sign of an address, and at most (a card's).
NEED_DIGITS, MOST_DIGITS = 7, 19
#: Windows whose labels a worker keeps, and their longest text: some ten MB.
KEPT_WINDOWS, KEPT_CHARS = 20_000, 200
SIGN = re.compile(r"@|\((?:at)\)|\[(?:at)\]", re.I)
TOKEN = re.compile(r"\S+")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base(text: str) -> list[Span]:
    """Spans of the four base kinds, in code points, by kind, then start."""
    out: list[Span] = []
    last, local = 0, LOCAL.match
    at = text.find("@")
    while at >= 0:
        a = at
        while a > last and local(text[a - 1]):
            a -= 1
        m = DOMAIN.match(text, at) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in CHAIN.finditer(text):
        parts = list(re.finditer("[0-9]+", m[0]))
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or "0") <= 255 for p in own):
                out.append(("ip", m.start() + own[0].start(), m.start() + own[3].end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def signs(segment: str, before: str, after: str = "") -> list[str]:
    """The features of a whole segment, and of the words before and behind it."""
    core = segment.strip(".,;:!?\"'")
    digits = re.sub(r"[^0-9]", "", core)
    letters = len(re.findall(r"[^\W\d_]", core))
    groups = re.findall(r"[0-9]+", core)
    out = ["any", f"digits{min(len(digits), 20)}", "letters" if letters else "no letters"]
    out.append("groups " + "-".join(str(min(len(g), 5)) for g in groups[:6]))
    out.append("split by " + "".join(sorted(set(re.sub(r"[^\W_]", "", core)))[:6]))
    if SIGN.search(core):
        out.append("at")
        if re.match(r"[A-Za-z0-9._%+-]+\s*(?:@|\(at\)|\[at\])\s*[A-Za-z0-9-]+\s*(?:\.|\(dot\)|\[dot\])\s*[A-Za-z0-9-]{2,}$", core, re.I):
            out.append("address")
    if core.startswith("+"):
        out.append("plus")
    if re.match(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", core):
        out.append("three three four")
    if len(digits) >= 13 and not letters:
        out.append("luhn" if luhn(digits) else "no luhn")
    if len(groups) == 4 and not letters and all(int(g[:4]) <= 255 and len(g) <= 3 for g in groups):
        out.append("octets")
    if core[:1].isalnum() and core[-1:].isalnum() or core[:1] in "+(":
        out.append("clean edges")
    word = re.sub(r"\W", "", before).lower()
    out.append(f"after {word}" if word in CUES else "after other")
    if not letters:
        out += [f"{side} a number" for side, w in (("after", before), ("before", after)) if NUMBER.fullmatch(w)]
        if len(groups) > 1:
            out.append("equal groups" if len({len(g) for g in groups}) == 1 else "unequal groups")
            out.append(f"groups of up to {min(max(map(len, groups)), 8)}")
    return out


CUES = ("tel", "phone", "call", "fax", "mobile", "card", "visa", "ip", "host", "email", "mail", "order", "id", "no", "version", "isbn")


#: A token that is a number, and one that is a digit or two of a longer number.
NUMBER = re.compile(r"[(\[]?[+-]?[0-9][0-9.,:/-]*[)\]%.,;]?")
FEW_DIGITS = re.compile(r"[0-9]{1,2}[.,-]?")


def segments(tokens: list[str]) -> list[tuple[int, int, list[str]]]:
    """(first token, token after the last, features) of every candidate segment."""
    out = []
    digits = [len(_DIGIT.findall(t)) for t in tokens]
    signed = [SIGN.search(t) is not None for t in tokens]
    few = [FEW_DIGITS.fullmatch(t) is not None for t in tokens]
    for i in range(len(tokens)):
        n, sign, spelled = 0, False, True
        for j in range(i + 1, min(len(tokens), i + MOST_DIGITS) + 1):
            n, sign, spelled = n + digits[j - 1], sign or signed[j - 1], spelled and few[j - 1]
            if (j - i > MOST_TOKENS and not spelled) or (n > MOST_DIGITS and not sign):
                if j - i > MOST_TOKENS or n > 4 * MOST_DIGITS:
                    break
                continue
            if NEED_DIGITS <= n or sign or sum(t.count(".") for t in tokens[i:j]) >= 3:
                out.append((i, j, signs(" ".join(tokens[i:j]), tokens[i - 1] if i else "", tokens[j] if j < len(tokens) else "")))
    return out


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Windows of tokens with their entities as (first, after last, type)."""
    rng = random.Random(seed)

    def num(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        k = rng.choice((15, 16, 16, 16, 19))
        body = rng.choice("3456") + num(k - 2)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        sep = rng.choice(("", " ", "-", "."))
        if k == 15 and sep:
            return sep.join((full[:4], full[4:10], full[10:]))
        return sep.join(full[i : i + 4] for i in range(0, k, 4)) if sep else full

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"{a} {b} {c}", f"1-{a}-{b}-{c}"))

    def ip() -> str:
        o = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice((".", ".", ".", "-")).join(o)

    def email() -> str:
        name, host, top = word() + rng.choice(("", num(2), "." + word())), word(), rng.choice(("com", "org", "net", "de"))
        return rng.choice((f"{name}@{host}.{top}", f"{name} (at) {host}.{top}", f"{name}[at]{host}.{top}", f"{name} @ {host}.{top}", f"{name} (at) {host} (dot) {top}"))

    def other() -> str:
        return rng.choice((num(rng.randint(1, 12)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(1)}.{num(1)}.{num(2)}", f"{num(3)},{num(3)},{num(3)}", "b" + num(18) + "f", f"#{num(8)}", num(16), f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(4)} {num(4)} {num(2)}", word() + "@", f"{num(2)}:{num(2)}:{num(2)}.{num(3)}"))

    def spelled() -> str:
        k = rng.choice((15, 16))
        body = rng.choice("3456") + num(k - 2)
        return rng.choice((" ", ". ", "- ")).join(next(body + d for d in "0123456789" if luhn(body + d)))

    def table() -> list[str]:
        width, most, sep = rng.randint(1, 8), rng.randint(2, 8), rng.choice(("", "", ",", ";", "."))
        many = rng.randint(4, 14)
        kind = rng.randrange(5)
        if kind == 0:  # a column of one width
            return [num(width) + sep for _ in range(many)]
        if kind == 1:  # of any width
            return [str(rng.randrange(10**most)) + sep for _ in range(many)]
        if kind == 2:  # of decimals
            return [f"{rng.randrange(10**rng.randint(1, 4))}.{num(rng.randint(1, 3))}" for _ in range(many)]
        if kind == 3:  # of dates and times
            return [rng.choice((f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(2)}/{num(2)}/{num(4)}")) for _ in range(many)]
        return [rng.choice(("-", "")) + str(rng.randrange(10 ** rng.randint(1, 9))) + sep for _ in range(many)]

    make = (email, ip, lambda: spelled() if rng.random() < 0.15 else card(), phone)
    out = []
    for k in range(n):
        if k % 3 == 0:
            out.append(([word() for _ in range(rng.randint(0, 2))] + table() + [word() for _ in range(rng.randint(0, 1))], []))
            continue
        tokens: list[str] = []
        found = []
        for _ in range(rng.randint(2, 4)):
            tokens += [word() for _ in range(rng.randint(0, 2))]
            if rng.random() < 0.3:
                tokens.append(rng.choice(CUES) + rng.choice(("", ":")))
            y = rng.randrange(6)
            got = (make[y] if y < 4 else other)().split(" ")
            if y < 4:
                found.append((len(tokens), len(tokens) + len(got), y))
            got[-1] += rng.choice(("", "", ".", ","))
            tokens += got
            tokens.append(word())
        out.append((tokens, found))
    return out


def _logsum(a: np.ndarray) -> float:
    m = a.max()
    return float(m + np.log(np.exp(a - m).sum()))


@cache
def field(n: int = EXAMPLES, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """The trained field: a weight per type for each feature."""
    number: dict[str, int] = {}
    data = []
    for tokens, found in examples(n):
        segs = [(i, j, np.array([number.setdefault(f, len(number)) for f in fs])) for i, j, fs in segments(tokens)]
        data.append((len(tokens), segs, {(i, j): y for i, j, y in found}))
    w = np.zeros((len(number), len(KINDS)))
    for epoch in range(epochs):
        rate = RATE / (1 + epoch / 3)
        for n_tokens, segs, gold in data:
            scores = [w[fs].sum(axis=0) for _, _, fs in segs]
            ending: dict[int, list[int]] = {}
            starting: dict[int, list[int]] = {}
            for s, (i, j, _) in enumerate(segs):
                ending.setdefault(j, []).append(s)
                starting.setdefault(i, []).append(s)
            alpha, beta = np.zeros(n_tokens + 1), np.zeros(n_tokens + 1)
            for j in range(1, n_tokens + 1):
                alpha[j] = _logsum(np.concatenate([[alpha[j - 1]], *[alpha[segs[s][0]] + scores[s] for s in ending.get(j, ())]]))
            for i in range(n_tokens - 1, -1, -1):
                beta[i] = _logsum(np.concatenate([[beta[i + 1]], *[beta[segs[s][1]] + scores[s] for s in starting.get(i, ())]]))
            for (i, j, fs), score in zip(segs, scores, strict=True):
                step = -np.exp(np.minimum(alpha[i] + score + beta[j] - alpha[n_tokens], 0))
                if (i, j) in gold:
                    step[gold[i, j]] += 1
                if np.abs(step).max() > 1e-4:
                    np.add.at(w, fs, rate * step)
        w *= 1 - SHRINK
    return {f: w[k] for f, k in number.items()}


_NONE = np.zeros(len(KINDS))


def decode(tokens: tuple[str, ...], weights: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """The likeliest entities of a window, as (first token, after last, type)."""
    best = [0.0] * (len(tokens) + 1)
    back: list[tuple[int, int] | None] = [None] * (len(tokens) + 1)
    ending: dict[int, list] = {}
    for i, j, fs in segments(list(tokens)):
        s = sum((weights.get(f, _NONE) for f in fs), _NONE)
        y = int(s.argmax())
        ending.setdefault(j, []).append((i, y, float(s[y])))
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, y, s in ending.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, y)
    out, j = [], len(tokens)
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, y = back[j]
            out.append((i, j, y))
            j = i
    return out[::-1]


def windows(text: str) -> Iterator[list[re.Match]]:
    """Tokens with digits or address signs, each with all that a segment can reach and the word before that; windows that overlap are one."""
    own: list[re.Match] = []
    quiet: list[re.Match] = []  # tokens since the last one with a digit or sign
    for m in TOKEN.finditer(text):
        if (_DIGIT.search(m[0]) or SIGN.search(m[0])) is None:
            quiet.append(m)
            continue
        if own and len(quiet) >= 2 * MOST_TOKENS - 1:
            yield own + quiet[: MOST_TOKENS - 1]
            own = []
        own += [*(quiet if own else quiet[-MOST_TOKENS:]), m]
        quiet = []
    if own:
        yield own + quiet[: MOST_TOKENS - 1]


def added(text: str, known: list[Span], labelled) -> list[Span]:
    """Entities of the field that no known span touches."""
    out = []
    taken = sorted((a, b) for _, a, b in known)
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    starts = [a for a, _ in taken]
    for own in windows(text):
        if sum(len(_DIGIT.findall(m[0])) for m in own) < NEED_DIGITS and not any(SIGN.search(m[0]) for m in own) and not any(m[0].count(".") >= 3 for m in own):
            continue
        for i, j, y in labelled(tuple(m[0] for m in own)):
            a, b = own[i].start(), own[j - 1].end()
            while b > a and text[b - 1] in ".,;:!?\"'":
                b -= 1
            while a < b and text[a] in "\"'":
                a += 1
            k = int(np.searchsorted(starts, b))
            if a < b and not (k and ends[k - 1] > a):
                out.append((ADDED[y], a, b))
    return out


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc`` (a struct of all other columns) and ``spans``, an array of (kind, start, end), by kind (base ones first), then start.

    Null and empty texts have no spans. Repeated rows each have theirs. An
    empty table gives no rows.
    """
    weights = field()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        order = {k: i for i, k in enumerate(KINDS + ADDED)}
        kept = lru_cache(KEPT_WINDOWS)(lambda tokens: decode(tokens, weights))

        def labelled(tokens: tuple[str, ...]) -> list[tuple[int, int, int]]:
            return kept(tokens) if sum(map(len, tokens)) <= KEPT_CHARS else decode(tokens, weights)

        for batch in batches:
            spans = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                own = base(text) if _DIGIT.search(text) or SIGN.search(text) else None
                own = own + added(text, own, labelled) if own is not None else []
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(own, key=lambda s: (order[s[0]], s[1], s[2]))])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(spans, kind)], ["doc", "spans"])

    given = with_text(docs, text_col)
    return given.mapInArrow(rows, schema_of(given, "doc", spans=SPANS))

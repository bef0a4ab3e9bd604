"""Packing: token windows filled by length combinations from non-negative least squares.

Documents are tokenized and packed where they are read, in groups of about
``GROUP_TOKENS`` tokens, so nothing is shuffled and memory is bounded by a
group (and by one document, however long). In a group, each document is cut
into whole windows and a rest. Rests fall into length classes of ``UNIT``
tokens. Combinations of up to ``DEPTH`` classes that fill a window are
enumerated; non-negative least squares against the histogram of classes says
how often to use each; the counts are rounded down, and pieces are dealt to
them. The pieces left over are packed greedily: they are cut to fill the gaps
that classes leave, then windows of their own. The last, partial window of a
group is cut into sequences whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import texts_to_python

WINDOW = 2048
UNIT = 32
DEPTH = 3
#: The id after each document.
END = 1
#: A group is packed when it has so many tokens.
GROUP_TOKENS = 2_000_000
#: Gaps under this many tokens stay as padding rather than take a shred of a document.
LEAST_CUT = 8


#: The added token of the vocabulary and its id (fixed).
ADDED = {"<|endoftext|>": 50256}


@cache
def _byte_bpe(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)


def byte_bpe_encoder(path: str | None = None) -> Callable[[str], list[int]]:
    """Token ids of a text by the public byte-level BPE with 50,257 ids, the string of its added token being that token.

    ``path`` is a file of base64 tokens and ranks, by default the installed
    one of the vocabulary in ``byte_bpe_50k.json``; tests compare the two.
    """
    import public_tokenizers as public

    encode = _byte_bpe(path or public.path("byte_bpe_50k.tiktoken"), public.PATTERN).encode
    return lambda text: encode(text, allowed_special="all")


def combinations(window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every choice of at most ``depth`` classes, largest first, that fills a window exactly."""
    full = window // unit

    def fill(room: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if room == 0:
            yield ()
        elif left:
            for k in range(min(room, most), 0, -1):
                for rest in fill(room - k, k, left - 1):
                    yield (k, *rest)

    return list(fill(full, full, depth))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(3 * n):
        w = atb - ata @ x
        w[passive] = -np.inf
        if passive.all() or w.max() <= tiny:
            break
        passive[int(w.argmax())] = True
        while True:
            own = np.flatnonzero(passive)
            s = np.linalg.lstsq(ata[np.ix_(own, own)], atb[own], rcond=None)[0]
            if (s > tiny * 1e-3).all():
                break
            low = s <= tiny * 1e-3
            gap = x[own][low] - s[low]
            step = min(1.0, float((x[own][low] / np.where(gap > 0, gap, 1)).min(initial=1.0)))
            x[own] += step * (s - x[own])
            passive[own[(x[own] <= tiny) & low]] = False
            x[~passive] = 0
            if not passive.any():
                break
        own = np.flatnonzero(passive)
        x[:] = 0
        if len(own):
            x[own] = np.maximum(s if len(s) == len(own) else 0, 0)
    return x


@cache
def _matrix(window: int, unit: int, depth: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    combos = combinations(window, unit, depth)
    a = np.zeros((window // unit, len(combos)))
    for j, combo in enumerate(combos):
        for k in combo:
            a[k - 1, j] += 1
    return combos, a


Piece = tuple[int, int, int]  # number of the document, start, length


def arrange(lengths: list[int], window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[list[Piece]]:
    """Sequences of pieces that together hold every token of documents of these lengths once."""
    out: list[list[Piece]] = []
    classes: dict[int, list[Piece]] = {}
    for d, n in enumerate(lengths):
        whole = n - n % window
        out += [[(d, at, window)] for at in range(0, whole, window)]
        if n % window:
            classes.setdefault(-(-(n % window) // unit), []).append((d, whole, n % window))
    combos, a = _matrix(window, unit, depth)
    counts = np.array([len(classes.get(k + 1, ())) for k in range(window // unit)], float)
    live = np.flatnonzero(((a > 0) <= (counts > 0)[:, None]).all(axis=0))
    partial: list[list[Piece]] = []
    if len(live):
        x = nnls(a[:, live], counts)
        for j in np.argsort(-x, kind="stable").tolist():
            combo = combos[live[j]]
            need = {k: combo.count(k) for k in combo}
            for _ in range(min(int(x[j] + 1e-6), *[len(classes[k]) // m for k, m in need.items()])):
                partial.append([classes[k].pop() for k in combo])
    left = sorted((p for own in classes.values() for p in own), key=lambda p: p[2])  # the largest last
    at = [sum(p[2] for p in own) for own in partial]

    def cut(own: list[Piece], room: int) -> int:
        """Fills a sequence from the pieces left over; returns the room that stays."""
        while room and left:
            d, start, n = left.pop()
            if n > room:
                left.append((d, start + room, n - room))
                n = room
            own.append((d, start, n))
            room -= n
        return room

    for own, filled in zip(partial, at, strict=True):
        if LEAST_CUT <= window - filled:
            cut(own, window - filled)
        out.append(own)
    rest = sum(p[2] for p in left)
    while rest >= window:
        own = []
        cut(own, window)
        out.append(own)
        rest -= window
    for bit in reversed(range(window.bit_length())):
        if rest >> bit & 1:
            own = []
            cut(own, 1 << bit)
            out.append(own)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, encoder: Callable[[], Callable[[str], list[int]]] = byte_bpe_encoder, end: int = END, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.

    A null text is empty; an empty text is the id ``end`` alone. Null ids
    stay null, and rows that share an id are documents of their own. Every
    token is in exactly one piece, offsets in a sequence have no gaps, and a
    sequence is as long as the window (short of it by fewer than
    ``LEAST_CUT`` tokens a gap) or a power of two. Sequence ids carry the
    number of the partition, so a rerun of a lost task gives the same ones.
    Repeated rows are packed each, and other columns are left out, whatever
    their names. An empty table gives no rows.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        sequence = TaskContext.get().partitionId() << 36
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            cols: list[list] = [[] for _ in names]
            for own in arrange([len(t) for t in tokens], window):
                offset = 0
                for d, start, n in own:
                    for col, v in zip(cols, (ids[d], start, n, tokens[d][start : start + n].astype("<u4").tobytes(), len(tokens[d]), sequence, offset), strict=True):
                        col.append(v)
                    offset += n
                sequence += 1
            ids.clear()
            tokens.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, cols, strict=True)], names)

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                own = np.array([*encode(text.as_py() or ""), end], np.uint32)
                ids.append(key)
                tokens.append(own)
                held += len(own)
                if held >= group_tokens:
                    yield flush()
        if ids:
            yield flush()

    return texts_to_python(docs).select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        rows, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )

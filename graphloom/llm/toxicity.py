"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Writers hide words by leetspeak, spacing and repetition. A suspicious stretch
of text becomes a lattice of the letters that each character may stand for
(a symbol for one or two letters or nothing, a separator for nothing, a run
of a letter for one or two of it); Viterbi decoding under a character trigram
model finds the likeliest word. The model's counts are taken over all
documents. Plain words have a lattice with a single path and are taken as
they are.

Words, restored ones and plain ones alike, are then scored by their stems
and whole forms: log odds learned from a bounded sample of the labelled
documents that aren't held out, squashed by a logistic fit on that sample.

Texts are searched as bytes, in blocks, with array operations; Python looks
only at suspicious stretches and at words that begin like a known feature.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from graphloom.llm.common import materialize, schema_of, texts_to_python, with_text

#: Labelled documents that the features are learned from, at most, by label (0, 1).
FIT_ROWS = (6000, 3000)
#: A feature needs so many toxic documents, and such log odds, taken so many standard errors low.
LEAST_SUPPORT, LEAST_ODDS, ERRORS = 3, 2.2, 1.64
#: Lengths in bytes of the stems that are features.
STEMS = (4, 5, 6, 7, 8, 10)
#: Letters of a whole word that is sought inside a spaced-out run of words; of longer ones the stems are.
LONGEST = 24
#: What a character may stand for beside itself (fixed values of common leetspeak).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Characters that may stand between the letters of a word and mean nothing.
SEPARATORS = " .-_*~'\""
#: Log probability of a symbol or separator that means nothing, and of a substitution.
DROPPED, SUBSTITUTED = math.log(1e-4), math.log(0.9)
#: Log probability that a letter that is there twice, or more often, is meant once.
REPEATED = (math.log(0.1), math.log(0.3))

LETTERS = "abcdefghijklmnopqrstuvwxyz"
_A = len(LETTERS) + 2  # 0: no letter; 27: a letter beyond ASCII
_CODE = bytes(1 + (b | 32) - 97 if 97 <= (b | 32) <= 122 and b < 128 else 27 if b >= 128 else 0 for b in range(256))
_LETTER = np.array([c > 0 for c in _CODE])
_SYMBOL = np.array([chr(b) in LEET for b in range(256)])
_SEPARATOR = np.array([chr(b) in SEPARATORS for b in range(256)])
_WORD = re.compile(rb"[A-Za-z\x80-\xff]{4,}")
#: Bytes that array operations look at together, about.
BLOCK = 1 << 21


def trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over all documents, by three codes (0: no letter, 1-26: a-z, 27: other letters)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_A**3, np.int64)
        for batch in batches:
            for block in _blocks(_lower(batch.column(0))):
                codes = np.frombuffer(b"\0\0".join([b"", *block, b""]).translate(_CODE), np.uint8).astype(np.int32)
                total += np.bincount((codes[:-2] * _A + codes[1:-1]) * _A + codes[2:], minlength=_A**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(_A**3)
    # as many rows as there are trigrams of 28 codes, however many documents
    for row in texts_to_python(docs).select(F.col(text_col).cast("string")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out.reshape(_A, _A, _A)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigrams interpolated with bigrams and single characters."""
    two, one = counts.sum(axis=0) + 0.1, counts.sum(axis=(0, 1)) + 1.0
    p1 = one / one.sum()
    p2 = (two + 5 * p1[None, :]) / (two + 5 * p1[None, :]).sum(axis=1, keepdims=True)
    p3 = (counts + 5 * p2[None, :, :]) / (counts + 5 * p2[None, :, :]).sum(axis=2, keepdims=True)
    return np.log(p3)


def _lower(texts: pa.Array) -> list[bytes | None]:
    return pc.utf8_lower(texts).cast(pa.binary()).to_pylist()


def _blocks(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for t in texts:
        own.append(t or b"")
        size += len(own[-1])
        if size >= BLOCK:
            yield own
            own, size = [], 0
    if own:
        yield own


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each place of a lower-case stretch, what it may stand for, with log probabilities."""
    out: list[list[tuple[str, float]]] = []
    for run in re.finditer(r"(.)\1*", stretch, re.DOTALL):
        c, n = run[1], len(run[0])
        if c in LEET:
            ways = [(x, SUBSTITUTED) for x in LEET[c]] + [("", DROPPED)]
        elif c.isalpha():
            ways = [(c, 0.0)]
        else:
            ways = [("", 0.0 if c in SEPARATORS else DROPPED)]
        if n == 1 or not (c in LEET or c.isalpha()):
            out.append(ways)
        else:
            out += [ways, ways + [("", REPEATED[n > 2])]]
    return out


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def decode(stretch: str, model: np.ndarray) -> str:
    """The likeliest word that a stretch stands for: Viterbi over (last two letters), ending at a word's end."""
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for ways in lattice(stretch.lower()):
        now: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (p, word) in paths.items():
            for x, cost in ways:
                c = _code(x) if x else None
                key, q = ((a, b), p + cost) if c is None else ((b, c), p + cost + model[a, b, c])
                if key not in now or q > now[key][0]:
                    now[key] = (q, word if c is None else (word, x))
        paths = now
    _, word = max(((p + model[a, b, 0], w) for (a, b), (p, w) in paths.items()), key=lambda pw: pw[0])
    out = []
    while word:
        word, x = word
        out.append(x)
    return "".join(reversed(out))


def stretches(text: bytes, at: np.ndarray, spaced: bool) -> Iterator[bytes]:
    """The stretches of a text around suspicious places: tokens, or runs of single characters."""
    end = -1
    for i in at.tolist():
        if i < end:
            continue
        a = i
        if spaced:
            b = i + 1
            while b + 1 < len(text) and _SEPARATOR[text[b]] and (_LETTER[text[b + 1]] or _SYMBOL[text[b + 1]]) and (b + 2 >= len(text) or not _LETTER[text[b + 2]]):
                b += 2
        else:
            while a > 0 and text[a - 1] > 32:
                a -= 1
            b = i + 1
            while b < len(text) and text[b] > 32:
                b += 1
        end = b
        yield text[a:b].strip(b".,;:?\"'()[]{}<>%&#*")


def suspicious(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a symbol beside a letter (a final ``!`` is none) or of a letter three times in a row, and places where single characters alternate with separators."""
    letter, symbol, separator = _LETTER[codes], _SYMBOL[codes], _SEPARATOR[codes]
    low = codes | 32
    leet = np.flatnonzero(symbol[:-1] & letter[1:]) if len(codes) > 1 else np.empty(0, np.int64)
    bang = codes == ord("!")
    last = symbol & ~bang  # a symbol after a letter, or after exclamation marks after one
    after = letter | bang
    leet = np.union1d(leet, np.flatnonzero(last[1:] & letter[:-1]) + 1) if len(codes) > 1 else leet
    leet = np.union1d(leet, np.flatnonzero(last[2:] & bang[1:-1] & after[:-2]) + 2) if len(codes) > 2 else leet
    thrice = np.flatnonzero((low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & letter[:-2] & (codes[:-2] < 128)) if len(codes) > 2 else leet[:0]
    mark = letter | symbol
    single = mark.copy()
    single[1:] &= ~mark[:-1]
    single[:-1] &= ~mark[1:]
    run = single[:-6] & single[2:-4] & single[4:-2] & single[6:] & separator[1:-5] & separator[3:-3] & separator[5:-1] if len(codes) > 6 else single[:0]
    return np.union1d(leet, thrice), np.flatnonzero(run)


def features(word: bytes) -> list[bytes]:
    """A word's features: its stems (with a hyphen), and itself."""
    return [word[:n] + b"-" for n in STEMS if len(word) >= n] + [word] if len(word) >= 4 else []


def restored(text: bytes, tokens: np.ndarray, spaced: np.ndarray, say) -> set[bytes]:
    """Words that the suspicious stretches of a text stand for."""
    out: set[bytes] = set()
    for s in stretches(text, tokens, False):
        if any(_LETTER[b] for b in s):
            out.add(say(s))
    for s in stretches(text, spaced, True):
        word = say(s)
        for i in range(max(1, len(word) - 3)):  # words may follow each other without a gap
            out.update(word[i:j] for j in range(i + 4, min(len(word), i + LONGEST) + 1))
            out.add(word[i:])  # a longer one is known by its stems
    return out


def _say(model: np.ndarray):
    @lru_cache(20_000)
    def say(stretch: bytes) -> bytes:
        return decode(stretch.decode("utf-8", "replace"), model).encode()

    return say


@dataclass
class Scorer:
    """Weights of features, the logistic's coefficients, and the character model."""

    weights: dict[bytes, float]
    model: np.ndarray
    beta: tuple[float, ...] = (0.3, 0.3, 0.3, 0.0, -4.0)

    def signs(self, texts: list[bytes | None]) -> Iterator[tuple[float, ...]]:
        """For each lower-case text: its strongest word, logs of how many words have a known feature and of their strength in all, and those per 100 words."""
        say = _say(self.model)

        @lru_cache(200_000)
        def weight(word: bytes) -> float:
            return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

        known = np.zeros(1 << 20, bool)
        for f in self.weights:
            known[_hash4(np.frombuffer(f[:4], np.uint8))[0]] = True
        for block in _blocks(texts):
            joined = b"\n".join([b"", *block, b""])
            codes = np.frombuffer(joined, np.uint8)
            starts = np.cumsum([1] + [len(t) + 1 for t in block])
            letter = _LETTER[codes]
            every = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
            begins = every[every + 4 <= len(codes)]
            begins = begins[known[_hash4(codes)[begins]]] if len(codes) >= 4 else begins[:0]
            tokens, spaced = suspicious(codes)
            cuts = [np.searchsorted(x, starts) for x in (begins, tokens, spaced, every)]
            for d in range(len(block)):
                (b0, b1), (t0, t1), (s0, s1), (w0, w1) = ((c[d], c[d + 1]) for c in cuts)
                words = {m[0] for i in begins[b0:b1].tolist() if (m := _WORD.match(joined, i))}
                if t1 > t0 or s1 > s0:
                    at = starts[d]
                    words |= restored(joined[at : starts[d + 1] - 1], tokens[t0:t1] - at, spaced[s0:s1] - at, say)
                strong = [w for x in words if (w := weight(x))]
                total = sum(strong)
                yield max(strong, default=0.0), math.log1p(len(strong)), math.log1p(total), 100.0 * total / (100 + w1 - w0)

    def score(self, signs: tuple[float, ...]) -> float:
        z = sum(b * x for b, x in zip(self.beta, (*signs, 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _hash4(codes: np.ndarray) -> np.ndarray:
    """A 20-bit hash of the four bytes from each place on."""
    c = codes.astype(np.uint32)
    four = c[:-3] | c[1:-2] << 8 | c[2:-1] << 16 | c[3:] << 24
    return (four * np.uint32(2654435761)) >> 12


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5 (a null id never is)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: tuple[int, int] = FIT_ROWS) -> Scorer:
    """A scorer from all texts (character model) and at most ``fit_rows`` labelled documents of each label that aren't held out.

    Labels without an id, without a label or without a document teach
    nothing; a document that has both labels teaches both, repeated labels
    teach once, and documents that share an id are each taught by its label.
    Null and empty texts hold no words. Without labels or documents the
    scorer knows no feature and calls nothing toxic. Other columns of either
    table have no effect.
    """
    model = log_model(trigrams(docs, text_col))
    marked = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(~held_out() & F.col("doc_id").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [marked.where(F.col("y") == y).distinct().orderBy(*order).limit(n) for y, n in enumerate(fit_rows)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = materialize(texts.join(F.broadcast(picked), "doc_id").select("text", "y"))  # fit_rows rows are broadcast at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say, counts = _say(model), (Counter(), Counter())
        for batch in batches:
            for text, y in zip(_lower(batch.column("text")), batch.column("y").to_pylist(), strict=True):
                text = text or b""
                words = set(_WORD.findall(text)) | restored(text, *suspicious(np.frombuffer(text, np.uint8)), say)
                counts[y].update({f for w in words for f in features(w)})
        both = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), *[pa.array([c[f] for f in both], pa.int64()) for c in counts]], ["f", "n0", "n1"])

    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = F.log((F.col("n1") + 0.5) / (seen.get(1, 0) + 1)) - F.log((F.col("n0") + 0.5) / (seen.get(0, 0) + 1))
    odds = odds - ERRORS * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    found = rows.mapInArrow(count, "f binary, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = found.where(F.col("n1") >= LEAST_SUPPORT).withColumn("w", odds).where(F.col("w") >= LEAST_ODDS)
    weights = {bytes(r["f"]): r["w"] for r in found.collect()}  # features of fit_rows documents at most
    return _fitted(Scorer(undominated(weights), model), rows)


def undominated(weights: dict[bytes, float]) -> dict[bytes, float]:
    """The features without those that never count, as a stem of theirs weighs as much."""
    stems = {f: [f[:n] + b"-" for n in STEMS if n < len(f.removesuffix(b"-"))] for f in weights}
    return {f: w for f, w in weights.items() if all(weights.get(s, -1.0) < w for s in stems[f])}


def fit(signs: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Coefficients of a logistic (the last is the constant) by Newton's method, drawn a little to the default."""
    x = np.column_stack([signs, np.ones(len(signs))])
    prior = np.array(Scorer.beta)
    beta, pull = prior.copy(), np.diag([0.5, 0.5, 0.5, 0.5, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ (beta - prior))
        beta = beta - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return tuple(beta.tolist())


def _fitted(scorer: Scorer, rows: DataFrame) -> Scorer:
    """The scorer with a logistic of the signs of the sample."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(scorer.signs(_lower(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), batch.column("y")], ["signs", "y"])

    got = rows.mapInArrow(signs, "signs array<double>, y int").collect()  # fit_rows rows at most
    y = np.array([r["y"] for r in got], float)
    if 0 < y.sum() < len(y):
        scorer.beta = fit(np.array([r["signs"] for r in got]), y)
    return scorer


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc`` (a struct of all other columns) and ``score``, from 0 to 1, and ``text`` if wanted.

    Null and empty texts have the score of no feature. Rows that repeat have
    equal scores. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # features of fit_rows documents and 28 ** 3 numbers, whatever the corpus

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            scores = [own.score(x) for x in own.signs(_lower(batch.column("text")))]
            text = {"text": batch.column("text")} if keep_text else {}
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "score": pa.array(scores, pa.float64()), **text})

    given = with_text(docs, text_col)
    text = {"text": T.StringType()} if keep_text else {}
    return given.mapInArrow(rows, schema_of(given, "doc", score=T.DoubleType(), **text))

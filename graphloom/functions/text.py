"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A sentence: text up to and with its closing marks; line ends separate too.
SENTENCE = r"[^.!?\n]+[.!?]*"
MENTION = r"[A-Z][a-z]{3,}"
BLANKS = " \n\t\r"


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def sentences(text: Column) -> Column:
    """The stripped, non-empty sentences of a text."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), 0), strip), lambda s: s != "")


def pack(pieces: Column, most: int, overlap: int = 0) -> Column:
    """Chunks of sentences: each takes sentences, a space after each, while its length allows ``most`` characters.

    A sentence that is longer is a chunk of its own. With ``overlap`` a chunk
    begins with so many last characters of the one before it, which may push
    it past ``most``.
    """

    def step(acc: Column, s: Column) -> Column:
        done = strip(acc["cur"])
        out = F.when(done != "", F.array_append(acc["out"], done)).otherwise(acc["out"])
        fresh = F.concat(s, F.lit(" "))
        if overlap > 0:
            fresh = F.when(F.size(out) > 0, F.concat(F.right(F.element_at(out, -1), F.lit(overlap)), F.lit(" "), s, F.lit(" "))).otherwise(fresh)
        fits = F.length(acc["cur"]) + F.length(s) <= most
        return F.when(fits, F.struct(F.concat(acc["cur"], s, F.lit(" ")).alias("cur"), acc["out"].alias("out"))).otherwise(F.struct(fresh.alias("cur"), out.alias("out")))

    def finish(acc: Column) -> Column:
        done = strip(acc["cur"])
        return F.when(done != "", F.array_append(acc["out"], done)).otherwise(acc["out"])

    empty = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(pieces, empty, step, finish)


def mentions(text: Column) -> Column:
    """Capitalised words, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(MENTION), 0)


def lines(text: Column) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda s: s != "")


#: What an answer that denies a relation begins with (a fixed pattern, in the language of the small model's prompts).
DENIES = r"(?iu)^(?:[-•]\s*)?(?:отсутств[\p{L}\p{N}_]*\s+(?:связ|отнош)[\p{L}\p{N}_]*|нет\s+(?:связ|отнош|информац|данн|сведен)[\p{L}\p{N}_]*)"
BULLET = r"^[-•]\s*"


def relation_text(answer: Column) -> Column:
    """An answer without its bullet, or null where it is blank, a dash, or begins by denying a relation."""
    core = F.regexp_replace(strip(answer), BULLET, "")
    empty = core.rlike(r"^\s*[-–—]?\s*$")
    return F.when(answer.isNotNull() & ~empty & ~core.rlike(DENIES), core)


def phrases(text: Column, most_words: int = 12) -> Column:
    """Every choice of a text's words in their order, punctuation removed, and the cleaned text itself.

    There are 2^w - 1 choices of w words; texts of more than ``most_words``
    words give runs of neighbouring words instead.
    """
    clean = strip(F.regexp_replace(text, r"\p{Punct}", ""))
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    n = F.size(words)
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.least(n, F.lit(most_words))) - 1)
    chosen = F.transform(masks, lambda m: F.array_join(F.filter(words, lambda w, i: m.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0), " "))
    starts = F.sequence(F.lit(1), n)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, F.least(n, i + most_words - 1)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    out = F.when(n == 0, F.array().cast("array<string>")).when(n <= most_words, chosen).otherwise(runs)
    return F.array_distinct(F.array_append(out, clean))


def named_by(name: Column, text: Column) -> Column:
    """Whether a name is a choice of a text's words in their order, or the text itself, as :func:`phrases` would list them; of texts of any length."""
    clean = strip(F.regexp_replace(text, r"\p{Punct}", ""))
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    own = F.split(name, " ")
    met = F.aggregate(words, F.lit(1), lambda at, w: F.when(F.get(own, at - 1) == w, at + 1).otherwise(at))
    return F.coalesce((name == clean) | ((met == F.size(own) + 1) & (name != "")), F.lit(False))


def first_tokens(text: Column, most: int) -> Column:
    """The first ``most`` tokens of a text, which white space separates; empty for a null or empty text.

    A pluggable tokenizer goes through :func:`graphloom.providers.truncate`.
    """
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.array_join(F.slice(tokens, 1, most), " ")


def render_list(items: Column, line) -> Column:
    """Lines made of an array's items, joined."""
    return F.array_join(F.transform(items, line), "\n")

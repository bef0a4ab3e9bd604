"""Chat formatting: conversations rebuilt from event logs, then rendered.

A log holds events of a message: ``start`` opens it (again), ``delta``
appends streamed text, ``edit`` replaces its text, ``regenerate`` empties it.
An edit or a regeneration of a turn also discards the later turns that were
there before it. The fold of a message is everything from its last reset on,
in order of sequence; a message lives if its last reset is later than every
edit or regeneration of an earlier turn.

Scale: events are dealt by ranges of ``RANGE`` turns and folded by message,
never by conversation. Which turns an edit discards is a prefix maximum over
turns, taken within ranges and over the ranges, so that a conversation with a
third of all rows is many groups. Rendering is per turn. Only a digest of a
whole conversation reads its turns in order, as a stream that holds one turn.
Texts pass two shuffles: one by range, one for the digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Fixed strings of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What begins a control string of this or another common template, after its first character.
CONTROL = r"\||/?s>|/?INST\]|</?SYS>>"
LEARNED_ROLE = "assistant"
#: Turns of a conversation that one group holds.
RANGE = 1024


def escape(text: Column) -> Column:
    """Text in which no control string begins: a backslash goes behind its first character, one more where there are some already."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


_ESCAPED = re.compile(rf"([<\[])\\(\\*)({CONTROL})")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with ``range`` and ``deal`` (a hash of conv_id and range), dealt by it: the one shuffle of texts that the log and its fold need."""
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-(2**62))))
    return rows.withColumn("deal", F.xxhash64("conv_id", "range")).repartition("deal")


def messages(events: DataFrame) -> DataFrame:
    """``conv_id, turn, nth, role, text`` of the messages that live at the end of a log.

    ``events``: conv_id, turn, nth (breaks ties of turn; 0 if there are
    none), seq (of any type that has an order), kind, role, text. A null text
    is empty, a null role is ''; a null conv_id is a conversation and a null
    turn is the first. The role is that of the message's last start. A
    message whose first event is a delta begins there. An unknown kind does
    nothing more than that. Events of equal seq in a message are folded by
    kind, then text. Other columns have no effect; an empty log has no
    messages.
    """
    return _fold(_dealt(events.select("conv_id", "turn", "nth", "seq", "kind", "role", "text")))


def _fold(events: DataFrame) -> DataFrame:
    """:func:`messages` of a log as :func:`_dealt` has it; what groups by ``deal`` needs no further shuffle."""
    reset = F.col("kind").isin("start", "edit", "regenerate")
    steers = F.col("kind").isin("edit", "regenerate")
    of = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    own = events.groupBy("deal", "conv_id", "range", "turn", "nth").agg(
        F.coalesce(F.max(F.when(reset, F.col("seq"))), F.min("seq")).alias("born"),
        F.max(F.when(steers, F.col("seq"))).alias("steered"),
        F.max_by("role", F.when(F.col("kind") == "start", F.col("seq"))).alias("role"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin("delta", "edit"), of))).alias("parts"),
    )
    fits = F.filter("parts", lambda p: p["seq"] >= F.col("born"))
    own = own.withColumn("text", F.array_join(F.transform(fits, lambda p: p["text"]), "")).drop("parts")
    inside = W.partitionBy("deal", "conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "nth").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("inside", F.max("steered").over(inside))
    # ranges with any edit or regeneration before them: none in a conversation of one range
    ranges = events.groupBy("deal", "conv_id", "range").agg(F.max(F.when(steers, F.col("seq"))).alias("steered"))
    over = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    upto = ranges.withColumn("before", F.max("steered").over(over)).where(F.col("before").isNotNull())
    upto = upto.select(F.col("deal").alias("d"), F.col("conv_id").alias("c"), F.col("range").alias("r"), "before")
    # the join's only equality is that of deal, by which the texts lie already
    same = F.when(F.col("c").isNull(), F.col("conv_id").isNull()).otherwise(F.col("conv_id") == F.col("c"))
    own = own.join(upto, (F.col("deal") == F.col("d")) & same & (F.col("range") >= F.col("r")) & (F.col("range") <= F.col("r")), "left")
    discards = F.greatest("before", "inside")
    own = own.where(F.coalesce(F.col("born") > discards, discards.isNull()))
    return own.select("conv_id", "turn", "nth", F.coalesce("role", F.lit("")).alias("role"), "text")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``messages(as_events(turns))``, dealt once."""
    return _fold(_log(_dealt(turns.select("conv_id", "turn", "role", "text"))))


def render(rows: DataFrame) -> DataFrame:
    """Messages with ``piece`` (the turn in the template) and ``loss_start, loss_end``, the code points of it that are learned from (equal if none).

    Roles and texts are not null here (:func:`messages` sees to that); an
    empty text is a turn with nothing between its marks, repeated turns are
    pieces each, and other columns stay. An empty table gives no rows.
    """
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    text = escape(F.col("text"))
    rows = rows.withColumn("piece", F.concat(head, text, F.lit(END))).withColumn("loss_start", F.length(head))
    return rows.withColumn("loss_end", F.when(F.col("role") == LEARNED_ROLE, F.col("loss_start") + F.length(text)).otherwise(F.col("loss_start")))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, or of some of its turns."""
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, _, text = turn.removesuffix(END).partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def digests(rendered: DataFrame) -> DataFrame:
    """What can be read back from each conversation's pieces: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Pieces are parsed where they lie; only what the digests take in is dealt
    by conversation, and streams through them there, turn by turn. A null
    conv_id is a conversation. Turns that share (turn, nth) go in any order.
    An empty table gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[list] = [[], [], [], [], []]
            for piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("piece", "loss_start", "loss_end")), strict=True):
                turns = parse(piece)
                said, learned = "".join(f"{role}\n{text}\n" for role, text in turns), unescape(piece[a:b])
                # what is learned is mostly the end of what is said, and then sent as a length
                ends = said[:-1].endswith(learned)
                for col, v in zip(own, (said, None if ends else learned, len(learned), len(turns), len(piece)), strict=True):
                    col.append(v)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "turn", "nth")], *[pa.array(c, k) for c, k in zip(own, kinds, strict=True)]], ["conv_id", "turn", "nth", "said", "learned", "n_learned", "n", "chars"])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, state = None, None

        def close() -> None:
            if state:
                done.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 6, kinds, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            for conv, said, learned, n_learned, n, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "said", "learned", "n_learned", "n", "chars")), strict=True):
                if learned is None:
                    learned = said[len(said) - 1 - n_learned : -1] if n_learned else ""
                if state is None or conv != at:
                    close()
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(said.encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += chars
            yield flush()
        close()
        yield flush()

    own = rendered.select("conv_id", "turn", "nth", "piece", "loss_start", "loss_end")
    order = own.schema
    fields = ", ".join(f"{c} {order[c].dataType.simpleString()}" for c in ("conv_id", "turn", "nth"))
    rows = own.mapInArrow(read, f"{fields}, said string, learned string, n_learned long, n long, chars long").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "nth")
    return rows.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Where a discarded message of a turn is put: behind all others of the turn.
ABANDONED = 2**32


def as_events(turns: DataFrame, chunk: int = 512) -> DataFrame:
    """A log of how turns (conv_id, turn, role, text) may have come about, which the fold must undo.

    By a hash of its place, a turn is streamed in deltas of ``chunk`` code
    points at once; or streamed otherwise first and regenerated; or begun
    with other words, edited to its first chunk, and streamed on; or left for
    a later message, which an edit of the turn to its whole text discards.
    ``seq`` is (turn, nth, step). Rows that share (conv_id, turn) are turns
    of their own, by role and text; null roles and texts are kept as such.
    Other columns are left out. An empty table gives an empty log.
    """
    return _log(_dealt(turns.select("conv_id", "turn", "role", "text")), chunk).drop("range", "deal")


def _log(turns: DataFrame, chunk: int = 512) -> DataFrame:
    """:func:`as_events` of turns as :func:`_dealt` has them, which its events stay."""
    nth = F.row_number().over(W.partitionBy("deal", "conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).cast("long")
    rows = turns.withColumn("text", F.col("text").cast("string")).withColumn("nth", nth).withColumn("text", F.coalesce("text", F.lit("")))
    starts = F.sequence(F.lit(1), F.ceil(F.length("text") / chunk).cast("int") * chunk + 1, F.lit(chunk))
    deltas = F.transform(starts, lambda a: F.struct(F.lit(0).cast("long").alias("place"), F.lit("delta").alias("kind"), F.substring(F.col("text"), a, F.lit(chunk)).alias("text")))

    def event(kind: str, text: Column | None = None, place: int = 0) -> Column:
        return F.array(F.struct(F.lit(place).cast("long").alias("place"), F.lit(kind).alias("kind"), (F.lit("") if text is None else text).alias("text")))

    draft = F.concat(F.lit("draft "), F.reverse(F.substring("text", 1, 64)))
    rest = F.slice(deltas, 2, F.size(deltas))
    ways = [
        F.concat(event("start"), deltas),
        F.concat(event("start"), event("delta", draft), event("regenerate"), deltas),
        F.concat(event("start"), event("delta", draft), event("edit", F.substring("text", 1, chunk)), rest),
        F.concat(event("start"), event("delta", draft), event("start", None, ABANDONED), event("delta", F.col("text"), ABANDONED), event("edit", F.col("text"))),
    ]
    way = F.pmod(F.xxhash64("conv_id", "turn", "nth"), F.lit(len(ways)))
    log = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    rows = rows.select("deal", "range", "conv_id", "turn", "nth", "role", F.posexplode(log).alias("step", "e"))
    seq = F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "nth", "step")
    return rows.select("deal", "range", "conv_id", "turn", (F.col("nth") + F.col("e.place")).alias("nth"), "role", seq.alias("seq"), "e.kind", "e.text")

"""Models behind the graph: language models, embedders and tokenizers, called from executors.

A provider is a small picklable object; it is set up once per Python worker.
Rows carry their inputs through a call, so an answer can never meet another
row's input. Callers write what a model returned before using it twice:
Spark may run a task again, and a call is never free.

A worker keeps up to ``in_flight`` calls going, in threads. A gate spaces
them out over one-second and one-minute windows; as it can't be shared by
machines, each partition gets its part of the quota. A failed call is logged,
leaves a null and, if a column is asked for, its error.
"""

from __future__ import annotations

import json
import logging
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, is_dataclass, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.functions.batches import in_small_batches
from graphloom.operators.chunking import hashed_embedding


log = logging.getLogger("graphloom")


class Model(Protocol):
    """One answer, as text, or None for each prompt."""

    def __call__(self, prompts: list[str]) -> list[str | None]: ...


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


@dataclass
class RateGate:
    """Spaces out calls so that one partition keeps to its share of a quota."""

    per_second: float | None = None
    per_minute: float | None = None
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _next: float | None = None
    _lock: threading.Lock | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_lock": None}

    def share(self, partitions: int) -> RateGate:
        """The gate of one of so many partitions."""
        def part(q: float | None) -> float | None:
            return None if q is None else q / max(1, partitions)

        return RateGate(part(self.per_second), part(self.per_minute), self.clock, self.sleep)

    def wait(self) -> None:
        """Returns when another call may start; threads queue."""
        gap = max([0.0, *(w / q for w, q in ((1.0, self.per_second), (60.0, self.per_minute)) if q)])
        self._lock = self._lock or threading.Lock()
        with self._lock:
            now = self.clock()
            if self._next is not None and now < self._next:
                self.sleep(self._next - now)
                now = self._next
            self._next = now + gap


def shared(provider, partitions: int):
    """A provider whose gate, or whose inner provider's, has one partition's part of the quota."""
    if not is_dataclass(provider):
        return provider
    changes = {"gate": provider.gate.share(partitions)} if isinstance(getattr(provider, "gate", None), RateGate) else {}
    if callable(getattr(provider, "model", None)):
        changes["model"] = shared(provider.model, partitions)
    return replace(provider, **changes) if changes else provider


@dataclass
class Retrying:
    """A model that tries failed calls again, doubling the pause from ``first`` to ``last`` seconds; the last failure is raised."""

    model: Model
    tries: int = 3
    first: float = 4.0
    last: float = 10.0
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, prompts: list[str]) -> list[str | None]:
        for k in range(self.tries):
            try:
                return self.model(prompts)
            except Exception as e:
                log.warning("call failed (%d of %d): %s", k + 1, self.tries, e)
                if k + 1 == self.tries:
                    raise
                self.sleep(min(self.last, self.first * 2**k))
        return [None] * len(prompts)


def _post(url: str, key: str, body: dict, timeout: float) -> dict:
    from urllib.request import Request, urlopen

    head = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
    with urlopen(Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
        return json.load(r)


@dataclass
class HttpModel:
    """A chat model behind an OpenAI-compatible endpoint; one request per prompt, and an exception where one fails."""

    url: str
    model: str
    key: str = ""
    system: str = ""
    timeout: float = 60.0
    gate: RateGate = field(default_factory=lambda: RateGate(1, 60))

    def __call__(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            self.gate.wait()
            turns = [{"role": "system", "content": self.system}] * bool(self.system) + [{"role": "user", "content": p}]
            got = _post(f"{self.url.rstrip('/')}/chat/completions", self.key, {"model": self.model, "messages": turns, "temperature": 0}, self.timeout)
            out.append(got["choices"][0]["message"]["content"])
        return out


@dataclass
class HttpEmbedder:
    """An embedder behind an OpenAI-compatible endpoint; a text per request unless ``batched``."""

    url: str
    model: str
    dim: int
    key: str = ""
    timeout: float = 60.0
    gate: RateGate = field(default_factory=lambda: RateGate(1, 60))
    batched: bool = False

    def __call__(self, texts: list[str]) -> np.ndarray:
        out: list = []
        for own in [texts] if self.batched else [[t] for t in texts]:
            self.gate.wait()
            got = _post(f"{self.url.rstrip('/')}/embeddings", self.key, {"model": self.model, "input": own}, self.timeout)
            out += [d["embedding"] for d in sorted(got["data"], key=lambda d: d.get("index", 0))]
        return np.array(out)


@dataclass
class LocalEmbedder:
    """A sentence-embedding model on the worker: ``name`` for the library of that kind, if it is installed there."""

    name: str
    dim: int
    batch: int = 16

    def __call__(self, texts: list[str]) -> np.ndarray:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("LocalEmbedder needs sentence-transformers on the workers") from e
        if not hasattr(self, "_model"):
            self._model = SentenceTransformer(self.name)
        return self._model.encode(texts, batch_size=self.batch)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_model"}


@dataclass
class OnnxEmbedder:
    """A sentence-embedding model in ONNX form with its tokenizer file: the mean of the last hidden states, of unit length."""

    model: str
    tokenizer: str
    dim: int
    most_tokens: int = 512

    def __call__(self, texts: list[str]) -> np.ndarray:
        import onnxruntime
        from tokenizers import Tokenizer as Own

        if not hasattr(self, "_run"):
            self._run, self._tok = onnxruntime.InferenceSession(self.model), Own.from_file(self.tokenizer)
            self._tok.enable_truncation(self.most_tokens)
            self._tok.enable_padding()
        got = self._tok.encode_batch(texts)
        given = {"input_ids": np.array([e.ids for e in got]), "attention_mask": np.array([e.attention_mask for e in got]), "token_type_ids": np.array([e.type_ids for e in got])}
        names = {i.name for i in self._run.get_inputs()}
        hidden = self._run.run(None, {k: v for k, v in given.items() if k in names})[0]
        mask = given["attention_mask"][:, :, None]
        mean = (hidden * mask).sum(axis=1) / np.maximum(1, mask.sum(axis=1))
        return mean / np.maximum(1e-12, np.linalg.norm(mean, axis=1, keepdims=True))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_run", "_tok")}


@dataclass
class TiktokenTokenizer:
    """Tokens of an encoding of the tiktoken library, by name, or of a file of base64 tokens and ranks with its pattern."""

    name: str = "cl100k_base"
    ranks: str | None = None
    pattern: str = ""

    def _own(self):
        import base64

        import tiktoken

        if not hasattr(self, "_encoding"):
            if self.ranks is None:
                self._encoding = tiktoken.get_encoding(self.name)
            else:
                with open(self.ranks, "rb") as f:
                    held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=held, special_tokens={})
        return self._encoding

    def encode(self, text: str) -> list[int]:
        return self._own().encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self._own().decode(ids)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_encoding"}


@dataclass
class FileTokenizer:
    """Tokens of a tokenizer file of the tokenizers library."""

    path: str

    def _own(self):
        from tokenizers import Tokenizer as Own

        if not hasattr(self, "_tok"):
            self._tok = Own.from_file(self.path)
        return self._tok

    def encode(self, text: str) -> list[int]:
        return self._own().encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self._own().decode(ids)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tok"}


@dataclass
class HashEmbedder:
    """A deterministic embedder from character trigrams, for tests and dry runs."""

    dim: int = 64

    def __call__(self, texts: list[str]) -> np.ndarray:
        return hashed_embedding(texts, self.dim)


@dataclass
class RuleModel:
    """A deterministic stand-in for a model: capitalised words after the marker are entities, neighbours are related."""

    marker: str = "TEXT:"

    def __call__(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            names = list(dict.fromkeys(re.findall(r"[A-Z][a-z]{3,}", p.rpartition(self.marker)[2])))
            entities = [{"entity_name": n, "entity_type": "TERM", "description": f"{n} is mentioned"} for n in names]
            relations = [{"source_entity": a, "target_entity": b, "description": f"{a} is near {b}", "relationship_strength": 1} for a, b in zip(names, names[1:], strict=False)]
            out.append(json.dumps({"entities": entities, "relations": relations}))
        return out


def _called(provider, inputs: list, batch: int, in_flight: int) -> tuple[list, list]:
    """Results and errors of a provider over inputs (None: not asked); a batch that fails is tried again one by one."""
    out: list = [None] * len(inputs)
    errors: list = [None] * len(inputs)
    asked = [i for i, x in enumerate(inputs) if x is not None]

    def some(at: list[int]) -> None:
        try:
            for i, x in zip(at, provider([inputs[i] for i in at]), strict=True):
                out[i] = x
        except Exception as e:
            if len(at) > 1:
                for i in at:
                    some([i])
            else:
                errors[at[0]] = f"{type(e).__name__}: {e}"
                log.warning("no answer: %s", errors[at[0]])

    parts = [asked[a : a + batch] for a in range(0, len(asked), batch)]
    if in_flight > 1 and len(parts) > 1:
        with ThreadPoolExecutor(in_flight) as pool:
            list(pool.map(some, parts))
    else:
        for at in parts:
            some(at)
    return out, errors


def generate(rows: DataFrame, prompt: str, answer: str, model: Model, batch: int = 1, in_flight: int = 8, error: str | None = None, partitions: int | None = None) -> DataFrame:
    """``rows`` with the model's answer to the prompt column; null for a null prompt or a failed call, whose reason is in ``error``, if wanted.

    Up to ``in_flight`` calls of ``batch`` prompts run at once in a worker.
    Where the model has a gate, rows are dealt into ``partitions`` (the
    session's parallelism by default), each with its part of the quota.
    """
    if partitions is None and shared(model, 1) is not model:
        partitions = rows.sparkSession.sparkContext.defaultParallelism
    if partitions is not None:
        rows, model = rows.repartition(partitions), shared(model, partitions)
    schema = T.StructType([*rows.schema.fields, T.StructField(answer, T.StringType()), *([T.StructField(error, T.StringType())] if error else [])])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            got, errors = _called(model, own[prompt].tolist(), batch, in_flight)
            own[answer] = got
            if error:
                own[error] = errors
            yield own

    return in_small_batches(rows).mapInPandas(call, schema)


def statistics(rows: DataFrame, prompt: str, answer: str) -> DataFrame:
    """One row: how many calls there were, how many succeeded and failed, and the words sent and received."""
    def words(c: str):
        return F.sum(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")))

    own = rows.where(F.col(prompt).isNotNull())
    done = F.count(answer)
    return own.agg(F.count(F.lit(1)).alias("requests"), done.alias("succeeded"), (F.count(F.lit(1)) - done).alias("failed"), F.coalesce(words(prompt), F.lit(0)).alias("words_sent"), F.coalesce(words(answer), F.lit(0)).alias("words_received"))


def parsed(rows: DataFrame, answer: str, schema: T.DataType, into: str) -> DataFrame:
    """``rows`` with the answer read as JSON; null where it can't be."""
    return rows.withColumn(into, F.from_json(answer, schema))


def embed(rows: DataFrame, text: str, vector: str, embedder: Embedder, batch: int = 16, in_flight: int = 8, partitions: int | None = None) -> DataFrame:
    """``rows`` with the vector of the text column; null for null texts and failed calls (of a batch that fails, only for the texts that do)."""
    if partitions is None and shared(embedder, 1) is not embedder:
        partitions = rows.sparkSession.sparkContext.defaultParallelism
    if partitions is not None:
        rows, embedder = rows.repartition(partitions), shared(embedder, partitions)
    schema = T.StructType([*rows.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            got, _ = _called(embedder, own[text].tolist(), batch, in_flight)
            own[vector] = [None if v is None else [float(x) for x in v] for v in got]
            yield own

    return in_small_batches(rows).mapInPandas(call, schema)


def truncate(rows: DataFrame, text: str, most: int, tokenizer: Tokenizer) -> DataFrame:
    """``rows`` with a text column cut to its first ``most`` tokens; a null text becomes empty."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            own[text] = [tokenizer.decode(tokenizer.encode(t)[:most]) if t else "" for t in own[text]]
            yield own

    return in_small_batches(rows).mapInPandas(cut, rows.schema)

"""Where models plug in: batched embedders, rerankers and query expanders behind pandas UDFs."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.subword import Subwords
from larkspur.functions.vectors import QUERY_PREFIX
from larkspur.sources.memo import Memo


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class QueryExpander(Protocol):
    def expand(self, question: str) -> list[str]: ...


def embed_column(text: Column, load: Callable[[], Embedder], *, query: bool = False, batch: int = 32) -> Column:
    """Vectors of a text column. load runs once for each task, so a model is read once, lazily."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out = []
            for i in range(0, len(part), batch):
                texts = part.iloc[i : i + batch].fillna("").tolist()
                vectors = [model.embed_query(t) for t in texts] if query else model.embed(texts)
                if any(len(v) != model.dim for v in vectors):
                    raise ValueError("dimension mismatch")
                out += [np.asarray(v, np.float32) for v in vectors]
            yield pd.Series(out, dtype=object)

    return run(text)


def rerank_column(query: Column, text: Column, load: Callable[[], Reranker], *, batch: int = 16) -> Column:
    """Scores of (query, text) pairs, in batches of one query."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in parts:
            out = pd.Series(np.nan, index=queries.index)
            for q, at in queries.groupby(queries).groups.items():
                for i in range(0, len(at), batch):
                    some = at[i : i + batch]
                    scores = model.score(q, texts.loc[some].tolist())
                    if len(scores) != len(some):
                        raise ValueError("a reranker returns one score for each text")
                    out.loc[some] = scores
            yield out

    return run(query, text)


@dataclass
class _Onnx:
    """A model in a local ONNX file, read at its first use, with a vocabulary (a file of pieces) or an encode of one's own, that turns texts into the model's inputs."""

    path: str
    vocabulary: str | None = None
    encode: Callable[[list], dict[str, np.ndarray]] | None = None
    most: int = 512
    lower: bool = True
    _session: object = field(default=None, repr=False)
    _pieces: Subwords | None = field(default=None, repr=False)

    def _inputs(self, texts: list, kind: str) -> dict[str, np.ndarray]:
        if self.encode is not None:
            return self.encode(texts)
        if self.vocabulary is None:
            raise ValueError("a model needs a vocabulary or an encode")
        if self._pieces is None:
            self._pieces = Subwords(self.vocabulary, self.lower, self.most)
        return getattr(self._pieces, kind)(texts)

    def _run(self, inputs: dict[str, np.ndarray]) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        known = {x.name for x in self._session.get_inputs()}
        return np.asarray(self._session.run(None, {k: v for k, v in inputs.items() if k in known})[0], float)


@dataclass
class OnnxEmbedder(_Onnx):
    """A sentence encoder: mean over tokens, unit length; queries get a prefix."""

    dim: int = 512
    name: str = "onnx"
    prefix: str = QUERY_PREFIX

    def embed(self, texts: list[str]) -> list[list[float]]:
        inputs = self._inputs(texts, "texts")
        mask = inputs["attention_mask"][:, :, None]
        mean = (self._run(inputs) * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
        norm = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
        return (mean / np.where(norm == 0, 1, norm)).astype(np.float32).tolist()

    def embed_query(self, text: str) -> list[float]:
        return self.embed([self.prefix + text])[0]


@dataclass
class OnnxReranker(_Onnx):
    """A cross-encoder; raw logits."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        return self._run(self._inputs([(query, t) for t in texts], "pairs")).reshape(-1).tolist()


@dataclass
class MapExpander:
    """Variants from a table; the question itself comes first."""

    variants: dict[str, list[str]]

    def expand(self, question: str) -> list[str]:
        return [question, *self.variants.get(question, [])]


@dataclass
class LlmExpander:
    """Variants from a language model: complete(system, prompt) returns JSON text. kind: rewrite (one to three lists of terms) or hyde (a passage)."""

    complete: Callable[[str, str], str]
    kind: str = "rewrite"

    def expand(self, question: str) -> list[str]:
        wants = {"rewrite": "Rewrite the question as search terms of its field. Answer with JSON: {\"rewrites\": [one to three strings]}.", "hyde": "Write a short textbook passage that answers the question. Answer with JSON: {\"passage\": a string of 20 to 400 characters}."}
        found = json.loads(self.complete(wants[self.kind], question))
        if self.kind == "hyde":
            if not 20 <= len(found["passage"]) <= 400:
                raise ValueError("a passage has 20 to 400 characters")
            return [question, found["passage"]]
        if not 1 <= len(found["rewrites"]) <= 3 or any(len(x) < 2 for x in found["rewrites"]):
            raise ValueError("one to three rewrites of two characters or more")
        return [question, *found["rewrites"]]


def expand_questions(questions: DataFrame, expander: QueryExpander, memo: Memo | None = None, batch: str = "expansions") -> DataFrame:
    """(qid, query) to (qid, variant, query); each distinct question is expanded once, on the workers.

    With a memo (key `text`, fields `variants array<string>`), questions that an earlier run or another plan expanded aren't asked again; that runs a job, and a null question is its own only variant.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"text": part["text"], "variants": [expander.expand(t) for t in part["text"]]})

    once = questions.select(F.col("query").alias("text")).distinct()
    expand = lambda rows: rows.select("text").mapInPandas(run, "text string, variants array<string>")
    once = expand(once) if memo is None else memo.answered(once, expand, batch)
    rows = questions.select("qid", F.col("query").alias("asked")).join(once, F.col("asked").eqNullSafe(F.col("text")))
    return rows.select("qid", F.posexplode(F.coalesce("variants", F.array("asked"))).alias("variant", "query"))


def embed_missing(chunks: DataFrame, memo: Memo, load: Callable[[], Embedder], batch: str) -> DataFrame:
    """Chunks (with chunk_id and text) with their vectors; the model embeds only those that the memo (key `chunk_id`, fields `embedding array<float>`) lacks, and the memo keeps them."""
    return memo.answered(chunks, lambda rows: rows.select("chunk_id", embed_column(F.col("text"), load).alias("embedding")), batch)


@dataclass(frozen=True)
class Settings:
    """What generation needs, from the environment."""

    api_key: str = field(default_factory=lambda: os.environ.get("LLM_API_KEY", ""), repr=False)
    base_url: str = field(default_factory=lambda: os.environ.get("LLM_BASE_URL", ""))
    model: str = field(default_factory=lambda: os.environ.get("LLM_MODEL", ""))

    def require_key(self) -> str:
        key = self.api_key.strip()
        if key in ("", "your-api-key", "sk-xxx", "changeme"):
            raise ValueError("LLM_API_KEY is not set")
        if len(key) < 16:
            raise ValueError("LLM_API_KEY is too short to be a key")
        return key

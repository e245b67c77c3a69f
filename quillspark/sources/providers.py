"""Models behind an interface: embeddings and answers in Arrow batches, with offline stand-ins.

A provider is made once for each partition, on the executor, by a factory without arguments; clients need not pickle.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.prompts import history


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str], task: str) -> list[np.ndarray]: ...


class Answerer(Protocol):
    model_name: str
    provider_name: str

    def generate(self, prompt: str, system: str | None = None) -> str: ...

    def count_tokens(self, text: str) -> int: ...


class HashEmbedder:
    """Offline: words by the first 8 hex digits of their md5 into buckets, signed by the ninth, normalised."""

    #: Words whose places are held.
    PLACES = 50_000

    def __init__(self, dimension: int = 64):
        self.dimension, self.places = dimension, {}

    def _place(self, token: str) -> tuple[int, int]:
        if token not in self.places:
            if len(self.places) >= self.PLACES:
                self.places.clear()
            h = hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()
            self.places[token] = int(h[:8], 16) % self.dimension, 1 if h[8] in "01234567" else -1
        return self.places[token]

    def embed(self, texts: list[str], task: str = "retrieval_document") -> list[np.ndarray]:
        import regex

        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for token in regex.findall(r"[\p{L}\p{N}_]+", text.lower()):
                at, sign = self._place(token)
                v[at] += sign
            norm = np.linalg.norm(v)
            out.append(v / norm if norm else v)
        return out


class ExtractiveAnswerer:
    """Offline: the sentence of the prompt's first chunk that shares most words with the question, with the chunk's number."""

    model_name, provider_name = "extractive", "local"

    def generate(self, prompt: str, system: str | None = None) -> str:
        import re

        asked = re.findall(r"(?:Pergunta|Caso): (.*)", prompt)
        want = set(re.findall(r"\w+", asked[-1].lower())) if asked else set()
        chunk = re.search(r"\[Trecho (\d+)\]\n(.*?)(?=\n\n|\Z)", prompt, re.S)
        if not chunk:
            return "Não encontrei essa informação nos documentos consultados."
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", chunk[2].strip()) if s]
        best = max(sentences, key=lambda s: len(want & set(re.findall(r"\w+", s.lower()))), default="")
        return f"{best} [Trecho {chunk[1]}]"

    def count_tokens(self, text: str) -> int:
        return len(text) // 4


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hash": HashEmbedder}
ANSWERERS: dict[str, Callable[[], Answerer]] = {"extractive": ExtractiveAnswerer}


def create(kind: dict, name: str) -> Callable:
    """The factory of a registered provider."""
    if name not in kind:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(kind))}")
    return kind[name]


def embed(df: DataFrame, make: Callable[[], Embedder] = HashEmbedder, text: str = "text", out: str = "vector", task: str = "retrieval_document", batch: int = 100, delay: float = 0.0) -> DataFrame:
    """df with a vector for each text (null: empty). A batch that fails is tried again text by text; a text that fails gets a zero vector."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()

        def checked(texts: list[str]) -> list[np.ndarray]:
            found = model.embed(texts, task)
            if len(found) != len(texts) or any(len(v) != model.dimension for v in found):
                raise ValueError("wrong number of vectors or dimensions")
            return found

        def one(t: str) -> np.ndarray:
            try:
                return checked([t])[0]
            except Exception:  # noqa: BLE001 - whatever a remote model raises
                return np.zeros(model.dimension)

        # Texts become Python strings, and vectors rows, a batch of the model at a time.
        for whole in frames:
            for i in range(0, len(whole), batch):
                rows = whole.slice(i, batch)
                part = [t or "" for t in rows.column(text).to_pylist()]
                try:
                    vectors = checked(part)
                except Exception:  # noqa: BLE001
                    vectors = list(map(one, part))
                if delay:
                    time.sleep(delay)
                yield rows.append_column(out, pa.array([np.asarray(v, float) for v in vectors], pa.list_(pa.float64())))

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != out)
    return df.select(*(c for c in df.columns if c != out)).mapInArrow(run, f"{fields}, `{out}` array<double>")


def answer(df: DataFrame, make: Callable[[], Answerer] = ExtractiveAnswerer, prompt: str = "prompt", system: str | None = None) -> DataFrame:
    """df with answer, error (null if none), tokens and latency_ms; a prompt that fails leaves its error and the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = []
            for p in frame[prompt].fillna(""):
                start = time.perf_counter()
                try:
                    said, error = model.generate(p, system), None
                except Exception as e:  # noqa: BLE001
                    said, error = None, f"{type(e).__name__}: {e}"
                rows.append((said, error, model.count_tokens(p) + model.count_tokens(said or ""), (time.perf_counter() - start) * 1000))
            found = pd.DataFrame(rows, columns=["answer", "error", "tokens", "latency_ms"], index=frame.index)
            yield pd.concat([frame, found], axis=1)

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(run, f"{fields}, answer string, error string, tokens long, latency_ms double")


def chat(conversations: DataFrame, make: Callable[[], Answerer] = ExtractiveAnswerer, id: str = "conv_id") -> DataFrame:
    """The model's reply to the last turn of each conversation (id, turn, role, text): one call for each, with the turns before it in the prompt."""
    return answer(history(conversations, id).select(id, "n_turns", "prompt"), make)

"""Embedding providers: models behind one interface, with a deterministic local default."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE, QUERY = "passage: ", "query: "


class Provider(Protocol):
    """Made once in each worker; ``embed`` takes a batch of texts."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        x = (x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Hashing:
    """Signed feature hashing of words and word pairs into unit vectors.

    Words are runs of ASCII letters, digits and underscores and of characters beyond ASCII; all
    words of a batch are hashed at once from the bytes of its lower-cased texts."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.inside = np.array([b >= 128 or b == 95 or chr(b).isalnum() for b in range(256)])

    def embed(self, texts: list[str]) -> np.ndarray:
        raw = [t.lower().encode() + b" " for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = self.inside[data]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = np.searchsorted(np.cumsum([len(r) for r in raw]), start, "right") if len(start) else start
        size = end - start
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        letters = _mixed(data[np.repeat(start, size) + place].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1))
        with np.errstate(over="ignore"):
            words = _mixed(np.add.reduceat(letters, np.cumsum(size) - size)) if len(size) else np.zeros(0, np.uint64)
            pairs = _mixed(words[:-1] * np.uint64(3) + words[1:])[row[1:] == row[:-1]]
        features, rows = np.concatenate([words, pairs]), np.concatenate([row, row[1:][row[1:] == row[:-1]]])
        slot = rows * self.dim + ((features >> np.uint64(1)) % np.uint64(self.dim)).astype(np.int64)
        out = np.bincount(slot, 1.0 - 2.0 * (features & np.uint64(1)).astype(float), len(texts) * self.dim).reshape(len(texts), self.dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class Hosted:
    """A hosted model: ``send`` posts a payload and gives the parsed answer, in whichever of the usual
    shapes; texts go in one call and answers must be of ``dim`` numbers."""

    def __init__(self, send: Callable[[dict], object], model: str, dim: int = 768, task: str = "query"):
        self.send, self.model, self.dim, self.task = send, model, dim, task

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.array([self._numbers(x) for x in self._vectors(self.send({"model": self.model, "task": self.task, "input": texts}))], float)
        if out.shape != (len(texts), self.dim):
            raise ValueError(f"expected {len(texts)} vectors of {self.dim} numbers, got {out.shape}")
        return out

    def _vectors(self, answer: object) -> list:
        """The list of vectors in an answer, or one vector as a list of one."""
        for key in ("embeddings", "data", "embedding"):
            if isinstance(answer, dict) and key in answer:
                answer = answer[key]
        if isinstance(answer, dict):
            return [answer]
        return answer if answer and not isinstance(answer[0], (int, float)) else [answer]

    def _numbers(self, item: object) -> list[float]:
        while isinstance(item, dict):
            item = next((item[k] for k in ("embedding", "values", "vector") if k in item), None)
        return list(item or ())


def retried(call: Callable[[], object], *, attempts: int = 4, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result, after at most ``attempts`` tries with growing jittered pauses."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(pause * 2**k * (1 + random.random()))


def embed_batch(provider: Provider, texts: list[str], *, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> np.ndarray:
    """A batch at once; if that fails, one text at a time with retries."""
    try:
        return provider.embed(texts)
    except Exception:
        return np.vstack([retried(lambda t=t: provider.embed([t]), attempts=attempts, sleep=sleep) for t in texts]) if texts else np.zeros((0, provider.dim))


def with_vectors(docs: DataFrame, make: Callable[[], Provider] = Hashing, *, text: str = "text", prefix: str = PASSAGE, batch: int = 128) -> DataFrame:
    """``docs`` with ``vector``: L2-normalised embeddings of the prefixed texts."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for part in parts:
            texts = [prefix + (t or "") for t in part]
            rows: list[np.ndarray] = []
            for lo in range(0, len(texts), batch):
                v = embed_batch(provider, texts[lo : lo + batch])
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                rows += list((v / np.where(norm == 0, 1, norm)).astype(np.float32))
            yield pd.Series([r.tolist() for r in rows])

    return docs.withColumn("vector", run(text))


def check_dim(docs: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Fails when a row's vector hasn't ``dim`` numbers."""
    return docs.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector has not {dim} numbers"))))

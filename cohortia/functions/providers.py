"""Interfaces of models and deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
import re
import time
from abc import ABC, abstractmethod
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.session import ship


class Embedder(ABC):
    """Vectors of texts. Instances go to the tasks, so they must pickle."""

    dims: int

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(ABC):
    @abstractmethod
    def scores(self, criterion: str, texts: list[str]) -> list[float | None]:
        """A relevance for each text; None where it fails."""


class Verifier(ABC):
    @abstractmethod
    def verdicts(self, criterion: str, texts: list[str]) -> list[str | None]: ...


VERDICTS = {"cumple", "dudoso", "no_cumple", "irrelevante"}


@lru_cache(100_000)
def _direction(word: str, dims: int) -> np.ndarray:
    seed = hashlib.sha256(word.encode()).digest()
    raw = (seed * (dims * 4 // len(seed) + 1))[: dims * 4]
    return np.frombuffer(raw, ">u4").astype(float) / 2**32 - 0.5


class BagOfWords(Embedder):
    """Normalised sum of directions fixed by the words' hashes: texts that share words lie near each other."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()) or [""]:
                out[row] += _direction(word, self.dims)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def embedded(units: DataFrame, embedder: Embedder, text: str = "texto", batch: int = 128) -> DataFrame:
    """units with `vector`, in sub-batches; null texts count as empty."""
    ship(units.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        values = [t or "" for t in texts]
        rows = [v for k in range(0, len(values), batch) for v in embedder.embed(values[k : k + batch]).astype("float32").tolist()]
        return pd.Series(rows)

    return units.withColumn("vector", vectors(text))


def distance_to(query: list[float], vector: Column) -> Column:
    """Cosine distance of a column of vectors to one vector, by matrix products; null for vectors of another length or zero."""
    return least_distance([query], vector)


def least_distance(queries: list[list[float]], vector: Column) -> Column:
    """Least cosine distance of a column of vectors to any of several."""
    wanted = np.atleast_2d(np.asarray(queries, dtype=float))
    norms_wanted = np.linalg.norm(wanted, axis=1, keepdims=True)
    wanted = (wanted / np.where(norms_wanted == 0, 1, norms_wanted)).T

    @F.pandas_udf("double")
    def distance(vectors: pd.Series) -> pd.Series:
        fits = vectors.map(lambda v: v is not None and len(v) == len(wanted)).to_numpy(dtype=bool)
        out = np.full(len(vectors), np.nan)
        if fits.any() and wanted.size:
            matrix = np.vstack(vectors[fits].to_numpy()).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[fits] = 1 - (matrix @ wanted).max(axis=1) / np.linalg.norm(matrix, axis=1)
        return pd.Series(out).where(np.isfinite(out), None)

    return distance(vector)


def checked(verdicts: list[str | None], expected: int) -> list[str]:
    """One valid verdict for each text: missing, unknown and surplus ones become sin_verificar."""
    out = [v if v in VERDICTS else "sin_verificar" for v in verdicts[:expected]]
    return out + ["sin_verificar"] * (expected - len(out))


class TransientError(Exception):
    """What a verifier raises for a batch that may succeed later or in smaller batches."""


def verified(units: DataFrame, verifier: Verifier, criterion: str, text: str = "texto", batch: int = 25, seconds: float = 60.0) -> DataFrame:
    """units with `veredicto` of a pluggable verifier, batch by batch; a batch that fails for the moment is halved down to single texts.

    TransientError, TimeoutError and ConnectionError are such failures; any other error ends the query. Each call of a task has `seconds`, after which the
    rest stays sin_verificar.
    """
    ship(units.sparkSession)

    def ask(texts: list[str], depth: int = 5) -> list[str]:
        try:
            return checked(list(verifier.verdicts(criterion, texts)), len(texts))
        except (TransientError, TimeoutError, ConnectionError):
            if len(texts) == 1 or not depth:
                return ["sin_verificar"] * len(texts)
            half = len(texts) // 2
            return ask(texts[:half], depth - 1) + ask(texts[half:], depth - 1)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        values, until, out = [t or "" for t in texts], time.monotonic() + seconds, []
        for k in range(0, len(values), batch):
            part = values[k : k + batch]
            out += ask(part) if time.monotonic() < until else ["sin_verificar"] * len(part)
        return pd.Series(out, dtype=object)

    return units.withColumn("veredicto", run(text))


def nearest_of(keys: list, queries: list[list[float]], k: int, rows: int = 2048):
    """A function over batches of (key, vector) that gives the k nearest of each query within its task: (consulta, key, distancia), ties by key."""

    def near(batches):
        best, name = None, None
        lengths = {len(q) for q in queries}
        by_length = {n: [i for i, q in enumerate(queries) if len(q) == n] for n in lengths}
        wanted = {n: np.asarray([queries[i] for i in at], dtype=float) for n, at in by_length.items()}
        for pdf in batches:
            name = pdf.columns[0]
            for start in range(0, len(pdf), rows):
                part = pdf.iloc[start : start + rows]
                sizes = part.iloc[:, 1].map(lambda v: -1 if v is None else len(v)).to_numpy()
                for n, at in by_length.items():
                    if not (sizes == n).any():
                        continue
                    matrix, own = np.vstack(part.iloc[:, 1][sizes == n].to_numpy()).astype(float), part.iloc[:, 0][sizes == n].to_numpy()
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d = 1 - (wanted[n] @ matrix.T) / np.linalg.norm(wanted[n], axis=1, keepdims=True) / np.linalg.norm(matrix, axis=1)
                    d = np.where(np.isfinite(d), d, np.inf)
                    least = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
                    q, j = np.nonzero((d <= least) & (d < np.inf))
                    new = pd.DataFrame({"q": np.asarray(at)[q], "clave": own[j], "d": d[q, j]})
                    best = (new if best is None else pd.concat([best, new])).sort_values(["q", "d", "clave"])
                    best = best[best.groupby("q").cumcount() < k]
        if best is not None:
            yield pd.DataFrame({"consulta": [keys[i] for i in best["q"]], name: best["clave"].to_numpy(), "distancia": best["d"].to_numpy()})

    return near

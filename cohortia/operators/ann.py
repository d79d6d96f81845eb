"""Approximate nearest neighbours by an inverted file, with its recall measured against the exact search.

Centroids are fitted on a bounded sample (SAMPLE rows of lowest hash); every row is indexed, in the list of its nearest centroid. A query looks into the
`probes` lists whose centroids are nearest to it. A list is split into slices of about ROWS rows and the queries into blocks of QUERIES, so that no
task holds more of either, however many there are; each keeps the k best a query. On vectors without any structure (the tests' are random) most lists must be
looked into for a recall of 0.9; vectors of texts need far fewer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.session import ship

SAMPLE, LISTS, PROBES, ROUNDS = 20_000, 64, 44, 10
ROWS, QUERIES = 5_000, 4_096


@dataclass(frozen=True)
class Index:
    """Unit centroids, one a row, how many lists a query looks into, and the number of slices of a list."""

    centroids: np.ndarray
    probes: int
    slices: int = 1


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def fitted(vectors: DataFrame, key: str, vector: str, lists: int = LISTS, probes: int = PROBES, sample: int = SAMPLE) -> Index:
    """Centroids by spherical k-means on at most `sample` vectors of the most frequent length; null vectors and others aren't indexed."""
    size = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return Index(np.zeros((0, 0)), probes)
    rows = vectors.filter(F.size(vector) == size["n"]).select(vector).orderBy(F.xxhash64(F.col(key).cast("string"))).limit(sample).toPandas()[vector]
    x = _unit(np.vstack(rows.to_numpy()).astype(float))
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(np.bincount(own, minlength=len(centroids))[:, None] > 0, _unit(sums), centroids)
    return Index(centroids, min(probes, len(centroids)), -(-size["count"] // (ROWS * len(centroids))))


def listed(index: Index, vectors: DataFrame, key: str, vector: str, lists: int) -> DataFrame:
    """(key, vector, lista): each vector with its `lists` nearest lists, a row each."""
    ship(vectors.sparkSession)
    centroids = index.centroids
    kinds = vectors.schema

    def run(batches):
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == centroids.shape[1] for v in pdf[vector]]]
            if not len(pdf) or not len(centroids):
                continue
            near = np.argsort(-(_unit(np.vstack(pdf[vector].to_numpy()).astype(float)) @ centroids.T), axis=1, kind="stable")[:, :lists]
            out = pdf.loc[pdf.index.repeat(near.shape[1])].reset_index(drop=True)
            yield out.assign(lista=near.ravel().astype("int32"))

    shape = f"`{key}` {kinds[key].dataType.simpleString()}, `{vector}` {kinds[vector].dataType.simpleString()}, lista int"
    return vectors.select(key, vector).mapInPandas(run, shape)


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(consulta, key, distancia, puesto): the k nearest of each query among the lists it looks into, ties by key.

    Rows and queries of a list meet in tasks by (lista, rebanada, bloque): rows are copied to each block of queries, queries to each slice.
    """
    kind = vectors.schema[key].dataType.simpleString()
    blocks = max(1, -(-queries.count() // QUERIES))
    part = lambda n: F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = listed(index, vectors, key, vector, 1).withColumn("rebanada", part(index.slices)).withColumn("bloque", each(blocks))
    asked = listed(index, queries, key, vector, index.probes).withColumn("bloque", part(blocks)).withColumn("rebanada", each(index.slices))

    def run(_, own: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(query):
            return pd.DataFrame({"consulta": [], key: [], "distancia": []})
        matrix, keys = _unit(np.vstack(own[vector].to_numpy()).astype(float)), own[key].to_numpy()
        parts = []
        for name, v in zip(query[key], query[vector]):
            d = 1 - matrix @ _unit(np.asarray([v], dtype=float))[0]
            best = np.lexsort((keys, d))[:k]
            parts.append(pd.DataFrame({"consulta": name, key: keys[best], "distancia": d[best]}))
        return pd.concat(parts)

    found = rows.groupBy("lista", "rebanada", "bloque").cogroup(asked.groupBy("lista", "rebanada", "bloque")).applyInPandas(run, f"consulta {kind}, `{key}` {kind}, distancia double")
    place = F.row_number().over(Window.partitionBy("consulta").orderBy("distancia", key))
    return found.withColumn("puesto", place).filter(F.col("puesto") <= k)


def audit(exact: DataFrame, approximate: DataFrame, key: str) -> DataFrame:
    """(consulta, vecinos, faltan, primer_lugar, exactitud) of each query: exact neighbours, those missed, the best exact place among them, the share found."""
    hit = approximate.select("consulta", key).withColumn("hallado", F.lit(True))
    both = exact.select("consulta", key, "puesto").join(hit, ["consulta", key], "left")
    missed = F.col("hallado").isNull()
    out = both.groupBy("consulta").agg(F.count(F.lit(1)).alias("vecinos"), F.count_if(missed).alias("faltan"), F.min(F.when(missed, F.col("puesto"))).alias("primer_lugar"))
    return out.withColumn("exactitud", 1 - F.col("faltan") / F.col("vecinos"))

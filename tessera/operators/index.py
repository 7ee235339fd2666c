"""A vector index: rows dealt out to cells of near vectors, as folders of a Parquet table, of which a search reads a few.

Cells are the Voronoi cells of centroids by cosine, found by k-means in a bounded sample (``SAMPLE`` rows by a hash of the key); every row is then assigned to its
nearest centroid and indexed. A search scans the cells whose centroids are nearest to the query, which Spark prunes to their folders, and ranks their rows exactly. What is missed
lies in cells that weren't read: ``probes`` trades reading for recall, and all cells give the exact result.

Defined results: rows without vector, or of another length than the first sampled one, aren't indexed; ties go to the smaller key; an empty table makes an index that finds nothing.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import retrieval

#: Rows that k-means takes at most, its rounds, and the most cells.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 12, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def centroids(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors, by k-means on cosines; a cell that gets empty takes the vector that fits its own worst."""
    x = _unit(x)
    c = x[np.random.default_rng(5).choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        fit = x @ c.T
        own = fit.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = x[np.argsort(fit.max(axis=1))[: len(empty)]]
        c = _unit(sums)
    return c


class VectorIndex:
    """An index in a folder: ``rows`` by cell, and the centroids."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        held = spark.read.json(f"{self.root}/centroids").first()
        self.key, self.vector = held["key"], held["vector"]
        self.schema = T.StructType.fromJson(json.loads(held["schema"]))
        self.centroids = np.array(json.loads(held["values"]), "f8").reshape(held["n"], -1)

    @classmethod
    def build(cls, vectors: DataFrame, root: str, key: str, vector: str = "embedding", cells: int | None = None) -> VectorIndex:
        """Indexes every row of ``vectors`` that has a vector; other columns are stored beside."""
        spark, root = vectors.sparkSession, root.rstrip("/")
        good = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
        n = good.count()
        share = min(1.0, SAMPLE / max(n, 1))
        sample = good.where(F.pmod(F.xxhash64(F.lit("index"), key), F.lit(1 << 30)) < int(share * (1 << 30))).select(vector).limit(2 * SAMPLE).toPandas()[vector]
        sample = [np.asarray(v, "f8") for v in sample]
        x = np.array([v for v in sample if len(v) == len(sample[0])]).reshape(-1, len(sample[0]) if sample else 1)
        cells = min(cells or max(1, round(n**0.5)), MOST_CELLS, max(1, len(x)))
        c = centroids(x, cells) if len(x) else np.zeros((1, 1))
        held = spark.sparkContext.broadcast(c)

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            return pd.Series((np.array(v.tolist(), "f8").reshape(len(v), -1) @ held.value.T).argmax(axis=1) if len(v) else [], dtype="int32")

        rows = good.where(F.size(vector) == c.shape[1]).withColumn("_cell", cell(vector))
        rows.repartition("_cell", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("_cell").parquet(f"{root}/rows")
        spark.createDataFrame([(key, vector, len(c), json.dumps(c.tolist()), rows.schema.json())], "key string, vector string, n int, values string, schema string").coalesce(1).write.mode("overwrite").json(f"{root}/centroids")
        return cls(spark, root)

    def search(self, query, k: int, probes: int = 8, digits: int | None = None) -> DataFrame:
        """The rows of the ``k`` nearest vectors in the ``probes`` cells nearest to the query, with ``score``."""
        q = np.asarray(query, "f8")
        near = np.argsort(-(self.centroids @ q), kind="stable")[:probes].tolist() if q.shape == self.centroids.shape[1:] else []
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/rows").where(F.col("_cell").isin(near)).drop("_cell")
        return retrieval.knn(rows, retrieval.literal(q), k, self.key, self.vector, digits)

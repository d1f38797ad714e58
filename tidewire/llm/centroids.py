"""Centroid clustering: plain Lloyd rounds over whole-number vectors.

A component x becomes floor(scale * x). The first centroids are the vectors whose id has the smallest salted
hash. In each round every task holds the few centroids, computes squared differences to each of them in
NumPy and takes the nearest, the lowest number of equals; it sums its own vectors by cluster before anything
is shuffled, so that a cluster with most of all rows costs one row per task. Sums are whole numbers: the
result does not depend on how rows are dealt, nor on tasks that run twice.

The vectors themselves are never shuffled or stored: each round reads the two columns again. What
comes to the driver, and goes out with the tasks, are k centroids.

Defined results: rows whose vector is null, has another number of components, or one that is null or not
finite, are left out. A null id is assigned a cluster but cannot be a first centroid. Of repeated ids, which
have one hash, the smaller vector comes first; repeated rows can so be several first centroids, of which the
first takes all. With fewer such rows than clusters there are as many clusters as rows; without any, as in
an empty table, there are no rows. Components beyond +-2^27 (after scaling) are held at that, and so are exact in every sum.
Sums of distances beyond 64 bits are held at the largest long. Only the two named columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import small_batches

#: Components are held within this, so that a squared distance of up to 64 of them is a long.
MOST = 1 << 27
LONGEST = (1 << 63) - 1


def usable(vectors: list, dims: int) -> np.ndarray:
    """Which vectors have exactly so many components, all finite. A null component comes as NaN or None."""

    def good(v) -> bool:
        if v is None or len(v) != dims:
            return False
        if getattr(v, "dtype", None) == object and any(x is None for x in v):
            return False
        return bool(np.isfinite(np.asarray(v, float)).all())

    return np.fromiter(map(good, vectors), bool, len(vectors))


def whole(vectors: list, dims: int, scale: float) -> np.ndarray:
    """The rows as whole numbers, one vector a row."""
    x = np.asarray(np.concatenate(vectors) if len(vectors) else [], np.float64).reshape(-1, dims)
    return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the number of the nearest centroid (the lowest of equals) and its squared distance."""
    best = np.full(len(rows), -1, np.int32)
    least = np.full(len(rows), LONGEST, np.int64)
    for number, c in enumerate(centroids):
        d = rows - c
        d = np.einsum("ij,ij->i", d, d)
        closer = d < least
        best[closer], least[closer] = number, d[closer]
    return best, least


@dataclass
class Clusters:
    """Centroids by number, with the sum of squared distances to each of the rows that it was made from."""

    centroids: np.ndarray
    inertia: list[int]

    def digest(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


class Lloyd:
    """Rounds of assignment and replacement over a table of vectors."""

    def __init__(self, vectors: DataFrame, dims: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.dims, self.scale = dims, scale
        self.kind = vectors.schema[id_col].dataType.simpleString()
        self.id_col = id_col
        self.rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(F.size("v") == dims)
        small_batches(vectors.sparkSession)

    def first(self, k: int, seed: int) -> np.ndarray:
        """The k vectors with the smallest hashes of `seed:id`, in that order."""
        dims, scale = self.dims, self.scale
        hashed = self.rows.filter("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        top = hashed.filter(good).orderBy("h", "v").limit(k).select("h", "v").collect()
        top.sort(key=lambda r: (r["h"], list(r["v"])))
        return whole([np.array(r["v"], float) for r in top], dims, scale)

    def summed(self, centroids: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[int]]:
        """By cluster: number of rows, sums of components, sum of distances. Each task combines its own rows first."""
        dims, scale, k = self.dims, self.scale, len(centroids)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            count, sums, spread = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
            for pdf in batches:
                vectors = pdf["v"].tolist()
                x = whole([v for v, ok in zip(vectors, usable(vectors, dims), strict=True) if ok], dims, scale)
                cluster, distance = nearest(x, centroids)
                for c in np.unique(cluster).tolist():
                    of = cluster == c
                    count[c] += of.sum()
                    sums[c] += x[of].sum(axis=0)
                    spread[c] += sum(distance[of].tolist()) if distance[of].max() > 1 << 40 else int(distance[of].sum())
            seen = [c for c in range(k) if count[c]]
            if seen:
                yield pd.DataFrame({"cluster": seen, "n": count[seen], "s": sums[seen].tolist(), "spread": [str(spread[c]) for c in seen]})

        parts = self.rows.select("v").mapInPandas(run, "cluster int, n long, s array<long>, spread string")
        exact = lambda c: F.sum(c.cast("decimal(38,0)")).cast("string")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(exact(F.col("s")[i]) for i in range(dims))).alias("s"), exact(F.col("spread")).alias("spread"))
        n, sums, spreads = np.zeros(k, np.int64), [[0] * dims for _ in range(k)], [0] * k
        for r in total.collect():
            n[r["cluster"]], sums[r["cluster"]], spreads[r["cluster"]] = r["n"], list(map(int, r["s"])), int(r["spread"])
        return n, sums, spreads

    def fit(self, k: int = 16, rounds: int = 3, seed: int = 1) -> Clusters:
        centroids = self.first(k, seed)
        if not len(centroids):
            return Clusters(centroids, [])
        for _ in range(rounds):
            n, sums, _ = self.summed(centroids)
            centroids = np.array([[s // int(m) for s in row] if m else old for m, row, old in zip(n, sums, centroids.tolist(), strict=True)], np.int64)
        return Clusters(centroids, self.summed(centroids)[2])

    def assign(self, clusters: Clusters) -> DataFrame:
        """One row per usable vector: id, cluster, squared distance. No shuffle."""
        dims, scale, centroids = self.dims, self.scale, clusters.centroids

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                vectors = pdf["v"].tolist()
                ok = usable(vectors, dims)
                cluster, distance = nearest(whole([v for v, good in zip(vectors, ok, strict=True) if good], dims, scale), centroids)
                yield pd.DataFrame({"id": pdf["id"][ok].reset_index(drop=True), "cluster": cluster, "distance": distance})

        return self.rows.mapInPandas(run, f"id {self.kind}, cluster int, distance long").withColumnRenamed("id", self.id_col)


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector: id, cluster, distance, inertia of its cluster and of all, digest of its centroid."""
    lloyd = Lloyd(vectors, dims, scale, id_col, vector_col)
    clusters = lloyd.fit(k, rounds, seed)
    if not clusters.inertia:
        lloyd.rows = lloyd.rows.limit(0)
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))
    held = [min(i, LONGEST) for i in clusters.inertia]
    return lloyd.assign(clusters).withColumns(
        {
            "cluster_inertia": of(held, "bigint"),
            "inertia": F.lit(min(sum(clusters.inertia), LONGEST)).cast("long"),
            "centroid_sha256": of(clusters.digest(), "string"),
        }
    )

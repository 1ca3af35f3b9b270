"""Centroid clustering in whole numbers, on distinct vectors with their multiplicities.

Components become floor(256 * x). Rows of one quantised vector are grouped with their number, Lloyd's
rounds run over the distinct vectors with sums weighted by it, and the assignment is joined back to
the rows by the vector's name. Every task sums its own vectors by cluster first, so a round
shuffles a row a cluster and task, and only the centroids, bounded by their number, meet on the driver.

Sums, quotients and distances are exact: products of matrices where doubles hold them exactly,
Python's integers where components are larger.

Defined cases: vectors that are null, not of ``DIM`` components or hold null or non-finite ones take no
part; ties go to the smaller cluster; repeated rows count each; rows without an id take part and come
last among the starts; equal starts are centroids of their own; fewer rows than ``CLUSTERS`` give as many centroids as rows; an empty table gives no rows; extra
columns are ignored. Components and results beyond a long are held at its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, small_batches, staged

DIM, CLUSTERS, ROUNDS = 64, 40, 5
SCALE = 256
SEED = "2"
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, q (longs) and uid, the name of q, of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == dim)
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    v = v.select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("q"))
    return v.withColumn("uid", F.md5(F.array_join("q", ",").cast("binary")))


def starts(rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> list[list[int]]:
    """The vectors of the smallest hashes of the ids, rows without an id last."""
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    got = rows.select(turn.alias("turn"), "q").orderBy(F.asc_nulls_last("turn"), "q").limit(clusters).collect()
    return [list(map(int, r.q)) for r in got]


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _exact(*blocks: np.ndarray) -> bool:
    """Whether doubles hold every squared distance of these vectors exactly."""
    return blocks[0].shape[1] * (2 * max(map(_largest, blocks))) ** 2 < 1 << 52


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Number of the nearest centroid, the smaller of equals, and the squared distance, of every row of whole numbers."""
    if _exact(x, c):
        f, g = x.astype(np.float64), c.astype(np.float64)
        d = (f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at].astype(np.int64).tolist()
    at, least = [], []
    big = c.astype(object)
    for row in x.astype(object):
        d = [int(v) for v in ((big - row) ** 2).sum(1)]
        least.append(min(d))
        at.append(d.index(least[-1]))
    return np.array(at), least


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column])


def _sums(c: np.ndarray):
    """Batches of distinct vectors -> a row a cluster: its number of rows and weighted sums, as decimal text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = [[0] * c.shape[1] for _ in c], [0] * len(c)
        for x in parts:
            if not len(x):
                continue
            m, w = _matrix(x.q), x.weight.to_numpy()
            near, _ = nearest(m, c)
            big = _largest(m) * int(w.sum()) >= 1 << 62
            for k in np.unique(near).tolist():
                own = near == k
                s = (m[own].astype(object) * w[own].astype(object)[:, None]).sum(0) if big else w[own] @ m[own]
                total[k] = [a + int(b) for a, b in zip(total[k], s)]
                count[k] += int(w[own].sum())
        rows = [(k, n, list(map(str, total[k]))) for k, n in enumerate(count) if n]
        yield pd.DataFrame(rows, columns=["cluster", "n", "sums"])

    return run


def lloyd(unique: DataFrame, c: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after the rounds; ``unique`` has q and weight."""
    for _ in range(rounds):
        sums = unique.select("q", "weight").mapInPandas(_sums(np.array(c, np.int64)), "cluster int, n long, sums array<string>")
        sums = sums.select("cluster", "n", F.transform("sums", lambda s: s.cast("decimal(38,0)")).alias("sums"))
        total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(c[0]))]
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
            c[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(len(c[0]))]
    return c


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and the multiplicity of the row's vector."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = quantised(vectors, dim)
    unique = staged(rows.groupBy("uid").agg(F.first("q").alias("q"), F.count("*").alias("weight")), "centroid-unique")
    c = starts(rows, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, multiplicity long"
    if not c:
        return spark.createDataFrame([], schema)
    final = np.array(lloyd(unique, c, rounds), np.int64)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            if len(x):
                near, far = nearest(_matrix(x.q), final)
                yield pd.DataFrame({"uid": x.uid, "cluster": near.astype(np.int32), "distance": [min(d, LONG) for d in far], "multiplicity": x.weight})

    placed = unique.mapInPandas(place, "uid string, cluster int, distance long, multiplicity long")
    placed = staged(placed, "centroid-placed")
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("multiplicity").cast("decimal(19,0)")).alias("i")).collect()
    whole = sum(int(r.i) for r in inertia)
    name = lambda row: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()
    facts = [(r.cluster, min(int(r.i), LONG), min(whole, LONG), name(final[r.cluster].tolist())) for r in inertia]
    # One row a centroid, ``k`` at most.
    facts = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    found = lookup(rows.select("vec_id", "uid"), placed, "uid").join(facts, "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "multiplicity")

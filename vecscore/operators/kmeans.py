"""Deterministic k-means on quantized vectors.

Centroids are `n_clusters` rows (a parameter, 4096 at most), so they are broadcast and collected; vectors never are.
A round is one scan with partial aggregation: only sums by cluster are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import divide, f32
from .kernel import TILE, distances, matrix

MOST_CLUSTERS = 4096


def stride_init(vectors: DataFrame, n_clusters: int) -> DataFrame:
    """(cid, c, cq): every (n div n_clusters)-th vector by id, ids being 0 to n - 1."""
    n = vectors.count()
    if not 0 < n_clusters <= min(n, MOST_CLUSTERS):
        raise ValueError(f"{n_clusters} clusters of {n} vectors")
    s = n // n_clusters
    pick = vectors.where((F.col("ref_id") % s == 0) & (F.floor(F.col("ref_id") / s) < n_clusters))
    return pick.select(F.floor(F.col("ref_id") / s).cast("int").alias("cid"), F.transform("v", lambda x: divide(x.cast("float"), 10000.0)).alias("c"), F.col("v").alias("cq"))


def _closest(ids: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
    parts = [ids[distances(v[i : i + TILE], c).argmin(axis=1)] for i in range(0, len(v), TILE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _assign(bc, at: int):
    def run(batches):
        ids, *sets = bc.value
        for b in batches:
            v = matrix(b.column(at))
            cols = [pa.array(_closest(ids, c, v) if c is not None else np.zeros(len(v), np.int32)) for c in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *("cid", "old")[: len(cols)]])

    return run


def assign(vectors: DataFrame, centroids: DataFrame, *before: DataFrame | None) -> DataFrame:
    """vectors with cid, the nearest quantized centroid (the smallest cid of equals); with centroids of the round before
    (or None: all 0), also with old, the nearest of those, so that changes are counted without a join."""
    spread = lambda df: None if df is None else np.array([r[1] for r in sorted(df.select("cid", "cq").collect())], np.float64)
    ids = np.array(sorted(r[0] for r in centroids.select("cid").collect()), np.int32)
    bc = vectors.sparkSession.sparkContext.broadcast((ids, spread(centroids), *(spread(b) for b in before)))
    names = [c for c in vectors.columns if c not in ("cid", "old")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name in names)
    return vectors.select(*names).mapInArrow(_assign(bc, names.index("v")), f"{ddl}, cid int" + ", old int" * len(before))


def update(assigned: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """(cid, n, changed, c, cq): means in 32-bit floats of 64-bit sums; empty clusters keep what they had. changed counts rows whose old differs."""
    changed = F.count_if(F.col("cid") != F.col("old")) if "old" in assigned.columns else F.lit(0)
    sums = assigned.groupBy("cid").agg(F.count("*").alias("n"), changed.alias("changed"), F.array(*(F.sum(F.col("v")[d].cast("bigint")) for d in range(dims))).alias("s"))
    mean = F.transform("s", lambda s: divide(s.cast("float"), F.col("n").cast("float") * f32(10000.0)))
    new = sums.select("cid", "n", "changed", mean.alias("new"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    both = centroids.select("cid", "c").join(new, "cid", "left").select("cid", count("n"), count("changed"), F.coalesce("new", "c").alias("c"))
    return both.withColumn("cq", F.transform("c", lambda x: F.round(x * f32(10000.0)).cast("int")))


def fit(vectors: DataFrame, n_clusters: int, dims: int, rounds: int = 30, seed: int | None = None) -> tuple[DataFrame, int]:
    """Centroids after at most `rounds` updates, or the one after which no vector changes; and the number of updates.

    A round is one scan: assignment, changes and sums in one job that returns n_clusters rows. The start is every (n div n_clusters)-th vector, or
    with a seed that of k-means++."""
    spark = vectors.sparkSession
    first = stride_init(vectors, n_clusters) if seed is None else seed_plus_plus(vectors, n_clusters, seed)
    centroids, before, done = spark.createDataFrame(first.collect(), first.schema), None, 0
    while done < rounds:
        new = update(assign(vectors, centroids, before), centroids, dims)
        rows = new.collect()
        before, centroids = centroids, spark.createDataFrame(rows, new.schema)
        done += 1
        if not sum(r["changed"] for r in rows):
            break
    return centroids, done


def seed_plus_plus(vectors: DataFrame, n_clusters: int, seed: int = 42, most: int = 10_000) -> DataFrame:
    """(cid, c, cq) by k-means++ on `most` vectors evenly spread over all ids (0 to n - 1): a bounded sample, so it is seeded on the driver."""
    n = vectors.count()
    if not 0 < n_clusters <= min(n, most, MOST_CLUSTERS):
        raise ValueError(f"{n_clusters} clusters of {min(n, most)} vectors")
    spread = F.lit(True) if n <= most else F.col("ref_id") * most % n < most
    v = np.array([r[0] for r in vectors.where(spread).orderBy("ref_id").select("v").collect()], np.float64)
    rng = np.random.default_rng(seed)
    take = [int(rng.integers(len(v)))]
    near = distances(v, v[take]).min(axis=1)
    while len(take) < n_clusters:
        p = near / near.sum() if near.sum() else None
        take.append(int(rng.choice(len(v), p=p)))
        near = np.minimum(near, distances(v, v[take[-1:]])[:, 0])
    rows = [(i, [float(x) / 10000 for x in v[t]], [int(x) for x in v[t]]) for i, t in enumerate(take)]
    return vectors.sparkSession.createDataFrame(rows, "cid int, c array<float>, cq array<int>")

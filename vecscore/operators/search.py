"""Index search: grid and box bounds choose clusters, members are compared in blocks, votes decide.

`neighbours` is the one expensive table: for every query and probed cluster its k nearest members. Any number
of probes, the adaptive search, tuning and evaluation are filters of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import axis, box_bound
from ..params import SearchParams
from ..sources.checkpoint import cut
from .index import Index
from .kernel import TILE, TopK, distances, matrix
from .knn import rank_within, votes

MEMBERS = 20_000
QUERIES = 20_000


def candidates(queries: DataFrame, index: Index, p: SearchParams = SearchParams()) -> DataFrame:
    """(qid, cid, lb): clusters registered in the query's grid cell, with the bound of their box."""
    a, b = index.disc
    cell = axis(F.col("v")[a], p.cells, p.scale) * p.cells + axis(F.col("v")[b], p.cells, p.scale)
    seen = queries.select("qid", "v", cell.alias("bucket")).join(index.grid, "bucket")
    return seen.join(index.clusters.select("cid", "mn", "mx"), "cid").select("qid", "cid", box_bound(F.col("v"), F.col("mn"), F.col("mx")).alias("lb"))


def probes(candidates_: DataFrame, n: int, p: SearchParams = SearchParams()) -> DataFrame:
    """(qid, cid, lb, probe_rk): the n clusters of least (lb, cid); never more than p.full."""
    return rank_within(candidates_, "qid", p.probes(n), ("lb", "cid"), "probe_rk")


def _nearest_centroids(bc, n: int):
    def run(batches):
        ids, c = bc.value
        for batch in batches:
            qid, v = batch.column(0), matrix(batch.column(1))
            for i in range(0, len(v), TILE):
                d = distances(v[i : i + TILE], c)
                o = np.argsort(d, axis=1, kind="stable")[:, :n]  # ids are in order, so equals stay in id order
                rows = np.repeat(np.arange(i, i + len(d)), o.shape[1])
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(rows)), pa.array(ids[o.ravel()]), pa.array(np.take_along_axis(d, o, 1).ravel().astype(np.int64)), pa.array(np.tile(np.arange(1, o.shape[1] + 1, dtype=np.int32), len(d)))], ["qid", "cid", "lb", "probe_rk"])

    return run


def centroid_probes(queries: DataFrame, index: Index, n: int) -> DataFrame:
    """(qid, cid, lb, probe_rk) by distance to the quantized centroids instead, without the grid; centroids are 4096 rows at most."""
    rows = sorted(index.centroids.select("cid", "cq").collect())
    bc = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.float64)))
    return queries.select("qid", "v").mapInArrow(_nearest_centroids(bc, n), "qid bigint, cid int, lb bigint, probe_rk int")


def _compare(k: int, not_self: bool):
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"qid": [], "cid": [], "dist": [], "ref_id": [], "fraud": []}).astype("int64").astype({"cid": "int32", "fraud": "int32"})
        top = TopK(q["qid"].to_numpy(), np.stack(q["v"].to_numpy()).astype(np.float64), k, not_self)
        top.show(r["ref_id"].to_numpy(), np.stack(r["v"].to_numpy()).astype(np.float64), r["fraud"].to_numpy())
        out = top.batch().to_pandas()
        out["cid"] = np.int32(q["cid"].iloc[0])
        return out[["qid", "cid", "dist", "ref_id", "fraud"]]

    return run


def neighbours(queries: DataFrame, probed: DataFrame, index: Index, p: SearchParams = SearchParams(), not_self: bool = False, bounded: bool = False) -> DataFrame:
    """(qid, probe_rk, dist, ref_id, fraud): the k nearest members of every probed cluster.

    bounded: lb is a lower bound of the distances in a cluster (as of candidates()). Then the p.fast first probes are searched before the
    others, and of those only clusters whose bound isn't beyond the k-th neighbour found: the rest can't change any vote of p.fast probes or more."""
    probed = cut(probed)
    if not bounded:
        return _members(queries, probed, index, p, not_self)
    first = cut(_members(queries, probed.where(F.col("probe_rk") <= p.fast), index, p, not_self))
    far = rank_within(first, "qid", p.k).groupBy("qid").agg(F.count("*").alias("found"), F.max("dist").alias("far")).where(F.col("found") == p.k)
    rest = probed.where(F.col("probe_rk") > p.fast).join(far.select("qid", "far"), "qid", "left").where("far is null or lb <= far").drop("far")
    return first.unionByName(_members(queries, cut(rest), index, p, not_self))


def _members(queries: DataFrame, probed: DataFrame, index: Index, p: SearchParams, not_self: bool) -> DataFrame:
    """The members of the probed clusters, of which at most 4096 exist: their numbers are a filter on the scan of the vectors.

    Queries and members meet by cluster in blocks of at most about MEMBERS by QUERIES rows: a large cluster is split by
    member, a much-probed one by query, and the other side is repeated for each part."""
    asked = queries.select("qid", "v").join(probed.select("qid", "cid", "probe_rk"), "qid")
    size = index.clusters.select("cid", F.greatest(F.ceil(F.col("n") / MEMBERS), F.lit(1)).cast("int").alias("ms"))
    want = probed.groupBy("cid").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs"))
    dealt = size.join(want, "cid")
    cids = [r[0] for r in want.select("cid").collect()]
    vectors = index.vectors.where(F.col("cid").isin(cids)) if cids else index.vectors.limit(0)
    vectors = vectors.select(*(F.col(c).alias(c) for c in ("ref_id", "v", "fraud", "cid")))  # columns of their own: queries may come from the index too
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    q = asked.join(dealt, "cid").select("qid", "v", F.col("cid").alias("cid"), each("ms").alias("m"), F.pmod(F.hash("qid"), F.col("qs")).alias("q"))
    r = vectors.join(dealt, "cid").select("ref_id", "v", "fraud", F.col("cid").alias("cid"), F.pmod(F.hash("ref_id"), F.col("ms")).alias("m"), each("qs").alias("q"))
    got = q.groupBy("cid", "m", "q").cogroup(r.groupBy("cid", "m", "q")).applyInPandas(_compare(p.k, not_self), "qid bigint, cid int, dist bigint, ref_id bigint, fraud int")
    return got.join(probed.select("qid", "cid", "probe_rk"), ["qid", "cid"]).select("qid", "probe_rk", "dist", "ref_id", "fraud")


def probe_votes(queries: DataFrame, near: DataFrame, n: int, p: SearchParams = SearchParams()) -> DataFrame:
    """votes() of the n first probed clusters."""
    return votes(queries, rank_within(near.where(F.col("probe_rk") <= p.probes(n)), "qid", p.k), p.k)


def adaptive(queries: DataFrame, near: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """(qid, cnt, worst, escalated): the fast pass, and the full pass where that found fewer than k or its farthest
    neighbour reaches the threshold of its fraud count. A count of 0 never escalates a full list."""
    fast, full = probe_votes(queries, near, p.fast, p), probe_votes(queries, near, p.full, p)
    limit = F.element_at(F.array(*(F.lit(t).cast("bigint") for t in p.fast_t)), F.col("cnt") + 1)
    need = (F.col("found") < p.k) | ((F.col("cnt") > 0) & (F.col("worst") >= limit))
    both = fast.withColumn("escalated", need).join(full.select("qid", F.col("cnt").alias("full_cnt"), F.col("worst").alias("full_worst")), "qid")
    pick = lambda a, b: F.when(F.col("escalated"), F.col(b)).otherwise(F.col(a)).alias(a)
    return both.select("qid", pick("cnt", "full_cnt"), pick("worst", "full_worst"), "escalated")


def recall(exact: DataFrame, near: DataFrame, n: int, p: SearchParams = SearchParams()) -> DataFrame:
    """(qid, hits): how many of the exact neighbours the n first probes find."""
    got = rank_within(near.where(F.col("probe_rk") <= p.probes(n)), "qid", p.k).select("qid", "ref_id", F.lit(1).alias("hit"))
    return exact.select("qid", "ref_id").join(got, ["qid", "ref_id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"))

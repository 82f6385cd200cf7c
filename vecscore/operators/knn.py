"""Exact nearest neighbours, votes and verdicts.

The reference vectors stay where they are: blocks of queries (of bounded size) are
broadcast, each task keeps the k nearest of its rows, and only k rows for each query and task are
shuffled. Integer vectors are searched in parts of bounded size, by boxes that exclude what is too far. Order is (distance, ref_id) everywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import NEVER
from ..sources.checkpoint import cut
from .kernel import TopK, matrix

#: Bytes of a block of queries and of the rows searched at once, as 64-bit numbers.
BLOCK_BYTES, PART_BYTES = 1 << 24, 1 << 25


def _nearest(bc, k: int, not_self: bool, floats: bool):
    def run(batches):
        top = TopK(*bc.value, k, not_self, floats)
        see = top.show if floats else top.search
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(1))
                held.append((b.column(0).to_numpy(zero_copy_only=False), v, b.column(2).to_numpy(zero_copy_only=False)))
                size += v.nbytes
                if floats or size >= PART_BYTES:
                    see(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            see(*map(np.concatenate, zip(*held, strict=True)))
        yield top.batch()

    return run


def rank_within(rows: DataFrame, by: str, k: int, order: tuple[str, ...] = ("dist", "ref_id"), name: str = "rk") -> DataFrame:
    rk = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn(name, rk).where(F.col(name) <= k)


def exact_knn(queries: DataFrame, refs: DataFrame, k: int = 5, not_self: bool = False, block_rows: int | None = None, floats: bool = False) -> DataFrame:
    """(qid, rk, ref_id, dist, fraud): the k nearest rows of refs (ref_id, v, fraud) for each of queries (qid, v).

    v are quantized vectors and distances 64-bit integers; with floats, any numbers and 64-bit floats. A block of queries has BLOCK_BYTES, unless
    block_rows are given. refs are read once for each block."""
    sc = refs.sparkSession.sparkContext
    parts, block = [], []

    def search(more: bool) -> None:
        bc = sc.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)))
        got = refs.select("ref_id", "v", "fraud").mapInArrow(_nearest(bc, k, not_self, floats), f"qid bigint, dist {'double' if floats else 'bigint'}, ref_id bigint, fraud int")
        parts.append(cut(got) if more or parts else got)
        block.clear()

    for row in queries.select("qid", "v").toLocalIterator():
        if block and len(block) == (block_rows or max(1, BLOCK_BYTES // (8 * max(1, len(block[0][1]))))):
            search(True)
        block.append(row)
    if block or not parts:
        search(False)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return rank_within(out, "qid", k).select("qid", "rk", "ref_id", "dist", "fraud")


def votes(queries: DataFrame, neighbours: DataFrame, k: int = 5) -> DataFrame:
    """(qid, found, cnt, worst) for every query: neighbours, frauds among them, greatest distance (NEVER if fewer than k)."""
    got = neighbours.groupBy("qid").agg(F.count("*").alias("found"), F.sum("fraud").alias("cnt"), F.max("dist").alias("far"))
    worst = F.when(F.col("found") == k, F.col("far")).otherwise(F.lit(NEVER))
    return queries.select("qid").join(got, "qid", "left").select("qid", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), F.coalesce("cnt", F.lit(0)).cast("int").alias("cnt"), F.coalesce(worst, F.lit(NEVER)).alias("worst"))


def verdict(cnt: Column, k: int = 5) -> tuple[Column, Column]:
    """(approved, fraud_score): fewer than 3 of 5 frauds are approved; the score divides by k, whatever was found."""
    return (5 * cnt < 3 * k).alias("approved"), (cnt / F.lit(float(k))).alias("fraud_score")


def response_json(cnt: Column, k: int = 5) -> Column:
    approved, score = verdict(cnt, k)
    return F.to_json(F.struct(approved, score)).alias("body")

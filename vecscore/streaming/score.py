"""Scoring a stream of payloads: every micro-batch is searched in the static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payload
from ..operators import search
from ..operators.index import Index
from ..operators.knn import response_json, verdict
from ..params import SearchParams


def score_bodies(bodies: DataFrame, index: Index, risks: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """(qid, approved, fraud_score, body) of rows (qid, body)."""
    parsed = payload.with_risk(payload.parse(bodies), risks)
    queries = payload.features(parsed, keep=["qid"])
    probed = search.probes(search.candidates(queries, index, p), p.full, p)
    out = search.adaptive(queries, search.neighbours(queries, probed, index, p, bounded=True), p)
    return out.select("qid", *verdict(F.col("cnt"), p.k), response_json(F.col("cnt"), p.k))


def score_stream(bodies: DataFrame, index: Index, risks: DataFrame, out: str, checkpoint: str, p: SearchParams = SearchParams()):
    """A started query that appends score_bodies() of every micro-batch to Parquet under `out`, once each: a batch writes its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        score_bodies(batch, index, risks, p).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route(requests: DataFrame) -> DataFrame:
    """requests (method, path, ...) with status and target: the scoring and readiness routes, by their whole path, else 404."""
    post = (F.col("method") == "POST") & (F.col("path") == "/fraud-score")
    ready = (F.col("method") == "GET") & (F.col("path") == "/ready")
    return requests.withColumn("target", F.when(post, "score").when(ready, "ready").otherwise("none")).withColumn("status", F.when(post | ready, 200).otherwise(404))

"""One query for each operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload
from ..functions.vector import register_sql
from ..operators import index as ix
from ..operators import kmeans, knn, search, tuning
from ..params import SearchParams
from ..sources import tables
from ..sources.checkpoint import cut
from ..streaming.score import route, score_stream
from .fixtures import asked, bodies, embeddings, payloads, transactions

DIMS = 64
CLUSTERS = 16
ROUNDS = 3
#: Thresholds of the adaptive query: distances of these vectors are about 1.2e8.
PARAMS = SearchParams(fast_t=(9223372036854775807, 110_000_000, 115_000_000, 120_000_000, 125_000_000, 130_000_000))
#: One probe against sixteen, so that the passes of few clusters disagree.
ONE = SearchParams(fast=1)
#: The reference's real setting of probes on transactions.
MANY, REAL = 256, SearchParams(fast=5, full=16)
Query = Callable[[SparkSession, str], DataFrame]


def text(v: str) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("v")


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ix.Index]:
    e = embeddings(spark, sf_dir)
    return e, ix.build(e, DIMS, CLUSTERS, ROUNDS, PARAMS)


def searched(spark: SparkSession, sf_dir: str, queries: Callable[[DataFrame], DataFrame] = asked, not_self: bool = True, p: SearchParams = PARAMS) -> tuple[DataFrame, DataFrame, ix.Index]:
    """Queries, their neighbours by probe, and the index."""
    e, index = built(spark, sf_dir)
    q = queries(e)
    probed = search.probes(search.candidates(q, index, PARAMS), PARAMS.full, PARAMS)
    return q, cut(search.neighbours(q, probed, index, p, not_self, bounded=True)), index


def tenth(e: DataFrame) -> DataFrame:
    return tuning.every(e, 10).withColumnRenamed("ref_id", "qid")


def fifth(e: DataFrame) -> DataFrame:
    return tuning.every(e, 5).withColumnRenamed("ref_id", "qid")


def q_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("ref_id", "fraud", text("v"))


def q_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("ref_id", "fraud", text("v"))


def q_features_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features without quantization, as hundred-thousandths; what is no number (0 over an average of 0) stays NaN."""
    p = payload.with_risk(payloads(spark, sf_dir), tables.default_risks(spark))
    scaled = F.transform("v", lambda x: F.coalesce(F.round(x.cast("double") * 100000).try_cast("bigint").cast("string"), x.cast("string")))
    return payload.float_features(p, keep=["ref_id"]).select("ref_id", F.array_join(scaled, ",").alias("v"))


def q_payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = payload.with_risk(payload.parse(bodies(spark, sf_dir)), tables.default_risks(spark))
    return payload.features(parsed, keep=["ref_id", "fraud"]).select("ref_id", "fraud", text("v"))


def q_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of which every tenth has a malformed time and every eleventh lacks its merchant."""
    b = bodies(spark, sf_dir)
    body = F.when(F.col("ref_id") % 10 == 0, F.regexp_replace("body", "T[0-9]{2}:", "T9x:")).when(F.col("ref_id") % 11 == 0, F.regexp_replace("body", '"merchant":', '"shop":')).otherwise(F.col("body"))
    # an average may be missing on a user's first event: given here, so that only the changes above are refused
    body = F.when(body.contains('"avg_amount":') & ~body.rlike('"customer":\\{"avg_amount"'), F.regexp_replace(body, '"customer":\\{', '"customer":{"avg_amount":1.0,')).otherwise(body)
    return payload.rejects(payload.parse(b.select("ref_id", body.alias("body")))).select("ref_id", "_reject")


def q_mcc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payload.with_risk(payloads(spark, sf_dir), tables.default_risks(spark))
    return p.select("ref_id", payload.category(F.col("merchant.mcc")).alias("mcc"), F.round(F.col("risk") * 10000).cast("int").alias("risk_bp"))


def q_known_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("ref_id", (F.col("v")[11] == 10000).cast("int").alias("unknown"))


def q_exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return knn.exact_knn(asked(e), e, not_self=True)


def q_exact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions against all others."""
    t = cut(transactions(spark, sf_dir))
    q = asked(t)
    got = knn.votes(q, knn.exact_knn(q, t, not_self=True))
    return got.select("qid", "cnt", "worst", *knn.verdict(F.col("cnt")))


def _float(spark: SparkSession, sf_dir: str, refs: Column) -> DataFrame:
    e = embeddings(spark, sf_dir)
    queries = asked(e.select("ref_id", F.transform("e", lambda x: x.cast("double")).alias("v")))
    got = knn.exact_knn(queries, e.select("ref_id", refs.alias("v"), "fraud"), not_self=True, floats=True)
    return got.select("qid", "rk", "ref_id", F.round("dist", 6).alias("dist"))


def q_knn_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _float(spark, sf_dir, F.transform("e", lambda x: x.cast("double")))


def q_knn_asym(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float queries against dequantized vectors."""
    return _float(spark, sf_dir, F.transform("v", lambda x: x / F.lit(10000.0)))


def q_dim_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.energy(embeddings(spark, sf_dir), DIMS)


def q_kmeans_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.stride_init(embeddings(spark, sf_dir), CLUSTERS).select("cid", text("cq"))


def q_kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return kmeans.assign(e, kmeans.stride_init(e, CLUSTERS)).select("ref_id", "cid")


def q_kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    c = kmeans.stride_init(e, CLUSTERS)
    return kmeans.update(kmeans.assign(e, c), c, DIMS).select("cid", "n", text("cq"))


def q_kmeans_fit3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.fit(embeddings(spark, sf_dir), CLUSTERS, DIMS, ROUNDS)[0].select("cid", text("cq"))


def q_cluster_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)[1].clusters.select("cid", "n", "start", "blocks")


def q_cluster_aabb(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = built(spark, sf_dir)[1].clusters.where("n > 0")
    return c.select("cid", text("mn").alias("mn"), text("mx").alias("mx"))


def q_block_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.pack_blocks(built(spark, sf_dir)[1].vectors)


def q_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ix.bucket_lists(built(spark, sf_dir)[1].grid)
    return lists.select("bucket", F.array_join(F.transform("cids", lambda x: x.cast("string")), ",").alias("cids"))


def q_grid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.grid_stats(built(spark, sf_dir)[1].grid, PARAMS)


def q_aabb_lb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, index = built(spark, sf_dir)
    return search.candidates(asked(e), index, PARAMS)


def q_probe_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, index = built(spark, sf_dir)
    return search.probes(search.candidates(asked(e), index, PARAMS), PARAMS.full, PARAMS)


def _probe(n: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, near, _ = searched(spark, sf_dir)
        return search.probe_votes(q, near, n, PARAMS).select("qid", "cnt", "worst")

    return query


def q_ivf_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, near, _ = searched(spark, sf_dir)
    return search.adaptive(q, near, PARAMS)


def q_ivf_centroid_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, index = built(spark, sf_dir)
    q = asked(e)
    near = search.neighbours(q, search.centroid_probes(q, index, 4), index, PARAMS, True)
    return search.probe_votes(q, near, 4, PARAMS).select("qid", "cnt", "worst")


def q_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, near, index = searched(spark, sf_dir)
    exact = knn.exact_knn(q, index.vectors, not_self=True)
    return search.recall(exact, near, PARAMS.full, PARAMS)


def q_tune_disagree(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, near, _ = searched(spark, sf_dir, tenth, False, ONE)
    return tuning.disagreement(tuning.fast_and_full(q, near, ONE))


def q_tune_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, near, _ = searched(spark, sf_dir, tenth, False, ONE)
    return tuning.thresholds(tuning.fast_and_full(q, near, ONE))


def q_tune_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of 14 features at 5 and 16 probes of 256 clusters; every fiftieth transaction asks."""
    index = ix.build(transactions(spark, sf_dir), 14, MANY, 2, REAL)
    q = asked(index.vectors.select("ref_id", "v", "fraud"))
    probed = search.probes(search.candidates(q, index, REAL), REAL.full, REAL)
    near = cut(search.neighbours(q, probed, index, REAL, False, bounded=True))
    return tuning.thresholds(tuning.fast_and_full(q, near, REAL))


def q_eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, near, _ = searched(spark, sf_dir, p=SearchParams(fast=min(tuning.NPROBES)))
    return tuning.confusion(q, near, q.select("qid", (F.col("fraud") == 0).alias("approved")), p=PARAMS)


def q_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, near, _ = searched(spark, sf_dir, fifth, False)
    return tuning.workload(q, near, p=PARAMS)


def q_response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    q = asked(e)
    return knn.votes(q, knn.exact_knn(q, e, not_self=True)).select("qid", knn.response_json(F.col("cnt")))


def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.round_robin(tables.table(spark, sf_dir, "events").select("event_id"), "event_id", 2).groupBy("backend").agg(F.count("*").alias("n"))


def q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request: purchases score, views ask for readiness, others go astray."""
    kind = F.col("event_type")
    method = F.when(kind.isin("purchase", "click"), "POST").otherwise("GET")
    path = F.when(kind == "purchase", "/fraud-score").when(kind == "view", "/ready").when(kind == "click", "/fraud-scoreboard").when(kind == "signup", "/readyz").otherwise(F.concat(F.lit("/"), kind))
    return route(tables.table(spark, sf_dir, "events").select("event_id", method.alias("method"), path.alias("path"))).groupBy("target", "status").agg(F.count("*").alias("n"))


def q_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql(spark)
    e = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"))
    return e.selectExpr("vec_id", "quantize10k(x) as q", "grid_axis(quantize10k(x)) as cell", "quantize10k(clamp01(x)) as held")


def _scratch(spark: SparkSession) -> str:
    """A folder that all executors share; it goes when the session's JVM ends."""
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    at = f"{sc.getCheckpointDir()}/query-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def q_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    ix.save(built(spark, sf_dir)[1], path)
    return ix.load(spark, path).vectors.groupBy("cid").agg(F.count("*").alias("n"), F.sum("ref_id").alias("ids"), F.sum("fraud").alias("frauds"))


def q_stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload bodies as a stream of files, scored in micro-batches."""
    path = _scratch(spark)
    t = bodies(spark, sf_dir)
    index = ix.build(transactions(spark, sf_dir), 14, CLUSTERS, ROUNDS, PARAMS)
    ix.save(index, f"{path}/index")
    t.where("ref_id % 50 = 0").select(F.col("ref_id").alias("qid"), "body").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("qid bigint, body string").option("maxFilesPerTrigger", 8).parquet(f"{path}/in")
    score_stream(stream, ix.load(spark, f"{path}/index"), tables.default_risks(spark), f"{path}/out", f"{path}/state", PARAMS).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("qid", "approved", "fraud_score", "body")


def queries() -> dict[str, Query]:
    own = {k: f for k, f in globals().items() if k.startswith("q_")}
    return own | {"q_ivf_probe5": _probe(5), "q_ivf_probe16": _probe(16)}

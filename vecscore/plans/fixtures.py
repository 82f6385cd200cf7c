"""Workloads derived from the test tables: payloads from events, labelled vectors from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.payload import features, with_risk
from ..functions.vector import quantize_vector
from ..sources.tables import default_risks, table

QUERY_STEP = 50
MCC = {"click": "5411", "view": "5812", "purchase": "5999", "signup": "7995"}


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, v, fraud, e): quantized vectors; labels 0 to 2 are frauds; e is the float vector."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("ref_id"), quantize_vector(F.col("embedding")).alias("v"), (F.col("label") < 3).cast("int").alias("fraud"), F.col("embedding").alias("e"))


def asked(refs: DataFrame) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 50."""
    return refs.where(F.col("ref_id") % QUERY_STEP == 0).withColumnRenamed("ref_id", "qid")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, label fields, payload structs) of every event."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", k.alias("k"), (F.round(F.col("value") * 100).cast("bigint") * 20).alias("cents"))
    e = e.withColumn("mid", F.concat(F.lit("MERC-"), F.lpad((F.col("k") % 40).cast("string"), 3, "0")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-86_400_000_000, 0)
    merchant = e.groupBy("mid").agg(F.sum("cents").alias("msum"), F.count("*").alias("mn"))
    e = e.select(
        "*", F.sum("cents").over(before).alias("s"), F.count("*").over(before).alias("n"), (F.count("*").over(day) - 1).alias("c24"),
        F.array_sort(F.array_distinct(F.collect_list("mid").over(w.rowsBetween(-20, -1)))).alias("known"), F.lag("ts").over(w).alias("lts"), F.lag("k").over(w).alias("lk"),
    ).join(merchant, "mid")
    money = lambda cents, n: (cents.cast("double") / n / 100).cast("float")
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    f = lambda c: c.cast("float")
    mcc = F.lit("0000")
    for kind, code in MCC.items():
        mcc = F.when(F.col("event_type") == kind, code).otherwise(mcc)
    fraud = (F.col("event_type").isin("signup", "error") & (F.col("k") >= 50)) | (F.col("k") >= 90)
    return e.select(
        F.col("event_id").alias("ref_id"), fraud.cast("int").alias("fraud"), F.col("event_id").cast("string").alias("id"),
        F.struct((F.col("cents").cast("double") / 100).cast("float").alias("amount"), (F.col("k") % 14).cast("double").alias("installments"), iso(F.col("ts")).alias("requested_at")).alias("transaction"),
        F.struct(F.when(F.col("n") > 0, money(F.col("s"), F.col("n"))).alias("avg_amount"), F.col("c24").cast("double").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(F.col("mid").alias("id"), mcc.alias("mcc"), money(F.col("msum"), F.col("mn")).alias("avg_amount")).alias("merchant"),
        F.struct(F.col("event_type").isin("click", "view", "signup").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"), f(F.col("k") * 37 % 1200).alias("km_from_home")).alias("terminal"),
        F.when(F.col("lts").isNotNull(), F.struct(iso(F.col("lts")).alias("timestamp"), f(F.abs(F.col("k") - F.col("lk")) * 13).alias("km_from_current"))).alias("last_transaction"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, v, fraud): features of every event."""
    return features(with_risk(payloads(spark, sf_dir), default_risks(spark)), keep=["ref_id", "fraud"])


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, fraud, body): the payloads as JSON text."""
    p = payloads(spark, sf_dir)
    return p.select("ref_id", "fraud", F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction")).alias("body"))

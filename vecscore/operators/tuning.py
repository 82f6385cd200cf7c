"""Sampling, threshold tuning, accuracy and workload reports on the neighbours table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import NEVER, SearchParams
from .search import probe_votes

NPROBES = (4, 6, 8, 10, 12, 16, 24)


def every(df: DataFrame, n: int, id_: str = "ref_id") -> DataFrame:
    """Every n-th row by id."""
    return df.where(F.col(id_) % n == 0)


def fast_and_full(queries: DataFrame, near: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """(qid, fast, worst, full): fraud counts of both passes and the fast pass's worst distance."""
    a = probe_votes(queries, near, p.fast, p).select("qid", F.col("cnt").alias("fast"), "worst")
    return a.join(probe_votes(queries, near, p.full, p).select("qid", F.col("cnt").alias("full")), "qid")


def disagreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("total"), F.count_if(F.col("fast") != F.col("full")).alias("disagree"))


def _nearest_rank(sorted_: Column, num: int, den: int) -> Column:
    return F.get(sorted_, F.floor(F.size(sorted_) * num / den).cast("int"))


def thresholds(pairs: DataFrame, k: int = 5) -> DataFrame:
    """(fast, n, p10, p50, p90, fast_t) for fast counts 0 to k; nearest rank (n * q) div 10 of the worst distances of
    disagreeing queries. The threshold is p10, NEVER where passes never disagree. Distances are counted by value first,
    so a group is a list of distinct values with counts, not of queries."""
    apart = pairs.where(F.col("fast") != F.col("full")).groupBy("fast", "worst").agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    upto = F.sum("c").over(Window.partitionBy("fast").orderBy("worst"))
    total = F.sum("c").over(Window.partitionBy("fast"))
    ranked = apart.select("fast", "worst", upto.alias("upto"), total.alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q / 10), F.col("worst")))
    got = ranked.groupBy("fast").agg(F.max("n").alias("n"), at(1).alias("p10"), at(5).alias("p50"), at(9).alias("p90"))
    spark = pairs.sparkSession
    counts = spark.range(k + 1).select(F.col("id").cast("int").alias("fast"))
    return counts.join(got, "fast", "left").select("fast", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "p10", "p50", "p90", F.coalesce("p10", F.lit(NEVER)).alias("fast_t"))


def confusion(queries: DataFrame, near: DataFrame, expected: DataFrame, nprobes: tuple[int, ...] = NPROBES, p: SearchParams = SearchParams()) -> DataFrame:
    """(nprobe, total, frauds, fn, fp, wrong, fn_rate, fp_rate) against expected (qid, approved); one pass over the table for all nprobes."""
    spark = near.sparkSession
    table = F.broadcast(spark.createDataFrame([(n, p.probes(n)) for n in nprobes], "nprobe int, most int"))
    rows = near.join(table, F.col("probe_rk") <= F.col("most"))
    from pyspark.sql import Window

    rk = F.row_number().over(Window.partitionBy("nprobe", "qid").orderBy("dist", "ref_id"))
    cnt = rows.withColumn("rk", rk).where(F.col("rk") <= p.k).groupBy("nprobe", "qid").agg(F.sum("fraud").alias("cnt"))
    every_ = expected.crossJoin(table.select("nprobe")).join(cnt, ["nprobe", "qid"], "left").withColumn("ok", F.coalesce("cnt", F.lit(0)) * 5 < 3 * p.k)
    out = every_.groupBy("nprobe").agg(
        F.count("*").alias("total"), F.count_if(~F.col("approved")).alias("frauds"), F.count_if(F.col("ok") & ~F.col("approved")).alias("fn"), F.count_if(~F.col("ok") & F.col("approved")).alias("fp"),
    )
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 8))
    return out.select("*", (F.col("fn") + F.col("fp")).alias("wrong"), rate(F.col("fn"), F.col("frauds")).alias("fn_rate"), rate(F.col("fp"), F.col("total") - F.col("frauds")).alias("fp_rate"))


def workload(queries: DataFrame, near: DataFrame, passes: int = 4, p: SearchParams = SearchParams()) -> DataFrame:
    """Checksum of fraud counts over repeated passes."""
    return probe_votes(queries, near, p.full, p).agg(F.count("*").alias("n"), (F.sum("cnt") * passes).cast("bigint").alias("checksum"))


def round_robin(rows: DataFrame, seq: str, n: int) -> DataFrame:
    """rows with backend: the sequence number dealt in turn."""
    return rows.withColumn("backend", (F.col(seq) % n).cast("int"))

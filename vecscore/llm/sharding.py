"""Two-pass external shuffle into shards, with DataFrame functions only.

Placement. A row's shard is the one with the highest seeded hash of (id, shard): the id and the number of
shards decide (law `key`), and with one shard more a row either stays or goes to the new one.

Pass 1 scatters each shard's rows into buckets by a seeded hash of id and text. The number of buckets comes
from the table's row count and bytes, so that a bucket fits a task's memory whatever the table's size. Rows of one id and text would
all hash alike: where there are more of them than a fraction of a bucket, they are numbered first (within the parts of a written table, plus
the parts before) and their number is hashed too, in runs of that fraction, so a bucket's size holds for equal rows as well.
Pass 2 sorts a bucket's rows (so that a retried task sees the same order), shuffles them by Spark's
seeded Fisher-Yates `shuffle`, and numbers them; a bucket's first slot is the number of rows in the
earlier buckets of its shard, from a broadcast table of one row for each bucket.

Nulls: a null text counts no bytes; a null id is placed as any other value. Repeated rows get slots of
their own; the slots of rows are the same in every run, whatever the table's partitions, except that rows of one id and text that differ in other columns may swap theirs.
An empty table gives an empty table. A very long text is one row of its bucket. Payload columns may have any names: they travel in a struct, and result
columns replace those of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 8
SEED = 7
RESULT = ("size", "text_crc32", "shard", "slot", "grown_shard")
BUCKET_ROWS = 20_000
BUCKET_BYTES = 8 << 20  # a task holds a few copies of its bucket


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard with the greatest hash of (seed, key, shard)."""
    return F.greatest(*(F.struct(F.xxhash64(F.lit(seed), key.cast("string"), F.lit(s)), F.lit(s).alias("shard")) for s in range(shards)))["shard"] if shards > 1 else F.lit(0)


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(F.encode(text, "utf-8"), F.lit(b"")))


def _spread(own: DataFrame, run: int) -> DataFrame:
    """own with `deal`, the hash by which a row is dealt: scatter, or for over `run` rows of one scatter that and the row's number among them div run."""
    many = materialize(own.groupBy("scatter").agg(F.count("*").alias("c")).where(F.col("c") > run).select("scatter"))
    if not many.limit(1).count():
        return own.withColumn("deal", F.col("scatter"))
    rest = own.join(many, "scatter", "left_anti").withColumn("deal", F.col("scatter"))
    hot = materialize(own.join(many, "scatter").withColumn("part", F.monotonically_increasing_id()))
    hot = hot.withColumn("part", F.floor(F.col("part") / run))  # a part's rows are of one partition, run at most
    counts = hot.groupBy("scatter", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("scatter").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = materialize(counts.select("scatter", "part", F.coalesce(before, F.lit(0)).alias("first")))
    at = F.row_number().over(Window.partitionBy("scatter", "part").orderBy("scatter")) - 1
    rows = hot.withColumn("at", at).join(first, ["scatter", "part"])
    deal = F.xxhash64("scatter", F.floor((F.col("first") + F.col("at")) / run))
    return rest.unionByName(rows.withColumn("deal", deal).drop("part", "at", "first"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", payload: list[str] | None = None,
               bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The payload columns (all of docs, unless named) of every row with size (bytes of text plus 1), text_crc32, shard, slot, grown_shard."""
    payload = [c for c in (docs.columns if payload is None else payload) if c not in RESULT]
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in payload)).alias("row"), (text_bytes(F.col(text)) + 1).alias("size"), text_crc32(F.col(text)).alias("text_crc32"),
        shard_of(F.col(doc_id), shards, seed).alias("shard"), shard_of(F.col(doc_id), shards + 1, seed).alias("grown_shard"),
        F.xxhash64(F.lit(seed), F.lit("scatter"), F.col(doc_id).cast("string"), F.col(text)).alias("scatter"),
    )
    rows, size = docs.agg(F.count("*"), F.sum(text_bytes(F.col(text)) + 1)).first()
    moved = size or 0 if text in payload else 0  # a bucket's bytes are those of the texts that travel
    per_shard = max(1, math.ceil(rows / shards / bucket_rows), math.ceil(moved / shards / bucket_bytes))
    own = _spread(own, max(1, bucket_rows // 8))
    bucket = F.col("shard") * per_shard + F.pmod("deal", F.lit(per_shard))
    scattered = own.withColumn("bucket", bucket.cast("int")).drop("deal").repartition(shards * per_shard, "bucket")
    order = F.struct("scatter", "size", "text_crc32", "shard", "grown_shard", "row")
    buckets = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list(order)).alias("rows")).sortWithinPartitions("bucket")
    shuffled = materialize(buckets.select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = shuffled.select("bucket", F.floor(F.col("bucket") / per_shard).alias("shard"), F.size("rows").cast("bigint").alias("n"))
    first = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("first"))
    out = shuffled.join(F.broadcast(first), "bucket").select("first", F.posexplode("rows").alias("at", "r"))
    return out.select("r.row.*", "r.size", "r.text_crc32", "r.shard", (F.col("first") + F.col("at")).alias("slot"), "r.grown_shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order within a file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

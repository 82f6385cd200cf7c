"""Thin queries over whole tables: one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle, toxicity
from .common import sha256_hex, table
from .decontaminate import decontaminate
from .language import crc_part, identify
from .lines import dedup_lines
from .minhash import near_duplicates
from .pieces import encode
from .pii import KINDS, personal_data, span_list
from .quality import quality
from .repeats import repeated_spans
from .sharding import shard_rows, text_bytes, text_crc32


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + (x["e"] - x["s"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    of_kind = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    place = lambda x: F.array_position(F.array(*map(F.lit, [*KINDS, "key"])), x["kind"])
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(place(x).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return out.select("doc_id", *counts, sha256_hex(span_list(F.col("base"))).alias("base_sha256"), span_list(order).alias("spans"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", sha256_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of every row go into the shards; size and checksum are those of the text that came there."""
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (text_bytes(F.col("text")) + 1).alias("size"), text_crc32(F.col("text")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=base)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *base, failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(F.col("kept")).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_part(F.col("doc_id"), 5) == 0, F.lit(True))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    out = toxicity.score(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", F.coalesce(crc_part(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_repeats": op2_repeats,
        "op3_personal_data": op3_personal_data,
        "op4_language": op4_language,
        "op5_lines": op5_lines,
        "op6_pieces": op6_pieces,
        "op7_sharding": op7_sharding,
        "op8_quality": op8_quality,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()

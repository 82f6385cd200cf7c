"""A training corpus in five stages, each written as Parquet before the next one reads it.

1. toxicity: documents that the convolutional classifier calls toxic go.
2. line dedup: later repeated runs of lines are cut; documents that consisted of nothing else go.
3. MinHash near-dedup: of each class of near duplicates the document with the smallest id stays.
4. benchmark decontamination: documents with a benchmark window go.
5. SentencePiece encoding: piece ids of what is left.

Every stage works on all that the one before kept. All but the last return the columns of documents, with
n_chars kept in step with the text.

Rows are told apart by themselves: repeated and null ids are rows of their own in every stage. Null and empty texts are not toxic, have no lines,
near duplicates, benchmark windows or pieces, and stay. Of equal ids in a class of near duplicates the first row stays. An empty table gives empty
stages (and no classifier). Ties, very long texts and columns with clashing names are as in the operators' modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.llm import toxicity
from vecscore.llm.common import fresh, materialize, numbered, table
from vecscore.llm.decontaminate import decontaminate
from vecscore.llm.language import crc_part
from vecscore.llm.lines import dedup_lines
from vecscore.llm.minhash import near_duplicates
from vecscore.llm.pieces import encode

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_part(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    left = F.coalesce(F.trim(F.translate("text", "\n\t\r", "   ")), F.lit("")) != ""
    out = out.where((F.col("n_removed") == 0) | left)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, key = fresh(docs, "__row"), fresh(docs, "__key")
    rows = numbered(docs, row)  # repeated ids are rows of their own: of equal ids the first row counts as smaller
    keyed = rows.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.col(row).alias("row")))
    gone = near_duplicates(keyed, doc_id=key).where("not kept").select(F.col(f"{key}.row").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return out.where("not contaminated").select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, keep=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

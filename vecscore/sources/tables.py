"""Sources and sinks: reference vectors, configuration, evaluation sets, results of jobs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import quantize_vector
from ..params import MCC_RISK, Norm
from .checkpoint import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, vector, label) of a JSON array (also gzipped), or of several files one behind the other. The place in the array is the id: numbers
    are given right after the scan and written, so that they are the same for all that follows, then closed up over the parts."""
    rows = spark.read.schema("vector ARRAY<FLOAT>, label STRING").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = cut(rows.select(F.monotonically_increasing_id().alias("at"), "vector", "label"))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each part of the scan
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = F.broadcast(counts.select("part", F.coalesce(before, F.lit(0)).alias("first")))
    return rows.withColumn("part", part).join(first, "part").select((F.col("first") + within).alias("ref_id"), "vector", "label")


def labelled(references: DataFrame) -> DataFrame:
    """(ref_id, v, fraud): quantized vectors; any label but 'fraud' is legitimate."""
    return references.select("ref_id", quantize_vector(F.col("vector")).alias("v"), (F.coalesce(F.col("label"), F.lit("")) == "fraud").cast("int").alias("fraud"))


def read_norm(spark: SparkSession, path: str) -> Norm:
    """All constants are mandatory."""
    text = "\n".join(r[0] for r in spark.read.text(path).collect())  # one small object
    got = json.loads(text)
    return Norm(**{k: float(got[k]) for k in Norm.__dataclass_fields__})


def read_risks(spark: SparkSession, path: str) -> DataFrame:
    """(mcc, risk) of a JSON object; keys that are no 16-bit number are dropped."""
    body = spark.read.option("wholetext", True).text(path)
    rows = body.select(F.explode(F.from_json("value", "map<string,float>")).alias("code", "risk"))
    return rows.select(F.col("code").try_cast("int").alias("mcc"), "risk").where(F.col("mcc").between(0, 65535))


def default_risks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MCC_RISK.items()), "mcc int, risk float")


def read_eval(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """(qid, request fields, expected_approved) of {"entries": [{"request": {...}, "expected_approved": ...}]}."""
    schema = f"entries ARRAY<STRUCT<request: STRUCT<{_inner(ddl)}>, expected_approved: BOOLEAN>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.posexplode("entries").alias("qid", "e")).select(F.col("qid").cast("bigint"), "e.request.*", "e.expected_approved")


def _inner(ddl: str) -> str:
    out, depth = [], 0
    for word in ddl.replace("\n", " ").split(" "):
        out.append(word + ":" if depth == 0 and word and (not out or out[-1].endswith(",")) else word)
        depth += word.count("<") - word.count(">")
    return " ".join(out)


def write_csv(report: DataFrame, path: str) -> None:
    """With a header; rates with eight decimals."""
    rates = [f.name for f in report.schema.fields if f.dataType.simpleString() in ("float", "double")]
    report = report.withColumns({c: F.format_string("%.8f", c) for c in rates}) if rates else report
    report.coalesce(1).write.option("header", True).csv(path)  # a few rows

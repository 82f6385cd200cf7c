"""Transaction payloads: JSON bodies to structs, structs to 14 quantized features.

Deliberate differences to a byte scanner: fields are found by path, not by position; times are true UTC
epochs; numeric merchant categories are accepted; malformed or empty bodies give all defaults and a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT_RISK, Norm
from .vector import clamp01, divide, f32, quantize

DDL = """id STRING,
transaction STRUCT<amount: FLOAT, installments: DOUBLE, requested_at: STRING>,
customer STRUCT<avg_amount: FLOAT, tx_count_24h: DOUBLE, known_merchants: ARRAY<STRING>>,
merchant STRUCT<id: STRING, mcc: STRING, avg_amount: FLOAT>,
terminal STRUCT<is_online: BOOLEAN, card_present: BOOLEAN, km_from_home: FLOAT>,
last_transaction STRUCT<timestamp: STRING, km_from_current: FLOAT>"""
KNOWN = 16


def parse(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The body's fields beside the other columns, and _corrupt where it is no JSON object."""
    p = F.from_json(F.col(body), DDL.replace("\n", " "))
    out = bodies.withColumn("__p", p).withColumn("_corrupt", F.coalesce(F.try_parse_json(F.col(body)).isNull() | ~F.ltrim(F.col(body)).startswith("{"), F.lit(True)))
    return out.select(*[c for c in bodies.columns if c != body], "__p.*", "_corrupt")


def local_time(s: Column) -> Column:
    """Timestamp of the first 19 characters (offset and fraction are ignored); null if malformed."""
    return F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


REQUIRED = (
    "id", "transaction.amount", "transaction.installments", "customer.avg_amount", "customer.tx_count_24h", "customer.known_merchants",
    "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home",
)


def rejects(parsed: DataFrame) -> DataFrame:
    """parsed with `_reject`, for callers who refuse what isn't complete: a body that is no object, a missing field, or a malformed time."""
    bad = F.col("_corrupt") | local_time(F.col("transaction.requested_at")).isNull()
    for name in REQUIRED:
        bad = bad | F.col(name).isNull()
    last = F.col("last_transaction").isNotNull() & (local_time(F.col("last_transaction.timestamp")).isNull() | F.col("last_transaction.km_from_current").isNull())
    return parsed.withColumn("_reject", bad | last)


def category(mcc: Column) -> Column:
    """Number made of the digits."""
    return F.regexp_replace(mcc, "[^0-9]", "").try_cast("int")


def with_risk(payloads: DataFrame, risks: DataFrame) -> DataFrame:
    """payloads with `risk` from (mcc INT, risk FLOAT); at most 65536 codes, so the table can be broadcast."""
    code = risks.where(F.col("mcc").between(0, 65535)).select(F.col("mcc").alias("__mcc"), F.col("risk").alias("__risk"))
    joined = payloads.join(F.broadcast(code), category(F.col("merchant.mcc")) == F.col("__mcc"), "left")
    return joined.withColumn("risk", F.coalesce("__risk", f32(DEFAULT_RISK))).drop("__mcc", "__risk")


def whole(x: Column) -> Column:
    """Truncated number, 0 if missing."""
    return f32(F.coalesce(x.try_cast("int"), F.lit(0)))


YEAR_ONE = -62135596800


def float_features(payloads: DataFrame, norm: Norm = Norm(), keep: list[str] | None = None) -> DataFrame:
    """The kept columns and v, 14 features as 32-bit floats without quantization, in 64-bit steps. Times are RFC 3339 with their offset; a malformed
    one is the first second of year 1. All known merchants count; an amount over an average of 0 is 1 (0 over 0: NaN)."""
    get = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    seconds = lambda c: F.coalesce(F.unix_micros(F.try_to_timestamp(F.when(F.col(c).rlike(r"(?:Z|[+-][0-9]{2}:[0-9]{2})$"), F.col(c)))) / F.lit(1e6), F.lit(float(YEAR_ONE)))
    clamp = lambda x: F.when(F.isnan(x), x).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    at, last = seconds("transaction.requested_at"), seconds("last_transaction.timestamp")
    amount, avg = get("transaction.amount"), get("customer.avg_amount")
    ratio = F.when(avg == 0, F.when(amount > 0, 1.0).when(amount < 0, 0.0).otherwise(float("nan"))).otherwise(clamp(amount / F.when(avg == 0, 1.0).otherwise(avg) / norm.amount_vs_avg_ratio))
    first = F.col("last_transaction").isNull()
    known = F.coalesce(F.array_contains("customer.known_merchants", F.col("merchant.id")), F.lit(False))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    count = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)).cast("double")
    dims = [
        clamp(amount / norm.max_amount), clamp(count("transaction.installments") / norm.max_installments), ratio,
        F.pmod(F.floor(at / 3600), F.lit(24)) / 23, F.pmod(F.floor(at / 86400) + 3, F.lit(7)) / 6,
        F.when(first, -1.0).otherwise(clamp((at - last) / 60 / norm.max_minutes)), F.when(first, -1.0).otherwise(clamp(get("last_transaction.km_from_current") / norm.max_km)),
        clamp(get("terminal.km_from_home") / norm.max_km), clamp(count("customer.tx_count_24h") / norm.max_tx_count_24h), flag("terminal.is_online"), flag("terminal.card_present"),
        F.when(known, 0.0).otherwise(1.0), F.col("risk").cast("double"), clamp(get("merchant.avg_amount") / norm.max_merchant_avg_amount),
    ]
    return payloads.select(*(keep or []), F.array(*(d.cast("float") for d in dims)).alias("v"))


def features(payloads: DataFrame, norm: Norm = Norm(), keep: list[str] | None = None) -> DataFrame:
    """The kept columns and v, the 14 quantized features of rows as of parse() with `risk`."""
    zero = f32(0.0)
    get = lambda name: F.coalesce(F.col(name), zero)
    amount = get("transaction.amount")
    avg = F.when(F.col("customer.avg_amount") > 0, F.col("customer.avg_amount")).otherwise(f32(1.0))
    at, last = local_time(F.col("transaction.requested_at")), local_time(F.col("last_transaction.timestamp"))
    seconds = lambda t: F.coalesce(F.unix_seconds(t), F.lit(0))
    minutes = divide(F.greatest(seconds(at) - seconds(last), F.lit(0)).cast("float"), 60.0)
    first = F.col("last_transaction").isNull()
    known = F.coalesce(F.array_contains(F.slice("customer.known_merchants", 1, KNOWN), F.col("merchant.id")), F.lit(False))
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), f32(1.0)).otherwise(zero)
    dims = [
        clamp01(divide(amount, norm.max_amount)),
        clamp01(divide(whole(F.col("transaction.installments")), norm.max_installments)),
        clamp01(divide(divide(amount, avg), norm.amount_vs_avg_ratio)),
        divide(F.coalesce(F.hour(at), F.lit(0)).cast("float"), 23.0),
        divide(F.coalesce(F.weekday(at), F.lit(0)).cast("float"), 6.0),
        F.when(first, f32(-1.0)).otherwise(clamp01(divide(minutes, norm.max_minutes))),
        F.when(first, f32(-1.0)).otherwise(clamp01(divide(get("last_transaction.km_from_current"), norm.max_km))),
        clamp01(divide(get("terminal.km_from_home"), norm.max_km)),
        clamp01(divide(whole(F.col("customer.tx_count_24h")), norm.max_tx_count_24h)),
        flag("terminal.is_online"),
        flag("terminal.card_present"),
        F.when(known, zero).otherwise(f32(1.0)),
        f32(F.col("risk")),
        clamp01(divide(get("merchant.avg_amount"), norm.max_merchant_avg_amount)),
    ]
    return payloads.select(*(keep or []), F.array(*(quantize(d) for d in dims)).alias("v"))

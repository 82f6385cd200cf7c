"""Column expressions on quantized vectors (array<int>, values within +-scale)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def f32(c: Column | float) -> Column:
    return (F.lit(c) if isinstance(c, (int, float)) else c).cast("float")


def divide(a: Column, b: Column | float) -> Column:
    """32-bit quotient: Spark's float division gives a double."""
    return (a / f32(b)).cast("float")


def guarded_ratio(x: Column, most: Column) -> Column:
    """x / most held within 0 and 1; 0 where most is 0."""
    return F.when(most == 0, f32(0.0)).otherwise(clamp01(divide(x, F.when(most == 0, f32(1.0)).otherwise(most))))


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(f32(1.0), F.greatest(f32(0.0), x)))


def quantize(x: Column, scale: int = 10000) -> Column:
    """32-bit product rounded half away from zero, held within +-scale; NaN is 0."""
    y = F.round(x.cast("float") * f32(float(scale)))
    return F.when(F.isnan(x), 0).otherwise(F.least(f32(float(scale)), F.greatest(f32(float(-scale)), y)).cast("int"))


def quantize_vector(v: Column, scale: int = 10000) -> Column:
    return F.transform(v, lambda x: quantize(x, scale))


def l2sq(a: Column, b: Column) -> Column:
    """Squared distance of two integer vectors, in 64 bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("bigint") * (x - y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def box_bound(q: Column, mn: Column, mx: Column) -> Column:
    """Squared distance of q to the box [mn, mx]: a lower bound of the distance to any vector in it."""
    gap = F.transform(F.arrays_zip(q.alias("q"), mn.alias("mn"), mx.alias("mx")), lambda x: F.greatest(x["mn"] - x["q"], x["q"] - x["mx"], F.lit(0)).cast("bigint"))
    return F.aggregate(gap, F.lit(0).cast("bigint"), lambda s, g: s + g * g)


def float_box_bound(q: Column, mn: Column, mx: Column) -> Column:
    """box_bound() of float vectors, in 64-bit floats."""
    gap = F.transform(F.arrays_zip(q.alias("q"), mn.alias("mn"), mx.alias("mx")), lambda x: F.greatest(x["mn"] - x["q"], x["q"] - x["mx"], F.lit(0)).cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)


def axis(v: Column, cells: int = 32, scale: int = 10000) -> Column:
    """Cell of a coordinate on one grid axis."""
    return F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor((v + scale) / F.lit(2 * scale / cells)).cast("int")))


def register_sql(spark: SparkSession) -> None:
    """clamp01, quantize10k and grid_axis for spark.sql()."""
    for name, arg, out, body in (
        ("clamp01", "x FLOAT", "FLOAT", "least(1f, greatest(0f, x))"),
        ("quantize10k", "x FLOAT", "INT", "cast(least(10000f, greatest(-10000f, round(x * 10000f))) as int)"),
        ("grid_axis", "v INT", "INT", "cast(least(31, greatest(0, (v + 10000) div 625)) as int)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arg}) RETURNS {out} RETURN {body}")

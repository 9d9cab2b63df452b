"""Safe arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """n/0 is infinite for n > 0, 0/0 is 0; nulls count as 0."""
    n, d = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (numerator, denominator))
    return F.when(d != 0, n / d).when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))


def mean_or_zero(total: Column, n: Column) -> Column:
    return F.when(n > 0, total.cast("double") / n).otherwise(F.lit(0.0))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def scale_to_u8(rows: DataFrame, column: str, into: str = "u8") -> DataFrame:
    """Finite values from their least to their greatest onto 0 to 255, others to
    0; a constant column becomes 0. The bounds are one row."""
    finite = F.when(is_finite(F.col(column)), F.col(column).cast("double"))
    bounds = rows.agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    spread = F.col("_high") - F.col("_low")
    scaled = F.when(finite.isNotNull() & (spread > 0), F.rint((finite - F.col("_low")) / spread * 255)).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(bounds)).withColumn(into, scaled.cast("int")).drop("_low", "_high")

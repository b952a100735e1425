"""Ordered per-key scans whose partitions stay bounded when one key is huge.

A plain ``Window.partitionBy(key).orderBy(pos)`` puts every row of a key in one task. Here
rows are cut into buckets of ``bucket`` consecutive positions; the scan runs inside each
(key, bucket) partition, and a one-row-per-bucket summary carries the state across
buckets (a window over the summaries: rows / bucket entries per key). Results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = 4096


def segmented_row_number(df: DataFrame, keys: list[str], pos: str, out: str,
                         bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """1-based rank of ``pos`` within ``keys`` (``pos`` unique per key, numeric)."""
    b = F.floor(F.col(pos) / F.lit(bucket)).alias("_bkt")
    d = df.withColumn("_bkt", b)
    sizes = d.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(*keys, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*keys, "_bkt").orderBy(pos)
    return (d.join(offs, [*keys, "_bkt"])
             .withColumn(out, (F.row_number().over(inner) + F.col("_off")).cast("int"))
             .drop("_bkt", "_off"))


def segmented_last_non_null(df: DataFrame, keys: list[str], pos: str, value: str, out: str,
                            bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """Last non-null ``value`` at or before ``pos`` within ``keys`` (carry-forward)."""
    d = df.withColumn("_bkt", F.floor(F.col(pos) / F.lit(bucket)))
    tagged = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    summ = d.groupBy(*keys, "_bkt").agg(F.max(tagged).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*keys, "_bkt", F.last(F.col("_last")["v"], ignorenulls=True).over(before).alias("_carry"))
    inner = Window.partitionBy(*keys, "_bkt").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (d.join(carry, [*keys, "_bkt"])
             .withColumn(out, F.coalesce(F.last(F.col(value), ignorenulls=True).over(inner), F.col("_carry")))
             .drop("_bkt", "_carry"))


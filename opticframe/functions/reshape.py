"""Reshapes of long vectors, and systematic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vec import total


def chunks(v: Column, size: int) -> Column:
    """Consecutive slices of so many elements; a shorter rest is left out."""
    n = F.floor(F.size(v) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(v, i * size + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def chunk_mean(v: Column, size: int = 8) -> Column:
    return F.transform(chunks(v, size), lambda c: total(c) / F.lit(float(size)))


def strided(v: Column, stride: int = 8) -> Column:
    """Vector j of the elements j, j + stride, j + 2 stride, ..."""
    n = F.floor(F.size(v) / F.lit(stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), lambda j: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(v, i * stride + j + 1)))


def systematic_sample(df: DataFrame, order: str, step: int = 10, limit: int | None = 10_000) -> DataFrame:
    """Every step-th row in order, and of these the first `limit`.

    Places come from counts of range partitions and a window in each, not from one sort of all rows.
    """
    parts = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    placed = ranked.join(F.broadcast(counts.drop("_n")), "_part").withColumn("_place", F.col("_rank") + F.col("_before"))  # a row for each partition
    keep = (F.col("_place") % step == 0) & (F.lit(limit is None) | (F.col("_place") / step < F.lit(limit or 0)))
    return placed.where(keep).drop("_part", "_rank", "_before", "_place")

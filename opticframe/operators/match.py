"""Descriptor matching by distance ratio, image scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nn import search


def ratio_match(source: DataFrame, target: DataFrame, absolute: float = 300.0, relative: float = 0.6, group: str | None = None, **cols) -> DataFrame:
    """(query_id, group, id, d1, d2): the best target of each source row (in each group of targets) if it is nearer than `absolute` and
    than `relative` times the second best; a lone candidate has no second and passes the second test."""
    two = search(source, target, k=2, group=group, **cols)
    best = two.groupBy("query_id", "group").agg(F.min_by("id", "rank").alias("id"), F.min("distance").alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
    return best.where((F.col("d1") < absolute) & (F.col("d2").isNull() | (F.col("d1") < relative * F.col("d2"))))


def image_scores(matches: DataFrame, descriptors: DataFrame, image: Column, id_col: str = "vec_id") -> DataFrame:
    """(source, target, score): matches over the larger count of descriptors, of image pairs with matches. matches: query_id, group (the target image)."""
    counts = descriptors.groupBy(image.alias("image")).agg(F.count(F.lit(1)).alias("n"))
    owner = descriptors.select(F.col(id_col).alias("query_id"), image.alias("source"))
    pairs = matches.join(owner, "query_id").groupBy("source", F.col("group").alias("target")).agg(F.count(F.lit(1)).alias("m"))
    sized = pairs.join(counts.select(F.col("image").alias("source"), F.col("n").alias("ns")), "source").join(counts.select(F.col("image").alias("target"), F.col("n").alias("nt")), "target")
    return sized.select("source", "target", (F.col("m") / F.greatest("ns", "nt")).alias("score"))


def records(scores: DataFrame, order: str = "target", last: int | None = 3) -> DataFrame:
    """(source, target, score, rank): targets, in order, whose score beats all before them and 0; the newest `last` of these, newest first."""
    before = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    kept = scores.withColumn("_best", F.coalesce(F.max("score").over(before), F.lit(0.0))).where(F.col("score") > F.greatest("_best", F.lit(0.0))).drop("_best")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col(order).desc())))
    return ranked if last is None else ranked.where(F.col("rank") <= last)


def match_rate(matches: DataFrame, detected: DataFrame, least: float = 0.8) -> DataFrame:
    """(matched, detected, rate, passed)."""
    both = matches.agg(F.count(F.lit(1)).alias("matched"), F.lit(1).alias("_k")).join(detected.agg(F.count(F.lit(1)).alias("detected"), F.lit(1).alias("_k")), "_k").drop("_k")
    rate = F.when(F.col("detected") > 0, F.col("matched") / F.col("detected"))
    return both.withColumn("rate", rate).withColumn("passed", F.coalesce(rate >= least, F.lit(False)))

"""Writers of ranked matches and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def nested_matches(sources: DataFrame, ranked: DataFrame) -> DataFrame:
    """(source, matches): each source with its few ranked matches (target, score), best rank first; an empty list for a source without any."""
    lists = ranked.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "target", "score"))).alias("m"))
    joined = sources.select("source").join(lists, "source", "left")
    empty = F.array().cast("array<struct<target:bigint,score:double>>")
    return joined.select("source", F.coalesce(F.transform("m", lambda s: F.struct(s["target"].cast("bigint").alias("target"), s["score"].cast("double").alias("score"))), empty).alias("matches"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The rows, or an error where there are none, as for an empty set of references."""
    if df.isEmpty():
        raise ValueError(f"there are no {what}")
    return df


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to Parquet once, until the input that is there now is used up."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

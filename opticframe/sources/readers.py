"""Readers of descriptor and keypoint text, images and frames, and generated names, vectors and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# What the numbers that begin a descriptor's line are; a keypoint's line has the first three.
DESCRIPTOR_LINE = ["y", "x", "sigma", "theta"]


def make_names(spark: SparkSession, prefix: str, extension: str, first: int, last: int) -> DataFrame:
    """(ord, name) of a closed range of numbers."""
    return spark.range(first, last + 1).select(F.col("id").alias("ord"), F.format_string(f"{prefix}%d{extension}", "id").alias("name"))


def scale_space_names(spark: SparkSession, name: str, octaves: int, scales: int, extension: str = "png") -> DataFrame:
    """(octave, scale, name), octave by octave."""
    at = spark.range(octaves * scales).select(F.floor(F.col("id") / scales).cast("int").alias("octave"), (F.col("id") % scales).cast("int").alias("scale"))
    return at.withColumn("name", F.format_string(f"{name}_o%03d_s%03d.{extension}", "octave", "scale"))


def parse_lines(lines: DataFrame, names: list[str], more: int) -> tuple[DataFrame, DataFrame]:
    """Lines (value) of space-separated numbers as columns `names` and so many whole numbers (features), and the lines that are none; blank lines are skipped."""
    lines = lines.select("value").where(F.trim("value") != "")
    parts = lines.select("value", F.split(F.trim("value"), r" +").alias("p"))
    at = lambda i: F.try_element_at("p", F.lit(i + 1)).try_cast("float")
    cols = [at(i).alias(n) for i, n in enumerate(names)]
    if more:
        cols.append(F.transform(F.slice("p", len(names) + 1, more), lambda x: x.try_cast("int")).alias("features"))
    read = parts.select("value", *cols)
    good = F.lit(True)
    for n in names:
        good = good & F.col(n).isNotNull()
    if more:
        good = good & (F.size("features") == more) & ~F.exists("features", lambda x: x.isNull())
    return read.where(good).drop("value"), read.where(~F.coalesce(good, F.lit(False))).select("value")


def read_descriptors(spark: SparkSession, path: str, length: int = 128) -> tuple[DataFrame, DataFrame]:
    """(y, x, sigma, theta, features) of space-separated lines, and the lines that are none; further columns are ignored."""
    return parse_lines(spark.read.text(path), DESCRIPTOR_LINE, length)


def read_keypoints(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(y, x, sigma), and the lines that are none."""
    return parse_lines(spark.read.text(path), DESCRIPTOR_LINE[:3], 0)


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, height, width, channels, data) of images; data interleaved, in blue-green-red order."""
    images = spark.read.format("image").option("pathGlobFilter", glob).option("dropInvalid", "true").load(path)
    return images.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def random_vectors(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    """(id, vec) uniform in [0, 1), by a hash of the seed, the id and the place."""
    place = lambda i: F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), place).alias("vec"))


def synthetic_frames(spark: SparkSession, frames: int = 4, height: int = 20, width: int = 24) -> DataFrame:
    """(video_id, frame_no, height, width, data) of grey frames by integer arithmetic."""
    f, w = F.col("id"), width
    value = lambda p: ((p % w * 7 + F.floor(p / w) * 13 + f * 5 + (p % w * F.floor(p / w)) % 11) % 256).cast("double")
    data = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), value)
    return spark.range(frames).select(F.lit("v").alias("video_id"), f.alias("frame_no"), F.lit(height).alias("height"), F.lit(width).alias("width"), data.alias("data"))


def read_frames(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Frames (Parquet files of the given schema) as a stream, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)

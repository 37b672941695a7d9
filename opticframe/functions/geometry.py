"""What an overlay would draw, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keypoint_circle(df: DataFrame) -> DataFrame:
    """Rows with cx, cy, r of a keypoint (x, y, sigma)."""
    return df.withColumns({"cx": F.col("x"), "cy": F.col("y"), "r": F.col("sigma")})


def descriptor_ray(df: DataFrame) -> DataFrame:
    """Rows with the circle (radius 1.5 sigma) of a descriptor (x, y, sigma, theta) and the end ex, ey of its orientation's ray."""
    r = 1.5 * F.col("sigma")
    return df.withColumns({"cx": F.col("x"), "cy": F.col("y"), "r": r, "ex": F.col("x") + F.cos("theta") * r, "ey": F.col("y") + F.sin("theta") * r})


def match_line(source_x: Column, source_y: Column, target_x: Column, target_y: Column, width: Column) -> Column:
    """struct(x1, y1, x2, y2) of a match drawn with the target image to the right of the source image."""
    return F.struct(source_x.alias("x1"), source_y.alias("y1"), (target_x + width).alias("x2"), target_y.alias("y2"))

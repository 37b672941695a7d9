"""Image operators: a frame is a row, its pixels an array; each operator is one pass without a shuffle.

Defined results: a frame whose pixels are null, hold a null or are not height x width passes with null pixels; NaN and
infinite pixels count as any number does in arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrays import images, lists

# The two gradient kernels, by rows.
SOBEL_X = np.array([[1.0, 0, -1], [2, 0, -2], [1, 0, -1]])
SOBEL_Y = np.array([[1.0, 2, 1], [0, 0, 0], [-1, -2, -1]])
#: Weights of red, green and blue in grey (ITU-R BT.601).
GREY = (0.299, 0.587, 0.114)
FRAME = "video_id string, frame_no long, height int, width int, data array<double>"


def gaussian(sigma: float, radius: int | None = None) -> np.ndarray:
    """Normalised weights at -radius..radius."""
    at = np.arange(-(radius or int(np.ceil(3 * sigma))), (radius or int(np.ceil(3 * sigma))) + 1)
    w = np.exp(-(at**2) / (2 * sigma**2))
    return w / w.sum()


def stencil(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with a kernel; beyond the edge the edge's pixel counts."""
    h, w = image.shape
    kh, kw = kernel.shape
    wide, out = np.pad(image, ((kh // 2, kh // 2), (kw // 2, kw // 2)), "edge"), np.zeros_like(image)
    for y, x in zip(*np.nonzero(kernel)):
        out += kernel[y, x] * wide[y : y + h, x : x + w]
    return out


def blur(image: np.ndarray, sigma: float = 5.0) -> np.ndarray:
    w = gaussian(sigma)
    return stencil(stencil(image, w[None]), w[:, None])


def resize(image: np.ndarray, height: int, width: int, lobes: int = 1) -> np.ndarray:
    """Pixel centres meet; lobes 1: bilinear, 3: Lanczos over three lobes, widened when the image shrinks."""

    def weights(n: int, m: int) -> np.ndarray:
        step = n / m
        spread = max(1.0, step) if lobes > 1 else 1.0
        d = (np.arange(n) - ((np.arange(m) + 0.5) * step - 0.5)[:, None]) / spread
        if lobes == 1:
            centre = np.clip((np.arange(m) + 0.5) * step - 0.5, 0, n - 1)
            w = np.maximum(0, 1 - np.abs(np.arange(n) - centre[:, None]))
        else:
            w = np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0)
        return w / w.sum(1, keepdims=True)

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def per_frame(frames: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Frames with f of each image."""
    ship(frames.sparkSession)

    def mapped(batches):
        for batch in batches:
            out = [None if a is None else f(a) for a in images(batch)]
            sides = [pa.array([given if a is None else a.shape[k] for a, given in zip(out, batch.column(name).to_pylist())], pa.int32()) for k, name in enumerate(("height", "width"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sides, lists(out)], names=names)

    names = ["video_id", "frame_no", "height", "width", "data"]
    given = [F.col("video_id").cast("string"), F.col("frame_no").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("data").cast("array<double>")]
    return frames.select(*given).mapInArrow(mapped, FRAME)


def preprocess(frames: DataFrame, height: int, width: int, sigma: float = 5.0) -> DataFrame:
    """Grey frames blurred and then brought to a size by Lanczos: what flow is solved on."""
    return per_frame(frames, lambda a: resize(blur(a, sigma), height, width, 3))


def grey_frames(images: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """Frames of decoded images (path, height, width, channels, data: interleaved bytes, blue, green, red[, alpha], or grey): video_id is the path,
    frame_no 0, pixels are grey from 0 to 255, brought bilinearly to a size if one is given.  Bytes that are null or too few or many give null pixels."""
    ship(images.sparkSession)

    def greyed(batches):
        for batch in batches:
            out = []
            for h, w, c, data in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                whole = data is not None and h and w and c in (1, 3, 4) and len(data) == h * w * c
                if not whole:
                    out.append(None)
                    continue
                x = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
                out.append(x[:, :, 0] if c == 1 else GREY[0] * x[:, :, 2] + GREY[1] * x[:, :, 1] + GREY[2] * x[:, :, 0])
            if height and width:
                out = [a if a is None or a.shape == (height, width) else resize(a, height, width) for a in out]
            sides = [pa.array([given if a is None else a.shape[k] for a, given in zip(out, batch.column(1 + k).to_pylist())], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(out), np.int64)), *sides, lists(out)], names=["video_id", "frame_no", "height", "width", "data"])

    given = [F.col("path").cast("string"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("channels").cast("int"), F.col("data").cast("binary")]
    return images.select(*given).mapInArrow(greyed, FRAME)


def pixels(frames: DataFrame) -> DataFrame:
    """(video_id, frame_no, y, x, v)."""
    at = frames.select("video_id", "frame_no", "width", F.posexplode("data").alias("p", "v"))
    return at.select("video_id", "frame_no", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), "v")


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.lit(GREY[0]) * r + F.lit(GREY[1]) * g + F.lit(GREY[2]) * b


def to_linear(v: Column) -> Column:
    """sRGB to linear light (IEC 61966-2-1)."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def compare(a: DataFrame, b: DataFrame, threshold: float = 0.005) -> DataFrame:
    """(video_id, frame_no, pixels, different, largest) of two tables of frames, values clamped to [0, 1]; the second is brought to the first's size by
    its nearest pixels.  Null pixels on either side give nulls."""
    other = b.select("video_id", "frame_no", F.col("data").alias("_data"), F.col("height").alias("_h"), F.col("width").alias("_w"))
    both = a.select("video_id", "frame_no", "height", "width", "data").join(other, ["video_id", "frame_no"])
    near = lambda p, n, m: F.floor((p + 0.5) * m / n).cast("int")  # noqa: E731  the pixel of m in which the centre of pixel p of n lies
    place = lambda p: near(F.floor(p / F.col("width")), F.col("height"), F.col("_h")) * F.col("_w") + near(p % F.col("width"), F.col("width"), F.col("_w"))
    same = (F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w"))
    scaled = F.when(same, F.col("_data")).otherwise(F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda p: F.get("_data", place(p))))
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    whole = (F.size("data") == F.col("height") * F.col("width")) & (F.size("_data") == F.col("_h") * F.col("_w"))
    d = F.when(whole, F.zip_with("data", scaled, lambda x, y: F.abs(clamp(x) - clamp(y))))
    return both.withColumn("_d", d).select("video_id", "frame_no", F.when(F.col("_d").isNotNull(), F.size("_d")).alias("pixels"), F.when(F.col("_d").isNotNull(), F.size(F.filter("_d", lambda x: x > threshold))).alias("different"), F.array_max("_d").alias("largest"))

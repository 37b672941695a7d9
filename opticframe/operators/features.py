"""Scale-space keypoints and gradient-histogram descriptors of frames, by the published method.

Lowe, "Distinctive Image Features from Scale-Invariant Keypoints" (2004), with the parameters of Rey Otero and
Delbracio, "Anatomy of the SIFT Method" (2014).  A frame is one row and is worked on alone: one pass, no shuffle.

Ours: beyond the edge the edge's pixel counts, pixels outside the frame have no part in a histogram, values are
divided by ``white``; number counts a frame's rows from 0; a frame without pixels, smaller than SMALLEST, or with null or non-finite pixels has no keypoints.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrays import images
from .grid import gaussian, grey_frames, resize, stencil

#: Least side of an octave's images.
SMALLEST = 12
#: Bins of the orientation histogram; rows and columns, and directions, of a descriptor's histograms.
TURNS, CELLS, DIRECTIONS = 36, 4, 8
KEYPOINT = "video_id string, frame_no long, number int, octave int, scale int, sub_scale double, y double, x double, sigma double, value double"
DESCRIPTOR = KEYPOINT + ", theta double, features array<int>"


@dataclass(frozen=True)
class Config:
    white: float = 255.0
    octaves: int = 8
    scales: int = 3
    step: float = 0.5  # of the first octave's pixels, in the frame's
    blur: float = 0.8  # of the first octave's first image, in the frame's pixels
    given_blur: float = 0.5
    contrast: float = 0.015
    edge: float = 10.0
    moves: int = 5
    turn_width: float = 1.5
    turn_share: float = 0.8
    width: float = 6.0


def _blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    w = gaussian(sigma, max(1, int(np.ceil(4 * sigma))))
    return stencil(stencil(image, w[None]), w[:, None])


def scale_space(image: np.ndarray, c: Config = Config()) -> list[np.ndarray]:
    """For each octave its blurred images (scales + 3, height, width), values from 0 to 1."""
    if min(image.shape) < SMALLEST or not np.isfinite(image).all():
        return []
    wide = resize(image / c.white, round(image.shape[0] / c.step), round(image.shape[1] / c.step))
    now, space = _blurred(wide, np.sqrt(c.blur**2 - c.given_blur**2) / c.step), []
    sigma = c.blur / c.step * 2 ** (np.arange(c.scales + 3) / c.scales)
    while len(space) < c.octaves and min(now.shape) >= SMALLEST:
        images = [now]
        for was, s in zip(sigma, sigma[1:]):
            images.append(_blurred(images[-1], np.sqrt(s**2 - was**2)))
        space.append(np.stack(images))
        now = images[c.scales][::2, ::2]
    return space


def _extrema(d: np.ndarray, least: float) -> np.ndarray:
    """(scale, y, x) that lie strictly above or strictly below all 26 neighbours."""
    core, top, low = d[1:-1, 1:-1, 1:-1], True, True
    for k in np.ndindex(3, 3, 3):
        if k != (1, 1, 1):
            other = d[tuple(slice(i, i + n) for i, n in zip(k, core.shape))]
            top, low = top & (core > other), low & (core < other)
    return np.argwhere((top | low) & (np.abs(core) >= least)) + 1


def _refined(d: np.ndarray, at: np.ndarray, c: Config) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Place, offset and value of the quadric's extremum near a place; None if it drifts off, is faint or lies on an edge."""
    at = at.copy()
    for _ in range(c.moves):
        v = d[tuple(slice(i - 1, i + 2) for i in at)]
        slope = np.array([v[2, 1, 1] - v[0, 1, 1], v[1, 2, 1] - v[1, 0, 1], v[1, 1, 2] - v[1, 1, 0]]) / 2
        bend = np.diag([v[2, 1, 1] + v[0, 1, 1], v[1, 2, 1] + v[1, 0, 1], v[1, 1, 2] + v[1, 1, 0]] - 2 * v[1, 1, 1])
        bend[0, 1] = bend[1, 0] = (v[2, 2, 1] - v[2, 0, 1] - v[0, 2, 1] + v[0, 0, 1]) / 4
        bend[0, 2] = bend[2, 0] = (v[2, 1, 2] - v[2, 1, 0] - v[0, 1, 2] + v[0, 1, 0]) / 4
        bend[1, 2] = bend[2, 1] = (v[1, 2, 2] - v[1, 2, 0] - v[1, 0, 2] + v[1, 0, 0]) / 4
        if abs(np.linalg.det(bend)) < 1e-18:
            return None
        off = -np.linalg.solve(bend, slope)
        if np.abs(off).max() < 0.6:
            value = float(v[1, 1, 1] + slope @ off / 2)
            trace, det = bend[1, 1] + bend[2, 2], bend[1, 1] * bend[2, 2] - bend[1, 2] ** 2
            good = abs(value) >= c.contrast and trace**2 * c.edge < det * (c.edge + 1) ** 2
            return (at, off, value) if good else None
        at = at + np.where(np.abs(off) > 0.6, np.sign(off), 0).astype(int)
        if (at < 1).any() or (at >= np.array(d.shape) - 1).any():
            return None
    return None


def _around(y: float, x: float, reach: float, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    ys, xs = (np.arange(max(0, int(np.ceil(p - reach))), min(n, int(p + reach) + 1)) for p, n in zip((y, x), shape))
    return tuple(a.ravel() for a in np.meshgrid(ys, xs, indexing="ij"))


def _turns(gy: np.ndarray, gx: np.ndarray, y: float, x: float, sigma: float, c: Config) -> list[float]:
    """Main directions of the gradients about a place, in [0, 2 pi)."""
    ys, xs = _around(y, x, 3 * c.turn_width * sigma, gy.shape)
    dy, dx = gy[ys, xs], gx[ys, xs]
    weight = np.hypot(dy, dx) * np.exp(-((ys - y) ** 2 + (xs - x) ** 2) / (2 * (c.turn_width * sigma) ** 2))
    h = np.bincount(np.rint(np.arctan2(dy, dx) * TURNS / (2 * np.pi)).astype(int) % TURNS, weight, TURNS)
    for _ in range(6):
        h = (np.roll(h, 1) + h + np.roll(h, -1)) / 3
    left, right = np.roll(h, 1), np.roll(h, -1)
    peaks = np.flatnonzero((h > left) & (h > right) & (h >= c.turn_share * h.max()))
    return [float((k + (left[k] - right[k]) / (2 * (left[k] - 2 * h[k] + right[k]))) * 2 * np.pi / TURNS % (2 * np.pi)) for k in peaks]


def _histograms(gy: np.ndarray, gx: np.ndarray, y: float, x: float, sigma: float, theta: float, c: Config) -> list[int]:
    """A descriptor: histograms of directions on a turned grid, normalised, clipped and quantised to 0..255."""
    reach = c.width * sigma * (CELLS + 1) / CELLS
    ys, xs = _around(y, x, np.sqrt(2) * reach, gy.shape)
    u = ((xs - x) * np.cos(theta) + (ys - y) * np.sin(theta)) / sigma
    v = ((ys - y) * np.cos(theta) - (xs - x) * np.sin(theta)) / sigma
    dy, dx = gy[ys, xs], gx[ys, xs]
    weight = np.hypot(dy, dx) * np.exp(-(u**2 + v**2) / (2 * c.width**2))
    centre = (np.arange(1, CELLS + 1) - (1 + CELLS) / 2) * 2 * c.width / CELLS
    cell = lambda p: np.maximum(0, 1 - np.abs(p[:, None] - centre) * CELLS / (2 * c.width))
    turn = (np.arctan2(dy, dx) - theta)[:, None] - 2 * np.pi * np.arange(DIRECTIONS) / DIRECTIONS
    turn = np.abs((turn + np.pi) % (2 * np.pi) - np.pi)
    f = np.einsum("p,pi,pj,pk->ijk", weight, cell(v), cell(u), np.maximum(0, 1 - turn * DIRECTIONS / (2 * np.pi)), optimize=True).ravel()
    f = np.minimum(f, 0.2 * np.sqrt((f**2).sum()))
    return np.minimum(255, np.floor(512 * f / max(np.sqrt((f**2).sum()), 1e-300))).astype(int).tolist()


def keypoints_of(image: np.ndarray, c: Config = Config(), describe: bool = False) -> list[dict]:
    """Keypoints of an image in its own pixel places; with describe one row for each main direction, with its descriptor."""
    out = []
    for octave, images in enumerate(scale_space(image, c)):
        d, grown, slopes = np.diff(images, axis=0), 2**octave, {}
        for start in _extrema(d, 0.8 * c.contrast):
            if (got := _refined(d, start, c)) is None:
                continue
            at, off, value = got
            scale, y, x = at + off
            sigma = c.blur / c.step * 2 ** (scale / c.scales)
            row = {"octave": octave, "scale": int(at[0]), "sub_scale": float(off[0]), "sigma": float(sigma * c.step * grown), "value": value}
            row["y"], row["x"] = (float((p * grown + 0.5) * c.step - 0.5) for p in (y, x))
            if not describe:
                out.append(row)
                continue
            if at[0] not in slopes:
                slopes[at[0]] = np.gradient(images[at[0]])
            gy, gx = slopes[at[0]]
            for theta in _turns(gy, gx, y, x, sigma, c):
                out.append({**row, "theta": theta, "features": _histograms(gy, gx, y, x, sigma, theta, c)})
    return out


def _rows(frames: DataFrame, schema: str, of) -> DataFrame:
    ship(frames.sparkSession)

    def mapped(batches):
        for batch in batches:
            for video, frame, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), images(batch)):
                rows = of(image) if image is not None else []
                if rows:
                    yield pa.RecordBatch.from_pylist([{"video_id": video, "frame_no": frame, "number": i, **x} for i, x in enumerate(rows)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return frames.select(F.col("video_id").cast("string"), F.col("frame_no").cast("long"), "height", "width", F.col("data").cast("array<double>")).mapInArrow(mapped, schema)


def keypoints(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """Keypoints of every frame."""
    return _rows(frames, KEYPOINT, lambda image: keypoints_of(image, config))


def descriptors(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """Keypoints of every frame with theta and 128 features, a row for each main direction."""
    return _rows(frames, DESCRIPTOR, lambda image: keypoints_of(image, config, describe=True))


def differences(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """Difference-of-Gaussians scale space: an image for each octave and scale."""

    def of(image: np.ndarray) -> list[dict]:
        return [{"octave": o, "scale": s, "height": d.shape[0], "width": d.shape[1], "data": d.ravel().tolist()} for o, images in enumerate(scale_space(image, config)) for s, d in enumerate(np.diff(images, axis=0))]

    return _rows(frames, "video_id string, frame_no long, number int, octave int, scale int, height int, width int, data array<double>", of)


def image_descriptors(images: DataFrame, height: int | None = None, width: int | None = None, config: Config = Config()) -> DataFrame:
    """Descriptors of decoded images (see readers.read_images; video_id is the path), brought to a size before if one is given; an image without any has no row."""
    return descriptors(grey_frames(images, height, width), config)

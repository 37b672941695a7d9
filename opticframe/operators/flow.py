"""Dense optical flow: pairs of frames, a windowed least-squares solve, smoothing in time, pooling and heading.

Defined results: a frame without pixels (see grid), or that follows one without or one of another size, has null flow; a
null in a series, or an array that holds one or has another length than before, is passed over: its row gets null, the
running value stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import grid
from .arrays import images, lists, parts

#: Weight of what was there before, in smoothing; pixels at the edge without flow; half the solve's window.
OLD, BORDER, HALF = 0.9, 3, 3
FLOW = "video_id string, frame_no long, height int, width int, u array<double>, v array<double>"


def pairs(frames: DataFrame) -> DataFrame:
    """Each frame with its previous one's pixels and size (before, before_height, before_width); a video's first frame has no pair.

    Only numbers of frames go through the window; frames then meet by a join, so a long video is many tasks.  Rows that
    repeat a frame's number are paired one by one.
    """
    back = Window.partitionBy("video_id").orderBy("frame_no")
    numbers = frames.select("video_id", "frame_no").distinct().withColumn("_before", F.lag("frame_no").over(back)).where(F.col("_before").isNotNull())
    old = frames.select(F.col("video_id").alias("_video"), F.col("frame_no").alias("_no"), F.col("data").alias("before"), F.col("height").alias("before_height"), F.col("width").alias("before_width"))
    now = frames.join(numbers, ["video_id", "frame_no"])
    return now.join(old, (F.col("video_id") == F.col("_video")) & (F.col("_before") == F.col("_no"))).drop("_before", "_video", "_no")


def solve(a: np.ndarray, b: np.ndarray, sigma: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Flow from image a to b: gradients of a, b - a in time, weights squared in a 7 x 7 window; 0 at the border and where the system is singular."""
    ix, iy, it = grid.stencil(a, grid.SOBEL_X), grid.stencil(a, grid.SOBEL_Y), b - a
    at = np.arange(-HALF, HALF + 1)
    w = np.exp(-(at[:, None] ** 2 + at**2) / (2 * sigma**2)) ** 2
    xx, xy, yy, xt, yt = (grid.stencil(p, w) for p in (ix * ix, ix * iy, iy * iy, ix * it, iy * it))
    det = xx * yy - xy * xy
    over = np.divide(-1.0, det, out=np.zeros_like(det), where=det != 0)
    u, v = (yy * xt - xy * yt) * over, (xx * yt - xy * xt) * over
    inside = np.zeros(a.shape, bool)
    inside[BORDER + 1 : a.shape[0] - BORDER - 1, BORDER + 1 : a.shape[1] - BORDER - 1] = True
    return np.where(inside, u, 0), np.where(inside, v, 0)


def _image(a: np.ndarray | None, height: int | None, width: int | None) -> np.ndarray | None:
    return a.reshape(height, width) if a is not None and height and width and a.size == height * width else None


def flow(frames: DataFrame, sigma: float = 3.0) -> DataFrame:
    """(video_id, frame_no, height, width, u, v) of each frame that has one before it."""
    ship(frames.sparkSession)

    def solved(batches):
        for batch in batches:
            old = [_image(a, h, w) for a, h, w in zip(parts(batch.column(5)), batch.column(6).to_pylist(), batch.column(7).to_pylist())]
            got = [solve(a, b, sigma) if a is not None and b is not None and a.shape == b.shape else (None, None) for a, b in zip(old, images(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(lists([g[k] for g in got]) for k in (0, 1))], names=["video_id", "frame_no", "height", "width", "u", "v"])

    doubles = [F.col(c).cast("array<double>") for c in ("data", "before")]
    given = [F.col("video_id").cast("string"), F.col("frame_no").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), *doubles, "before_height", "before_width"]
    return pairs(frames).select(*given).mapInArrow(solved, FLOW)


def perform(frames: DataFrame, height: int, width: int, blur: float = 5.0, sigma: float = 3.0) -> DataFrame:
    """Flow of frames that are blurred and brought to a size before."""
    return flow(grid.preprocess(frames, height, width, blur), sigma)


def smooth(df: DataFrame, key: str, order: list[str], values: list[str], old: float = OLD) -> DataFrame:
    """Running old * before + (1 - old) * now of columns (numbers or arrays) in each key, from 0.

    Keys are dealt by a hash and sorted in their part; the fold walks on with one state, so a long key costs no memory.
    """
    ship(df.sparkSession)
    names, kinds = df.columns, [df.schema[v].dataType.typeName() == "array" for v in values]
    doubles = {v: F.col(v).cast("array<double>" if k else "double").alias(v) for v, k in zip(values, kinds)}

    def folded(batches):
        last, state, new = object(), {}, 1 - old
        for batch in batches:
            keys = batch.column(names.index(key)).to_pylist()
            begins = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]
            columns = list(batch.columns)
            for v, array in zip(values, kinds):
                column = columns[names.index(v)]
                series, run, starts, out = parts(column) if array else column.to_pylist(), state.get(v), set(begins), []
                for i, now in enumerate(series):
                    if i in starts:
                        run = None
                    if now is None or (array and run is not None and now.size != run.size):
                        out.append(None)
                        continue
                    run = old * (0.0 if run is None else run) + new * now
                    out.append(run)
                state[v] = run
                columns[names.index(v)] = lists(out) if array else pa.array(out, pa.float64())
            last = keys[-1] if keys else last
            yield pa.RecordBatch.from_arrays(columns, names=names)

    given = df.select(*[doubles.get(c, F.col(c)) for c in names])
    return given.repartition(key).sortWithinPartitions(key, *order).mapInArrow(folded, given.schema)


def vectors(flows: DataFrame) -> DataFrame:
    """(video_id, frame_no, y, x, u, v)."""
    z = flows.select("video_id", "frame_no", "width", F.posexplode(F.arrays_zip("u", "v")).alias("p", "s"))
    return z.select("video_id", "frame_no", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), "s.u", "s.v")


def centres(side: int, cells: int, half: int) -> np.ndarray:
    """Places half + i / cells * (side - 1 - 2 half): every window of 2 half + 1 pixels around one lies in the frame.
    Pixels about a place between two are rounded away from 0, as the window's pixels are."""
    return half + np.arange(cells) / cells * (side - 1 - 2 * half)


def pool(flows: DataFrame, cells: int = 5, half: int = 5, least: float = 1e-4) -> DataFrame:
    """(video_id, frame_no, i, j, u, v): mean flow in whole windows of 2 half + 1 pixels around a grid of centres (row i, column j); means no longer than
    `least` are dropped.  Flow that is null, or of frames that hold no such window, has no rows."""
    ship(flows.sparkSession)
    at = np.arange(-half, half + 1)

    def pooled(batches):
        for batch in batches:
            out = []
            for video, frame, u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), images(batch, "u"), images(batch, "v")):
                if u is None or v is None or min(u.shape) < 2 * half + 1:
                    continue
                ys, xs = (np.floor(centres(n, cells, half)[:, None] + at + 0.5).astype(int) for n in u.shape)
                for i, j in np.ndindex(cells, cells):
                    window = np.ix_(ys[i], xs[j])
                    a, b = float(u[window].mean()), float(v[window].mean())
                    if np.hypot(a, b) > least:
                        out.append({"video_id": video, "frame_no": frame, "i": i, "j": j, "u": a, "v": b})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("video_id", pa.string()), ("frame_no", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("u", pa.float64()), ("v", pa.float64())]))

    return flows.select("video_id", "frame_no", "height", "width", "u", "v").mapInArrow(pooled, "video_id string, frame_no long, i int, j int, u double, v double")


def heading(pooled: DataFrame, factor: float = 100.0) -> DataFrame:
    """(video_id, frame_no, u, v): mean of a frame's cells, scaled; frames without cells have no row."""
    return pooled.groupBy("video_id", "frame_no").agg((F.avg("u") * factor).alias("u"), (F.avg("v") * factor).alias("v"))

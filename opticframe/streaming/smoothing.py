"""Smoothing in time, and the loop over frames, as streams: one state row for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.flow import OLD, solve
from ..shipping import ship


def smooth_stream(frames: DataFrame, key: str, order: str, value: str, old: float = OLD) -> DataFrame:
    """Running old * before + (1 - old) * now of an array column in each key, from 0.

    Rows of a trigger are taken in order; a row that is not later than one already taken is left out,
    as its place in the running value is gone.  A null array, or one that holds a null, is passed over: it gives no row.
    """
    ship(frames.sparkSession)
    field = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = f"{key} {field[key]}, {order} {field[order]}, {value} array<double>"

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, running = state.get if state.exists else (None, None)
        running = None if running is None else np.array(running, float)
        out = []
        for at, now in pd.concat(list(parts))[[order, value]].sort_values(order).itertuples(index=False):
            if (last is not None and at <= last) or now is None or np.isnan(now := np.asarray(now, float)).any():
                continue
            running = old * (0.0 if running is None else running) + (1 - old) * now
            last = at
            out.append((group[0], at, running.tolist()))
        if last is not None:
            state.update((last, running.tolist()))
        yield pd.DataFrame(out, columns=[key, order, value])

    return frames.select(key, order, value).groupBy(key).applyInPandasWithState(fold, schema, f"last {field[order]}, running array<double>", "append", GroupStateTimeout.NoTimeout)


def flow_stream(frames: DataFrame, sigma: float = 3.0, old: float = OLD) -> DataFrame:
    """(video_id, frame_no, height, width, u, v): the smoothed flow of a stream of frames, each against the one before it.

    A video's state is its last frame and its running flow.  Frames of a trigger are taken in order; one that is not later
    than one already taken, or has no whole pixels, is left out; one of another size begins the video anew.
    """
    ship(frames.sparkSession)
    state_type = "last long, height int, width int, data array<double>, u array<double>, v array<double>"

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, shape, image, flow, out = None, None, None, None, []
        if state.exists:
            last, h, w, data, u, v = state.get
            shape, image = (h, w), np.array(data, float).reshape(h, w)
            flow = (np.array(u, float), np.array(v, float)) if len(u) else None
        rows = pd.concat(list(parts))[["frame_no", "height", "width", "data"]].sort_values("frame_no")
        for no, h, w, data in rows.itertuples(index=False):
            if (last is not None and no <= last) or data is None or len(data) != h * w or not len(data) or np.isnan(now := np.asarray(data, float)).any():
                continue
            now = now.reshape(int(h), int(w))
            if shape == now.shape:
                new = solve(image, now, sigma)
                flow = tuple(old * f + (1 - old) * x.ravel() for f, x in zip(flow or (0.0, 0.0), new))
                out.append((group[0], no, *now.shape, flow[0].tolist(), flow[1].tolist()))
            else:
                flow = None
            last, shape, image = int(no), now.shape, now
        if last is not None:
            u, v = ([], []) if flow is None else (flow[0].tolist(), flow[1].tolist())
            state.update((last, *shape, image.ravel().tolist(), u, v))
        yield pd.DataFrame(out, columns=["video_id", "frame_no", "height", "width", "u", "v"])

    out = "video_id string, frame_no long, height int, width int, u array<double>, v array<double>"
    return frames.select("video_id", "frame_no", "height", "width", "data").groupBy("video_id").applyInPandasWithState(fold, out, state_type, "append", GroupStateTimeout.NoTimeout)

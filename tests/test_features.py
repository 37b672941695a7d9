import numpy as np

from opticframe.operators import features
from opticframe.operators.grid import FRAME
from opticframe.plans import catalogue


def blobs(spots, height=64, width=72):
    y, x = np.mgrid[:height, :width]
    return np.clip(sum(a * np.exp(-((y - cy) ** 2 + (x - cx) ** 2 * f) / (2 * s * s)) for cy, cx, s, a, f in spots), 0, 255)


def test_a_blob_is_one_keypoint_at_its_place_and_size():
    for sigma in (3.0, 4.0, 6.0):
        (k,) = features.keypoints_of(blobs([(30, 40, sigma, 200, 1)]))
        assert abs(k["y"] - 30) < 0.2 and abs(k["x"] - 40) < 0.2 and k["value"] < 0
        assert abs(k["sigma"] / (sigma / 2 ** (1 / 6)) - 1) < 0.1  # between the blurs of the difference that matches it


def test_descriptors_survive_a_quarter_turn():
    rng = np.random.default_rng(1)
    image = blobs([(*rng.uniform(8, 56, 2), rng.uniform(1.5, 4), rng.uniform(60, 160), rng.uniform(0.4, 1)) for _ in range(25)], 64, 64)
    a, b = features.keypoints_of(image, describe=True), features.keypoints_of(np.rot90(image), describe=True)
    assert len(a) > 15 and all(len(k["features"]) == 128 and 0 <= min(k["features"]) and max(k["features"]) <= 255 for k in a)
    d = ((np.array([k["features"] for k in a])[:, None] - np.array([k["features"] for k in b])) ** 2).sum(2)
    turned = [b[j] for j in d.argmin(1)]
    right = [abs(63 - p["x"] - q["y"]) < 0.5 and abs(p["y"] - q["x"]) < 0.5 and abs((q["theta"] - p["theta"] + np.pi / 2 + np.pi) % (2 * np.pi) - np.pi) < 0.2 for p, q in zip(a, turned)]
    assert np.mean(right) > 0.85


def test_frames_without_features(spark):
    flat, small = [5.0] * 1600, [1.0] * 16
    rows = [("v", 0, 40, 40, flat), ("v", 1, 4, 4, small), ("v", 2, 0, 0, []), ("v", 3, None, None, None), ("v", 4, 40, 40, [None, *flat[1:]]), ("v", 5, 40, 40, [float("nan"), *flat[1:]])]
    frames = spark.createDataFrame(rows, FRAME)
    assert features.keypoints(frames).count() == 0 and features.descriptors(frames).count() == 0
    assert features.descriptors(frames.where("false")).count() == 0


def test_operators_equal_the_plain_function(spark):
    scenes = catalogue.scenes(spark)
    images = {r["frame_no"]: np.array(r["data"]).reshape(r["height"], r["width"]) for r in scenes.collect()}
    got = features.descriptors(scenes).orderBy("frame_no", "number").collect()
    want = [(n, i, k) for n in sorted(images) for i, k in enumerate(features.keypoints_of(images[n], describe=True))]
    assert want and [(r["frame_no"], r["number"], r["octave"], r["scale"]) for r in got] == [(n, i, k["octave"], k["scale"]) for n, i, k in want]
    for r, (_, _, k) in zip(got, want):  # workers may add in another order
        assert np.allclose([r["y"], r["x"], r["sigma"], r["theta"], r["value"]], [k["y"], k["x"], k["sigma"], k["theta"], k["value"]], atol=1e-6) and np.abs(np.subtract(r["features"], k["features"])).max() <= 1
    space = features.differences(scenes.where("frame_no = 0")).collect()
    assert all(np.allclose(np.diff(features.scale_space(images[0])[r["octave"]], axis=0)[r["scale"]].ravel(), r["data"]) for r in space) and space


def test_ranking_of_frames(spark):
    ranked = catalogue.QUERIES["frame_rank_records"](spark, "").collect()
    assert ranked and all(r["source"] < 3 <= r["target"] and 0 < r["score"] <= 1 for r in ranked)

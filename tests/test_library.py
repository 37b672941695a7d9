import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opticframe.functions import reshape, vec
from opticframe.operators import cluster, flow, grid, match, nn
from opticframe.plans import catalogue
from opticframe.sources import readers

DATA = "/root/testdata/sf0.001"
TINY = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    if not Path(DATA).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), con.sql(catalogue.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (got, want))
    assert got.equals(want)


def test_covariance_of_all_components(spark):
    if not Path(DATA).exists():
        pytest.skip("no test data")
    rows = cluster.assign(catalogue.embeddings(spark, DATA), catalogue.first_centroids(spark, DATA)).collect()
    got = {(r["cid"], r["i"], r["j"]): r["value"] for r in catalogue.QUERIES["cluster_covariance"](spark, DATA).collect()}
    cids = {r["cid"] for r in rows}
    assert len(got) == len(cids) * 64 * 65 // 2
    for c in cids:
        want = np.cov(np.array([r["embedding"] for r in rows if r["cid"] == c], float).T, bias=True)
        assert all(abs(got[c, i, j] - want[i, j]) < 1e-8 for i in range(64) for j in range(i, 64))


POINTS = [(0, [1.0, 1.0]), (1, [10.0, 10.0]), (2, [20.0, 20.0]), (3, [30.0, 30.0])]


@pytest.mark.parametrize(("query", "nearest", "distance"), [((4.0, 5.0), 0, 5.0), ((-2.0, -3.0), 0, 5.0), ((60.0, 70.0), 3, 50.0)])
def test_known_neighbours(spark, query, nearest, distance):
    q = spark.createDataFrame([(9, list(query))], TINY)
    row = nn.search(q, spark.createDataFrame(POINTS, TINY)).first()
    assert (row["id"], row["distance"]) == (nearest, distance)


def test_lookup_hits_and_misses(spark):
    points = spark.createDataFrame([(0, [30.0, 40.0]), (1, [5.0, 25.0]), (4, [50.0, 30.0])], TINY)
    asked = spark.createDataFrame([(7, [50.0, 30.0]), (8, [4.0, 5.0])], TINY)
    assert [tuple(r) for r in nn.point_lookup(asked, points).collect()] == [(7, 4)]


def test_empty_points_find_nothing(spark):
    q = spark.createDataFrame(POINTS, TINY)
    assert nn.search(q, q.where("false")).count() == 0


def test_ratio_match_at_06(spark):
    source = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0])], TINY)
    target = spark.createDataFrame([(10, [0.1, 0.0]), (11, [9.0, 0.0]), (12, [11.1, 0.0])], TINY)
    assert [(r["query_id"], r["id"]) for r in match.ratio_match(source, target, relative=0.6).collect()] == [(0, 10)]
    assert match.ratio_match(source.where("vec_id = 0"), target.where("vec_id = 10")).count() == 1  # a lone candidate


def test_records_are_newest_first(spark):
    scores = spark.createDataFrame([("s", i, x) for i, x in enumerate([0.2, 0.5, 0.4, 0.7, 0.9])] + [("t", i, x) for i, x in enumerate([0.9, 0.8, 0.7])] + [("u", 0, 0.0)], "source string, target int, score double")
    got = match.records(scores).orderBy("source", "rank").collect()
    assert [(r["source"], r["score"]) for r in got] == [("s", 0.9), ("s", 0.7), ("s", 0.5), ("t", 0.9)]


def test_vector_algebra(spark):
    a, b = F.array(*map(F.lit, (3.0, 4.0))), F.array(*map(F.lit, (0.0, 0.0)))
    row = spark.range(1).select(vec.norm(a).alias("n"), vec.cosine(a, b).alias("c"), vec.normalized(b).alias("z"), vec.mahalanobis(a, b, vec.identity(2)).alias("m"), vec.add(a, a).alias("p"), F.array(*vec.inverse2(*map(F.lit, (2.0, 0.0, 0.0, 4.0)))).alias("i"), F.array(*vec.inverse2(*map(F.lit, (1.0, 2.0, 2.0, 4.0)))).alias("s")).first()
    assert (row["n"], row["c"], row["z"], row["m"], row["p"]) == (5.0, None, None, 5.0, [6.0, 8.0])
    assert row["i"] == [0.5, 0.0, 0.0, 0.25] and row["s"] == [None] * 4


def test_sample_of_many(spark):
    got = reshape.systematic_sample(spark.range(1000).repartition(7), "id", 10, 5)
    assert sorted(r["id"] for r in got.collect()) == [0, 10, 20, 30, 40]


def test_empty_cluster_keeps_its_centroid(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0])], TINY)
    first = [[1.0, 0.0], [99.0, 99.0]]
    assert cluster.step(df, first) == ([[1.0, 0.0], [99.0, 99.0]], [2, 0])
    assert cluster.assign(df, [[1.0, 0.0], [1.0, 0.0]]).select("cid").distinct().collect()[0][0] == 0  # ties


def test_text_readers(spark, tmp_path):
    good = "1.5 2.5 3.5 4.5 " + " ".join(map(str, range(128)))
    (tmp_path / "d.txt").write_text(good + " extra\n\n" + "1 2 x 4\n")
    rows, rejects = readers.read_descriptors(spark, str(tmp_path / "d.txt"))
    row = rows.first()
    assert rows.count() == 1 and row["y"] == 1.5 and row["theta"] == 4.5 and row["features"] == list(range(128)) and rejects.count() == 1
    assert readers.read_keypoints(spark, str(tmp_path / "d.txt"))[0].count() == 1


def test_recall_of_all_and_of_half(spark):
    points = spark.createDataFrame([(i, [float(i * i), 0.0]) for i in range(10)], TINY)
    truth = nn.search(points, points)
    row = nn.recall(truth.where("query_id < 5"), truth).first()
    assert (row["total"], row["correct"], row["ratio"], row["mse"]) == (10, 5, 0.5, 0.0)
    assert nn.recall(nn.lsh(points, length=50.0, threshold=1000.0), truth).first()["ratio"] == 1.0


def test_lsh_equals_its_definition(spark, monkeypatch):
    rng = np.random.default_rng(31)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 5)))] + [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (40, 2)), 300)]
    rows += [(400, [0.0] * 5), (401, None), (402, [1.0, None, 1.0, 1.0, 1.0]), (403, [float("nan")] * 5), (None, [0.1] * 5), (3, rows[3][1]), (404, rows[4][1])]
    points = spark.createDataFrame(rows, TINY)
    there = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    monkeypatch.setattr(nn, "BLOCK_BYTES", 4000)  # several blocks
    for length, tables, threshold in ((0.5, 2, 1.5), (0.01, 1, 3.0), (50.0, 3, 2.0)):
        number = [nn.buckets(v[None], length, tables, 1)[0] for _, v in there]
        want = {}
        for (a, x), m in zip(there, number):
            for (b, y), n in zip(there, number):
                if a != b and len(x) == len(y) and (m == n).any() and (d := float(np.sqrt(((x - y) ** 2).sum()))) < threshold:
                    want[a, b] = min(d, want.get((a, b), d))
        got = nn.lsh(points, length=length, tables=tables, threshold=threshold).collect()
        assert len(got) == len(want) and {(r["query_id"], r["id"]): r["distance"] for r in got} == pytest.approx(want)
        few = nn.lsh(points, length=length, tables=tables, threshold=threshold, queries=points.where("vec_id % 20 = 0"), k=1).collect()
        best = {a: min((d, b) for (q, b), d in want.items() if q == a) for a, _ in want if a % 20 == 0}
        assert {r["query_id"]: r["id"] for r in few} == {a: b for a, (_, b) in best.items()} and len(few) == len(best)
    assert nn.lsh(points.where("false")).count() == 0


def test_nn_recall_of_the_queries(spark, tmp_path):
    """2000 vectors a unit long: 100 queries against all rows."""
    v = np.random.default_rng(32).normal(0, 1, (2000, 64))
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v / np.linalg.norm(v, axis=1)[:, None])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    row = catalogue.nn_recall(spark, str(tmp_path)).first()
    assert row["total"] == 100 and row["ratio"] >= 0.9 and row["correct"] == round(100 * row["ratio"]) and row["mse"] < 1e-3


def test_match_lists_and_guard(spark):
    from opticframe.sources import sinks

    ranked = spark.createDataFrame([(1, 9, 0.5, 2), (1, 8, 0.7, 1)], "source long, target long, score double, rank int")
    got = {r["source"]: [tuple(m) for m in r["matches"]] for r in sinks.nested_matches(spark.createDataFrame([(1,), (2,)], "source long"), ranked).collect()}
    assert got == {1: [(8, 0.7), (9, 0.5)], 2: []}
    with pytest.raises(ValueError):
        sinks.require_rows(ranked.where("false"), "references")


def test_resize_and_stencil():
    a = np.arange(12.0).reshape(3, 4)
    assert np.allclose(grid.resize(a, 3, 4), a) and np.allclose(grid.resize(np.full((8, 8), 5.0), 3, 2, 3), 5.0)
    assert np.allclose(grid.stencil(a, grid.SOBEL_X)[1, 1], -8.0) and np.allclose(grid.blur(np.full((9, 9), 2.0)), 2.0)


def test_flow_of_flat_frames_is_zero():
    u, v = flow.solve(np.full((12, 12), 3.0), np.full((12, 12), 4.0))
    assert not u.any() and not v.any()


def test_stream_equals_batch(spark, tmp_path):
    from opticframe.streaming.smoothing import smooth_stream

    rows = [("a", 0, [1.0, 2.0]), ("b", 0, [5.0, 5.0]), ("a", 1, [3.0, 4.0]), ("a", 2, [0.0, 8.0])]
    schema = "video_id string, frame_no long, u array<double>"
    src = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[1] == i], schema).coalesce(1).write.mode("append").parquet(str(src))
    out = smooth_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), "video_id", "frame_no", "u")
    q = out.writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["video_id"], r["frame_no"]): r["u"] for r in spark.table("smoothed").collect()}
    batch = {(r["video_id"], r["frame_no"]): r["u"] for r in flow.smooth(spark.createDataFrame(rows, schema), "video_id", ["frame_no"], ["u"]).collect()}
    assert got.keys() == batch.keys() and all(math.isclose(x, y) for k in got for x, y in zip(got[k], batch[k]))


def test_neighbours_with_bad_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), float(i % 3)]) for i in range(5)]
    bad = [(50, [nan, 1.0]), (51, [None, 1.0]), (52, [inf, 1.0]), (53, []), (54, None), (None, [1.0, 1.0]), (55, [1e200, 1.0]), (56, [1.0, 2.0, 3.0])]
    q = spark.createDataFrame(good, TINY)
    want = [tuple(r) for r in nn.search(q, q, k=2).select("query_id", "rank", "id", "distance").orderBy("query_id", "rank").collect()]
    assert len(want) == 10
    full = spark.createDataFrame(good + bad + [good[0]] * 4 + [(3, [3.0, 9.0])], TINY)
    got = nn.search(full, full, k=2).where("query_id < 50").select("query_id", "rank", "id", "distance").orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == want
    assert nn.search(full, full, k=None, radius=100.0).where("query_id >= 50 or id >= 50").count() == 0
    assert [r["id"] for r in nn.search(spark.createDataFrame([(9, [1.0, 2.0, 4.0])], TINY), full).collect()] == [56]  # of its own length
    far = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1e8, 0.0]), (2, [1e8 + 1, 0.0]), (3, [1e150, 0.0])], TINY)  # a large one does not blur the others
    assert {r["query_id"]: r["id"] for r in nn.search(far, far).collect()} == {0: 1, 1: 2, 2: 1, 3: 0}  # of three at one distance the least id


@pytest.mark.parametrize(("query", "point", "distance"), [((4.0, 5.0), 0, 5.0), ((-2.0, -3.0), 0, 5.0), ((60.0, 70.0), 3, 50.0)])
def test_known_neighbours_beside_a_bad_point(spark, query, point, distance):
    q = spark.createDataFrame([(9, list(query))], TINY)
    row = nn.search(q, spark.createDataFrame([*POINTS, (4, [float("nan"), 0.0])], TINY)).first()
    assert (row["id"], row["distance"]) == (point, distance)


def test_neighbours_in_many_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(nn, "STRIP", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    x[50:80] = x[50]
    rows = [(i, v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, TINY + ", g int")
    got = {}
    for r in nn.search(df, df, k=3, group="g").collect():
        got.setdefault((r["query_id"], r["group"]), []).append((r["rank"], r["id"], r["distance"]))
    for i in range(200):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        for g in (0, 1, 2, None):
            want = sorted((d[j], j) for j in range(200) if j != i and rows[j][2] == g)[:3]
            assert [(n, j) for n, j, _ in sorted(got[i, g])] == [(k + 1, j) for k, (_, j) in enumerate(want)]


def test_clusters_leave_bad_vectors_out(spark):
    rows = [(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [1.0]), (6, [9.0, 9.0])]
    df, first = spark.createDataFrame(rows, TINY), [[0.0, 0.0], [9.0, 9.0]]
    got = {r["vec_id"]: r["cid"] for r in cluster.assign(df, first).collect()}
    assert got == {0: 0, 1: 0, 2: None, 3: None, 4: None, 5: None, 6: 1}
    assert cluster.step(df, first) == ([[1.0, 0.0], [9.0, 9.0]], [2, 1]) and cluster.step(df.where("false"), first) == (first, [0, 0])
    assert [r["bow"] for r in cluster.bags(df, first, F.lit(1)).collect()] == [pytest.approx([2 / 5**0.5, 1 / 5**0.5])]
    assert {r["vec_id"]: r["cids"] for r in cluster.within(df, first, 5.0).collect()}[2] == []
    assert cluster.covariance(cluster.assign(df, first)).where("cid = 0 and i = 0 and j = 0").first()["value"] == 1.0
    with pytest.raises(ValueError):
        cluster.step(df, [[1.0], [1.0, 2.0]])


def test_steps_equal_the_assignment(spark, monkeypatch):
    monkeypatch.setattr(cluster, "STRIP", 16)
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(300, 5)), cluster.random_centroids(6, 5, 4)
    assert c == cluster.random_centroids(6, 5, 4) and np.allclose((np.array(c) ** 2).sum(1), 1) and c != cluster.random_centroids(6, 5, 5)
    c[5] = c[4]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], TINY).repartition(5)
    means, sizes = cluster.step(df, c)
    cid = np.array([r["cid"] for r in cluster.assign(df, c).orderBy("vec_id").collect()])
    assert sizes == np.bincount(cid, minlength=6).tolist() and sizes[5] == 0 and means[5] == c[5]
    assert all(np.allclose(means[k], x[cid == k].mean(0)) for k in range(5))
    now, last = c, []
    for _ in range(4):
        near = ((x[:, None] - np.array(now)) ** 2).sum(2).argmin(1)
        last, now = np.bincount(near, minlength=6).tolist(), [x[near == k].mean(0).tolist() if (near == k).any() else now[k] for k in range(6)]
    got, kept = cluster.train(df, c, iterations=4, error=0.0, least=20)
    assert kept == [n for n in last if n > 20] and np.allclose(got, [m for m, n in zip(now, last) if n > 20])


def test_inverse_covariance_and_its_distance(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(80, 3)) @ np.diag([1.0, 4.0, 0.5]) + 1e6, rng.normal(size=(50, 3)), [[1.0, 2.0, 3.0]] * 2]
    cid = np.r_[np.zeros(80, int), np.ones(50, int), np.full(2, 2)]
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, cid))], TINY + ", cid int").repartition(7)
    got = {r["cid"]: r["inverse"] for r in cluster.inverse_covariance(df).collect()}
    assert got[2] is None and all(np.allclose(got[k], np.linalg.inv(np.cov(x[cid == k].T, bias=True)), rtol=1e-5) for k in (0, 1))
    centroids, inverses = [x[cid == k].mean(0).tolist() for k in (0, 1)], [got[0], got[1]]
    for r in cluster.assign_mahalanobis(df.drop("cid").where("vec_id < 130"), centroids, inverses).collect():
        d = [np.sqrt((x[r["vec_id"]] - c) @ np.array(m) @ (x[r["vec_id"]] - c)) for c, m in zip(centroids, inverses)]
        assert r["cid"] == int(np.argmin(d)) and math.isclose(r["distance"], min(d), rel_tol=1e-6)


FRAMES = "video_id string, frame_no long, height int, width int, data array<double>"


def test_pool_takes_whole_windows_about_rounded_centres(spark):
    # 24 wide: 5 + j / 5 * 13 = 5, 7.6, 10.2, 12.8, 15.4; 20 high: 5 + i / 5 * 9 = 5, 6.8, 8.6, 10.4, 12.2
    u = np.arange(20.0)[:, None] + 100 * np.arange(24.0)
    flows = spark.createDataFrame([("v", 1, 20, 24, u.ravel().tolist(), (-u).ravel().tolist()), ("v", 2, 20, 24, None, None), ("v", 3, 10, 24, [1.0] * 240, [1.0] * 240), ("v", 4, 20, 24, [0.00005] * 480, [0.0] * 480)], "video_id string, frame_no long, height int, width int, u array<double>, v array<double>")
    got = {(r["frame_no"], r["i"], r["j"]): (r["u"], r["v"]) for r in flow.pool(flows).collect()}
    want = {(1, i, j): (y + 100 * x, -(y + 100 * x)) for i, y in enumerate((5.0, 7.0, 9.0, 10.0, 12.0)) for j, x in enumerate((5.0, 8.0, 10.0, 13.0, 15.0))}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    head = flow.heading(flow.pool(flows)).collect()
    assert len(head) == 1 and math.isclose(head[0]["u"], 100 * (8.6 + 1020)) and math.isclose(head[0]["v"], -100 * (8.6 + 1020))


def test_frames_without_pixels(spark):
    rows = [("a", 0, 16, 16, [float(i % 7) for i in range(256)]), ("a", 1, 16, 16, None), ("a", 2, 16, 16, [None] + [1.0] * 255), ("a", 3, 16, 16, [float(i % 5) for i in range(256)]), ("a", 4, 4, 4, [1.0] * 16), ("a", 5, 16, 16, [1.0] * 9), ("a", 7, None, 16, [1.0] * 9)]
    df = spark.createDataFrame(rows, FRAMES)
    got = {r["frame_no"]: (r["height"], r["data"]) for r in grid.per_frame(df, lambda a: a[:2, :2] + 1).collect()}
    assert got == {0: (2, [1.0, 2.0, 3.0, 4.0]), 1: (16, None), 2: (16, None), 3: (2, [1.0, 2.0, 2.0, 3.0]), 4: (2, [2.0] * 4), 5: (16, None), 7: (None, None)}
    flows = {r["frame_no"]: r["u"] for r in flow.flow(df).collect()}
    assert flows.keys() == {1, 2, 3, 4, 5, 7} and all(v is None for v in flows.values())
    series = spark.createDataFrame([("k", 0, 1.0, [1.0, 2.0]), ("k", 1, None, None), ("k", 2, 2.0, [None, 1.0]), ("k", 3, 3.0, [3.0]), ("k", 4, 4.0, [5.0, 6.0])], "k string, t int, x double, a array<double>")
    out = flow.smooth(series, "k", ["t"], ["x", "a"], old=0.5).orderBy("t").collect()
    assert [r["x"] for r in out] == [0.5, None, 1.25, 2.125, 3.0625] and [r["a"] for r in out] == [[0.5, 1.0], None, None, None, [2.75, 3.5]]


def test_pairs_follow_the_order_over_gaps_and_repeats(spark):
    df = spark.createDataFrame([("a", n, 1, 1, [float(n)]) for n in (3, 10, 11, 11, 40)] + [("b", 1, 1, 1, [7.0])], FRAMES)
    assert sorted((r["frame_no"], r["before"]) for r in flow.pairs(df).collect()) == [(10, [3.0]), (11, [10.0]), (11, [10.0]), (40, [11.0]), (40, [11.0])]
    assert flow.pairs(df.where("false")).count() == 0


def test_streamed_flow_equals_batch(spark, tmp_path):
    from opticframe.streaming.smoothing import flow_stream

    df = readers.synthetic_frames(spark, 6, 14, 15).union(readers.synthetic_frames(spark, 3, 12, 12).withColumn("video_id", F.lit("w")))
    rows = df.collect()
    for i in range(3):
        spark.createDataFrame([r for r in rows if r["frame_no"] // 2 == i], FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = flow_stream(readers.read_frames(spark, str(tmp_path / "in"), FRAMES))
    q = out.writeStream.format("memory").queryName("flows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["video_id"], r["frame_no"]): (r["u"], r["v"]) for r in spark.table("flows").collect()}
    want = {(r["video_id"], r["frame_no"]): (r["u"], r["v"]) for r in flow.smooth(flow.flow(df), "video_id", ["frame_no"], ["u", "v"]).collect()}
    assert got.keys() == want.keys() and len(got) == 7 and all(np.allclose(got[k], want[k]) for k in got)


def _png(path, pixels):
    import struct
    import zlib

    h, w, c = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def test_image_files_to_matches(spark, tmp_path):
    from opticframe.operators import features

    rng = np.random.default_rng(8)
    base = grid.resize(rng.uniform(0, 255, (12, 13)), 96, 104)
    scenes = {"a": base, "b": np.clip(base + 3, 0, 255), "c": grid.resize(rng.uniform(0, 255, (12, 13)), 96, 104), "flat": np.full((60, 60), 90.0)}
    for name, x in scenes.items():
        _png(tmp_path / f"{name}.png", np.repeat(np.clip(np.rint(x), 0, 255)[:, :, None], 3, 2))
    red = np.zeros((2, 3, 3))
    red[:, :, 0], red[0, 1, 1] = 200, 100
    _png(tmp_path / "red.png", red)
    (tmp_path / "broken.png").write_bytes(b"no image")
    images = readers.read_images(spark, f"file://{tmp_path}", "*.png")
    frames = {Path(r["video_id"]).stem: r for r in grid.grey_frames(images).collect()}
    assert set(frames) == {*scenes, "red"}
    assert np.allclose(np.array(frames["red"]["data"]).reshape(2, 3), [[59.8, 59.8 + 58.7, 59.8], [59.8] * 3])
    small = {Path(r["video_id"]).stem: r for r in grid.grey_frames(images, 48, 52).collect()}
    assert (small["a"]["height"], small["a"]["width"]) == (48, 52) and np.allclose(small["a"]["data"], grid.resize(np.array(frames["a"]["data"]).reshape(96, 104), 48, 52).ravel())
    d = features.image_descriptors(images).select("video_id", "number", F.col("features").cast("array<double>").alias("embedding"))
    d = d.withColumn("image", F.regexp_extract("video_id", r"(\w+)\.png$", 1)).where("image in ('a', 'b', 'c', 'flat')").withColumn("image", F.expr("array_position(array('a', 'b', 'c', 'flat'), image)"))
    d = d.withColumn("vec_id", F.col("image") * 100_000 + F.col("number"))
    assert {r["image"] for r in d.select("image").distinct().collect()} == {1, 2, 3}  # none in a flat picture
    scores = match.image_scores(match.ratio_match(d.where("image = 1"), d.where("image > 1"), relative=0.8, group="image"), d, F.col("image"))
    got = {r["target"]: r["score"] for r in scores.collect()}
    assert got[2] > 0.8 and got.get(3, 0.0) < 0.2


def test_odd_images(spark):
    rows = [("ok", 1, 2, 4, bytearray([10, 20, 30, 255, 1, 2, 3, 0])), ("grey", 1, 2, 1, bytearray([7, 9])), ("short", 2, 2, 3, bytearray([1])), ("none", 2, 2, 3, None), ("odd", 1, 1, 2, bytearray([1, 2]))]
    got = {r["video_id"]: r["data"] for r in grid.grey_frames(spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary")).collect()}
    assert np.allclose(got["ok"], [0.299 * 30 + 0.587 * 20 + 1.14, 0.299 * 3 + 0.587 * 2 + 0.114]) and got["grey"] == [7.0, 9.0] and got["short"] is got["none"] is got["odd"] is None


def test_compare_scales_by_nearest_pixels(spark):
    a = spark.createDataFrame([("v", 0, 2, 4, [0.0, 0.0, 1.0, 1.0, 0.5, 0.5, 0.2, 0.2]), ("v", 1, 1, 1, None), ("v", 2, 1, 2, [0.0, 2.0])], FRAMES)
    b = spark.createDataFrame([("v", 0, 2, 2, [0.0, 1.0, 0.5, 0.2]), ("v", 1, 1, 1, [1.0]), ("v", 2, 1, 2, [-1.0, 0.25])], FRAMES)
    got = sorted(tuple(r)[1:] for r in grid.compare(a, b).collect())
    assert got == [(0, 8, 0, 0.0), (1, None, None, None), (2, 2, 1, 0.75)]


def test_colours_and_turns(spark):
    from opticframe.functions import colour, geometry

    v = F.lit(0.5)
    row = spark.range(1).select(colour.smear(v).alias("s"), grid.to_srgb(grid.to_linear(v)).alias("r"), grid.to_srgb(F.lit(0.001)).alias("low")).first()
    assert row["s"] == [0.5] * 3 and math.isclose(row["r"], 0.5) and math.isclose(row["low"], 0.01292)
    x = np.arange(6.0).reshape(2, 3)
    df = spark.createDataFrame([("v", 0, 2, 3, x.ravel().tolist())], FRAMES)
    for k in range(5):
        got = df.select(colour.oriented(F.col("data"), F.col("height"), F.col("width"), k).alias("d")).first()["d"]
        assert got == np.rot90(x, -k).ravel().tolist()
    p = geometry.keypoint_circle(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, sigma double")).first()
    assert (p["cx"], p["cy"], p["r"]) == (1.0, 2.0, 3.0)


def test_random_vectors_and_stream_sink(spark, tmp_path):
    from opticframe.sources import sinks

    rows = readers.random_vectors(spark, 500, 10, 3).collect()
    x = np.array([r["vec"] for r in rows])
    assert x.shape == (500, 10) and 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.02 and len(np.unique(x)) == 5000
    assert rows == readers.random_vectors(spark, 500, 10, 3).repartition(3).orderBy("id").collect()
    readers.synthetic_frames(spark, 4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        sinks.write_stream(readers.read_frames(spark, str(tmp_path / "in"), FRAMES), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_resizes_equal_plain_sums():
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 255, (9, 14))

    def plain(lobes, n, m, o):
        step = n / m
        at = (o + 0.5) * step - 0.5
        if lobes == 1:
            at = min(max(at, 0), n - 1)
            w = [max(0.0, 1 - abs(i - at)) for i in range(n)]
        else:
            sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
            spread = max(1.0, step)
            w = [sinc((i - at) / spread) * sinc((i - at) / spread / 3) if abs(i - at) / spread < 3 else 0.0 for i in range(n)]
        return [x / sum(w) for x in w]

    for lobes, (h, w) in ((1, (5, 20)), (3, (4, 6)), (3, (9, 14))):
        want = [[sum(wy * wx * a[y, x] for y, wy in enumerate(plain(lobes, 9, h, i)) for x, wx in enumerate(plain(lobes, 14, w, j))) for j in range(w)] for i in range(h)]
        assert np.allclose(grid.resize(a, h, w, lobes), want)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.SQL.keys()))
def test_query_without_sql_has_rows(spark, name):
    if not Path(DATA).exists():
        pytest.skip("no test data")
    rows = catalogue.QUERIES[name](spark, DATA).collect()
    assert rows and not any(math.isnan(v) for r in rows for v in r if isinstance(v, float))
    if name == "mahalanobis_assign":
        x = {r["vec_id"]: np.array(r["embedding"], float).reshape(8, 8).mean(1) for r in catalogue.embeddings(spark, DATA).collect()}
        first = np.array([x[i] for i in range(catalogue.K)])
        near = {i: ((v - first) ** 2).sum(1).argmin() for i, v in x.items()}
        inverse = [np.linalg.inv(np.cov(np.array([x[i] for i in x if near[i] == k]).T, bias=True)) for k in range(catalogue.K)]
        for r in rows:
            d = [np.sqrt((x[r["vec_id"]] - c) @ m @ (x[r["vec_id"]] - c)) for c, m in zip(first, inverse)]
            assert r["cid"] == int(np.argmin(d)) and abs(r["distance"] - min(d)) < 1e-5

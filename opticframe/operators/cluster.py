"""K-means, pruning of small clusters, and bags of visual words.

Centroids are few (k vectors, checked).  A training step is one pass: each task multiplies its vectors with the
centroids in blocks and returns a count and a sum for each centroid.  Row by row, vectors are assigned in the JVM.

Defined results: vectors that are null, of another length than the centroids, or hold null or non-finite components
belong to no cluster (cid and distance null) and count nowhere; ties go to the lowest cid; an empty cluster keeps its
centroid; without rows all do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..shipping import ship
from .arrays import finite, matrix

#: Most numbers of all centroids together that go into a plan; rows multiplied at once; groups in which covariances are first summed.
LITERAL_NUMBERS, STRIP, PARTS = 500_000, 4096, 64


def checked(centroids: list[list[float]]) -> list[list[float]]:
    if sum(map(len, centroids)) > LITERAL_NUMBERS:
        raise ValueError("too many centroids for a plan")
    if len({len(c) for c in centroids}) > 1:
        raise ValueError("centroids have different lengths")
    return [list(map(float, c)) for c in centroids]


def literal(centroids: list[list[float]]) -> Column:
    return F.lit(checked(centroids)) if centroids else F.array().cast("array<array<double>>")


def usable(v: Column, centroids: list[list[float]]) -> Column:
    """Whether a vector can be held against the centroids."""
    return finite(v) & (F.size(v) == (len(centroids[0]) if centroids else 0))


def nearest(v: Column, centroids: list[list[float]]) -> Column:
    """struct(d, cid) of the nearest centroid: squared distance and number; null for a vector that cannot be held against them."""
    each = F.transform(literal(centroids), lambda c, i: F.struct(vec.squared_distance(v, c).alias("d"), i.alias("cid")))
    return F.when(usable(v, centroids), F.array_min(each))


def assign(df: DataFrame, centroids: list[list[float]], vector: str = "embedding") -> DataFrame:
    """The rows with cid and distance."""
    near = df.withColumn("_n", nearest(vec.doubles(vector), centroids))
    return near.withColumn("cid", F.col("_n.cid")).withColumn("distance", F.sqrt("_n.d")).drop("_n")


def assign_mahalanobis(df: DataFrame, centroids: list[list[float]], inverses: list[list[list[float]]], vector: str = "embedding") -> DataFrame:
    """The rows with cid and distance, each centroid's distance taken under its own inverse covariance."""
    v, words = vec.doubles(vector), F.arrays_zip(literal(centroids).alias("c"), F.lit([checked(m) for m in inverses]).alias("m"))
    each = F.transform(words, lambda s, i: F.struct(vec.mahalanobis(v, s["c"], s["m"]).alias("d"), i.alias("cid")))
    near = df.withColumn("_n", F.when(usable(v, centroids), F.array_min(each)))
    return near.withColumn("cid", F.col("_n.cid")).withColumn("distance", F.col("_n.d")).drop("_n")


def random_centroids(k: int, d: int, seed: int = 0) -> list[list[float]]:
    """k vectors of length 1 whose components were uniform in [-1, 1)."""
    x = np.random.default_rng(seed).uniform(-1, 1, (k, d))
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).tolist()


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each row of x the nearest row of c, the lowest on ties: those a product's rounding leaves in doubt are measured."""
    out, square = np.zeros(len(x), np.int64), (c * c).sum(1)
    for lo in range(0, len(x), STRIP):
        a = x[lo : lo + STRIP]
        length = (a * a).sum(1)[:, None]
        d = length - 2 * a @ c.T + square
        r, j = np.nonzero(d - 1e-9 * (length + square) <= (d + 1e-9 * (length + square)).min(1, keepdims=True))
        exact = ((a[r] - c[j]) ** 2).sum(1)
        order = np.lexsort((j, exact, r))
        first = np.flatnonzero(np.r_[True, np.diff(r[order]) != 0][: len(r)])
        out[lo + r[order][first]] = j[order][first]
    return out


def step(df: DataFrame, centroids: list[list[float]], vector: str = "embedding") -> tuple[list[list[float]], list[int]]:
    """(means of the clusters' vectors, sizes) after each vector went to its nearest centroid; an empty cluster keeps its centroid. k rows reach the driver."""
    ship(df.sparkSession)
    c = np.array(checked(centroids))
    k, d = c.shape
    v = vec.doubles(vector)

    def summed(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, d))
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                at = closest(x, c)
                count += np.bincount(at, minlength=k)
                for j in np.unique(at).tolist():
                    sums[j] += x[at == j].sum(0)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), pa.array(list(sums[there]), pa.list_(pa.float64()))], names=["cid", "n", "sums"])

    parts = df.select(v.alias("v")).where(usable(F.col("v"), centroids)).mapInArrow(summed, "cid int, n long, sums array<double>")
    rows = parts.groupBy("cid").agg(F.sum("n").alias("n"), *[F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(d)]).collect()
    got = {r["cid"]: r for r in rows}
    return [[got[j][f"s{i}"] / got[j]["n"] for i in range(d)] if j in got else list(map(float, centroids[j])) for j in range(k)], [got[j]["n"] if j in got else 0 for j in range(k)]


def shift(old: list[list[float]], new: list[list[float]]) -> float:
    return sum((a - b) ** 2 for x, y in zip(old, new) for a, b in zip(x, y))


def train(df: DataFrame, centroids: list[list[float]], iterations: int = 20, error: float = 0.001, least: int = 50, vector: str = "embedding") -> tuple[list[list[float]], list[int]]:
    """Centroids after at most so many steps, or once they move no more than the error; clusters of more than `least` rows, re-numbered, and their sizes
    as the last step's assignment had them.  `random_centroids` gives a seeded start."""
    sizes = [0] * len(centroids)
    for _ in range(iterations):
        new, sizes = step(df, centroids, vector)
        moved, centroids = shift(centroids, new), new
        if moved <= error:
            break
    kept = [i for i, n in enumerate(sizes) if n > least]
    return [centroids[i] for i in kept], [sizes[i] for i in kept]


def bags(df: DataFrame, words: list[list[float]], image: Column, k: int | None = None, vector: str = "embedding", soft: float | None = None) -> DataFrame:
    """(image_id, bow): normalised histogram of each image's nearest words, of length k; soft: words within the distance weigh 1 - d / soft. Images without words are left out."""
    k = k or len(words)
    rows = df.withColumn("image_id", image)
    if soft is None:
        hits = assign(rows, words, vector).select("image_id", "cid", F.lit(1.0).alias("w"))
    else:
        all_words = F.transform(literal(words), lambda c, i: F.struct(i.alias("cid"), vec.distance(vec.doubles(vector), c).alias("d")))
        hits = rows.where(usable(vec.doubles(vector), words)).select("image_id", F.explode(F.filter(all_words, lambda s: s["d"] < soft)).alias("s")).select("image_id", "s.cid", (1 - F.col("s.d") / soft).alias("w"))
    counts = hits.groupBy("image_id").agg(*[F.sum(F.when(F.col("cid") == i, F.col("w")).otherwise(0.0)).alias(f"w{i}") for i in range(k)])
    bow = counts.select("image_id", F.array(*[F.col(f"w{i}") for i in range(k)]).alias("bow"))
    return bow.withColumn("bow", vec.normalized(F.col("bow"))).where(F.col("bow").isNotNull())


def within(df: DataFrame, words: list[list[float]], radius: float = 0.1, vector: str = "embedding") -> DataFrame:
    """The rows with the ascending list cids of centroids nearer than the radius; none for a vector that cannot be held against them."""
    v = vec.doubles(vector)
    near = F.transform(literal(words), lambda c, i: F.struct(i.alias("cid"), vec.distance(v, c).alias("d")))
    return df.withColumn("cids", F.when(usable(v, words), F.transform(F.filter(near, lambda s: s["d"] < radius), lambda s: s["cid"])).otherwise(F.array().cast("array<int>")))


def _merged(n: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and sums of outer products about them, of parts, as those of the whole."""
    total = int(n.sum())
    centre = (n[:, None] * mean).sum(0) / total
    off = mean - centre
    return total, centre, spread.sum(0) + (off * n[:, None]).T @ off


def _moments(assigned: DataFrame, vector: str) -> DataFrame:
    """(cid, n, mean, spread) of each cluster: each task's own, merged in two steps, so that no task gets a row from each other."""
    schema = pa.schema([("cid", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64()))])
    text = "cid int, part int, n long, mean array<double>, spread array<double>"

    def rows_of(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_pylist([{"cid": c, "part": p, "n": n, "mean": m.tolist(), "spread": s.ravel().tolist()} for c, p, n, m, s in rows], schema=schema)

    def own(batches):
        known: dict[int, tuple] = {}
        part = 0
        for batch in batches:
            cids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for c in np.unique(cids).tolist():
                some = x[cids == c]
                mean = some.mean(0)
                now = (np.array([len(some)]), mean[None], ((some - mean).T @ (some - mean))[None])
                if c in known:
                    was = known[c]
                    now = tuple(np.concatenate([np.array([w]) if k == 0 else w[None], x]) for k, (w, x) in enumerate(zip(was, now)))
                known[c] = _merged(*now)
                part = batch.column(2)[0].as_py() % PARTS
        yield from rows_of([(c, part, *v) for c, v in known.items()]).to_batches()

    def merged(t: pa.Table) -> pa.Table:
        mean = matrix(t.column("mean"))
        got = _merged(t.column("n").to_numpy(), mean, matrix(t.column("spread")).reshape(len(mean), mean.shape[1], mean.shape[1]))
        return rows_of([(t.column("cid")[0].as_py(), t.column("part")[0].as_py(), *got)])

    rows = assigned.select(F.col("cid").cast("int"), vec.doubles(vector).alias("v"), F.spark_partition_id().alias("part")).where(F.col("cid").isNotNull() & finite(F.col("v")))
    return rows.mapInArrow(own, text).groupBy("cid", "part").applyInArrow(merged, text).groupBy("cid").applyInArrow(merged, text).drop("part")


def covariance(assigned: DataFrame, vector: str = "embedding") -> DataFrame:
    """(cid, i, j, value): population covariance of all components in each cluster, i <= j."""
    d = F.size("mean")
    each = F.transform("spread", lambda x, at: F.struct(F.floor(at / d).cast("int").alias("i"), (at % d).cast("int").alias("j"), (x / F.col("n")).alias("value")))
    return _moments(assigned, vector).select("cid", F.explode(F.filter(each, lambda s: s["i"] <= s["j"])).alias("s")).select("cid", "s.*")


def inverse_covariance(assigned: DataFrame, vector: str = "embedding", worst: float = 1e12) -> DataFrame:
    """(cid, inverse): the inverse of each cluster's covariance, rows of arrays; null where it is singular, its condition beyond `worst`."""

    def inverted(batches):
        for batch in batches:
            out = []
            for n, d, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                m = np.array(s).reshape(d, d) / n
                out.append(np.linalg.inv(m).tolist() if m.any() and np.linalg.cond(m) < worst else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["cid", "inverse"])

    return _moments(assigned, vector).select("cid", "n", F.size("mean").alias("d"), "spread").mapInArrow(inverted, "cid int, inverse array<array<double>>")


def best_image(queries: DataFrame, references: DataFrame, metric: str = "cosine", digits: int = 9, ties: int = 16) -> DataFrame:
    """(source, target, score): the reference with the best bag for each query's bag. Bags are unit vectors, so both metrics rank by the nearest; the search is
    that of the exact neighbours. Scores are rounded to so many digits; of the nearest `ties` references whose scores are then equal, the lower image wins."""
    from .nn import search

    near = search(queries, references, k=ties, id_col="image_id", vector="bow", other=False)
    distance = F.col("distance") if metric == "l2" else F.col("distance") * F.col("distance") / 2
    best = near.withColumn("_d", F.round(distance, digits)).groupBy("query_id").agg(F.min(F.struct("_d", "id")).alias("m"))
    score = F.col("m._d") if metric == "l2" else F.round(1 - F.col("m._d"), digits)
    return best.select(F.col("query_id").alias("source"), F.col("m.id").alias("target"), score.alias("score"))

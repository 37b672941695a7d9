"""Nearest neighbours, exact or of the same random-projection bucket: tiles of query block by point block, multiplied in numpy.

Both sides are dealt to blocks of about BLOCK_BYTES by a hash of their rows; each two blocks of vectors of one length
meet in a task of bounded memory, which returns at most k points a query and group (or those within the radius).
The larger the blocks, the fewer copies of them travel: all rows against all is quadratic by its nature.

Defined results: vectors that are null, empty, hold null or non-finite components, or whose squared length is beyond a
double, and rows without id, take no part; vectors of different length are no neighbours; an id counts once, however
many rows it has, at the least distance of any of its rows and the query's; ties go to the smaller id; a null group is
a group; empty tables find nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .arrays import finite, matrix

#: Bytes of a block's vectors; rows of a product at once; pairs measured at once; one pair asked for in so many, below which pairs are measured without a product.
BLOCK_BYTES, STRIP, PAIRS, DENSE = 8 << 20, 512, 1 << 16, 32
FOUND = pa.schema([("query_id", pa.int64()), ("group", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def _blocks(df: DataFrame, id_col: str, vector: str, group: str | None) -> tuple[DataFrame, int]:
    """(dim, b, ids, gs, no_g, vs): vectors of one length in blocks, and the number of blocks."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(0)).cast("long").alias("g"))
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("v"))).withColumn("dim", F.size("v"))
    n = max(1, -(-8 * (rows.agg(F.sum("dim")).first()[0] or 0) // BLOCK_BYTES))

    def pack(t: pa.Table) -> pa.Table:
        v = matrix(t.column("v"))
        with np.errstate(over="ignore"):
            at = np.flatnonzero(np.isfinite((v * v).sum(1)))
        ids, g = t.column("id").to_numpy()[at], t.column("g").combine_chunks()
        order = at[np.argsort(ids, kind="stable")]
        gs, no_g = g.fill_null(0).to_numpy()[order], g.is_null().to_numpy(zero_copy_only=False)[order]
        return pa.table({"dim": t.column("dim")[:1], "b": t.column("b")[:1], "ids": [np.sort(ids).tobytes()], "gs": [gs.tobytes()], "no_g": [no_g.tobytes()], "vs": [v[order].tobytes()]})

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return dealt.groupBy("dim", "b").applyInArrow(pack, "dim int, b int, ids binary, gs binary, no_g binary, vs binary"), n


def buckets(v: np.ndarray, length: float, tables: int, seed: int) -> np.ndarray:
    """(rows of v, tables): in which piece of the length each vector's projection on each table's random direction falls."""
    to = np.random.default_rng(seed).standard_normal((v.shape[1], tables))
    with np.errstate(over="ignore"):
        return np.floor(v @ (to / np.sqrt((to * to).sum(0))) / length)


class Buckets:
    """The rows of each bucket of each table."""

    def __init__(self, y: np.ndarray, hashing: tuple[float, int, int]):
        self.hashing, self.rows = hashing, len(y)
        numbers = buckets(y, *hashing)
        self.order = [np.argsort(n, kind="stable") for n in numbers.T]
        self.numbers = [n[o] for n, o in zip(numbers.T, self.order)]

    def shared(self, x: np.ndarray) -> np.ndarray:
        """(rows of x, rows): whether they share a bucket in any table."""
        out = np.zeros((len(x), self.rows), bool)
        for n, order, there in zip(buckets(x, *self.hashing).T, self.order, self.numbers):
            for b in np.unique(n):
                out[np.ix_(np.flatnonzero(n == b), order[np.searchsorted(there, b) : np.searchsorted(there, b, "right")])] = True
        return out


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, own: np.ndarray | None, k: int | None, reach: float, hashing: tuple[float, int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, ids, distances): of each row of x the k nearest ids of y's rows (None: all) within reach; own: ids that are not their own
    neighbours; hashing: only rows that share a bucket."""
    out: list[tuple[np.ndarray, ...]] = []
    index = None if hashing is None else Buckets(y, hashing)
    square = (y * y).sum(1)
    for lo in range(0, len(x), STRIP):
        a = x[lo : lo + STRIP]
        asked = np.ones((len(a), len(y)), bool) if index is None else index.shared(a)
        if own is not None:
            asked &= own[lo : lo + STRIP, None] != ids
        if DENSE * np.count_nonzero(asked) < asked.size:
            r, c = np.nonzero(asked)
        else:
            length = (a * a).sum(1)[:, None]
            d = np.where(asked, length - 2 * a @ y.T + square, np.inf)
            slack = 1e-9 * (length + square) + 1e-300  # of the product's rounding, pair by pair
            least = np.maximum(d - slack, 0)
            bar = np.full(len(a), reach**2)
            if k is not None and len(ids) > k:  # the k-th of what the pairs are at most
                bar = np.minimum(bar, np.partition(d + slack, k - 1, 1)[:, k - 1])
            r, c = np.nonzero((least <= bar[:, None]) & np.isfinite(d))
        exact = np.concatenate([np.zeros(0), *[np.sqrt(((a[r[p : p + PAIRS]] - y[c[p : p + PAIRS]]) ** 2).sum(1)) for p in range(0, len(r), PAIRS)]])
        near = exact <= reach
        r, vid, exact = r[near], ids[c[near]], exact[near]
        order = np.lexsort((exact, vid, r))
        r, vid, exact = r[order], vid[order], exact[order]
        once = np.r_[True, (np.diff(r) != 0) | (np.diff(vid) != 0)][: len(r)]
        r, vid, exact = r[once], vid[once], exact[once]
        if k is not None:
            order = np.lexsort((vid, exact, r))
            r, vid, exact = r[order], vid[order], exact[order]
            top = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, vid, exact = r[top], vid[top], exact[top]
        out.append((r + lo, vid, exact))
    return tuple(np.concatenate([np.zeros(0, t), *[o[j] for o in out]]) for j, t in enumerate((np.int64, np.int64, np.float64)))


def search(queries: DataFrame, points: DataFrame, k: int | None = 1, radius: float | None = None, id_col: str = "vec_id", vector: str = "embedding", group: str | None = None, other: bool = True, hashing: tuple[float, int, int] | None = None) -> DataFrame:
    """(query_id, group, id, distance, rank): nearest points of each query, in each group of points if there is one.

    k None: all within the radius.  other: a query is not its own neighbour.  hashing (length, tables, seed): of the points that
    share a bucket with the query, see lsh.
    """
    ship(queries.sparkSession)
    (q, m), (p, n) = _blocks(queries, id_col, vector, None), _blocks(points, id_col, vector, group)
    q = q.withColumnRenamed("b", "q").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    p = p.withColumnRenamed("b", "p").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    reach = np.inf if radius is None else radius

    def tile(asked: pa.Table, there: pa.Table) -> pa.Table:
        out = [FOUND.empty_table()]
        if asked.num_rows and there.num_rows:
            a, b = asked.to_pylist()[0], there.to_pylist()[0]
            qids, ids, gs, no_g = np.frombuffer(a["ids"], np.int64), np.frombuffer(b["ids"], np.int64), np.frombuffer(b["gs"], np.int64), np.frombuffer(b["no_g"], bool)
            x, y = np.frombuffer(a["vs"]).reshape(len(qids), a["dim"]), np.frombuffer(b["vs"]).reshape(len(ids), a["dim"])
            kinds, which = np.unique(np.stack([no_g.astype(np.int64), gs], 1), axis=0, return_inverse=True)
            for g, (none, value) in enumerate(kinds.tolist()):
                mine = np.flatnonzero(which.ravel() == g)
                r, vid, d = nearest(x, y[mine], ids[mine], qids if other else None, k, reach, hashing)
                out.append(pa.table({"query_id": qids[r], "group": pa.array([None if none else value] * len(r), pa.int64()), "id": vid, "distance": d}, schema=FOUND))
        return pa.concat_tables(out)

    keys = ("dim", "q", "p")
    found = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(tile, "query_id long, group long, id long, distance double")
    once = found.repartition("query_id", "group").groupBy("query_id", "group", "id").agg(F.min("distance").alias("distance"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "group").orderBy("distance", "id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def point_lookup(queries: DataFrame, points: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id) of points whose vector equals the query's, component by component (a null one equals nothing); an equi-join on the array."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    return q.join(points.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")), "v").select("query_id", "id")


def lsh(points: DataFrame, id_col: str = "vec_id", vector: str = "embedding", length: float = 0.5, tables: int = 8, threshold: float = 1.2, seed: int = 1, queries: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(query_id, id, distance) of pairs that share a bucket and are nearer than the threshold; queries: the points themselves by default; k: the k nearest of each.

    Bucketed random projections: in each table a random direction is cut into pieces of the length, and vectors whose
    projections fall into one piece share a bucket.  Each block of points is an index of its own, of all its rows, which each
    query looks its buckets up in; what it finds there is measured exactly, and no pair leaves a task but those within the threshold.
    """
    found = search(points if queries is None else queries, points, k, float(np.nextafter(threshold, -np.inf)), id_col, vector, hashing=(length, tables, seed))
    return found.select("query_id", "id", "distance")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(total, correct, ratio, mse) of nearest neighbours (query_id, distance) against the true ones."""
    best = found.groupBy("query_id").agg(F.min("distance").alias("d"))
    both = truth.select("query_id", F.col("distance").alias("t")).join(best, "query_id", "left")
    error = (F.col("d") - F.col("t")) * (F.col("d") - F.col("t"))
    return both.agg(F.count(F.lit(1)).alias("total"), F.sum((error < 1e-18).cast("long")).alias("correct"), F.avg(F.coalesce((error < 1e-18).cast("double"), F.lit(0.0))).alias("ratio"), F.avg(error).alias("mse"))

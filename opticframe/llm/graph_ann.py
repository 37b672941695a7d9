"""Approximate nearest neighbours by cosine: a robust-pruned directed graph for each shard.

``index`` deals vectors to shards of about SHARD_ROWS by a hash of their id and builds a graph in each:
points are inserted in growing batches, a greedy search over the graph so far proposes neighbours, and
robust pruning keeps a neighbour only if no kept one is nearer to it by the factor ALPHA, which leaves
edges in diverse directions.  Equal vectors are one point of a shard's graph that lists their ids.
``search`` runs a beam search for every query in every shard (queries in blocks against the whole
index), scores what it finds in double precision on the original vectors and merges the shards' lists.

Defined results: vectors that are null, empty, zero or hold null or non-finite components are neither
indexed nor searched for; vectors of another length than the most common one raise an error; a query's
candidates are all other ids, each once however many rows it has, at the best score of any of its rows and
the query's; ties go to the smaller id; rows without id take no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

SHARD_ROWS = 4096
DEGREE, BEAM, ALPHA, EXPAND = 40, 64, 1.2, 4
#: Products of candidates with each other that are held at once.
PRODUCTS = 1 << 23
#: Queries that one task searches for in one shard.
QUERY_ROWS = 8192


def valid(vector: str) -> F.Column:
    """Whether a vector column can be compared by cosine."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A column of equally long vectors as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if flat.size % len(column) or (np.diff(column.offsets.to_numpy()) != flat.size // len(column)).any():
        raise ValueError("vectors have different lengths")
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflows nor vanishes when squared
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Graph:
    """A robust-pruned graph over unit vectors; distances are squared Euclidean ones."""

    def __init__(self, x: np.ndarray, neighbours: np.ndarray | None = None, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        self.x, self.degree, self.beam, self.alpha = np.ascontiguousarray(x, np.float32), degree, beam, alpha**2
        n = len(x)
        rng = np.random.default_rng(n)
        centre = int(np.argmax(self.x @ self.x.mean(0))) if n else 0
        self.entry = np.arange(n) if n <= beam else np.unique(np.r_[centre, rng.choice(n, 15, replace=False)])
        if neighbours is not None:
            self.neighbours = neighbours
            return
        self.neighbours = np.full((n, degree), -1, np.int32)
        order = np.r_[self.entry, np.setdiff1d(rng.permutation(n), self.entry, assume_unique=True)] if n else np.arange(0)
        rng.shuffle(order[len(self.entry) :])
        done = len(self.entry)
        self._link(order[:done], np.broadcast_to(self.entry, (done, done)))
        while done < n:
            batch = order[done : done + min(max(done, 32), 512)]
            self._link(batch, self.search(self.x[batch], all_seen=True)[0])
            done += len(batch)

    def search(self, queries: np.ndarray, beam: int | None = None, all_seen: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: places (-1: none) and distances, nearest first."""
        beam, (q, n) = beam or self.beam, (len(queries), len(self.x))
        queries = np.ascontiguousarray(queries, np.float32)
        row = np.arange(q)[:, None]
        ids = np.broadcast_to(self.entry, (q, len(self.entry))).astype(np.int64)
        dist = 2 - 2 * (queries @ self.x[self.entry].T)
        seen = np.zeros((q, n + 1), bool)
        seen[:, self.entry] = True
        seen[:, n] = True
        keep = beam if not all_seen else 2 * beam
        open_ = np.ones(ids.shape, bool)
        while True:
            top = np.argsort(dist, 1)[:, :keep]
            ids, dist, open_ = ids[row, top], dist[row, top], open_[row, top]
            live = open_[:, :beam]
            active = live.any(1)
            if not active.any():
                return ids, dist
            rank = np.where(live, live.cumsum(1), beam + 1)
            pick = np.argpartition(rank, EXPAND - 1, 1)[:, :EXPAND] if rank.shape[1] > EXPAND else np.broadcast_to(np.arange(rank.shape[1]), rank.shape)
            chosen = np.take_along_axis(rank, pick, 1) <= EXPAND
            open_[row, pick] &= ~chosen
            near = np.where(chosen[:, :, None], self.neighbours[ids[row, pick]], -1).reshape(q, -1).astype(np.int64)
            near[near < 0] = n
            near = np.sort(near, 1)
            fresh = ~seen[row, near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[row, near] = True
            width = int(fresh.sum(1).max())
            if not width:
                continue
            first = np.argsort(~fresh, 1, kind="stable")[:, :width]
            near, fresh = near[row, first], fresh[row, first]
            near = np.where(fresh, near, 0)
            d = np.where(fresh, 2 - 2 * np.matmul(self.x[near], queries[:, :, None])[:, :, 0], np.float32(np.inf))
            ids, dist, open_ = np.hstack([ids, near]), np.hstack([dist, d]), np.hstack([open_, fresh])

    def _prune(self, points: np.ndarray, candidates: np.ndarray) -> None:
        """Robust pruning: the nearest candidate is kept and drops those that it is nearer to, by the factor, than the point is; and again."""
        some = max(1, PRODUCTS // candidates.shape[1] ** 2)
        for lo in range(0, len(points), some):
            self._prune_some(points[lo : lo + some], candidates[lo : lo + some])

    def _prune_some(self, points: np.ndarray, candidates: np.ndarray) -> None:
        cx = self.x[candidates]
        d = 2 - 2 * np.matmul(cx, self.x[points][:, :, None])[:, :, 0]
        apart = 2 - 2 * np.matmul(cx, cx.transpose(0, 2, 1))  # of any two candidates of a point
        same = (candidates < 0) | (candidates == points[:, None])
        order = np.argsort(np.where(same, np.inf, candidates), 1, kind="stable")
        again = np.zeros(candidates.shape, bool)
        s = np.take_along_axis(candidates, order, 1)
        np.put_along_axis(again, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
        alive = ~(same | again)
        out, row = np.full((len(points), self.degree), -1, np.int32), np.arange(len(points))
        for k in range(self.degree):
            left = np.where(alive, d, np.inf)
            best = left.argmin(1)
            has = left[row, best] < np.inf
            if not has.any():
                break
            out[has, k] = candidates[row, best][has]
            alive &= self.alpha * apart[row, best] > d
            alive[row, best] = False
        self.neighbours[points] = out

    def _link(self, points: np.ndarray, candidates: np.ndarray) -> None:
        self._prune(points, np.ascontiguousarray(candidates))
        target = self.neighbours[points].ravel()
        source = np.repeat(points, self.degree)[target >= 0]
        target = target[target >= 0]
        order = np.argsort(target, kind="stable")
        nodes, begin, count = np.unique(target[order], return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 512):
            at, b, c = nodes[lo : lo + 512], begin[lo : lo + 512], count[lo : lo + 512]
            new = np.full((len(at), int(c.max())), -1, np.int64)
            mask = np.arange(new.shape[1]) < c[:, None]
            new[mask] = source[order][np.concatenate([np.arange(x, x + y) for x, y in zip(b, c)])]
            merged = np.hstack([self.neighbours[at].astype(np.int64), new])
            roomy = (merged >= 0).sum(1) <= self.degree
            fit = merged[roomy]
            fit = np.take_along_axis(fit, np.argsort(fit < 0, 1, kind="stable"), 1)[:, : self.degree]
            self.neighbours[at[roomy]] = fit
            if (~roomy).any():
                self._prune(at[~roomy], merged[~roomy])


def _points(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unique vectors, and the distinct ids of each in ascending order: (first rows, ids by vector, begins, counts)."""
    kinds = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, which = np.unique(kinds, return_index=True, return_inverse=True)
    order = np.lexsort((ids, which))
    again = (np.diff(which[order]) == 0) & (np.diff(ids[order]) == 0)
    order = order[np.r_[np.full(min(1, len(order)), True), ~again]]
    count = np.bincount(which[order], minlength=len(first))
    return first, ids[order], np.cumsum(count) - count, count


INDEX = "shard int, ids binary, begins binary, vectors binary, neighbours binary, dim int"


def index(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """A row for each shard: the ids, vectors and graph (see INDEX); written to the shared folder."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where(F.col("_id").isNotNull() & valid("_v"))
    shards = max(1, -(-rows.count() // shard_rows))

    def build(group: pa.Table) -> pa.Table:
        shard, ids, x = group.column("_shard")[0].as_py(), group.column("_id").to_numpy(), matrix(group.column("_v"))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        first, members, begins, count = _points(ids, x)
        graph = Graph(unit(x[first]), degree=degree, beam=beam)
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "ids": [members.tobytes()], "begins": [np.r_[begins, len(members)].astype(np.int64).tobytes()],
            "vectors": [x[first].tobytes()], "neighbours": [graph.neighbours.tobytes()], "dim": pa.array([x.shape[1]], pa.int32()),
        })

    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int")).repartition(shards, "_shard")
    return Scratch(spark, "graph").save(dealt.groupBy("_shard").applyInArrow(build, INDEX))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row of q with the same row of x, in double precision; each row's sums have one order."""
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def best(qid: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each query, nearest first; of hits of one id the best."""
    order = np.lexsort((-score, vid, qid))
    qid, vid, score = qid[order], vid[order], score[order]
    once = np.r_[True, (np.diff(qid) != 0) | (np.diff(vid) != 0)][: len(qid)]
    qid, vid, score = qid[once], vid[once], score[once]
    order = np.lexsort((vid, -score, qid))
    qid, vid, score = qid[order], vid[order], score[order]
    top = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return qid[top], vid[top], score[top]


def search(queries: DataFrame, built: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", beam: int = BEAM, degree: int = DEGREE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, its own id apart."""
    spark = queries.sparkSession
    bounded_batches(spark)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("_v")).where(F.col("query_id").isNotNull() & valid("_v"))
    shards = (built.agg(F.max("shard")).first()[0] or 0) + 1  # shards are numbered; one that is not there finds nothing
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    each = asked.withColumn("_group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    each = each.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = built.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def find(asked: pa.Table, part: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not asked.num_rows or not part.num_rows:
            return schema.empty_table()
        row = part.to_pylist()[0]
        x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        ids, begins = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["begins"], np.int64)
        graph = Graph(unit(x), np.frombuffer(row["neighbours"], np.int32).reshape(len(x), -1), beam=beam)
        own, q = asked.column("query_id").to_numpy(), matrix(asked.column("_v"))
        out: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(q), 256):
            some, mine = q[lo : lo + 256], own[lo : lo + 256]
            at = graph.search(unit(some))[0][:, : 2 * k + 6]
            n, width = at.shape
            score = cosines(np.repeat(some, width, 0), x[at.ravel()]).reshape(n, width)
            # of equal vectors only the k + 1 smallest ids can be among a query's k nearest
            for j in range(k + 1):
                place = begins[at] + j
                there = place < begins[at + 1]
                member = ids[np.where(there, place, 0)]
                there &= member != mine[:, None]
                r, c = np.nonzero(there)
                out.append((mine[r], member[r, c], score[r, c]))
        qid, vid, s = best(*(np.concatenate([o[j] for o in out]) for j in range(3)), k)
        # one id's many vectors can fill the places: who found fewer ids than there are looks at all vectors
        asking, kinds = np.unique(own), np.unique(ids)
        few = np.bincount(np.searchsorted(asking, qid), minlength=len(asking)) < np.minimum(k, len(kinds) - np.isin(asking, kinds))
        if few.any():
            point, out = np.repeat(np.arange(len(x)), np.diff(begins)), [(qid, vid, s)]
            for j in np.nonzero(few[np.searchsorted(asking, own)])[0]:
                score, other = cosines(q[j : j + 1], x)[point], ids != own[j]
                out.append(best(np.full(int(other.sum()), own[j]), ids[other], score[other], k))
            qid, vid, s = best(*(np.concatenate([o[j] for o in out]) for j in range(3)), k)
        return pa.table({"query_id": qid, "vec_id": vid, "score": s}, schema=schema)

    n = shards * groups
    found = each.repartition(n, "shard", "_group").groupBy("shard", "_group").cogroup(parts.repartition(n, "shard", "_group").groupBy("shard", "_group")).applyInArrow(find, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

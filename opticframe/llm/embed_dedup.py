"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of one label are one class; what links a class to another links all its rows, so copies are
counted, not paired.  The classes of a label are dealt to blocks, and every two blocks of a label make a
tile: one task multiplies their int8 forms.  A vector x of length 1 is s*q + e with integer q; then
|x.y - s_x*s_y*(q_x.q_y)| <= |s_x q_x||e_y| + |e_x||s_y q_y| + |e_x||e_y|, all of it known per vector.
Pairs whose product plus bound stays under the threshold are settled, as are those whose product less the
bound reaches it; all others are computed in double precision.  A tile returns a row for each class that
links there (how many rows it links with, and the tile's least class it is joined to), never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null label or without id, link with nothing and are their own component (a row without id: null, not
kept); rows that share an id and vector link with each other; rows of one id are one node of
a component; vectors of different length in one label raise an error; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, bounded_batches
from .components import Forest, connected_components
from .graph_ann import cosines, matrix, unit, valid

THRESHOLD = 0.93
#: Classes of a block, rows of a tile's product at once, pairs recomputed at once.
BLOCK_ROWS, STRIP, PAIRS = 2048, 512, 1 << 15
#: Covers the rounding of the 32-bit product and scales: far over 4 * 2**-24.
SLACK = 1e-5


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors of length 1: int8 values, scales, lengths of the int8 part, lengths of the rest."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    part = q * scale[:, None]
    return q, scale, np.sqrt((part**2).sum(1)), np.sqrt(((x - part) ** 2).sum(1))


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) with cosine >= threshold; same: a is b, each pair once and none with itself."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = quantise(unit(a)), quantise(unit(b))
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integers up to 2**24 are exact in 32 bits
    right = np.ascontiguousarray(qb.T.astype(kind))
    for lo in range(0, len(a), STRIP):
        i = slice(lo, lo + STRIP)
        product = (qa[i].astype(kind) @ right) * sa[i, None].astype(kind) * sb.astype(kind)
        bound = (na[i, None] * eb + ea[i, None] * (nb + eb) + SLACK).astype(kind)
        possible = product + bound >= threshold
        if same:
            possible &= np.arange(len(b)) > np.arange(lo, min(lo + STRIP, len(a)))[:, None]
        r, c = np.nonzero(possible)
        sure = product[r, c] - bound[r, c] >= threshold
        yield r[sure] + lo, c[sure]
        r, c = r[~sure] + lo, c[~sure]
        for k in range(0, len(r), PAIRS):
            x, y = r[k : k + PAIRS], c[k : k + PAIRS]
            linked = cosines(a[x], b[y]) >= threshold
            yield x[linked], y[linked]


def link(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "embeddings")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid("v")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, labels = [], batch.column(1).to_pylist()
            v = batch.column(2)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False) + 0.0, v.offsets.to_numpy() - v.offsets[0].as_py()
            blobs = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            keys = [hashlib.md5(x.encode("utf-8", "surrogatepass") + b"\0" + y, usedforsecurity=False).digest() for x, y in zip(labels, blobs)]
            group = [hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for x in labels]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group, pa.binary()), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "label", "vkey", "v"])

    rows = scratch.save(given.where(usable).mapInArrow(keyed, "vec_id long, label binary, vkey binary, v binary"))
    classes = scratch.save(rows.groupBy("vkey").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("v").alias("v")))
    sizes = classes.groupBy("label").agg(F.count(F.lit(1)).alias("_m")).withColumn("blocks", F.ceil(F.col("_m") / F.lit(block_rows)).cast("int"))
    dealt = attach(classes, sizes, "label", "_m", classes.count())
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vkey"), F.col("blocks")).cast("int"))

    def blocked(group: pa.Table) -> pa.Table:
        order = pa.array(np.argsort(group.column("rep").to_numpy(), kind="stable"))
        group = group.take(order)
        blobs = group.column("v").to_pylist()
        if len({len(x) for x in blobs}) > 1:
            raise ValueError("vectors have different lengths")
        return pa.table({
            "label": group.column("label")[:1], "block": group.column("block")[:1], "blocks": group.column("blocks")[:1], "reps": [group.column("rep").to_numpy().tobytes()],
            "ns": [group.column("n").to_numpy().tobytes()], "vkeys": [b"".join(group.column("vkey").to_pylist())], "vs": [b"".join(blobs)],
        })

    block_schema = "label binary, block int, blocks int, reps binary, ns binary, vkeys binary, vs binary"
    blocks = scratch.save(dealt.select("label", "block", "blocks", "rep", "n", "vkey", "v").groupBy("label", "block").applyInArrow(blocked, block_schema))
    tiles = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")

    def multiplied(tile: pa.Table) -> pa.Table:
        parts = sorted(tile.to_pylist(), key=lambda r: r["block"])
        same = len(parts) == 1
        if same and parts[0]["i"] != parts[0]["j"]:
            return pa.table({"vkey": pa.array([], pa.binary()), "rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "hub": pa.array([], pa.int64())})  # the other block is empty
        reps, ns = (np.concatenate([np.frombuffer(p[k], np.int64) for p in parts]) for k in ("reps", "ns"))
        vs = [np.frombuffer(p["vs"], np.float64).reshape(len(p["reps"]) // 8, -1) for p in parts]
        if vs[0].shape[1] != vs[-1].shape[1]:
            raise ValueError("vectors have different lengths")
        shift, links, forest = 0 if same else len(vs[0]), np.zeros(len(reps), np.int64), Forest(len(reps))
        for a, b in tile_links(vs[0], vs[-1], threshold, same):
            b = b + shift
            links += np.bincount(a, ns[b], len(reps)).astype(np.int64) + np.bincount(b, ns[a], len(reps)).astype(np.int64)
            forest.join(a, b)
        vkeys = b"".join(p["vkeys"] for p in parts)
        at = np.flatnonzero(links)
        return pa.table({"vkey": pa.array([vkeys[16 * k : 16 * k + 16] for k in at.tolist()], pa.binary()), "rep": reps[at], "links": links[at], "hub": reps[forest.label[at]]})

    linked = scratch.save(tiles.groupBy("label", "i", "j").applyInArrow(multiplied, "vkey binary, rep long, links long, hub long"))
    links = linked.groupBy("vkey").agg(F.sum("links").alias("links"))
    components = connected_components(linked.select(F.col("rep").alias("a"), F.col("hub").alias("b")), scratch)
    known = classes.drop("v", "label").join(links, "vkey", "left").join(components, F.col("rep") == F.col("node"), "left")
    known = known.select("vkey", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = attach(rows.select("vec_id", "vkey"), known, "vkey", "n", rows.count()).drop("vkey")
    alone = given.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

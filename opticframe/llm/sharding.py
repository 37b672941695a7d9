"""Sharding by Karmarkar-Karp differencing: near-equal bytes, with groups of equal texts kept together.

A partial partition is a tuple of shard sums.  The two with the largest spread are combined, the largest
sum of one with the smallest of the other, again and again until one is left.  Up to BLOCK_GROUPS groups
are differenced in one heap.  Of more, the BLOCK_GROUPS largest are differenced first, and tell how much of
the rest each shard is still to get; the others are dealt to blocks by a hash of their text, and each block
gives the shards its bytes in those proportions, so that a group of any size is made up for by all blocks.
The last block is differenced on top of the true sums of all that went before and evens out what they left.

Defined results: a null text has size EXTRA, and is in one group with empty texts; equal rows, rows of
one doc_id and rows without one are placed one by one, in the shard of their text; one text that is larger than a
fair share has its shard as nearly alone as it can be; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, attach

SHARDS, EXTRA = 24, 8
#: Groups of a block (as many of the largest are differenced before all blocks); groups that are differenced in one heap.
BLOCK_GROUPS, RUN = 20_000, 20_000
#: Slots are counted within (shard, chunk); a chunk has about so many rows.
CHUNK_ROWS, LEAST_CHUNKS = 100_000, 96


def difference(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over (n, k) partial partitions: where each one's entries go, (n, k), and the sums of the k parts, largest first."""
    n, k = tuples.shape
    if not n:
        return np.zeros((0, k), np.int64), np.zeros(k, np.int64)
    first = np.argsort(-tuples, 1, kind="stable")
    sums = dict(enumerate(np.take_along_axis(tuples, first, 1)))
    heap = [(int(s[-1] - s[0]), i) for i, s in sums.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), node))
    root = heap[0][1]
    goes, out = {root: np.arange(k)}, np.empty((n, k), np.int64)
    for node in range(root, n - 1, -1):
        a, b, order = merges[node - n]
        to, at = goes.pop(node), np.empty(k, np.int64)
        at[order] = to
        goes[a], goes[b] = at, at[::-1]
    for i, to in goes.items():
        out[i, first[i]] = to
    return out, sums[root]


def partition(sizes: np.ndarray, parts: int, run: int = RUN, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A part of each size, and the sums of the parts, which begin at base; runs follow each other from the largest sizes on, each on top of the sums so far."""
    order, part = np.argsort(-sizes, kind="stable"), np.zeros(len(sizes), np.int64)
    sums = np.zeros(parts, np.int64) if base is None else base.astype(np.int64)
    for lo in range(0, len(sizes), run):
        mine = order[lo : lo + run]
        leaves = np.zeros((len(mine) + 1, parts), np.int64)
        leaves[0], leaves[1:, 0] = sums, sizes[mine]
        to, ends = difference(leaves if sums.any() else leaves[1:])
        at = to[0] if sums.any() else np.arange(parts)  # where the parts are in ends
        part[mine], sums = np.argsort(at)[to[-len(mine) :, 0]], ends[at]
    return part, sums


def lacking(sums: np.ndarray, rest: int) -> np.ndarray:
    """How much of the rest each part is to get, so that the least filled ones come to one level."""
    level = ((rest + np.cumsum(np.sort(sums))) / np.arange(1, len(sums) + 1)).min()
    return np.maximum(level - sums, 0.0)


def shard(docs: DataFrame, shards: int = SHARDS, extra: int = EXTRA) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document; size: UTF-8 bytes of the text plus extra."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + extra).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_text"))
    rows = scratch.save(rows.withColumn("_row", F.monotonically_increasing_id()))  # parts equal rows among chunks
    total = rows.count()
    groups = scratch.save(rows.groupBy("_text").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    count = groups.count()
    blocks, others, large, base = 1, groups, None, np.zeros(shards, np.int64)
    if count > BLOCK_GROUPS:
        large = groups.orderBy(F.col("bytes").desc(), "_text").limit(BLOCK_GROUPS).toArrow()  # 20,000 rows of 32 bytes
        part, base = partition(large.column("bytes").to_numpy(), shards)
        large = large.append_column("shard", pa.array(part, pa.int32()))
        least, key = large.column("bytes")[-1].as_py(), large.column("_text")[-1].as_py()
        others = groups.where((F.col("bytes") < least) | ((F.col("bytes") == least) & (F.col("_text") > F.lit(key))))
        blocks = -(-(count - BLOCK_GROUPS) // BLOCK_GROUPS)

    def differencing(base: np.ndarray, share: int | None):
        """Blocks on top of base; share: on top of what makes them give the parts' lacks in proportion, of so many bytes in all."""

        def differenced(block: pa.Table) -> pa.Table:
            keys = block.column("_text").to_pylist()
            order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)  # the same result in whatever order rows come
            sizes, turn, on = block.column("bytes").to_numpy()[order], np.arange(shards), base
            if share is not None:
                lack = lacking(base, share)
                on = np.rint((lack.max() - lack) * (sizes.sum() / share)).astype(np.int64)
                turn = np.random.default_rng(block.column("block")[0].as_py()).permutation(shards)  # blocks' remainders are not to meet in one shard
            part, _ = partition(sizes, shards, base=on[turn])
            return block.take(pa.array(order)).select(["_text", "bytes", "n"]).append_column("shard", pa.array(turn[part], pa.int32()))

        return differenced

    dealt = others.withColumn("block", F.pmod(F.xxhash64("_text"), F.lit(blocks)).cast("int"))
    placed, schema = [], "_text binary, bytes long, n long, shard int"
    if blocks > 1:
        rest = others.agg(F.sum("bytes")).first()[0]
        placed.append(scratch.save(dealt.where("block > 0").groupBy("block").applyInArrow(differencing(base, rest), schema)))
        for r in placed[0].groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():  # at most shards rows
            base[r["shard"]] += r["bytes"]
    placed.append(scratch.save(dealt.where("block = 0").groupBy("block").applyInArrow(differencing(base, None), schema)))
    if large is not None:
        placed.append(spark.createDataFrame(large.select(["_text", "bytes", "n", "shard"])))
    classes = reduce(DataFrame.unionByName, placed).select("_text", "n", "shard")
    chunks = max(LEAST_CHUNKS, total // CHUNK_ROWS)
    chunk = F.pmod(F.xxhash64("_row"), F.lit(chunks)).cast("int")
    found = scratch.save(attach(rows, classes, "_text", "n", total).withColumn("chunk", chunk))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    among = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size", "_text")
    slotted = found.withColumn("slot", F.row_number().over(among) - 1).join(base, ["shard", "chunk"])
    return slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("base")).cast("long").alias("slot"))

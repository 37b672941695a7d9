"""SimHash near-duplicates, by vantage-point trees.

``fingerprints`` sums the bits of every word shingle's XXH64 (and, for more than 64 bits, of mixes of it).
Equal fingerprints are one class.  A tree, whose depth follows the number of classes and which is built from a
sample of them, parts the classes by their Hamming distance from vantage points: near side up to a threshold,
far side beyond.  A pair within the radius can
lie on both sides only if its near one is within the radius of the boundary, so those near ones go to the
far side as well (the triangle bound); then each such pair meets in at least one shard.  A shard goes on
splitting by vantage points from its own midst, in memory, with the same bound, and compares what is left
by XOR and bit counts.  It returns for each class the least one it is joined to, never its pairs.  Where
no vantage point parts the rows, as with a radius near the spread of random distances, shards are tiled: each
two blocks of TILE_ROWS are one task's, which compares across and, on the diagonal, within.

``ratio`` (0: none) links only texts whose numbers of distinct shingles differ by no more than that factor, as
they do where the Jaccard similarity is ratio or more.  The radius that goes with such a similarity is near the spread
of random distances, so no vantage point would part anything with a boundary as wide.  The tree is then built with
the boundary that does part (``boundary``), and its shards compare all their pairs at the whole radius: up to SHARD_ROWS
classes are one shard, and every pair is compared; of more, each pair within the boundary meets by the
triangle bound.  Pairs beyond the boundary that the tree parts meet besides where two hashes that follow each other
among the KEYS + 1 smallest of their distinct shingles are the same: of similar texts most of these hashes are shared,
and two that follow each other nearly always.  The work then goes with the number of texts and the sizes of
their groups, not with the square of all texts.  A pair within
the radius is then held against a sketch of its shingle sets (the least hash in each of SLOTS ranges, a byte
of it), and is linked only if the share of equal slots does not speak against a Jaccard similarity of ratio.
That is a second pass, in the components of the first: only classes that have one within the radius move
their sketches.
The sketch is nearly exact for texts of fewer shingles than slots, as each slot then holds but one of them.

Defined results: null and empty texts have the fingerprint zero and link as any other; a shorter text than
a shingle is one shingle; classes whose least doc_id is the same are one node; rows without doc_id have a
fingerprint but no part in linking (component null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, bounded_batches
from .components import Forest, connected_components

WORDS, RADIUS, SEED = 3, 2, 42
#: Shingles that are hashed before their bits are summed.
RUN = 1 << 14
#: Slots of a sketch, standard deviations by which its estimate may fall short, pairs held against their sketches at once.
SLOTS, DOUBT, PAIRS = 1024, 2.5, 1 << 13
#: Pairs of neighbouring least hashes under which a text meets others.  Texts of a similarity of 0.8 share none with a chance of about 0.51 to the power of 18.
KEYS = 16
#: Standard deviations by which `distinct`'s radius stays below the distance of random fingerprints.
FAR = 6.5
#: Large shards up to which their sizes are broadcast (16 bytes each).
BROADCAST_SHARDS = 100_000
#: A slot that no hash has reached.
_NONE = np.uint64((1 << 64) - 1)
#: Sampled fingerprints for each leaf of the tree, and in all at most (8 MB, enough for a thousand million classes); classes of a
#: shard to aim at; of a block, beyond which a shard is tiled (of the tree's shards four times as many as they aim at); compared outright.
LEAF_SAMPLE, SAMPLE, SHARD_ROWS, TILE_ROWS, OUTRIGHT = 8, 1 << 20, 8192, 4096, 512


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of a whole text's word shingles, repeats included, in runs."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and blanks are 09-0D and 20
    if not parts:
        return
    data = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    begins, ends = (end - size)[: max(1, len(parts) - words + 1)].tolist(), (end[words - 1 :] if len(parts) >= words else end[-1:]).tolist()
    hash_ = xxhash.xxh64_intdigest
    for lo in range(0, len(begins), RUN):
        yield np.array([hash_(data[a:b], SEED) for a, b in zip(begins[lo : lo + RUN], ends[lo : lo + RUN])], np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits of a hash: itself, then finalised sums with an odd constant."""
    if not k:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def meeting_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set of hashes (sorted): each two that follow each other among the least ones; of fewer than two, the one, or none of a fixed value."""
    least = hashes[: KEYS + 1]
    if len(least) < 2:
        return np.r_[least, np.zeros(1 - len(least), np.uint64)].view(np.int64)
    return (mixed(least[:-1], 1) ^ mixed(least[1:], 2)).view(np.int64)


def fingerprint(text: str | None, words: int = WORDS, blocks: int = 1, slots: int = 0) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """SimHash of a whole text, as so many blocks of 64 bits, its number of shingles; with slots: of distinct ones, a sketch of their set (0: an empty slot), and its meeting keys."""
    ones, n, least, kinds = np.zeros((blocks, 64), np.int64), 0, np.full(slots, _NONE), []
    for h in shingle_hashes(text, words):
        n += len(h)
        if slots:
            kinds.append(np.unique(h))
            np.minimum.at(least, kinds[-1] % np.uint64(slots), kinds[-1] // np.uint64(slots))
        for k in range(blocks):
            ones[k] += np.unpackbits(mixed(h, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp, keys = np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0], np.zeros(0, np.int64)
    if slots:
        distinct = np.unique(np.concatenate(kinds)) if len(kinds) > 1 else kinds[0] if kinds else np.zeros(0, np.uint64)
        n, keys = len(distinct), meeting_keys(distinct)
    return fp, n, np.where(least == _NONE, 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8), keys


def fingerprints(docs: DataFrame, words: int = WORDS, blocks: int = 1, slots: int = 0) -> DataFrame:
    """(doc_id, fp binary: little-endian blocks of 64 bits, shingles, sketch, keys) of every document."""
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, counts, sketches, keys = zip(*[fingerprint(t, words, blocks, slots) for t in batch.column(1).to_pylist()]) if len(batch) else ((),) * 4
            columns = [pa.array([x.tobytes() for x in fps], pa.binary()), pa.array(counts, pa.int64()), pa.array([x.tobytes() for x in sketches], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "fp", "shingles", "sketch", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(hashed, "doc_id long, fp binary, shingles long, sketch binary, keys array<long>")


def blocks_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fingerprints of a binary column as rows of 64-bit blocks."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<u8").reshape(len(values), -1) if values else np.zeros((0, 1), np.uint64)


def distance(x: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ vantage).sum(-1, dtype=np.int64)


class VantageTree:
    """Vantage points and thresholds of a binary tree, in arrays by node; leaves are numbered as they are met."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int):
        self.radius, self.leaves, nodes = radius, 0, []
        root = self._grow(np.unique(sample, axis=0), depth, nodes)
        #: by node: vantage point, threshold, and the nodes (or, below 0, the leaf -1 - k) of the near and the far side
        self.vantage = np.array([n[0] for n in nodes], np.uint64).reshape(len(nodes), sample.shape[1])
        self.limit, self.near, self.far = (np.array([n[k] for n in nodes], np.int32) for k in (1, 2, 3))
        self.root = root

    def _grow(self, x: np.ndarray, depth: int, nodes: list) -> int:
        if depth <= 0 or len(x) < 4 or (best := split(x, self.radius)) is None:
            self.leaves += 1
            return -self.leaves
        vantage, limit = best
        near, at = distance(x, vantage) <= limit, len(nodes)
        nodes.append(None)
        nodes[at] = (vantage, limit, self._grow(x[near], depth - 1, nodes), self._grow(x[~near], depth - 1, nodes))
        return at

    def leaf_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x, leaves): each fingerprint's shards."""
        places, leaves, at, node = [], [], np.arange(len(x)), np.full(len(x), self.root)
        while len(at):  # a level at a time
            ended = node < 0
            places.append(at[ended])
            leaves.append((-1 - node[ended]).astype(np.int32))
            at, node = at[~ended], node[~ended]
            d, limit = distance(x[at], self.vantage[node]), self.limit[node]
            near, far = d <= limit, d > limit - self.radius
            at, node = np.concatenate([at[near], at[far]]), np.concatenate([self.near[node[near]], self.far[node[far]]])
        return np.concatenate([*places, np.zeros(0, np.int64)]), np.concatenate([*leaves, np.zeros(0, np.int32)])


def split(x: np.ndarray, radius: int, tries: int = 6) -> tuple[np.ndarray, int] | None:
    """The vantage point (of some of x) and threshold whose two sides, with the boundary on both, have the fewest pairs; None if none parts x."""
    best, least = None, 0.8 * len(x) ** 2
    for k in range(tries):
        vantage = x[(k * 2 + 1) * len(x) // (2 * tries)]
        near = np.cumsum(np.bincount(distance(x, vantage), minlength=64 * x.shape[1] + 1)).astype(float)
        far = len(x) - np.r_[np.zeros(radius), near[: len(near) - radius]]  # those beyond the threshold less the radius
        cost = near**2 + far**2
        limit = int(cost.argmin())
        if cost[limit] < least:
            best, least = (vantage, limit), cost[limit]
    return best


def alike(a: np.ndarray, b: np.ndarray, similarity: float, shingles: np.ndarray | None = None) -> np.ndarray:
    """Whether the sketches of pairs leave a Jaccard similarity possible; shingles: sums of the two numbers of distinct ones."""
    used, same = ((a | b) != 0).sum(1), ((a == b) & (a != 0)).sum(1)
    hidden = 1.0
    if shingles is not None:  # the used slots are drawn from the union without putting back: none is hidden, and there is no doubt, if it has no more members
        union = shingles / (1 + similarity)
        hidden = np.clip((union - used) / np.maximum(union - 1, 1), 0, 1)
    return same >= used * similarity - DOUBT * np.sqrt(used * similarity * (1 - similarity) * hidden) - 1e-9


def join_near(x: np.ndarray, radius: int, shingles: np.ndarray | None = None, ratio: float = 0.0, sketch: np.ndarray | None = None, side: np.ndarray | None = None) -> Forest:
    """Joins all pairs of fingerprints within the radius and ratio (and with sketches alike); side: only pairs of which one is marked are asked for."""
    forest, todo = Forest(len(x)), [np.arange(len(x))]
    while todo:
        at = todo.pop()
        got = split(x[at], radius) if len(at) > OUTRIGHT else None
        if got is None:
            few = shingles if ratio else None
            if few is not None:
                at = at[np.argsort(few[at], kind="stable")]
            a, b = (at, at) if side is None else (at[side[at]], at[~side[at]])
            _outright(forest, x, a, b, radius, few, ratio, sketch)
            continue
        d = distance(x[at], got[0])
        todo += [at[d <= got[1]], at[d > got[1] - radius]]
    return forest


def _outright(forest: Forest, x: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, shingles: np.ndarray | None, ratio: float, sketch: np.ndarray | None) -> None:
    """Joins what is near of left and right (or within left, if right is the same); both in the order of shingles, if these are given."""
    for lo in range(0, len(left), OUTRIGHT):
        a = left[lo : lo + OUTRIGHT]
        first, last = lo if right is left else 0, len(right)
        if shingles is not None:  # those of right that the ratio leaves for any of a
            counts = shingles[right]
            first = max(first, int(np.searchsorted(counts, ratio * shingles[a[0]] * (1 - 1e-12))))
            last = int(np.searchsorted(counts, shingles[a[-1]] / ratio * (1 + 1e-12), "right"))
        for hi in range(first, last, OUTRIGHT):
            b = right[hi : min(hi + OUTRIGHT, last)]
            d = np.bitwise_count(x[a, None, 0] ^ x[b, 0]).astype(np.uint16)
            for k in range(1, x.shape[1]):
                d += np.bitwise_count(x[a, None, k] ^ x[b, k])
            r, c = np.nonzero(d <= radius)
            if shingles is not None:
                few, many = shingles[a[r]], shingles[b[c]]
                close = np.minimum(few, many) >= ratio * np.maximum(few, many)
                r, c = r[close], c[close]
            if sketch is None:
                forest.join(a[r], b[c])
                continue
            for k in range(0, len(r), PAIRS):
                i, j = a[r[k : k + PAIRS]], b[c[k : k + PAIRS]]
                apart = forest.label[i] != forest.label[j]
                i, j = i[apart], j[apart]
                both = alike(sketch[i], sketch[j], ratio, None if shingles is None else shingles[i] + shingles[j])
                forest.join(i[both], j[both])


def boundary(radius: int, blocks: int, ratio: float) -> int:
    """Bits of the tree's boundary on either side: the radius, so that the tree loses no pair, or with a ratio at most what parts random fingerprints as well as RADIUS does those of one block."""
    return min(radius, int(RADIUS * np.sqrt(blocks))) if ratio else radius


def dealt(classes: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Classes (fp, ...) with leaf: a row for each of their shards of a vantage-point tree."""
    depth = max(0, int(np.ceil(np.log2(max(1, classes.count() / shard_rows)))))
    sample = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, LEAF_SAMPLE << depth)).toArrow() if depth else None
    tree = VantageTree(blocks_of(sample.column("fp")) if depth else np.zeros((0, 1), np.uint64), depth, radius)
    place, names = classes.columns.index("fp"), [*classes.columns, "leaf"]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, leaf = tree.leaf_of(blocks_of(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(leaf, pa.int64())], names=names)

    if not tree.leaves > 1:
        return classes.withColumn("leaf", F.lit(0).cast("long"))
    return classes.mapInArrow(leaves, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", leaf long")


def met(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Classes (key, fp, shingles, rep, keys) with leaf: a row for each of their meeting keys that another class has too."""
    thin = classes.select("key", F.explode("keys").alias("leaf"))
    live = scratch.save(thin.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("live", F.lit(True)))
    there = attach(thin, live, "leaf", "_n", classes.agg(F.sum(F.size("keys"))).first()[0] or 0).where("live").select("key", "leaf")
    return there.join(classes.drop("keys", "n"), "key")


def near_edges(shards: DataFrame, radius: int, ratio: float = 0.0, tile_rows: int = TILE_ROWS, pack_rows: int | None = None) -> DataFrame:
    """(a, b) edges between the reps of classes (leaf, fp, rep, shingles[, sketch]) whose components are those of all pairs of one leaf
    within the radius and ratio, with sketches alike if there are any.  pack_rows: rows of small shards to take together, as many as a tile's by default."""
    sketched = "sketch" in shards.columns
    shards = shards.select("leaf", "fp", "rep", "shingles", *(["sketch"] if sketched else []))
    sizes = shards.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile_rows)
    sizes = sizes.withColumn("blocks", F.ceil(F.col("_n") / F.lit(tile_rows)).cast("int"))
    packs = max(1, shards.count() // (pack_rows or tile_rows))
    # sizes: a row for each shard of more than tile_rows rows, whose tiles are a task's each; of smaller ones many are taken together
    if sizes.count() <= BROADCAST_SHARDS:
        tiled = shards.join(F.broadcast(sizes.drop("_n")), "leaf", "left")
    else:
        tiled = attach(shards, sizes, "leaf", "_n", shards.count())
    tiled = tiled.withColumn("large", F.col("blocks").isNotNull()).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    tiled = tiled.withColumn("pack", F.when(F.col("large"), F.col("leaf")).otherwise(F.pmod(F.xxhash64("leaf"), F.lit(packs))))
    tiled = tiled.withColumn("block", F.pmod(F.xxhash64("fp", "shingles", "rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("first", F.col("block") == F.col("i")).drop("block", "other", "blocks")

    def joined(shard: pa.Table) -> pa.Table:
        leaf = shard.column("leaf").to_numpy()
        shard = shard.take(pa.array(np.lexsort((shard.column("rep").to_numpy(), leaf))))
        leaf, rep, count = np.sort(leaf), shard.column("rep").to_numpy(), shard.column("shingles").to_numpy()
        x, first = blocks_of(shard.column("fp")), shard.column("first").to_numpy()
        across = shard.column("i")[0] != shard.column("j")[0]
        sketch = np.frombuffer(b"".join(shard.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1) if sketched else None
        forest, begin = Forest(len(rep)), np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        size = np.diff(np.r_[begin, len(rep)])
        if not across:  # most shards are of two: all of these at once
            i = begin[size == 2]
            near = distance(x[i], x[i + 1]) <= radius
            if ratio:
                near &= np.minimum(count[i], count[i + 1]) >= ratio * np.maximum(count[i], count[i + 1])
            i = i[near]
            if sketched:
                i = i[alike(sketch[i], sketch[i + 1], ratio, count[i] + count[i + 1])]
            forest.join(i, i + 1)
            begin, size = begin[size > 2], size[size > 2]
        for lo, hi in zip(begin.tolist(), (begin + size).tolist()):
            at = slice(lo, hi)
            label = join_near(x[at], radius, count[at], ratio, sketch[at] if sketched else None, first[at] if across else None).label
            forest.join(np.arange(lo, hi), lo + label)
        hub = rep[forest.label]
        apart = hub != rep
        return pa.table({"a": rep[apart], "b": hub[apart]})

    return tiled.groupBy("large", "pack", "i", "j").applyInArrow(joined, "a long, b long")


def link(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, blocks: int = 1, ratio: float = 0.0) -> DataFrame:
    """(doc_id, fp, component_id) of every document: components of fingerprints within the radius (and ratio)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    key = F.concat("fp", "sketch", F.concat_ws(",", F.col("shingles").cast("string"), F.col("keys").cast("array<string>")).cast("binary")) if ratio else F.col("fp")
    rows = fingerprints(docs, words, blocks, SLOTS if ratio else 0).withColumn("key", F.unhex(F.md5(key)))
    rows = scratch.save(rows if ratio else rows.select("doc_id", "fp", "key"))
    # rows of one key have one fp and, with a ratio, one number of shingles and the same meeting keys
    of = [F.col("shingles"), F.col("keys")] if ratio else [F.lit(0).cast("long").alias("shingles")]
    classes = scratch.save(rows.where(F.col("doc_id").isNotNull()).groupBy("key", "fp", *of).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep")))
    reach = boundary(radius, blocks, ratio)
    edges = near_edges(scratch.save(dealt(classes.select("fp", "rep", "shingles"), reach, SHARD_ROWS)), radius, ratio, 4 * SHARD_ROWS, TILE_ROWS if ratio else None)  # with a ratio a shard is work for a task: all its pairs
    if reach < radius and classes.count() > SHARD_ROWS:  # what the tree may have parted
        edges = edges.union(near_edges(scratch.save(met(classes, scratch)), radius, ratio))
    components = connected_components(edges, scratch)
    if ratio:
        near = classes.join(components, F.col("rep") == F.col("node")).select("key", "fp", "shingles", "rep", F.col("component").alias("leaf"))
        sketches = rows.select("key", "sketch").distinct()  # copies fall together before they are shuffled
        components = connected_components(near_edges(scratch.save(near.join(sketches, "key")), radius, ratio), scratch)
    known = classes.join(components, F.col("rep") == F.col("node"), "left").select("key", "n", F.coalesce("component", "rep").alias("component_id"))
    found = attach(rows.select("doc_id", "fp", "key"), known, "key", "n", rows.count())
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def distinct(docs: DataFrame, words: int = 5, similarity: float = 0.8, blocks: int = 4) -> DataFrame:
    """The documents, with all their columns, without those that resemble one with a smaller doc_id, directly or through others.

    Two texts resemble each other if the ratio of their numbers of distinct shingles is at least the similarity,
    and the Jaccard similarity that their sketches estimate does not fall short of it by more than DOUBT standard
    deviations.  The meeting keys and fingerprints only choose the pairs whose sketches are held against each other: their radius is
    not that of the similarity, about which close copies scatter, but as wide as random pairs allow.  Rows without
    doc_id stay; rows of one doc_id stay or go together.
    """
    bits = 64 * blocks
    radius = int(max(np.floor(np.arccos(similarity) / np.pi * bits), np.floor(bits / 2 - FAR * np.sqrt(bits) / 2)))
    gone = link(docs, words, radius, blocks, similarity).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    gone = Scratch(docs.sparkSession, "copies").save(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")  # docs may have a column of that name

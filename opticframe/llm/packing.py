"""Best-fit packing of token pieces into sequences, by exact-complement hashing.

How pieces combine depends on nothing but their lengths, and there are at most ``capacity`` lengths.
So the executors count pieces by length, the driver packs those counts (at most ``capacity`` numbers,
however large the corpus), and each piece finds its place from its rank among the pieces of its length:

1. ``pieces``: token ids, cut at the capacity (one pass over the texts, no shuffle);
2. ``pack_counts``: index the sums of one, two and three lengths; for the longest open length take
   combinations that fill its gap exactly, as often as their counts allow; place the rest by best fit; of
   the plans with up to three, two, one and no such lengths the one with the fewest sequences holds;
3. ``pack``: rank every piece within (length, chunk of documents), add what the chunks before hold,
   and look the rank up in the list of places.

Defined results: a null or empty text is one piece that holds the end id only; a longer text is cut
into full pieces, whose last may be shorter; equal rows (also of one doc_id, or without one) are packed
each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches
from .tokens import encoder, vocabulary

CAPACITY = 2048
#: Ranks are taken within (length, chunk); pieces are dealt to chunks of about so many by a hash, so that no length makes a large group.
CHUNK_ROWS, LEAST_CHUNKS = 100_000, 96


@dataclass(frozen=True)
class Places:
    """Places of pieces by rank: the piece of ``length`` and a rank in [rank, rank + times) goes to sequence
    ``sequence + (its rank - rank)`` at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> Places:
    """Packs counts of lengths (1 to capacity) into few sequences.

    Combinations of up to three lengths that fill gaps can use up the short pieces that the rest needs, so it is also tried
    with up to two, with one, and with none, until the least possible number of sequences is reached; the fewest win.
    """
    for length in counts:
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
    least, best = -(-sum(length * n for length, n in counts.items()) // capacity), None
    for most in (3, 2, 1, 0):
        groups = _combine(counts, capacity, most)
        if best is None or sum(n for _, n in groups) < sum(n for _, n in best):
            best = groups
        if sum(n for _, n in best) == least:
            break
    return _places(best, capacity)


def _combine(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences): exact fills of gaps by up to `most` lengths, then best fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    groups: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...]) -> bool:
        times = min(left[x] // k for x, k in Counter(combo).items())
        if times:
            groups.append((combo, int(times)))
            for x in combo:
                left[x] -= times
        return bool(times)

    take((capacity,))
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if left[a] and most:
            take((a, gap))
        if left[a] and most > 1:
            _pairs(take, left, a, gap)
        if left[a] and most > 2:
            _triples(take, left, a, gap)
    return groups + _best_fit(left, capacity)


def _pairs(take, left: np.ndarray, a: int, gap: int, first: tuple[int, ...] = ()) -> None:
    """Combinations of two lengths that fill the gap beside (a, *first), the longest length first."""
    while left[a]:
        x = np.arange((gap + 1) // 2, gap)
        x = x[(left[x] > 0) & (left[gap - x] > 0)][::-1]
        if not any(take((a, *first, int(b), gap - int(b))) for b in x) or not x.size:
            return


def _triples(take, left: np.ndarray, a: int, gap: int) -> None:
    """Combinations of three lengths that fill the gap beside a; sums of two are looked up, not searched."""
    x = np.flatnonzero(left[: max(gap - 1, 0)] > 0)
    x = x[(x >= (gap + 2) // 3)][::-1]
    small = np.flatnonzero(left[:gap] > 0)
    if not x.size or not small.size:
        return
    sums = np.zeros(gap + 1, bool)  # the index of pair sums
    for s in small:
        t = s + small
        sums[t[t <= gap]] = True
    for b in x:
        if not left[a]:
            return
        if left[b] and sums[gap - b]:
            _pairs(take, left, a, gap - int(b), (int(b),))


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the open sequence with the least room that suffices; equal sequences are kept as one with a count."""
    room: dict[int, list[list]] = {}  # by room: [lengths, how many]
    full: list[tuple[tuple[int, ...], int]] = []
    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            gap = min((g for g in room if g >= a), default=None)
            if gap is None:
                each = min(capacity // a, n)
                times = n // each
                room.setdefault(capacity - a * each, []).append([(a,) * each, times])
                n -= each * times
                continue
            lengths, times = room[gap].pop()
            if not room[gap]:
                del room[gap]
            each = min(gap // a, n)
            used = min(times, n // each)
            if used < times:
                room.setdefault(gap, []).append([lengths, times - used])
            room.setdefault(gap - a * each, []).append([lengths + (a,) * each, used])
            n -= used * each
    left[:] = 0
    for group in room.values():
        full += [(lengths, times) for lengths, times in group]
    return full


def _places(groups: list[tuple[tuple[int, ...], int]], capacity: int) -> Places:
    rank, rows, base = np.zeros(capacity + 1, np.int64), [], 0
    for lengths, times in groups:
        offset = 0
        for x in lengths:
            rows.append((x, rank[x], base, offset))
            rank[x] += times
            offset += x
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Places(*table.T.copy(), sequences=base)


def pieces(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of documents; ids: little-endian unsigned 32-bit, null unless kept."""
    bounded_batches(docs.sparkSession)
    path = vocab or vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, at = enc.encode(batch.column(1), end_id)
            many = -(-np.diff(at) // capacity)  # pieces of each document
            doc = np.repeat(np.arange(len(many)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            begin = at[doc] + piece * capacity
            length = np.minimum(at[doc + 1] - begin, capacity)
            data = memoryview(ids.astype("<u4")).cast("B")
            parts = [data[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
            kept = pa.array([bytes(x) for x in parts], pa.binary()) if keep_ids else pa.nulls(len(doc), pa.binary())
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()), kept]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of all documents, in as few sequences as the method finds."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = pieces(docs, vocab, capacity, end_id, keep_ids)
    cut = scratch.save((cut if keep_ids else cut.drop("ids")).withColumn("row", F.monotonically_increasing_id()))  # parts equal rows among chunks
    chunks = max(LEAST_CHUNKS, cut.count() // CHUNK_ROWS)
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).drop("row")
    counted = scratch.save(cut.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = pack_counts(counts, capacity)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    among = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("rank", F.row_number().over(among) - 1).join(base, ["length", "chunk"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "chunk")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if keep_ids else [])]
    shift = 40  # ranks stay under 2^40, lengths under 2^23
    starts = (places.length << shift) + places.rank

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {n: batch.column(k) for k, n in enumerate(names)}
            rank = got.pop("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(starts, (got["length"].to_numpy(zero_copy_only=False) << shift) + rank, "right") - 1
            got["sequence_id"] = pa.array(places.sequence[at] + rank - places.rank[at], pa.int64())
            got["offset"] = pa.array(places.offset[at], pa.int64())
            yield pa.RecordBatch.from_pydict(got)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names).mapInArrow(locate, schema)

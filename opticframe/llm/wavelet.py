"""Token-id files: one wavelet matrix per shard segment, with rank and select.

``write`` deals documents to shards by ranges of doc_id, encodes them there and writes, through Spark's
Parquet committer, one row per segment whose ``payload`` is a wavelet-matrix file (``WaveletMatrix.to_bytes``):
bit planes from the highest bit down, each stably parted into its zeros and its ones, deflated in blocks
with the count of ones before each, beside the directory of the segment's documents.  Any store that Spark
writes holds them, a task that is run again replaces its own output, and a payload saved on its own is a
file that ``from_bytes`` reads.  A segment ends after the document that reaches SEGMENT_TOKENS, which bounds
memory.  ``documents`` reads whole files back; ``occurrences`` looks a token up by rank and select, and
inflates the blocks on its way only.

Defined results: null and empty texts give the end id only; rows without doc_id come first; rows of one
doc_id, or of none, are ordered by a hash of their text, and may be parted among shards; an empty table gives
no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches
from .tokens import encoder, vocabulary

SEGMENT_TOKENS = 1 << 20
#: Bits of a block: each is deflated by itself, beside a stored count of the ones before it.
BLOCK = 1 << 15
#: Inflated blocks that a matrix keeps at hand.
AT_HAND = 256
MAGIC = b"WMX2"


class WaveletMatrix:
    """A sequence of unsigned integers as bit planes: access, rank and select take one step a plane.

    It works on the file's bytes: planes lie there in deflated blocks, and a step inflates the block that it
    looks into and no other.  ``inflated`` counts them.
    """

    def __init__(self, n: int, zeros: np.ndarray, ones: np.ndarray, sizes: np.ndarray, data: bytes):
        #: zeros of each plane; ones before each block, and in all, of each plane; bytes of each block, plane by plane, and the blocks
        self.n, self.zeros, self.ones, self.sizes, self.data = n, zeros, ones, sizes, data
        self.bits, self.blocks = len(zeros), -(-n // BLOCK)
        self.begin = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.inflated, self._hand = 0, {}

    @classmethod
    def build(cls, values: np.ndarray, bits: int | None = None) -> "WaveletMatrix":
        values = np.ascontiguousarray(values)
        bits = bits or max(1, int(values.max(initial=0)).bit_length())
        blocks = -(-values.size // BLOCK)
        zeros, ones, sizes, parts = np.zeros(bits, np.int64), np.zeros((bits, blocks + 1), np.int64), np.zeros(bits * blocks, np.uint32), []
        for level in range(bits):
            bit = (values & values.dtype.type(1 << bits - 1 - level)) != 0
            low = np.flatnonzero(~bit)  # taking by places is far faster than by a mask
            zeros[level] = low.size
            ones[level, 1:] = np.cumsum(np.add.reduceat(bit, np.arange(0, bit.size, BLOCK), dtype=np.int64)) if blocks else 0
            plane = np.packbits(bit, bitorder="little").tobytes()
            for k in range(blocks):
                raw = plane[k * BLOCK // 8 : (k + 1) * BLOCK // 8]
                part = zlib.compress(raw, 1)
                parts.append(part if len(part) < len(raw) else raw)  # a block as long as its bits is stored as it is
                sizes[level * blocks + k] = len(parts[-1])
            values = values.take(np.concatenate([low, np.flatnonzero(bit)]))
        return cls(values.size, zeros, ones, sizes, b"".join(parts))

    def _raw(self, level: int, block: int) -> bytes:
        k = level * self.blocks + block
        part = self.data[self.begin[k] : self.begin[k + 1]]
        self.inflated += 1
        return part if len(part) == -(-min(BLOCK, self.n - block * BLOCK) // 8) else zlib.decompress(part)

    def values(self, dtype=np.uint32) -> np.ndarray:
        """The whole sequence: the planes are put back from the lowest bit up."""
        out = np.zeros(self.n, dtype)
        for level in range(self.bits - 1, -1, -1):
            plane = np.frombuffer(b"".join([self._raw(level, k) for k in range(self.blocks)]), np.uint8)
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            back = np.empty_like(out)
            back[np.flatnonzero(~ones)] = out[: self.zeros[level]]
            back[np.flatnonzero(ones)] = out[self.zeros[level] :] | dtype(1 << self.bits - 1 - level)
            out = back
        return out

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a block, and the ones in it before each byte."""
        got = self._hand.pop((level, block), None)
        if got is None:
            raw = np.frombuffer(self._raw(level, block) + b"\0", np.uint8)
            got = raw, np.concatenate([[0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)])
        self._hand[level, block] = got  # the latest at the end
        if len(self._hand) > AT_HAND:
            del self._hand[next(iter(self._hand))]
        return got

    def _look(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit at each place, ones of the plane before it); a place may be the end."""
        at = np.asarray(at, np.int64)
        bit, ones = np.zeros(at.size, np.int64), np.full(at.size, self.ones[level, -1])
        for block in np.unique(at[at < self.n] // BLOCK).tolist():
            here = np.flatnonzero((at // BLOCK == block) & (at < self.n))
            raw, before = self._block(level, block)
            byte, rest = np.divmod(at[here] - block * BLOCK, 8)
            bit[here] = raw[byte] >> rest & 1
            ones[here] = self.ones[level, block] + before[byte] + np.bitwise_count(raw[byte] & ((1 << rest) - 1))
        return bit, ones

    def access(self, at) -> np.ndarray:
        """Values at places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if at.size and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the sequence")
        out = np.zeros(at.size, np.int64)
        for level in range(self.bits):
            bit, ones = self._look(level, at)
            out = (out << 1) | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def rank(self, value: int, end: int) -> int:
        """Occurrences of value among the first ``end`` places."""
        lo, hi = self._range(value, end)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _range(self, value: int, end: int) -> tuple[int, int]:
        lo, hi = 0, min(max(end, 0), self.n)
        if value < 0 or value >> self.bits:
            return 0, 0
        for level in range(self.bits):
            if lo == hi:
                return 0, 0
            a, b = map(int, self._look(level, np.array([lo, hi]))[1])
            one = value >> self.bits - 1 - level & 1
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if one else (lo - a, hi - b)
        return lo, hi

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of value; -1 if there are fewer."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> self.bits - 1 - level & 1
            nth = at - int(self.zeros[level]) if one else at
            before = self.ones[level] if one else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.n) - self.ones[level]
            block = int(np.searchsorted(before, nth, "right")) - 1
            bits = np.unpackbits(self._block(level, block)[0], count=min(BLOCK, self.n - block * BLOCK), bitorder="little")
            at = block * BLOCK + int(np.flatnonzero(bits == one)[nth - int(before[block])])
        return at

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QH", self.n, self.bits)
        return head + self.zeros.astype("<u8").tobytes() + self.ones.astype("<u8").tobytes() + self.sizes.astype("<u4").tobytes() + self.data

    @classmethod
    def from_bytes(cls, blob: bytes) -> "WaveletMatrix":
        """The matrix in a file's bytes; nothing is inflated yet."""
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        n, bits = struct.unpack_from("<QH", blob, 4)
        blocks, at, got = -(-n // BLOCK), 14, []
        for kind, count in (("<u8", bits), ("<u8", bits * (blocks + 1)), ("<u4", bits * blocks)):
            got.append(np.frombuffer(blob, kind, count, at))
            at += got[-1].nbytes
        return cls(n, got[0].astype(np.int64), got[1].astype(np.int64).reshape(bits, blocks + 1), got[2], blob[at:])


SEGMENTS = "shard int, segment int, start long, n_docs long, n_tokens long, doc_ids binary, doc_ends binary, no_id int, payload binary"


def write(docs: DataFrame, vocab: str | None = None, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Encodes documents and writes their segments (see SEGMENTS) below path, in ascending doc_id order; returns them as read back."""
    spark = docs.sparkSession
    bounded_batches(spark)
    vocab = vocab or vocabulary()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, number, before = encoder(vocab), 0, 0, 0
        doc_ids: list[pa.Array] = []  # of the segment at hand, as are the following
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            nonlocal number, before
            values, ids = np.concatenate(parts), pa.concat_arrays(doc_ids)
            narrow = values.astype(np.uint16) if values.max(initial=0) < 1 << 16 else values
            row = {
                "shard": shard, "segment": number, "start": before, "n_docs": len(ids), "n_tokens": values.size,
                "doc_ids": zlib.compress(ids.fill_null(0).to_numpy().astype("<i8").tobytes(), 1),
                "doc_ends": zlib.compress(np.cumsum(np.concatenate(sizes)).astype("<i8").tobytes(), 1),
                "no_id": ids.null_count, "payload": WaveletMatrix.build(narrow).to_bytes(),
            }
            number, before = number + 1, before + values.size
            for x in (doc_ids, parts, sizes):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_ends", pa.binary()), ("no_id", pa.int32()), ("payload", pa.binary())]))

        size = 0
        for batch in batches:
            ids, at = enc.encode(batch.column(1), end_id)
            if len(batch):
                shard = batch.column(2)[0].as_py()
            lo = 0
            while lo < len(batch):  # up to the document that reaches SEGMENT_TOKENS
                hi = min(int(np.searchsorted(at, at[lo] + SEGMENT_TOKENS - size)), len(batch))
                doc_ids.append(batch.column(0)[lo:hi])
                parts.append(ids[at[lo] : at[hi]])
                sizes.append(np.diff(at[lo : hi + 1]))
                size, lo = size + int(at[hi] - at[lo]), hi
                if size >= SEGMENT_TOKENS:
                    yield done()
                    size = 0
        if parts:
            yield done()

    # the row's number parts even equal rows of one doc_id, which would else be one partition however many they are
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    order = ["doc_id", "_hash", "_row"]
    sorted_docs = given.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = sorted_docs.withColumn("shard", F.spark_partition_id()).mapInArrow(segment, SEGMENTS)
    if path is None:
        return Scratch(spark, "wavelet").save(made)
    made.write.mode("overwrite").parquet(path)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def documents(segments: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) read back from segments; start: ids of all documents before, ids as uint32."""
    at, starts = 0, {}  # one number a shard; a segment's row holds where it begins in its shard
    for r in segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        starts[r["shard"]] = at
        at += r["n"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if ids else [])])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = memoryview(WaveletMatrix.from_bytes(row["payload"]).values().astype("<u4").tobytes())
                doc_ids = np.frombuffer(zlib.decompress(row["doc_ids"]), "<i8").tolist()
                doc_ids[: row["no_id"]] = [None] * row["no_id"]
                ends = np.frombuffer(zlib.decompress(row["doc_ends"]), "<i8")
                begins = np.concatenate([[0], ends[:-1]])
                parts = [data[a * 4 : b * 4] for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(begins + row["start"] + starts[row["shard"]], pa.int64()), pa.array(ends - begins, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                if ids:
                    columns.append(pa.array([x.tobytes() for x in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return segments.select("shard", "start", "doc_ids", "doc_ends", "no_id", "payload").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else ""))


def occurrences(segments: DataFrame, token: int) -> DataFrame:
    """(shard, segment, n, first) of every segment: how often a token occurs in it, and its first place there (-1: none)."""
    bounded_batches(segments.sparkSession)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [WaveletMatrix.from_bytes(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w.count(token) for w in files], pa.int64()), pa.array([w.select(token, 0) for w in files], pa.int64())], names=["shard", "segment", "n", "first"])

    return segments.select("shard", "segment", "payload").mapInArrow(looked_up, "shard int, segment int, n long, first long")

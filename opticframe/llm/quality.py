"""Quality classifier: histogram gradient-boosted trees over document statistics.

``fit`` learns from at most TRAIN_ROWS labelled documents (chosen by a hash of their id), on quantile
histograms of the statistics in ``FEATURES``.  The trees are complete and lie flat in arrays, so that a
batch of documents walks all trees at once in numpy.  ``score`` runs over whole texts, batch by batch.

Defined results: null and empty texts have all-zero statistics and get the score the trees give these;
rows without doc_id are scored, never learned from; rows with a null label are not learned from; rows of
one doc_id are learned from and scored one by one; without labelled rows, or with one class only, every
score is the share of label 1 (0.5 without rows); an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc32_of

#: At most so many labelled documents are learned from.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "blanks", "stops", "symbols", "bangs", "pipes", "brackets", "high_bytes",
    "byte_entropy", "distinct_words", "top_word", "distinct_pairs", "lines", "line_bytes", "distinct_lines", "top_line_bytes", "words_per_stop", "long_words", "short_words",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_LOWER, _UPPER, _DIGIT = (_class(bytes(range(ord(a), ord(b) + 1))) for a, b in ("az", "AZ", "09"))
_HIGH = np.r_[np.zeros(128), np.ones(128)]
_CLASSES = np.stack([_LOWER + _UPPER + _HIGH, _UPPER, _DIGIT, _class(b" \t\n\r"), _class(b".,;:?"), _class(b"#$%&*+=@^_~\\/"), _class(b"!"), _class(b"|"), _class(b"<>{}[]()"), _HIGH], 1)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text, by FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(len(FEATURES))
    n, w = len(data), len(words)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    shares = hist @ _CLASSES / n
    p = hist[hist > 0] / n
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / (w - 1) if w > 1 else 1.0
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    sizes = np.fromiter(map(len, words), np.int64, w)
    stops = hist[ord(".")] + hist[ord("?")] + hist[ord("!")]
    shares[1] = shares[1] / max(shares[0], 1e-9)
    return np.array([
        np.log1p(n), np.log1p(w), sizes.mean(), *shares, -(p * np.log2(p)).sum(), len(counts) / w, max(counts.values()) / w, pairs,
        np.log1p(len(lines)), np.log1p(n / len(lines)), len(line_counts) / len(lines), max(len(x) * k for x, k in line_counts.items()) / n,
        np.log1p(w / (stops + 1)), (sizes > 20).mean(), (sizes < 3).mean(),
    ])


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth, flat: node k of tree t has the children 2k+1 and 2k+2; the leaves follow the inner nodes."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): right if the statistic is larger
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        trees, inner = self.feature.shape
        depth, t = (inner + 1).bit_length() - 1, np.arange(trees)
        at, rows = np.zeros((len(x), trees), np.int64), np.arange(len(x))[:, None]
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
        raw = self.base + self.leaf[t, at - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, leaf_rows: float = 20, l2: float = 1.0) -> Trees:
    """Fits trees to 0/1 labels: Newton steps on the logistic loss over histograms of binned statistics."""
    n, d = x.shape
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    if n == 0 or y.min() == y.max():
        share = float(y.mean()) if n else 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Trees(np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, (1 << depth) - 1)), np.zeros((0, 1 << depth)), float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # > cut k means bin > k
    base, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    raw = np.full(n, base)
    offset = np.arange(d) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, at = p - y, np.maximum(p * (1 - p), 1e-6), np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            flat = ((at - first) * (d * bins))[:, None] + offset + binned
            G, H = (np.bincount(flat.ravel(), np.repeat(v, d), nodes * d * bins).reshape(nodes, d, bins).cumsum(2) for v in (g, h))
            N = np.bincount(flat.ravel(), minlength=nodes * d * bins).reshape(nodes, d, bins).cumsum(2)
            g_all, h_all, n_all = G[:, :, -1:], H[:, :, -1:], N[:, :, -1:]
            gain = G**2 / (H + l2) + (g_all - G) ** 2 / (h_all - H + l2) - g_all**2 / (h_all + l2)
            gain = np.where((N >= leaf_rows) & (n_all - N >= leaf_rows), gain, 0)
            best = gain.reshape(nodes, -1).argmax(1)
            split = np.take_along_axis(gain.reshape(nodes, -1), best[:, None], 1)[:, 0] > 1e-6
            f, b = best // bins, best % bins
            for k in np.flatnonzero(split):
                feature[t, first + k], cut[t, first + k] = f[k], cuts[f[k]][b[k]]
            here = at - first
            at = 2 * at + 1 + (split[here] & (binned[np.arange(n), f[here]] > b[here]))
        G, H = (np.bincount(at - inner, v, inner + 1) for v in (g, h))
        leaf[t] = -rate * G / (H + l2)
        raw += leaf[t, at - inner]
    return Trees(feature, cut, leaf, base)


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from: the CRC-32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(crc32_of(doc_id) % 4 == 2, F.lit(False))


def _measure(docs: DataFrame, keep: list[str], types: str, trees: Trees | None) -> DataFrame:
    """keep columns, and the statistics of the text (or what the trees make of them)."""
    bounded_batches(docs.sparkSession)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            value = pa.array(list(x), pa.list_(pa.float64())) if trees is None else pa.array(trees.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], value], names=[*keep, "value"])

    return docs.select(F.col("text").cast("string"), *keep).mapInArrow(measured, f"{types}, value {'array<double>' if trees is None else 'double'}")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, **params) -> Trees:
    """Trees from at most train_rows labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(train_rows)
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # at most train_rows rows
    rows = _measure(joined, ["doc_id", "_y"], "doc_id long, _y int", None).orderBy("doc_id", "_y", "value").limit(train_rows).toArrow()
    x = np.array(rows.column("value").to_pylist()).reshape(-1, len(FEATURES))
    return grow(x, rows.column("_y").to_numpy().astype(float), **params)


def score(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = _measure(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], "doc_id long", trees)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("value").alias("score"), (F.col("value") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(text):
        return __import__("pandas").Series(trees.score(np.array([statistics(t) for t in text]).reshape(-1, len(FEATURES))))

    return docs.where(scored(F.col("text").cast("string")) >= threshold)

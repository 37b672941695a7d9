"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a batch go into a trie, level by level.  A trie node stands for a prefix; its
forward score is the best of (score of the prefix without its last piece) + (score of that piece) over all
pieces that end there, and is computed once, however many pre-tokens share the prefix.  The piece count that
comes with the best score is stored with the node, and a pre-token's token count is read at its terminal
node.  A level's nodes are arrays, so that all prefixes of one length are scored together; only as many levels
are held as the longest piece has characters.

Scores: the vocabulary file's pieces in the order of their ids are taken as a unigram model by a fixed
Zipf law, score = -log(rank + 1), as the file holds merge ranks and no frequencies.  A character that no
piece covers costs UNKNOWN and counts as its UTF-8 bytes (byte fallback).  Ties go to fewer tokens.

Defined results: null and empty texts have 0 tokens; pre-tokens are the blank-separated words, each led
by the word mark; rows are counted one by one, whatever their doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import vocabulary

MARK = "▁"
#: Log score of a character outside the vocabulary.
UNKNOWN = -20.0
#: Pre-tokens of which fewer are as long as a level is deep are counted alone: a level's arrays would not pay.
FEW = 8
#: Base of the hash of a piece, and bits of the table that says which hashes no piece has.
BASE, BITS = 0x9E3779B97F4A7C15, 18
_TRIES: dict[str, "UnigramTrie"] = {}


def zipf_scores(path: str) -> dict[str, float]:
    """Scores of a sentencepiece file's ordinary pieces, by a fixed law of their rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    return {p: -math.log(r + 2) for r, p in enumerate(usual)}


class Pieces:
    """The pieces of one length: their characters and scores, found by a hash and then compared."""

    def __init__(self, chars: np.ndarray, scores: np.ndarray, base: np.ndarray):
        hashes = (chars[:, ::-1].astype(np.uint64) * base[: chars.shape[1]]).sum(1, dtype=np.uint64)
        order = np.argsort(hashes)
        self.chars, self.scores, self.hashes = chars[order], scores[order], hashes[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[hashes >> np.uint64(64 - BITS)] = True

    def find(self, hashes: np.ndarray, back: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of those hashes that belong to a piece; back: their characters, the last one first."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - BITS)])
        k = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[k] == hashes[at]
        at, k = at[same], k[same]
        for j, c in enumerate(back):
            same = self.chars[k, -1 - j] == c[at]
            if not same.all():
                at, k = at[same], k[same]
        return at, self.scores[k]


class UnigramTrie:
    """Token counts of many pre-tokens at once, over the trie of their prefixes."""

    def __init__(self, scores: dict[str, float], few: int = FEW):
        self.scores, self.few = scores, few
        self.longest = max(map(len, scores), default=1)
        self.base = np.array([pow(BASE, j, 1 << 64) for j in range(self.longest)], np.uint64)
        self.pieces: dict[int, Pieces] = {}
        for n in range(1, self.longest + 1):
            if some := [p for p in scores if len(p) == n]:
                chars = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                self.pieces[n] = Pieces(chars, np.array([scores[p] for p in some]), self.base)

    def counts(self, words: pa.Array) -> np.ndarray:
        """Tokens of distinct non-empty words, each led by the word mark."""
        out = np.zeros(len(words), np.int64)
        if not len(words):
            return out
        order = pc.sort_indices(words).to_numpy()  # words of one prefix lie beside each other
        words = words.take(pa.array(order))
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        begin = np.cumsum(size) - size
        flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        got, live, depth = np.zeros(len(words), np.int64), np.arange(len(words)), 0
        node = np.zeros(len(live), np.int64)  # of each live word, among its level's
        #: the latest levels, the newest last: parents, characters, forward scores, tokens
        levels: list[tuple[np.ndarray, ...]] = [(np.zeros(1, np.int64), np.zeros(1, np.uint32), np.zeros(1), np.zeros(1, np.int64))]
        while len(live) and (depth == 0 or len(live) >= self.few):
            char = flat[begin[live] + depth - 1] if depth else np.full(len(live), ord(MARK), np.uint32)
            new = np.r_[True, (node[1:] != node[:-1]) | (char[1:] != char[:-1])]
            first = np.flatnonzero(new)
            levels.append(self._level(levels, node[first], char[first]))
            del levels[: -self.longest - 1]
            node = np.cumsum(new) - 1
            ended = size[live] == depth
            got[live[ended]] = levels[-1][3][node[ended]]
            live, node, depth = live[~ended], node[~ended], depth + 1
        for k in live.tolist():
            got[k] = self.count_alone(MARK + words[k].as_py())
        out[order] = got
        return out

    def _level(self, levels: list[tuple[np.ndarray, ...]], parent: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, ...]:
        """The nodes below the newest level: of each, the best way to end a piece there."""
        score = levels[-1][2][parent] + UNKNOWN
        tokens = levels[-1][3][parent] + 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        hashes, above, back = np.zeros(len(char), np.uint64), parent, [char]
        for n in range(1, min(self.longest, len(levels)) + 1):
            hashes = hashes + back[-1].astype(np.uint64) * self.base[n - 1]
            up = levels[-n]  # `above` are the places, there, of the prefixes without the last n characters
            if n in self.pieces:
                at, worth = self.pieces[n].find(hashes, back)
                if len(at):
                    ways, many = up[2][above[at]] + worth, up[3][above[at]] + 1
                    better = (ways > score[at]) | ((ways == score[at]) & (many < tokens[at]))
                    score[at[better]], tokens[at[better]] = ways[better], many[better]
            if n < len(levels):
                back.append(up[1][above])
                above = up[0][above]
        return parent, char, score, tokens

    def count_alone(self, word: str) -> int:
        """The same scores for one pre-token: only the last ones are held."""
        scores, last = self.scores, [(0.0, 0)]  # (forward score, tokens) of the prefixes so far, the newest first
        for end, char in enumerate(word, 1):
            best, tokens = last[0][0] + UNKNOWN, last[0][1] + len(char.encode("utf-8", "surrogatepass"))
            for back, (score, n) in enumerate(last, 1):
                piece = scores.get(word[end - back : end])
                if piece is not None and (score + piece > best or (score + piece == best and n + 1 < tokens)):
                    best, tokens = score + piece, n + 1
            last = [(best, tokens), *last[: self.longest - 1]]
        return last[0][1]


def trie(path: str) -> UnigramTrie:
    """This process's trie for a vocabulary file."""
    if path not in _TRIES:
        _TRIES[path] = UnigramTrie(zipf_scores(path))
    return _TRIES[path]


def count_tokens(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_distinct) of every document; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    path = vocab or vocabulary("piece_bpe_32k.model")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = trie(path)
        for batch in batches:
            lists = pc.utf8_split_whitespace(batch.column(1).fill_null(""))
            edge = lists.offsets.to_numpy().astype(np.int64)
            doc, told = np.repeat(np.arange(len(batch)), np.diff(edge)), lists.flatten().dictionary_encode()
            which, words = told.indices.to_numpy(), told.dictionary
            there = (pc.binary_length(words).to_numpy() > 0)[which] if len(which) else np.zeros(0, bool)  # blanks at an end leave an empty one
            doc, which = doc[there], which[there]
            filled = np.flatnonzero(pc.binary_length(words).to_numpy() > 0)
            tokens = np.zeros(len(words), np.int64)
            tokens[filled] = of.counts(words.take(pa.array(filled)))
            distinct = np.unique(doc * max(len(words), 1) + which) // max(len(words), 1)
            sums = [np.bincount(doc, minlength=len(batch)), np.bincount(doc, tokens[which], len(batch)).astype(np.int64), np.bincount(distinct, minlength=len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in sums)], names=["doc_id", "n_words", "n_tokens", "n_distinct"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(counted, "doc_id long, n_words long, n_tokens long, n_distinct long")

"""Token ids of whole texts with a vocabulary file of the tokenizers library."""

from __future__ import annotations

import os
import string
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries and bytes of a key of the word cache; beyond, words outside the batch at hand are forgotten, and longer ones never kept.
CACHE_WORDS, CACHE_BYTES = 400_000, 40
#: ASCII signs that form one pre-token when they follow letters; the apostrophe can begin one of its own.
SIGNS = string.punctuation.replace("'", "")
#: Letters are looked for below this place: Latin, Greek and Cyrillic ones.
LETTERS = 0x530
#: Words put together, words encoded, at once.
RUN, STEMS = 1 << 16, 4096
_ENCODERS: dict[str, "TextEncoder"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """The pieces flat[begin : begin + size], one after the other; which: these of them, in this order."""
    n = len(size) if which is None else len(which)
    out: list[np.ndarray] = [flat[:0]]
    for lo in range(0, n, RUN):
        at = slice(lo, lo + RUN) if which is None else which[lo : lo + RUN]
        many = size[at]
        ends = np.cumsum(many)
        out.append(flat[np.repeat(begin[at] - ends + many, many) + np.arange(ends[-1])])
    return np.concatenate(out)


class TextEncoder:
    """Encodes texts by their distinct words; the ids equal those of encoding each whole text.

    Only for vocabularies that drop white space before their merges and mark word ends, as
    ``word_bpe_49k.json`` does: there no merge, no normalisation and no special token reaches over a
    blank, so that the ids of a text are those of its blank-separated words, one after the other.  A word
    of ``letters`` and then signs is two pre-tokens, a stem and a tail; new stems are encoded many at a
    time, and parted where a token ends a word.  ``letters`` are those of which the file's own normaliser
    and pre-tokeniser say so: a run of them, with a sign behind it, must give the run and the sign.  A
    capital I with a dot above is none, as its lower case ends in a mark, which goes with the signs.
    """

    END = "</w>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.END)]] = True
        self.letters = frozenset(c for c in map(chr, range(LETTERS)) if c.isalpha() and self._is_letter(c))
        self._stem = f"^[{''.join(sorted(self.letters))}]+$"
        #: the cache: words (stems, or words that are not parted), and where the ids of each begin and how many they are
        self.words, self.flat, self.begin, self.size = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _is_letter(self, c: str) -> bool:
        """Whether the letter, alone or in a run, is one pre-token of its own, whatever sign follows."""
        normal, parts = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        one = parts(normal(c))
        return len(one) == 1 and all([p[0] for p in parts(normal(f"a{c}{c}a{c}{s}"))] == [f"a{one[0][0] * 2}a{one[0][0]}", s] for s in SIGNS)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many of each) of words; stem: which are runs of letters."""
        parts: list[np.ndarray] = []
        size = np.zeros(len(words), np.int64)
        for kind in (True, False):
            at = np.flatnonzero(stem == kind)
            texts = words.take(pa.array(at)).to_pylist()
            for lo in range(0, len(texts), STEMS):
                some, mine = texts[lo : lo + STEMS], at[lo : lo + STEMS]
                if kind:
                    ids = self._ids([" ".join(some)])[0]
                    cut = np.flatnonzero(self.ends[ids]) + 1
                    if len(cut) == len(some) and cut[-1] == len(ids):
                        parts.append(ids)
                        size[mine] = np.diff(cut, prepend=0)
                        continue
                each = self._ids(some)
                parts += each
                size[mine] = [len(x) for x in each]
        flat = np.concatenate([*parts, np.zeros(0, np.uint32)])
        order = np.r_[np.flatnonzero(stem), np.flatnonzero(~stem)]  # as they were encoded
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return pieces_of(flat, begin, size), size

    def _known(self, words: pa.Array, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, sizes) of distinct words, from the cache or learnt and added to it."""
        at = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy()
        fresh = words.take(pa.array(new))
        ids, many = self._learn(fresh, stem[new])
        flat = np.concatenate([self.flat, ids])
        begin, size = (x[at] if len(x) else np.zeros(len(at), np.int64) for x in (self.begin, self.size))
        begin[new], size[new] = len(self.flat) + np.cumsum(many) - many, many
        if len(self.words) + len(new) > CACHE_WORDS:
            keep = np.flatnonzero(pc.binary_length(words).to_numpy() <= CACHE_BYTES)[:CACHE_WORDS]
            self.words, self.size = words.take(pa.array(keep)), size[keep]
            self.flat, self.begin = pieces_of(flat, begin[keep], size[keep]), np.cumsum(size[keep]) - size[keep]
        else:
            keep = pc.binary_length(fresh).to_numpy() <= CACHE_BYTES
            self.words = pa.concat_arrays([self.words, fresh.filter(pa.array(keep))])
            kept = many[keep]
            self.begin, self.size = np.concatenate([self.begin, len(self.flat) + np.cumsum(kept) - kept]), np.concatenate([self.size, kept])
            self.flat = np.concatenate([self.flat, pieces_of(ids, (np.cumsum(many) - many)[keep], kept)])
        return flat, begin, size

    def _tails(self, words: pa.Array, from_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, sizes) of what is left of words behind their first so many bytes: signs."""
        end = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
        begin, size = end[:-1].astype(np.int64) + from_, np.diff(end) - from_
        data = pieces_of(np.frombuffer(words.buffers()[2] or b"", np.uint8), begin, size)
        tails = pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        each = self._ids(tails.dictionary.to_pylist())
        many, which = np.array([len(x) for x in each], np.int64), tails.indices.to_numpy()
        return np.concatenate([*each, np.zeros(0, np.uint32)]), (np.cumsum(many) - many)[which], many[which]

    def encode(self, texts: pa.Array | Iterable[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin, and the end) with end_id behind each text, if there is one; null: as empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        lists = pc.ascii_split_whitespace(texts)
        edge, told = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        words, which = told.dictionary, told.indices.to_numpy()
        del lists  # as large as the texts
        stems = pc.ascii_rtrim(words, characters=SIGNS)
        stem = pc.match_substring_regex(stems, self._stem).to_numpy(zero_copy_only=False)
        length = np.where(stem, pc.binary_length(stems).to_numpy(), pc.binary_length(words).to_numpy()).astype(np.int64)
        keys = pc.if_else(pa.array(stem), pc.ascii_lower(stems), words).dictionary_encode()
        key, kinds = keys.indices.to_numpy(), len(keys.dictionary)
        is_stem = np.zeros(kinds, bool)
        is_stem[key] = stem  # a run of letters and another word are never one key
        flat, begin, size = self._known(keys.dictionary, is_stem)
        tail_ids, tail_begin, tail_size = self._tails(words, length)
        # a word's ids: those of its key, then those of its tail
        both = pieces_of(np.concatenate([flat, tail_ids]), np.stack([begin[key], len(flat) + tail_begin], 1).ravel(), np.stack([size[key], tail_size], 1).ravel())
        many = size[key] + tail_size
        ids = pieces_of(both, np.cumsum(many) - many, many, which)
        at = np.concatenate([[0], np.cumsum(many[which])])[edge - edge[0]]
        pa.default_memory_pool().release_unused()
        if end_id is None:
            return ids, at
        return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))


def encoder(path: str) -> TextEncoder:
    """This process's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]

"""URL filters: a bit-parallel wildcard automaton.

Glob rules are packed, one after the other, into the words of Shift-And masks: a bit for each state
(literals consumed so far) of each rule.  One step per byte moves all rules over all urls of a batch at
once: states shift left, and stay only where the mask of the byte has a literal; states before a wildcard
also stay by themselves.  ``*`` takes any bytes but ``/``, ``**`` any bytes, ``?`` one byte but ``/``.

A url's canonical form is ``.`` + host + ``/`` + path, where the path is empty or has its own slash, so that
``*.net//de/**`` fits the path ``/de/`` of ``net`` and its subdomains, ``*.net/**`` any path of these, and
neither a host that only begins or ends like it.  Where several rules fit, the one with the longest text wins (then the first given);
where none fits, the default verdict holds.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no host rule and
gets the default verdict; rows of one page_id are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    text: str  # as results show it
    glob: str  # over the canonical url

    @classmethod
    def host_path(cls, action: str, text: str) -> "Rule":
        """A rule for a host (A-Z as a-z) with all its subdomains, and the paths that start with its path: all, if it has none."""
        host, slash, path = text.partition("/")
        quoted = "".join("\\" + c if c in "*?\\" else c for c in f"{host.translate(_LOWER)}/{slash}{path}")
        return cls(action, text, f"*.{quoted}**")


class Automaton:
    """All globs as one Shift-And automaton."""

    def __init__(self, globs: list[str]):
        states = [self._states(g) for g in globs]
        total = sum(len(s) for s in states)
        self.words = max(1, -(-total // 64))
        self.shift, self.stay = np.zeros((self.words, 256), np.uint64), np.zeros((self.words, 256), np.uint64)
        self.start, self.ends = np.zeros(self.words, np.uint64), []
        at = 0
        for chain in states:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for k, (literal, wild) in enumerate(chain):
                word, bit = divmod(at + k, 64)
                if k:
                    self.shift[word, literal] |= np.uint64(1 << bit)
                if wild:
                    self.stay[word, [c for c in range(256) if wild == 2 or c != 47]] |= np.uint64(1 << bit)
            at += len(chain)
            self.ends.append(divmod(at - 1, 64))

    @staticmethod
    def _states(glob: str) -> list[tuple[list[int], int]]:
        """Of each state: the bytes that lead into it, and its own wildcard (0 none, 1 ``*``, 2 ``**``)."""
        chain: list[tuple[list[int], int]] = [([], 0)]
        data, k = glob.encode(), 0
        while k < len(data):
            c = data[k : k + 1]
            if c == b"*":
                n = 2 if data[k : k + 2] == b"**" else 1
                chain[-1] = (chain[-1][0], max(chain[-1][1], n))
                k += n
                continue
            if c == b"\\" and k + 1 < len(data):
                k += 1
                chain.append(([data[k]], 0))
            else:
                chain.append(([b for b in range(256) if b != 47] if c == b"?" else [data[k]], 0))
            k += 1
        return chain

    def match(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs) boolean: which globs fit which whole text."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")  # the longest first, so that those still running are a prefix
        flat = np.frombuffer(b"".join([texts[i] for i in order]) or b"\0", np.uint8)
        begin = np.concatenate([[0], np.cumsum(size[order])])[:-1]
        state = np.repeat(self.start[:, None], len(texts), 1)
        running = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")  # at each step
        one, top = np.uint64(1), np.uint64(63)
        for step, n in enumerate(running):
            byte, now, carry = flat[begin[:n] + step], state[:, :n].copy(), np.uint64(0)
            for w in range(self.words):
                state[w, :n] = (((now[w] << one) | carry) & self.shift[w, byte]) | (now[w] & self.stay[w, byte])
                carry = now[w] >> top
        out = np.zeros((len(texts), len(self.ends)), bool)
        for g, (word, bit) in enumerate(self.ends):
            out[order, g] = (state[word] >> np.uint64(bit)) & one
        return out


def _parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = lambda s, ends: s[: min((k for k in map(s.find, ends) if k >= 0), default=len(s))]
    host = cut(rest, "/?#")
    return host.translate(_LOWER), cut(rest[len(host) :], "?#")


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every page; one pass, no shuffle."""
    bounded_batches(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: -len(r.text))  # stable: the first given among equally long ones
    automaton = Automaton([r.glob for r in ranked])
    actions, texts = [*(r.action for r in ranked), default], [*(r.text for r in ranked), None]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_parts(u) for u in batch.column(1).to_pylist()]
            fits = automaton.match([f".{h}/{p}".encode("utf-8", "surrogatepass") for h, p in parts])
            best = np.where(fits.any(1), fits.argmax(1), len(ranked)).tolist() if ranked else [0] * len(parts)
            columns = [pa.array([p[k] for p in parts], pa.string()) for k in (0, 1)] + [pa.array([x[k] for k in best], pa.string()) for x in (texts, actions)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).mapInArrow(judged, f"_id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("_id", id_col)

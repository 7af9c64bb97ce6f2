"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_M1, _M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_COEF = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37], np.uint64)

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is in lower case, and of words [^\x20\x09-\x0D]+.
PROSE = np.ones(256, bool)
PROSE[:0x30] = PROSE[0x3A:0x61] = PROSE[0x7B:0x80] = False
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of equally long arrays of hashes, in order."""
    total = np.full(len(parts[0]), len(parts), np.uint64)
    for i, part in enumerate(parts):
        total = total * _BASE + mix(part + _COEF[i % len(_COEF)])
    return mix(total)


def group_hash(values: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A polynomial hash of each run values[first : first + length]; the runs are not empty and cover all values."""
    at = np.arange(len(values)) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    return mix(np.add.reduceat((values + np.uint64(1)) * np.cumprod(powers)[at], first) + lengths.astype(np.uint64) * GOLDEN)


@dataclass
class Words:
    """Words in order of texts. start and end are bytes of buf, doc is the text's index, offsets its first byte."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_docs: int

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self) -> np.ndarray:
        lengths = self.end - self.start
        if not len(lengths):
            return np.zeros(0, np.uint64)
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        values = self.buf[np.cumsum(inside[:-1], dtype=np.int8).view(bool)].astype(np.uint64)
        return group_hash(values, np.cumsum(lengths) - lengths, lengths)

    def text(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def words(texts: list[str | None], kind: np.ndarray = PROSE, lower: bool = True) -> Words:
    """Words of ``texts`` (None: no word); a word is a longest run of bytes of ``kind``."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    joined = b"\n".join([*raw, b""])
    buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    offsets = np.cumsum(sizes) - sizes
    inside = kind[buf].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(buf, offsets, start, end, np.searchsorted(offsets, start, "right") - 1, len(raw))


def windows(values: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive values of one text, and the index of each one's first value."""
    if len(values) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(values) - size + 1
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return combine([values[first + j] for j in range(size)]), first

"""Vectorised scanning of Arrow text columns: word bounds, word hashes, rolling hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the
same as ``[^\\x20\\x09-\\x0D]+`` over code points. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_BYTES = 2 << 20
_BLOCK = 1 << 19
_U = np.uint64

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """p**i and p**-i modulo 2**64, grown as needed."""

    def __init__(self, p: int) -> None:
        self.p, self.up, self.down = p, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.p), ("down", pow(self.p, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(0x5851F42D4C957F2D), _Powers(0xD1342543DE82EF95)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values of h, in order; empty if h is shorter."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * up, out=sums[1:])
    return mix64((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


class Scan:
    """Words of some texts.

    data: bytes, with one separator before each text and one at the end; start: where
    each text begins in data (and one past the last); ws, we: bounds of the words;
    ptr: index of each text's first word (and one past the last). separator: which bytes
    part words, a space among them.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False, separator: np.ndarray = SEPARATOR) -> None:
        texts = [t or b"" for t in texts]
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self.data = LOWER[raw] if lower else raw
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.sizes = sizes
        self.start = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
        self.inword = ~separator[raw]
        edges = np.flatnonzero(self.inword[1:] != self.inword[:-1]) + 1
        self.ws, self.we = edges[0::2], edges[1::2]
        self.ptr = np.searchsorted(self.ws, self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.ws), np.uint64)
        a = 0
        while a < len(self.ws):
            base = int(self.ws[a])
            b = max(a + 1, int(np.searchsorted(self.we, base + _BLOCK, "right")))
            end = int(self.we[b - 1])
            up, down = _BYTES.get(end - base + 1)
            sums = np.empty(end - base + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_VALUE[self.data[base:end]] * up[: end - base], out=sums[1:])
            s, e = self.ws[a:b] - base, self.we[a:b] - base
            out[a:b] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
            a = b
        return out

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words joined by one space, over all texts, and the words' bounds in that."""
        keep = self.inword.copy()
        keep[self.ws - 1] = True
        data = np.where(self.inword, self.data, np.uint8(0x20))[keep]
        size = self.we - self.ws
        ws = np.cumsum(size + 1) - size
        return data.tobytes(), ws, ws + size

    def owner(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.sizes)), np.diff(self.ptr))


def window_starts(ptr: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the words at which a window of k words within one text begins."""
    counts = np.maximum(np.diff(ptr) - k + 1, 0)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(ptr[:-1] - (ends - counts), counts)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about limit bytes at most (always one row or more)."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray([0 if v is None else v for v in pa.compute.binary_length(col).to_pylist()], np.int64)
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield batch.slice(a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The column's values as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()

"""Texts as flat byte arrays: words, lines and hashes of any substring, vectorised in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, i.e. the
pattern [^\\x20\\x09-\\x0D]+ on the decoded text, since these bytes only stand
for themselves in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.RandomState(20240229)
#: A random odd word for each byte value; the hash of a string is the sum of these times powers of BASE.
BYTE = (_rng.randint(0, 1 << 32, 256).astype(U64) << U64(32)) | _rng.randint(0, 1 << 32, 256).astype(U64) | U64(1)
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i < n at least."""
    if not _powers or len(_powers["up"]) < n:
        for key, b in (("up", BASE), ("down", BASE_INV)):
            p = np.ones(n, U64)
            p[1:] = U64(b)
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def texts(array: pa.Array) -> pa.Array:
    """Strings without nulls: null counts as empty."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return pc.fill_null(array, "") if array.null_count else array


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the strings, one after another, and the offsets where each begins."""
    wide = pa.types.is_large_string(array.type)
    _, offs, data = array.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return flat, off - off[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batch with about `most` bytes of text each (one row at least: a text is never cut)."""
    column_at = batch.schema.get_field_index(column)
    array = texts(batch.column(column_at))
    if not len(array):
        return
    _, off = bytes_of(array)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), Block(array.slice(at, to - at))
        at = to


class Block:
    """Some whole texts; spans are in bytes of `data`."""

    def __init__(self, array: pa.Array, lower: bool = False):
        self.array, self.n = array, len(array)
        self.data, self.off = bytes_of(array)
        if lower:
            self.data = LOWER[self.data]
        self._sum = None

    def words(self) -> None:
        """Sets ws, we (begin and end of each word) and wd (words before each text, and in all)."""
        solid = ~SPACE[self.data]
        begin, end = solid.copy(), solid.copy()
        if len(solid):
            first = np.zeros(len(solid) + 1, bool)
            first[self.off] = True
            begin[1:] &= ~solid[:-1] | first[1:-1]
            end[:-1] &= ~solid[1:] | first[1:-1]
        self.ws, self.we = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.wd = np.searchsorted(self.ws, self.off)
        self.solid = solid

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.wd))

    def lines(self) -> None:
        """Sets ls, le (begin and end of each line; \\n parts lines) and ld (lines before each text, and in all)."""
        cut = np.flatnonzero(self.data == 10)
        doc = np.searchsorted(self.off, cut, "right") - 1
        # each text begins one line, and each \n another
        keys = np.concatenate([self.off[:-1] * 2, (cut + 1) * 2 - 1]) if len(cut) else self.off[:-1] * 2
        begins = np.concatenate([self.off[:-1], cut + 1])
        docs = np.concatenate([np.arange(self.n), doc])
        order = np.lexsort((keys, docs))
        self.ls, docs = begins[order], docs[order]
        self.ld = np.searchsorted(docs, np.arange(self.n + 1))
        self.le = np.empty_like(self.ls)
        if len(self.ls):
            self.le[:-1] = self.ls[1:] - 1
            self.le[self.ld[1:] - 1] = self.off[1:]

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's bytes; equal bytes, equal hash, wherever they stand."""
        if self._sum is None:
            up, _ = _power(max(len(self.data) + 1, BLOCK + 1))
            self._sum = np.zeros(len(self.data) + 1, U64)
            np.cumsum(BYTE[self.data] * up[: len(self.data)], out=self._sum[1:])
        _, down = _power(len(self.data) + 1)
        h = self._sum[end] - self._sum[begin]
        h *= down[begin]
        h += (end - begin).astype(U64)
        return mix(h)


def per_doc(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the values between edges[i] and edges[i + 1]; 0 for an empty stretch. Sums of fractions don't depend on what stands around."""
    if values.dtype.kind == "f":
        out, full = np.zeros(len(edges) - 1), np.flatnonzero(edges[1:] > edges[:-1])
        if len(full):
            out[full] = np.add.reduceat(values[: edges[-1]], edges[full])
        return out
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether an equal one stands before it, and whether there is any other equal one."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    later, any_other = np.empty(len(s), bool), np.empty(len(s), bool)
    later[order] = same[:-1]
    any_other[order] = same[:-1] | same[1:]
    return later, any_other

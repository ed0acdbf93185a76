"""Elias-Fano sequences over memory-mapped words, queried in numpy batches."""

from __future__ import annotations

import json
import os
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs as pafs

U64 = np.uint64


class EliasFano:
    """A rising sequence: the low bits of each value packed, the high bits in unary; with the counts of ones and of zeros before each word."""

    def __init__(self, n: int, low_bits: int, top: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.top, self.low, self.high, self.ones, self.zeros = n, low_bits, top, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        universe = top + 1
        l = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)  # noqa: E741
        values = values.astype(U64)
        if l:
            bits = ((values[:, None] >> np.arange(l, dtype=U64)) & U64(1)).astype(np.uint8)
            packed = np.packbits(bits.ravel(), bitorder="little")
        else:
            packed = np.zeros(0, np.uint8)
        low = np.zeros((len(packed) // 8 + 2) * 8, np.uint8)
        low[: len(packed)] = packed
        size = n + (universe >> l) + 2
        upper = np.zeros((size // 64 + 2) * 64, np.uint8)
        upper[(values >> U64(l)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(upper, bitorder="little").view(U64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return cls(n, l, top, low.view(U64), high, ones, (np.arange(len(ones)) * 64 - ones).astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U64)
        bit = i.astype(np.int64) * self.l
        word, off = bit >> 6, (bit & 63).astype(U64)
        both = (self.low[word] >> off) | ((self.low[word + 1] << U64(1)) << (U64(63) - off))
        return both & U64((1 << self.l) - 1)

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """Position of the rank-th one (or zero), from 0."""
        before = self.ones if one else self.zeros  # as they are: a copy would cost more than the look-ups of a small batch
        word = np.searchsorted(before, rank.astype(np.uint32), "right") - 1
        left = rank - before[word]
        bits = self.high[word] if one else ~self.high[word]
        at = np.zeros(len(rank), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((bits >> at.astype(U64)) & U64((1 << step) - 1)).astype(np.int64)
            go = left >= count
            left -= count * go
            at += step * go
        return word * 64 + at

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values by place."""
        return (self._select(i, True) - i << self.l) | self._low(i).astype(np.int64)

    def find(self, keys: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The place of each key among the places from lo to before hi (anywhere), -1 if it isn't there: the bucket of its high bits, then a successor search in the low bits."""
        out = np.full(len(keys), -1, np.int64)
        use = np.flatnonzero((keys <= self.top) & (keys >= 0)) if self.n else np.zeros(0, np.int64)
        if not len(use):
            return out
        keys = keys[use]
        h = (keys >> self.l).astype(np.int64)
        low = (keys & ((1 << self.l) - 1)).astype(U64)
        end = self._select(h, False) - h
        at = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1 - h, 0)
        if lo is not None:
            at, end = np.maximum(at, lo[use]), np.minimum(end, hi[use])
        stop = end.copy()
        todo = np.flatnonzero(at < stop)
        while len(todo):
            middle = (at[todo] + stop[todo]) >> 1
            less = self._low(middle) < low[todo]
            at[todo] = np.where(less, middle + 1, at[todo])
            stop[todo] = np.where(less, stop[todo], middle)
            todo = todo[at[todo] < stop[todo]]
        hit = at < end
        hit[hit] = self._low(at[hit]) == low[hit]
        out[use[hit]] = at[hit]
        return out

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones, f"{name}.zeros": self.zeros, f"{name}.meta": np.array([self.n, self.l, self.top], np.int64)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, l, top = arrays[f"{name}.meta"]  # noqa: E741
        return cls(int(n), int(l), int(top), arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"], arrays[f"{name}.zeros"])


class Level:
    """The children of a row of parents: a rising pointer to each parent's first child, and the children's values.

    A value stands relative to its parent: to it is added the last value of
    the parent before, so the sequence rises throughout. Without the pointers
    it says nothing.
    """

    def __init__(self, at: EliasFano, values: EliasFano):
        self.at, self.values = at, values

    @classmethod
    def build(cls, counts: np.ndarray, values: np.ndarray) -> Level:
        """counts: children of each parent. values: theirs, rising within a parent."""
        edges = np.concatenate([[0], np.cumsum(counts)])
        some = counts > 0
        last = np.zeros(len(counts), np.int64)
        last[some] = values[edges[1:][some] - 1]
        base = np.cumsum(last) - last
        return cls(EliasFano.build(edges), EliasFano.build(values + np.repeat(base, counts)))

    def children(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each parent the places of its first child and behind its last, and what its children's values are relative to."""
        lo, hi, base = self.at.access(parent), self.at.access(parent + 1), np.zeros(len(parent), np.int64)
        inner = np.flatnonzero((lo > 0) & (hi > lo))
        base[inner] = self.values.access(lo[inner] - 1)
        return lo, hi, base

    def find(self, lo: np.ndarray, hi: np.ndarray, base: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The place of the value among the children from lo to before hi, -1 if it isn't there."""
        return self.values.find(base + value, lo, hi)

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return self.at.parts(f"{name}.at") | self.values.parts(name)

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> Level:
        return cls(EliasFano.of(arrays, f"{name}.at"), EliasFano.of(arrays, name))


class Files:
    """Files of a folder by name, opened when they are asked for: the last ones used stay open, up to a number and (where they can't be mapped) to a number of bytes."""

    def __init__(self, base: str, make=lambda arrays: arrays, most: int = 1024, most_bytes: int = 256 << 20):
        self.base, self.make, self.most, self.most_bytes = base, make, most, most_bytes
        self.open: OrderedDict[str, tuple[object, int]] = OrderedDict()
        self.bytes = 0

    def __getitem__(self, name: str):
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name][0]
        arrays = read(f"{self.base}/{name}")
        size = 0 if _local(self.base) is not None else sum(a.nbytes for a in arrays.values())
        while self.open and (len(self.open) >= self.most or self.bytes + size > self.most_bytes):
            self.bytes -= self.open.popitem(last=False)[1][1]
        self.open[name], self.bytes = (self.make(arrays), size), self.bytes + size
        return self.open[name][0]


def _local(uri: str) -> str | None:
    p = urlparse(uri)
    return p.path if p.scheme in ("", "file") else None


def write(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON (name, type, length, offset), then the arrays, aligned. It appears whole or not at all, so a task can be run again."""
    heads, at = [], 0
    for name, a in arrays.items():
        heads.append([name, a.dtype.str, len(a), at])
        at += (a.nbytes + 7) // 8 * 8
    head = json.dumps(heads).encode()
    head += b" " * (-(len(head) + 9) % 8) + b"\n"
    body = [len(head).to_bytes(8, "little"), head, *(x for a in arrays.values() for x in (a.tobytes(), b"\0" * (-a.nbytes % 8)))]
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part := f"{path}.{os.getpid()}", "wb") as f:
            f.writelines(body)
        os.replace(part, path)
    else:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_output_stream(part := f"{path}.{os.getpid()}") as f:
            for x in body:
                f.write(x)
        fs.move(part, path)


def read(uri: str) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped where the shared folder is mounted."""
    if (path := _local(uri)) is not None:
        raw = np.memmap(path, np.uint8, "r")
    else:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    heads, body = json.loads(raw[8 : 8 + size].tobytes()), raw[8 + size :]
    return {name: np.asarray(body[at : at + n * np.dtype(kind).itemsize]).view(kind) for name, kind, n, at in heads}


def remove(uris: list[str]) -> None:
    """Deletes files that are there."""
    for uri in uris:
        if (path := _local(uri)) is not None:
            if os.path.exists(path):
                os.remove(path)
        else:
            fs, path = pafs.FileSystem.from_uri(uri)
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_file(path)

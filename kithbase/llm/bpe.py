"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Not one word after another, but one merge after another: the distinct words
of a block of texts stand in one array of symbols, an inverted index leads
from each token that a pair can merge into to the positions of such pairs,
and the merges are applied to all their positions at once in the order of
rank. Only the neighbours of a merged pair get new index entries.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .lexer import texts
from .store import lean, slim_batches

NONE = np.int32(2**31 - 1)
#: Bytes of text that share a dictionary, and words that a worker remembers.
BLOCK, REMEMBERED = 8 << 20, 400_000
#: Words or ids that are looked up at once, so that index arrays stay small beside the texts.
AT_ONCE = 1 << 16


class Ranks:
    """A vocabulary of byte strings, the rank of each being its id."""

    def __init__(self, blob: bytes):
        pairs = [line.split() for line in blob.splitlines() if line]
        size = max(int(r) for _, r in pairs) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in pairs:
            self.tokens[int(rank)] = base64.b64decode(token)
        rank = {t: i for i, t in enumerate(self.tokens) if t}
        self.single = np.full(256, -1, np.int32)
        keys, merged = [], []
        for t, r in rank.items():
            if len(t) == 1:
                self.single[t[0]] = r
            for k in range(1, len(t)):
                left, right = rank.get(t[:k]), rank.get(t[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(r)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        # An open hash table: a look-up is one or two gathers instead of a binary search.
        self.mask = (1 << (len(keys) * 4).bit_length()) - 1
        self.slot_key, self.slot_rank = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int32)
        at, left = self._home(self.keys), np.arange(len(self.keys))
        self.reach = 0
        while len(left):
            free = self.slot_key[at[left]] < 0
            _, first = np.unique(at[left][free], return_index=True)
            won = left[free][first]
            self.slot_key[at[won]], self.slot_rank[at[won]] = self.keys[won], self.merged[won]
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & self.mask
            self.reach += 1
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges into; NONE if none."""
        key = left.astype(np.int64) << 32 | right
        at = self._home(key)
        found = np.full(len(key), NONE, np.int32)
        for _ in range(self.reach):
            have = self.slot_key[at]
            hit = have == key
            found[hit] = self.slot_rank[at[hit]]
            if not (more := (have >= 0) & ~hit).any():
                break
            if not more.all():
                rest = np.flatnonzero(more)
                found[rest] = self._probe(key[rest], (at[rest] + 1) & self.mask)
                break
            at = (at + 1) & self.mask
        return found

    def _probe(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        found, todo = np.full(len(key), NONE, np.int32), np.arange(len(key))
        while len(todo):
            have = self.slot_key[at[todo]]
            hit = have == key[todo]
            found[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[(have >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & self.mask
        return found

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one word after another, and the offset of each word."""
        size = np.array([len(w) for w in words], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        n = int(off[-1])
        # Position n is a sentinel beyond the last symbol; the symbol before a word's first is n, too.
        sym = np.append(self.single[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))
        ahead, back = np.arange(1, n + 2), np.arange(-1, n)
        last = off[1:][size > 0] - 1
        ahead[last] = n
        back[off[:-1][size > 0]] = n
        rank = np.full(n + 1, NONE, np.int32)
        has = np.flatnonzero(ahead[:n] < n)
        rank[has] = self.pair(sym[has], sym[has + 1])
        alive = np.ones(n + 1, bool)
        has = has[rank[has] != NONE]
        by_rank = has[np.argsort(rank[has], kind="stable")]
        ranks, cuts = np.unique(rank[by_rank], return_index=True)
        index: dict[int, list[np.ndarray]] = {int(r): [p] for r, p in zip(ranks, np.split(by_rank, cuts[1:]), strict=True)} if len(by_rank) else {}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r, None)
            if at is None:
                continue
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            at = at[rank[at] == r]  # others have changed meanwhile
            if not len(at):
                continue
            right = ahead[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():
                at = self._apart(at, right)
                right = ahead[at]
            after = ahead[right]
            sym[at] = r
            alive[right] = False
            rank[right] = NONE
            ahead[at] = after
            back[after] = at
            back[n] = n
            before = back[at]
            left = np.concatenate([before[before < n], at])
            to = ahead[left]
            new = np.full(len(left), NONE, np.int32)
            ok = to < n
            new[ok] = self.pair(sym[left[ok]], sym[to[ok]])
            rank[left] = new
            use = new != NONE
            if use.any():
                left, new = left[use], new[use]
                if len(left) > 1 and (new[1:] != new[0]).any():
                    order = np.argsort(new, kind="stable")
                    left, new = left[order], new[order]
                    cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
                    parts, names = np.split(left, cuts), new[np.concatenate([[0], cuts])].tolist()
                else:
                    parts, names = [left], [int(new[0])]
                for name, part in zip(names, parts, strict=True):
                    if name in index:
                        index[name].append(part)
                    else:
                        index[name] = [part]
                        heapq.heappush(heap, name)
        keep = alive[:n]
        count = np.concatenate([[0], np.cumsum(keep)])
        return sym[:n][keep], count[off]

    @staticmethod
    def _apart(at: np.ndarray, right: np.ndarray) -> np.ndarray:
        """From left to right, without those whose left symbol the one before takes."""
        touch = np.concatenate([[False], right[:-1] == at[1:]])
        place = np.arange(len(at))
        run = place - np.maximum.accumulate(np.where(touch, 0, place))
        return at[run % 2 == 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        out = [np.zeros(0, np.uint8)]
        for k in range(0, len(ids), AT_ONCE):
            part = ids[k : k + AT_ONCE]
            size = self.length[part]
            end = np.cumsum(size)
            out.append(self.bytes[np.arange(end[-1]) + np.repeat(self.start[part] - (end - size), size)])
        return np.concatenate(out)


class Encoder:
    """Encodes whole texts as a pattern cuts them into words; remembers words between blocks."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self._clear()

    def _clear(self):
        self.place: dict[str, int] = {}
        self.ids, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the offset of each text."""
        if len(self.place) > REMEMBERED:
            self._clear()
        place, find = self.place, self.find
        fresh, at, edges = [], [], [0]
        for text in block:
            words = find(text)
            new = [w for w in dict.fromkeys(words) if w not in place]
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            fresh += new
            at.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
            edges.append(edges[-1] + len(words))
        if fresh:
            ids, off = self.ranks.replay([w.encode() for w in fresh])
            self.ids, self.off = np.concatenate([self.ids, ids]), np.concatenate([self.off, self.off[-1] + off[1:]])
        at = np.concatenate(at) if at else np.zeros(0, np.int32)
        end = np.concatenate([[0], np.cumsum(self.off[at + 1] - self.off[at])])
        out = np.empty(end[-1], np.int32)
        for k in range(0, len(at), AT_ONCE):
            begin, to = self.off[at[k : k + AT_ONCE]], end[k : k + AT_ONCE + 1]
            out[to[0] : to[-1]] = self.ids[np.arange(to[0], to[-1]) + np.repeat(begin - to[:-1], np.diff(to))]
        return out, end[edges]


def pieces(array: pa.Array, most: int = BLOCK):
    """Lists of whole texts of about `most` characters, with the place of the first."""
    got, at, size = [], 0, 0
    for i, text in enumerate(array.to_pylist()):
        got.append(text)
        size += len(text)
        if size >= most:
            yield at, got
            got, at, size = [], i + 1, 0
    if got:
        yield at, got


_ranks: dict[bytes, Ranks] = {}


def _loaded(blob: bytes) -> Ranks:
    """One parsed vocabulary for a worker process, which runs many tasks."""
    if blob not in _ranks:
        _ranks.clear()
        _ranks[blob] = Ranks(blob)
    return _ranks[blob]


def vocabulary(path: str) -> bytes:
    """The rank file; it is read on the driver and sent along, so that executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def encode(docs: DataFrame, blob: bytes, pattern: str, emit: str = "digest") -> DataFrame:
    """Encode every text of docs (doc_id, text) and decode the ids again.

    emit="digest": doc_id, n_tokens, ids_sha256, decoded_sha256.
    emit="ids": all columns of docs plus tokens (array<int>).
    emit="both": doc_id, source, tokens and the digests.
    Null counts as an empty text, which has no tokens. Repeated rows give
    equal results; an empty table gives an empty result. Columns of docs
    named like new ones are replaced.
    """
    slim_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(blob)  # under a megabyte, whatever the input
    passed = [c for c in {"digest": ["doc_id"], "ids": docs.columns, "both": ["doc_id", "source"]}[emit] if c != "tokens" and (emit == "ids" or c not in DIGESTS)]
    new = [*(["tokens"] if emit != "digest" else []), *(DIGESTS if emit != "ids" else [])]
    kinds = {"tokens": ArrayType(IntegerType()), "n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}
    own = docs.select(*passed, *([] if "text" in passed else ["text"]))

    def rows(batches):
        coder = Encoder(_loaded(shared.value), pattern)
        for batch in batches:
            array = texts(batch.column(batch.schema.get_field_index("text")))
            for at, block in pieces(array):
                ids, edges = coder.encode(block)
                columns = dict(zip(batch.schema.names, batch.slice(at, len(block)).columns, strict=True))
                columns["tokens"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
                if emit != "ids":
                    flat = coder.ranks.decode(ids)
                    cut = np.concatenate([[0], np.cumsum(coder.ranks.length[ids])])[edges]
                    sha = lambda a, e: [hashlib.sha256(a[i:j]).hexdigest() for i, j in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)]
                    columns |= {"n_tokens": pa.array(np.diff(edges)), "ids_sha256": pa.array(sha(ids.astype("<u4"), edges)), "decoded_sha256": pa.array(sha(flat, cut))}
                yield pa.RecordBatch.from_arrays([columns[c] for c in (*passed, *new)], [*passed, *new])

    return own.mapInArrow(lean(rows), StructType([*(own.schema[c] for c in passed), *(StructField(c, kinds[c]) for c in new)]))

"""Language-model scoring by an Elias-Fano n-gram trie.

Training counts all n-grams up to three tokens in two passes. The first
counts words: a word's id is the rank of its hash, so the dictionary is a
sorted list in shards. The second counts pairs and triples of ids and builds
the trie in shards: contexts, pairs and triples are rising Elias-Fano
sequences, the pointers from a level to the next likewise, with smoothed
log-probabilities in a byte each. A word's value stands relative to its
context, so a look-up goes from the context's pointers to the range of its
followers, and searches the successor of the word there. Scoring maps the
shards from the shared folder into memory and looks n-grams up batch by batch.
The probabilities are interpolated by absolute discounting; what unigrams
leave goes to the unknown token.

A pair (v, w) belongs to shard S * (before(v) + count(v) * before(w) / N) / N,
where before(x) counts the tokens with smaller ids: shards get equal parts of
all pairs, whatever their first words are, so a hot word is spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import EliasFano, Files, Level, read, remove, write
from .lexer import Block, blocks, mix, per_doc, texts
from .store import place, slim_batches

#: Bytes of training text for a shard; tokens that a task counts before it passes counts on.
SHARD_BYTES, FLUSH = 8 << 20, 1_500_000
NO_THIRD = np.uint32(2**32 - 1)
END = mix(np.array([0x0E4D], np.uint64))[0]
#: Tokens (some 8 MB of text) that are looked up at once, as each look-up opens nearly all shards; shards of n-grams for one of words.
SCORE_TOKENS, WORD_SHARE = 1_250_000, 8


def held_out() -> F.Column:
    """crc32 of the id as text, modulo 10, is 0; a null id counts as an empty text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 10 == 0


def tokens(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of END, words, END of each text, and the edges between texts. A-Z count as a-z. The first END is context only."""
    b = Block(texts(array), lower=True)
    b.words()
    n = np.diff(b.wd)
    edges = np.concatenate([[0], np.cumsum(n + 2)])
    seq = np.full(int(edges[-1]), END)
    at = np.ones(len(seq), bool)
    at[edges[:-1]] = at[edges[1:] - 1] = False
    seq[at] = b.hashes(b.ws, b.we)
    return seq, edges


def discount(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 else 0.5


# --- dictionary --------------------------------------------------------------------------------------------------


def _word_counts(shards: int):
    shift = np.uint64(32)

    def emit(h, c):
        home = ((h >> shift) * np.uint64(shards) >> shift).astype(np.int64)
        cut = np.searchsorted(home, np.arange(shards + 1))
        use = np.flatnonzero(np.diff(cut))
        raw = [(int(s), h[cut[s] : cut[s + 1]].tobytes(), c[cut[s] : cut[s + 1]].astype(np.uint32).tobytes()) for s in use]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*raw, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "a", "b"])

    def rows(batches):
        held: list = []
        size = 0
        for batch in batches:
            for part, _ in blocks(batch, "text"):
                seq, edges = tokens(part.column(0))
                seq = np.delete(seq, edges[:-1])
                held.append(np.unique(seq, return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield emit(*_summed(held))
                    held, size = [], 0
        if held:
            yield emit(*_summed(held))

    return rows


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def _by_shard(batches):
    """The rows of one shard after another: (shard, columns a.. of bytes)."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


class Words:
    """The dictionary: for hashes ids, counts and how many tokens have smaller ids."""

    def __init__(self, base: str, meta: dict):
        self.m, self.files = meta, Files(base)

    def shard(self, s: int) -> dict[str, np.ndarray]:
        return self.files[f"words-{s}"]

    def look(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """id (-1: unknown), count, before."""
        n, m = len(sorted_hashes), self.m
        ids, count, before = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        home = ((sorted_hashes >> np.uint64(32)) * np.uint64(m["word_shards"]) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if n else []
        for a, z in zip(cut, [*cut[1:], n], strict=True):
            s = int(home[a])
            if not m["words"][s]:
                continue
            f = self.shard(s)
            h = sorted_hashes[a:z]
            at = np.minimum(np.searchsorted(f["hash"], h), len(f["hash"]) - 1)
            hit = np.flatnonzero(f["hash"][at] == h)
            ids[a + hit] = at[hit] + m["id_base"][s]
            count[a + hit] = f["count"][at[hit]]
            before[a + hit] = f["before"][at[hit]] + m["count_base"][s]
        return ids, count, before


def _home(cv, bv, bw, total: int, shards: int) -> np.ndarray:
    return np.minimum((shards * ((bv + cv * (bw / total)) / total)).astype(np.int64), shards - 1)


# --- pairs and triples -------------------------------------------------------------------------------------------


def packed(pair: np.ndarray, third: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted distinct n-grams with counts in few bytes: each level once, first words as differences, byte planes compressed."""
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    key = pair[first]
    v = (key >> np.uint64(32)).astype(np.uint32)
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    levels = [np.diff(v[start], prepend=np.uint32(0)), np.diff(np.append(start, len(v))), key & np.uint64(0xFFFFFFFF), np.diff(np.append(first, len(pair))), third, count]
    planes = np.concatenate([np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel() for x in levels])
    sizes = np.array([len(start), len(key), len(pair)], "<u4").tobytes()
    return sizes + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(blob[:12], "<u4").astype(np.int64)
    sizes = n[[0, 0, 1, 1, 2, 2]]
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(blob[12:], int(sizes.sum()) * 4, asbytes=True), np.uint8)
    ends = np.cumsum(sizes) * 4
    levels = [np.ascontiguousarray(planes[e - 4 * k : e].reshape(4, -1).T).ravel().view("<u4") for k, e in zip(sizes, ends, strict=True)]
    v = np.repeat(np.cumsum(levels[0], dtype=np.uint64), levels[1])
    return np.repeat(v << np.uint64(32) | levels[2].astype(np.uint64), levels[3]), levels[4], levels[5]


def _ngram_counts(words: Words):
    def emit(parts):
        pair, third, home = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((third, pair, home))
        pair, third, home = pair[order], third[order], home[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
        count = np.diff(np.append(first, len(pair))).astype(np.uint32)
        pair, third, home = pair[first], third[first], home[first]
        cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
        raw = [(int(home[a]), packed(pair[a:z], third[a:z], count[a:z])) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        for k in range(0, len(raw), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*raw[k : k + 64], strict=True), (pa.int32(), pa.binary()), strict=True)], ["shard", "a"])

    def rows(batches):
        held: list = []
        size = 0
        for batch in batches:
            for part, _ in blocks(batch, "text"):
                seq, edges = tokens(part.column(0))
                known, at = np.unique(seq, return_inverse=True)
                ids, count, before = words.look(known)
                x = ids[at].astype(np.uint64)
                first = np.ones(len(x), bool)
                first[edges[1:] - 1] = False
                i = np.flatnonzero(first)  # a pair begins at every place but a text's last
                third = np.full(len(i), NO_THIRD)
                more = np.flatnonzero(first[i + 1])
                third[more] = x[i[more] + 2].astype(np.uint32)
                v, w = at[i], at[i + 1]
                held.append((x[i] << np.uint64(32) | x[i + 1], third, _home(count[v], before[v], before[w], words.m["tokens"], words.m["shards"])))
                size += len(i)
                if size > FLUSH:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return rows


def _quantised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each log10, and the table of their 256 values."""
    p = np.log10(np.maximum(p, 1e-12))
    low, high = (p.min(), p.max()) if len(p) else (0.0, 0.0)
    step = max((high - low) / 255, 1e-9)
    return np.round((p - low) / step).astype(np.uint8), low + step * np.arange(256)


def _levels(pair: np.ndarray, third: np.ndarray, count: np.ndarray, counts_of) -> tuple[dict, dict]:
    """The levels of one shard from its sorted distinct (pair, third), and the counts of their entries."""
    new = np.concatenate([[True], pair[1:] != pair[:-1]])
    first = np.flatnonzero(new)
    key, c2 = pair[first], np.add.reduceat(count, first)
    v, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    real = third != NO_THIRD
    kinds = np.bincount((np.cumsum(new) - 1)[real], minlength=len(key))
    arrays = EliasFano.build(v[starts]).parts("contexts") | Level.build(np.diff(np.append(starts, len(v))), w).parts("pairs") | Level.build(kinds, third[real].astype(np.int64)).parts("triples")
    return arrays, {"c1": counts_of(v[starts]), "c2": _narrow(c2), "c3": _narrow(count[real])}


def _narrow(count: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    return count.astype(np.min_scalar_type(int(count.max()) if len(count) else 0))


def _probabilities(arrays: dict, counts: dict, d2: float, d3: float) -> tuple[dict, list[tuple[int, float]]]:
    """Smoothed probabilities of a shard's entries in a byte each, and what its first and last contexts leave."""
    children = lambda name: np.diff((at := EliasFano.of(arrays, f"{name}.at")).access(np.arange(at.n)))
    kinds2, kinds3 = children("pairs"), children("triples")
    c1, c2, c3 = (counts[k].astype(np.int64) for k in ("c1", "c2", "c3"))
    left1, left2 = d2 * kinds2 / c1, np.where(kinds3 > 0, d3 * kinds3 / c2, 1.0)
    out = {}
    for name, p in (("left1", left1), ("left2", left2), ("p2", (c2 - d2) / np.repeat(c1, kinds2)), ("p3", (c3 - d3) / np.repeat(c2, kinds3))):
        code, table = _quantised(p)
        out |= {name: code, f"{name}.table": table}
    ends = sorted({0, len(c1) - 1})
    contexts = EliasFano.of(arrays, "contexts").access(np.array(ends))
    return out, [(int(v), float(left1[i])) for v, i in zip(contexts, ends, strict=True)]


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[str, dict]:
    """The folder of the model and its small table of contents (a few numbers a shard). docs: the training rows."""
    spark = docs.sparkSession
    slim_batches(spark)
    base = place(spark, "lm")
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    shards = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))

    word_shards = max(1, shards // WORD_SHARE)  # words are far fewer than n-grams

    def dictionary(batches):
        for s, held in _by_shard(batches):
            h, c = _summed([(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)) for a, b in held])
            write(f"{base}/words-{s}", {"hash": h, "count": c, "before": np.cumsum(c) - c})
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (s, len(h), int(c.sum()), int((c == 1).sum()), int((c == 2).sum()))], ["shard", "n", "total", "n1", "n2"])

    got = own.mapInArrow(_word_counts(word_shards), "shard int, a binary, b binary").repartition(word_shards, "shard").sortWithinPartitions("shard").mapInArrow(dictionary, "shard long, n long, total long, n1 long, n2 long").collect()
    per = {k: np.zeros(word_shards, np.int64) for k in ("n", "total")}
    for r in got:
        per["n"][r.shard], per["total"][r.shard] = r.n, r.total
    meta = {
        "word_shards": word_shards, "shards": shards, "words": per["n"], "id_base": np.cumsum(per["n"]) - per["n"], "count_base": np.cumsum(per["total"]) - per["total"],
        "vocabulary": int(per["n"].sum()), "tokens": int(per["total"].sum()), "d1": discount(sum(r.n1 for r in got), sum(r.n2 for r in got)), "split": (np.zeros(0, np.int64), np.zeros(0)), "built": np.zeros(shards, bool),
    }
    if not meta["tokens"]:
        return base, meta
    words = Words(base, meta)

    def counts_of(ids):
        """Counts by id, from the dictionary's shards."""
        s = np.searchsorted(meta["id_base"], ids, "right") - 1
        out = np.zeros(len(ids), np.int64)
        for k in np.unique(s):
            use = s == k
            out[use] = words.shard(int(k))["count"][ids[use] - meta["id_base"][k]]
        return out

    def build(batches):
        for s, held in _by_shard(batches):
            pair, third, count = (np.concatenate(x) for x in zip(*(unpacked(blob) for (blob,) in held), strict=True))
            order = np.lexsort((third, pair))
            pair, third, count = pair[order], third[order], count[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
            arrays, counts = _levels(pair[first], third[first], np.add.reduceat(count, first), counts_of)
            write(f"{base}/levels-{s}", arrays)
            write(f"{base}/counts-{s}", counts)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (s, *(int((counts[k] == n).sum()) for k in ("c2", "c3") for n in (1, 2)))], ["shard", "p1", "p2", "t1", "t2"])

    built = own.mapInArrow(_ngram_counts(words), "shard int, a binary").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(build, "shard long, p1 long, p2 long, t1 long, t2 long").collect()
    # The discounts are those of the whole corpus, however many shards there are.
    d2, d3 = (discount(sum(r[f"{k}1"] for r in built), sum(r[f"{k}2"] for r in built)) for k in "pt")

    def smooth(batches):
        for batch in batches:
            for s in batch.column(0).to_pylist():
                probabilities, ends = _probabilities(read(f"{base}/levels-{s}"), read(f"{base}/counts-{s}"), d2, d3)
                write(f"{base}/probabilities-{s}", probabilities)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(ends)), pa.array([e[0] for e in ends]), pa.array([e[1] for e in ends])], ["shard", "context", "left"])

    ends = spark.createDataFrame([(r.shard,) for r in built], "shard long").repartition(len(built), "shard").mapInArrow(smooth, "shard long, context long, left double").collect()
    # Only now, as a lost task would read them again.
    remove([f"{base}/counts-{r.shard}" for r in built])
    split: dict[int, float] = {}
    for r in ends:
        meta["built"][r.shard] = True
        split[r.context] = split.get(r.context, 0.0) + r.left
    meta["split"] = (np.array(sorted(split), np.int64), np.log10(np.array([split[k] for k in sorted(split)])))
    return base, meta


# --- scoring -----------------------------------------------------------------------------------------------------


def _opened_levels(a: dict[str, np.ndarray]) -> tuple[EliasFano, Level, Level]:
    """A shard's contexts, pairs and triples."""
    return EliasFano.of(a, "contexts"), Level.of(a, "pairs"), Level.of(a, "triples")


def _opened_probabilities(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Codes (name#) and what they stand for."""
    names = ("left1", "left2", "p2", "p3")
    return {k: a[f"{k}.table"][np.arange(256)] for k in names} | {f"{k}#": a[k] for k in names}


class Model:
    def __init__(self, base: str, meta: dict):
        self.m, self.words, self.levels, self.probabilities = meta, Words(base, meta), Files(base, _opened_levels), Files(base, _opened_probabilities)
        self.unknown = np.log10(max(meta["d1"] * meta["vocabulary"] / meta["tokens"], 1e-12)) if meta["tokens"] else 0.0

    def score(self, seq: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each text of tokens()."""
        m = self.m
        known, at = _distinct(seq)
        ids, count, before = self.words.look(known)
        scored = np.ones(len(seq), bool)
        scored[edges[:-1]] = False
        base = np.log10((count + 0.1) / (m["tokens"] + 0.1 * (m["vocabulary"] + 1)))[at]
        n_known = per_doc((count[at] > 0) & scored, edges)
        base = per_doc(base * scored, edges)
        if not m["tokens"]:
            return np.diff(edges) - 1, n_known, base, per_doc(np.log10(1.0) * scored, edges)
        p1 = np.where(count > 0, np.log10(np.maximum(count - m["d1"], 1e-9) / m["tokens"]), self.unknown)
        # pairs: (place of the first word, place of the second) in `known`
        i = np.flatnonzero(scored)
        pair, pair_of = _distinct(at[i - 1].astype(np.int64) << 32 | at[i])
        v, w = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
        home = np.where(ids[v] >= 0, _home(count[v], before[v], np.where(ids[w] >= 0, before[w], 0), m["tokens"], m["shards"]), -1).astype(np.int32)
        # triples: (number of the pair before, place of the word)
        has = np.flatnonzero(scored[i - 1] if len(i) else i)
        triple, triple_of = _distinct(pair_of[has - 1].astype(np.int64) << 32 | at[i[has]])
        up, tw = (triple >> 32).astype(np.int32), (triple & 0xFFFFFFFF).astype(np.int32)
        a2, g1 = np.full(len(pair), -np.inf), np.zeros(len(pair))
        g2, a3 = np.zeros(len(pair)), np.full(len(triple), -np.inf)
        number = np.full(len(pair), -1, np.int32)
        order, torder = np.argsort(home, kind="stable"), np.argsort(home[up], kind="stable")
        cut, tcut = np.searchsorted(home[order], np.arange(m["shards"] + 1)), np.searchsorted(home[up][torder], np.arange(m["shards"] + 1))
        for s in np.flatnonzero((np.diff(cut) > 0) & m["built"]):
            (contexts, pairs, triples), q = self.levels[f"levels-{s}"], self.probabilities[f"probabilities-{s}"]
            mine = order[cut[s] : cut[s + 1]]
            distinct, back = np.unique(ids[v[mine]], return_inverse=True)
            where = contexts.find(distinct)
            known_context = where >= 0
            ranges = np.zeros((3, len(distinct)), np.int64)
            ranges[:, known_context] = pairs.children(where[known_context])
            where = where[back]
            hit = where >= 0
            g1[mine[hit]] = q["left1"][q["left1#"][where[hit]]]
            ok = np.flatnonzero(hit & (ids[w[mine]] >= 0))
            entry = np.full(len(mine), -1, np.int64)
            entry[ok] = pairs.find(*ranges[:, back[ok]], ids[w[mine[ok]]])
            got = np.flatnonzero(entry >= 0)
            a2[mine[got]] = q["p2"][q["p2#"][entry[got]]]
            g2[mine[got]] = q["left2"][q["left2#"][entry[got]]]
            own = torder[tcut[s] : tcut[s + 1]]
            own = own[ids[tw[own]] >= 0]
            if len(own):
                number[mine] = -1
                number[mine[got]] = np.arange(len(got))
                row = number[up[own]]
                own, row = own[row >= 0], row[row >= 0]
                below = np.array(triples.children(entry[got]))
                found = triples.find(*below[:, row], ids[tw[own]])
                a3[own[found >= 0]] = q["p3"][q["p3#"][found[found >= 0]]]
        contexts, left = m["split"]
        if len(contexts):
            k = np.minimum(np.searchsorted(contexts, ids[v]), len(contexts) - 1)
            whole = contexts[k] == ids[v]
            g1[whole] = left[k[whole]]
        p2 = np.logaddexp(a2 * np.log(10), (g1 + p1[w]) * np.log(10)) / np.log(10)
        p = p2[pair_of]
        if len(has):
            p[has] = (np.logaddexp(a3 * np.log(10), (g2[up] + p2[pair_of[has]][_first(triple_of, len(triple))]) * np.log(10)) / np.log(10))[triple_of]
        out = np.zeros(len(seq))
        out[i] = np.minimum(p, 0.0)
        return np.diff(edges) - 1, n_known, base, per_doc(out, edges)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, and where among them each key is, in four bytes."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, at.astype(np.int32)


def gathered(batches):
    """Record batches of whole texts, of about SCORE_TOKENS tokens together (one at least), with their tokens as tokens() gives them for all."""
    held: list = []
    size = 0

    def joined():
        parts, seqs, edges = zip(*held, strict=True)
        begin = np.cumsum([0, *map(len, seqs)])
        return parts, np.concatenate(seqs), np.concatenate([[0], *(e[1:] + b for e, b in zip(edges, begin, strict=False))])

    for batch in batches:
        for part, b in blocks(batch, "text"):
            held.append((part, *tokens(b.array)))
            size += len(held[-1][1])
            if size >= SCORE_TOKENS:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _first(inverse: np.ndarray, n: int) -> np.ndarray:
    """For each distinct value a place where it stands."""
    out = np.zeros(n, np.int64)
    out[inverse] = np.arange(len(inverse))
    return out


_models: dict[str, Model] = {}


def _model(base: str, meta: dict) -> Model:
    if base not in _models:
        _models.clear()
        _models[base] = Model(base, meta)
    return _models[base]


def score(docs: DataFrame, base: str, meta: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Null counts as empty; an empty text has one token, its end. Repeated rows
    score alike; extra columns are left out; an empty table gives an empty
    result. Without training rows all scores are 0 and the base is uniform.
    """
    slim_batches(docs.sparkSession)

    def rows(batches):
        model = _model(base, meta)
        for parts, seq, edges in gathered(batches):
            got = model.score(seq, edges)
            ends = np.cumsum([part.num_rows for part in parts])
            for part, z in zip(parts, ends.tolist(), strict=True):
                n, known, plain, p = (x[z - part.num_rows : z] for x in got)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(known), pa.array(np.full(len(n), meta["tokens"])), pa.array(plain), pa.array(p)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own = docs.select("doc_id", "text", held_out().alias("held_out"))
    return own.mapInArrow(rows, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

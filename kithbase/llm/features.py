"""Per-document counts and ratios from whole texts, vectorised; shared by the quality operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexer import Block, mix, per_doc, repeats, salted

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_CLASSES = {
    "symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": b"0123456789", "stops": b".!?", "commas": b",;:", "quotes": b"\"'()[]{}", "exclaims": b"!", "bars": b"|", "at": b"@+=/\\_~^`",
}
TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
#: Names of the columns of features().
NAMES = (
    "log_words", "word_length", "symbols", "upper", "digits", "stops", "commas", "quotes", "exclaims", "bars", "at",
    "wide", "line_words", "dup_lines", "repeat_words", "distinct_words", "long_words", "short_words", "top_word", "capital_words",
)


def base_counts(b: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, exact (up to 64-bit hash collisions)."""
    b.words()
    n_words = np.diff(b.wd)
    lead = (b.data & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": per_doc(lead & b.solid, b.off), "n_symbols": per_doc(SYMBOL[b.data], b.off)}
    b.lines()
    before = np.concatenate([[0], np.cumsum(b.solid)])
    filled = before[b.le] > before[b.ls]
    doc = np.repeat(np.arange(b.n), np.diff(b.ld))
    later, _ = repeats(mix(b.hashes(b.ls[filled], b.le[filled]) ^ salted(doc[filled].astype(np.uint64), 3)))
    out["n_dup_lines"] = np.bincount(doc[filled][later], minlength=b.n)
    h, wdoc = b.hashes(b.ws, b.we), b.doc_of_word()
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        whole = wdoc[2:] == wdoc[:-2]
        key = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) ^ salted(wdoc[:-2].astype(np.uint64), 4)
        at = np.flatnonzero(whole)
        _, again = repeats(key[at])
        at = at[again]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = per_doc(covered, b.wd)
    b.word_hash, b.word_doc = h, wdoc
    return out


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def features(b: Block) -> np.ndarray:
    """One row of NAMES for each text; every text has one, empty ones too."""
    c = base_counts(b)
    n_bytes, words = np.maximum(np.diff(b.off), 1), np.maximum(c["n_words"], 1)
    lengths = b.we - b.ws
    share = lambda table: per_doc(table[b.data], b.off) / n_bytes
    later, _ = repeats(b.word_hash ^ salted(b.word_doc.astype(np.uint64), 5))
    n_lines = np.diff(b.ld)
    first = b.data[b.ws] if len(b.ws) else np.zeros(0, np.uint8)
    columns = [np.log1p(c["n_words"]), c["word_chars"] / words]
    columns += [share(TABLES[k]) for k in _CLASSES]
    columns += [
        per_doc(b.data >= 0x80, b.off) / n_bytes, c["n_words"] / np.maximum(n_lines, 1), c["n_dup_lines"] / np.maximum(n_lines, 1), c["n_repeat_words"] / words,
        1 - per_doc(later, b.wd) / words, per_doc(lengths > 12, b.wd) / words, per_doc(lengths <= 3, b.wd) / words,
        _top_share(b, words), per_doc(TABLES["upper"][first], b.wd) / words,
    ]
    return np.column_stack(columns)


def _top_share(b: Block, words: np.ndarray) -> np.ndarray:
    """Share of the most frequent word."""
    top = np.zeros(b.n)
    if len(b.word_hash):
        order = np.lexsort((b.word_hash, b.word_doc))
        h, d = b.word_hash[order], b.word_doc[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
        np.maximum.at(top, d[new], np.diff(np.append(new, len(h))))
    return top / words


def sampled(docs: DataFrame, labels: DataFrame, wanted: Column, label: str, sample: int) -> DataFrame:
    """id, text, y of at most `sample` labelled ids of those wanted: a top-k by hash of the id, so it is bounded and may be broadcast; other texts don't move.

    An id with several labels has the largest, one with several texts that of the least hash.
    """
    picked = labels.filter(wanted & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("y")).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("id", "text", "y")
    return own.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("id", "text", "y")

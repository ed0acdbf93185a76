"""Quality rules: exact base counts, and a calibrated logistic regression over hashed word and character n-grams.

A text's features are the relative frequencies of its hashed words, word
pairs and runs of four bytes, each family in a table of its own. The
regression is trained on a bounded sample of labelled rows; a fifth of them,
not used in the fit, calibrates the probability (Platt scaling). A text is
kept where its probability reaches a fixed threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import base_counts, base_failed, sampled
from .lexer import Block, blocks, mix, per_doc
from .store import slim_batches

BITS = 14
FAMILIES = ("word", "pair", "bytes4")
#: Most labelled rows that the fit uses: those with the lowest hashes of their ids.
SAMPLE = 4_000
THRESHOLD = 0.5
STEPS, PENALTY = 150, 1e-4
#: Features that a step of the fit holds at once, beside the table of all.
AT_ONCE = 1 << 18


@dataclass
class Regression:
    weights: np.ndarray  # a row for each family
    bias: float
    slope: float
    shift: float

    def probability(self, b: Block) -> np.ndarray:
        """Of a block whose base counts have been taken: the calibrated logistic of the sum of weights by relative frequency. Texts without n-grams of a family get nothing from it."""
        z = np.full(b.n, self.bias)
        for w, (keys, edges) in zip(self.weights, grams(b), strict=True):
            z += per_doc(w[keys], edges) / np.maximum(np.diff(edges), 1)
        return 1 / (1 + np.exp(-(self.slope * z + self.shift)))


def grams(b: Block):
    """For each family the table places of its n-grams in order, and the edges between texts."""
    top = np.uint64(64 - BITS)
    h, doc = b.word_hash, b.word_doc
    yield (h >> top).astype(np.int64), b.wd
    same = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, np.int64)
    pair = mix(h[same] * np.uint64(3) + h[same + 1]) if len(same) else np.zeros(0, np.uint64)
    yield (pair >> top).astype(np.int64), np.searchsorted(same, b.wd)
    d = b.data
    if len(d) < 4:
        yield np.zeros(0, np.int64), np.zeros(b.n + 1, np.int64)
        return
    run = d[:-3].astype(np.uint32)
    for k in range(1, 4):
        run |= d[k : len(d) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    run = (run * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    inside = np.ones(len(run), bool)
    for k in range(1, 4):  # a run that begins less than four bytes before the end of a text isn't whole
        at = b.off[1:] - k
        at = at[(at >= 0) & (at < len(run))]
        inside[at] = False
    edges = np.concatenate([[0], np.cumsum(inside)])[np.minimum(b.off, len(run))]
    yield run[inside].astype(np.int64), edges


def _train_rows(batches):
    """id, y, and the places and values of each text's features."""
    for batch in batches:
        for part, b in blocks(batch, "text", 1 << 18):
            base_counts(b)
            keys = []
            for f, (places, edges) in enumerate(grams(b)):
                doc = np.repeat(np.arange(b.n), np.diff(edges))
                cell, n = np.unique(doc << 20 | f << BITS | places, return_counts=True)
                keys.append((cell >> 20, cell & 0xFFFFF, n / np.maximum(np.diff(edges), 1)[cell >> 20]))
            doc, place, value = (np.concatenate(x) for x in zip(*keys, strict=True))
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(b.n + 1)).astype(np.int32)
            places = pa.ListArray.from_arrays(cut, pa.array(place[order].astype(np.int32)))
            values = pa.ListArray.from_arrays(cut, pa.array(value[order].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), places, values], ["id", "y", "places", "vals"])


def _sums(index: np.ndarray, weights, size: int) -> np.ndarray:
    """Sums by index of weights(slice), slice by slice."""
    out = np.zeros(size)
    for k in range(0, len(index), AT_ONCE):
        at = slice(k, k + AT_ONCE)
        out += np.bincount(index[at], weights(at), size)
    return out


def fit(y: np.ndarray, rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> Regression:
    """rows, places, values: the non-zero features. Without rows, or with one class, the probability is that class's smoothed share (0.5 for no rows)."""
    dims, n = len(FAMILIES) << BITS, len(y)
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    w = np.zeros(dims)
    if n < 10 or y.min() == y.max():
        return Regression(w.reshape(len(FAMILIES), -1), bias, 1.0, 0.0)
    check = np.arange(n) % 5 == 4
    use = ~check[rows]
    r, p, v = rows[use], places[use], values[use].astype(np.float32)
    # Relative frequencies are small; scaling each feature by its root mean square lets plain Adam converge in few steps.
    scale = 1 / np.sqrt(_sums(p, lambda at: v[at].astype(float) ** 2, dims) / max(1, (~check).sum()) + 1e-6)
    for k in range(0, len(p), AT_ONCE):
        v[k : k + AT_ONCE] *= scale[p[k : k + AT_ONCE]]
    # One constant for all rows, so that what is fitted is what scores: the mean square length of a row is 1.
    length = np.sqrt(_sums(r, lambda at: v[at].astype(float) ** 2, n).sum() / max(1, (~check).sum()))
    v /= length
    m1, m2, b1, b2 = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = _sums(r, lambda at: w[p[at]] * v[at], n) + bias
        err = np.where(check, 0, 1 / (1 + np.exp(-z)) - y) / (~check).sum()
        g, gb = _sums(p, lambda at: v[at] * err[r[at]], dims) + PENALTY * w / dims, err.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        w -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        bias -= 0.05 * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
    w = w * scale / length
    z = _sums(rows, lambda at: w[places[at]] * values[at], n)
    spread = z[~check].std() + 1e-9
    w, z = w / spread, z / spread
    slope, shift = 1.0, 0.0
    for _ in range(300):  # Newton steps of the calibration, on rows the fit hasn't seen
        q = 1 / (1 + np.exp(-(slope * z[check] + shift)))
        e, h = q - y[check], q * (1 - q) + 1e-6
        gs, gt = (e * z[check]).sum() + 1e-2 * slope, e.sum()
        hss, hst, htt = (h * z[check] ** 2).sum() + 1e-2, (h * z[check]).sum(), h.sum() + 1e-3
        det = hss * htt - hst * hst + 1e-12
        ds, dt = (htt * gs - hst * gt) / det, (hss * gt - hst * gs) / det
        slope, shift = slope - np.clip(ds, -1, 1), shift - np.clip(dt, -1, 1)
        if abs(ds) + abs(dt) < 1e-8:
            break
    return Regression(w.reshape(len(FAMILIES), -1), 0.0, float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Regression:
    """Fits on at most `sample` labelled ids, one text each; only their hashed features reach the driver."""
    slim_batches(docs.sparkSession)
    own = sampled(docs, labels, F.col(label).isNotNull(), label, sample)
    got = own.mapInArrow(_train_rows, f"id {own.schema['id'].dataType.simpleString()}, y double, places array<int>, vals array<float>").toArrow()
    got = got.sort_by([("id", "ascending"), ("y", "ascending")])
    got = got.combine_chunks()
    column = lambda c: x.chunk(0) if isinstance(x := got.column(c).combine_chunks(), pa.ChunkedArray) else x
    counts = np.asarray(column("places").value_lengths())
    rows = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return fit(np.asarray(got.column("y"), float), rows, np.asarray(column("places").flatten()), np.asarray(column("vals").flatten()))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Regression, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, quality_probability and kept of each row, scored in Arrow batches.

    Null and empty texts have no words and fail; repeated rows fare alike;
    extra columns are left out; an empty table gives an empty result.
    """
    slim_batches(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            for part, b in blocks(batch, "text"):
                c = base_counts(b)
                failed, p = base_failed(c), model.probability(b)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], ["doc_id", *COUNTS, "base_failed", "quality_probability", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, quality_probability double, kept boolean")

"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into quantile bins. Cyclic boosting visits one feature after
another and adds a small multiple of a shallow regression tree (two splits
of the feature's bins) to that feature's table; then the pairs whose joint
bins explain most of what is left get tables of their own. A score is the
logistic of a sum of table look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .features import NAMES, features, sampled
from .lexer import blocks
from .store import lean, slim_batches

BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, PRIOR = 64, 12, 6, 200, 0.1, 5.0
#: Most labelled rows that the fit uses: those with the lowest hashes of their ids.
SAMPLE = 20_000


@dataclass
class Additive:
    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], "right") for j in {j for p in self.pairs for j in p}}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _quantiles(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + PRIOR)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of the best tree with at most three leaves over ordered bins."""
    gain = lambda a, b: a * a / (b + PRIOR)
    edges = [0, len(g)]
    for _ in range(2):
        best = (1e-9, None)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            gains = gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain(cg[-1], ch[-1])
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (gains[k], lo + k + 1)
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Additive:
    """Fits the model. One class only (or no rows): a constant model near that class's share (or 0.5)."""
    n, d = len(y), len(NAMES)
    x = x if n else np.zeros((1, d))
    cuts, pair_cuts = [_quantiles(x[:, j], BINS) for j in range(d)], [_quantiles(x[:, j], PAIR_BINS) for j in range(d)]
    share = (y.sum() + 0.5) / (n + 1)
    model = Additive(cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts], [], pair_cuts, [])
    if not n or y.min() == y.max():
        return model
    fine = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(pair_cuts)]
    logit = np.full(n, model.base)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(fine[j], g, size), np.bincount(fine[j], h, size))
            model.tables[j] += step
            logit += step[fine[j]]
    g, h = slopes()
    joint = {}
    for i in range(d):
        for j in range(i + 1, d):
            k = len(pair_cuts[j]) + 1
            cell, size = coarse[i] * k + coarse[j], (len(pair_cuts[i]) + 1) * k
            joint[i, j] = (np.bincount(cell, g, size) ** 2 / (np.bincount(cell, h, size) + PRIOR)).sum()
    model.pairs = sorted(joint, key=lambda p: (-joint[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)) for i, j in model.pairs]
    for _ in range(rounds // 4):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            cell = coarse[i] * table.shape[1] + coarse[j]
            gi, hi = np.bincount(cell, g, table.size).reshape(table.shape), np.bincount(cell, h, table.size).reshape(table.shape)
            # a tree of depth two: split one feature, then the other on each side
            rows = _tree(gi.sum(1), hi.sum(1))
            step = np.zeros_like(table)
            for v in np.unique(rows):
                step[rows == v] = _tree(gi[rows == v].sum(0), hi[rows == v].sum(0))
            table += RATE * step
            logit += RATE * step.reshape(-1)[cell]
    return model


def fold(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3; remainder 1 is held out. A null id counts as an empty text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 3


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """id, text, y of at most `sample` labelled ids outside the held-out fold."""
    return sampled(docs, labels, F.col(label).isNotNull() & (fold("doc_id") != 1), label, sample)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    slim_batches(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            for part, block in blocks(batch, "text"):
                x = features(block)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(x[:, j]) for j in range(len(NAMES)))], ["id", "y", *NAMES])

    own = labelled(docs, labels, sample=sample)
    got = own.mapInArrow(lean(rows), f"id {own.schema['id'].dataType.simpleString()}, y double, " + ", ".join(f"{n} double" for n in NAMES)).toPandas().sort_values(["id", "y"])
    return fit(got[list(NAMES)].to_numpy(float), got["y"].to_numpy(float))


def scored(docs: DataFrame, model: Additive, keep: float | None = None) -> DataFrame:
    """All columns of docs plus quality_score; with `keep`, only rows that score at least that (and no extra column)."""
    slim_batches(docs.sparkSession)
    if keep is None:
        docs = docs.drop("quality_score")
    schema = StructType([*docs.schema.fields, *([] if keep is not None else [StructField("quality_score", DoubleType())])])

    def rows(batches):
        for batch in batches:
            for part, block in blocks(batch, "text"):
                p = model.score(features(block))
                if keep is None:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, "quality_score"])
                else:
                    yield part.filter(pa.array(p >= keep))

    return docs.mapInArrow(lean(rows), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    Null and empty texts are scored as texts without words; repeated rows get
    equal scores; extra columns are left out; an empty table gives an empty
    result; without labels every score is 0.5.
    """
    model = train(docs, labels, sample)
    out = scored(docs.select("doc_id", "text"), model).withColumnRenamed("quality_score", "score")
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

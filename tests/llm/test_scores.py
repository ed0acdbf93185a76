"""Scores of the quality operators, and the mix, against slow versions in plain Python."""

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithbase.llm import features, gam, lexer, mixing, ngram_quality

MASK = 2**64 - 1
SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def word_hash(word):
    total, power = 0, 1
    for b in word.encode():
        total = (total + int(lexer.BYTE[b]) * power) & MASK
        power = power * lexer.BASE & MASK
    return mixed((total + len(word.encode())) & MASK)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_rules_probability(tables):
    """The verdict from word, pair and byte n-grams counted one by one."""
    docs, labels = tables
    model, top = ngram_quality.train(docs, labels), 64 - ngram_quality.BITS
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in ngram_quality.judge(docs, model).collect():
        t = texts[r.doc_id]
        h, data = [word_hash(w) for w in words(t)], t.encode()
        families = [[x >> top for x in h], [mixed((a * 3 + b) & MASK) >> top for a, b in zip(h, h[1:])]]
        families.append([(int.from_bytes(data[i : i + 4], "little") * 2654435761 & 0xFFFFFFFF) >> (32 - ngram_quality.BITS) for i in range(len(data) - 3)])
        z = model.bias + sum(sum(w[k] for k in keys) / max(1, len(keys)) for w, keys in zip(model.weights, families))
        p = 1 / (1 + math.exp(-(model.slope * z + model.shift)))
        assert r.quality_probability == pytest.approx(p, rel=1e-6, abs=1e-9) and r.kept == (not r.base_failed and p >= ngram_quality.THRESHOLD)


def feature_row(t):
    """features.NAMES of a text, one by one."""
    t = t or ""
    w, data, lines = words(t), t.encode(), t.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, own = Counter(windows), Counter(w)
    repeated = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    n_bytes, n = max(1, len(data)), max(1, len(w))
    sizes = [len(x.encode()) for x in w]
    shares = [sum(b in chars for b in data) / n_bytes for chars in features._CLASSES.values()]
    return [
        math.log1p(len(w)), sum(map(len, w)) / n, *shares, sum(b >= 0x80 for b in data) / n_bytes, len(w) / len(lines), dup / len(lines), len(repeated) / n,
        1 - (len(w) - len(own)) / n, sum(x > 12 for x in sizes) / n, sum(x <= 3 for x in sizes) / n, max(own.values(), default=0) / n, sum("A" <= x[0] <= "Z" for x in w) / n,
    ]


def test_additive_scores(tables):
    """Features and table look-ups one by one; the fold; labels only from outside it."""
    docs, labels = tables
    model = gam.train(docs, labels)
    assert gam.train(docs, labels.filter(gam.fold() != 1)).tables[0].tolist() == model.tables[0].tolist()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in gam.classify(docs, labels).collect():
        x = feature_row(texts[r.doc_id])
        total = model.base + sum(table[bisect_right(cut.tolist(), v)] for cut, table, v in zip(model.cuts, model.tables, x))
        total += sum(table[bisect_right(model.pair_cuts[i].tolist(), x[i])][bisect_right(model.pair_cuts[j].tolist(), x[j])] for (i, j), table in zip(model.pairs, model.pair_tables))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_rules_held_out(spark):
    """Fitted on one half of the labels, right on the other."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = ngram_quality.judge(docs, ngram_quality.train(docs, labels.filter(half))).join(labels.filter(~half), "doc_id").filter("NOT base_failed")
    rows = out.select(F.col("kept").cast("int").alias("k"), "quality").collect()
    assert len(rows) > 100 and sum(r.k == r.quality for r in rows) >= 0.97 * len(rows)


def test_sample_is_bounded(spark):
    """Text ids, and an id that repeats: one row of the sample."""
    docs = spark.createDataFrame([(f"d{i % 7}", f"text {i} of some words " * (i % 5)) for i in range(100)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(7)], "doc_id string, quality int")
    assert gam.labelled(docs, labels).count() == gam.labelled(docs, labels).select("id").distinct().count() > 0
    assert features.sampled(docs, labels, F.lit(True), "quality", 3).count() == 3
    assert gam.classify(docs, labels).count() == 100 and ngram_quality.judge(docs, ngram_quality.train(docs, labels)).count() == 100


def mixed_by_hand(rows, share=1.5, most=2):
    """times a document is taken, by (doc_id, source, size, hash): whole helpings, then the lowest hashes as long as what stands before them fits, the last if that lands nearer."""
    sources = sorted({s for _, s, _, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, x, n, _ in rows if x == s) for s in sources}
    target = dict(zip(sources, mixing.water_fill([sizes[s] for s in sources], [mixing.WEIGHTS[i % 3] for i in range(len(sources))], share, most)))
    out = {}
    for s in sources:
        own = [r for r in rows if r[1] == s]
        whole = min(most, int(target[s] // sizes[s])) if sizes[s] else 0
        left, by = target[s] - whole * sizes[s], Counter()
        for _, _, n, h in own:
            by[h] += n
        before, below = 0, 0
        for h in sorted(by):
            if before > left:
                break
            below = h + (2 * (left - before) > by[h])
            before += by[h]
        for i, _, _, h in own:
            out[i] = whole + (h < below and whole < most)
    return out


def test_mix_selection(spark, monkeypatch):
    rng = np.random.RandomState(8)
    rows = [(i, "w " * rng.randint(0, 60), ["a", "b", "c", "é", None][rng.randint(5)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", mixing._hash().alias("h")).collect()}
    want = mixed_by_hand([(i, s, len(words(t)), hashes[i]) for i, t, s in rows])
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert {i: r.taken for i, r in got.items()} == {i: want[i] * len(words(t)) for i, t, _ in rows}
    taken = {r["doc_id"]: r["count"] for r in mixing.mix(df, emit="rows").groupBy("doc_id").count().collect()}
    assert taken == {i: n for i, n in want.items() if n}


def test_many_sources(spark):
    """Each document a source of its own: nothing about a source passes through the driver."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i:05}") for i in range(2000)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    want = mixing.water_fill([1 + i % 7 for i in range(2000)], [mixing.WEIGHTS[i % 3] for i in range(2000)])
    assert len(rows) == 2000 and all(r.target == pytest.approx(want[r.doc_id]) and r.taken <= 2 * r.size for r in rows)

"""The trie against dictionaries of counts, and the sequences below it."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from kithbase.llm import lm
from kithbase.llm.eliasfano import EliasFano, Files, Level, read, write

END = None


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), END]


def test_elias_fano(tmp_path):
    rng = np.random.RandomState(1)
    for n, universe in ((0, 5), (1, 1), (5, 5), (1000, 10**6), (50_000, 2**40), (3000, 3001)):
        v = np.unique(rng.randint(0, universe, n)) if n else np.zeros(0, np.int64)
        write(f"file://{tmp_path}/x", EliasFano.build(v).parts("a"))
        e = EliasFano.of(read(f"file://{tmp_path}/x"), "a")
        assert (e.access(np.arange(len(v))) == v).all()
        place = {int(x): i for i, x in enumerate(v)}
        q = np.concatenate([v, rng.randint(0, universe, 500)])
        assert e.find(q).tolist() == [place.get(int(x), -1) for x in q]
    pointers = np.array([0, 0, 0, 7, 7, 9])
    assert EliasFano.build(pointers).access(np.arange(6)).tolist() == pointers.tolist()


def test_levels():
    """A child is found from its parent's pointers, and nowhere else: the same values stand below many parents."""
    rng = np.random.RandomState(4)
    counts = rng.randint(0, 9, 300) * (rng.rand(300) < 0.7)
    values = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in counts]).astype(np.int64)
    level = Level.build(counts, values)
    edges = np.concatenate([[0], np.cumsum(counts)])
    parent, value = np.repeat(np.arange(300), 45), np.tile(np.arange(45), 300)
    lo, hi, base = level.children(parent)
    assert (lo == edges[parent]).all() and (hi == edges[parent + 1]).all()
    want = [next((k for k in range(edges[p], edges[p + 1]) if values[k] == v), -1) for p, v in zip(parent.tolist(), value.tolist())]
    assert level.find(lo, hi, base, value).tolist() == want


def test_packed():
    rng = np.random.RandomState(9)
    pair = np.sort(rng.randint(0, 2**20, 5000).astype(np.uint64) << np.uint64(32) | rng.randint(0, 50, 5000).astype(np.uint64))
    third, count = rng.randint(0, 2**32, 5000, dtype=np.uint64).astype(np.uint32), rng.randint(1, 2**31, 5000).astype(np.uint32)
    for n in (1, 2, 5000):
        assert all((x[:n] == y).all() and len(y) == n for x, y in zip((pair, third, count), lm.unpacked(lm.packed(pair[:n], third[:n], count[:n]))))


def test_files(tmp_path, monkeypatch):
    """Files beyond the bounds are closed, the ones used last stay."""
    from kithbase.llm import eliasfano

    for i in range(5):
        write(f"file://{tmp_path}/f-{i}", {"a": np.full(100, i)})
    few = Files(f"file://{tmp_path}", lambda a: int(a["a"][0]), most=2)
    assert [few[f"f-{i}"] for i in (0, 1, 0, 2, 0, 3)] == [0, 1, 0, 2, 0, 3] and list(few.open) == ["f-0", "f-3"]
    monkeypatch.setattr(eliasfano, "_local", lambda uri: None)  # read through a file system, by bytes
    small = Files(f"file://{tmp_path}", lambda a: int(a["a"][0]), most_bytes=1700)
    assert [small[f"f-{i}"] for i in range(5)] == list(range(5)) and len(small.open) == 2 and small.bytes == 1600
    eliasfano.remove([f"file://{tmp_path}/f-0", f"file://{tmp_path}/gone"])
    assert not (tmp_path / "f-0").exists() and (tmp_path / "f-1").exists()


def brute(train, discounts):
    """Interpolated absolute discounting from dictionaries."""
    c1, c2, c3 = Counter(), Counter(), Counter()
    for t in train:
        s = tokens(t)
        c1.update(s)
        s = [END, *s]
        c2.update(zip(s, s[1:]))
        c3.update(zip(s, s[1:], s[2:]))
    k2, k3 = Counter(a for a, _ in c2), Counter((a, b) for a, b, _ in c3)
    n, (d1, d2, d3) = sum(c1.values()), discounts(c1, c2, c3)

    def p(u, v, w, first):
        q = (c1[w] - d1) / n if c1[w] else d1 * len(c1) / n
        if k2[v]:
            q = max(c2[v, w] - d2, 0) / c1[v] + d2 * k2[v] / c1[v] * q
        if not first and c2[u, v]:
            q = max(c3[u, v, w] - d3, 0) / c2[u, v] + d3 * k3[u, v] / c2[u, v] * q
        return q

    return c1, n, p


def test_scores_against_dictionaries(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_001, None), (10_002, ""), (10_003, "Unknownword anotherunknown the"), (10_004, "THE the The")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    d = lambda c: lm.discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    c1, n, p = brute(learn, lambda *c: tuple(map(d, c)))
    one = {r.doc_id: r for r in lm.score(df, *lm.train(df.filter(~lm.held_out()), 1 << 40)).collect()}
    many = {r.doc_id: r for r in lm.score(df, *lm.train(df.filter(~lm.held_out()), 1 << 15)).collect()}
    base = total = 0.0
    for i, t in rows:
        s = tokens(t)
        r = one[i]
        plain = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (len(c1) + 1))) for w in s)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(s), sum(c1[w] > 0 for w in s), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r.base_score, plain, rel_tol=1e-9) and math.isclose(many[i].base_score, plain, rel_tol=1e-9)
        s = [END, *s]
        want = sum(math.log10(p(s[k - 2] if k > 1 else None, s[k - 1], s[k], k == 1)) for k in range(1, len(s)))
        assert abs(r.score - want) <= 0.05 * len(s) and r.score <= 0
        assert abs(many[i].score - want) <= 0.05 * len(s)  # however many shards there are
        if r.held_out:
            base, total = base + r.base_score, total + r.score
    assert total > base
    some = list(c1)[:50] + [END]
    for v in some[:10]:  # what a context gives to all words and the unknown one adds up to one
        assert math.isclose(sum(p(some[0], v, w, False) for w in c1) + p(some[0], v, "never seen", False), 1, rel_tol=1e-6)


def test_small_batches_are_looked_up_together(spark, monkeypatch):
    """Shards are opened once for many batches, not for each, and scores don't depend on what is looked up together."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60)
    texts = [*(r.text for r in docs.collect()), None, ""]
    base, meta = lm.train(docs, 1 << 15)
    assert meta["shards"] > 3 * meta["word_shards"]
    batches = [pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["text"]) for t in texts]
    model, opened = lm.Model(base, meta), Counter()
    get = Files.__getitem__
    monkeypatch.setattr(Files, "__getitem__", lambda self, name: opened.update([name]) or get(self, name))
    [(parts, seq, edges)] = lm.gathered(batches)
    together = model.score(seq, edges)
    assert len(parts) == len(texts) and sum(k.startswith("levels-") for k in opened) > 3 and set(opened.values()) == {1}
    monkeypatch.setattr(lm, "SCORE_TOKENS", 1)
    alone = [model.score(seq, edges) for _, seq, edges in lm.gathered(batches)]
    assert len(alone) == len(texts)
    for one, all_ in zip(zip(*alone, strict=True), together, strict=True):
        assert (np.concatenate(one) == all_).all()

"""Near duplicates against brute force, and the sketch's expectation."""

import re
from collections import Counter, defaultdict

import numpy as np

from kithbase.llm import neardup


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(docs, similarity=0.8):
    """class by id: transitive closure of all pairs that share a shingle and reach the similarity."""
    bags, home = {i: bag(t or "") for i, t in docs}, {i: i for i, _ in docs}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    index, same = defaultdict(list), {}
    for i, t in docs:
        if (t or "") in same:
            home[max(root(i), root(same[t or ""]))] = min(root(i), root(same[t or ""]))
        same.setdefault(t or "", i)
        for s in bags[i]:
            index[s].append(i)
    pairs = {(a, b) for ids in index.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        both = sum((bags[a] & bags[b]).values())
        if both >= similarity * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            ra, rb = root(a), root(b)
            home[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i, _ in docs}


def test_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    from kithbase.llm.queries import QUERIES

    got = {r.doc_id: r.class_id for r in QUERIES["op1_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert got == classes(docs)


def test_hard_cases(spark, monkeypatch):
    """A chain of links, a bucket of texts that share a passage without being alike, short and wordless texts, counts that matter."""
    rng = np.random.RandomState(2)
    w = lambda n: " ".join(f"w{x}" for x in rng.randint(0, 10**6, n))
    base, docs = w(200).split(), []
    for i in range(30):  # a drift: neighbours alike, ends not
        docs.append(" ".join(base))
        at = rng.randint(0, 195)
        base[at : at + 4] = w(4).split()
    passage = w(100)
    docs += [f"{passage} {w(100)}" for _ in range(40)]
    docs += ["", None, "  ", "\n", "a b", "a b", "a b c", "x " * 50, "x " * 60, "x " * 200]
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values()) and all(r.group_size == sum(c == r.class_id for c in want.values()) for r in got.values())
    monkeypatch.setattr(neardup, "PART", 2)  # texts that aren't frequent are joined by key
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want
    kept = sorted(r.doc_id for r in neardup.deduplicated(df.union(df.filter("doc_id in (0, 40)"))).collect())
    assert kept == sorted(set(want.values()))


def test_prefix_filter(spark, monkeypatch):
    """Mutated copies of one text near the threshold, of several lengths, some with repeated shingles: every pair that reaches the similarity is a candidate, and few others are."""
    rng = np.random.RandomState(5)
    base, docs = [f"w{x}" for x in rng.randint(0, 10**6, 150)], []
    for _ in range(120):
        text = list(base[: rng.randint(100, 151)]) if rng.rand() < 0.5 else list(base)
        for at in rng.randint(0, len(text), rng.randint(0, 7)):
            text[at] = f"w{rng.randint(0, 10**6)}"
        docs.append(" ".join(text + text[:20] * rng.randint(0, 3)))
    docs += ["a", "a b", "a b c d e", "", "x " * 50, "x " * 60]
    key = [f"{i:05}".encode() for i in range(len(docs))]
    texts = spark.createDataFrame([(k, k, t) for k, t in zip(key, docs, strict=True)], "cid binary, comp binary, text string")
    found = []
    for most in (neardup.MEMBERS_PER_TASK, 5):  # shingles in many prefixes are dealt over tasks
        monkeypatch.setattr(neardup, "MEMBERS_PER_TASK", most)
        found.append({tuple(sorted((bytes(r.cid), bytes(r.rep)))) for r in neardup._unsettled(texts, 0.8).collect()})
    got = found[0]
    assert found[1] == got
    bags = [bag(t) for t in docs]
    want, every = set(), 0
    for i, a in enumerate(bags):
        for j in range(i + 1, len(bags)):
            both = sum((a & bags[j]).values())
            every += both > 0
            if both and both >= 0.8 * (sum(a.values()) + sum(bags[j].values()) - both):
                want.add((key[i], key[j]))
    assert want and want <= got and len(got) < every / 2


def test_hubs(spark, monkeypatch):
    """A node whose edges are dealt over many tasks."""
    monkeypatch.setattr(neardup, "MEMBERS_PER_TASK", 7)
    edges = [(50, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 220)] + [(220, 50), (7, 8), (8, 9)]
    got = {r.cid: r.comp for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 50 for i in (50, *range(100, 160), *range(200, 221))}, 7: 7, 8: 7, 9: 7}


def test_halves_agree():
    """Texts of other weights see the same points as far as both reach: a larger weight only adds earlier ones."""
    element = np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B9)
    s = [neardup.signatures(np.zeros(3, np.int64), element, np.array([w, 1, 2]), 1)[0] for w in (3, 5, 8, 13, 64, 100)]
    for a, b in zip(s, s[1:]):
        assert (b <= a).all() and (b < a).any() and (a == b).any()


def test_agreement_is_weighted_jaccard():
    rng = np.random.RandomState(0)
    error = []
    for _ in range(40):
        element = rng.randint(0, 2**62, 50).astype(np.uint64)
        a, b = rng.randint(0, 9, 50), rng.randint(0, 9, 50)
        b = np.where(rng.rand(50) < 0.6, a, b)
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = neardup.signatures(doc, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        error.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.015 and np.std(error) < 0.06
    for _ in range(40):  # large weights
        element = rng.randint(0, 2**62, 6).astype(np.uint64)
        a, b = rng.randint(1, 300, 6), rng.randint(1, 300, 6)
        s = neardup.signatures(np.repeat([0, 1], 6), np.concatenate([element, element]), np.concatenate([a, b]), 2)
        error.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error[40:])) < 0.015 and np.std(error[40:]) < 0.06


def test_sketches_of_short_texts_take_little_memory():
    """Texts are sketched some at a time, with the bands that they have all at once: thousands of short ones in a block would take hundreds of MB."""
    import tracemalloc

    import pyarrow as pa

    from kithbase.llm.lexer import Block

    block = Block(pa.array(["" if i % 7 == 0 else " ".join(f"w{i * k % 997}" for k in range(1, 12)) for i in range(2000)]))
    doc, s, n = neardup.shingles(block)
    neardup.banded(Block(block.array.slice(0, 3)))
    tracemalloc.start()
    has, got = neardup.banded(block)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    some = doc < 450
    want = neardup.bands(neardup.signatures(doc[some], s[some], n[some], 450))[has[:450]]
    assert (got[: len(want)] == want).all() and len(got) == has.sum() == 2000 - len(range(0, 2000, 7))

"""Near duplicates by BagMinHash: weighted Jaccard of multisets of five-word shingles.

A shingle that stands c times in a text has weight c. Weights are cut into
the dyadic intervals [0,1), [1,2), [2,4), ...; each (shingle, interval) has a
Poisson process, whose points carry a time and a signature slot. Processes are
hierarchical: once the first point of an interval is known, it falls to one
half of the interval, and both halves go on as processes of their own, down to
single steps of weight. Halves above the weight are dropped as a whole, so
texts of different weights see the same points as far as both reach. A slot's
value is the earliest time of its points, so two texts agree in a slot with
the probability of their weighted Jaccard similarity. Only points up to a
bound are made at all: some m * ln(m) for a text of any length.

Slots are banded; texts that share a band are candidates (at a similarity of
0.8 all bands fail five times in a million). In each bucket the members are
compared with one representative, then with four more, by the exact
overlap of multisets. The representative is the member that meets most
others over all buckets: of a text and its many copies, the text itself.
Links join components; a bucket is done when all its members are in one.
What is then unsettled (texts that share a long passage with many others, say)
is settled exactly by a prefix filter: two texts of that similarity must share
a shingle among the fifth of their weight that comes first, the rarest first,
so passages that many share bring no candidates. So no bucket's pairs are all
made, and no link that joins two components is missed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexer import Block, blocks, mix, salted
from .store import discard, lean, slim_batches, stash

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
SLOTS = BANDS * ROWS
UNIT = 40  # times are integers, in 2**-40
NEVER = np.uint64(2**64 - 1)
MEMBERS_PER_TASK = 1000
#: Texts that are sketched at once: each takes some 2,500 points, however short it is.
TEXTS = 200
#: Classes with more than so small a part of all rows are known by name (a hundred thousand at most).
PART = 100_000
#: Rounds of representatives; and how many of the most frequent shingles of unsettled texts are known by name.
ROUNDS, COMMON = 2, 200_000


def shingles(b: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) of a block with counts, sorted by text and shingle. A text of fewer words has one shingle of all of them; a text without words none."""
    b.words()
    h, doc = b.hashes(b.ws, b.we), b.doc_of_word()
    n = np.diff(b.wd)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = (n > 0) & (n < words)
    parts, docs = [], []
    if len(h) >= words:
        at = np.flatnonzero(doc[words - 1 :] == doc[: len(doc) - words + 1])
        s = np.zeros(len(at), np.uint64)
        for k in range(words):
            s = mix(s + h[at + k])
        parts.append(s)
        docs.append(doc[at])
    for d in np.flatnonzero(short):
        s = np.zeros(1, np.uint64)
        for x in h[b.wd[d] : b.wd[d + 1]]:
            s = mix(s + x)
        parts.append(s)
        docs.append(np.array([d]))
    s, d = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])]))
    return d[new], s[new], np.diff(np.append(new, len(s)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n rows of `slots` earliest times; rows of texts without elements are NEVER throughout."""
    out = np.full((n, slots), NEVER)
    total = np.bincount(doc, weight, n)
    # A row for each (element, interval): [0,1), [1,2), [2,4), ... as far as the weight reaches.
    spans = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), spans)
    k = np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans)
    width = np.where(k < 2, 1, np.left_shift(1, np.maximum(k - 1, 0)))
    low = np.where(k == 0, 0, width)
    seed = salted(element[row] + k.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), 7)
    who, reach = doc[row], weight[row]
    bound = slots * (np.log(slots) + 3.0) / np.maximum(total, 1)
    active = np.arange(len(row))
    while len(active):
        limit = (bound * 2.0**UNIT).astype(np.uint64)
        single, wide = active[width[active] == 1], active[width[active] > 1]
        steps = _halved(out, who[wide], seed[wide], low[wide], width[wide], reach[wide], limit, slots)
        _points(out, np.concatenate([who[single], steps[0]]), np.concatenate([seed[single], steps[1]]), np.concatenate([np.zeros(len(single), np.uint64), steps[2]]), limit, bound, slots)
        missing = (out == NEVER).any(1) & (total > 0)
        bound = np.where(missing, bound * 2, bound)
        active = active[missing[who[active]]]
    return out


def _gap(bits: np.ndarray, rate: np.ndarray | int = 1) -> np.ndarray:
    """Exponential waiting times from random bits, as integers in units of time."""
    return (-np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * (2.0**UNIT / rate)).astype(np.uint64)


def _fall(out, who, point, time, slots) -> None:
    """Lets points fall into their slots."""
    slot = ((mix(point ^ np.uint64(0xA5A5A5A55A5A5A5A)) & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out.reshape(-1), who * slots + slot, time)


def _halved(out, who, seed, low, width, reach, limit, slots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points of wide intervals, by recursive halving; returns the single steps (who, seed, time of the last point) that go on by themselves.

    A process is an interval with the time of its next point. A point falls
    into its slot as soon as all of its interval lies below the weight; which
    half it belongs to, and when the other half's next point comes, depends on
    the shingle and the interval alone.
    """
    time, point = _gap(mix(seed ^ np.uint64(0x51ED270B)), width), mix(seed + np.uint64(0x2545F4914F6CDD1D))
    fallen = np.zeros(len(who), bool)
    ended: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    while len(who):
        on = np.flatnonzero((time <= limit[who]) & (low < reach))
        who, seed, low, width, reach, time, point, fallen = (x[on] for x in (who, seed, low, width, reach, time, point, fallen))
        now = ~fallen & (low + width <= reach)
        _fall(out, who[now], point[now], time[now], slots)
        fallen = fallen | now
        leaf = width == 1
        ended.append((who[leaf], seed[leaf], time[leaf]))
        who, seed, low, width, reach, time, point, fallen = (x[~leaf] for x in (who, seed, low, width, reach, time, point, fallen))
        half = width >> 1
        right = (mix(seed ^ np.uint64(0x94D049BB)) >> np.uint64(63)).astype(np.int64)  # which half the point belongs to
        parts = []
        for own in (True, False):
            side = right if own else 1 - right
            child = mix(seed * np.uint64(0x9E3779B97F4A7C15) + side.astype(np.uint64) + np.uint64(1))
            # The half without the point waits from here on for its own.
            t = time if own else time + _gap(mix(child ^ np.uint64(0x51ED270B)), half)
            p = point if own else mix(child + np.uint64(0x2545F4914F6CDD1D))
            parts.append((who, child, low + side * half, half, reach, t, p, fallen & own))
        who, seed, low, width, reach, time, point, fallen = (np.concatenate(x) for x in zip(*parts, strict=True))
    return tuple(np.concatenate(x) for x in zip(*ended, strict=True))


def _points(out, who, seed, time, limit, bound, slots) -> None:
    """Lets the points of single steps of weight, from a time on up to their text's limit, fall into their slots."""
    count = np.zeros(len(who), np.int64)
    while len(who):
        # as many points at once as are expected, one at least
        size = 1 + (bound[who] * 1.2).astype(np.int64)
        end = np.cumsum(size)
        at = np.repeat(np.arange(len(who)), size)
        number = np.arange(len(at)) - np.repeat(end - size, size) + count[at]
        bits = mix(seed[at] + (number + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        gap = _gap(bits)
        run = np.cumsum(gap)  # integers, so differences are exact
        t = run - np.repeat(run[end - size] - gap[end - size], size) + time[at]
        inside = np.flatnonzero(t <= limit[who][at])
        _fall(out, who[at[inside]], bits[inside], t[inside], slots)
        last = t[end - 1]
        on = last <= limit[who]
        who, seed, time, count = who[on], seed[on], last[on], (count + size)[on]


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of each row."""
    s = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(salted(np.arange(BANDS, dtype=np.uint64), 9), s.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h + s[:, :, k])
    return h.view(np.int64)


def overlap(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sorted multisets."""
    (a, ca), (b, cb) = (one, two) if len(one[0]) >= len(two[0]) else (two, one)
    if not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = float(np.minimum(ca[at], cb)[a[at] == b].sum())
    return both / (ca.sum() + cb.sum() - both)


def _cid(text: str = "text") -> Column:
    """The class of equal texts: 128 bits of digest."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def banded(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Which texts of the block have words, and a row of bands for each of these."""
    doc, s, n = shingles(b)
    has = np.bincount(doc, minlength=b.n) > 0
    out = [np.zeros((0, BANDS), np.int64)]
    for k in range(0, b.n, TEXTS):
        a, z = np.searchsorted(doc, [k, k + TEXTS])
        if z > a:
            some = has[k : k + TEXTS]
            out.append(bands(signatures(doc[a:z] - k, s[a:z], n[a:z], len(some)))[some])
    return has, np.concatenate(out)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, cid, bands (empty for a text without words) of each row."""
    slim_batches(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            for part, b in blocks(batch, "text"):
                has, h = banded(b)
                off = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(off), pa.array(h.ravel()))], ["doc_id", "cid", "bands"])

    own = docs.select("doc_id", _cid().alias("cid"), "text")
    return own.mapInArrow(lean(rows), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, cid binary, bands array<long>")


def _shared(classes: DataFrame) -> DataFrame:
    """b, cid, degree of the members of all buckets with two at least; degree is how often a class meets others, over all its buckets."""
    bands = classes.select(F.explode("bands").alias("b"), "cid")
    members = bands.join(bands.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "b")
    degree = members.groupBy("cid").agg(F.sum(F.col("n") - 1).alias("degree"))
    return members.select("b", "cid").join(degree, "cid").select("b", "cid", "degree")


def _open(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """The members, with their component, of buckets in which two components meet."""
    placed = members.join(label, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")) if label is not None else members.withColumn("comp", F.col("cid"))
    ends = placed.groupBy("b").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("b")
    return placed.join(ends, "b", "left_semi")


def _representatives(members: DataFrame, used: DataFrame | None, number: int) -> DataFrame:
    """b, rep, rep_comp: up to 4**number members of each bucket that weren't representatives before, those of the highest degree. Found by partial aggregation: no bucket meets in one task."""
    free = members if used is None else members.join(used.select("b", F.col("rep").alias("cid")), ["b", "cid"], "left_anti")
    place = F.pmod(F.xxhash64("b", "cid", F.lit(number)), F.lit(4**number))
    best = free.groupBy("b", place.alias("place")).agg(F.max(F.struct("degree", F.xxhash64("cid", "b").alias("draw"), "cid", "comp")).alias("m"))
    return best.select("b", F.col("m.cid").alias("rep"), F.col("m.comp").alias("rep_comp"), F.col("m.degree").alias("rep_degree"))


def _oriented(pairs: DataFrame) -> DataFrame:
    """cid, rep of the distinct pairs (cid, degree; rep, rep_degree): the one that meets more others is the representative, whichever side it stood on."""
    swap = F.struct("degree", "cid") > F.struct(F.col("rep_degree").alias("degree"), F.col("rep").alias("cid"))
    one, two = F.col("cid"), F.col("rep")
    return pairs.select(F.when(swap, two).otherwise(one).alias("cid"), F.when(swap, one).otherwise(two).alias("rep")).distinct()


def verify(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """cid, rep, similarity of the distinct pairs (cid, rep); payload has cid, text.

    A representative's text goes once to each task that compares members with
    it; one with many members is dealt over several tasks. The pairs are
    _oriented(), so what meets many others is the representative, and a
    member's text goes to its few representatives.
    """
    pairs = stash(pairs, "pairs")
    spans = stash(pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("int").alias("tasks")), "spans")
    # Only those with several tasks are looked up, a thousandth of the pairs at most; a small written table is broadcast.
    several = stash(spans.filter("tasks > 1"), "several")
    dealt = pairs.join(several, "rep", "left").withColumn("task", F.pmod(F.xxhash64("cid"), F.coalesce("tasks", F.lit(1))).cast("int"))
    member = dealt.join(payload, "cid").select("rep", "task", "cid", "text")
    head = spans.join(payload.withColumnRenamed("cid", "rep"), "rep").select("rep", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(None).cast("binary").alias("cid"), "text")

    def rows(batches):
        key, own = None, None
        for batch in batches:
            for part, b in blocks(batch, "text"):
                doc, s, n = shingles(b)
                cut = np.searchsorted(doc, np.arange(b.n + 1))
                reps, ids = part.column(0).to_pylist(), part.column(2).to_pylist()
                out = []
                for i in range(b.n):
                    bag = (s[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]])
                    if ids[i] is None:
                        key, own = reps[i], bag
                    elif key == reps[i]:
                        out.append((ids[i], reps[i], overlap(own, bag)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.float64()), strict=True)], ["cid", "rep", "similarity"])

    return member.union(head).repartition("rep", "task").sortWithinPartitions("rep", "task", F.asc_nulls_first("cid")).mapInArrow(lean(rows), "cid binary, rep binary, similarity double")


def _bags(df: DataFrame, rows, schema: str) -> DataFrame:
    """mapInArrow over (cid, comp, text): rows(part, doc, shingle, count) gives each block's record batch."""

    def run(batches):
        for batch in batches:
            for part, b in blocks(batch, "text"):
                yield rows(part, *shingles(b))

    return df.select("cid", "comp", "text").mapInArrow(lean(run), schema)


def _unsettled(texts: DataFrame, similarity: float) -> DataFrame:
    """cid, rep: the pairs of different components among the texts (cid, comp, text) that can reach the similarity.

    Shingles are put into one order: those not known as common by their hash,
    then the common ones by frequency. If two texts share no shingle of their
    prefixes, all they share lies behind the end of the shorter reaching
    prefix, and is less than the needed part of that text. Any order will do
    for that; this one keeps frequent shingles out of most prefixes.

    From the first shared shingle on, a pair can share no more than either
    text has left there. What it needs grows with both sizes, so the smaller
    text of a pair is found by (1-s)/(1+s) of its weight already, and a match
    counts only if what is left on both sides suffices. That holds at the first
    match if at any (later ones leave less), so the condition of the join is exact.
    """

    def counted(part, doc, s, n):
        h, c = np.unique(s, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["s", "n"])

    frequent = _bags(texts, counted, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter("n >= 4").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    # At most COMMON pairs of numbers, whatever the input.
    key, often = np.asarray(frequent["s"]).astype(np.int64).view(np.uint64), np.asarray(frequent["n"]).astype(np.int64)
    order = np.argsort(key)
    key, often = key[order], often[order]

    def prefixes(part, doc, s, n):
        f = np.zeros(len(s), np.int64)
        if len(key):
            at = np.minimum(np.searchsorted(key, s), len(key) - 1)
            f = np.where(key[at] == s, often[at], 0)
        by = np.lexsort((s, f, doc))
        doc, s, n = doc[by], s[by], n[by]
        total = np.bincount(doc, n, part.num_rows)
        run = np.cumsum(n) - n
        first = np.searchsorted(doc, np.arange(part.num_rows))
        before = run - run[np.minimum(first, max(0, len(run) - 1))][doc] if len(run) else run
        use = before <= (1 - similarity) * total[doc] + 1e-6
        take, size = pa.array(doc[use]), total[doc[use]].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(s[use].view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(size), pa.array(size - before[use])], ["s", "cid", "comp", "size", "left"])

    rows = _bags(texts, prefixes, "s long, cid binary, comp binary, size long, left long")
    shared = rows.groupBy("s").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("s")
    # Sizes of a pair differ by the factor of the similarity at most, so their bands (a little wider) are the same or neighbours.
    band = F.floor(F.log(F.col("size").cast("double")) / (-np.log(similarity) * 1.001)).cast("int")
    rows = stash(rows.join(shared, "s", "left_semi").withColumn("band", band), "prefixes")
    part = similarity / (1 + similarity)
    # A key that many texts share is dealt over several tasks, each with all of the smaller texts and some of the others.
    tasks = stash(rows.groupBy("s", "band").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("int").alias("tasks")), "tasks")
    large = rows.join(tasks, ["s", "band"]).withColumn("task", F.pmod(F.xxhash64("cid"), F.col("tasks")).cast("int")).drop("tasks")
    small = rows.filter(F.col("left") >= 2 * part * F.col("size") - 1e-6).select("s", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), *[F.col(c).alias(f"small_{c}") for c in ("cid", "comp", "size", "left")])
    small = small.join(tasks, ["s", "band"]).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    ordered = (F.col("small_size") < F.col("size")) | ((F.col("small_size") == F.col("size")) & (F.col("small_cid") < F.col("cid")))
    enough = F.least("left", "small_left") >= part * (F.col("size") + F.col("small_size")) - 1e-6
    pairs = stash(large.join(small, ["s", "band", "task"]).filter(ordered & enough & (F.col("comp") != F.col("small_comp"))).select("cid", F.col("small_cid").alias("rep")).distinct(), "candidates")
    degree = pairs.select("cid").union(pairs.select("rep")).groupBy("cid").agg(F.count(F.lit(1)).alias("degree"))
    return _oriented(pairs.join(degree, "cid").join(degree.select(F.col("cid").alias("rep"), F.col("degree").alias("rep_degree")), "rep"))


def components(edges: DataFrame) -> DataFrame:
    """cid, comp: the least member of each connected component of the edges (u, v). Labels spread to neighbours and jump along themselves until none changes; nothing is collected.

    A node with many edges sends its label to as many tasks as its edges are
    dealt over.
    """
    every = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct()
    hubs = every.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MEMBERS_PER_TASK).select(F.col("v").alias("hub"), F.ceil(F.col("n") / MEMBERS_PER_TASK).cast("int").alias("tasks"))
    hubs = stash(hubs, "hubs")
    task = F.coalesce(F.pmod(F.xxhash64("u"), F.col("tasks")).cast("int"), F.lit(0))
    both = stash(every.join(hubs, F.col("v") == F.col("hub"), "left").select("u", "v", task.alias("task")), "edges")
    label = stash(both.groupBy(F.col("u").alias("cid")).agg(F.min("v").alias("m")).select("cid", F.least("cid", "m").alias("comp")), "label")
    while True:
        sent = label.join(hubs, F.col("cid") == F.col("hub"), "left").select(F.col("cid").alias("v"), F.col("comp").alias("there"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tasks") - 1, F.lit(0)))).alias("task"))
        near = both.join(sent, ["v", "task"]).groupBy(F.col("u").alias("cid")).agg(F.min("there").alias("near"))
        step = label.join(near, "cid").select("cid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # All may have one label by now, so that the jump is a join with a hot key: only labels that lead further are looked up.
        further = label.filter(F.col("cid") != F.col("comp")).select(F.col("cid").alias("comp"), F.col("comp").alias("far"))
        jump = step.join(further, "comp", "left").select("cid", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        new = stash(jump, "label")
        discard(label)
        label = new.select("cid", "comp")
        label._kithbase_path = new._kithbase_path
        if new.filter(F.col("old") != F.col("comp")).isEmpty():
            discard(both, hubs)
            return label


def group(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(cid, comp, copies, first, size of every class of equal texts; doc_id, cid, bands of every row). comp is the group of near duplicates, first the least (doc_id, cid) in it, size its rows."""
    rows = stash(sketch(docs), "sketch")
    classes = stash(rows.groupBy("cid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "classes")
    members = every = stash(_shared(classes), "members")
    # Of each class one row, picked by class and id, so that the copies of a text don't meet in one task.
    picked = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", F.xxhash64("cid", "least").alias("k"))
    texts = docs.select(_cid().alias("cid"), F.coalesce("text", F.lit("")).alias("text"), "doc_id").select("cid", F.xxhash64("cid", "doc_id").alias("k"), "text")
    payload = stash(texts.join(picked, ["cid", "k"], "left_semi").dropDuplicates(["cid", "k"]).select("cid", "text"), "payload")
    known = used = label = None
    done = [every, payload]

    def settle(pairs: DataFrame) -> None:
        nonlocal known, label
        pairs = pairs if known is None else pairs.join(known.select("cid", "rep"), ["cid", "rep"], "left_anti")
        fresh = stash(verify(pairs, payload), "verified")
        done.append(fresh)
        known = fresh if known is None else known.union(fresh)
        discard(label)
        label = components(known.filter(F.col("similarity") >= similarity).select(F.col("cid").alias("u"), F.col("rep").alias("v")))

    for number in range(ROUNDS):
        members = stash(_open(members.select("b", "cid", "degree"), label), "open")
        reps = stash(_representatives(members, used, number), "representatives")
        done += [members, reps]
        if reps.isEmpty():
            break
        used = reps.select("b", "rep") if used is None else used.union(reps.select("b", "rep"))
        settle(_oriented(members.join(reps, "b").filter(F.col("comp") != F.col("rep_comp"))))
    else:
        rest = _open(members.select("b", "cid", "degree"), label).select("cid", "comp").distinct()
        rest = stash(payload.join(rest, "cid"), "unsettled")
        done.append(rest)
        if not rest.isEmpty():
            settle(_unsettled(rest, similarity))
    placed = classes.select("cid", "least", "copies")
    placed = placed.join(label, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")) if label is not None else placed.withColumn("comp", F.col("cid"))
    first = placed.groupBy("comp").agg(F.min(F.struct("least", "cid")).alias("first"), F.sum("copies").alias("size"))
    out = stash(placed.join(first, "comp").select("cid", "comp", "copies", "first", "size"), "groups")
    discard(*done, classes, label)
    return out, rows


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, group_size, kept of every row of docs (doc_id, text).

    class_id is the least doc_id among the texts that a chain of links of at
    least `similarity` joins; equal texts are always joined, null counts as
    empty. A text without words is joined with equal texts only. kept marks
    the row whose doc_id is class_id (all of them where ids repeat). Extra
    columns are left out; an empty table gives an empty result.
    """
    classes, rows = group(docs, similarity)
    # Rows of frequent texts find their class by a broadcast of PART rows at most, so no key of the other join is hot.
    most = classes.agg(F.sum("copies")).first()[0] or 0
    frequent, own = F.broadcast(classes.filter(F.col("copies") * PART > most)), rows.select("doc_id", "cid")
    rest = own.join(F.broadcast(classes.filter(F.col("copies") * PART > most).select("cid")), "cid", "left_anti").join(classes.filter(F.col("copies") * PART <= most), "cid")
    return own.join(frequent, "cid").unionByName(rest).select("doc_id", F.col("first.least").alias("class_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("first.least")).alias("kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group: the one with the least doc_id, of repeated rows any one."""
    classes, _ = group(docs, similarity)
    keep = classes.select(F.col("first.least").alias("_id"), F.col("first.cid").alias("_cid")).distinct()
    # The row goes as one struct, so that no column of docs can meet one of ours.
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), _cid().alias("cid"))
    chosen = marked.join(keep, (F.col("cid") == F.col("_cid")) & F.col("id").eqNullSafe(F.col("_id")))
    return chosen.dropDuplicates(["cid", "id"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

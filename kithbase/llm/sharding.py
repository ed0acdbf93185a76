"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are the sets of equal texts, each an item of its own. Best fit puts
equal sizes one after another into the tightest bin for as long as it holds
them, so all groups of a size are packed at once, and the packing runs over
the list of distinct sizes with their numbers. D distinct sizes are together
at least D * D / 2 bytes, so that list has at most the square root of twice
all bytes: 14 million for 100 TB. Which of the groups of a size goes where is
settled by their rank among them; all that touches groups or documents is
distributed.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.sorting import numbered
from .store import discard, stash

SHARDS = 24
#: Rows that are numbered together; groups that have more than so small a part of all rows are known by name (a hundred thousand at most).
ROWS_PER_RUN, PART = 50_000, 100_000


class RemainingTree:
    """Treap over (remaining capacity, bin): the tightest bin that still holds an item is one successor search."""

    __slots__ = ("root", "seed")

    def __init__(self):
        self.root, self.seed = None, 88172645463325252

    def _rank(self) -> int:
        x = self.seed
        x ^= (x << 13) & (2**64 - 1)
        x ^= x >> 7
        x ^= (x << 17) & (2**64 - 1)
        self.seed = x
        return x

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self._rank(), None, None]), right)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the smallest key whose capacity is at least `least`."""
        left, right = self._split(self.root, (least, -1))
        if right is None:
            self.root = left
            return None
        parent, node = None, right
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(left, right)
        return node[0]


Placed = list[list[tuple[int, int]]]


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int | None = None, counts: list[int] | None = None) -> tuple[Placed | None, int]:
    """For each size (in descending order) the bins its items go to, with how many go there, and how many bins are used.

    counts: items of each size (one by default). An item above the capacity
    gets a bin of its own. With `bins` set, no more bins than that are opened;
    None instead of places if not everything fits.
    """
    tree, out, used = RemainingTree(), [], 0
    for size, left in zip(sizes, counts or [1] * len(sizes), strict=True):
        placed = []
        while left:
            found = tree.take(size)
            if found is None:
                if bins is not None and used >= bins:
                    return None, used
                found, used = (max(capacity, size), used), used + 1
            # As long as an item fits, this bin stays the tightest one that holds it.
            some = min(left, found[0] // size)
            placed.append((found[1], some))
            left -= some
            tree.add((found[0] - size * some, found[1]))
        out.append(placed)
    return out, used


def pack(sizes: list[int], bins: int, counts: list[int] | None = None) -> Placed:
    """For distinct sizes in descending order, with the number of items of each, the bins 0 to bins - 1 they go to and how many go there.

    An item of at least a fair part of what is left gets a bin to itself. The
    others are packed best-fit decreasing at the smallest capacity at which
    all fit into the other bins (searched to a 20000th); the smallest
    capacity is what makes the bins nearly equal.
    """
    counts = list(counts or [1] * len(sizes))
    rest, single, at, out = sum(s * n for s, n in zip(sizes, counts, strict=True)), 0, 0, [[] for _ in sizes]
    while single < bins - 1 and at < len(sizes) and sizes[at] * (bins - single) >= rest:
        out[at].append((single, 1))
        rest, single, counts[at] = rest - sizes[at], single + 1, counts[at] - 1
        at += counts[at] == 0
    small, number, left = sizes[at:], counts[at:], bins - single
    if not small:
        return out
    low = max(-(-rest // left), small[0]) - 1  # too small
    high, best = low + 1, None
    while best is None or high - low > max(1, high // 20_000):
        middle = high if best is None else (low + high) // 2
        got, _ = best_fit_decreasing(small, middle, left, number)
        if got is not None:
            best, high = got, middle
        else:
            low = middle
            if best is None:
                high = middle + max(1, middle // 1000)
    for k, placed in enumerate(best, at):
        out[k] += [(single + b, n) for b, n in placed]
    return out


def _packed(groups: DataFrame, shards: int) -> DataFrame:
    """g1, g2, shard, n of groups (g1, g2, bytes, n)."""
    spark = groups.sparkSession
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("bytes")).toArrow()
    size, items = sizes["bytes"].to_pylist(), sizes["items"].to_pylist()
    # Groups are numbered by descending size, then by hash; a size's groups go to its bins in that order.
    ranked = numbered(groups.orderBy(F.desc("bytes"), "g1", "g2"), "place", 0)
    plan, start = [], 0
    for b, n, placed in zip(size, items, pack(size, shards, items), strict=True):
        ends, upto = [], start
        for _, k in placed:
            ends.append(upto := upto + k)
        plan.append((b, ends, [bin_ for bin_, _ in placed]))
        start += n
    # A row for each distinct size; written, so that Spark broadcasts it only if it is small.
    plan = stash(spark.createDataFrame(plan, "size long, ends array<long>, bins array<int>"), "plan")
    shard = F.get("bins", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
    return ranked.join(plan, F.col("bytes") == F.col("size")).select("g1", "g2", shard.alias("shard"), "n")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group of every row of docs (doc_id, text).

    law is `bytes`: the shards' sizes (UTF-8 bytes of text plus 8 a row) are
    as near to equal as whole groups allow, and rows of equal texts share a
    shard. A group larger than a shard's fair part has a shard of its own to
    itself as far as possible. Null text counts as empty and groups with it.
    slot numbers the rows of a shard from 0 without gaps; repeated rows get
    slots of their own. Very long texts are rows like others. Extra columns
    are left out. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stash(
        docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("second"), text).alias("g2")),
        "rows",
    )
    # Equal texts meet as sums only: each task adds up its copies before the shuffle.
    groups = stash(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    placed = stash(_packed(groups, shards), "placed")
    per_shard = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    # Rows of frequent texts find their shard by a broadcast, so no key of the other join is hot.
    most = sum(per_shard.values())
    frequent = placed.filter(F.col("n") * PART > most).select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("shard").alias("known"))
    marked = rows.join(F.broadcast(frequent), (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")), "left").drop("h1", "h2")
    own = ["doc_id", "size", "text_crc32", "g1", "g2", "shard"]
    rest = marked.filter("known IS NULL").drop("known").join(placed.filter(F.col("n") * PART <= most).select("g1", "g2", "shard"), ["g1", "g2"])
    homes = marked.filter("known IS NOT NULL").withColumnRenamed("known", "shard").select(own).union(rest.select(own))
    # The rows of a shard are numbered in runs, dealt by hash, so that no task has a whole shard.
    runs = F.array(*[F.lit(max(1, -(-per_shard.get(s, 0) // ROWS_PER_RUN))) for s in range(shards)])
    homes = stash(homes.withColumn("run", F.pmod(F.xxhash64("doc_id", "g1", F.lit(6)), F.get(runs, F.col("shard"))).cast("int")), "homes")
    counts = homes.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("m"))
    starts = stash(counts.select("shard", "run", (F.sum("m").over(W.partitionBy("shard").orderBy("run")) - F.col("m")).alias("start")), "starts")
    discard(rows, groups, placed)
    within = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "g1", "g2")) - 1
    out = homes.withColumn("within", within).join(starts, ["shard", "run"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.hex("g1").alias("group"))

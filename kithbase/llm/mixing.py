"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 36-bit hash of its id and text. A source's tokens are
summed by hash bucket; in cumulative order of the buckets the budget falls
into one of them, and only that boundary bucket is summed again by the next
bits. What results is a threshold for each source: documents below it are
taken (once more). The thresholds for the first and second helping are
nested, so a larger target takes a superset. Nothing is sorted by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.sorting import numbered
from .store import discard, stash

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BITS, LEVELS = 12, 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of the text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def water_fill(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets by weight that add up to share * sum(sizes), none above most * its size; the excess is dealt out again by weight."""
    budget, target = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        unit = budget / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in free:
                target[i] = weights[i] * unit
            break
        for i in full:
            target[i] = most * sizes[i]
            budget -= target[i]
        free = [i for i in free if i not in set(full)]
    return target


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (src, size) rows: src, source_size, target, as water_fill() gives them.

    Sources are ordered by code point, null last, and get the weights in turn.
    A round fixes all sources that reach their cap; only the sums of what is
    left pass through the driver, so there may be as many sources as rows.
    """
    totals = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    placed = numbered(totals.orderBy(F.col("src").isNull(), "src"), "place", 0)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    state = stash(placed.select("src", "source_size", weight.alias("weight"), F.when(F.col("source_size") > 0, F.lit(None)).otherwise(0.0).cast("double").alias("target")), "targets")
    budget = share * (state.agg(F.sum("source_size")).first()[0] or 0)
    cap = most * F.col("source_size")
    while True:
        free = state.filter("target IS NULL").agg(F.sum("weight")).first()[0]
        if not free:
            return state.drop("weight")
        level = F.col("weight") * F.lit(budget / free)
        full = F.col("target").isNull() & (level > cap)
        spent = state.filter(full).agg(F.sum(cap), F.count(F.lit(1))).first()
        filled = F.when(full, cap) if spent[1] else F.when(F.col("target").isNull(), level)
        new = stash(state.withColumn("target", F.coalesce("target", filled)), "targets")
        discard(state)
        state, budget = new, budget - (spent[0] or 0.0)


def _prefix(level: int) -> Column:
    """The first `level` digits of BITS bits of the hash."""
    return F.shiftright("h", BITS * (LEVELS - level))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """src, source_size, target, whole (helpings everyone gets), below (hash threshold of the partial helping).

    Level by level: sums by (source, next digit) within the boundary bucket
    of the level before. A histogram has at most 4096 rows a source; it is
    pre-aggregated in each task, so a hot source is no hot key. The state is a
    written table, so Spark knows its size and broadcasts it only if it is small.
    """
    state = targets.withColumns({"whole": F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(MOST)))).otherwise(0).cast("long")})
    state = state.withColumns({"left": F.col("target") - F.col("whole") * F.col("source_size"), "at": F.lit(0).cast("long")})
    for level in range(1, LEVELS + 1):
        state = stash(state, "thresholds")
        inside = rows.join(state.select(F.col("src").alias("s"), "at"), F.col("src").eqNullSafe(F.col("s")) & (_prefix(level - 1) == F.col("at")))
        sums = inside.groupBy("src", _prefix(level).alias("digit")).agg(F.sum("size").alias("n"))
        before = F.sum("n").over(W.partitionBy("src").orderBy("digit").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
        # The boundary bucket: the last one whose predecessors fit into what is left of the budget.
        cut = (
            sums.withColumn("before", before).join(state.select(F.col("src").alias("s"), "left"), F.col("src").eqNullSafe(F.col("s")))
            .filter(F.col("before") <= F.col("left")).groupBy("src").agg(F.max_by(F.struct("digit", "before", "n"), "digit").alias("b"))
        )
        state = state.join(cut.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")), "left").select(
            "src", "source_size", "target", "whole",
            F.when(F.col("b").isNull(), F.col("left")).otherwise(F.col("left") - F.col("b.before")).alias("left"),
            F.coalesce(F.col("b.digit"), F.shiftleft("at", BITS)).alias("at"),
        )
    state = stash(state, "thresholds")
    # Rows with the very hash `at` are equal rows (or collide): they are taken if that lands nearer to the target.
    last = rows.join(state.select(F.col("src").alias("s"), "at"), F.col("src").eqNullSafe(F.col("s")) & (F.col("h") == F.col("at"))).groupBy("src").agg(F.sum("size").alias("n"))
    return state.join(last.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")), "left").select(
        "src", "source_size", "target", "whole", (F.col("at") + F.when(2 * F.col("left") > F.coalesce("n", F.lit(0)), 1).otherwise(0)).alias("below")
    )


def _hash() -> Column:
    """36 bits of hash of id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(8), "doc_id", F.coalesce("text", F.lit(""))), 64 - BITS * LEVELS)


def _copies() -> Column:
    return F.col("whole") + F.when((F.col("h") < F.col("below")) & (F.col("whole") < int(MOST)), 1).otherwise(0)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, emit: str = "counts") -> DataFrame:
    """Mix documents so that each source's taken words come near its target.

    docs has doc_id, text, source; other columns are kept. emit="rows"
    returns every document as often as it is taken (0 to 2 times);
    emit="counts" returns doc_id, size, source_size, target, taken.

    Null text counts 0 words; null source is a source of its own, the last.
    A source of size 0 has target 0. Rows that are equal in id and text
    share one fate. An empty table gives an empty result. Reruns agree, as
    the choice depends on rows alone and not on their order.
    """
    rows = stash(docs.select("doc_id", F.col("source").alias("src"), word_count(F.col("text")).alias("size"), _hash().alias("h")), "mix")
    plan = stash(thresholds(rows, source_targets(rows, weights, share, most)), "plan")
    if emit == "counts":
        return rows.join(plan.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (_copies() * F.col("size")).alias("taken"))
    names = docs.columns
    kept = docs.select(F.struct(*names).alias("row"), _hash().alias("h"), F.col("source").alias("src")).join(plan.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")))
    return kept.withColumn("n", _copies()).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*[F.col("row").getField(c).alias(c) for c in names])

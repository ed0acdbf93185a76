"""What changed between two versions of a record's details."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fields that don't count when details are compared.
IGNORED = ("provenance", "modifiable", "nonexportable", "changeFlags", "databaseId", "normalizedNumber")


def plain(df: DataFrame, c: str) -> Column:
    """The value with '' and empty lists as NULL."""
    kind = dict(df.dtypes)[c]
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, F.col(c))
    return F.when(F.col(c) != "", F.col(c)) if kind == "string" else F.col(c)


def compared(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[plain(df, f).alias(f) if f in fields else F.col(f) for f in df.columns])


def distance(pairs: list[tuple[Column, Column]]) -> Column:
    """How many fields differ; blank equals NULL if the sides are compared()."""
    total = F.lit(0)
    for a, b in pairs:
        total = total + F.when(a.eqNullSafe(b), 0).otherwise(1)
    return total.cast("int")


def _occurrences(df: DataFrame, keys: list[str], fields: list[str], detail_id: str) -> DataFrame:
    """How many equal details of the group have smaller ids: equal multisets then match one to one."""
    return df.withColumn("nth", F.row_number().over(W.partitionBy(*keys, *fields).orderBy(detail_id)))


def exact(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], detail_id: str) -> tuple[DataFrame, DataFrame]:
    """Details of old and new without those that match exactly, as multisets."""
    a, b = (_occurrences(compared(x, fields), keys, fields, detail_id) for x in (old, new))
    on = [a[c].eqNullSafe(b[c]) for c in (*keys, *fields, "nth")]
    return a.join(b, on, "left_anti").select(*old.columns), b.join(a, on, "left_anti").select(*new.columns)


def same_contact(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, same: whether two records have the same multiset of details."""
    bag = lambda df, name: compared(df, fields).groupBy(key).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*fields)))).alias(name))
    return bag(old, "a").join(bag(new, "b"), key, "full").select(key, F.col("a").eqNullSafe(F.col("b")).alias("same"))


def _levels(old: list[tuple], new: list[tuple], width: int) -> list[tuple[int, int, int]]:
    """(i, j, distance) of the greedy pairs: always the smallest distance, of equal ones the smallest i, then j.

    Distances are numbers of differing fields, so the pairs come level by
    level. At a level the free rows that agree on some choice of the other
    fields stand in one list; the partner of a row is the first free one in
    the lists it belongs to. Time grows with rows times choices of fields, not
    with pairs of rows.
    """
    free_a, used, out = list(range(len(old))), [False] * len(new), []
    left = len(new)
    for level in range(width + 1):
        if not free_a or not left:
            break
        choices = list(combinations(range(width), width - level))
        lists: list[dict[tuple, list[int]]] = []
        for chosen in choices:
            at: dict[tuple, list[int]] = {}
            for j in range(len(new) - 1, -1, -1):
                if not used[j]:
                    at.setdefault(tuple(new[j][k] for k in chosen), []).append(j)  # the first is last
            lists.append(at)
        rest = []
        for i in free_a:
            best = None
            for chosen, at in zip(choices, lists, strict=True):
                found = at.get(tuple(old[i][k] for k in chosen))
                while found and used[found[-1]]:
                    found.pop()
                if found and (best is None or found[-1] < best):
                    best = found[-1]
            if best is None:
                rest.append(i)
            else:
                used[best] = True
                left -= 1
                out.append((i, best, level))
        free_a = rest
    return out


def _comparable(v):
    """Values that are equal as Spark has it: NaN is NaN, and lists and structs compare by their parts."""
    if isinstance(v, float):
        return "NaN" if v != v else v + 0.0
    if isinstance(v, list):
        return tuple(map(_comparable, v))
    return tuple((k, _comparable(x)) for k, x in v.items()) if isinstance(v, dict) else v


def _paired(keys: list[str], fields: list[str]):
    """mapInArrow over rows sorted by keys, side and detailId: pairs the two sides of each group, one group at a time."""

    def run(batches):
        now, sides, out = None, ([], []), []

        def close():
            (old_ids, old), (new_ids, new) = (([r[0] for r in s], [r[1] for r in s]) for s in sides)
            pairs = _levels(old, new, len(fields))
            out.extend((*now, "modified", old_ids[i], new_ids[j], d) for i, j, d in pairs)
            gone, fresh = {i for i, _, _ in pairs}, {j for _, j, _ in pairs}
            out.extend((*now, "deleted", x, None, None) for i, x in enumerate(old_ids) if i not in gone)
            out.extend((*now, "added", None, x, None) for j, x in enumerate(new_ids) if j not in fresh)

        def flush():
            nonlocal out
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*kinds, pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            out = []
            return pa.RecordBatch.from_arrays(arrays, [*keys, "change", "oldId", "newId", "distance"])

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "side", "detailId", *fields)]
            for row in zip(*columns, strict=True):
                group = row[: len(keys)]
                if group != now:
                    if now is not None:
                        close()
                    now, sides = group, ([], [])
                sides[row[len(keys)]].append((row[len(keys) + 1], tuple(map(_comparable, row[len(keys) + 2 :]))))
            if len(out) > 10_000:
                yield flush()
        if now is not None:
            close()
        if out:
            yield flush()

    return run


def pairing(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], detail_id: str) -> DataFrame:
    """keys, change, oldId, newId, distance.

    Exact matches go first, by joins. Of what is left, details of one id on
    both sides pair; then, in each group (record and type), the pairs of the
    smallest distance. What finds no partner was deleted or added. Groups with
    one side only never leave the JVM; a group with both is held by one task,
    which is what a record's changed details of one type amount to.
    """
    a, b = exact(old, new, keys, fields, detail_id)
    a, b = (compared(x, fields).withColumnRenamed(detail_id, "detailId").select(*keys, "detailId", *fields) for x in (a, b))
    # One row for each detail, with what it was and what it is, whichever of them is there: a single join tells pairs by id from the rest.
    side = lambda df, name: df.select(*keys, "detailId", F.struct(F.lit(True).alias("there"), *fields).alias(name))
    both = side(a, "a").join(side(b, "b"), [*keys, "detailId"], "full")
    by_id = both.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(*keys, F.lit("modified").alias("change"), F.col("detailId").alias("oldId"), F.col("detailId").alias("newId"), distance([(F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields]).cast("long").alias("distance"))
    lone = both.filter(F.col("a").isNull() | F.col("b").isNull()).select(*keys, "detailId", F.when(F.col("a").isNotNull(), 0).otherwise(1).alias("side"), F.coalesce("a", "b").alias("v"))
    met = lone.withColumn("met", F.min("side").over(W.partitionBy(*keys)) != F.max("side").over(W.partitionBy(*keys)))
    number = lambda x: F.when(x, F.col("detailId"))
    single = met.filter(~F.col("met")).select(*keys, F.when(F.col("side") == 0, "deleted").otherwise("added").alias("change"), number(F.col("side") == 0).alias("oldId"), number(F.col("side") == 1).alias("newId"), F.lit(None).cast("long").alias("distance"))
    kinds = ", ".join(f"{k} {dict(old.dtypes)[k]}" for k in keys)
    groups = met.filter("met").select(*keys, "side", "detailId", *[F.col(f"v.{f}").alias(f) for f in fields])
    greedy = groups.repartition(*keys).sortWithinPartitions(*keys, "side", "detailId").mapInArrow(_paired(keys, fields), f"{kinds}, change string, oldId long, newId long, distance long")
    return by_id.unionByName(single).unionByName(greedy)

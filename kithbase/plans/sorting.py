"""Sort orders with explicit places for blanks, and ranks without a single-partition window."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import availability
from ..functions.text import blank
from ..sources.shared import stash
from .binding import Binding


@dataclass(frozen=True)
class Sort:
    """One key. blanks: first or last, whatever the direction. No field: whether a detail of the type exists. locale: a collation that overrides case_sensitive."""

    type: str
    field: str | None = None
    descending: bool = False
    blanks: str = "last"
    case_sensitive: bool = True
    locale: str | None = None


def collated(c: Column, key: Sort) -> Column:
    if key.locale:
        return F.collate(c, key.locale)
    return F.collate(c, "UTF8_BINARY_RTRIM") if key.case_sensitive else F.lower(c)


def compile_sort(b: Binding, df: DataFrame, keys: list[Sort]) -> tuple[DataFrame, list[Column], list[str]]:
    """df with the sort columns joined in (each table once), the order, and the names of columns to drop."""
    order, extra, joined = [], [], {}
    for n, key in enumerate(keys):
        own = b.detail(key.type)
        if own is None or (key.field is not None and not (own.singular or own.primary)):
            warnings.warn(f"sort by {key.type} {key.field} is left out", stacklevel=2)
            continue
        if key.field is None:
            mark = f"sort_has_{n}"
            df = df.join(own.table.select(F.col(own.key).alias(b.key)).distinct().withColumn(mark, F.lit(1)), b.key, "left")
            extra.append(mark)
            c: Column = F.coalesce(F.col(mark), F.lit(0))
            order.append(c.desc() if key.descending else c.asc())
            continue
        field = own.fields[key.field]
        if own.primary:
            c = F.col(field.column)
        else:
            if key.type not in joined:
                names = {f.column: f"sort_{key.type}_{f.column}" for f in own.fields.values()}
                # One row a record: a type with several (guids) gives its first.
                one = own.table.groupBy(F.col(own.key).alias(b.key)).agg(F.min(F.struct(*[F.col(x).alias(y) for x, y in names.items()])).alias("one")).select(b.key, "one.*")
                df, joined[key.type] = df.join(one, b.key, "left"), names
                extra += names.values()
            c = F.col(joined[key.type][field.column])
        if b.overlay is not None and key.field in b.overlay.columns and (own.primary or key.field == "presenceState"):
            # The overlay's value, where it has one, over the durable one.
            over = f"sort_overlay_{n}"
            df = df.join(b.overlay.select(b.key, F.col(key.field).alias(over)), b.key, "left")
            extra.append(over)
            c = F.coalesce(F.col(over), c)
        if key.field == "presenceState":
            rank = availability(c)
            order.append(rank.desc() if key.descending else rank.asc())
            continue
        if key.field == "displayLabelGroup" and "displayLabelGroupSortOrder" in own.fields:
            sort = own.fields["displayLabelGroupSortOrder"].column
            c = F.col(sort if own.primary else joined[key.type][sort])
            order += [c.isNull().asc() if key.blanks == "last" else c.isNull().desc(), c.desc() if key.descending else c.asc()]
            continue
        text = field.kind in ("string", "phone")
        is_blank = blank(c) if text else c.isNull()
        order.append(is_blank.asc() if key.blanks == "last" else is_blank.desc())
        c = collated(F.coalesce(c, F.lit("")), key) if text else c
        order.append(c.desc() if key.descending else c.asc())
    return df, [*order, F.col(b.key).asc()], extra


def ordered(b: Binding, df: DataFrame, keys: list[Sort], most: int | None = None) -> DataFrame:
    """df in the order of the keys, then of ids; with `most`, only so many rows, by a top-k that needs no full sort."""
    wide, order, extra = compile_sort(b, df, keys)
    out = wide.orderBy(*order)
    return (out.limit(most) if most is not None else out).drop(*extra)


def ranked(b: Binding, df: DataFrame, keys: list[Sort], name: str = "rank") -> DataFrame:
    """df with the place (from 1) of each row in the order.

    Rows are range-partitioned by the keys; a row's place is its place in its
    partition plus the rows of the partitions before, of which there is one
    count each.
    """
    wide, order, extra = compile_sort(b, df, keys)
    return numbered(wide.orderBy(*order).drop(*extra), name)


def numbered(in_order: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Rows of a frame, in the order in which they come, with consecutive numbers from start."""
    return numbered_once(in_order, name, start)[0]


def numbered_once(in_order: DataFrame, name: str, start: int = 1) -> tuple[DataFrame, int]:
    """numbered(), and the next number.

    The rows are written once, with their partition and their place in it:
    counts and rows must come from one and the same run, since a second one
    may draw the ranges elsewhere.
    """
    both = (1 << 33) - 1  # the bits of monotonically_increasing_id() for the place in a partition
    placed = stash(in_order.withColumn("_seq", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_seq", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a partition
    before, total = {}, start
    for r in sorted(counts, key=lambda r: r._part):
        before[r._part], total = total, total + r.n
    starts = in_order.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_part long, _start long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_seq").bitwiseAND(both)).drop("_part", "_start", "_seq"), total

"""Filter trees to DataFrame plans.

A leaf becomes a condition on the record table or a set of keys (a detail
table and a condition on its rows). A conjunction turns key sets into semi
joins, which Catalyst may broadcast, reorder and push filters through. Where
a disjunction needs them, key sets become marks: all leaves on one table are
tested in one pass (max of cases by key) and joined once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import ADDED, DELETED, MODIFIED, STATUS_BITS
from ..functions.phone import minimise, minimised
from ..functions.text import glob, has_glob, strip_phone
from .binding import Binding, Details, Field
from .filters import And, Changed, Collections, Detail, Everything, Filter, Flags, Ids, Nothing, Or, Range, Related, UnsupportedFilter, leaves, mentions

INLINE_IDS = 800


@dataclass
class Keys:
    """Records whose key is among table[key] where the condition holds."""

    table: DataFrame
    key: str
    where: Column | None
    name: str  # leaves of the same name share a pass


Leaf = Column | Keys


def _literal(value, kind: str) -> Column:
    if kind == "bool":
        return F.lit(bool(value))
    if kind == "date" and isinstance(value, datetime):
        value = value.date()
    if kind == "timestamp" and type(value) is date:
        value = datetime(value.year, value.month, value.day)
    cast = {"int": "bigint", "enum": "int", "real": "double"}.get(kind)
    return F.lit(value).cast(cast) if cast else F.lit(value)


def _matches(c: Column, value: str, match: str, wildcards: bool) -> Column:
    if wildcards and has_glob(value):
        return glob(c, {"exact": value, "starts": f"{value}*", "ends": f"*{value}", "contains": f"*{value}*"}[match])
    return {"exact": lambda: c == value, "starts": lambda: c.startswith(value), "ends": lambda: c.endswith(value), "contains": lambda: c.contains(value)}[match]()


def detail_condition(f: Detail, own: Field) -> Column:
    """The condition on a row of the detail table."""
    c = F.col(own.column)
    if f.value is None or (f.type == "SyncTarget" and f.value == ""):
        return c.isNotNull()
    if own.kind == "phone" and f.phone:
        value = str(f.value)
        if f.match == "exact":
            short = minimised(value)
            if not short:
                raise UnsupportedFilter(f"no number in {value!r}")
            return (F.col(own.normalised) if own.normalised else minimise(c)) == short
        return _matches(strip_phone(c), "".join(x for x in value if x.isdigit()), f.match, False)
    if own.kind in ("int", "bool", "real", "enum", "date", "timestamp"):
        if f.match != "exact" or (f.fixed_string and isinstance(f.value, str)):
            return _matches(c.cast("string"), str(f.value), f.match, f.wildcards)
        return c == _literal(f.value, own.kind)
    value = str(f.value)
    if own.kind == "list":
        return F.exists(c, lambda x: x.contains(value)) if value else F.coalesce(F.size(c), F.lit(0)) <= 0
    if f.fixed_string and not f.case_sensitive:
        c, value = F.col(own.lower) if own.lower else F.lower(c), value.lower()
    if value == "" and f.match == "exact":
        return F.coalesce(c, F.lit("")) == ""
    return _matches(c, value, f.match, f.wildcards)


def range_condition(f: Range, own: Field) -> Column:
    c = F.col(own.column)
    fold = f.ignore_case and own.kind in ("string", "phone")
    if fold:
        c = F.col(own.lower) if own.lower else F.lower(c)
    literal = lambda v: F.lit(v.lower()) if fold else _literal(v, own.kind)
    out = c.isNotNull()
    if f.least is not None:
        out = out & (c >= literal(f.least) if f.include_lower else c > literal(f.least))
    if f.most is not None:
        out = out & (c <= literal(f.most) if f.include_upper else c < literal(f.most))
    return out


@dataclass(frozen=True)
class _NotSelf:
    id: int


@dataclass(frozen=True)
class _Not:
    what: str


class Compiler:
    """One tree on one binding. The overlay is joined only if the tree refers to it."""

    def __init__(self, b: Binding):
        self.b = b
        self.records = b.records
        self.overlaid = False

    def overlay(self, column: str) -> Column:
        """The overlay's value, else the record's."""
        if self.b.overlay is None or column not in self.b.overlay.columns:
            return F.col(column)
        if not self.overlaid:
            over = self.b.overlay.select(F.col(self.b.key), *[F.col(c).alias(f"overlay_{c}") for c in self.b.overlay.columns if c != self.b.key])
            self.records, self.overlaid = self.records.join(over, self.b.key, "left"), True
        return F.coalesce(F.col(f"overlay_{column}"), F.col(column)) if column in self.b.records.columns else F.col(f"overlay_{column}")

    def leaf(self, f: Filter) -> Leaf:
        b = self.b
        if isinstance(f, Everything):
            return F.lit(True)
        if isinstance(f, Nothing):
            return F.lit(False)
        if isinstance(f, _NotSelf):
            return F.col(b.key) > f.id
        if isinstance(f, _Not):
            return F.col("changeFlags") < DELETED if f.what == "deleted" else ~F.col("isDeactivated")
        if isinstance(f, Ids):
            if not f.ids:
                raise UnsupportedFilter("no ids")
            if len(f.ids) <= INLINE_IDS:
                return F.col(b.key).isin(*f.ids)
            ids = self.records.sparkSession.createDataFrame([(int(i),) for i in f.ids], "id long")
            return Keys(ids, "id", None, f"ids{hash(f.ids)}")
        if isinstance(f, Collections):
            return F.col(b.collection).isin(*f.ids) if f.ids else F.col(b.collection).isNotNull()
        if isinstance(f, Flags):
            return self.flags(f)
        if isinstance(f, Changed):
            if f.kind == "added":
                return F.col("created") >= F.lit(f.since)
            if f.kind == "changed":
                return self.overlay("modified") >= F.lit(f.since)
            if f.kind == "removed":
                return (F.col("changeFlags") >= DELETED) & (F.col("deleted") >= F.lit(f.since))
            raise UnsupportedFilter(f.kind)
        if isinstance(f, Related):
            return Keys(related_keys(b, f), "id", None, f"related{f}")
        if isinstance(f, Detail | Range):
            if getattr(f, "keypad", False):
                raise UnsupportedFilter("keypad collation")
            own = b.detail(f.type) if f.type else None
            if own is None:
                raise UnsupportedFilter(f"no type {f.type!r}")
            if f.field is None:
                return F.col(b.key) != 0 if own.primary else Keys(own.table, own.key, None, f.type)
            if f.field not in own.fields:
                raise UnsupportedFilter(f"no field {f.field!r}")
            field = own.fields[f.field]
            if f.type == "GlobalPresence" and field.column == "presenceState" and b.overlay is not None and isinstance(f, Detail) and f.value is not None:
                return self.presence(own, f)
            where = detail_condition(f, field) if isinstance(f, Detail) else range_condition(f, field)
            return where if own.primary else Keys(own.table, own.key, where, f.type)
        raise UnsupportedFilter(type(f).__name__)

    def presence(self, own: Details, f: Detail) -> Keys:
        """Presence details with the overlay's state in place of their own."""
        over = self.b.overlay.select(F.col(self.b.key).alias(own.key), F.col("presenceState").alias("over_state"))
        table = own.table.join(over, own.key, "left").withColumn("presenceState", F.coalesce("over_state", "presenceState"))
        return Keys(table, own.key, F.col("presenceState") == int(f.value), "GlobalPresence+overlay")

    def flags(self, f: Flags) -> Column:
        change = F.col("changeFlags")
        own = {n: self.overlay("isOnline") if n == "isOnline" else F.col(n) for n in STATUS_BITS[:5] if n in self.b.records.columns}
        own |= {"isAdded": change.bitwiseAND(ADDED) == ADDED, "isModified": change.bitwiseAND(MODIFIED) == MODIFIED, "isDeleted": change >= DELETED}
        tests = []
        for i, n in enumerate(STATUS_BITS):
            want = bool(f.mask >> i & 1)
            if n not in own:
                if want:
                    raise UnsupportedFilter(f"no flag {n}")
                continue
            if want:
                tests.append(own[n])
            elif f.exactly:
                tests.append(~own[n])
        return reduce(Column.__and__, tests, F.lit(True))

    def apply(self, tree: Filter) -> DataFrame:
        tree = simplified(tree)
        plain, sets, rest = [], [], []
        for part in tree.parts if isinstance(tree, And) else (tree,):
            if isinstance(part, Or):
                rest.append(part)
            else:
                (sets if isinstance(leaf := self.leaf(part), Keys) else plain).append(leaf)
        marked = [self.expression(part) for part in rest]
        df = self.records
        for c in plain:
            df = df.filter(c)
        for s in sets:
            own = s.table if s.where is None else s.table.filter(s.where)
            df = df.join(own.select(F.col(s.key).alias(self.b.key)), self.b.key, "left_semi")
        if marked:
            df = self.marked(df, marked)
        return df.select(*self.b.records.columns) if self.overlaid else df

    def expression(self, tree: Filter):
        """The tree with leaves in place of filters."""
        if isinstance(tree, And | Or):
            return (type(tree), [self.expression(p) for p in tree.parts])
        return self.leaf(tree)

    def marked(self, df: DataFrame, trees: list) -> DataFrame:
        """Filters df by expressions over conditions and key sets."""
        names, passes = [], {}

        def column(node) -> Column:
            if isinstance(node, tuple):
                parts = [column(p) for p in node[1]]
                return reduce(Column.__and__ if node[0] is And else Column.__or__, parts)
            if isinstance(node, Keys):
                mark = f"mark_{len(names)}"
                names.append(mark)
                passes.setdefault(node.name, (node.table, node.key, []))[2].append((mark, node.where))
                return F.coalesce(F.col(mark), F.lit(0)) == 1
            return F.coalesce(node, F.lit(False))

        conditions = [column(t) for t in trees]
        for table, key, marks in passes.values():
            hits = table.groupBy(F.col(key).alias(self.b.key)).agg(*[F.max(F.lit(1) if where is None else F.when(where, 1)).alias(mark) for mark, where in marks])
            df = df.join(hits, self.b.key, "left")
        for c in conditions:
            df = df.filter(c)
        return df.drop(*names)


def simplified(tree: Filter) -> Filter:
    """Default parts of a conjunction are dropped and nested conjunctions opened; a union without parts is the default; default parts of a union are dropped."""
    if isinstance(tree, And):
        parts = []
        for p in map(simplified, tree.parts):
            parts.extend(p.parts if isinstance(p, And) else [] if isinstance(p, Everything) else [p])
        return Everything() if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))
    if isinstance(tree, Or):
        parts = [p for p in map(simplified, tree.parts) if not isinstance(p, Everything)]
        return Everything() if not parts else parts[0] if len(parts) == 1 else Or(tuple(parts))
    return tree


def related_keys(b: Binding, f: Related) -> DataFrame:
    """id of records in the wanted role, deleted ones removed."""
    if b.edges is None or f.role not in ("first", "second", "either"):
        raise UnsupportedFilter("no relationships" if b.edges is None else f.role)
    edges = b.edges if f.type is None else b.edges.filter(F.col("type") == f.type)

    def side(own: str, other: str) -> DataFrame:
        return (edges if f.other is None else edges.filter(F.col(other) == f.other)).select(F.col(own).alias("id"))

    # `first` says that the other record is the first of the edge
    out = {"first": lambda: side("secondId", "firstId"), "second": lambda: side("firstId", "secondId"), "either": lambda: side("secondId", "firstId").union(side("firstId", "secondId"))}[f.role]().distinct()
    if "changeFlags" in b.records.columns:
        out = out.join(b.records.filter(F.col("changeFlags") >= DELETED).select(F.col(b.key).alias("id")), "id", "left_anti")
    return out


def with_implicit(tree: Filter, b: Binding) -> Filter:
    """Adds what a query leaves unsaid: not the self record, only aggregates (where there are any), not deactivated, not deleted."""
    has_ids, has_flags = mentions(tree, Ids), mentions(tree, Flags)
    extra: list = []
    if not any(isinstance(x, Ids) and b.self_id in x.ids for x in leaves(tree)):
        extra.append(_NotSelf(b.self_id))
    if b.aggregating and not has_ids and not mentions(tree, Collections):
        extra.append(Collections((1,)))
    if not has_ids and not has_flags:
        extra += [_Not("isDeactivated"), _Not("deleted")] if not mentions(tree, Changed) or not any(isinstance(x, Changed) and x.kind == "removed" for x in leaves(tree)) else [_Not("isDeactivated")]
    return And((tree, *extra))


def select(tree: Filter, b: Binding, implicit: bool = False) -> DataFrame:
    """The records that the tree matches. A filter that can't be tested raises UnsupportedFilter."""
    return Compiler(b).apply(with_implicit(tree, b) if implicit else tree)


def select_removed(tree: Filter, b: Binding) -> DataFrame:
    """Deleted records: a removal filter alone, or with one other filter."""
    kinds = tree.parts if isinstance(tree, And) else (tree,)
    if len(kinds) > 2 or not any(isinstance(k, Changed) and k.kind == "removed" for k in kinds):
        raise UnsupportedFilter("removals combine with one collection or sync target only")
    if any(not (isinstance(k, Changed) or (isinstance(k, Collections) and len(k.ids) == 1) or (isinstance(k, Detail) and k.type == "SyncTarget")) for k in kinds):
        raise UnsupportedFilter("removals combine with one collection or sync target only")
    return select(tree, replace(b))

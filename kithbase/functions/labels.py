"""Display labels, their groups and the groups' sort values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import not_blank

# The default groups in order, and the sort values of numbers and others.
DEFAULT_GROUPS = (*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#", "?")
LAST_CODE_POINT = 0x10FFFF
NUMBER_VALUE, OTHER_VALUE = LAST_CODE_POINT + 1, LAST_CODE_POINT + 2

Generator = Callable[[Column], Column]
_generators: list[tuple[int, str, Generator, tuple[str, ...]]] = []


def display_label(custom: Column, first: Column, last: Column, *others: Column) -> Column:
    """Custom label, else first and last name, else the first of others (nickname, presence nickname, organisation, account uri, email, phone) that isn't blank; NULL if all are."""
    name = F.trim(F.concat_ws(" ", not_blank(first), not_blank(last)))
    return F.coalesce(not_blank(custom), not_blank(name), *(not_blank(c) for c in others))


def group_source(first: Column, last: Column, label: Column, preferred: str = "first") -> Column:
    """What the group is taken from: the preferred property, the other name part, then the label (for "label": the label, then first, then last)."""
    order = {"first": (first, last, label), "last": (last, first, label), "label": (label, first, last)}[preferred]
    return F.coalesce(*(not_blank(c) for c in order), F.lit(""))


def default_group(c: Column) -> Column:
    """The capital of A-Z that the text begins with, # for a digit, ? for anything else."""
    head = F.upper(F.substring(c, 1, 1))
    return F.when(head.rlike("^[A-Z]$"), head).when(F.substring(c, 1, 1).rlike(r"^\p{Nd}"), "#").otherwise("?")


def register_generator(name: str, group: Generator, groups: Sequence[str], priority: int = 0) -> None:
    """Adds a generator; a group of NULL passes the text on to the next by descending priority, at last to the default."""
    _generators[:] = sorted([g for g in _generators if g[1] != name] + [(priority, name, group, tuple(groups))], key=lambda g: (-g[0], g[1]))


def unregister_generator(name: str) -> None:
    _generators[:] = [g for g in _generators if g[1] != name]


def label_group(c: Column) -> Column:
    return F.coalesce(*(g[2](c) for g in _generators), default_group(c))


def known_groups() -> tuple[str, ...]:
    return _generators[0][3] if _generators else DEFAULT_GROUPS


def group_sort_value(group: Column, known: Sequence[str] | None = None) -> Column:
    """Sort value of a group: its place among the known ones, fixed values for # and ?, else its code point, moved behind the known run; -1 for blank."""
    known = [g for g in (known_groups() if known is None else known) if g not in "#?"]
    places = F.create_map(*[x for i, g in enumerate(known) for x in (F.lit(g), F.lit(i))]) if known else F.create_map().cast("map<string,int>")
    beyond = F.greatest(F.ascii(group), F.lit(len(known) + 1))
    return F.when(F.coalesce(group, F.lit("")) == "", -1).when(group == "#", NUMBER_VALUE).when(group == "?", OTHER_VALUE).otherwise(F.coalesce(F.try_element_at(places, group), beyond)).cast("int")

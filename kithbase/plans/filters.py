"""The filter tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

Value = str | int | float | bool | date | datetime | None


class UnsupportedFilter(ValueError):
    """A filter that no record can be tested by."""


@dataclass(frozen=True)
class Everything:
    """The default filter."""


@dataclass(frozen=True)
class Nothing:
    """Matches no record."""


@dataclass(frozen=True)
class Detail:
    """Records with a detail whose field matches a value.

    No field: any detail of the type; no value: any value. match is exact,
    starts, ends or contains. A text is compared without case if fixed_string
    is set and case_sensitive isn't. phone compares numbers. With wildcards,
    * ? and [ in the value have their GLOB meaning. keypad isn't supported.
    """

    type: str
    field: str | None = None
    value: Value = None
    match: str = "exact"
    fixed_string: bool = False
    case_sensitive: bool = False
    phone: bool = False
    wildcards: bool = False
    keypad: bool = False


@dataclass(frozen=True)
class Range:
    """least <= value < most; the ends' inclusion can be changed. Neither: any value."""

    type: str
    field: str
    least: Value = None
    most: Value = None
    include_lower: bool = True
    include_upper: bool = False
    ignore_case: bool = False


@dataclass(frozen=True)
class Ids:
    ids: tuple[int, ...]


@dataclass(frozen=True)
class Collections:
    ids: tuple[int, ...] = ()


@dataclass(frozen=True)
class Related:
    """Records related to `other` (any, if None) by `type` (any, if None). role is the other's: first, second or either."""

    type: str | None = None
    other: int | None = None
    role: str = "either"


@dataclass(frozen=True)
class Flags:
    """Bits of the status flags: all of `mask` set, or exactly `mask` of all eight."""

    mask: int
    exactly: bool = False


@dataclass(frozen=True)
class Changed:
    """kind: added, changed or removed; at `since` or later."""

    kind: str
    since: Value


@dataclass(frozen=True)
class And:
    parts: tuple = field(default=())


@dataclass(frozen=True)
class Or:
    parts: tuple = field(default=())


Filter = Everything | Nothing | Detail | Range | Ids | Collections | Related | Flags | Changed | And | Or


def leaves(tree: Filter):
    if isinstance(tree, And | Or):
        for p in tree.parts:
            yield from leaves(p)
    else:
        yield tree


def mentions(tree: Filter, kind: type) -> bool:
    return any(isinstance(x, kind) for x in leaves(tree))

"""What logical records and details are bound to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Field:
    """A column and its kind: string, list, phone, int, bool, real, date, timestamp, enum. lower, normalised: columns that hold those forms already."""

    column: str
    kind: str = "string"
    lower: str | None = None
    normalised: str | None = None


@dataclass(frozen=True)
class Details:
    """The table of one type of detail. singular: at most one row a record, so it may be joined for sorting. primary: columns of the record table itself."""

    table: DataFrame
    key: str
    fields: dict[str, Field]
    singular: bool = False
    primary: bool = False


@dataclass
class Binding:
    records: DataFrame
    key: str = "contactId"
    collection: str = "collectionId"
    details: dict[str, Details] = field(default_factory=dict)
    edges: DataFrame | None = None  # firstId, secondId, type
    overlay: DataFrame | None = None  # key, and any of presenceState, isOnline, modified
    aggregating: bool = False
    self_id: int = 2

    def detail(self, name: str) -> Details | None:
        return self.details.get(name)

"""Text functions: globs, ;-joined lists, blanks, ids, uris."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PHONE_PUNCTUATION = "+-#() "


def blank(c: Column) -> Column:
    """NULL and '' alike."""
    return F.coalesce(c, F.lit("")) == ""


def not_blank(c: Column) -> Column:
    """The value, NULL if blank."""
    return F.when(~blank(c), c)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a GLOB pattern (* ? [set] [^set])."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] not in ("^",) else i + 3) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            negate, body = body.startswith("^"), body.removeprefix("^")
            out.append("[" + "^" * negate + re.sub(r"([\[\]\\^&])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def has_glob(value: str) -> bool:
    return any(x in value for x in "*?[")


def split_list(c: Column) -> Column:
    """Parts of a ;-joined text, empty ones dropped."""
    return F.filter(F.split(c, ";"), lambda x: x != "")


def join_list(c: Column) -> Column:
    return F.array_join(c, ";")


def strip_phone(c: Column) -> Column:
    """The number without + - # ( ) and blanks."""
    return F.translate(c, PHONE_PUNCTUATION, "")


def contact_uri(c: Column) -> Column:
    return F.concat(F.lit("sql-"), c.cast("string"))


def contact_id(c: Column) -> Column:
    """The number of a sql-<n> text, 0 for anything else."""
    return F.coalesce(F.when(c.rlike(r"^sql-[0-9]{1,10}$"), F.substring(c, 5, 10).cast("long")), F.lit(0).cast("long"))


def collection_uri(c: Column) -> Column:
    return F.concat(F.lit("col-"), c.cast("string"))


def aggregate_uri(uri: Column, contact: Column) -> Column:
    """Uri of a detail promoted to aggregate `contact`; blank stays blank."""
    return F.when(~blank(uri), F.concat(F.lit("aggregate-"), contact.cast("string"), F.lit(":"), uri)).otherwise(uri)


def aggregate_uris(uris: Column, contact: Column) -> Column:
    return F.transform(uris, lambda u: aggregate_uri(u, contact))


def parse_iso(c: Column) -> Column:
    """Strict ISO date-times of 19 or 23 characters; anything else is NULL."""
    good = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?$")
    return F.when(good, F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]")))


def format_iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")

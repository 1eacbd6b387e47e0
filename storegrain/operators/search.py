"""Customer search: a conjunction of optional filters, and a sort."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import UTC, datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storegrain.functions.text import full_name

# The sorts a search accepts.
SORTS = (
    "date_created:asc",
    "date_created:desc",
    "date_modified:asc",
    "date_modified:desc",
    "last_name:asc",
    "last_name:desc",
)


class SearchError(ValueError):
    """A search without any filter, or with an unknown sort."""


@dataclass(frozen=True)
class SearchFilters:
    """Filters of a search; those left out are not applied, all others must hold.

    Dates are RFC 3339 texts, both bounds included.  ``*_like`` filters match a
    part of the text in any case.
    """

    id: int | None = None
    email: str | None = None
    name: str | None = None
    name_like: str | None = None
    phone: str | None = None
    company: str | None = None
    company_like: str | None = None
    customer_group_id: int | None = None
    date_created_min: str | None = None
    date_created_max: str | None = None
    date_modified_min: str | None = None
    date_modified_max: str | None = None
    registration_ip: str | None = None

    def any_set(self) -> bool:
        """Empty text and group 0 do not count as a filter of their own."""
        return any(getattr(self, f.name) for f in fields(self))


def _moment(text: str, kind: T.DataType) -> Column:
    at = datetime.fromisoformat(text)
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    if isinstance(kind, T.TimestampNTZType):
        at = at.replace(tzinfo=None)
        return F.lit(at.isoformat(sep=" ")).cast(kind)
    return F.lit(at.isoformat(sep=" ")).cast(T.TimestampType())


def _contains(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(part)))


def conditions(customers: DataFrame, filters: SearchFilters) -> list[Column]:
    """The filters that are set, as conditions that can be pushed to the scan."""
    name = full_name(F.col("first_name"), F.col("last_name"))
    found: list[Column] = []
    for column in ("id", "email", "phone", "company", "customer_group_id", "registration_ip"):
        wanted = getattr(filters, column)
        if wanted is not None and wanted != "":
            found.append(F.col(column) == wanted)
    if filters.name:
        found.append(name == filters.name)
    if filters.name_like:
        found.append(_contains(name, filters.name_like))
    if filters.company_like:
        found.append(_contains(F.col("company"), filters.company_like))
    for column in ("date_created", "date_modified"):
        lowest, highest = (getattr(filters, f"{column}_{end}") for end in ("min", "max"))
        if lowest:
            found.append(F.col(column) >= _moment(lowest, customers.schema[column].dataType))
        if highest:
            found.append(F.col(column) <= _moment(highest, customers.schema[column].dataType))
    return found


def search_customers(customers: DataFrame, filters: SearchFilters,
                     sort: str | None = None) -> DataFrame:
    """Customers that meet all given filters; at least one must be given."""
    if not filters.any_set():
        names = ", ".join(f.name for f in fields(filters))
        raise SearchError(f"give at least one filter: {names}")
    matches = customers.where(reduce(and_, conditions(customers, filters)))
    return sort_customers(matches, sort) if sort else matches


def sort_customers(customers: DataFrame, sort: str) -> DataFrame:
    """Sort by one of ``SORTS``; equal keys are ordered by id."""
    if sort not in SORTS:
        raise SearchError(f"unknown sort {sort!r}; use one of {', '.join(SORTS)}")
    column, direction = sort.split(":")
    first = F.col(column).asc() if direction == "asc" else F.col(column).desc()
    return customers.orderBy(first, F.col("id"))

"""Export cells: a ``Name:source`` column list turned into text columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storegrain.functions.text import join_list

# Customer columns that may be named directly, and source formats.
TOP_LEVEL = (
    "id",
    "email",
    "phone",
    "first_name",
    "last_name",
    "date_created",
    "date_modified",
    "company",
)
FORM_FIELD = "form_field:"
ADDRESS = re.compile(r"addresses\[([0-9]+)\]\.(.+)")
ID_COLUMN = ("Customer ID", "id")

ColumnList = list[tuple[str, str]]


class ColumnListError(ValueError):
    """A column list that cannot be read."""


def parse_columns(spec: str | Iterable[tuple[str, str]]) -> ColumnList:
    """Read ``"Email:email,Country:addresses[0].country"`` into (name, source) pairs.

    The first colon separates, so a source may hold more of them.  Unknown
    sources are refused here, before any job runs.
    """
    if isinstance(spec, str):
        pairs = []
        for entry in filter(None, map(str.strip, spec.split(","))):
            name, colon, source = entry.partition(":")
            if not colon:
                raise ColumnListError(f"{entry!r} has no colon: write Name:source")
            pairs.append((name.strip(), source.strip()))
    else:
        pairs = [(name, source) for name, source in spec]
    for name, source in pairs:
        if not (name and source):
            raise ColumnListError(f"{name}:{source} needs both a name and a source")
        if not (
            source in TOP_LEVEL
            or source.startswith(FORM_FIELD)
            or ADDRESS.fullmatch(source)
        ):
            raise ColumnListError(
                f"unknown source {source!r}; use one of {', '.join(TOP_LEVEL)}, "
                "addresses[N].<field> or form_field:<name>"
            )
    return pairs


def with_id(columns: ColumnList) -> ColumnList:
    """The full column list: the customer id first, then the clean columns.

    The name of the id column is reserved: another source under it is left out.
    """
    return [ID_COLUMN, *[(name, source) for name, source in columns if name != ID_COLUMN[0]]]


def _as_text(value: Column, kind: T.DataType) -> Column:
    """Text of a value; times are written as RFC 3339 in UTC."""
    if isinstance(kind, T.TimestampType):
        value = F.to_utc_timestamp(value, F.current_timezone())
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.replace(value.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    return value.cast("string")


def _address_text(df: DataFrame, position: int, field: str) -> Column:
    element = df.schema["addresses"].dataType.elementType
    address = F.get("addresses", F.lit(position))
    if field != "extra" and field in element.names:
        return _as_text(address.getField(field), element[field].dataType)
    if "extra" in element.names:
        keys = F.try_variant_get(address.getField("extra"), "$", "map<string,variant>")
        return F.try_variant_get(F.try_element_at(keys, F.lit(field)), "$", "string")
    return F.lit(None).cast("string")


def cell(df: DataFrame, source: str) -> Column:
    """One export cell; anything null, absent or out of range is ``''``."""
    if source.startswith(FORM_FIELD):
        wanted = source.removeprefix(FORM_FIELD)
        same = F.filter("form_fields", lambda f: f.getField("name") == wanted)
        text = join_list(F.get(same, F.lit(0)).getField("value"))
    elif at := ADDRESS.fullmatch(source):
        position = int(at[1])
        if position > 2**31 - 1:  # beyond what an array can hold
            return F.lit("")
        text = _address_text(df, position, at[2])
    elif source in df.columns:
        text = _as_text(F.col(source), df.schema[source].dataType)
    else:
        return F.lit("")
    return F.coalesce(text, F.lit(""))


def cells(df: DataFrame, columns: ColumnList) -> list[Column]:
    """Aliased cells in order; a repeated name keeps its first place, last source."""
    return [cell(df, source).alias(name) for name, source in dict(columns).items()]


def export_rows(customers: DataFrame, columns: str | ColumnList) -> DataFrame:
    return customers.select(*cells(customers, parse_columns(columns)))

"""Text expressions: masking, slugs, fallbacks and truth values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _keep_start(part: Column, shown: int) -> Column:
    hidden = F.greatest(F.lit(0), F.length(part) - shown)
    return F.concat(F.substring(part, 1, shown), F.repeat(F.lit("*"), hidden))


def mask_email(email: Column) -> Column:
    """Two characters of the local part and of the domain stay, the rest is starred.

    Whatever follows a second ``@`` is dropped; a missing domain counts as empty.
    """
    parts = F.split(email, "@")
    return F.concat(
        _keep_start(F.get(parts, F.lit(0)), 2),
        F.lit("@"),
        _keep_start(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 2),
    )


def mask_secret(secret: Column) -> Column:
    """First and last four characters, or four stars for eight or fewer."""
    return F.when(F.length(secret) <= 8, F.lit("****")).when(
        secret.isNotNull(),
        F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4))),
    )


def slug(text: Column) -> Column:
    """Lower case, each run of other characters than ``a-z0-9`` one dash, no edge dash."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.trim(dashed, F.lit("-"))


def slug_of(text: str) -> str:
    """The same rule for a single key used in a folder name."""
    return "-".join(re.findall("[a-z0-9]+", text.lower()))


def full_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", first, last)


def first_filled(*candidates: Column, default: str) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(default))


def truthy_variant(value: Column) -> Column:
    """Truth of a JSON value: false for missing, null, ``false``, 0 and ``''``.

    The kind of the value is looked up only where its text could mean false.
    """
    text = F.try_variant_get(value, "$", "string")
    zero = F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False))
    is_false = (
        (text.startswith("0") | text.startswith("-0") | (text == "false"))
        & (F.schema_of_variant(value) != "STRING")
        & ((text == "false") | zero)
    )
    return F.coalesce((text != "") & ~is_false, F.lit(False))


def truthy(df: DataFrame, name: str) -> Column:
    """Truth of a column by its type; the text ``'0'`` is true, null is false."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.VariantType):
        return truthy_variant(value)
    if isinstance(kind, T.BooleanType):
        holds = value
    elif isinstance(kind, T.StringType):
        holds = value != ""
    elif isinstance(kind, T.NumericType):
        holds = value != 0
    else:
        holds = value.isNotNull()
    return F.coalesce(holds, F.lit(False))


def join_list(values: Column) -> Column:
    """List to text, comma and space between; a null element is empty text."""
    return F.array_join(values, ", ", "")

"""Expressions over a field-catalogue row: name, type and options of a field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storegrain.functions.text import first_filled

# Store field type -> registry type, and the name of a nameless field.
STORE_TYPES = {
    "text": "string",
    "multiline": "string",
    "password": "string",
    "radiobuttons": "string",
    "radio_buttons": "string",
    "multipleselect": "string",
    "multiple_select": "string",
    "dropdown": "string",
    "numberonly": "number",
    "number_only": "number",
    "number": "number",
    "date": "date",
    "checkboxes": "boolean",
}
UNNAMED = "(unnamed)"


def field_name(name: str = "name", label: str = "label",
               field_name: str = "field_name", title: str = "title") -> Column:
    return first_filled(F.col(name), F.col(label), F.col(field_name), F.col(title),
                        default=UNNAMED)


def raw_type() -> Column:
    return first_filled(F.col("type"), F.col("form_field_type"), F.col("field_type"),
                        default="")


def field_options() -> Column:
    """Nested option list, else the top-level one; an empty list is no list."""
    listed = F.coalesce(F.col("extra_info.options"), F.col("options"))
    return F.when(F.size(listed) > 0, listed)


def registry_type(store_type: Column) -> Column:
    """Map a store type such as ``type_date_field`` to a registry type."""
    bare = F.regexp_replace(F.lower(store_type), "^type_", "")
    bare = F.regexp_replace(bare, "_field$", "")
    known = F.create_map(*[F.lit(x) for pair in STORE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, bare), F.lit("string"))

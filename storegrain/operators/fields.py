"""Field catalogue, registry entries, discovery and value checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.functions.catalog import field_name, field_options, raw_type, registry_type
from storegrain.functions.text import truthy
from storegrain.operators.keys import top_n
from storegrain.workspace import stage, stage_counted

UNKNOWN_FIELD, VALUE_NOT_ALLOWED = "unknown field", "value not allowed"


class FieldRequestError(ValueError):
    """A requested field or value the registry does not allow."""


def visible_fields(catalog: DataFrame, include_built_in: bool = False) -> DataFrame:
    """Custom fields only, unless asked for the built-in ones as well."""
    return catalog if include_built_in else catalog.where(~truthy(catalog, "private_id"))


def catalog_summary(catalog: DataFrame, include_built_in: bool = False) -> DataFrame:
    named = visible_fields(catalog, include_built_in).select(
        field_name().alias("name"),
        raw_type().alias("raw_type"),
        field_options().alias("options"),
        truthy(catalog, "private_id").alias("built_in"),
        truthy(catalog, "required").alias("required"),
    )
    kind = registry_type(F.col("raw_type")).alias("type")
    return named.select("name", kind, "raw_type", "options", "built_in", "required")


def registry_entries(catalog: DataFrame, include_built_in: bool = False) -> DataFrame:
    """Registry rows from catalogue rows."""
    return catalog_summary(catalog, include_built_in).select("name", "type", "options")


def check_request(registry: DataFrame, field: str, value: str) -> None:
    """Refuse a field the registry lacks or a value it does not list.

    An empty registry accepts everything; an empty option list accepts nothing.
    Of entries with one name the first counts, see :func:`first_entries`.
    """
    entry = first_entries(registry.where(F.col("name") == field)).select("options").head()
    if entry is None:
        if registry.isEmpty():
            return
        raise FieldRequestError(f"field {field!r} is not registered")
    if entry.options is not None and value not in entry.options:
        raise FieldRequestError(
            f"value {value!r} is not allowed for {field!r}: {', '.join(entry.options)}"
        )


def first_entries(registry: DataFrame) -> DataFrame:
    """One entry for each name: the first by ``position`` if there is one.

    Tables have no order of their own; without a ``position`` the least entry counts.
    """
    rest = [c for c in registry.columns if c not in ("name", "position")]
    order = (["position"] if "position" in registry.columns else []) + rest
    return registry.groupBy("name").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_entry")
    ).select("name", "_entry.*")


def field_violations(values: DataFrame, registry: DataFrame) -> DataFrame:
    """Value rows with an unknown field or a value outside its options.

    One left join does both checks.  Fields are few and each has very many
    rows, so the registry goes through a written table: the planner knows its
    size and broadcasts it, or splits the skewed fields if it is too large.
    """
    known, entries = stage_counted(
        first_entries(registry).select(F.col("name").alias("_name"), F.struct("options").alias("_entry")),
        "registry",
    )
    if entries == 0:
        return values.withColumn("violation", F.lit(None).cast("string")).where(F.lit(False))
    options = F.col("_entry.options")
    violation = F.when(F.col("_name").isNull(), UNKNOWN_FIELD).when(
        options.isNotNull() & ~F.coalesce(F.array_contains(options, F.col("value")), F.lit(False)),
        VALUE_NOT_ALLOWED,
    )
    joined = values.join(known, values["name"] == known["_name"], "left")
    return (
        joined.withColumn("violation", violation)
        .where("violation is not null")
        .drop("_name", "_entry")
    )


def discover_fields(values: DataFrame, samples: int = 3, approximate: bool = False) -> DataFrame:
    """Per field: rows, customers, distinct values and the first few of them.

    There are few fields and very many rows, so rows are first merged on
    (field, value) and on (field, customer); only sums are taken per field.
    ``approximate`` estimates the customers instead of counting them.
    """
    per_value = stage(
        values.groupBy("name", "value").agg(F.count(F.lit(1)).alias("rows")), "field-values"
    )
    counts = per_value.groupBy("name").agg(
        F.sum("rows").alias("rows"), F.count("value").alias("distinct_values")
    )
    if approximate:
        per_customer = values.groupBy("name")
        holders = per_customer.agg(F.approx_count_distinct("customer_id").alias("customers"))
    else:
        per_customer = values.select("name", "customer_id").distinct().groupBy("name")
        holders = per_customer.agg(F.count("customer_id").alias("customers"))
    first = top_n(per_value.where("value is not null"), "name", [F.asc("value")], samples, "_rank")
    sample = first.groupBy("name").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    joined = counts
    for more in (holders, sample):
        more = more.withColumnRenamed("name", "_name")
        on = joined["name"].eqNullSafe(more["_name"])
        joined = joined.join(more, on, "left").drop("_name")
    none = F.array().cast("array<string>")
    return joined.select(
        "name", "rows", "customers", "distinct_values",
        F.coalesce("samples", none).alias("samples"),
    )

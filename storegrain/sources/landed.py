"""Readers for landed JSON: customer and value pages, orders, carts, catalogue.

A page is an envelope ``{"data": [...], "meta": {...}}``.  With
``multiline=True`` each file is one page; with ``multiline=False`` each line is
one, and large files are split between tasks.  Many files or lines take the
place of a page loop, so the union of pages is just the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain import schemas
from storegrain.functions.text import truthy_variant
from storegrain.sources.checks import FAIL, QUARANTINE, fields_of, read_time, require, split_rows


def _json_options(multiline: bool, strict: bool) -> dict[str, str]:
    return {
        "multiLine": str(multiline).lower(),
        "mode": "FAILFAST" if strict else "PERMISSIVE",
        "singleVariantColumn": "page",
    }


def read_pages(spark: SparkSession, path: str, *, multiline: bool = True,
               strict: bool = True) -> DataFrame:
    """One VARIANT ``page`` per landed page, with the file it came from."""
    pages = spark.read.options(**_json_options(multiline, strict)).json(path)
    return pages.select("page", F.col("_metadata.file_path").alias("file"))


def stream_pages(spark: SparkSession, path: str, *, multiline: bool = True,
                 files_per_batch: int | None = None, strict: bool = True) -> DataFrame:
    """The same as a stream; ``files_per_batch`` bounds the work of one batch."""
    reader = spark.readStream.schema("page VARIANT").options(**_json_options(multiline, strict))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pages = reader.json(path)
    return pages.select("page", F.col("_metadata.file_path").alias("file"))


def page_rows(pages: DataFrame) -> DataFrame:
    """One VARIANT ``row`` per element of each page's ``data``."""
    data = F.try_variant_get("page", "$.data", "array<variant>")
    return pages.select(F.explode(data).alias("row"), "file")


def _address(address: Column) -> Column:
    return F.struct(
        F.try_variant_get(address, "$.country", "string").alias("country"),
        address.alias("extra"),
    )


def _form_field(field: Column) -> Column:
    """Single text and list of texts both become a list; null stays null."""
    listed = F.try_variant_get(field, "$.value", "array<string>")
    single = F.try_variant_get(field, "$.value", "string")
    return F.struct(
        F.try_variant_get(field, "$.name", "string").alias("name"),
        F.coalesce(listed, F.when(single.isNotNull(), F.array(single))).alias("value"),
    )


def customer_columns() -> list[Column]:
    """The columns of a customer, of a VARIANT ``row``; the raw object stays in ``extra``."""
    texts = ("email", "first_name", "last_name", "phone", "company")
    held = fields_of("row", {
        "id": "bigint", **dict.fromkeys(texts, "string"), "customer_group_id": "bigint",
        "registration_ip_address": "string", "date_created": "string", "date_modified": "string",
        "addresses": "array<variant>", "form_fields": "array<variant>",
    })
    return [
        held["id"].alias("id"),
        *[held[c].alias(c) for c in texts],
        held["customer_group_id"].alias("customer_group_id"),
        held["registration_ip_address"].alias("registration_ip"),
        read_time(held["date_created"]).alias("date_created"),
        read_time(held["date_modified"]).alias("date_modified"),
        F.transform(held["addresses"], _address).alias("addresses"),
        F.transform(held["form_fields"], _form_field).alias("form_fields"),
        F.col("row").alias("extra"),
    ]


def type_customers(rows: DataFrame) -> DataFrame:
    return rows.select(*customer_columns())


def field_value_columns() -> list[Column]:
    kinds = dict(c.split() for c in schemas.FORM_FIELD_VALUES.split(", "))
    held = fields_of("row", kinds)
    return [held[name].alias(name) for name in kinds]


def type_field_values(rows: DataFrame) -> DataFrame:
    return rows.select(*field_value_columns())


def _read_checked(spark, path, multiline, mode, rules, typed, what):
    if mode == FAIL:
        pages = require(read_pages(spark, path, multiline=multiline), "page",
                        schemas.PAGE_RULES, f"{what} page")
        return typed(require(page_rows(pages), "row", rules, what))
    if mode != QUARANTINE:
        raise ValueError(f"mode must be {FAIL!r} or {QUARANTINE!r}, not {mode!r}")
    pages = read_pages(spark, path, multiline=multiline, strict=False)
    sound_pages, bad_pages = split_rows(pages, "page", schemas.PAGE_RULES)
    sound, bad = split_rows(page_rows(sound_pages), "row", rules)
    rejects = bad.unionByName(bad_pages.withColumnRenamed("page", "row"))
    return typed(sound), rejects


def read_customers(spark: SparkSession, path: str, *, multiline: bool = True,
                   mode: str = FAIL):
    """Customers from landed pages.

    ``mode="fail"`` returns one DataFrame and fails the job on a bad row;
    ``mode="quarantine"`` returns (customers, rejects with their problems).
    """
    return _read_checked(spark, path, multiline, mode, schemas.CUSTOMER_RULES,
                         type_customers, "customer")


def read_field_values(spark: SparkSession, path: str, *, multiline: bool = True,
                      mode: str = FAIL):
    """The tall (customer, field, value) feed; modes as :func:`read_customers`."""
    return _read_checked(spark, path, multiline, mode, schemas.FIELD_VALUE_RULES,
                         type_field_values, "field value")


def stream_field_values(spark: SparkSession, path: str, *, multiline: bool = True,
                        files_per_batch: int | None = None) -> DataFrame:
    pages = stream_pages(spark, path, multiline=multiline, files_per_batch=files_per_batch)
    pages = require(pages, "page", schemas.PAGE_RULES, "field value page")
    rows = require(page_rows(pages), "row", schemas.FIELD_VALUE_RULES, "field value")
    return type_field_values(rows)


def list_rows(pages: DataFrame) -> DataFrame:
    """One VARIANT ``row`` per element of bare JSON arrays, or per object."""
    listed = F.coalesce(F.try_variant_get("page", "$", "array<variant>"), F.array("page"))
    return pages.select(F.explode(listed).alias("row"), "file")


def list_columns(columns: str) -> list[Column]:
    """The given columns of a VARIANT ``row``; the whole object stays in ``extra``."""
    kinds = dict(c.split() for c in columns.split(", "))
    held = fields_of("row", {n: "string" if k == "TIMESTAMP" else k for n, k in kinds.items() if n != "extra"})
    return [
        F.col("row").alias(name) if name == "extra"
        else read_time(held[name]).alias(name) if kind == "TIMESTAMP"
        else held[name].alias(name)
        for name, kind in kinds.items()
    ]


def _typed(columns: str):
    """A function that types VARIANT rows."""
    return lambda rows: rows.select(*list_columns(columns))


def _read_list(spark, path, columns, rules, multiline, mode, what):
    """Bare JSON arrays, or one object per line; modes as :func:`read_customers`."""
    pages = read_pages(spark, path, multiline=multiline, strict=mode == FAIL)
    return _checked_rows(list_rows(pages), mode, rules, _typed(columns), what)


def read_orders(spark: SparkSession, path: str, *, multiline: bool = True, mode: str = FAIL):
    """Orders; keys without a column of their own are in ``extra``."""
    return _read_list(spark, path, schemas.ORDERS, schemas.ORDER_RULES, multiline, mode, "order")


def read_order_products(spark: SparkSession, path: str, *, multiline: bool = True, mode: str = FAIL):
    return _read_list(spark, path, schemas.ORDER_PRODUCTS, schemas.ORDER_PRODUCT_RULES,
                      multiline, mode, "order product")


def read_order_fees(spark: SparkSession, path: str, *, multiline: bool = True, mode: str = FAIL):
    """Fees; amounts arrive as text and must be exact at four places."""
    return _read_list(spark, path, schemas.ORDER_FEES, schemas.ORDER_FEE_RULES,
                      multiline, mode, "order fee")


def cart_columns() -> list[Column]:
    held = fields_of("row", {
        "id": "string", "customer_id": "bigint", "created_time": "string", "updated_time": "string",
    })
    return [
        held["id"].alias("id"),
        held["customer_id"].alias("customer_id"),
        read_time(held["created_time"]).alias("created_time"),
        read_time(held["updated_time"]).alias("updated_time"),
        F.coalesce(
            F.try_variant_get("row", "$.line_items.physical_items", schemas.CART_ITEMS),
            F.array().cast(schemas.CART_ITEMS),
        ).alias("physical_items"),
        F.col("row").alias("extra"),
    ]


def type_carts(rows: DataFrame) -> DataFrame:
    return rows.select(*cart_columns())


def cart_rows(pages: DataFrame) -> DataFrame:
    """One VARIANT ``row`` per cart, taken out of its envelope."""
    return pages.select(F.coalesce(F.try_variant_get("page", "$.data", "variant"), "page").alias("row"), "file")


def read_carts(spark: SparkSession, path: str, *, multiline: bool = True, mode: str = FAIL):
    """Carts, each an object under ``data``; the whole object stays in ``extra``.

    Modes as :func:`read_customers`: a cart without an id fails the job or is set aside.
    """
    pages = read_pages(spark, path, multiline=multiline, strict=mode == FAIL)
    return _checked_rows(cart_rows(pages), mode, schemas.CART_RULES, type_carts, "cart")


def _checked_rows(rows, mode, rules, typed, what):
    if mode == FAIL:
        return typed(require(rows, "row", rules, what))
    if mode != QUARANTINE:
        raise ValueError(f"mode must be {FAIL!r} or {QUARANTINE!r}, not {mode!r}")
    sound, rejects = split_rows(rows, "row", rules)
    return typed(sound), rejects


def _filled_text(value: Column) -> Column:
    """Text of a JSON value; null where it counts as false."""
    return F.when(truthy_variant(value), F.try_variant_get(value, "$", "string"))


def _texts(value: Column) -> Column:
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.transform(
        listed, lambda o: F.coalesce(F.try_variant_get(o, "$", "string"), F.lit("null"))
    )


def type_catalog(pages: DataFrame) -> DataFrame:
    """Field definitions from either payload shape, a bare list or one under ``data``.

    Any other payload gives no rows.  A nested option value that is present but
    no list hides the top-level one, so it is kept as an empty list.
    """
    listed = F.coalesce(
        F.try_variant_get("page", "$", "array<variant>"),
        F.try_variant_get("page", "$.data", "array<variant>"),
    )
    names = ("name", "label", "field_name", "title", "type", "form_field_type", "field_type")
    keys = (*names, "private_id", "required", "extra_info", "options")
    taken = f"struct<{', '.join(f'{k} variant' for k in keys)}>"
    rows = pages.select(F.explode(listed).alias("row")).select(
        F.try_variant_get("row", "$", taken).alias("field")
    )
    nested = F.try_variant_get("field.extra_info", "$.options", "variant")
    given = nested.isNotNull() & ~F.is_variant_null(nested)
    none = F.array().cast("array<string>")
    return rows.select(
        *[_filled_text(F.col(f"field.{name}")).alias(name) for name in names],
        "field.private_id",
        "field.required",
        F.struct(F.when(given, F.coalesce(_texts(nested), none)).alias("options"))
        .alias("extra_info"),
        _texts(F.col("field.options")).alias("options"),
    )


def read_catalog(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame:
    return type_catalog(read_pages(spark, path, multiline=multiline))

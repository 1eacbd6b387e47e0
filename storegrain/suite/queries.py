"""The registered queries: name -> job over (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.functions.cells import export_rows, parse_columns
from storegrain.functions.text import slug, truthy
from storegrain.operators import fields, orders, segments, values
from storegrain.operators.masking import mask_columns
from storegrain.operators.search import SORTS, SearchFilters, search_customers
from storegrain.plans.export import export_segment
from storegrain.plans.ledger import compact_ledgers, exported_when
from storegrain.plans.registry import publish_registry
from storegrain.plans.status import run_report
from storegrain.sources import landed
from storegrain.sources.batches import vacuum
from storegrain.sources.csv_files import column_values, read_csv, write_csv
from storegrain.sources.landing_store import compact_store, read_rejects, read_store
from storegrain.sources.registry import read_registry, read_registry_file, registry_problems
from storegrain.sources.run_states import parse_run_states
from storegrain.sources.value_table import compact, read_values
from storegrain.streaming.export_feed import run_export_feed
from storegrain.streaming.landing_feed import run_landing_feed
from storegrain.streaming.segment_feed import collect_segment
from storegrain.streaming.value_feed import run_value_feed, stream_changes
from storegrain.suite import standins as tables
from storegrain.workspace import new_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

FIELD, VALUE = "purchase", "7"
COLUMNS = (
    "Customer ID:id,Email:email,Country:addresses[0].country,"
    "Segment:form_field:segment,City:addresses[1].city"
)
PLAIN = ("id", "email", "first_name", "last_name", "phone", "company",
         "customer_group_id", "registration_ip")
RUN_DATE = date(2024, 2, 1)


def query(job: Query) -> Query:
    REGISTERED[job.__name__] = job
    return job


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def money(column: Column) -> Column:
    return column.cast("double")


# Segment export.


@query
def segment_export(spark, sf_dir):
    ids, _ = segments.find_segment(tables.values(spark, sf_dir), FIELD, VALUE)
    found = segments.customers_of(tables.customers(spark, sf_dir), ids)
    return export_rows(found, parse_columns(COLUMNS))


@query
def segment_export_dates(spark, sf_dir):
    ids, _ = segments.find_segment(tables.values(spark, sf_dir), FIELD, VALUE)
    found = segments.customers_of(tables.customers(spark, sf_dir, dates=True), ids)
    spec = "ID:email,ID:id,Created:date_created,Modified:date_modified,Region:form_field:region"
    return export_rows(found, parse_columns(spec))


@query
def segment_export_incremental(spark, sf_dir):
    everyone = tables.customers(spark, sf_dir)
    ids, _ = segments.find_segment(tables.values(spark, sf_dir), FIELD, VALUE)
    base = everyone.where("id % 2 = 0").select(F.col("id").cast("string").alias("Customer ID"))
    new = segments.not_exported(ids, base, "Customer ID")
    return export_rows(segments.customers_of(everyone, new), parse_columns(COLUMNS))


@query
def segment_counts(spark, sf_dir):
    return segments.segment_counts(
        tables.values(spark, sf_dir), tables.customers(spark, sf_dir), FIELD, VALUE
    )


@query
def export_report(spark, sf_dir):
    result = export_segment(
        tables.values(spark, sf_dir), tables.customers(spark, sf_dir), key="Report", field=FIELD,
        value=VALUE, columns=COLUMNS, out_dir=new_folder(spark, "exports"), run_date=RUN_DATE,
    )
    return result.report().select("matched", "fetched", "written", "exported")


@query
def export_files(spark, sf_dir):
    """A full export of one half of the values, then an increment over all of them."""
    held = tables.values(spark, sf_dir)
    common = dict(
        customers=tables.customers(spark, sf_dir), key="Bought Seven", field=FIELD, value=VALUE,
        columns="Email:email,Segment:form_field:segment", out_dir=new_folder(spark, "exports"),
        run_date=RUN_DATE, write=True,
    )
    first = export_segment(held.where("seq % 2 = 0"), run="first", **common)
    second = export_segment(held, run="second", incremental=True, **common)

    def read(kind, path, written):
        if not written:
            return None
        rows = read_csv(spark, path)
        id_cell = F.col("`Customer ID`") if kind == "base" else F.lit("")
        return rows.select(F.lit(kind).alias("output"), id_cell.alias("customer_id"),
                           F.col("Email").alias("email"), F.col("Segment").alias("segment"))

    parts = [read("base", first.base_path, first.written),
             read("clean full", first.clean_path, first.written),
             read("base", second.base_path, second.written),
             read("clean increment", second.clean_path, second.written)]
    found = [p for p in parts if p is not None]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# Customer search.


def flat_customers(rows: DataFrame) -> DataFrame:
    return rows.select(*PLAIN, day("date_created"), day("date_modified"))


@query
def search_exact(spark, sf_dir):
    everyone = tables.customers(spark, sf_dir)
    asked = {
        "id": SearchFilters(id=42),
        "email": SearchFilters(email="customer.000000043@example.com"),
        "name": SearchFilters(name="Customer 000000044"),
        "phone": SearchFilters(phone="555-0000045"),
        "company": SearchFilters(company="MACHINERY", registration_ip="10.0.0.77"),
        "none": SearchFilters(email="customer.000000043@example.com", id=42),
    }
    out = None
    for label, filters in asked.items():
        hits = search_customers(everyone, filters).select(F.lit(label).alias("asked"), *PLAIN)
        out = hits if out is None else out.unionByName(hits)
    return out


@query
def search_name_like(spark, sf_dir):
    filters = SearchFilters(name_like="CUSTOMER 00000", company_like="ture")
    return flat_customers(search_customers(tables.customers(spark, sf_dir, dates=True), filters))


@query
def search_company_dates(spark, sf_dir):
    filters = SearchFilters(
        company="BUILDING",
        date_created_min="1995-01-10T00:00:00Z", date_created_max="1996-06-30T02:00:00+02:00",
        date_modified_min="2000-06-01", date_modified_max="2001-07-01T00:00:00Z",
    )
    return flat_customers(search_customers(tables.customers(spark, sf_dir, dates=True), filters))


@query
def search_group_ip(spark, sf_dir):
    """Customers of the group of customer 37 that share that customer's address."""
    group = tables.customers(spark, sf_dir).where("id = 37").head()["customer_group_id"]
    filters = SearchFilters(customer_group_id=group, registration_ip="10.0.0.37")
    return flat_customers(search_customers(tables.customers(spark, sf_dir, dates=True), filters))


@query
def search_sorted(spark, sf_dir):
    everyone = tables.customers(spark, sf_dir, dates=True)
    filters = SearchFilters(company_like="hold")
    return flat_customers(search_customers(everyone, filters, sort="date_modified:desc"))


def _placed(rows: DataFrame, n: int) -> DataFrame:
    """The ids of the first ``n`` rows with their places, as a report of the order."""
    top = rows.limit(n).groupBy().agg(F.collect_list("id").alias("ids"))
    return top.select(F.posexplode("ids").alias("at", "id")).select(
        "id", (F.col("at") + 1).cast("bigint").alias("place")
    )


@query
def search_sorted_top(spark, sf_dir):
    """The first 25 hits in each of the six orders."""
    everyone = tables.customers(spark, sf_dir, dates=True)
    out = None
    for sort in SORTS:
        hits = search_customers(everyone, SearchFilters(company_like="hold"), sort=sort)
        part = _placed(hits, 25).select(F.lit(sort).alias("sort"), "id", "place")
        out = part if out is None else out.unionByName(part)
    return out


@query
def orders_newest_top(spark, sf_dir):
    return _placed(orders.sort_newest_first(orders.with_customer(tables.orders(spark, sf_dir))), 100)


@query
def search_with_recent_orders(spark, sf_dir):
    hits = search_customers(tables.customers(spark, sf_dir), SearchFilters(company_like="machin"))
    full = orders.with_recent_orders(
        hits, tables.orders(spark, sf_dir), tables.products(spark, sf_dir)
    )
    return _recent_summary(full)


def _recent_summary(full: DataFrame) -> DataFrame:
    listed = F.col("recent_orders")
    return full.select(
        "id", "email",
        F.size(listed).cast("bigint").alias("n_orders"),
        F.aggregate(
            listed, F.lit(0).cast("bigint"), lambda acc, o: acc + F.size(o.getField("products"))
        ).alias("n_products"),
        F.get(listed, F.lit(0)).getField("id").alias("newest_order"),
        F.aggregate(
            listed, F.lit(0).cast("decimal(28,2)"),
            lambda acc, o: (acc + o.getField("total")).cast("decimal(28,2)"),
        ).cast("double").alias("total"),
    )


@query
def search_by_order(spark, sf_dir):
    """Customers found by the orders of a status, each with recent orders and products."""
    held = tables.orders(spark, sf_dir)
    asked = held.where("status = 'P'").select(F.col("id").alias("order_id"))
    return _recent_summary(orders.customers_of_orders(
        asked, held, tables.customers(spark, sf_dir), tables.products(spark, sf_dir)
    ))


@query
def customers_by_email(spark, sf_dir):
    def shared(number: Column) -> Column:
        return F.concat(F.lit("group"), number.cast("string"), F.lit("@example.com"))

    everyone = tables.customers(spark, sf_dir).withColumn("email", shared(F.col("id") % 700))
    asked = tables.table(spark, sf_dir, "orders").select(
        shared(F.col("o_custkey") % 1000).alias("email")
    )
    return orders.first_customers(everyone, asked).select(*PLAIN)


@query
def customer_by_order(spark, sf_dir):
    asked = tables.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("order_id")
    )
    found = orders.customers_by_order(
        asked, tables.orders(spark, sf_dir), tables.customers(spark, sf_dir)
    )
    return found.select("order_id", "id", "email", F.col("addresses")[0]["country"].alias("country"))


# Orders, fees and carts.


@query
def guest_orders(spark, sf_dir):
    found = orders.guest_orders(tables.orders(spark, sf_dir))
    return found.select("id", "customer_id", "status", day("date_created"))


@query
def orders_newest_first(spark, sf_dir):
    found = orders.sort_newest_first(orders.with_customer(tables.orders(spark, sf_dir)))
    return found.select("id", "customer_id", "status", day("date_created"))


@query
def recent_orders_top10(spark, sf_dir):
    return orders.recent_orders(tables.orders(spark, sf_dir)).select(
        "customer_id", "id", F.col("recency").cast("bigint").alias("recency"),
        day("date_created"), money(F.col("total")).alias("total"),
    )


@query
def orders_by_email(spark, sf_dir):
    hits = search_customers(tables.customers(spark, sf_dir), SearchFilters(company="BUILDING"))
    emails = stage(hits.select("email"), "emails")
    full = orders.orders_by_email(
        tables.orders(spark, sf_dir), emails, tables.products(spark, sf_dir), n=10
    )
    return full.select("email", "id", F.col("recency").cast("bigint").alias("recency"),
                       F.size("products").cast("bigint").alias("n_products"))


def _list_sum(column: str, field: str) -> Column:
    return F.aggregate(
        column, F.lit(0).cast("decimal(34,4)"),
        lambda acc, x: (acc + x.getField(field)).cast("decimal(34,4)"),
    ).cast("double")


@query
def orders_with_products(spark, sf_dir):
    full = orders.with_products(tables.orders(spark, sf_dir), tables.products(spark, sf_dir))
    return full.select(
        "id",
        F.size("products").cast("bigint").alias("n_products"),
        _list_sum("products", "quantity").alias("quantity"),
        _list_sum("products", "price").alias("price"),
        F.get("products", F.lit(0)).getField("sku").alias("first_sku"),
    )


@query
def order_product_rows(spark, sf_dir):
    """The flat form: one row a product."""
    found = orders.order_product_rows(tables.orders(spark, sf_dir), tables.products(spark, sf_dir))
    return found.select("id", "customer_id", F.col("product.sku").alias("sku"),
                        F.col("product.quantity").cast("bigint").alias("quantity"),
                        money(F.col("product.price")).alias("price"))


@query
def order_fees(spark, sf_dir):
    return orders.order_fees(tables.orders(spark, sf_dir), tables.fees(spark, sf_dir)).select(
        "order_id", "name", "type", money(F.col("amount")).alias("amount"),
        money(F.col("tax")).alias("tax"),
    )


@query
def orders_with_fees(spark, sf_dir):
    full = orders.with_fees(tables.orders(spark, sf_dir), tables.fees(spark, sf_dir))
    return full.select(
        "id", F.size("fees").cast("bigint").alias("n_fees"), _list_sum("fees", "amount").alias("amount")
    )


@query
def carts_by_order(spark, sf_dir):
    key = F.col("o_orderkey")
    asked = tables.table(spark, sf_dir, "orders").select(
        F.when(key % 10 == 0, -1 - key).otherwise(key).alias("order_id")
    )
    found = orders.carts_by_order(
        asked, tables.orders(spark, sf_dir), tables.carts(spark, sf_dir)
    )
    return found.select("order_id", "cart_id", "outcome", "cart_customer_id")


@query
def carts_mixed_keys(spark, sf_dir):
    number = F.col("o_orderkey")
    key = (
        F.when(number % 3 == 0, number.cast("string"))
        .when(number % 3 == 1, F.concat(F.lit("cart-"), number.cast("string")))
        .otherwise(F.concat(F.lit("9999999999"), number.cast("string"), F.lit("0000000000")))
    )
    asked = tables.table(spark, sf_dir, "orders").select(key.alias("key"))
    found = orders.carts_by_key(asked, tables.orders(spark, sf_dir), tables.carts(spark, sf_dir))
    return found.select("key", "cart_id", "outcome", "cart_customer_id",
                        F.size("cart_physical_items").cast("bigint").alias("n_items"))


# Field catalogue, registry and checks.


def _flat_options(rows: DataFrame) -> DataFrame:
    return rows.withColumn("options", F.array_join("options", "|"))


@query
def field_catalog_summary(spark, sf_dir):
    payloads = tables.catalog_payloads(spark, sf_dir)
    catalog = landed.type_catalog(payloads.select(F.parse_json("value").alias("page")))
    return _flat_options(fields.catalog_summary(catalog, include_built_in=True))


@query
def field_registry_build(spark, sf_dir):
    """Landed catalogue -> published registry -> read back; saving again changes nothing."""
    path = tables.land(tables.catalog_payloads(spark, sf_dir), "catalog")
    catalog = landed.read_catalog(spark, path, multiline=False)
    root = new_folder(spark, "registry")
    saved = [publish_registry(catalog, root), publish_registry(catalog, root)]
    rows = _flat_options(read_registry(spark, root))
    return rows.withColumn("saved_once", F.lit(saved == [True, False]))


@query
def registry_violations(spark, sf_dir):
    n = F.col("p_partkey")
    entries = tables.table(spark, sf_dir, "part").select(
        F.when(n % 10 == 0, "").when(n % 10 == 1, None)
        .otherwise(F.concat(F.col("p_name"), n.cast("string"))).alias("name"),
        F.when(n % 4 == 0, "string").when(n % 4 == 1, "date").when(n % 4 == 2, "bogus")
        .alias("type"),
        F.array("p_brand").alias("options"),
    )
    return registry_problems(entries).select("name", "type", "problem")


@query
def field_discovery(spark, sf_dir):
    return fields.discover_fields(tables.values(spark, sf_dir)).withColumn(
        "samples", F.array_join("samples", "|")
    )


@query
def field_values_pivot(spark, sf_dir):
    return segments.pivot_fields(tables.values(spark, sf_dir), ["click", "view", "purchase"], "seq")


@query
def field_value_violations(spark, sf_dir):
    """The registry names ``purchase`` twice; its first entry counts."""
    once = tables.registry(spark).withColumn("position", F.lit(0))
    again = once.where("name = 'purchase'").withColumns(
        {"position": F.lit(1), "type": F.lit("string"), "options": F.array(F.lit("none"))}
    )
    found = fields.field_violations(tables.values(spark, sf_dir), once.unionByName(again))
    return found.select("seq", "customer_id", "name", "value", "violation")


# Updates and masking.


@query
def field_values_current(spark, sf_dir):
    return values.last_writes(tables.values(spark, sf_dir)).select(
        "customer_id", "name", "value", "seq"
    )


def _text_id(rows: DataFrame) -> DataFrame:
    """Change rows whose id is text, some of it unusable."""
    given = F.col("customer_id").cast("string")
    odd = (
        F.when(F.col("seq") % 20 == 1, F.concat(F.lit("abc"), given))
        .when(F.col("seq") % 20 == 3, F.concat(F.lit("-"), given))
        .when(F.col("seq") % 20 == 5, F.concat(given, F.lit(".0")))
        .when(F.col("seq") % 20 == 7, F.concat(given, F.lit("d")))
        .when(F.col("seq") % 20 == 9, F.concat(given, F.lit("f")))
        .otherwise(given)
    )
    return rows.withColumn("customer_id", odd)


@query
def field_values_upsert(spark, sf_dir):
    held = tables.values(spark, sf_dir)
    current = values.last_writes(held.where("seq % 2 = 0")).select("customer_id", "name", "value")
    updated, _, _ = values.apply_updates(current, _text_id(held.where("seq % 2 = 1")))
    return updated


@query
def field_value_rejects(spark, sf_dir):
    _, rejects = values.split_changes(_text_id(tables.values(spark, sf_dir)))
    return rejects.select("seq", "customer_id", "name", "value")


@query
def customers_masked(spark, sf_dir):
    masked = mask_columns(tables.customers(spark, sf_dir), ["email"], ["phone", "registration_ip"])
    return masked.select("id", "email", "phone", "registration_ip")


@query
def part_slugs(spark, sf_dir):
    """Slugs and truth values over the part names."""
    parts = tables.table(spark, sf_dir, "part").withColumn(
        "text", F.concat(F.lit(" --"), F.upper("p_name"), F.lit("!! "), F.col("p_brand"), F.lit(" "))
    )
    parts = parts.withColumn("flag", F.when(F.col("p_size") % 3 == 0, "0").when(
        F.col("p_size") % 3 == 1, "")).withColumn("zero", F.col("p_partkey") % 2)
    return parts.select("p_partkey", slug(F.col("text")).alias("slug"),
                        truthy(parts, "flag").alias("flag_true"),
                        truthy(parts, "zero").alias("zero_true"))


# Runs.


@query
def run_status(spark, sf_dir):
    states = parse_run_states(tables.run_state_files(spark, sf_dir))
    return run_report(states).select(
        "key", "phase", F.col("percent").cast("bigint").alias("percent"),
        F.col("page_num").cast("bigint").alias("page_num"),
        F.col("collected").cast("bigint").alias("collected"), day("mtime"),
    )


# Landed sources: rows are written as JSON and read back through the readers.


@query
def landed_customers(spark, sf_dir):
    path = tables.land(tables.customer_pages(tables.customers(spark, sf_dir)), "customers")
    rows = landed.read_customers(spark, path, multiline=False)
    spec = ("ID:id,Email:email,First:first_name,Country:addresses[0].country,"
            "Zip:addresses[0].zip,Region:form_field:region")
    return export_rows(rows, parse_columns(spec))


@query
def landed_customers_rejects(spark, sf_dir):
    rows = tables.customers(spark, sf_dir)
    nowhere = F.array(F.struct(F.lit(None).cast("string").alias("country")))
    broken = rows.withColumns({
        "email": F.when(F.col("id") % 50 > 0, F.col("email")),
        "addresses": F.when(F.col("id") % 50 == 1, nowhere).otherwise(F.col("addresses")),
    })
    path = tables.land(tables.customer_pages(broken), "customers")
    sound, rejects = landed.read_customers(spark, path, multiline=False, mode="quarantine")
    bad = rejects.select(
        F.try_variant_get("row", "$.id", "bigint").alias("id"),
        F.array_join("problems", "; ").alias("problems"),
    )
    return bad.unionByName(sound.select("id", F.lit("").alias("problems")))


@query
def landed_field_values(spark, sf_dir):
    path = tables.land(tables.value_pages(tables.values(spark, sf_dir)), "values")
    rows = landed.read_field_values(spark, path, multiline=False)
    return rows.groupBy("customer_id", "name", "value").agg(F.count(F.lit(1)).alias("rows"))


def _land_rows(rows: DataFrame, label: str) -> str:
    return tables.land(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")), label)


@query
def landed_orders(spark, sf_dir):
    path = _land_rows(tables.orders(spark, sf_dir), "orders")
    return landed.read_orders(spark, path, multiline=False).select(
        "id", "customer_id", "email", "cart_id", "status", day("date_created")
    )


@query
def landed_orders_rejects(spark, sf_dir):
    """Rows with a broken key are set aside; an unlisted key of a sound one is read from ``extra``."""
    held = tables.orders(spark, sf_dir).select(
        F.when(F.col("id") % 11 == 0, F.col("id") + 0.5).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") % 13 == 0, "noon").otherwise(F.col("date_created").cast("string")).alias("date_created"),
        "total",
    )
    sound, rejects = landed.read_orders(spark, _land_rows(held, "orders"), multiline=False, mode="quarantine")
    kept = sound.select(F.col("id").cast("double").alias("id"), F.lit("").alias("problems"),
                        F.try_variant_get("extra", "$.total", "double").alias("total"))
    return kept.unionByName(rejects.select(
        F.try_variant_get("row", "$.id", "double").alias("id"),
        F.array_join("problems", "; ").alias("problems"),
        F.try_variant_get("row", "$.total", "double").alias("total"),
    ))


@query
def landed_carts_rejects(spark, sf_dir):
    """Carts without an id, or with a quantity in words, are set aside."""
    n = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")
    item = F.struct(F.lit("x").alias("name"), F.when(n % 5 == 0, "two").alias("quantity"))
    row = F.struct(F.when(n % 3 > 0, F.col("id")).alias("id"), n.alias("n"),
                   F.struct(F.array(item).alias("physical_items")).alias("line_items"))
    lines = tables.carts(spark, sf_dir).select(F.to_json(F.struct(row.alias("data"))).alias("value"))
    path = tables.land(lines, "carts")
    sound, rejects = landed.read_carts(spark, path, multiline=False, mode="quarantine")
    kept = sound.select(F.try_variant_get("extra", "$.n", "bigint").alias("n"), F.lit("").alias("problems"))
    return kept.unionByName(rejects.select(
        F.try_variant_get("row", "$.n", "bigint").alias("n"), F.array_join("problems", "; ").alias("problems")
    ))


@query
def landed_order_products(spark, sf_dir):
    path = _land_rows(tables.products(spark, sf_dir), "products")
    rows = landed.read_order_products(spark, path, multiline=False)
    return rows.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_products"),
        F.sum("quantity").alias("quantity"),
        F.sum("price").cast("double").alias("price"),
    )


@query
def landed_order_fees(spark, sf_dir):
    fees = tables.fees(spark, sf_dir).withColumns(
        {c: F.col(c).cast("decimal(18,2)").cast("string") for c in ("amount", "tax")}
    )
    rows = landed.read_order_fees(spark, _land_rows(fees, "fees"), multiline=False)
    return rows.groupBy("order_id", "name", "type").agg(
        F.count(F.lit(1)).alias("n_fees"), F.sum("tax").cast("double").alias("tax")
    )


@query
def landed_carts(spark, sf_dir):
    items = F.struct(F.col("physical_items"))
    row = F.struct("id", "customer_id", "created_time", items.alias("line_items"))
    carts = tables.carts(spark, sf_dir)
    lines = carts.select(F.to_json(F.struct(row.alias("data"))).alias("value"))
    rows = landed.read_carts(spark, tables.land(lines, "carts"), multiline=False)
    return rows.select("id", "customer_id", day("created_time"),
                       F.col("physical_items")[0]["sku"].alias("sku"),
                       F.size("physical_items").cast("bigint").alias("n_items"))


# CSV.


@query
def csv_round_trip(spark, sf_dir):
    rows = tables.customers(spark, sf_dir).select(
        F.col("id").cast("string").alias("Customer ID"),
        F.concat(F.lit('Said "'), F.col("email"), F.lit('",\nthen \\ left ')).alias("Note"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.col("company")).alias("Company"),
    )
    path = new_folder(spark, "csv")
    write_csv(rows, path)
    return read_csv(spark, path)


@query
def csv_column_values(spark, sf_dir):
    rows = tables.orders(spark, sf_dir).select(
        F.when(F.col("customer_id") % 4 == 0, "").otherwise(F.col("customer_id").cast("string"))
        .alias("Customer ID"),
        F.col("email").alias("Email"),
    )
    path = new_folder(spark, "csv")
    write_csv(rows, path)
    return column_values(spark, path, "Customer ID")


# Feeds: two waves of landed pages, the job run after each.


def _two_waves(held: DataFrame) -> list[DataFrame]:
    cut = F.lit(tables.BATCH_CUT).cast("timestamp_ntz")
    return [held.where(F.col("ts") < cut), held.where(F.col("ts") >= cut)]


@query
def feed_segment_resume(spark, sf_dir):
    pages, root = new_folder(spark, "pages"), new_folder(spark, "scans")
    ids = None
    for wave in _two_waves(tables.values(spark, sf_dir)):
        tables.land_more(tables.value_pages(wave), pages)
        ids = collect_segment(spark, pages, root, "Seven", FIELD, VALUE, multiline=False)
    return ids


@query
def feed_incremental_export(spark, sf_dir):
    pages, out, state = (new_folder(spark, x) for x in ("pages", "exports", "feed"))
    for wave in _two_waves(tables.values(spark, sf_dir)):
        tables.land_more(tables.value_pages(wave), pages)
        run_export_feed(spark, pages, tables.customers(spark, sf_dir), checkpoint=state,
                        key="seven", field=FIELD, value=VALUE, columns="Email:email",
                        out_dir=out, run_date=RUN_DATE, multiline=False)
    return read_csv(spark, f"{out}/seven/base").select("Customer ID", "Email")


@query
def feed_values_current(spark, sf_dir):
    landing, root, state = (new_folder(spark, x) for x in ("changes", "values", "feed"))
    for number, wave in enumerate(_two_waves(tables.values(spark, sf_dir))):
        lines = wave.select(
            F.to_json(F.struct(F.col("customer_id").cast("string").alias("customer_id"),
                               "name", "value", F.col("ts").cast("string").alias("ts"), "seq"))
            .alias("value")
        )
        tables.land_more(lines, landing)
        run_value_feed(stream_changes(spark, landing), root, state)
        if number == 0:
            compact(spark, root)
    return read_values(spark, root)


@query
def feed_segment_two_fields(spark, sf_dir):
    """Two fields scanned under one key: each scan is its own."""
    pages, root = new_folder(spark, "pages"), new_folder(spark, "scans")
    tables.land_more(tables.value_pages(tables.values(spark, sf_dir)), pages)
    out = None
    for field, value in ((FIELD, VALUE), ("click", "3")):
        ids = collect_segment(spark, pages, root, "Key", field, value, multiline=False)
        part = ids.select(F.lit(field).alias("field"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query
def feed_export_new_checkpoint(spark, sf_dir):
    """A second feed with a checkpoint of its own adds to the base and overwrites nothing."""
    out = new_folder(spark, "exports")
    for wave in _two_waves(tables.values(spark, sf_dir)):
        pages = new_folder(spark, "pages")
        tables.land_more(tables.value_pages(wave), pages)
        run_export_feed(spark, pages, tables.customers(spark, sf_dir), checkpoint=new_folder(spark, "feed"),
                        key="seven", field=FIELD, value=VALUE, columns="Email:email",
                        out_dir=out, run_date=RUN_DATE, multiline=False)
    return read_csv(spark, f"{out}/seven/base").select("Customer ID", "Email")


@query
def feed_values_two_sources(spark, sf_dir):
    """Two feeds with checkpoints of their own; what arrives later wins, folded or not."""
    root = new_folder(spark, "values")
    for number, wave in enumerate(_two_waves(tables.values(spark, sf_dir))):
        landing = new_folder(spark, "changes")
        tables.land_more(wave.select(
            F.to_json(F.struct(F.col("customer_id").cast("string").alias("customer_id"),
                               "name", "value", F.col("ts").cast("string").alias("ts"), "seq"))
            .alias("value")
        ), landing)
        run_value_feed(stream_changes(spark, landing), root, new_folder(spark, "feed"))
        if number == 0:
            compact(spark, root)
    return read_values(spark, root)


@query
def export_increment_custom_id(spark, sf_dir):
    """Columns that use the name of the id column for something else: the base keeps the id."""
    held = tables.values(spark, sf_dir)
    common = dict(
        customers=tables.customers(spark, sf_dir), key="custom", field=FIELD, value=VALUE,
        columns="Customer ID:email,Phone:phone", out_dir=new_folder(spark, "exports"),
        run_date=RUN_DATE, write=True,
    )
    first = export_segment(held.where("seq % 2 = 0"), run="first", **common)
    second = export_segment(held, run="second", incremental=True, **common)
    third = export_segment(held, run="third", incremental=True, **common)
    found = [read_csv(spark, run.base_path) for run in (first, second, third) if run.written]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("Customer ID", "Phone").withColumn("new_in_third", F.lit(third.fetched).cast("bigint"))


@query
def registry_file(spark, sf_dir):
    """A registry file of one entry an object, read back with each entry's place."""
    lines = tables.table(spark, sf_dir, "part").select(F.to_json(F.struct(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, "number").alias("type"),
        F.when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_type")).alias("options"),
    )).alias("value"))
    rows = read_registry_file(spark, tables.land(lines, "registry"), multiline=False)
    return _flat_options(rows).select("name", "type", "options", F.col("position").cast("bigint").alias("position"))


# Landing stores: pages are taken in once and then read as Parquet.


def _take_in(spark: SparkSession, kind: str, waves: list[DataFrame], fold_after: int | None = None) -> str:
    """The store that a feed makes of waves of landed lines."""
    pages, root, state = (new_folder(spark, x) for x in ("pages", "store", "feed"))
    for number, wave in enumerate(waves):
        tables.land_more(wave, pages)
        run_landing_feed(spark, pages, root, kind, checkpoint=state, multiline=False)
        if number == fold_after:
            compact_store(spark, root, kind)
    return root


def _as_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


@query
def stored_segment_export(spark, sf_dir):
    """The segment export from stores of values and customers, the first wave of values folded into a base."""
    waves = [tables.value_pages(wave) for wave in _two_waves(tables.values(spark, sf_dir))]
    held = read_store(spark, _take_in(spark, "field_values", waves, fold_after=0), "field_values", key=FIELD)
    people = _take_in(spark, "customers", [tables.customer_pages(tables.customers(spark, sf_dir))])
    ids, _ = segments.find_segment(held, FIELD, VALUE)
    found = segments.customers_of(read_store(spark, people, "customers"), ids)
    return export_rows(found, parse_columns(COLUMNS))


@query
def stored_values_by_field(spark, sf_dir):
    """All stored values, counted by field; those of one field asked for by its key."""
    waves = [tables.value_pages(wave) for wave in _two_waves(tables.values(spark, sf_dir))]
    root = _take_in(spark, "field_values", waves)
    whole = read_store(spark, root, "field_values").groupBy("name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("customer_id").alias("n_customers"))
    one = read_store(spark, root, "field_values", key=FIELD).groupBy(F.concat("name", F.lit(" alone")).alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("customer_id").alias("n_customers"))
    return whole.unionByName(one)


@query
def stored_orders_latest(spark, sf_dir):
    """Orders landed three times, with less and less of them; the last landing of an order counts."""
    held = tables.orders(spark, sf_dir)
    waves = [_as_lines(held.select("id", "customer_id", F.concat("status", F.lit(mark)).alias("status")).where(which))
             for mark, which in (("1", "true"), ("2", "id % 3 = 0"), ("3", "id % 6 = 0"))]
    return read_store(spark, _take_in(spark, "orders", waves, fold_after=1), "orders").select("id", "customer_id", "status")


@query
def stored_products_replaced(spark, sf_dir):
    """Products of an order that is landed again replace all it had before."""
    held = tables.products(spark, sf_dir).select("order_id", "sku", "quantity")
    again = held.where("order_id % 4 = 0").groupBy("order_id").agg(F.min("sku").alias("sku"), F.lit(1).alias("quantity"))
    root = _take_in(spark, "order_products", [_as_lines(held), _as_lines(again)])
    return read_store(spark, root, "order_products").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_products"), F.sum("quantity").alias("quantity"), F.min("sku").alias("first_sku"))


@query
def stored_rejects(spark, sf_dir):
    """Rows that break a rule are set aside with their problems, from the pass that stores the others."""
    held = tables.values(spark, sf_dir).select(
        F.when(F.col("seq") % 9 == 0, F.col("customer_id") + 0.5).otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(F.col("seq") % 7 > 0, F.col("name")).alias("name"), "value",
    )
    root = _take_in(spark, "field_values", [tables.value_pages(held)])
    bad = read_rejects(spark, root, "field_values").select(
        F.try_variant_get("row", "$.customer_id", "double").alias("customer_id"), F.array_join("problems", "; ").alias("problems"))
    good = read_store(spark, root, "field_values").select(F.col("customer_id").cast("double"), F.lit("").alias("problems"))
    return bad.unionByName(good).groupBy("customer_id", "problems").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def values_vacuumed(spark, sf_dir):
    """Current values after both waves were folded and the folders no longer needed deleted."""
    root, state = new_folder(spark, "values"), new_folder(spark, "feed")
    landing = new_folder(spark, "changes")
    deleted = []
    for wave in _two_waves(tables.values(spark, sf_dir)):
        tables.land_more(_as_lines(wave.select(
            F.col("customer_id").cast("string").alias("customer_id"), "name", "value",
            F.col("ts").cast("string").alias("ts"), "seq",
        )), landing)
        run_value_feed(stream_changes(spark, landing), root, state)
        compact(spark, root)
        deleted += vacuum(spark, root)
    return read_values(spark, root).withColumn("n_deleted", F.lit(len(deleted)).cast("bigint"))


@query
def export_ledger(spark, sf_dir):
    """Ledgers of a full run and of two increments: who was exported when."""
    held, out = tables.values(spark, sf_dir), new_folder(spark, "exports")
    found = None
    for run, which in (("first", "seq % 3 = 0"), ("second", "seq % 3 < 2"), ("third", "true")):
        result = export_segment(
            held.where(which), tables.customers(spark, sf_dir), key="ledger", field=FIELD, value=VALUE,
            columns="Email:email", out_dir=out, run_date=RUN_DATE, run=run, incremental=run != "first", write=True,
        )
        if result.written:
            rows = spark.read.schema("id BIGINT").parquet(f"{out}/ledger/ledger/*/run={run}").withColumn("run", F.lit(run))
            found = rows if found is None else found.unionByName(rows)
    return found


@query
def export_ledger_folded(spark, sf_dir):
    """The same runs told from the ledger, folded after the first and after the second."""
    held, out = tables.values(spark, sf_dir), new_folder(spark, "exports")
    for run, which in (("first", "seq % 3 = 0"), ("second", "seq % 3 < 2"), ("third", "true")):
        export_segment(
            held.where(which), tables.customers(spark, sf_dir), key="ledger", field=FIELD, value=VALUE,
            columns="Email:email", out_dir=out, run_date=RUN_DATE, run=run, incremental=run != "first", write=True,
        )
        if run != "third":
            compact_ledgers(spark, f"{out}/ledger")
    return exported_when(spark, f"{out}/ledger")

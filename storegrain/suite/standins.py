"""Store tables made from the driver's TPC-H-like tables, and their landed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.functions.catalog import STORE_TYPES
from storegrain.workspace import new_folder

MONEY = "decimal(18,2)"
BATCH_CUT = "2024-01-15 00:00:00"


TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,"
    " c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,"
    " p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
    " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
    " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,"
    " value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def email_of(customer_id: Column) -> Column:
    number = F.lpad(customer_id.cast("string"), 9, "0")
    return F.concat(F.lit("customer."), number, F.lit("@example.com"))


def customers(spark: SparkSession, sf_dir: str, *, dates: bool = False) -> DataFrame:
    """Customers with an address and two form fields; ``dates`` adds the order scan."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    base = table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("c_custkey")

    def field(name: str, value: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.array(F.col(value)).alias("value"))

    rows = base.select(
        key.alias("id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
        .alias("email"),
        F.lit("Customer").alias("first_name"),
        F.substr("c_name", F.lit(10)).alias("last_name"),
        F.concat(F.lit("555-"), F.lpad(key.cast("string"), 7, "0")).alias("phone"),
        F.col("c_mktsegment").alias("company"),
        F.col("c_nationkey").cast("bigint").alias("customer_group_id"),
        F.concat(F.lit("10.0.0."), (key % 256).cast("string")).alias("registration_ip"),
        F.array(F.struct(F.col("n_name").alias("country"))).alias("addresses"),
        F.array(field("segment", "c_mktsegment"), field("region", "r_name")).alias("form_fields"),
    )
    if not dates:
        return rows
    span = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("_owner")).agg(
        F.min("o_orderdate").alias("date_created"), F.max("o_orderdate").alias("date_modified")
    )
    return rows.join(span, F.col("id") == F.col("_owner"), "left").drop("_owner")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"),
        F.col("event_type").alias("name"),
        F.get_json_object("props", "$.k").alias("value"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("customer_id"),
        email_of(F.col("o_custkey")).alias("email"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("cart-"), key.cast("string")))
        .alias("cart_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("date_created"),
        F.col("o_totalprice").cast(MONEY).alias("total"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("sku"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
    )


def fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, rate = F.col("l_extendedprice").cast(MONEY), F.col("l_tax").cast("decimal(4,2)")
    return table(spark, sf_dir, "lineitem").where("l_tax > 0").select(
        F.col("l_orderkey").alias("order_id"),
        F.lit("tax").alias("name"),
        F.lit("custom").alias("type"),
        (price * rate).alias("amount"),
        rate.alias("tax"),
    )


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carts of open orders; completed orders have lost theirs."""
    key = F.col("o_orderkey").cast("string")
    item = F.struct(
        F.concat(F.lit("Order "), key).alias("name"),
        F.lit(1).alias("quantity"),
        F.concat(F.lit("O-"), key).alias("sku"),
    )
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(
        F.concat(F.lit("cart-"), key).alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("created_time"),
        F.col("o_orderdate").alias("updated_time"),
        F.array(item).alias("physical_items"),
    )


def registry(spark: SparkSession) -> DataFrame:
    """Four of the five event types; ``purchase`` lists its values, ``error`` is missing."""
    options = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda n: n.cast("string"))
    names = spark.sql("SELECT * FROM VALUES ('click'), ('view'), ('purchase'), ('signup') AS t(name)")
    return names.select(
        "name",
        F.when(F.col("name") == "signup", "boolean").otherwise("number").alias("type"),
        F.when(F.col("name") == "purchase", options).alias("options"),
    )


# Landed JSON. One row per page, so that making pages needs no grouping.


def page_of(row: Column) -> Column:
    """Envelope text around one row object."""
    no_meta = F.create_map().cast("map<string,string>")
    return F.to_json(F.struct(F.array(row).alias("data"), no_meta.alias("meta")))


def land(lines: DataFrame, label: str) -> str:
    """Write one text column as lines and return the folder."""
    path = new_folder(lines.sparkSession, label)
    lines.write.text(path)
    return path


def land_more(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def customer_pages(rows: DataFrame) -> DataFrame:
    """Customer pages as a store lands them: one field a text, one a list."""

    def landed(field: Column) -> Column:
        first = F.get(field.getField("value"), F.lit(0))
        return F.struct(field.getField("name").alias("name"), first.alias("value"))

    fields = F.transform("form_fields", landed)
    address = F.struct(F.col("addresses")[0]["country"].alias("country"),
                       F.col("customer_group_id").alias("zip"))
    row = F.struct(
        *[c for c in rows.columns if c not in ("addresses", "form_fields")],
        F.array(address).alias("addresses"), fields.alias("form_fields"),
    )
    return rows.select(page_of(row).alias("value"))


def value_pages(rows: DataFrame) -> DataFrame:
    return rows.select(page_of(F.struct("customer_id", "name", "value")).alias("value"))


def catalog_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field definition per part, in varying keys and both payload shapes."""
    n = F.col("p_partkey")
    label = F.concat(F.initcap("p_name"), F.lit(" "), n.cast("string"))
    names = [F.when(n % 5 == i, label).alias(k)
             for i, k in enumerate(("name", "label", "field_name", "title"))]
    known = F.array(*[F.lit(t) for t in [*STORE_TYPES, "weird"]])
    bare = F.get(known, (F.col("p_size") % (len(STORE_TYPES) + 1)).cast("int"))
    wrapped = F.when(n % 2 == 0, bare).otherwise(
        F.upper(F.concat(F.lit("type_"), bare, F.lit("_field")))
    )
    types = [F.when(n % 3 == i, wrapped).alias(k)
             for i, k in enumerate(("type", "form_field_type", "field_type"))]
    none = F.array().cast("array<string>")
    nested = F.when(n % 4 == 0, F.array("p_brand", "p_type")).when(n % 4 == 1, none)
    row = F.struct(
        *names, *types,
        F.when(n % 7 == 0, 1).when(n % 7 == 1, 0).alias("private_id"),
        (n % 2 == 0).alias("required"),
        F.struct(nested.alias("options")).alias("extra_info"),
        F.when(n % 4 != 3, F.array("p_brand")).alias("options"),
    )
    listed = F.to_json(F.array(row))
    shaped = F.when(n % 3 == 0, F.concat(F.lit('{"data":'), listed, F.lit("}"))).otherwise(listed)
    return table(spark, sf_dir, "part").select(shaped.alias("value"))


def run_state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, mtime, text): one saved run per order."""
    n = F.col("o_orderkey")
    ids = F.when(n % 7 > 0, F.sequence(F.lit(1), (n % 7).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    done = F.when(F.col("o_orderstatus") == "F", F.least(n % 7, n % 3)).otherwise(0)
    state = F.struct(
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("c"), n.cast("string")))
        .alias("cursor"),
        (n % 11).alias("pageNum"),
        ids.alias("collectedIds"),
        done.alias("processedIdIndex"),
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit(".progress-run-"), n.cast("string"), F.lit(".json")).alias("file"),
        F.col("o_orderdate").alias("mtime"),
        F.to_json(state).alias("text"),
    )

"""Order lookups: latest orders, products, fees, customers and carts.

Lookups take a table of keys.  Where the planner cannot know how many keys or
hits there are, they go through a written table (``stage``): its size is known,
so a small one is broadcast and the big tables are scanned without a shuffle,
while a large one is joined by shuffling both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.operators.keys import (
    asked_keys,
    keep_matching,
    left_join_filled,
    one_per_key,
    top_n,
    top_n_of,
)
from storegrain.operators.nesting import attach, nest_and_attach, part_column
from storegrain.workspace import stage

# How many latest orders a lookup returns unless told otherwise.
RECENT_ORDERS = 10
ORDERS_PER_EMAIL = 50

# Outcomes of a cart lookup.
FOUND, CART_GONE = "found", "cart gone"
NO_CART, NO_ORDER = "order has no cart", "order not found"


def newest_first() -> list:
    return [F.desc("date_created"), F.desc("id")]


def sort_newest_first(orders: DataFrame) -> DataFrame:
    return orders.orderBy(*newest_first())


def with_customer(orders: DataFrame) -> DataFrame:
    """Orders of a known customer: the id is neither null nor 0."""
    return orders.where(F.col("customer_id") > 0)


def guest_orders(orders: DataFrame) -> DataFrame:
    """The complement of :func:`with_customer`."""
    return orders.where(F.coalesce(F.col("customer_id"), F.lit(0)) <= 0)


def recent_orders(orders: DataFrame, n: int = RECENT_ORDERS) -> DataFrame:
    """The ``n`` latest orders of each customer, numbered in ``recency``."""
    return top_n(with_customer(orders), "customer_id", newest_first(), n, "recency")


def _product_columns(products: DataFrame) -> list[str]:
    return [c for c in products.columns if c != "order_id"]


def order_product_rows(orders: DataFrame, products: DataFrame) -> DataFrame:
    """One row per product of the given orders: the order's columns and ``product``."""
    rows = products.select(
        F.col("order_id").alias("_order"), F.struct(*_product_columns(products)).alias("product")
    )
    return orders.join(rows, orders["id"] == rows["_order"]).drop("_order")


def with_products(orders: DataFrame, products: DataFrame, *, parts: int = 1) -> DataFrame:
    """Orders with their products nested in ``products``; none is an empty list.

    Each order has ``parts`` rows, see ``nesting``.
    """
    return nest_and_attach(orders, "id", products, "order_id",
                           _product_columns(products), "products", parts)


def products_of(orders: DataFrame, products: DataFrame) -> DataFrame:
    """The products of some orders, cut out of the product table."""
    return keep_matching(products, orders, "order_id", "id")


def with_fees(orders: DataFrame, fees: DataFrame, *, parts: int = 1) -> DataFrame:
    elements = [c for c in fees.columns if c != "order_id"]
    return nest_and_attach(orders, "id", fees, "order_id", elements, "fees", parts)


def order_fees(orders: DataFrame, fees: DataFrame) -> DataFrame:
    """One row per fee of the given orders."""
    return fees.join(orders.select(F.col("id").alias("order_id")), "order_id")


def orders_by_email(orders: DataFrame, emails: DataFrame, products: DataFrame | None = None,
                    n: int = ORDERS_PER_EMAIL, *, parts: int = 1) -> DataFrame:
    """The ``n`` latest orders placed under each email, with products if given."""
    asked = asked_keys(emails, "email")
    latest = top_n_of(orders, asked, "email", newest_first(), n, "recency")
    if products is None:
        return latest
    latest = stage(latest, "latest-orders")
    return with_products(latest, products_of(latest, products), parts=parts)


def customers_by_order(order_ids: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """(``order_id``, customer columns) for each order of a known customer."""
    asked = with_customer(keep_matching(orders, order_ids, "id", "order_id"))
    owners = asked.select(F.col("id").alias("order_id"), F.col("customer_id").alias("_owner"))
    owners = stage(owners, "owners")
    return owners.join(customers, owners["_owner"] == customers["id"]).drop("_owner")


def recent_order_rows(customers: DataFrame, orders: DataFrame, n: int = RECENT_ORDERS) -> DataFrame:
    """The ``n`` latest orders of each of the customers, one row each."""
    asked = asked_keys(customers, "id")
    return top_n_of(with_customer(orders), asked, "customer_id", newest_first(), n, "recency")


def with_recent_orders(customers: DataFrame, orders: DataFrame, products: DataFrame,
                       n: int = RECENT_ORDERS, *, parts: int = 1) -> DataFrame:
    """Customers with ``recent_orders``, newest first, each holding its products.

    A customer without orders keeps an empty list. Each customer has ``parts``
    rows; all of them list the same orders, each with a part of its products.
    """
    latest = stage(recent_order_rows(customers, orders, n), "latest-orders")
    full = with_products(latest, products_of(latest, products), parts=parts)
    fields = ["recency", *[c for c in orders.columns if c != "customer_id"], "products"]
    part = part_column("products")
    nested = full.groupBy("customer_id", part).agg(
        F.array_sort(
            F.collect_list(F.struct(*fields)),
            lambda a, b: (a["recency"] - b["recency"]).cast("int"),
        ).alias("recent_orders")
    )
    nested = nested.withColumnRenamed(part, part_column("recent_orders"))
    return attach(customers, "id", nested, "customer_id", "recent_orders", parts)


def customers_of_orders(order_ids: DataFrame, orders: DataFrame, customers: DataFrame,
                        products: DataFrame, n: int = RECENT_ORDERS) -> DataFrame:
    """The customers of the orders asked for, each once, with their recent orders nested."""
    found = stage(one_per_key(customers_by_order(order_ids, orders, customers).drop("order_id"), "id"), "owners-found")
    return with_recent_orders(found, orders, products, n)


def first_customers(customers: DataFrame, emails: DataFrame) -> DataFrame:
    """For each email the customer with the lowest id; unknown emails keep nulls."""
    wanted = stage(emails.select("email").distinct(), "emails")
    asked = wanted.where("email IS NOT NULL").withColumnRenamed("email", "_key")
    first = top_n_of(customers, asked, "email", [F.asc("id")], 1, "_rank").drop("_rank")
    return wanted.join(first, "email", "left")


def carts_by_order(order_ids: DataFrame, orders: DataFrame, carts: DataFrame) -> DataFrame:
    """The cart of each order id, with an ``outcome`` in place of an error; a null id is no order."""
    asked = stage(order_ids.select("order_id").distinct(), "order-ids")
    return _look_up_carts(_order_keys(asked, orders), carts, "order_id")


def carts_by_key(keys: DataFrame, orders: DataFrame, carts: DataFrame) -> DataFrame:
    """Carts for a mix of keys: all digits is an order id, anything else a cart id.

    A null or empty key is an order that is not found.
    """
    asked = stage(keys.select("key").distinct(), "cart-keys")
    digits = F.coalesce(F.col("key").rlike("^[0-9]*$"), F.lit(True))
    by_order = _order_keys(
        asked.where(digits).withColumn("order_id", F.expr("try_cast(key as bigint)")), orders
    )
    direct = asked.where(~digits).select(
        "key",
        F.lit(None).cast("bigint").alias("order_id"),
        F.col("key").alias("cart_id"),
        F.lit(True).alias("known"),
    )
    keyed = by_order.select("key", "order_id", "cart_id", "known").unionByName(direct)
    return _look_up_carts(keyed, carts, "key")


def _order_keys(asked: DataFrame, orders: DataFrame) -> DataFrame:
    """The cart id of each order asked for; only what matched is freed of copies."""
    cart_of = orders.select(
        F.col("id").alias("_id"), F.nullif("cart_id", F.lit("")).alias("cart_id"),
        F.lit(True).alias("known"),
    )
    cart_of = one_per_key(keep_matching(cart_of, asked, "_id", "order_id"), "_id")
    return asked.join(cart_of, asked["order_id"] == cart_of["_id"], "left").drop("_id")


def _look_up_carts(keyed: DataFrame, carts: DataFrame, spread: str) -> DataFrame:
    keyed = stage(keyed, "cart-ids")
    found = carts.withColumnsRenamed({c: f"cart_{c}" for c in carts.columns if c != "id"})
    found = found.withColumnRenamed("id", "_cart")
    # Written, so that a cart of very many orders can be split in the join below.
    found = stage(one_per_key(keep_matching(found, keyed, "_cart", "cart_id"), "_cart"), "carts-found")
    joined = left_join_filled(keyed, found, "cart_id", "_cart", spread)
    outcome = (
        F.when(F.col("_cart").isNotNull(), FOUND)
        .when(F.col("known").isNull(), NO_ORDER)
        .when(F.col("cart_id").isNull(), NO_CART)
        .otherwise(CART_GONE)
    )
    return joined.withColumn("outcome", outcome).drop("known", "_cart")

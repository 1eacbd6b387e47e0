import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from storegrain.operators import keys, orders

RNG = random.Random(5)


@pytest.fixture(scope="module")
def order_rows(spark):
    rows = []
    for i in range(1, 201):
        customer = RNG.choice([None, 0, 1, 1, 1, 2, 3, 4])
        cart = RNG.choice([None, "", f"cart-{i}", "cart-shared"])
        rows.append((i, customer, f"m{i % 5}@x.y", cart, "ok", f"2024-01-{RNG.randint(1, 9):02d}"))
    return rows


@pytest.fixture(scope="module")
def all_orders(spark, order_rows):
    df = spark.createDataFrame(order_rows, """id BIGINT, customer_id BIGINT, email STRING,
        cart_id STRING, status STRING, day STRING""")
    return df.withColumn("date_created", F.col("day").cast("timestamp_ntz")).drop("day")


@pytest.fixture(scope="module")
def product_rows(spark):
    """Order 7 holds a third of the rows, most of them one and the same product."""
    rows = [(RNG.randint(1, 200), f"S{RNG.randint(1, 9)}", "n", 1, "1.00") for _ in range(600)]
    rows += [(7, "SAME", "copy", 2, "3.50")] * 250 + [(7, f"T{i}", "n", 1, "1.00") for i in range(50)]
    return rows


@pytest.fixture(scope="module")
def all_products(spark, product_rows):
    df = spark.createDataFrame(product_rows, "order_id BIGINT, sku STRING, name STRING, quantity INT, price STRING")
    return df.withColumn("price", F.col("price").cast("decimal(18,2)"))


def newest(rows, key, n):
    groups = defaultdict(list)
    for r in rows:
        groups[key(r)].append(r)
    return {k: [r[0] for r in sorted(g, key=lambda r: (r[5], r[0]), reverse=True)[:n]]
            for k, g in groups.items()}


@pytest.fixture(params=["10MB", "-1"], ids=["broadcast", "shuffled"])
def join_limit(request, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_guests_and_known(all_orders, order_rows):
    guests = {r[0] for r in order_rows if not r[1]}
    assert {r.id for r in orders.guest_orders(all_orders).collect()} == guests
    assert orders.with_customer(all_orders).count() == len(order_rows) - len(guests)


@pytest.mark.parametrize("n", [1, 10, 1500])
def test_recent_orders(all_orders, order_rows, n):
    found = defaultdict(list)
    for r in orders.recent_orders(all_orders, n).orderBy("recency").collect():
        found[r.customer_id].append(r.id)
    assert found == newest([r for r in order_rows if r[1]], lambda r: r[1], n)


@pytest.mark.parametrize("parts", [1, 3])
def test_products_nested_whole(all_orders, all_products, product_rows, parts):
    """Each order has as many rows as the caller says, whatever it holds."""
    wanted = {i: [] for i in range(1, 201)}
    for order, sku, _, quantity, _ in product_rows:
        wanted[order].append((sku, quantity))
    rows = orders.with_products(all_orders, all_products, parts=parts).collect()
    assert Counter(r.id for r in rows) == dict.fromkeys(wanted, parts)
    lists = defaultdict(list)
    for r in rows:
        lists[r.id] += [(p.sku, p.quantity) for p in r.products]
        assert r.products == sorted(r.products)
    assert {k: sorted(v) for k, v in lists.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_the_number_of_rows_does_not_depend_on_the_number_of_products(spark, all_orders):
    """An order of 12,000 products is one row nested, and 12,000 flat."""
    many = spark.range(12_000).selectExpr("3L AS order_id", "concat('S', id) AS sku", "'n' AS name", "1 AS quantity")
    nested = orders.with_products(all_orders, many)
    assert nested.count() == 200
    assert nested.where("id = 3").select(F.size("products")).head()[0] == 12_000
    assert orders.order_product_rows(all_orders, many).count() == 12_000


def test_nested_rows_may_hold_variants(spark, all_orders):
    rows = [(3, "b", '{"x": 2}'), (3, "a", '{"x": 1}'), (3, "a", '{"x": 1}'), (4, "c", "null")]
    held = spark.createDataFrame(rows, "order_id BIGINT, sku STRING, t STRING").select(
        "order_id", "sku", F.parse_json("t").alias("extra"))
    nested = {r.id: r.products for r in orders.with_products(all_orders, held).collect()}
    assert [(p.sku, p.extra.toPython()) for p in nested[3]] == [("a", {"x": 1}), ("a", {"x": 1}), ("b", {"x": 2})]
    assert keys.one_per_key(held, "order_id").count() == 2


def test_orders_with_fees(spark, all_orders):
    fees = spark.createDataFrame([(10, "Tip", "custom", 5, 0)], "order_id BIGINT, name STRING, type STRING, amount INT, tax INT")
    nested = {r.id: r.fees for r in orders.with_fees(all_orders, fees).collect()}
    assert len(nested) == 200 and nested[10] == [("Tip", "custom", 5, 0)] and nested[11] == []
    assert orders.order_fees(all_orders.where("id <> 10"), fees).count() == 0
    assert orders.order_fees(all_orders, fees).count() == 1


def test_orders_by_email(join_limit, spark, all_orders, order_rows, all_products, product_rows):
    emails = spark.createDataFrame([("m1@x.y",), ("m2@x.y",), ("none@x.y",), ("m1@x.y",), (None,)], "email STRING")
    wanted = newest([r for r in order_rows if r[2] in ("m1@x.y", "m2@x.y")], lambda r: r[2], 3)
    for products in (None, all_products):
        found = defaultdict(list)
        for r in orders.orders_by_email(all_orders, emails, products, n=3).orderBy("recency").collect():
            found[r.email].append(r.id)
            if products is not None:
                assert len(r.products) == sum(p[0] == r.id for p in product_rows)
        assert found == wanted
    assert orders.orders_by_email(all_orders.limit(0), emails).count() == 0


@pytest.mark.parametrize("parts", [1, 2])
def test_with_recent_orders(join_limit, spark, all_orders, order_rows, all_products, product_rows, parts):
    people = spark.createDataFrame([(1, "hot"), (2, "b"), (99, "none")], "id BIGINT, email STRING")
    n = 200
    wanted = newest([r for r in order_rows if r[1]], lambda r: r[1], n)
    rows = orders.with_recent_orders(people, all_orders, all_products, n, parts=parts).collect()
    assert len(rows) == 3 * parts
    for r in rows:
        assert [o.id for o in r.recent_orders] == (wanted[r.id] if r.id != 99 else [])
    count = Counter()
    for r in rows:
        for o in r.recent_orders:
            count[o.id] += len(o.products)
    for order in wanted[1] + wanted[2]:
        assert count[order] == sum(p[0] == order for p in product_rows)


def test_customers_of_orders(spark, all_orders, order_rows, all_products):
    """Several orders of one customer give that customer once."""
    people = spark.createDataFrame([(1, "one"), (2, "two")], "id BIGINT, email STRING")
    asked = [r[0] for r in order_rows if r[1] in (1, 2)][:9]
    found = orders.customers_of_orders(
        spark.createDataFrame([(i,) for i in asked + asked], "order_id BIGINT"), all_orders, people, all_products, 4).collect()
    wanted = newest([r for r in order_rows if r[1]], lambda r: r[1], 4)
    owners = {r[1] for r in order_rows if r[0] in asked}
    assert {r.id: [o.id for o in r.recent_orders] for r in found} == {i: wanted[i] for i in owners}
    assert len(found) == len(owners)


def test_first_customers(join_limit, spark):
    people = spark.createDataFrame([(5, "a@x"), (3, "a@x"), (4, "b@x"), (1, None)], "id BIGINT, email STRING")
    asked = spark.createDataFrame([("a@x",), ("z@x",), ("a@x",), (None,)], "email STRING")
    found = [(r.email, r.id) for r in orders.first_customers(people, asked).collect()]
    assert sorted(found, key=str) == sorted([("a@x", 3), ("z@x", None), (None, None)], key=str)


def test_customers_by_order(spark, all_orders, order_rows):
    people = spark.createDataFrame([(1, "one"), (2, "two")], "id BIGINT, email STRING")
    asked = spark.createDataFrame([(r[0],) for r in order_rows[:50]] + [(1,), (9999,)], "order_id BIGINT")
    found = orders.customers_by_order(asked, all_orders, people).collect()
    wanted = {r[0]: r[1] for r in order_rows[:50] if r[1] in (1, 2)}
    assert {r.order_id: r.id for r in found} == wanted and len(found) == len(wanted)


def test_carts(join_limit, spark, all_orders, order_rows):
    carts = spark.createDataFrame([("cart-shared", 5), ("cart-10", 6), ("cart-10", 6), ("abc-def-123", 7)], "id STRING, customer_id BIGINT")
    known = {r[0]: r[3] for r in order_rows}
    alive = {"cart-shared", "cart-10", "abc-def-123"}

    def outcome(order):
        if order not in known:
            return orders.NO_ORDER
        if not known[order]:
            return orders.NO_CART
        return orders.FOUND if known[order] in alive else orders.CART_GONE

    asked = spark.createDataFrame([(i,) for i in range(1, 211)], "order_id BIGINT")
    rows = orders.carts_by_order(asked, all_orders.union(all_orders), carts).collect()
    assert {r.order_id: r.outcome for r in rows} == {i: outcome(i) for i in range(1, 211)}
    assert len(rows) == 210

    mixed = spark.createDataFrame([("abc-def-123",), ("gone-1",), ("10",), ("5000",), ("9" * 30,), ("10",), ("-5",), (None,), ("",)], "key STRING")
    rows = orders.carts_by_key(mixed, all_orders, carts).collect()
    assert {r.key: r.outcome for r in rows} == {
        "abc-def-123": orders.FOUND, "gone-1": orders.CART_GONE, "10": outcome(10),
        "5000": orders.NO_ORDER, "9" * 30: orders.NO_ORDER, "-5": orders.CART_GONE,
        None: orders.NO_ORDER, "": orders.NO_ORDER}
    assert len(rows) == 8


def test_sort_newest_first(all_orders, order_rows):
    wanted = [r[0] for r in sorted(order_rows, key=lambda r: (r[5], r[0]), reverse=True)]
    assert [r.id for r in orders.sort_newest_first(all_orders).collect()] == wanted

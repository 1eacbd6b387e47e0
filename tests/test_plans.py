"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from storegrain.operators import keys, orders, segments, values
from storegrain.suite import standins as tables
from storegrain.suite.queries import REGISTERED
from storegrain.workspace import stage

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_no_python_no_cross_join(spark, name):
    text = plan(REGISTERED[name](spark, SF_DIR))
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_segment_plan(spark):
    ids = segments.segment_ids(tables.values(spark, SF_DIR), "purchase", "7")
    text = plan(segments.customers_of(tables.customers(spark, SF_DIR), ids))
    assert "LeftSemi" in text
    assert "EqualTo(event_type,purchase)" in text and "GreaterThan(user_id,0)" in text
    scans = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert "user_id:bigint,event_type:string,props:string" in scans
    assert not any("c_acctbal" in s or "o_" in s for s in scans)


def test_search_filters_reach_the_scan(spark):
    text = plan(REGISTERED["search_exact"](spark, SF_DIR))
    assert "EqualTo(c_custkey,42)" in text
    assert "EqualTo(c_mktsegment,MACHINERY)" in text


def test_top_n_is_limited_before_the_exchange(spark):
    text = plan(orders.recent_orders(tables.orders(spark, SF_DIR)))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_a_lookup_changes_no_setting(spark):
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    orders.recent_orders(tables.orders(spark, SF_DIR), 5000).collect()
    assert spark.conf.get(name) == before


def test_a_lookup_by_key_shares_the_exchange_of_its_join(spark):
    """Without a broadcast: one exchange a side, and none more for the window above."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = tables.orders(spark, SF_DIR)
        mine = keys.keep_matching(held, tables.customers(spark, SF_DIR), "email")
        text = plan(keys.top_n(mine, "email", orders.newest_first(), 10, "recency"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" in text and "Exchange" not in text[: text.index("LeftSemi")]


def test_last_writes_combine_in_each_task(spark):
    text = plan(values.last_writes(tables.values(spark, SF_DIR)))
    assert "partial_max" in text and text.count("Exchange\n") <= 2


def test_upsert_uses_an_anti_join(spark):
    assert "LeftAnti" in plan(REGISTERED["field_values_upsert"](spark, SF_DIR))
    assert "LeftAnti" in plan(REGISTERED["segment_export_incremental"](spark, SF_DIR))


def test_one_exchange_to_nest(spark):
    nested = orders.with_products(tables.orders(spark, SF_DIR), tables.products(spark, SF_DIR))
    text = plan(nested)
    assert "REPARTITION_BY_COL" in text and text.count("Exchange (") <= 4


SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
}


@pytest.fixture
def small_partitions(spark):
    for name, value in SMALL_PARTITIONS.items():
        spark.conf.set(name, value)
    yield
    for name in SMALL_PARTITIONS:
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Rows of which 99 in 100 share one id, email and cart."""
    path = str(tmp_path_factory.mktemp("skewed") / "rows")
    spark.range(300_000).selectExpr(
        "id AS seq", "if(id % 100 = 0, id, 5) AS id", "if(id % 100 = 0, id, 5) AS customer_id",
        "if(id % 100 = 0, id, 5) AS order_id",
        "if(id % 100 = 0, concat('m', id), 'hot') AS email",
        "if(id % 100 = 0, concat('c', id), 'hot') AS cart_id",
        "date_add(date'2024-01-01', cast(id % 300 as int)) AS date_created",
        "uuid() AS note").repartition(16).write.parquet(path)
    return spark.read.parquet(path)


def finished_plan(df) -> str:
    df.collect()
    return plan(df)


def test_skew_below_a_top_n_is_split_where_the_session_asks_for_it(spark, skewed, small_partitions):
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    try:
        mine = keys.keep_matching(skewed, skewed.select("email").distinct(), "email")
        latest = keys.top_n(mine, "email", orders.newest_first(), 10, "recency")
        assert latest.where("email = 'hot'").count() == 10
    finally:
        spark.conf.unset("spark.sql.adaptive.forceOptimizeSkewedJoin")


def test_skew_in_a_segment_is_split(spark, skewed, small_partitions):
    found = segments.customers_of(skewed, spark.range(1, 1000))
    assert "skew=true" in finished_plan(found)
    assert found.where("id = 5").count() == 297_000


def test_skew_in_fees_is_split(spark, skewed, small_partitions):
    fees = orders.order_fees(spark.range(300_000).withColumn("x", F.uuid()), skewed)
    assert "skew=true" in finished_plan(fees)


def test_skew_in_order_owners_is_split(spark, skewed, small_partitions):
    held = skewed.select(F.col("seq").alias("id"), "customer_id", "note")
    asked = spark.range(300_000).select(F.col("id").alias("order_id"))
    found = orders.customers_by_order(asked, held, spark.range(300_000).withColumn("x", F.uuid()))
    assert "skew=true" in finished_plan(found)
    assert found.where("id = 5").count() == 297_000


def test_skew_in_cart_ids_is_split(spark, skewed, small_partitions):
    keyed = skewed.select(F.col("seq").alias("order_id"), "cart_id", "note")
    carts = stage(keys.one_per_key(skewed.select(F.col("cart_id").alias("_cart"), "seq"), "_cart"), "carts")
    joined = keys.left_join_filled(keyed, carts, "cart_id", "_cart", "order_id")
    assert "skew=true" in finished_plan(joined)
    assert joined.count() == 300_000

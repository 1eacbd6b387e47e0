import pytest
from pyspark.sql import functions as F

from storegrain.operators import fields, segments, values
from storegrain.operators.search import (
    SORTS,
    SearchError,
    SearchFilters,
    search_customers,
    sort_customers,
)
from storegrain.sources.value_table import append_changes, compact, read_values

VALUES = [(1, "F", "Y"), (2, "F", "N"), (0, "F", "Y"), (-4, "F", "Y"), (3, "F", None),
          (4, "F", "y"), (1, "F", "Y"), (5, "G", "Y"), (6, "F", "Y")]


@pytest.fixture(scope="module")
def held(spark):
    return spark.createDataFrame(VALUES, "customer_id BIGINT, name STRING, value STRING")


@pytest.fixture(scope="module")
def everyone(spark):
    rows = [(i, f"u{i}@x.y", "Ann", f"Lee{9 - i}", f"555-{i}", "Acme" if i % 2 else None,
             i % 3, f"10.0.0.{i}") for i in range(1, 6)]
    df = spark.createDataFrame(rows, """id BIGINT, email STRING, first_name STRING, last_name STRING,
        phone STRING, company STRING, customer_group_id BIGINT, registration_ip STRING""")
    return df.withColumn("date_created", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int))")) \
        .withColumn("date_modified", F.expr("timestamp '2024-02-01 00:00:00' - make_interval(0, 0, 0, cast(id as int))"))


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_segment(held, everyone):
    found = segments.segment_ids(held, "F", "Y")
    assert ids(found) == [1, 6]
    assert ids(segments.customers_of(everyone, found)) == [1]


def test_segment_counts(held, everyone):
    assert segments.segment_counts(held, everyone, "F", "Y").collect() == [(3, 2, 1)]
    assert segments.segment_counts(held, everyone, "F", "none").collect() == [(0, 0, 0)]


def test_not_exported_compares_text(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "id BIGINT")
    base = spark.createDataFrame([("1",), ("2",), ("03",), ("",)], "`Customer ID` STRING")
    assert ids(segments.not_exported(wanted, base, "Customer ID")) == [3]


def test_pivot_keeps_the_first(spark):
    df = spark.createDataFrame([(1, "a", "x", 2), (1, "a", "w", 1), (1, "b", "z", 3), (2, "c", "q", 4), (2, "b", None, 5)],
                               "customer_id BIGINT, name STRING, value STRING, seq INT")
    assert sorted(map(tuple, segments.pivot_fields(df, ["a", "b"], "seq").collect())) == [
        (1, "w", "z"), (2, None, None)]


@pytest.mark.parametrize("filters, wanted", [
    (dict(id=3), [3]),
    (dict(email="u2@x.y"), [2]),
    (dict(name="Ann Lee5"), [4]),
    (dict(name="ann lee5"), []),
    (dict(name_like="NN LEE"), [1, 2, 3, 4, 5]),
    (dict(name_like="lee%"), []),
    (dict(phone="555-1"), [1]),
    (dict(company="Acme"), [1, 3, 5]),
    (dict(company_like="CM"), [1, 3, 5]),
    (dict(customer_group_id=2), [2, 5]),
    (dict(customer_group_id=0, company="Acme"), [3]),
    (dict(registration_ip="10.0.0.5"), [5]),
    (dict(date_created_min="2024-01-03T00:00:00Z"), [2, 3, 4, 5]),
    (dict(date_created_max="2024-01-03T00:00:00+00:00"), [1, 2]),
    (dict(date_created_min="2024-01-03T02:00:00+02:00", date_created_max="2024-01-04"), [2, 3]),
    (dict(date_modified_min="2024-01-30", date_modified_max="2024-01-30T00:00:00Z"), [2]),
    (dict(company="Acme", email="", date_created_min="2024-01-05"), [5]),
    (dict(company="Acme", id=2), []),
])
def test_filters(everyone, filters, wanted):
    assert ids(search_customers(everyone, SearchFilters(**filters))) == wanted


@pytest.mark.parametrize("filters", [dict(), dict(email="", name=""), dict(customer_group_id=0)])
def test_a_filter_is_needed(everyone, filters):
    with pytest.raises(SearchError, match="at least one"):
        search_customers(everyone, SearchFilters(**filters))


def test_sorts(everyone):
    order = {s: [r.id for r in sort_customers(everyone, s).collect()] for s in SORTS}
    up, down = [1, 2, 3, 4, 5], [5, 4, 3, 2, 1]
    assert order == {"date_created:asc": up, "date_created:desc": down,
                     "date_modified:asc": down, "date_modified:desc": up,
                     "last_name:asc": down, "last_name:desc": up}
    with pytest.raises(SearchError, match="unknown sort"):
        sort_customers(everyone, "id:asc")


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(
        [("Trusted", "boolean", ["True", "False"]), ("Free", None, None), ("None", None, [])],
        "name STRING, type STRING, options ARRAY<STRING>")


def test_request_checks(registry):
    fields.check_request(registry, "Trusted", "True")
    fields.check_request(registry, "Free", "anything")
    fields.check_request(registry.limit(0), "whatever", "value")
    for field, value in (("Unknown", "True"), ("trusted", "True"), ("Trusted", "Maybe"), ("None", "x")):
        with pytest.raises(fields.FieldRequestError):
            fields.check_request(registry, field, value)


def test_violations(spark, registry):
    df = spark.createDataFrame(
        [(1, "Trusted", "True"), (2, "Trusted", "Maybe"), (3, "Trusted", None), (4, "Free", None),
         (5, "Other", "x"), (6, "None", "x"), (7, None, "x")],
        "customer_id BIGINT, name STRING, value STRING")
    found = {r.customer_id: r.violation for r in fields.field_violations(df, registry).collect()}
    no, bad = fields.UNKNOWN_FIELD, fields.VALUE_NOT_ALLOWED
    assert found == {2: bad, 3: bad, 5: no, 6: bad, 7: no}
    assert fields.field_violations(df, registry.limit(0)).count() == 0


def test_discovery(spark):
    df = spark.createDataFrame([(1, "a", "z"), (1, "a", "y"), (2, "a", "z"), (3, "b", None)],
                               "customer_id BIGINT, name STRING, value STRING")
    rows = {r.name: tuple(r)[1:] for r in fields.discover_fields(df, samples=1).collect()}
    assert rows == {"a": (3, 2, 2, ["y"]), "b": (1, 1, 0, [])}
    assert fields.discover_fields(df, approximate=True).count() == 2


CHANGE = "customer_id STRING, name STRING, value STRING, ts TIMESTAMP, seq BIGINT"


def changes(spark, *rows):
    df = spark.createDataFrame([(c, n, v, t, s) for c, n, v, t, s in rows],
                               "customer_id STRING, name STRING, value STRING, t STRING, seq BIGINT")
    return df.withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def test_updates(spark):
    current = spark.createDataFrame([(42, "Trusted", "False"), (42, "Other", "o"), (7, "Trusted", "False")],
                                    "customer_id BIGINT, name STRING, value STRING")
    asked = changes(
        spark, ("42", "Trusted", "no", "2024-01-01", 1), ("42", "Trusted", "True", "2024-01-02", 1),
        ("42", "Trusted", "older", "2024-01-02", 0), ("9.0", "New", None, "2024-01-01", 2),
        *[(bad, "Trusted", "x", "2024-01-01", 9)
          for bad in ("abc", "0", "-1", "", None, "NaN", "Infinity", "4.5", "1e400", "42d", "42f", "42L")])
    updated, applied, rejects = values.apply_updates(current, asked)
    assert sorted(map(tuple, updated.collect())) == [
        (7, "Trusted", "False"), (9, "New", None), (42, "Other", "o"), (42, "Trusted", "True")]
    assert sorted(map(tuple, applied.collect())) == [(9, "New", None), (42, "Trusted", "True")]
    assert rejects.count() == 12


def test_value_table(spark, tmp_path):
    root = str(tmp_path / "values")

    def apply(batch, *rows):
        sound, _ = values.split_changes(changes(spark, *rows))
        append_changes(sound, root, batch)

    def now():
        return sorted(map(tuple, read_values(spark, root).collect()))

    assert now() == [] and not compact(spark, root)
    apply(0, ("1", "a", "x", "2024-01-05", 1), ("2", "a", "x", "2024-01-05", 1))
    apply(1, ("1", "a", "later batch", "2024-01-01", 1))
    assert now() == [(1, "a", "later batch"), (2, "a", "x")]
    apply(1, ("1", "a", "replayed", "2024-01-01", 1))
    assert compact(spark, root) and not compact(spark, root)
    assert now() == [(1, "a", "replayed"), (2, "a", "x")]
    apply(2, ("2", "a", None, "2024-01-01", 1))
    assert now() == [(1, "a", "replayed"), (2, "a", None)]
    assert compact(spark, root)
    assert now() == [(1, "a", "replayed"), (2, "a", None)]

import json
import os
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from storegrain import schemas, workspace
from storegrain.sources import landed
from storegrain.sources.csv_files import column_values, read_csv, write_csv
from storegrain.sources.registry import (
    read_registry,
    read_registry_file,
    registry_problems,
    save_registry,
)
from storegrain.sources.run_states import read_run_states
from storegrain.operators.fields import (
    FieldRequestError,
    catalog_summary,
    check_request,
    field_violations,
    registry_entries,
)
from storegrain.operators.orders import with_products
from storegrain.plans.registry import publish_registry
from storegrain.plans.status import run_report

JOB_FAILED = (PySparkException, Py4JJavaError)

ANN = {"id": 99, "email": "a@b.c", "first_name": "A", "last_name": "B", "phone": "555",
       "addresses": [{"country": "US"}], "form_fields": [], "notes": "kept"}


def put(folder: Path, name: str, content) -> str:
    folder.mkdir(exist_ok=True)
    text = content if isinstance(content, str) else json.dumps(content, indent=1)
    (folder / name).write_text(text)
    return str(folder)


def page(*rows, **meta):
    counts = ("total", "count", "per_page", "current_page", "total_pages")
    return {"data": list(rows), "meta": {"pagination": dict.fromkeys(counts, 1), **meta}}


def test_customers_from_several_pages(spark, tmp_path):
    pages = tmp_path / "pages"
    put(pages, "1.json", page(ANN, {**ANN, "id": 1, "form_fields": [{"name": "m", "value": ["a", "b"]}]}))
    put(pages, "2.json", page({**ANN, "id": 2, "form_fields": [{"name": "s"}]}))
    path = put(pages, "3.json", {"data": [], "meta": {}})
    customers = landed.read_customers(spark, path)
    assert customers.dtypes == workspace.empty_table(spark, schemas.CUSTOMERS).dtypes
    rows = customers.orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 99]
    assert rows[0].form_fields == [("m", ["a", "b"])]
    assert rows[1].form_fields == [("s", None)]
    assert rows[2].addresses[0].country == "US"
    assert json.loads(rows[2].extra.toJson())["notes"] == "kept"


@pytest.mark.parametrize("change", [
    {"email": None}, {"email": 5}, {"id": "7"}, {"addresses": {}}, {"addresses": [{}]},
    {"form_fields": [{"value": "x"}]}, {"form_fields": [{"name": "x", "value": 5}]},
    {"form_fields": [{"name": "x", "value": ["a", 5]}]}, {"addresses": None},
    {"id": 1.5}, {"id": 1e30}, {"date_created": "soon"}, {"date_modified": 5}, {"customer_group_id": "gold"},
    {"customer_group_id": 2.5}, {"company": {}},
])
def test_bad_customers_fail_or_are_set_aside(spark, tmp_path, change):
    path = put(tmp_path / "pages", "1.json", page(ANN, {**ANN, "id": 1, **change}))
    with pytest.raises(JOB_FAILED, match="bad customer"):
        landed.read_customers(spark, path).count()
    sound, rejects = landed.read_customers(spark, path, mode="quarantine")
    assert [r.id for r in sound.collect()] == [99]
    assert [r.problems[0].split(":")[0] for r in rejects.collect()] == list(change)


def test_missing_key_fails(spark, tmp_path):
    path = put(tmp_path / "pages", "1.json", page({"id": 1}))
    with pytest.raises(JOB_FAILED, match="bad customer"):
        landed.read_customers(spark, path).count()


def test_bad_pages(spark, tmp_path):
    pages = tmp_path / "pages"
    put(pages, "1.json", page(ANN))
    put(pages, "2.json", '{"data": [')
    path = put(pages, "3.json", {"meta": {}})
    with pytest.raises(JOB_FAILED):
        landed.read_customers(spark, path).count()
    sound, rejects = landed.read_customers(spark, path, mode="quarantine")
    assert sound.count() == 1
    assert rejects.count() == 2


CURSOR = {"count": 1, "per_page": 250, "end_cursor": "abc", "links": {"next": "?after=abc"}}


@pytest.mark.parametrize("meta, sound", [
    ({}, True),
    ({"pagination": {"total": 1}}, False),
    ({"pagination": None}, False),
    ({"cursor_pagination": CURSOR}, True),
    ({"cursor_pagination": {**CURSOR, "links": {}}}, True),
    ({"cursor_pagination": {**CURSOR, "links": {"next": 5}}}, False),
    ({"cursor_pagination": {**CURSOR, "end_cursor": None}}, False),
])
def test_page_meta(spark, tmp_path, meta, sound):
    path = put(tmp_path / "pages", "1.json", page(ANN, **meta))
    good, rejects = landed.read_customers(spark, path, mode="quarantine")
    assert (good.count(), rejects.count()) == ((1, 0) if sound else (0, 1))


def test_mode_is_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="mode"):
        landed.read_customers(spark, str(tmp_path), mode="ignore")


def test_field_values(spark, tmp_path):
    good = {"name": "F", "value": None, "customer_id": 3}
    path = put(tmp_path / "good", "1.json", page(good, {**good, "value": "Y"}))
    assert {tuple(r) for r in landed.read_field_values(spark, path).collect()} == {
        (3, "F", None), (3, "F", "Y"),
    }
    path = put(tmp_path / "bad", "1.json", page({"name": "F", "customer_id": 3}))
    with pytest.raises(JOB_FAILED, match="bad field value"):
        landed.read_field_values(spark, path).count()


def test_lines_and_files_read_alike(spark, tmp_path):
    path = put(tmp_path / "lines", "1.json", "\n".join(json.dumps(page({**ANN, "id": i})) for i in (1, 2)))
    rows = landed.read_customers(spark, path, multiline=False)
    assert sorted(r.id for r in rows.collect()) == [1, 2]


def test_orders_products_and_fees(spark, tmp_path):
    given = {"id": 6, "status": "salted", "date_created": "2018-04-09T12:00:00Z", "crew": {"size": 4}}
    orders = put(tmp_path / "o", "1.json", [given, {"id": 7}])
    rows = {r.id: r for r in landed.read_orders(spark, orders).collect()}
    assert (rows[6].status, rows[6].customer_id, rows[6].date_created.year) == ("salted", None, 2018)
    assert rows[6].extra.toPython() == given and rows[7].extra.toPython() == {"id": 7}
    product = {"order_id": 6, "sku": "H/40", "price": "3.125", "quantity": 9, "weights": [1, 2]}
    products = landed.read_order_products(spark, put(tmp_path / "p", "1.json", [product]))
    nested = with_products(landed.read_orders(spark, orders), products).where("id = 6").head()
    assert [(p.sku, str(p.price), p.extra.toPython()["weights"]) for p in nested.products] == [("H/40", "3.1250", [1, 2])]
    fee = {"order_id": 77, "name": "Ice", "type": "storage", "amount": "5.1250", "tax": "0"}
    fees = put(tmp_path / "f", "1.json", [fee])
    assert [str(x) for x in landed.read_order_fees(spark, fees).drop("extra").head()] == ["77", "Ice", "storage", "5.1250", "0.0000"]
    for bad in ("5.12501", "five", "1e20"):
        path = put(tmp_path / "bad", "1.json", [{**fee, "amount": bad}])
        with pytest.raises(JOB_FAILED, match="bad order fee"):
            landed.read_order_fees(spark, path).collect()
    for wrong in ({"id": "x"}, {"id": 1, "date_created": "noon"}, {"id": 1, "status": 5}, {"status": "x"}):
        path = put(tmp_path / "w", "1.json", [wrong, {"id": 2}])
        with pytest.raises(JOB_FAILED, match="bad order"):
            landed.read_orders(spark, path).collect()
        sound, rejects = landed.read_orders(spark, path, mode="quarantine")
        assert [r.id for r in sound.collect()] == [2] and rejects.count() == 1


def test_carts(spark, tmp_path):
    carts = tmp_path / "carts"
    items = {"physical_items": [{"name": "Herring", "quantity": 40, "sku": "H/40", "salted": True}], "digital_items": [1]}
    put(carts, "1.json", {"data": {"id": "quay-9", "customer_id": 311, "created_time": "2021-06-15T04:30:00Z", "line_items": items}})
    path = put(carts, "2.json", {"data": {"id": "bare"}})
    rows = {r.id: r for r in landed.read_carts(spark, path).collect()}
    assert rows["quay-9"].physical_items == [("Herring", 40, "H/40")]
    assert rows["quay-9"].extra.toPython()["line_items"] == items
    assert rows["bare"].physical_items == []
    bad = [{"data": {"customer_id": 1}}, {"data": {"id": "q", "line_items": {"physical_items": [{"quantity": "two"}]}}},
           {"data": {"id": "r", "created_time": "noon"}}, {"other": 1}]
    for number, content in enumerate(bad):
        path = put(carts, f"bad{number}.json", content)
    with pytest.raises(JOB_FAILED, match="bad cart"):
        landed.read_carts(spark, path).count()
    sound, rejects = landed.read_carts(spark, path, mode="quarantine")
    assert (sound.count(), rejects.count()) == (2, 4)


def test_times_of_mail_headers(spark, tmp_path):
    row = {**ANN, "date_created": "Sat, 02 Mar 2019 18:05:00 +0100", "date_modified": None}
    path = put(tmp_path / "pages", "1.json", page(row))
    found = landed.read_customers(spark, path).select(F.date_format("date_created", "yyyy-MM-dd HH:mm").alias("t"), "date_modified").head()
    assert tuple(found) == ("2019-03-02 17:05", None)


FIELDS = [
    {"name": "Login", "type": "password", "private_id": 7, "required": True},
    {"name": "Boat class", "type": "dropdown", "required": False},
    {"label": "Berths", "field_type": "type_checkboxes_field", "private_id": "",
     "extra_info": {"options": [12, False, "bow", None]}, "options": ["unseen"]},
    {"title": "Pier", "extra_info": {"options": "none"}, "options": ["unseen"]},
    {"name": 0, "label": "Moor", "extra_info": {}, "options": ["day", "night"]},
]


@pytest.mark.parametrize("payload", [FIELDS, {"data": FIELDS}])
def test_catalog(spark, tmp_path, payload):
    path = put(tmp_path / "c", "1.json", payload)
    catalog = landed.read_catalog(spark, path)
    rows = [tuple(r) for r in catalog_summary(catalog, include_built_in=True).collect()]
    assert rows == [
        ("Login", "string", "password", None, True, True),
        ("Boat class", "string", "dropdown", None, False, False),
        ("Berths", "boolean", "type_checkboxes_field", ["12", "false", "bow", "null"], False, False),
        ("Pier", "string", "", None, False, False),
        ("Moor", "string", "", ["day", "night"], False, False),
    ]
    assert registry_entries(catalog).count() == 4


@pytest.mark.parametrize("payload", [{"unexpected": True}, {"data": None}, []])
def test_catalog_of_another_shape_is_empty(spark, tmp_path, payload):
    path = put(tmp_path / "c", "1.json", payload)
    assert landed.read_catalog(spark, path).count() == 0


def test_registry_file(spark, tmp_path):
    assert read_registry_file(spark, str(tmp_path / "none.json")).count() == 0
    entries = [{"name": "Berth", "type": "number", "options": ["4", "8"]}, {"name": "Sail no"}, {"name": "Berth"}]
    put(tmp_path, "r.json", {"formFields": entries})
    assert [tuple(r) for r in read_registry_file(spark, str(tmp_path / "r.json")).collect()] == [
        ("Berth", "number", ["4", "8"], 0), ("Sail no", None, None, 1), ("Berth", None, None, 2),
    ]
    registry = read_registry_file(spark, str(tmp_path / "r.json"))
    with pytest.raises(FieldRequestError):  # of entries with one name the first counts
        check_request(registry, "Berth", "5")
    asked = spark.createDataFrame([(1, "Berth", "5"), (2, "Berth", "8"), (3, "Sail no", "x")], "customer_id BIGINT, name STRING, value STRING")
    assert [r.customer_id for r in field_violations(asked, registry).collect()] == [1]
    put(tmp_path, "e.json", {})
    assert read_registry_file(spark, str(tmp_path / "e.json")).count() == 0
    shapes = [{"name": ""}, {"name": "x", "type": "bogus"}, {"type": "string"}, {"name": 5}, {"name": "x", "options": "y"}]
    for bad in (*({"formFields": [shape]} for shape in shapes), {"formFields": "x"}, {"formFields": {}}):
        put(tmp_path, "b.json", bad)
        with pytest.raises(JOB_FAILED, match="registry entry"):
            read_registry_file(spark, str(tmp_path / "b.json")).collect()


def test_registry_versions(spark, tmp_path):
    root = str(tmp_path / "registry")
    assert read_registry(spark, root).count() == 0
    first = spark.createDataFrame([("A", "string", None), ("B", None, ["x", "y"])],
                                  "name STRING, type STRING, options ARRAY<STRING>")
    assert save_registry(first, root)
    assert not save_registry(first, root)
    assert sorted(map(tuple, read_registry(spark, root).collect())) == sorted(map(tuple, first.collect()))
    assert save_registry(first.where("name = 'A'"), root)
    assert read_registry(spark, root).count() == 1
    assert save_registry(first.where("name = 'A'").union(first.where("name = 'A'")), root)
    assert len(os.listdir(root)) == 3


def test_publish_registry_by_name(spark, tmp_path):
    catalog = landed.read_catalog(spark, put(tmp_path / "c", "1.json", FIELDS))
    root = str(tmp_path / "registry")
    assert publish_registry(catalog, root, include_built_in=True, names=["Login", "Berths"])
    assert sorted(r.name for r in read_registry(spark, root).collect()) == ["Berths", "Login"]


def test_registry_problems(spark):
    df = spark.createDataFrame([("", "string"), (None, None), ("x", "bogus"), ("y", "date"), ("z", None)],
                               "name STRING, type STRING")
    assert sorted(r.problem for r in registry_problems(df).collect()) == [
        "empty name", "empty name", "unknown type"]


def test_csv_bytes(spark, tmp_path):
    rows = spark.createDataFrame([("Skuld", "4.5"), ('the "Ran"', ""), (" bow ", "x\ny\\z")], "Boat STRING, Length STRING")
    path = str(tmp_path / "out" / "csv")
    write_csv(rows.coalesce(1), path)
    (part,) = Path(path).glob("part-*.csv")
    assert part.read_text() == (
        '"Boat","Length"\n"Skuld","4.5"\n"the ""Ran""",""\n" bow ","x\ny\\z"\n')
    write_csv(rows.limit(1), path)
    back = read_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(
        [("Skuld", "4.5"), ('the "Ran"', ""), (" bow ", "x\ny\\z"), ("Skuld", "4.5")])


def test_csv_column_values(spark, tmp_path):
    path = put(tmp_path / "csv", "a.csv", 'ID, Pier\n31,north\n"47",south\n 31 ,east\n"",west\n')
    assert sorted(r[0] for r in column_values(spark, path, "ID").collect()) == ["31", "47"]
    # a later file with its columns in another order, one without the column, and one without rows
    put(tmp_path / "csv", "b.csv", "Pier,ID\nquay,52\n")
    put(tmp_path / "csv", "c.csv", "Pier,Boat\nquay,skiff\n")
    put(tmp_path / "csv", "d.csv", "")
    assert sorted(r[0] for r in column_values(spark, path, "ID").collect()) == ["31", "47", "52"]
    assert column_values(spark, path, "Nope").count() == 0
    assert column_values(spark, str(tmp_path / "missing.csv"), "ID").count() == 0


def test_csv_header_must_match(spark, tmp_path):
    path = put(tmp_path / "csv", "a.csv", '"A","B"\n"1","2"\n')
    assert read_csv(spark, path, columns=["A", "B"]).count() == 1
    with pytest.raises(JOB_FAILED):
        read_csv(spark, path, columns=["A", "C"]).collect()


def test_run_states(spark, tmp_path):
    store, other = tmp_path / "store", tmp_path / "other"
    state = {"pageNum": 11, "collectedIds": [], "processedIdIndex": 0}
    put(store, ".progress-tide.json", state)
    put(store, ".progress-ebb.json", {**state, "collectedIds": [71, 72, 75, 79], "processedIdIndex": 3})
    put(store, "tide.log", "x")
    put(other, ".progress-spring.json", {**state, "collectedIds": [71]})
    put(other, ".progress-neap.json", {**state, "collectedIds": [71, 72, 75], "cursor": "p12"})
    states = read_run_states(spark, [str(store), str(other)])
    rows = {r.key: (r.phase, r.percent, r.collected) for r in run_report(states).collect()}
    assert rows == {
        "tide": ("collecting IDs (phase 1)", None, 0),
        "ebb": ("fetching customers (phase 2)", 75, 4),
        "spring": ("ready for phase 2", None, 1),
        "neap": ("collecting IDs (phase 1)", None, 3),
    }
    assert run_report(states, "tide").count() == 1
    stamp = run_report(states, "tide").select(F.unix_timestamp("mtime")).head()[0]
    assert stamp == int((store / ".progress-tide.json").stat().st_mtime)
    with pytest.raises(LookupError, match="missing"):
        run_report(states, "missing")


def test_run_states_vanished_broken_or_none(spark, tmp_path):
    assert run_report(read_run_states(spark, str(tmp_path / "none"))).count() == 0
    store = tmp_path / "store"
    put(store, ".progress-gone.json", {"pageNum": 1, "collectedIds": [], "processedIdIndex": 0})
    states = read_run_states(spark, str(store))
    (store / ".progress-gone.json").unlink()
    assert states.count() == 0
    put(store, ".progress-broken.json", "{")
    with pytest.raises(JOB_FAILED):
        read_run_states(spark, str(store)).collect()

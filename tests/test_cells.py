import json

import pytest
from pyspark.sql import functions as F

from storegrain.functions.cells import (
    ColumnListError,
    export_rows,
    parse_columns,
    with_id,
)
from storegrain.sources.landed import type_customers

ROWER = {
    "id": 8051, "email": "oar@boathouse.example", "first_name": "Ingrid", "last_name": "Skuld",
    "phone": "+47 900", "date_created": "2019-11-30T23:59:01Z", "company": None,
    "addresses": [{"country": "Norway", "berth": 17, "pier no": "B'2"}, {"country": "Chile"}],
    "form_fields": [{"name": "Boat class", "value": "skiff"},
                    {"name": "Seats", "value": ["bow", "stroke", "cox"]},
                    {"name": "Coach", "value": None}, {"name": "Club"},
                    {"name": "crew:2020", "value": "first"}, {"name": "crew:2020", "value": "again"}],
}


@pytest.fixture(scope="module")
def rower(spark):
    text = spark.createDataFrame([(json.dumps(ROWER),)], "t STRING")
    return type_customers(text.select(F.parse_json("t").alias("row")))


@pytest.mark.parametrize("spec, wanted", [
    ("", []),
    (",", []),
    ("Surname:last_name", [("Surname", "last_name")]),
    ("\tSurname :last_name\t", [("Surname", "last_name")]),
    ("Pier:addresses[3].pier no, Since:date_created,", [("Pier", "addresses[3].pier no"), ("Since", "date_created")]),
    ("Crew:form_field:crew:2020", [("Crew", "form_field:crew:2020")]),
])
def test_parse(spec, wanted):
    assert parse_columns(spec) == wanted


@pytest.mark.parametrize("spec, message", [
    ("Surname:last_name,phone", "no colon"),
    (" :phone", "both a name and a source"),
    ("Phone: ", "both a name and a source"),
    ("Shoe:shoe_size", "unknown source"),
    ("Pier:addresses[-1].pier", "unknown source"),
    ("Pier:addresses[2]", "unknown source"),
])
def test_parse_errors(spec, message):
    with pytest.raises(ColumnListError, match=message):
        parse_columns(spec)


@pytest.mark.parametrize("source, wanted", [
    ("form_field:Seats", "bow, stroke, cox"),
    ("form_field:crew:2020", "first"),
    ("form_field:Boat class", "skiff"),
    ("form_field:boat class", ""),
    ("form_field:Coach", ""),
    ("form_field:Club", ""),
    ("form_field:Rudder", ""),
    ("addresses[0].berth", "17"),
    ("addresses[0].pier no", "B'2"),
    ("addresses[1].berth", ""),
    ("addresses[1].country", "Chile"),
    ("addresses[2].country", ""),
    ("addresses[31415926535].country", ""),
    ("last_name", "Skuld"),
    ("phone", "+47 900"),
    ("id", "8051"),
    ("company", ""),
    ("date_created", "2019-11-30T23:59:01Z"),
    ("date_modified", ""),
])
def test_cells(rower, source, wanted):
    assert export_rows(rower, [("X", source)]).collect() == [(wanted,)]


def test_rows_keep_order_and_last_source_of_a_name(rower):
    rows = export_rows(rower, parse_columns("Who:id,Where:addresses[0].country,Who:first_name"))
    assert rows.columns == ["Who", "Where"]
    assert rows.collect() == [("Ingrid", "Norway")]


def test_full_columns():
    assert with_id([("Phone", "phone")]) == [("Customer ID", "id"), ("Phone", "phone")]
    assert with_id([("Customer ID", "email"), ("P", "phone")]) == [("Customer ID", "id"), ("P", "phone")]

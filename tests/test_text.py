import random

import pytest
from pyspark.sql import functions as F

from storegrain.functions import catalog, text
from storegrain.operators.masking import mask_columns


def column(spark, values, expression):
    df = spark.createDataFrame([(v,) for v in values], "x STRING")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_mask_email(spark):
    given = [None, "", "@", "rudder", "cox@fjord.example", "x@y@z", "@deck", "oars@"]
    assert column(spark, given, text.mask_email) == [
        None, "@", "@", "ru****@", "co*@fj***********", "x@y", "@de**", "oa**@",
    ]


def test_mask_secret(spark):
    rng = random.Random(9)
    given = ["".join(rng.choices("xyz019_", k=n)) for n in range(15)] + [None]
    wanted = ["****" if len(t) <= 8 else t[:4] + "..." + t[-4:] for t in given[:-1]] + [None]
    assert column(spark, given, text.mask_secret) == wanted


def test_mask_columns(spark):
    df = spark.createDataFrame([(1, "bob@shop.org", "tokentoken")], "id INT, email STRING, t STRING")
    assert mask_columns(df, ["email"], ["t"]).collect() == [(1, "bo*@sh******", "toke...oken")]


@pytest.mark.parametrize("given, wanted", [
    ("Boat_Class 2020", "boat-class-2020"),
    ("?x?", "x"),
    ("...", ""),
    ("\tTWO  lines\n", "two-lines"),
])
def test_slug(spark, given, wanted):
    assert column(spark, [given], text.slug) == [wanted]
    assert text.slug_of(given) == wanted


def test_text_rules_on_random_text(spark):
    rng = random.Random(3)
    letters = "aZ9 -@@.\u00e9\u00df\u0130\u212a\u4e2d!_\n"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(400)]
    assert column(spark, texts, text.slug) == [text.slug_of(t) for t in texts]

    def masked(t):
        local, domain = (t.split("@") + [""])[:2]
        return "@".join(p[:2] + "*" * max(0, len(p) - 2) for p in (local, domain))

    assert column(spark, texts, text.mask_email) == [masked(t) for t in texts]


def test_truthy_by_type(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
          (1, '0', 1L, true, '1'), (2, '', 0L, false, '0'), (3, NULL, NULL, NULL, NULL),
          (4, 'x', -1L, true, '""'), (5, 'x', 2L, true, 'null'), (6, 'x', 2L, true, '[]'),
          (7, 'x', 2L, true, 'false'), (8, 'x', 2L, true, '"0"'), (9, 'x', 2L, true, '0.0')
        AS t(i, s, n, b, j)""").withColumn("v", F.parse_json("j"))
    rows = df.orderBy("i").select(*[text.truthy(df, c).alias(c) for c in "snbv"]).collect()
    assert [r.s for r in rows[:4]] == [True, False, False, True]
    assert [r.n for r in rows[:4]] == [True, False, False, True]
    assert [r.b for r in rows[:3]] == [True, False, False]
    assert [r.v for r in rows] == [True, False, False, False, False, True, False, True, False]


def test_join_list(spark):
    df = spark.sql("SELECT array('a', 'b', NULL) AS x")
    assert df.select(text.join_list(F.col("x"))).head()[0] == "a, b, "


def test_registry_type(spark):
    """Every known store type in any case, and made-up ones, which are strings."""
    rng = random.Random(6)
    known = dict(catalog.STORE_TYPES)
    given = [*known, *(name.upper() for name in known), *(f"{name}{rng.randint(10, 99)}" for name in known), ""]
    wanted = [known.get(name.lower(), "string") for name in given]
    assert column(spark, given, catalog.registry_type) == wanted


def test_field_names_types_and_options(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
          ('A', 'B', NULL, NULL, 'x', 'y', 'z', array('n'), array('t')),
          ('', 'B', 'C', 'D', '', 'y', 'z', NULL, array('t')),
          (NULL, NULL, 'C', 'D', NULL, '', 'z', array(), array('t')),
          (NULL, '', NULL, 'D', NULL, NULL, NULL, NULL, array()),
          (NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
        AS t(name, label, field_name, title, type, form_field_type, field_type, nested, options)
    """).withColumn("extra_info", F.struct(F.col("nested").alias("options")))
    rows = df.select(
        catalog.field_name().alias("n"), catalog.raw_type().alias("t"),
        catalog.field_options().alias("o"),
    ).collect()
    assert [r.n for r in rows] == ["A", "B", "C", "D", "(unnamed)"]
    assert [r.t for r in rows] == ["x", "y", "z", "", ""]
    assert [r.o for r in rows] == [["n"], ["t"], None, None, None]

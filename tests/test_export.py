import shutil
from datetime import date
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from storegrain.functions.cells import ColumnListError
from storegrain.operators.fields import FieldRequestError
from storegrain.plans.export import export_segment, export_target
from storegrain.plans.ledger import compact_ledgers, exported_when
from storegrain.sources.csv_files import column_values, read_csv

DAY = date(2026, 4, 24)
ASK = dict(key="My Key", field="F", value="Y", columns="Email:email,Seg:form_field:seg", run_date=DAY)


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(1, 6).select(
        "id", F.format_string("u%d@x.y", "id").alias("email"),
        F.array(F.struct(F.lit("seg").alias("name"), F.array(F.lit("s")).alias("value"))).alias("form_fields"))


def held(spark, *ids):
    return spark.createDataFrame([(i, "F", "Y") for i in ids] + [(9, "F", "N")], "customer_id BIGINT, name STRING, value STRING")


def cells(spark, path):
    return sorted(map(tuple, read_csv(spark, path).collect()))


def counts(result):
    return result.matched, result.fetched, result.written, result.exported


def test_names_of_outputs():
    target = export_target("out", "Is Trusted", run_date=DAY, run="r1")
    assert target.base_path == "out/is-trusted/base/run=r1"
    assert target.clean_path == "out/is-trusted/clean/run_date=2026-04-24/mode=full/run=r1"
    target = export_target("out", "k", prefix="My-Prefix", run_date=DAY, incremental=True, run="r2")
    assert target.clean_path == "out/My-Prefix/clean/run_date=2026-04-24/mode=incremental/run=r2"
    assert export_target("out", "k").run != export_target("out", "k").run


def test_dry_run_counts_and_writes_nothing(spark, people, tmp_path):
    result = export_segment(held(spark, 1, 1, 2, 77), people, out_dir=str(tmp_path / "out"), **ASK)
    assert counts(result) == (3, 3, 2, False)
    assert sorted(r.id for r in result.ids.collect()) == [1, 2, 77]
    assert not (tmp_path / "out").exists()
    assert result.report().head().matched == 3


def test_export_writes_base_and_clean(spark, people, tmp_path):
    result = export_segment(held(spark, 1, 2), people, out_dir=str(tmp_path), write=True, **ASK)
    assert counts(result) == (2, 2, 2, True)
    assert cells(spark, result.base_path) == [("1", "u1@x.y", "s"), ("2", "u2@x.y", "s")]
    assert cells(spark, result.clean_path) == [("u1@x.y", "s"), ("u2@x.y", "s")]
    (first, *_) = sorted(Path(result.base_path).glob("part-*.csv"))
    assert first.read_text().startswith('"Customer ID","Email","Seg"\n')


def test_no_match_ends_cleanly(spark, people, tmp_path):
    for incremental in (False, True):
        result = export_segment(held(spark), people, out_dir=str(tmp_path / "out"), write=True,
                                incremental=incremental, **ASK)
        assert counts(result) == (0, 0, 0, False)
    assert not (tmp_path / "out").exists()


def test_incremental(spark, people, tmp_path):
    out = dict(people=people)
    ask = dict(out_dir=str(tmp_path), incremental=True, write=True, **ASK)
    first = export_segment(held(spark, 1, 2), people, **ask)
    assert counts(first) == (2, 2, 2, True)
    second = export_segment(held(spark, 1, 2, 3), people, **ask)
    assert counts(second) == (3, 1, 1, True)
    assert cells(spark, second.clean_path) == [("u3@x.y", "s")]
    third = export_segment(held(spark, 1, 2, 3), people, **ask)
    assert counts(third) == (3, 0, 0, False)
    assert not Path(third.clean_path).exists()
    base = f"{tmp_path}/my-key/base"
    assert sorted(r[0] for r in column_values(spark, base, "Customer ID").collect()) == ["1", "2", "3"]


def test_a_run_can_be_repeated(spark, people, tmp_path):
    ask = dict(out_dir=str(tmp_path), incremental=True, write=True, run="r", **{**ASK, "run_date": None})
    first = export_segment(held(spark, 1, 2), people, **{**ask, "run_date": DAY})
    # the second attempt, on another day: same folders, same rows
    again = export_segment(held(spark, 1, 2), people, **{**ask, "run_date": date(2026, 4, 25)})
    assert again.clean_path == first.clean_path
    assert cells(spark, f"{tmp_path}/my-key/base") == [("1", "u1@x.y", "s", "r"), ("2", "u2@x.y", "s", "r")]
    assert len(cells(spark, first.clean_path)) == 2


def test_base_lost_half_way(spark, people, tmp_path):
    """A run that wrote only its clean output is not taken for exported."""
    ask = dict(out_dir=str(tmp_path), incremental=True, write=True, **ASK)
    first = export_segment(held(spark, 1), people, run="r", **ask)
    (Path(first.base_path) / "_SUCCESS").unlink()
    other = export_segment(held(spark, 1), people, run="other", **ask)
    assert other.written == 1


def test_full_columns_keep_the_id(spark, people, tmp_path):
    ask = dict(out_dir=str(tmp_path), write=True, **ASK)
    mine = export_segment(held(spark, 1), people, full_columns="Mail:email", prefix="a", **ask)
    assert cells(spark, mine.base_path) == [("1", "u1@x.y")]
    mine = export_segment(held(spark, 1), people, full_columns="Mail:email,Customer ID:id", prefix="b", **ask)
    assert cells(spark, mine.base_path) == [("u1@x.y", "1")]


def test_base_with_other_columns_is_refused(spark, people, tmp_path):
    ask = dict(out_dir=str(tmp_path), write=True, incremental=True, **ASK)
    export_segment(held(spark, 1), people, **ask)
    with pytest.raises((PySparkException, Py4JJavaError)):
        export_segment(held(spark, 1, 2), people, full_columns="Mail:email", **ask)


def test_requests_are_checked_first(spark, people, tmp_path):
    registry = spark.createDataFrame([("Other", None, None), ("F", None, ["N"])], "name STRING, type STRING, options ARRAY<STRING>")
    ask = dict(out_dir=str(tmp_path), **ASK)
    with pytest.raises(FieldRequestError, match="not allowed"):
        export_segment(held(spark, 1), people, registry=registry, **ask)
    with pytest.raises(FieldRequestError, match="not registered"):
        export_segment(held(spark, 1), people, registry=registry.where("name = 'Other'"), **ask)
    with pytest.raises(ColumnListError):
        export_segment(held(spark, 1), people, **{**ask, "columns": "X:nope"})


def test_increments_are_told_from_the_ledger(spark, people, tmp_path):
    """The cells of the base are not read again; a base without ledger is."""
    ask = dict(out_dir=str(tmp_path), incremental=True, write=True, **ASK)
    first = export_segment(held(spark, 1, 2), people, run="a", **ask)
    (ledger,) = (tmp_path / "my-key" / "ledger").glob("columns=*")
    assert sorted(r.id for r in spark.read.parquet(f"{ledger}/run=a").collect()) == [1, 2]
    for part in Path(first.base_path).glob("part-*.csv"):
        part.write_text("spoilt")
    second = export_segment(held(spark, 1, 2, 3), people, run="b", **ask)
    assert counts(second) == (3, 1, 1, True)
    # Runs of before the ledger: their base is read.
    shutil.rmtree(ledger / "run=b")
    shutil.rmtree(first.base_path)
    third = export_segment(held(spark, 1, 3, 4), people, run="c", **ask)
    assert sorted(r[0] for r in read_csv(spark, third.base_path).collect()) == ["1", "4"]


def test_a_ledger_without_its_base_counts_for_nothing(spark, people, tmp_path):
    ask = dict(out_dir=str(tmp_path), incremental=True, write=True, **ASK)
    first = export_segment(held(spark, 1), people, run="a", **ask)
    (Path(first.base_path) / "_SUCCESS").unlink()
    again = export_segment(held(spark, 1), people, run="b", **ask)
    assert counts(again) == (1, 1, 1, True)


def test_ledgers_fold(spark, people, tmp_path):
    """Later increments find in the fold what they found in the folders of the runs."""
    out, root = str(tmp_path), str(tmp_path / "my-key")

    def export(run, *ids, incremental=True):
        found = export_segment(held(spark, *ids), people, out_dir=out, run=run, incremental=incremental, write=True, **ASK)
        return found.written

    def when():
        return sorted((r.id, r.run) for r in exported_when(spark, root).collect())

    assert compact_ledgers(spark, root) == 0 and when() == []
    assert export("a", 1, 2, incremental=False) == 2 and export("007", 1, 2, 3) == 1
    (ledger,) = (tmp_path / "my-key" / "ledger").glob("columns=*")
    before = when()
    assert before == [(1, "a"), (2, "a"), (3, "007")]
    assert compact_ledgers(spark, root) == 2 and when() == before
    assert not list(ledger.glob("run=*")) and compact_ledgers(spark, root) == 0
    assert export("c", 1, 2, 3, 4) == 1
    assert when() == [*before, (4, "c")]
    # A folded run is repeated: its own ids count as new, and its folder in place of the fold's rows.
    assert export("007", 1, 2, 3, 5) == 2
    assert when() == [(1, "a"), (2, "a"), (3, "007"), (4, "c"), (5, "007")]
    assert compact_ledgers(spark, root) == 2 and compact_ledgers(spark, root) == 0
    assert when() == [(1, "a"), (2, "a"), (3, "007"), (4, "c"), (5, "007")]
    # A base that is gone takes its rows along, in reading and in the next fold.
    shutil.rmtree(tmp_path / "my-key" / "base" / "run=a")
    assert export("d", 1, 2, 3) == 2
    assert when() == [(1, "d"), (2, "d"), (3, "007"), (4, "c"), (5, "007")]
    assert compact_ledgers(spark, root) == 1
    assert when() == [(1, "d"), (2, "d"), (3, "007"), (4, "c"), (5, "007")]
    assert sorted(p.name for p in (ledger / "folds").iterdir()) == ["runs=1", "runs=2", "upto=1", "upto=2"]


def test_a_fold_that_died_changes_nothing(spark, people, tmp_path):
    for run, ids in (("a", [1]), ("b", [1, 2])):
        export_segment(held(spark, *ids), people, out_dir=str(tmp_path), run=run, incremental=True, write=True, **ASK)
    root = str(tmp_path / "my-key")
    (ledger,) = (tmp_path / "my-key" / "ledger").glob("columns=*")
    shutil.copytree(ledger / "run=a", tmp_path / "kept")
    assert compact_ledgers(spark, root) == 2
    shutil.copytree(tmp_path / "kept", ledger / "run=a")  # died before this folder went
    (ledger / "folds" / "upto=1").mkdir()  # and another time before the ids were written
    assert sorted((r.id, r.run) for r in exported_when(spark, root).collect()) == [(1, "a"), (2, "b")]
    again = export_segment(held(spark, 1, 2, 3), people, out_dir=str(tmp_path), incremental=True, **ASK)
    assert (again.matched, again.fetched, again.exported) == (3, 1, False)
    assert compact_ledgers(spark, root) == 1
    assert sorted((r.id, r.run) for r in exported_when(spark, root).collect()) == [(1, "a"), (2, "b")]

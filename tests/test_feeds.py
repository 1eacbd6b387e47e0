import json
from datetime import date
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from storegrain.sources.csv_files import read_csv
from storegrain.sources.value_table import compact, read_values
from storegrain.streaming.export_feed import run_export_feed
from storegrain.streaming.segment_feed import collect_segment, collected_ids
from storegrain.streaming.value_feed import run_value_feed, stream_changes


def land(folder: Path, name: str, *ids: int, value: str = "Y") -> None:
    folder.mkdir(exist_ok=True)
    rows = [{"name": "F", "value": value, "customer_id": i} for i in ids]
    (folder / name).write_text(json.dumps({"data": rows, "meta": {}}))


def forget_last_commit(checkpoint: Path) -> None:
    """Make the stream believe its last batch never finished."""
    commits = sorted((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    crc = commits[-1].with_name(f".{commits[-1].name}.crc")
    if crc.exists():
        crc.unlink()


def test_segment_scan_resumes(spark, tmp_path):
    pages, root = tmp_path / "pages", str(tmp_path / "scans")

    def scan(**options):
        ids = collect_segment(spark, str(pages), root, "My Key", "F", "Y", **options)
        return sorted(r.id for r in ids.collect())

    land(pages, "1.json", 9, 0, 9)
    assert scan() == [9]
    land(pages, "2.json", 10)
    land(pages, "3.json", 11, value="N")
    (pages / "1.json").write_text("not read again")
    assert scan(files_per_batch=1) == [9, 10]
    assert sorted(r.id for r in collected_ids(spark, root, "My Key", "F", "Y").collect()) == [9, 10]
    land(pages, "1.json", 12)
    assert scan() == [9, 10]
    assert scan(resume=False) == [10, 12]
    assert scan() == [10, 12]


def test_scan_without_matches(spark, tmp_path):
    land(tmp_path / "pages", "1.json", 1, value="N")
    ids = collect_segment(spark, str(tmp_path / "pages"), str(tmp_path / "scans"), "k", "F", "Y")
    assert ids.count() == 0


def test_bad_page_stops_the_scan(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text('{"data": [{"name": "F"}], "meta": {}}')
    with pytest.raises((PySparkException, Py4JJavaError)):
        collect_segment(spark, str(pages), str(tmp_path / "scans"), "k", "F", "Y")


def test_export_feed(spark, tmp_path):
    people = spark.range(1, 9).select("id", F.format_string("u%d@x.y", "id").alias("email"))
    pages, out, state = tmp_path / "pages", tmp_path / "out", tmp_path / "state"

    def feed(day=24):
        run_export_feed(spark, str(pages), people, checkpoint=str(state), key="k", field="F", value="Y",
                        columns="Email:email", out_dir=str(out), run_date=date(2026, 4, day))

    def base():
        return sorted(r[0] for r in read_csv(spark, f"{out}/k/base").collect())

    def clean():
        return sorted(r.Email for r in read_csv(spark, f"{out}/k/clean").collect())

    land(pages, "1.json", 1, 2, 1)
    feed()
    assert base() == ["1", "2"]
    land(pages, "2.json", 2, 3)
    feed()
    assert base() == ["1", "2", "3"] and clean() == ["u1@x.y", "u2@x.y", "u3@x.y"]
    # the last batch is replayed a day later: its own rows are not taken for exported
    forget_last_commit(state)
    feed(day=25)
    assert base() == ["1", "2", "3"] and clean() == ["u1@x.y", "u2@x.y", "u3@x.y"]
    # replayed after its output was lost
    forget_last_commit(state)
    for folder in sorted(out.glob("k/**/run=*-1")):
        for part in folder.iterdir():
            part.unlink()
        folder.rmdir()
    feed()
    assert base() == ["1", "2", "3"] and clean() == ["u1@x.y", "u2@x.y", "u3@x.y"]
    land(pages, "3.json", 1, 2, 3)
    feed()
    assert base() == ["1", "2", "3"]


def test_value_feed(spark, tmp_path):
    landing, root, state = tmp_path / "landing", str(tmp_path / "values"), tmp_path / "state"
    landing.mkdir()

    def change(name, *rows):
        keys = ("customer_id", "name", "value", "ts", "seq")
        lines = [json.dumps(dict(zip(keys, r))) for r in rows]
        (landing / name).write_text("\n".join(lines))
        run()

    def run():
        run_value_feed(stream_changes(spark, str(landing)), root, str(state))

    def now():
        return sorted(map(tuple, read_values(spark, root).collect()))

    change("1.json", ("42", "T", "False", "2024-01-01T00:00:00Z", 1), ("42", "T", "True", "2024-01-02T00:00:00Z", 0),
           ("abc", "T", "x", "2024-01-01T00:00:00Z", 2))
    assert now() == [(42, "T", "True")]
    assert spark.read.parquet(f"{root}/rejects").count() == 1
    change("2.json", ("42", "T", "Maybe", "2024-01-03T00:00:00Z", 0), ("7", "T", None, "2024-01-03T00:00:00Z", 0))
    wanted = [(7, "T", None), (42, "T", "Maybe")]
    assert now() == wanted
    forget_last_commit(state)
    run()
    assert now() == wanted
    assert compact(spark, root)
    assert now() == wanted


def test_a_scan_belongs_to_its_field_and_value(spark, tmp_path):
    land(tmp_path / "pages", "1.json", 1)
    land(tmp_path / "pages", "2.json", 2, value="N")

    def scan(value):
        ids = collect_segment(spark, str(tmp_path / "pages"), str(tmp_path / "scans"), "k", "F", value)
        return sorted(r.id for r in ids.collect())

    assert (scan("Y"), scan("N"), scan("Y"), scan("other")) == ([1], [2], [1], [])


def test_an_export_feed_with_a_new_checkpoint_keeps_what_was_exported(spark, tmp_path):
    people = spark.range(1, 9).select("id", F.format_string("u%d@x.y", "id").alias("email"))
    pages, out = tmp_path / "pages", tmp_path / "out"
    for number, ids in enumerate([(1, 2), (2, 3)]):
        land(pages, f"{number}.json", *ids)
        run_export_feed(spark, str(pages), people, checkpoint=str(tmp_path / f"state{number}"), key="k", field="F",
                        value="Y", columns="Email:email", out_dir=str(out), run_date=date(2026, 4, 24))
    for folder, column in (("base", "Customer ID"), ("clean", "Email")):
        found = sorted(r[column] for r in read_csv(spark, f"{out}/k/{folder}").collect())
        assert found == (["1", "2", "3"] if folder == "base" else ["u1@x.y", "u2@x.y", "u3@x.y"])


def test_value_feeds_with_checkpoints_of_their_own(spark, tmp_path):
    root = str(tmp_path / "values")

    def feed(number, *rows):
        landing = tmp_path / f"landing{number}"
        landing.mkdir(exist_ok=True)
        lines = [json.dumps(dict(zip(("customer_id", "name", "value", "ts", "seq"), r))) for r in rows]
        (landing / f"{len(list(landing.iterdir()))}.json").write_text("\n".join(lines))
        run_value_feed(stream_changes(spark, str(landing)), root, str(tmp_path / f"state{number}"))
        return sorted(map(tuple, read_values(spark, root).collect()))

    day = "2024-01-01T00:00:00Z"
    assert feed(1, ("1", "T", "a", day, 1)) == [(1, "T", "a")]
    assert feed(2, ("2", "T", "b", day, 1)) == [(1, "T", "a"), (2, "T", "b")]
    assert compact(spark, root)
    assert feed(3, ("1", "T", "c", day, 1)) == [(1, "T", "c"), (2, "T", "b")]
    assert feed(1, ("2", "T", "d", day, 0)) == [(1, "T", "c"), (2, "T", "d")]
    assert compact(spark, root)
    assert sorted(map(tuple, read_values(spark, root).collect())) == [(1, "T", "c"), (2, "T", "d")]

import os
import time
from pathlib import Path

from storegrain import workspace


def test_stage_keeps_rows_and_drop_removes_them(spark):
    df = spark.range(5).selectExpr("id", "parse_json(cast(id as string)) AS v")
    staged, count = workspace.stage_counted(df, "numbers")
    assert count == 5 and staged.count() == 5 and staged.dtypes == df.dtypes
    assert workspace.stage(df, "again").count() == 5
    assert workspace.drop_staged(spark)
    assert not workspace.drop_staged(spark)


def test_folders(spark, tmp_path):
    assert workspace.list_folder(spark, str(tmp_path / "none")) == []
    assert workspace.finished_folders(spark, str(tmp_path / "none"), "run=") == {}
    (tmp_path / "run=a").mkdir()
    (tmp_path / "run=b").mkdir()
    (tmp_path / "run=b" / "_SUCCESS").touch()
    assert list(workspace.finished_folders(spark, str(tmp_path), "run=")) == ["b"]
    assert workspace.path_exists(spark, str(tmp_path / "run=a"))


def test_shared_root_is_the_sessions(spark):
    assert workspace.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_empty_table(spark):
    df = workspace.empty_table(spark, "`a b` STRING, n ARRAY<INT>")
    assert df.columns == ["a b", "n"] and df.count() == 0


def test_staged_tables_of_applications_long_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_root", lambda _: str(tmp_path))
    for name, hours in (("app-old", 30), ("app-new", 1), (spark.sparkContext.applicationId, 99)):
        folder = tmp_path / "storegrain" / name
        (folder / "table").mkdir(parents=True)
        os.utime(folder, (time.time() - 3600 * hours,) * 2)
    assert workspace.expire_staged(spark, hours=24) == ["app-old"]
    left = sorted(p.name for p in Path(tmp_path / "storegrain").iterdir())
    assert left == sorted(["app-new", spark.sparkContext.applicationId])


def test_staging_keeps_the_sessions_setting(spark):
    for own in (None, "false", "true"):
        if own is not None:
            spark.conf.set(workspace.DROP_SHUFFLES, own)
        before = spark.conf.get(workspace.DROP_SHUFFLES, None)
        staged = workspace.stage(spark.range(1000).repartition(7, "id").groupBy("id").count(), "numbers")
        assert staged.count() == 1000 and spark.conf.get(workspace.DROP_SHUFFLES, None) == before
    spark.conf.unset(workspace.DROP_SHUFFLES)


def test_released_tables_are_deleted(spark):
    kept, gone = (workspace.stage(spark.range(3), label) for label in ("kept", "gone"))
    folder = gone.inputFiles()[0].rsplit("/", 1)[0]
    assert workspace.path_exists(spark, folder)
    workspace.release(gone)
    assert not workspace.path_exists(spark, folder) and kept.count() == 3

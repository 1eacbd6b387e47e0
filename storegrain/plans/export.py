"""Segment export: match, skip what was exported before, project, write CSV.

Layout under ``<out_dir>/<prefix>``::

    base/run=<run>/                                    full columns, keeps the customer id
    ledger/columns=<hash>/                             the ids of the base alone (see ``ledger``)
    clean/run_date=<day>/mode=<full|incremental>/run=<run>/   the columns asked for

An increment is told from the ledger, so it reads eight bytes a customer exported
before, not their cells; a base without ledger (or with other columns) is read as CSV.

A run owns its folders.  Repeating it under the same run id overwrites
them, so a run that died half-way is simply run again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, replace
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.functions.cells import ID_COLUMN, ColumnList, cells, parse_columns, with_id
from storegrain.functions.text import slug_of
from storegrain.operators.fields import check_request
from storegrain.operators.segments import customers_of, find_segment, not_exported, not_listed
from storegrain.plans.ledger import open_ledger
from storegrain.sources.csv_files import distinct_filled, read_csv, write_csv
from storegrain.workspace import finished_folders, matching_paths, stage_counted

FULL, INCREMENTAL = "full", "incremental"
RUN = "run="


@dataclass(frozen=True)
class ExportResult:
    """Counts and paths of an export; ``ids`` is the table of matched customers."""

    ids: DataFrame
    matched: int
    fetched: int
    written: int
    base_path: str
    clean_path: str
    exported: bool

    def report(self) -> DataFrame:
        cells = {
            "matched": F.lit(self.matched).cast("bigint"),
            "fetched": F.lit(self.fetched).cast("bigint"),
            "written": F.lit(self.written).cast("bigint"),
            "base_path": F.lit(self.base_path),
            "clean_path": F.lit(self.clean_path),
            "exported": F.lit(self.exported),
        }
        return self.ids.sparkSession.range(1).select(*[c.alias(n) for n, c in cells.items()])


@dataclass(frozen=True)
class ExportTarget:
    """Where one run of an export writes."""

    root: str
    run_date: date
    mode: str
    run: str

    @property
    def base(self) -> str:
        return f"{self.root}/base"

    @property
    def base_path(self) -> str:
        return f"{self.base}/{RUN}{self.run}"

    def ledger(self, full: ColumnList) -> str:
        """Ledgers belong to one column list, as all runs of a base share one."""
        columns = hashlib.sha256(json.dumps(list(full)).encode()).hexdigest()[:16]
        return f"{self.root}/ledger/columns={columns}"

    @property
    def clean_path(self) -> str:
        return (
            f"{self.root}/clean/run_date={self.run_date.isoformat()}"
            f"/mode={self.mode}/{RUN}{self.run}"
        )


def export_target(out_dir: str, key: str, *, prefix: str | None = None,
                  run_date: date | None = None, incremental: bool = False,
                  run: str | None = None) -> ExportTarget:
    """Named by prefix or slug of the key, run date (today in UTC) and mode."""
    return ExportTarget(
        root=f"{out_dir}/{prefix or slug_of(key)}",
        run_date=run_date or datetime.now(UTC).date(),
        mode=INCREMENTAL if incremental else FULL,
        run=run or uuid.uuid4().hex,
    )


def full_columns_of(columns: ColumnList, full: str | None) -> ColumnList:
    """The base columns; the customer id is always among them."""
    if full is None:
        return with_id(columns)
    given = parse_columns(full)
    return given if dict(given).get(ID_COLUMN[0]) == ID_COLUMN[1] else with_id(given)


def unexported(ids: DataFrame, target: ExportTarget, full: ColumnList) -> tuple[DataFrame, int] | None:
    """Ids that no finished run but this very one has in its base; None if there is no such run.

    All runs of a base share one column list; the read fails if headers differ.
    """
    spark = ids.sparkSession
    finished = finished_folders(spark, target.base, RUN)
    runs = sorted(run for run in finished if run != target.run)
    if not runs:
        return None
    ledger = open_ledger(spark, target.ledger(full))
    listed = ledger.rows(spark, set(runs))
    unlisted = [finished[run] for run in runs if run not in ledger.runs]
    new = ids
    if listed is not None:
        new = not_listed(new, listed.select("id"))
    if unlisted:
        rows = read_csv(spark, unlisted, trim=True, columns=list(dict(full)))
        new = not_exported(new, distinct_filled(rows, ID_COLUMN[0]), ID_COLUMN[0])
    return stage_counted(new, "new-ids")


def settle(spark: SparkSession, target: ExportTarget) -> ExportTarget:
    """Keep the run date of an earlier attempt of the same run, if there was one."""
    own = f"{target.root}/clean/run_date=*/mode={target.mode}/{RUN}{target.run}"
    for path in matching_paths(spark, own):
        day = path.split("/run_date=")[1].split("/")[0]
        return replace(target, run_date=date.fromisoformat(day))
    return target


def write_export(customers: DataFrame, ids: DataFrame, columns: ColumnList,
                 full: ColumnList, target: ExportTarget, write: bool) -> int:
    """Project the customers of ``ids`` and write all outputs; returns the row count.

    The cells of both column lists are computed once into a written table.  The
    base comes last: until it is there a repeated run finds the same customers.
    """
    found = customers_of(customers, ids)
    clean_cells = [c.alias(f"c{i}") for i, c in enumerate(cells(found, columns))]
    full_cells = [c.alias(f"f{i}") for i, c in enumerate(cells(found, full))]
    staged, count = stage_counted(found.select("id", *clean_cells, *full_cells), "export")
    if write and count:
        staged.select("id").write.mode("overwrite").parquet(f"{target.ledger(full)}/{RUN}{target.run}")
        for kind, names, path in (("c", dict(columns), target.clean_path),
                                  ("f", dict(full), target.base_path)):
            named = [F.col(f"{kind}{i}").alias(name) for i, name in enumerate(names)]
            write_csv(staged.select(*named), path, mode="overwrite")
    return count


def export_segment(values: DataFrame, customers: DataFrame, *, key: str, field: str, value: str,
                   columns: str, out_dir: str, full_columns: str | None = None,
                   prefix: str | None = None, run_date: date | None = None,
                   run: str | None = None, incremental: bool = False, write: bool = False,
                   registry: DataFrame | None = None) -> ExportResult:
    """Export the customers whose ``field`` equals ``value``.

    ``write=False`` is a dry run with the same counts.  If nothing matches, or
    nothing is new, the counts are zero and nothing is written.
    """
    if registry is not None:
        check_request(registry, field, value)
    wanted = parse_columns(columns)
    full = full_columns_of(wanted, full_columns)
    target = export_target(out_dir, key, prefix=prefix, run_date=run_date,
                           incremental=incremental, run=run)
    target = settle(values.sparkSession, target)
    ids, matched = find_segment(values, field, value)
    return export_ids(ids, matched, customers, wanted, full, target, write)


def export_ids(ids: DataFrame, matched: int, customers: DataFrame, columns: ColumnList,
               full: ColumnList, target: ExportTarget, write: bool) -> ExportResult:
    """The part of an export after the match; ``ids`` are distinct."""
    fetched, new = matched, ids
    if target.mode == INCREMENTAL and matched:
        new, fetched = unexported(ids, target, full) or (ids, matched)
    written = write_export(customers, new, columns, full, target, write) if fetched else 0
    return ExportResult(ids, matched, fetched, written, target.base_path,
                        target.clean_path, write and written > 0)

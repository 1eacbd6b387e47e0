"""The ledger of an export: which run exported which customer, as ids alone.

Layout under the ``ledger/columns=<hash>`` folder of an export::

    run=<run>/           ids of one run
    folds/runs=<n>/      names of the runs in a fold
    folds/upto=<n>/      their ids with the run, sorted by id

Runs come one by one, so after thousands of increments most of the reading would be
opening small folders. :func:`compact_ledgers` writes the ids of all runs into one
fold and drops their folders. A fold counts once its ids are written, names being
written before; folders go only then, and while a run has one, it counts in place of
the fold's rows: so a fold that died half-way, or a run repeated after it, changes nothing.

As exports do, folding takes one writer at a time for granted. The fold before stays
for those who still read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.workspace import delete_folder, empty_table, finished_folders, list_folder

RUN, NAMES, FOLD = "run=", "runs=", "upto="
ROWS = "id BIGINT, run STRING"


@dataclass(frozen=True)
class Ledger:
    """What one ledger folder holds: runs in folders, and the newest fold with its runs."""

    path: str
    folders: dict[str, str]
    number: int
    fold: str | None
    folded: frozenset[str]

    @property
    def runs(self) -> frozenset[str]:
        return self.folded | set(self.folders)

    def rows(self, spark: SparkSession, runs: set[str]) -> DataFrame | None:
        """``id, run`` of these runs; None if the ledger knows none of them."""
        own = [self.folders[run] for run in sorted(runs) if run in self.folders]
        older = (self.folded - set(self.folders)) & runs
        parts = []
        if own:
            parts.append(spark.read.schema(ROWS).option("basePath", self.path).parquet(*own))
        if older:
            rows = spark.read.schema(ROWS).parquet(self.fold)
            gone = sorted(self.folded - older)  # repeated runs and those whose base was deleted
            parts.append(rows.where(~F.col("run").isin(gone)) if gone else rows)
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None


def open_ledger(spark: SparkSession, path: str) -> Ledger:
    """The state of the ledger in a folder, which may be absent."""
    folds = {int(n): folder for n, folder in finished_folders(spark, f"{path}/folds", FOLD).items()}
    number = max(folds, default=-1)
    folded = frozenset()
    if folds:
        names = spark.read.schema("run STRING").parquet(f"{path}/folds/{NAMES}{number}")
        folded = frozenset(row.run for row in names.toLocalIterator())
    return Ledger(path, finished_folders(spark, path, RUN), number, folds.get(number), folded)


def _ledgers(spark: SparkSession, root: str) -> list[Ledger]:
    found = sorted(path for name, path, _ in list_folder(spark, f"{root}/ledger") if name.startswith("columns="))
    return [open_ledger(spark, path) for path in found]


def exported_when(spark: SparkSession, root: str) -> DataFrame:
    """``id, run`` of all finished runs of the export under ``root``, one row each.

    Runs whose base is missing, or unfinished, count for nothing.
    """
    finished = set(finished_folders(spark, f"{root}/base", RUN))
    found = empty_table(spark, ROWS)
    for ledger in _ledgers(spark, root):
        rows = ledger.rows(spark, finished)
        if rows is not None:
            found = found.unionByName(rows)
    return found


def compact_ledgers(spark: SparkSession, root: str) -> int:
    """Fold the runs of the export under ``root``; returns how many folders went.

    Folders of unfinished runs stay as they are, as do runs whose name holds a percent
    sign, which folder names escape. A fold's rows of runs whose base is gone go too.
    """
    finished = set(finished_folders(spark, f"{root}/base", RUN))
    return sum(_fold(spark, ledger, {run for run in finished if "%" not in run}) for ledger in _ledgers(spark, root))


def _fold(spark: SparkSession, ledger: Ledger, finished: set[str]) -> int:
    new = sorted(finished & set(ledger.folders))
    if not new:
        return 0
    kept, number = ledger.runs & finished, ledger.number + 1
    names = spark.createDataFrame([(run,) for run in sorted(kept)], "run STRING").coalesce(1)
    names.write.mode("overwrite").parquet(f"{ledger.path}/folds/{NAMES}{number}")
    rows = ledger.rows(spark, kept).repartitionByRange("id").sortWithinPartitions("id", "run")
    rows.write.mode("overwrite").parquet(f"{ledger.path}/folds/{FOLD}{number}")
    for run in new:
        delete_folder(spark, ledger.folders[run])
    for before in range(number - 1):
        delete_folder(spark, f"{ledger.path}/folds/{FOLD}{before}")
        delete_folder(spark, f"{ledger.path}/folds/{NAMES}{before}")
    return len(new)

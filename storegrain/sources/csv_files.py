"""CSV in the export format: header, every cell quoted, quotes doubled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storegrain.workspace import empty_table, path_exists

# A file with line breaks inside cells cannot be split on reading, so its size is bounded.
ROWS_PER_FILE = 1_000_000


def write_csv(rows: DataFrame, path: str, *, mode: str = "append") -> None:
    """Append text rows under ``path``: one folder of part files, each with a header."""
    (
        rows.write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str | list[str], *, trim: bool = False,
             columns: list[str] | None = None) -> DataFrame:
    """Read such folders back; every cell is text and a blank one is ``''``.

    With ``columns`` each file's header must list exactly these.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", trim)
        .option("ignoreTrailingWhiteSpace", trim)
    )
    if columns:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path).na.fill("")


def column_values(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct non-blank values of one column of an earlier export.

    A path that is not there gives an empty result, and so does an unknown column.
    Each file is read by its own header, so their columns may be in any order: files
    are told apart by header first, and those with one header are read together.
    """
    if not path_exists(spark, path):
        return empty_table(spark, f"`{column}` STRING")
    out = None
    for columns, files in _headers(spark, path).items():
        if column in columns:
            found = distinct_filled(read_csv(spark, files, trim=True, columns=list(columns)), column)
            out = found if out is None else out.unionByName(found)
    return empty_table(spark, f"`{column}` STRING") if out is None else out.distinct()


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The different headers under ``path`` and the files of each.

    First lines only: the rows of a file are not looked at beyond its first.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = [r["path"] for r in files.where("length > 0").select("path").collect()]
    found: dict[tuple[str, ...], list[str]] = {}
    for name in sorted(n for n in names if not n.rsplit("/", 1)[1].startswith(("_", "."))):
        header = read_csv(spark, name, trim=True).columns
        found.setdefault(tuple(header), []).append(name)
    return found


def distinct_filled(rows: DataFrame, column: str) -> DataFrame:
    value = F.col(f"`{column}`")
    return rows.where(value != "").select(value).distinct()

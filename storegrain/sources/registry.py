"""The field registry: versioned folders of ``{name, type, options}`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain import schemas
from storegrain.sources.checks import require
from storegrain.sources.landed import read_pages
from storegrain.workspace import empty_table, finished_folders, path_exists, stage

VERSION = "version="


def registry_problems(registry: DataFrame) -> DataFrame:
    """Entries without a name or with an unknown type, each with its problem."""
    problem = F.when(
        F.coalesce(F.col("name"), F.lit("")) == "", F.lit("empty name")
    ).when(~F.col("type").isin(*schemas.FIELD_TYPES), F.lit("unknown type"))
    return registry.withColumn("problem", problem).where("problem is not null")


def require_sound(registry: DataFrame) -> DataFrame:
    """Fails the job at the first malformed entry."""
    named = F.coalesce(F.col("name") != "", F.lit(False))
    typed = F.coalesce(F.col("type").isin(*schemas.FIELD_TYPES), F.lit(True))
    return registry.where(
        F.assert_true(named & typed, F.lit("registry entry without name or with unknown type"))
        .isNull()
    )


def read_registry_file(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame:
    """A ``{"formFields": [...]}`` file, or one entry per object; absent is empty.

    ``position`` is the place of an entry in its list. A file of another shape fails the job.
    """
    if not path_exists(spark, path):
        return empty_table(spark, f"{schemas.FIELD_REGISTRY}, position INT")
    pages = require(
        read_pages(spark, path, multiline=multiline), "page", schemas.REGISTRY_FILE_RULES,
        "registry entry",
    )
    is_entry = F.expr(
        "try_variant_get(page, '$.name', 'variant') is not null"
        " or try_variant_get(page, '$.type', 'variant') is not null"
        " or try_variant_get(page, '$.options', 'variant') is not null"
    )
    entries = pages.select(
        F.posexplode(
            F.coalesce(
                F.try_variant_get("page", "$.formFields", "array<variant>"),
                F.when(is_entry, F.array("page")),
            )
        ).alias("position", "row")
    )
    return require_sound(
        entries.select(
            F.try_variant_get("row", "$.name", "string").alias("name"),
            F.try_variant_get("row", "$.type", "string").alias("type"),
            F.try_variant_get("row", "$.options", "array<string>").alias("options"),
            "position",
        )
    )


def _versions(spark: SparkSession, root: str) -> dict[int, str]:
    return {int(n): path for n, path in finished_folders(spark, root, VERSION).items()}


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """The newest finished version under ``root``; none is an empty registry."""
    versions = _versions(spark, root)
    if not versions:
        return empty_table(spark, schemas.FIELD_REGISTRY)
    return require_sound(
        spark.read.schema(schemas.FIELD_REGISTRY)
        .option("mode", "FAILFAST")
        .json(versions[max(versions)])
    )


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    balance = signed.groupBy(*left.columns).agg(F.sum("_n").alias("_n"))
    return balance.where(F.col("_n") != 0).isEmpty()


def save_registry(registry: DataFrame, root: str) -> bool:
    """Write ``registry`` as the next version; False if it equals the newest one."""
    spark = registry.sparkSession
    wanted = stage(require_sound(registry.select(*schemas.REGISTRY_COLUMNS)), "registry")
    versions = _versions(spark, root)
    if versions and same_rows(wanted, read_registry(spark, root)):
        return False
    number = max(versions, default=0) + 1
    wanted.write.mode("overwrite").json(f"{root}/{VERSION}{number}")
    return True

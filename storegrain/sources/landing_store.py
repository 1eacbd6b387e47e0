"""Landed pages as checked Parquet: a page is parsed and checked once, then only columns are read.

``<root>/changes/batch=<n>-<feed>-<batch>/state=<sound|rejected>/slot=<s>``   one batch
``<root>/base/upto=<n>/state=sound/slot=<s>``                                 batches folded into one

Sound rows are typed; rejected ones keep their object as JSON and the rules they
break, both from one pass over the pages. ``slot`` is a hash of the column that
readers ask by (the field name of values, the id of others): asking for one key
opens its slot alone, and rows are sorted by that column inside a file, which
lets the scan skip row groups. A hot key fills its slot with as many files as it
needs, as batches are rebalanced by size.

A table of one kind of row has a root of its own. Values and the like are the union
of all batches. Of kinds with ``latest`` the rows of a key count from the newest
batch that has the key: a page that is landed again replaces what it held before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain import schemas
from storegrain.operators.keys import one_per_key
from storegrain.sources import landed
from storegrain.sources.batches import BASE, batch_name, newest_base, pending_batches
from storegrain.sources.checks import FAIL, QUARANTINE, problems
from storegrain.workspace import empty_table, session_settings, stage

SLOTS = 64
SOUND, REJECTED = "sound", "rejected"
# Objects are stored as they are: taking their keys apart into columns of their own, as
# Spark does by itself, repeats the typed columns beside them.
WHOLE_OBJECTS = {"spark.sql.variant.inferShreddingSchema": "false"}
STORED = "problems ARRAY<STRING>, raw STRING, file STRING, state STRING, slot INT"


@dataclass(frozen=True)
class Kind:
    """How rows of one kind are landed, checked and asked for.

    ``pages`` are envelopes with rules of their own, ``rows`` takes rows out of other
    payloads. ``key`` is the column asked by; with ``single`` a key has one row.
    """

    columns: Callable[[], list[Column]]
    schema: str
    rules: tuple[schemas.Rule, ...]
    key: str
    rows: Callable[[DataFrame], DataFrame] | None = None
    latest: bool = True
    single: bool = False


CART_SCHEMA = (
    "id STRING, customer_id BIGINT, created_time TIMESTAMP, updated_time TIMESTAMP, "
    f"physical_items {schemas.CART_ITEMS}, extra VARIANT"
)

KINDS = {
    "customers": Kind(landed.customer_columns, schemas.CUSTOMERS, schemas.CUSTOMER_RULES, "id", single=True),
    "field_values": Kind(
        landed.field_value_columns, schemas.FORM_FIELD_VALUES, schemas.FIELD_VALUE_RULES, "name", latest=False
    ),
    "orders": Kind(
        lambda: landed.list_columns(schemas.ORDERS), schemas.ORDERS, schemas.ORDER_RULES, "id", landed.list_rows,
        single=True,
    ),
    "order_products": Kind(
        lambda: landed.list_columns(schemas.ORDER_PRODUCTS), schemas.ORDER_PRODUCTS, schemas.ORDER_PRODUCT_RULES,
        "order_id", landed.list_rows,
    ),
    "order_fees": Kind(
        lambda: landed.list_columns(schemas.ORDER_FEES), schemas.ORDER_FEES, schemas.ORDER_FEE_RULES, "order_id",
        landed.list_rows,
    ),
    "carts": Kind(landed.cart_columns, CART_SCHEMA, schemas.CART_RULES, "id", landed.cart_rows, single=True),
}


def slot_of(key: Column) -> Column:
    """The slot of a key; of a literal it is a constant, so the scan lists that slot only."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(SLOTS)).cast("int")


def checked_rows(pages: DataFrame, kind: Kind) -> DataFrame:
    """Typed columns, ``problems`` (empty for a sound row), ``raw`` of the others, and ``file``.

    A page that breaks the rules of pages is one rejected row.
    """
    if kind.rows:
        rows = kind.rows(pages).withColumn("problems", problems(F.col("row"), kind.rules))
    else:
        broken = pages.withColumn("broken", problems(F.col("page"), schemas.PAGE_RULES))
        data = F.try_variant_get("page", "$.data", "array<variant>")
        sound = F.size("broken") == 0
        rows = broken.select(F.explode(F.when(sound, data).otherwise(F.array("page"))).alias("row"), "broken", "file")
        rows = rows.withColumn("problems", F.when(sound, problems(F.col("row"), kind.rules)).otherwise(F.col("broken")))
    raw = F.when(F.size("problems") > 0, F.to_json("row"))
    return rows.select(*kind.columns(), "problems", raw.alias("raw"), "file")


def store_batch(pages: DataFrame, root: str, kind_name: str, batch: int, feed: str = "pages",
                mode: str = QUARANTINE) -> str:
    """Check the pages of a batch and store their rows; a replay overwrites its own folder.

    ``mode="fail"`` fails at the first bad row, and the batch is not stored.
    Returns the name of the folder.
    """
    if mode not in (FAIL, QUARANTINE):
        raise ValueError(f"mode must be {FAIL!r} or {QUARANTINE!r}, not {mode!r}")
    kind = KINDS[kind_name]
    rows = checked_rows(pages, kind)
    if mode == FAIL:
        what = F.concat(F.lit(f"bad row for {kind_name}, expected "), F.array_join("problems", ", "))
        rows = rows.where(F.assert_true(F.size("problems") == 0, what).isNull())
    good = F.size("problems") == 0
    rows = rows.withColumns({
        "state": F.when(good, SOUND).otherwise(REJECTED),
        "slot": F.when(good, slot_of(F.col(kind.key))).otherwise(0),
    })
    name = batch_name(pages.sparkSession, root, feed, batch)
    _write(rows, kind, f"{root}/changes/{name}")
    return name


def _write(rows: DataFrame, kind: Kind, path: str) -> None:
    laid_out = rows.hint("rebalance", "state", "slot").sortWithinPartitions("state", "slot", kind.key)
    with session_settings(rows.sparkSession, WHOLE_OBJECTS):
        laid_out.write.partitionBy("state", "slot").mode("overwrite").parquet(path)


def _scan(spark: SparkSession, folders: list[str], kind: Kind, state: str, *more: str) -> DataFrame:
    within = folders[0].rsplit("/", 1)[0]
    rows = spark.read.schema(", ".join([kind.schema, STORED, *more])).option("basePath", within).parquet(*folders)
    return rows.where(F.col("state") == state)


def _asked(rows: DataFrame, kind: Kind, key: object | None) -> DataFrame:
    if key is None:
        return rows
    return rows.where((F.col("slot") == slot_of(F.lit(key))) & (F.col(kind.key) == F.lit(key)))


def _names(kind: Kind) -> list[str]:
    return [c.name for c in schemas.struct_of(kind.schema).fields]


def _pending_rows(spark: SparkSession, folders: list[str], kind: Kind, key: object | None) -> DataFrame:
    """Sound rows of batches with the ``batch`` they came with, a constant of each folder."""
    rows = _asked(_scan(spark, folders, kind, SOUND, "batch STRING"), kind, key)
    return rows.withColumn("batch", F.substring_index("batch", "-", 1).cast("bigint"))


def _newest_rows(spark: SparkSession, pending: dict[int, str], kind: Kind, key: object | None) -> DataFrame:
    """Of pending rows those of each key's newest batch.

    Only batches after the first replace others, so their keys alone are gathered;
    the join above them is the one exchange of the rows, by their key.
    """
    first, *later = [pending[n] for n in sorted(pending)]
    rows = _pending_rows(spark, [first, *later], kind, key)
    if later:
        replaced = _pending_rows(spark, later, kind, key).groupBy(F.col(kind.key).alias("_key"))
        newest = stage(replaced.agg(F.max("batch").alias("_batch")), "newest-batches")
        rows = rows.join(newest, rows[kind.key] == newest["_key"], "left")
        rows = rows.where(F.col("_batch").isNull() | (F.col("batch") == F.col("_batch")))
    rows = rows.select(*_names(kind))
    return one_per_key(rows, kind.key).select(*_names(kind)) if kind.single else rows


def read_store(spark: SparkSession, root: str, kind_name: str, key: object | None = None) -> DataFrame:
    """The sound rows of a store, or those of one ``key``.

    Pending batches are merged with the base: keys they hold replace those of the base.
    """
    kind = KINDS[kind_name]
    upto, folder = newest_base(spark, root)
    pending = pending_batches(spark, root, upto)
    names = _names(kind)
    base = _asked(_scan(spark, [folder], kind, SOUND), kind, key).select(*names) if folder else None
    if not pending:
        return empty_table(spark, kind.schema) if base is None else base
    changes = _asked(_scan(spark, list(pending.values()), kind, SOUND), kind, key)
    if not kind.latest:
        rows = changes.select(*names)
        return rows if base is None else base.unionByName(rows)
    rows = _newest_rows(spark, pending, kind, key)
    if base is None:
        return rows
    changed = stage(changes.select(F.col(kind.key).alias("_key")).distinct(), "changed-keys")
    return base.join(changed, base[kind.key] == changed["_key"], "left_anti").unionByName(rows)


def read_rejects(spark: SparkSession, root: str, kind_name: str) -> DataFrame:
    """``row`` (VARIANT), ``problems`` and ``file`` of the rows set aside in batches still there."""
    kind = KINDS[kind_name]
    folders = list(pending_batches(spark, root, -1).values())
    if not folders:
        return empty_table(spark, "row VARIANT, problems ARRAY<STRING>, file STRING")
    rejected = _scan(spark, folders, kind, REJECTED)
    return rejected.select(F.parse_json("raw").alias("row"), "problems", "file")


def compact_store(spark: SparkSession, root: str, kind_name: str) -> bool:
    """Fold the pending batches into a new base; False if nothing is pending.

    Rejects stay with their batches until :func:`storegrain.sources.batches.vacuum`.
    """
    kind = KINDS[kind_name]
    upto, _ = newest_base(spark, root)
    pending = pending_batches(spark, root, upto)
    if not pending:
        return False
    none = {"problems": F.array().cast("array<string>"), "raw": F.lit(None).cast("string"), "file": F.lit(None).cast("string")}
    rows = read_store(spark, root, kind_name).withColumns(
        none | {"state": F.lit(SOUND), "slot": slot_of(F.col(kind.key))}
    )
    _write(rows, kind, f"{root}/base/{BASE}{max(pending)}")
    return True

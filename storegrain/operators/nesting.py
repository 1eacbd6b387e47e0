"""Child rows nested into lists on their parents.

The main form of a parent with children is flat: one row a child (see
``orders.order_product_rows``). Where a list is wanted, the caller says into how
many ``parts`` it is cut, one if nothing is said; every parent then has exactly
that many rows, numbered in a ``<list>_part`` column, whatever the number of its
children. A list must fit into a task's memory, so parents with very many
children are read flat or with more parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_column(into: str) -> str:
    return f"{into}_part"


def _orderable(children: DataFrame, name: str) -> Column:
    """A column in a form that has an order: variants by their text."""
    if "variant" in children.schema[name].dataType.simpleString():
        return F.to_json(F.col(name))
    return F.col(name)


def nest(children: DataFrame, key: str, elements: list[str], into: str, parts: int = 1) -> DataFrame:
    """Lists of child structs by key and part, sorted by the fields in order.

    Rows with a null key are left out, as they belong to no parent. The part is
    taken from the content of a row, so equal rows lie in one part.
    """
    order = F.struct(*[_orderable(children, name).alias(f"k{n}") for n, name in enumerate(elements)])
    part = F.lit(0)
    if parts > 1:
        part = F.pmod(F.xxhash64(order), F.lit(parts)).cast("int")
    rows = children.where(F.col(key).isNotNull()).select(
        F.col(key), part.alias(part_column(into)), F.struct(order.alias("order"), F.struct(*elements).alias("row")).alias("_row")
    )
    # Collecting makes nothing smaller, so plain rows are shuffled, not partial lists.
    keys = [key, part_column(into)] if parts > 1 else [key]
    gathered = F.collect_list("_row")
    if any("variant" in children.schema[name].dataType.simpleString() for name in elements):
        listed = F.array_sort(gathered, _by_order)
    else:
        listed = F.sort_array(gathered)
    return rows.repartition(*keys).groupBy(key, part_column(into)).agg(
        F.transform(listed, lambda r: r["row"]).alias(into)
    )


def _by_order(left: Column, right: Column) -> Column:
    a, b = left["order"], right["order"]
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def attach(parents: DataFrame, parent_key: str, nested: DataFrame, key: str, into: str, parts: int = 1) -> DataFrame:
    """Left join nested lists to parents, ``parts`` rows each; no children give an empty list."""
    part = part_column(into)
    lists = nested.select(F.col(key).alias("_key"), F.col(part).alias("_part"), F.col(into))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    spread = parents.withColumn(part, numbers)
    on = spread[parent_key] == lists["_key"]
    if parts > 1:
        on = on & (spread[part] == lists["_part"])
    joined = spread.join(lists, on, "left").drop("_key", "_part")
    empty = F.array().cast(nested.schema[into].dataType)
    return joined.withColumn(into, F.coalesce(into, empty))


def nest_and_attach(parents: DataFrame, parent_key: str, children: DataFrame, key: str,
                    elements: list[str], into: str, parts: int = 1) -> DataFrame:
    nested = nest(children, key, list(elements), into, parts)
    return attach(parents, parent_key, nested, key, into, parts)

"""Row checks on landed JSON: wrong types and missing keys are named per row.

Spark's JSON reader silently reads a missing key as NULL, so rows arrive as
VARIANT and are checked against the rules in ``schemas`` before typing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storegrain.schemas import Rule

FAIL, QUARANTINE = "fail", "quarantine"
NUMBER_SHAPES = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def read_time(text: Column) -> Column:
    """Times as ISO 8601 or as RFC 2822 (``Tue, 20 Nov 2012 00:00:00 +0000``); null if neither."""
    mail = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    return F.coalesce(
        F.try_to_timestamp(text), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))
    )


def fields_of(row: Column | str, kinds: Mapping[str, str]) -> Column:
    """Struct of the values that an object holds at the given keys, each of the type given.

    Null where the key is missing or the value of another type. One pass over the
    object takes them all; a path a key searches anew each time, and Spark leaves
    the search for a missing key by an exception.
    """
    return F.try_variant_get(row, "$", _struct(kinds))


def _struct(kinds: Mapping[str, str]) -> str:
    return f"struct<{', '.join(f'`{key}`: {kind}' for key, kind in kinds.items())}>"


def _is_number(shape: Column) -> Column:
    number = F.lit(False)
    for name in NUMBER_SHAPES:
        number = number | F.startswith(shape, F.lit(name))
    return number


def _has_kind(value: Column, kind: str) -> Column:
    if kind == "array":
        return F.try_variant_get(value, "$", "array<variant>").isNotNull()
    if kind == "object":
        return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()
    shape = F.schema_of_variant(value)
    if kind == "string":
        return shape == "STRING"
    if kind == "number":
        return _is_number(shape)
    if kind == "whole":
        number = F.try_variant_get(value, "$", "decimal(38,9)")
        return (shape == "BIGINT") | (_is_number(shape) & (number == F.try_variant_get(value, "$", "bigint")))
    if kind == "money":
        exact = F.try_variant_get(value, "$", "decimal(18,4)")
        return exact == F.try_variant_get(value, "$", "decimal(38,18)")
    if kind == "time":
        return (shape == "STRING") & read_time(F.try_variant_get(value, "$", "string")).isNotNull()
    # text_or_list: "ARRAY<VOID>" is an empty list
    return shape.isin("STRING", "ARRAY<STRING>", "ARRAY<VOID>")


def _variants(rules: Sequence[Rule]) -> dict[str, str]:
    return {rule.path: "variant" for rule in rules}


def _any_broken(held: Column, rules: Sequence[Rule]) -> Column:
    broken = F.lit(False)
    for rule in rules:
        broken = broken | _broken(held[rule.path], rule)
    return broken


def _broken(value: Column, rule: Rule) -> Column:
    """True where what a row holds at the rule's path breaks the rule (never null)."""
    good = F.coalesce(_has_kind(value, rule.kind), F.lit(False))
    if rule.items:
        elements = F.try_variant_get(value, "$", f"array<{_struct(_variants(rule.items))}>")
        bad_element = F.exists(elements, lambda element: _any_broken(element, rule.items))
        good = good & F.coalesce(~bad_element, F.lit(False))
    if rule.members:
        good = good & ~_any_broken(fields_of(value, _variants(rule.members)), rule.members)
    if rule.nullable:
        good = good | F.coalesce(F.schema_of_variant(value) == "VOID", F.lit(False))
    if not rule.required:
        good = good | value.isNull()
    return ~good


def problems(row: Column, rules: Sequence[Rule]) -> Column:
    """Array of the broken rules' paths; empty for a sound row."""
    held, none = fields_of(row, _variants(rules)), F.array().cast("array<string>")
    found = [F.when(_broken(held[r.path], r), F.array(F.lit(f"{r.path}: {r.kind}"))).otherwise(none) for r in rules]
    return F.flatten(F.array(*found))


def require(df: DataFrame, row: str, rules: Sequence[Rule], what: str) -> DataFrame:
    """Keep all rows; the job fails at the first one that breaks a rule."""
    broken = problems(F.col(row), rules)
    sound = F.assert_true(
        F.size(broken) == 0,
        F.concat(F.lit(f"bad {what}, expected "), F.array_join(broken, ", ")),
    )
    return df.where(sound.isNull())


def split_rows(
    df: DataFrame, row: str, rules: Sequence[Rule]
) -> tuple[DataFrame, DataFrame]:
    """(sound rows, bad rows with their ``problems``)."""
    marked = df.withColumn("problems", problems(F.col(row), rules))
    sound = marked.where(F.size("problems") == 0).drop("problems")
    return sound, marked.where(F.size("problems") > 0)

"""Publish a field registry from the store's field catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.operators.fields import registry_entries
from storegrain.sources.registry import save_registry


def publish_registry(catalog: DataFrame, root: str, *, include_built_in: bool = False,
                     names: Sequence[str] | None = None) -> bool:
    """Save the chosen fields as the registry; False if nothing changed.

    Without ``names`` all visible fields are taken.
    """
    entries = registry_entries(catalog, include_built_in)
    if names is not None:
        entries = entries.where(F.col("name").isin(*names))
    return save_registry(entries, root)

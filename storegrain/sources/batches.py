"""A table kept as a base plus numbered batches, each in a folder of its own.

``<root>/base/upto=<n>``                      every batch up to ``n`` in one
``<root>/changes/batch=<n>-<feed>-<batch>``   one batch

A batch is known by its feed and its number there; ``n`` is its place in the
order in which batches arrived, over all feeds. A folder counts only once its
write has finished.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from storegrain.workspace import delete_folder, finished_folders, list_folder

BASE, BATCH = "upto=", "batch="


def batch_name(spark: SparkSession, root: str, feed: str, batch: int) -> str:
    """The folder of a batch: its own from an earlier attempt, or the next number.

    One writer at a time is taken for granted, as for any table of a feed.
    """
    ending = f"-{feed}-{batch}"
    names = [name for name, _, _ in list_folder(spark, f"{root}/changes") if name.startswith(BATCH)]
    own = [name for name in names if name.endswith(ending)]
    if own:
        return own[0]
    taken = [_number(name.removeprefix(BATCH)) for name in names]
    taken += _numbered(spark, f"{root}/base", BASE)
    return f"{BATCH}{max(taken, default=-1) + 1}{ending}"


def _number(name: str) -> int:
    return int(name.split("-")[0])


def _numbered(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    return {_number(n): folder for n, folder in finished_folders(spark, path, prefix).items()}


def newest_base(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and folder of the newest base; -1 and None if there is none."""
    bases = _numbered(spark, f"{root}/base", BASE)
    return (max(bases), bases[max(bases)]) if bases else (-1, None)


def pending_batches(spark: SparkSession, root: str, after: int) -> dict[int, str]:
    """Folders of the batches that a base does not hold yet, by their numbers."""
    batches = _numbered(spark, f"{root}/changes", BATCH)
    return {n: path for n, path in batches.items() if n > after}


def batch_number() -> Column:
    """The number of the batch that a row was read from."""
    return F.regexp_extract(F.col("_metadata.file_path"), f"/{BATCH}([0-9]+)-", 1).cast("bigint")


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete all bases but the newest ``keep``, and the batches that the oldest kept one holds.

    Returns the folders deleted. ``keep=2`` spares those who still read the base
    before. The newest batch stays, by which a replayed one knows its folder, and
    without a base nothing goes.
    """
    if keep < 1:
        raise ValueError("keep the newest base at least")
    bases = _numbered(spark, f"{root}/base", BASE)
    if not bases:
        return []
    kept = sorted(bases)[-keep:]
    batches = _numbered(spark, f"{root}/changes", BATCH)
    gone = [bases[n] for n in sorted(bases) if n < kept[0]]
    gone += [batches[n] for n in sorted(batches) if n <= kept[0] and n < max(batches)]
    for folder in gone:
        delete_folder(spark, folder)
    return gone

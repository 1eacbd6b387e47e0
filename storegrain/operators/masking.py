"""Tables made safe for sharing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.functions.text import mask_email, mask_secret


def mask_columns(df: DataFrame, emails: Sequence[str] = ("email",),
                 secrets: Sequence[str] = ()) -> DataFrame:
    """Mask the named columns in place."""
    masked = {c: mask_email(F.col(c)) for c in emails}
    masked |= {c: mask_secret(F.col(c)) for c in secrets}
    return df.withColumns(masked)

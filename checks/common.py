"""Small helpers shared by the checks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns: the last bits of sums and sines differ between engines."""
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})

"""Global row order without a single task that sees all rows."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PARTS = 256


def boundaries(values: DataFrame, parts: int = _PARTS) -> list[str]:
    """At most `parts` - 1 values of the only column, a string, that divide it in ranges of about equal size.

    They are taken from a sample of 32 values for each range, those of lowest hashes.
    """
    v = values.columns[0]
    sample = sorted(r[0] for r in values.where(F.col(v).isNotNull()).orderBy(F.xxhash64(v)).limit(32 * parts).collect())
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def ordered(df: DataFrame, key: str, rest: list[str | Column], edges: list[str], name: str = "ord") -> DataFrame:
    """Adds a long that follows the order of (key, *rest): the range of the key in its upper bits, the row's place within it below.

    Each range is numbered by a task of its own, so numbers have gaps between ranges.
    """

    @F.pandas_udf("int")
    def part(values: pd.Series) -> pd.Series:
        return values.map(lambda x: bisect_right(edges, x or "")).astype("int32")

    w = Window.partitionBy("_part").orderBy(key, *rest)
    place = F.shiftleft(F.col("_part").cast("long"), 40) + F.row_number().over(w) - 1
    return df.withColumn("_part", part(F.col(key))).withColumn(name, place.cast("long")).drop("_part")

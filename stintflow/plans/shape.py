"""Small output helpers shared by the plan modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def r(value: Column | str, digits: int, name: str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits).alias(name)


def joined(name: str, sep: str = ",") -> Column:
    """An array of ids as one string."""
    return F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), sep).alias(name)


def div(num: Column, den: Column, default=None) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(default))

"""Joins that need more than one built-in call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.scale import top_k, with_ordinal


def occurrence_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str
) -> DataFrame:
    """Match the k-th left row of a key with its k-th right row, so duplicate keys never fan out.

    Rows are numbered by their unique ids. Adds ``occ`` (0-based) and ``matched``.
    """
    a = with_ordinal(left, keys, None, left_id, "_n").withColumn("occ", F.col("_n") - 1).drop("_n")
    b = with_ordinal(right, keys, None, right_id, "_n").withColumn("occ", F.col("_n") - 1).drop("_n")
    b = b.withColumn("_hit", F.lit(True))
    return (
        a.join(b, [*keys, "occ"], "left")
        .withColumn("matched", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def full_outer_filled(a: DataFrame, b: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Union of keys with absent measures as zero."""
    joined = a.join(b, keys, "full")
    return joined.select(*keys, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def resolve_key(
    rows: DataFrame, candidates: DataFrame, on: list[str], row_id: str, prefer: Column, position: str
) -> DataFrame:
    """One candidate per row: those that satisfy ``prefer`` first, then the earliest ``position``."""
    joined = rows.join(candidates, on, "left")
    ordered = [F.when(prefer, 0).otherwise(1).asc(), F.col(position).asc_nulls_last()]
    return top_k(joined, [row_id], ordered, 1, "_rn").drop("_rn")


def reuse_keys(new: DataFrame, snapshot: DataFrame, on: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the previous snapshot already knows, and the rows still to resolve."""
    known = snapshot.select(*on, key).dropDuplicates(on)
    return new.join(known, on, "inner"), new.join(known, on, "left_anti")


def first_non_empty(*sources: DataFrame) -> DataFrame:
    """The rows of the first source that has any.

    The lowest priority present is one scalar, so lower sources are filtered and never sorted together.
    """
    tagged = [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for s in tagged[1:]:
        union = union.unionByName(s)
    best = union.agg(F.min("priority").alias("p")).scalar()
    return union.where(F.col("priority") == best)

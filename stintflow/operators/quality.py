"""Checks that return one row per finding class instead of raising."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conservation(segment_stats: DataFrame, shots: DataFrame, shifts: DataFrame) -> DataFrame:
    """Do the segments hold all attempts, all goals and the whole clock of every period?"""
    parts = segment_stats.agg(
        F.sum(F.col("home_attempts") + F.col("away_attempts")).alias("attempts"),
        F.sum(F.col("home_goals") + F.col("away_goals")).alias("goals"),
        F.sum("duration_secs").alias("clock"),
    )
    span = shifts.groupBy("game_id", "period").agg((F.max("abs_end") - F.min("abs_start")).alias("span"))
    whole_shots = shots.agg(F.count(F.lit(1)).alias("attempts"), F.sum("is_goal").alias("goals"))
    clock = span.agg(F.sum("span").alias("c")).scalar()
    names = ["attempts", "goals", "clock"]
    long = lambda df, out: df.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).cast("bigint").alias(out)) for n in names])).alias("s")
    ).select("s.*")
    return long(parts, "parts").join(long(whole_shots.withColumn("clock", clock), "whole"), "check_name")


def audit_coverage(expected: DataFrame, rows: DataFrame, key: str, low: int, high: int, nullable: list[str]) -> DataFrame:
    """Coverage of the expected keys, row bands per key, orphan keys and nulls, one row per check."""
    counts = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"null_{c}") for c in nullable]
    )
    seen = expected.select(key, F.lit(1).alias("_e")).join(counts, key, "full")
    flag = lambda cond: F.coalesce(F.sum(F.when(cond, 1)), F.lit(0)).cast("bigint")
    have, known = F.col("n").isNotNull(), F.col("_e").isNotNull()
    checks = {
        "expected_keys": flag(known),
        "missing_keys": flag(known & ~have),
        "orphan_keys": flag(have & ~known),
        "short_keys": flag(F.col("n") < low),
        "long_keys": flag(F.col("n") > high),
        **{f"null_{c}": F.coalesce(F.sum(f"null_{c}"), F.lit(0)).cast("bigint") for c in nullable},
    }
    one = seen.agg(*[e.alias(n) for n, e in checks.items()])
    return one.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("found")) for n in checks])
        ).alias("s")
    ).select("s.*")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

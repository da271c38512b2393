"""Coordinates, clocks and calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Net position on the normalised axis and seconds per period.
NET_X = 89
PERIOD_SECS = 1200


def absolute_secs(period: str, secs: str) -> Column:
    return (F.greatest(F.col(period), F.lit(1)) - 1) * PERIOD_SECS + F.col(secs)


def shot_geometry(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mirror onto one half, then distance and angle to the net; on the goal line the angle is a right one or 0."""
    flip = F.when(F.col(x) < 0, -1).otherwise(1)
    rows = df.withColumn("x_norm", F.col(x) * flip).withColumn("y_norm", F.col(y) * flip)
    depth = NET_X - F.col("x_norm")
    level = F.when(F.col("y_norm") != 0, F.pi() / 2).otherwise(F.lit(0.0))
    angle = F.when(depth == 0, level).otherwise(F.atan2(F.abs("y_norm").cast("double"), depth.cast("double")))
    return rows.withColumn("distance_from_net", F.hypot(depth.cast("double"), F.col("y_norm").cast("double"))).withColumn(
        "angle_from_center", angle
    )


def off_wing(hand: Column, y_norm: Column) -> Column:
    """1 on the off wing, 0 otherwise, null without a known hand."""
    off = ((hand == "L") & (y_norm < 0)) | ((hand == "R") & (y_norm > 0))
    return F.when(hand.isNotNull(), F.when(off, 1.0).otherwise(0.0))


def age_at(born: Column, day: Column) -> Column:
    return F.floor(F.months_between(day, born) / 12)


def rfc822_to_utc(value: Column) -> Column:
    """``Mon, 1 Jan 2024 10:00:00 +0500`` to a UTC timestamp; the weekday is not needed and dropped."""
    bare = F.regexp_replace(F.regexp_replace(value, "^[A-Za-z]+,\\s*", ""), "GMT$", "+0000")
    return F.to_timestamp(bare, "d MMM yyyy HH:mm:ss Z")

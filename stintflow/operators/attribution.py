"""Handing a segment's values to the members present in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sides(segments: DataFrame, home: str, away: str, values: dict[str, tuple[str, str]], carry: list[str]) -> DataFrame:
    """Both sides of a segment as rows: own member array and side-aware values, from one pass."""
    side = lambda ids, pick, name: F.struct(
        F.lit(name).alias("side"),
        F.col(ids).alias("ids"),
        *[F.col(pair[pick]).alias(out) for out, pair in values.items()],
    )
    both = F.explode(F.array(side(home, 0, "home"), side(away, 1, "away"))).alias("_s")
    return segments.select(*carry, both).select(*carry, "_s.*")


def attribute_to_members(
    segments: DataFrame, home: str, away: str, values: dict[str, tuple[str, str]]
) -> DataFrame:
    """Sum values per member; ``values`` maps an output to its (home side, away side) source columns."""
    rows = _sides(segments, home, away, values, [])
    members = rows.withColumn("player_id", F.explode("ids"))
    return members.groupBy("player_id").agg(*[F.sum(v).cast("bigint").alias(v) for v in values])


def stint_quality(segments: DataFrame, ratings: DataFrame, home: str, away: str, secs: str) -> DataFrame:
    """Time-weighted mean rating of team mates (self left out) and opponents per member.

    Ratings join on exploded members, side sums come back by segment key, so no member pairs form.
    """
    keys = ["game_id", "period", "start_secs"]
    rows = _sides(segments, home, away, {"secs": (secs, secs)}, keys)
    members = rows.withColumn("player_id", F.explode("ids")).drop("ids").join(ratings, "player_id")
    sides = members.groupBy(*keys, "side").agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("n"))
    flip = F.when(F.col("side") == "home", "away").otherwise("home")
    other = sides.select(*keys, flip.alias("side"), F.col("s").alias("os"), F.col("n").alias("on"))
    facing = members.join(sides, [*keys, "side"]).join(other, [*keys, "side"]).where("n > 1")
    mate = (F.col("s") - F.col("rating")) / (F.col("n") - 1)
    return facing.groupBy("player_id").agg(
        (F.sum(F.col("secs") * mate) / F.sum("secs")).alias("qot"),
        (F.sum(F.col("secs") * (F.col("os") / F.col("on"))) / F.sum("secs")).alias("qoc"),
    )


def group_time(
    segments: DataFrame, home: str, away: str, secs: str, belongs: Callable[[Column], Column], size: int
) -> DataFrame:
    """Time each exact group of ``size`` qualifying members spent together on one side."""
    rows = _sides(segments, home, away, {"secs": (secs, secs)}, [])
    groups = rows.withColumn("group", F.array_sort(F.filter("ids", belongs))).where(F.size("group") == size)
    return groups.groupBy("group").agg(F.sum("secs").alias("secs"), F.count(F.lit(1)).alias("n_segments"))


def for_against(rows: DataFrame, own: str, opp: str, value: str) -> DataFrame:
    """Totals for and against each team from one event table, each event read once."""
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(own).alias("team"), F.col(value).alias("f"), zero.alias("a")),
        F.struct(F.col(opp).alias("team"), zero.alias("f"), F.col(value).alias("a")),
    )
    return (
        rows.select(F.explode(sides).alias("s"))
        .groupBy("s.team")
        .agg(F.sum("s.f").alias("total_for"), F.sum("s.a").alias("total_against"))
    )

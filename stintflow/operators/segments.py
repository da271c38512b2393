"""Maximal segments with a constant active set, what happened inside them, and who was active at a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintflow.operators.intervals import (
    CHUNK,
    bin_of,
    drop_contained,
    elementary_segments,
    points_in_intervals,
)
from stintflow.scale import Running, running


def _coded(side: Column, goalie: Column) -> Column:
    """Distinct members of a side in one set, the goalie flag as the lowest bit of the code."""
    return F.collect_set(F.when(side, F.col("player_id") * 2 + goalie.cast("bigint")))


def _skaters(coded: str) -> Column:
    return F.sort_array(F.transform(F.filter(coded, lambda c: c % 2 == 0), lambda c: F.shiftright(c, 1)))


def _n_goalies(coded: str) -> Column:
    return F.size(F.filter(coded, lambda c: c % 2 != 0))


def _goalie(side: Column, goalie: Column) -> Column:
    """The present goalie with the longest interval; equal lengths go to the lowest id."""
    rank = F.struct(F.col("ivl_end") - F.col("ivl_start"), -F.col("player_id"))
    return F.max_by(F.col("player_id"), F.when(side & goalie, rank))


def present_on_segments(shifts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One row per elementary segment with sorted member arrays and resolved goalies per side; gaps stay."""
    lean = drop_contained(
        shifts.select(*keys, "player_id", "team_id", "home_team_id", "is_goalie", "abs_start", "abs_end"),
        [*keys, "player_id", "team_id", "home_team_id", "is_goalie"],
        "abs_start",
        "abs_end",
    )
    segments = elementary_segments(shifts, keys, "abs_start", "abs_end")
    spans = lean.withColumnRenamed("abs_start", "ivl_start").withColumnRenamed("abs_end", "ivl_end")
    # boundaries are elementary, so covering t0 means covering the whole segment
    rows = points_in_intervals(segments, spans, keys, "t0", "ivl_start", "ivl_end", "left", width, "left")
    home = F.col("team_id") == F.col("home_team_id")
    away = F.col("team_id") != F.col("home_team_id")
    g = F.col("is_goalie")
    sides = rows.groupBy(*keys, "t0", "t1").agg(
        _coded(home, g).alias("_home"),
        _coded(away, g).alias("_away"),
        _goalie(home, g).alias("home_goalie"),
        _goalie(away, g).alias("away_goalie"),
    )
    return sides.select(
        *keys,
        "t0",
        "t1",
        _skaters("_home").alias("home_ids"),
        _skaters("_away").alias("away_ids"),
        "home_goalie",
        "away_goalie",
        ((_n_goalies("_home") > 1) | (_n_goalies("_away") > 1)).alias("two_goalies"),
        ((F.size("_home") == 0) & (F.size("_away") == 0)).alias("empty_side"),
    )


def constant_set_segments(shifts: DataFrame, keys: list[str] = ["game_id", "period"], width: int = 3600) -> DataFrame:
    """Segments with the same skaters and goalies throughout; equal neighbours merge and their flags combine.

    The island windows see distinct boundaries only, so a key's window is bounded by its clock.
    """
    parts = present_on_segments(shifts, keys, width)
    order = Window.partitionBy(*keys).orderBy("t0")
    state = F.struct("home_ids", "away_ids", "home_goalie", "away_goalie")
    prev = F.lag(state).over(order)
    changed = F.when(prev.isNull() | ~prev.eqNullSafe(state), 1).otherwise(0)
    islands = parts.withColumn("_new", changed).withColumn("_island", F.sum("_new").over(order))
    merged = islands.groupBy(*keys, "_island").agg(
        F.min("t0").alias("start_secs"),
        F.max("t1").alias("end_secs"),
        *[F.first(c).alias(c) for c in ("home_ids", "away_ids", "home_goalie", "away_goalie")],
        F.max("two_goalies").alias("flag_two_goalies"),
        F.max("empty_side").alias("flag_empty_side"),
    )
    return merged.select(
        *keys,
        "start_secs",
        "end_secs",
        (F.col("end_secs") - F.col("start_secs")).alias("duration_secs"),
        F.size("home_ids").alias("home_skaters"),
        F.size("away_ids").alias("away_skaters"),
        "home_ids",
        "away_ids",
        "home_goalie",
        "away_goalie",
        F.col("home_goalie").isNull().alias("home_empty_net"),
        F.col("away_goalie").isNull().alias("away_empty_net"),
        "flag_two_goalies",
        "flag_empty_side",
    )


def window_segments(
    shifts: DataFrame, keep: Column, min_secs: int = 10, keys: list[str] = ["game_id"], width: int = 3600
) -> DataFrame:
    """Unmerged boundary windows of at least ``min_secs`` whose state passes ``keep``."""
    parts = present_on_segments(shifts, keys, width)
    return parts.where((F.col("t1") - F.col("t0") >= min_secs) & keep)


def attach_point_stats(
    segments: DataFrame,
    points: DataFrame,
    keys: list[str],
    sums: dict[str, Column],
    t: str = "abs_secs",
    closed: str = "right",
    width: int = 3600,
) -> DataFrame:
    """Sum point expressions into the segment that holds each point; segments without points get zeros."""
    spans = segments.select(*keys, "start_secs", "end_secs")
    hits = points_in_intervals(points, spans, keys, t, "start_secs", "end_secs", closed, width)
    stats = hits.groupBy(*keys, "start_secs").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    filled = [F.coalesce(n, F.lit(0)).alias(n) for n in sums]
    return segments.join(stats, [*keys, "start_secs"], "left").select(*segments.columns, *filled)


def segment_of_point(
    points: DataFrame, segments: DataFrame, keys: list[str], t: str, width: int = 3600, closed: str = "right"
) -> DataFrame:
    """Each point with its segment's bounds, null when no segment holds it."""
    spans = segments.select(*keys, "start_secs", "end_secs")
    return points_in_intervals(points, spans, keys, t, "start_secs", "end_secs", closed, width, "left")


def score_diff_at_start(
    segments: DataFrame, goals: DataFrame, keys: list[str], t: str = "abs_secs", width: int = CHUNK
) -> DataFrame:
    """Home lead when each segment starts; a goal in the starting second has already counted.

    ``goals`` carries ``delta`` (+1 home, -1 away). Goals and starts become one ordered stream and a
    running sum, so nothing is compared pairwise.
    """
    steps = goals.groupBy(*keys, t).agg(F.sum("delta").alias("delta")).select(
        *keys, F.col(t).alias("t"), F.lit(0).alias("kind"), "delta"
    )
    marks = segments.select(
        *keys, F.col("start_secs").alias("t"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("delta")
    ).distinct()
    stream = steps.unionByName(marks)
    scored = running(
        stream,
        keys,
        bin_of(F.col("t"), width),
        ["t", "kind"],
        {"score_diff": Running("sum", F.col("delta"), inclusive=True)},
    )
    at = scored.where(F.col("kind") == 1).select(*keys, F.col("t").alias("start_secs"), "score_diff")
    return segments.join(at, [*keys, "start_secs"], "left")


def onset_at(points: DataFrame, shifts: DataFrame, width: int = 3600) -> DataFrame:
    """Who was active, per side, at every point (``start < t <= end``).

    ``points`` has ``shot_id, game_id, abs_secs, shooter_id``. A shooter without any interval in the game
    keeps the default row with only ``flag_shooter_absent`` set; a game without intervals sets no flag.
    """
    keys = ["game_id"]
    lean = drop_contained(
        shifts.select("game_id", "player_id", "team_id", "is_goalie", "abs_start", "abs_end"),
        ["game_id", "player_id", "team_id", "is_goalie"],
        "abs_start",
        "abs_end",
    ).select(
        "game_id",
        "player_id",
        "team_id",
        "is_goalie",
        F.col("abs_start").alias("ivl_start"),
        F.col("abs_end").alias("ivl_end"),
    )
    team_of = shifts.groupBy("game_id", F.col("player_id").alias("shooter_id")).agg(F.max("team_id").alias("for_team"))
    game_teams = shifts.groupBy("game_id").agg(F.array_sort(F.collect_set("team_id")).alias("_teams"))
    edges = (
        shifts.select("game_id", F.explode(F.array("abs_start", "abs_end")).alias("abs_secs"))
        .distinct()
        .withColumn("flag_boundary", F.lit(True))
    )
    base = (
        points.select("shot_id", "game_id", "abs_secs", "shooter_id")
        .join(team_of, ["game_id", "shooter_id"], "left")
        .join(game_teams, "game_id", "left")
        .join(edges, ["game_id", "abs_secs"], "left")
        .withColumn("against_team", F.get(F.expr("filter(_teams, x -> x != for_team)"), F.lit(0)))
        .withColumn("_has_game", F.col("_teams").isNotNull())
        .drop("_teams")
    )
    hits = points_in_intervals(base, lean, keys, "abs_secs", "ivl_start", "ivl_end", "right", width, "left")
    mine = F.col("team_id") == F.col("for_team")
    theirs = F.col("team_id") == F.col("against_team")
    g = F.col("is_goalie")
    sides = hits.groupBy(*base.columns).agg(
        _coded(mine, g).alias("_for"),
        _coded(theirs, g).alias("_against"),
        _goalie(mine, g).alias("goalie_for"),
        _goalie(theirs, g).alias("goalie_against"),
    )
    shooter = F.col("shooter_id") * 2
    agg = sides.select(
        *base.columns,
        _skaters("_for").alias("on_for"),
        _skaters("_against").alias("on_against"),
        "goalie_for",
        "goalie_against",
        _n_goalies("_against").alias("_n_goalies"),
        F.size("_for").alias("_n_for"),
        F.size("_against").alias("_n_against"),
        (F.array_contains("_for", shooter) | F.array_contains("_for", shooter + 1)).cast("int").alias("_n_shooter"),
    )
    known = F.col("for_team").isNotNull()
    when_known = lambda cond: F.when(known, cond).otherwise(F.lit(False))
    size_for, size_against = F.size("on_for"), F.size("on_against")
    return agg.select(
        "shot_id",
        "game_id",
        "abs_secs",
        "shooter_id",
        "for_team",
        "against_team",
        F.when(known, size_for).otherwise(0).alias("skaters_for"),
        F.when(known, size_against).otherwise(0).alias("skaters_against"),
        F.when(known, F.col("on_for")).alias("on_for"),
        F.when(known, F.col("on_against")).alias("on_against"),
        "goalie_for",
        "goalie_against",
        when_known(F.col("goalie_for").isNull()).alias("empty_net_for"),
        when_known(F.col("goalie_against").isNull()).alias("empty_net_against"),
        F.coalesce("flag_boundary", F.lit(False)).alias("flag_boundary"),
        when_known(F.col("_n_for") == 0).alias("flag_none_for"),
        when_known(F.col("_n_against") == 0).alias("flag_none_against"),
        when_known(F.col("_n_goalies") > 1).alias("flag_two_goalies"),
        F.when(known, F.col("_n_shooter") == 0).otherwise(F.col("_has_game")).alias("flag_shooter_absent"),
        when_known((size_for > 6) | (size_against > 6)).alias("flag_over_six"),
    )

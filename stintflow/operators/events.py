"""Per-event features from an ordered play list, and the model-ready shot table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.functions.geometry import PERIOD_SECS, off_wing, shot_geometry
from stintflow.operators.intervals import bin_of
from stintflow.operators.tables import map_with_default
from stintflow.scale import Running, running

# Shot classes, shot type ids, feature limits.
SHOT_TYPES = ("goal", "shot-on-goal", "missed-shot")
ON_NET_TYPES = ("goal", "shot-on-goal")
SHOT_TYPE_IDS = {
    "wrist": 1, "snap": 2, "slap": 3, "backhand": 4, "tip-in": 5, "deflected": 6, "wrap-around": 7, "poke": 8,
    "bat": 9, "cradle": 10, "between-legs": 11,
}
RUSH_SECS, REBOUND_SECS, MAX_SINCE_SHOT, MAX_LEAD = 4, 3, 600, 3


def opposing_net_empty(code: Column, is_home: Column) -> Column:
    """The other side's goalie digit is 0; codes of another length say nothing."""
    goalie = F.when(is_home, F.substring(code, 1, 1)).otherwise(F.substring(code, 4, 1))
    return F.coalesce((F.length(code) == 4) & (goalie == "0"), F.lit(False))


def sequential_shot_features(plays: DataFrame, order: list[str], chunk_secs: int = 300) -> DataFrame:
    """Rush, rebound, time since the last shot, score state and geometry of every counted shot.

    ``plays`` has ``game_id, abs_secs, period, type, team_id, home_team_id, zone, situation_code, x, y,
    shot_type, shooter_id`` and the ``order`` columns, which start with ``abs_secs``. Shots without a
    team, at an empty net or without coordinates give no row; they still are the previous event, and
    (without a team only if on net) the previous shot. The score moves on counted goals alone.
    """
    is_shot = F.col("type").isin(*SHOT_TYPES)
    has_team = F.col("team_id").isNotNull()
    is_home = F.coalesce(F.col("team_id") == F.col("home_team_id"), F.lit(False))
    counted = (
        is_shot
        & has_team
        & ~opposing_net_empty(F.col("situation_code"), is_home)
        & F.col("x").isNotNull()
        & F.col("y").isNotNull()
    )
    marks_shot = is_shot & (has_team | F.col("type").isin(*ON_NET_TYPES))
    step = F.when(counted & (F.col("type") == "goal"), F.when(is_home, 1).otherwise(-1)).otherwise(0)
    state = running(
        plays.withColumn("counted", counted).withColumn("is_home", is_home),
        ["game_id"],
        bin_of(F.col("abs_secs"), chunk_secs),
        order,
        {
            "prev": Running("last", F.struct("abs_secs", "zone", "type", "team_id")),
            "last_shot": Running("last", F.when(marks_shot, F.col("abs_secs"))),
            "lead": Running("sum", step),
        },
    ).where("counted")
    gap = F.col("abs_secs") - F.col("prev.abs_secs")
    same_team = F.col("prev.team_id").eqNullSafe(F.col("team_id"))
    flipped = map_with_default(F.col("prev.zone"), {"O": "D", "D": "O", "N": "N"}, None)
    zone = F.when(same_team, F.col("prev.zone")).otherwise(F.coalesce(flipped, F.col("prev.zone")))
    bit = lambda cond: F.coalesce(cond, F.lit(False)).cast("bigint")
    lead = F.coalesce("lead", F.lit(0))
    own_lead = F.when(F.col("is_home"), lead).otherwise(-lead)
    since = F.coalesce(F.col("abs_secs") - F.col("last_shot"), F.lit(9999))
    return shot_geometry(state, "x", "y").select(
        *[c for c in ("event_id",) if c in plays.columns],
        "game_id",
        "abs_secs",
        "period",
        "x_norm",
        "y_norm",
        "distance_from_net",
        "angle_from_center",
        map_with_default(F.lower("shot_type"), SHOT_TYPE_IDS, 0).alias("shot_type_id"),
        bit((gap <= RUSH_SECS) & zone.isin("N", "D")).alias("is_rush"),
        bit((gap <= REBOUND_SECS) & F.col("prev.type").isin(*SHOT_TYPES) & same_team).alias("is_rebound"),
        F.least(F.lit(MAX_SINCE_SHOT), since).alias("time_since_last_shot"),
        F.greatest(F.lit(-MAX_LEAD), F.least(F.lit(MAX_LEAD), own_lead)).cast("bigint").alias("score_state"),
        F.col("is_home").cast("bigint").alias("is_home"),
        (F.col("type") == "goal").cast("bigint").alias("is_goal"),
        F.col("type").isin(*ON_NET_TYPES).cast("bigint").alias("on_goal"),
        F.coalesce("shooter_id", F.lit(0)).alias("shooter_id"),
    )


def shot_model_table(shots: DataFrame, hands: DataFrame, dates: DataFrame) -> DataFrame:
    """Impute unknown shot types with the most frequent one, add hand, off-wing, date and drop reason.

    ``shots`` carries ``skaters_for`` and ``skaters_against``; ``hands`` is ``player_id, shoots``,
    ``dates`` is ``game_id, game_date``.
    """
    from stintflow.functions.classify import drop_reason

    known = shots.where("shot_type_id <> 0").groupBy("shot_type_id").agg(F.count(F.lit(1)).alias("n"))
    mode = known.agg(F.max_by("shot_type_id", F.struct(F.col("n"), -F.col("shot_type_id"))).alias("m")).scalar()
    rows = shots.withColumn("_mode", mode)
    rows = rows.join(hands.withColumnRenamed("player_id", "shooter_id"), "shooter_id", "left")
    rows = rows.join(dates, "game_id", "left")
    unknown = F.col("shot_type_id") == 0
    return rows.select(
        *[c for c in shots.columns if c != "shot_type_id"],
        F.when(unknown, F.col("_mode")).otherwise(F.col("shot_type_id")).alias("shot_type_id"),
        unknown.alias("shot_type_imputed"),
        off_wing(F.col("shoots"), F.col("y_norm")).alias("off_wing"),
        F.abs("y_norm").alias("abs_y_norm"),
        (F.col("abs_secs") - (F.col("period") - 1) * PERIOD_SECS).alias("time_in_period"),
        "game_date",
        drop_reason("skaters_for", "skaters_against").alias("train_drop_reason"),
    )

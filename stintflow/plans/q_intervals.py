"""Interval joins, segments and everything read off them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintflow.operators import attribution, intervals, segments
from stintflow.plans.bindings import cte
from stintflow.plans.registry import query
from stintflow.plans.shape import big, div, joined, r
from stintflow.scale import Running, running
from stintflow.session import cut_lineage

SEG_KEYS = ["game_id", "period"]

ELEM = """SELECT * FROM (
  SELECT *, lead(t0) OVER (PARTITION BY game_id, period ORDER BY t0) AS t1 FROM (
    SELECT game_id, period, abs_start AS t0 FROM shifts UNION SELECT game_id, period, abs_end FROM shifts))
  WHERE t1 IS NOT NULL"""

PRES = """
SELECT e.game_id, e.period, e.t0, e.t1,
  coalesce(array_to_string(list_sort(list(DISTINCT s.player_id) FILTER (s.team_id = s.home_team_id AND NOT s.is_goalie)), ','), '') AS home_ids,
  coalesce(array_to_string(list_sort(list(DISTINCT s.player_id) FILTER (s.team_id <> s.home_team_id AND NOT s.is_goalie)), ','), '') AS away_ids,
  count(DISTINCT s.player_id) FILTER (s.team_id = s.home_team_id AND NOT s.is_goalie) AS home_skaters,
  count(DISTINCT s.player_id) FILTER (s.team_id <> s.home_team_id AND NOT s.is_goalie) AS away_skaters,
  arg_max(s.player_id, s.dur * 1000000000 - s.player_id) FILTER (s.team_id = s.home_team_id AND s.is_goalie) AS home_goalie,
  arg_max(s.player_id, s.dur * 1000000000 - s.player_id) FILTER (s.team_id <> s.home_team_id AND s.is_goalie) AS away_goalie,
  (count(DISTINCT s.player_id) FILTER (s.team_id = s.home_team_id AND s.is_goalie) > 1
    OR count(DISTINCT s.player_id) FILTER (s.team_id <> s.home_team_id AND s.is_goalie) > 1) AS two_goalies,
  count(s.player_id) = 0 AS empty_side
FROM elem e LEFT JOIN shifts_flagged s
  ON s.game_id = e.game_id AND s.period = e.period AND s.abs_start <= e.t0 AND s.abs_end >= e.t1
GROUP BY 1, 2, 3, 4"""

STINTS = """
SELECT game_id, period, min(t0) AS start_secs, max(t1) AS end_secs, max(t1) - min(t0) AS duration_secs,
  any_value(home_skaters) AS home_skaters, any_value(away_skaters) AS away_skaters,
  any_value(home_ids) AS home_ids, any_value(away_ids) AS away_ids,
  any_value(home_goalie) AS home_goalie, any_value(away_goalie) AS away_goalie,
  any_value(home_goalie) IS NULL AS home_empty_net, any_value(away_goalie) IS NULL AS away_empty_net,
  bool_or(two_goalies) AS flag_two_goalies, bool_or(empty_side) AS flag_empty_side
FROM (
  SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM state THEN 0 ELSE 1 END)
    OVER (PARTITION BY game_id, period ORDER BY t0) AS island FROM (
    SELECT *, lag(state) OVER (PARTITION BY game_id, period ORDER BY t0) AS prev FROM (
      SELECT *, home_ids || '|' || away_ids || '|' || coalesce(home_goalie, -1) || '|' || coalesce(away_goalie, -1) AS state
      FROM pres)))
GROUP BY game_id, period, island"""


def stint_cte(**extra: str) -> str:
    return cte("shifts_flagged", "shots", elem=ELEM, pres=PRES, stints=STINTS, **extra)


def stints(t):
    return segments.constant_set_segments(t.shifts_flagged, SEG_KEYS)


def stint_table(t):
    """The segments materialised once: what follows reads them several times."""
    return cut_lineage(stints(t))


def attempt_sums():
    home = F.col("team_id") == F.col("home_team_id")
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return {
        "home_attempts": F.when(home, one).otherwise(zero),
        "away_attempts": F.when(home, zero).otherwise(one),
        "home_goals": F.when(home, F.col("is_goal")).otherwise(zero),
        "away_goals": F.when(home, zero).otherwise(F.col("is_goal")),
        "home_xg_c": F.when(home, F.col("xg_c")).otherwise(zero),
        "away_xg_c": F.when(home, zero).otherwise(F.col("xg_c")),
    }


STINT_STATS = """
SELECT s.*, coalesce(home_attempts, 0) AS home_attempts, coalesce(away_attempts, 0) AS away_attempts,
  coalesce(home_goals, 0) AS home_goals, coalesce(away_goals, 0) AS away_goals,
  coalesce(home_xg_c, 0) AS home_xg_c, coalesce(away_xg_c, 0) AS away_xg_c
FROM stints s LEFT JOIN (
  SELECT s.game_id, s.period, s.start_secs,
    count(*) FILTER (p.team_id = p.home_team_id) AS home_attempts,
    count(*) FILTER (p.team_id <> p.home_team_id) AS away_attempts,
    CAST(sum(CASE WHEN p.team_id = p.home_team_id THEN is_goal ELSE 0 END) AS BIGINT) AS home_goals,
    CAST(sum(CASE WHEN p.team_id <> p.home_team_id THEN is_goal ELSE 0 END) AS BIGINT) AS away_goals,
    CAST(sum(CASE WHEN p.team_id = p.home_team_id THEN xg_c ELSE 0 END) AS BIGINT) AS home_xg_c,
    CAST(sum(CASE WHEN p.team_id <> p.home_team_id THEN xg_c ELSE 0 END) AS BIGINT) AS away_xg_c
  FROM stints s JOIN shots p ON p.game_id = s.game_id AND p.period = s.period
    AND s.start_secs < p.abs_secs AND p.abs_secs <= s.end_secs
  GROUP BY 1, 2, 3) a USING (game_id, period, start_secs)"""


def stint_stats(t):
    return segments.attach_point_stats(stint_table(t), t.shots, SEG_KEYS, attempt_sums())


@query(
    "j6_point_in_interval_join",
    cte("shifts", "shots")
    + """SELECT shot_id, count(*) AS n_intervals, count(DISTINCT player_id) AS n_members, CAST(sum(dur) AS BIGINT) AS dur
FROM shots p JOIN shifts i ON p.game_id = i.game_id AND i.abs_start < p.abs_secs AND p.abs_secs <= i.abs_end
GROUP BY 1""",
)
def j6(t):
    pts = t.shots.select("shot_id", "game_id", "abs_secs")
    ivs = t.shifts.select("game_id", "player_id", "abs_start", "abs_end", "dur")
    rows = intervals.points_in_intervals(pts, ivs, ["game_id"], "abs_secs", "abs_start", "abs_end", "right", 3600)
    return rows.groupBy("shot_id").agg(
        F.count(F.lit(1)).alias("n_intervals"),
        F.countDistinct("player_id").alias("n_members"),
        F.sum("dur").alias("dur"),
    )


@query(
    "j7_closed_interval_opponents",
    cte("shifts", "shots")
    + """SELECT i.player_id, count(*) AS shots_against, CAST(sum(is_goal) AS BIGINT) AS goals_against,
  CAST(sum(xg_c) AS BIGINT) AS xga_c
FROM shots p JOIN shifts i ON p.game_id = i.game_id AND i.abs_start <= p.abs_secs AND p.abs_secs <= i.abs_end
  AND p.team_id <> i.team_id GROUP BY 1""",
)
def j7(t):
    pts = t.shots.select("game_id", "abs_secs", "is_goal", "xg_c", F.col("team_id").alias("shot_team"))
    ivs = t.shifts.select("game_id", "player_id", "team_id", "abs_start", "abs_end")
    rows = intervals.points_in_intervals(pts, ivs, ["game_id"], "abs_secs", "abs_start", "abs_end", "both", 3600)
    return (
        rows.where(F.col("shot_team") != F.col("team_id"))
        .groupBy("player_id")
        .agg(
            F.count(F.lit(1)).alias("shots_against"),
            F.sum("is_goal").alias("goals_against"),
            F.sum("xg_c").alias("xga_c"),
        )
    )


@query(
    "j8_single_segment_lookup",
    stint_cte()
    + """SELECT p.shot_id, p.game_id, s.start_secs, s.end_secs, s.start_secs IS NULL AS unmatched
FROM shots p LEFT JOIN stints s ON p.game_id = s.game_id AND p.period = s.period
  AND s.start_secs < p.abs_secs AND p.abs_secs <= s.end_secs""",
)
def j8(t):
    pts = t.shots.select("shot_id", "game_id", "period", "abs_secs")
    found = segments.segment_of_point(pts, stints(t), SEG_KEYS, "abs_secs")
    return found.select(
        "shot_id", "game_id", "start_secs", "end_secs", F.col("start_secs").isNull().alias("unmatched")
    )


@query(
    "j9_overlap_pair_seconds",
    cte("shifts")
    + """SELECT a.player_id AS focal, b.player_id AS partner, a.team_id = b.team_id AS same_side,
  CAST(sum(least(a.abs_end, b.abs_end) - greatest(a.abs_start, b.abs_start)) AS BIGINT) AS shared_secs
FROM shifts a JOIN shifts b ON a.game_id = b.game_id AND a.player_id <> b.player_id
  AND a.abs_start < b.abs_end AND b.abs_start < a.abs_end GROUP BY 1, 2, 3""",
)
def j9(t):
    rows = intervals.overlap_pair_seconds(t.shifts, ["game_id"], "player_id", "team_id", "abs_start", "abs_end")
    return rows.select("focal", "partner", "same_side", big("shared_secs"))


@query(
    "j10_nearest_within_tolerance",
    cte(
        "plays",
        goals="SELECT event_id, game_id, abs_secs, n FROM plays, range(1 + event_id % 2) r(n) WHERE event_type = 'purchase'",
        others="SELECT game_id, abs_secs AS other_secs, event_id AS other_id FROM plays WHERE event_type = 'click'",
    )
    + """SELECT g.event_id, g.abs_secs, o.other_secs, o.other_id FROM goals g LEFT JOIN others o
  ON g.game_id = o.game_id AND abs(g.abs_secs - o.other_secs) <= 900
QUALIFY row_number() OVER (PARTITION BY g.event_id, g.n ORDER BY abs(g.abs_secs - o.other_secs), o.other_secs, o.other_id) = 1""",
)
def j10(t):
    goals = t.plays.where("event_type = 'purchase'").select("event_id", "game_id", "abs_secs")
    goals = goals.unionByName(goals.where("event_id % 2 = 1"))  # some points come twice
    others = (
        t.plays.where("event_type = 'click'")
        .groupBy("game_id", F.col("abs_secs").alias("other_secs"))
        .agg(F.min("event_id").alias("other_id"))
    )
    rows = intervals.nearest_within(goals, others, ["game_id"], "abs_secs", "other_secs", 900)
    return rows.select("event_id", "abs_secs", "other_secs", "other_id")


@query(
    "k1_onset_at_points",
    cte(
        "shifts_flagged",
        "shots",
        team_of="SELECT game_id, player_id, max(team_id) AS for_team FROM shifts GROUP BY 1, 2",
        base="""SELECT p.*, f.for_team, (SELECT min(team_id) FROM shifts s WHERE s.game_id = p.game_id
            AND s.team_id <> f.for_team) AS against_team FROM shots p
            LEFT JOIN team_of f ON f.game_id = p.game_id AND f.player_id = p.shooter_id""",
    )
    + """SELECT p.shot_id, p.for_team, p.against_team,
  count(DISTINCT i.player_id) FILTER (i.team_id = for_team AND NOT is_goalie) AS skaters_for,
  count(DISTINCT i.player_id) FILTER (i.team_id = against_team AND NOT is_goalie) AS skaters_against,
  coalesce(array_to_string(list_sort(list(DISTINCT i.player_id) FILTER (i.team_id = for_team AND NOT is_goalie)), ','), '') AS on_for,
  coalesce(array_to_string(list_sort(list(DISTINCT i.player_id) FILTER (i.team_id = against_team AND NOT is_goalie)), ','), '') AS on_against,
  arg_max(i.player_id, i.dur * 1000000000 - i.player_id) FILTER (i.team_id = for_team AND is_goalie) AS goalie_for,
  arg_max(i.player_id, i.dur * 1000000000 - i.player_id) FILTER (i.team_id = against_team AND is_goalie) AS goalie_against,
  count(*) FILTER (i.team_id = for_team AND is_goalie) = 0 AS empty_net_for,
  count(*) FILTER (i.team_id = against_team AND is_goalie) = 0 AS empty_net_against,
  any_value((p.game_id, p.abs_secs) IN (SELECT (game_id, abs_start) FROM shifts UNION
    SELECT (game_id, abs_end) FROM shifts)) AS flag_boundary,
  count(*) FILTER (i.team_id = for_team) = 0 AS flag_none_for,
  count(*) FILTER (i.team_id = against_team) = 0 AS flag_none_against,
  count(DISTINCT i.player_id) FILTER (i.team_id = against_team AND is_goalie) > 1 AS flag_two_goalies,
  count(*) FILTER (i.team_id = for_team AND i.player_id = p.shooter_id) = 0 AS flag_shooter_absent
FROM base p LEFT JOIN shifts_flagged i ON i.game_id = p.game_id AND i.abs_start < p.abs_secs AND p.abs_secs <= i.abs_end
GROUP BY p.shot_id, p.for_team, p.against_team""",
)
def k1(t):
    rows = segments.onset_at(t.shots, t.shifts_flagged)
    return rows.select(
        "shot_id",
        "for_team",
        "against_team",
        big("skaters_for"),
        big("skaters_against"),
        joined("on_for"),
        joined("on_against"),
        "goalie_for",
        "goalie_against",
        "empty_net_for",
        "empty_net_against",
        "flag_boundary",
        "flag_none_for",
        "flag_none_against",
        "flag_two_goalies",
        "flag_shooter_absent",
    )


@query("k2_segments_constant_set", stint_cte() + "SELECT * FROM stints")
def k2(t):
    s = stints(t)
    ints = ("home_skaters", "away_skaters", "start_secs", "end_secs", "duration_secs")
    ids = ("home_ids", "away_ids")
    return s.select(*[big(c) if c in ints else joined(c) if c in ids else F.col(c) for c in s.columns])


@query(
    "k3_segments_min_length",
    cte("shifts_flagged", elem=ELEM, pres=PRES)
    + """SELECT game_id, period, t0 AS start_secs, t1 AS end_secs, home_ids, away_ids FROM pres
WHERE t1 - t0 >= 10 AND home_skaters >= 1 AND away_skaters >= 1""",
)
def k3(t):
    keep = (F.size("home_ids") >= 1) & (F.size("away_ids") >= 1)
    rows = segments.window_segments(t.shifts_flagged, keep, 10, SEG_KEYS)
    return rows.select(
        "game_id", "period", F.col("t0").alias("start_secs"), F.col("t1").alias("end_secs"), joined("home_ids"), joined("away_ids")
    )


@query(
    "k4_segment_point_stats",
    stint_cte(stats=STINT_STATS)
    + """SELECT game_id, period, start_secs, end_secs, home_attempts, away_attempts, home_goals, away_goals,
  round(home_xg_c / 50000.0::DOUBLE, 6) AS home_xg, round(away_xg_c / 50000.0::DOUBLE, 6) AS away_xg FROM stats""",
)
def k4(t):
    return stint_stats(t).select(
        "game_id",
        "period",
        "start_secs",
        "end_secs",
        "home_attempts",
        "away_attempts",
        "home_goals",
        "away_goals",
        r(F.col("home_xg_c") / 50000.0, 6, "home_xg"),
        r(F.col("away_xg_c") / 50000.0, 6, "away_xg"),
    )


def goal_deltas(t):
    lead = F.when(F.col("team_id") == F.col("home_team_id"), 1).otherwise(-1).cast("bigint")
    return t.shots.where("is_goal = 1").select("game_id", "abs_secs", lead.alias("delta"))


@query(
    "w10_score_diff_at_segment_start",
    stint_cte()
    + """SELECT s.game_id, s.period, s.start_secs, CAST(coalesce(sum(CASE WHEN p.team_id = p.home_team_id THEN 1 WHEN p.team_id IS NOT NULL THEN -1 END), 0) AS BIGINT) AS score_diff
FROM stints s LEFT JOIN shots p ON p.game_id = s.game_id AND p.is_goal = 1 AND p.abs_secs <= s.start_secs
GROUP BY 1, 2, 3""",
)
def w10(t):
    rows = segments.score_diff_at_start(stint_table(t), goal_deltas(t), ["game_id"])
    return rows.select("game_id", "period", "start_secs", "score_diff")


@query(
    "w11_prefix_sum_window",
    cte("shots", grid="SELECT DISTINCT game_id, unnest(range(0, 86400, 7200)) AS t0 FROM shots")
    + """SELECT g.game_id, CAST(g.t0 AS BIGINT) AS start_secs, count(p.shot_id) AS attempts,
  CAST(coalesce(sum(p.xg_c), 0) AS BIGINT) AS xg_c
FROM grid g LEFT JOIN shots p ON p.game_id = g.game_id AND g.t0 <= p.abs_secs AND p.abs_secs < g.t0 + 7200
GROUP BY 1, 2""",
)
def w11(t):
    grid = t.shots.select("game_id").distinct().select(
        "game_id", F.explode(F.expr("sequence(0L, 79200L, 7200L)")).alias("start_secs")
    ).withColumn("end_secs", F.col("start_secs") + 7200)
    one = F.lit(1).cast("bigint")
    rows = segments.attach_point_stats(
        grid, t.shots, ["game_id"], {"attempts": one, "xg_c": F.col("xg_c")}, closed="left"
    )
    return rows.select("game_id", "start_secs", "attempts", "xg_c")


@query(
    "w14_merge_adjacent_equal",
    cte("plays")
    + """SELECT game_id, event_type, min(event_id) AS first_event, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN prev = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY game_id ORDER BY abs_secs, event_id) AS island FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY game_id ORDER BY abs_secs, event_id) AS prev FROM plays))
GROUP BY game_id, event_type, island""",
)
def w14(t):
    order = ["abs_secs", "event_id"]
    chunk = intervals.bin_of(F.col("abs_secs"), 300)
    rows = t.plays.select("game_id", "event_id", "abs_secs", "event_type")
    seen = running(rows, ["game_id"], chunk, order, {"prev": Running("last", F.col("event_type"))})
    fresh = F.when(F.col("prev") == F.col("event_type"), 0).otherwise(1)
    tagged = running(seen, ["game_id"], chunk, order, {"island": Running("sum", fresh, inclusive=True)})
    return tagged.groupBy("game_id", "event_type", "island").agg(
        F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n")
    ).drop("island")


@query(
    "w15_next_boundary",
    cte("shifts", elem=ELEM) + "SELECT game_id, period, t0, t1, t1 - t0 AS secs FROM elem",
)
def w15(t):
    rows = intervals.elementary_segments(t.shifts, SEG_KEYS, "abs_start", "abs_end")
    return rows.select("game_id", "period", "t0", "t1", (F.col("t1") - F.col("t0")).alias("secs"))


@query(
    "w16_running_max_end",
    cte("shifts")
    + """SELECT shift_id, max(abs_end) OVER (PARTITION BY game_id, player_id ORDER BY abs_start, shift_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max_end FROM shifts""",
)
def w16(t):
    rows = running(
        t.shifts,
        ["game_id", "player_id"],
        intervals.bin_of(F.col("abs_start"), 300),
        ["abs_start", "shift_id"],
        {"prev_max_end": Running("max", F.col("abs_end"))},
    )
    return rows.select("shift_id", "prev_max_end")


@query(
    "a28_union_interval_time",
    cte("shifts")
    + """SELECT game_id, player_id, CAST(sum(greatest(0, abs_end - greatest(abs_start, coalesce(m, abs_start)))) AS BIGINT) AS union_secs FROM (
  SELECT *, max(abs_end) OVER (PARTITION BY game_id, player_id ORDER BY abs_start, abs_end
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM shifts)
GROUP BY 1, 2""",
)
def a28(t):
    return intervals.union_time(t.shifts, ["game_id", "player_id"], "abs_start", "abs_end")


@query(
    "a10_mean_threshold_members",
    cte("goalies", "shifts") + "SELECT player_id FROM goalies",
)
def a10(t):
    return t.goalies


@query(
    "k5_self_overlap_rows",
    cte("shifts")
    + """SELECT a.game_id, count(DISTINCT a.shift_id) AS self_overlap_rows FROM shifts a JOIN shifts b
  ON a.game_id = b.game_id AND a.player_id = b.player_id AND a.shift_id <> b.shift_id
  AND a.abs_start < b.abs_end AND b.abs_start < a.abs_end GROUP BY 1""",
)
def k5(t):
    rows = intervals.self_overlap_rows(t.shifts, ["game_id", "player_id"], "abs_start", "abs_end", "shift_id")
    return rows.groupBy("game_id").agg(F.count(F.lit(1)).alias("self_overlap_rows"))


ONICE = """
SELECT player_id, CAST(sum(duration_secs) AS BIGINT) AS toi_secs, CAST(sum(xf) AS BIGINT) AS xgf_c, CAST(sum(xa) AS BIGINT) AS xga_c,
  CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca FROM (
  SELECT CAST(unnest(string_split(home_ids, ',')) AS BIGINT) AS player_id, duration_secs, home_xg_c AS xf, away_xg_c AS xa,
    home_attempts AS cf, away_attempts AS ca FROM stats WHERE home_ids <> ''
  UNION ALL
  SELECT CAST(unnest(string_split(away_ids, ',')) AS BIGINT), duration_secs, away_xg_c, home_xg_c, away_attempts, home_attempts
  FROM stats WHERE away_ids <> '')
GROUP BY 1"""


def on_ice(t):
    return attribution.attribute_to_members(
        stint_stats(t),
        "home_ids",
        "away_ids",
        {
            "toi_secs": ("duration_secs", "duration_secs"),
            "xgf_c": ("home_xg_c", "away_xg_c"),
            "xga_c": ("away_xg_c", "home_xg_c"),
            "cf": ("home_attempts", "away_attempts"),
            "ca": ("away_attempts", "home_attempts"),
        },
    )


@query("a5_attributed_value_per_entity", stint_cte(stats=STINT_STATS, onice=ONICE) + "SELECT * FROM onice")
def a5(t):
    return on_ice(t)


@query(
    "k50_attributed_value_per_hour",
    stint_cte(stats=STINT_STATS, onice=ONICE)
    + """SELECT player_id, toi_secs, round(xgf_c / 50000e0 / (toi_secs / 3600e0), 6) AS xgf_60,
  round(xga_c / 50000e0 / (toi_secs / 3600e0), 6) AS xga_60,
  round(CASE WHEN xgf_c + xga_c > 0 THEN 100e0 * xgf_c / (xgf_c + xga_c) END, 6) AS xgf_pct
FROM onice WHERE toi_secs >= 3600 ORDER BY xgf_60 DESC, player_id LIMIT 25""",
)
def k50a(t):
    hours = F.col("toi_secs") / 3600.0
    xf, xa = F.col("xgf_c"), F.col("xga_c")
    return (
        on_ice(t)
        .where("toi_secs >= 3600")
        .select(
            "player_id",
            "toi_secs",
            r(xf / 50000.0 / hours, 6, "xgf_60"),
            r(xa / 50000.0 / hours, 6, "xga_60"),
            r(F.when(xf + xa > 0, F.lit(100.0) * xf / (xf + xa)), 6, "xgf_pct"),
        )
        .orderBy(F.desc("xgf_60"), "player_id")
        .limit(25)
    )


MEMBERS = """
SELECT game_id, period, start_secs, duration_secs, 'home' AS side,
  CAST(unnest(string_split(home_ids, ',')) AS BIGINT) AS player_id FROM stints WHERE home_ids <> ''
UNION ALL SELECT game_id, period, start_secs, duration_secs, 'away',
  CAST(unnest(string_split(away_ids, ',')) AS BIGINT) FROM stints WHERE away_ids <> ''"""


@query(
    "a13_k27_teammate_opponent_quality",
    stint_cte(
        members=MEMBERS,
        rated="SELECT *, player_id % 7 AS rating FROM members",
        sides="SELECT game_id, period, start_secs, side, CAST(sum(rating) AS BIGINT) AS s, count(*) AS n FROM rated GROUP BY 1, 2, 3, 4",
    )
    + """SELECT m.player_id, round(sum(m.duration_secs * ((a.s - m.rating) / (a.n - 1)::DOUBLE)) / sum(m.duration_secs), 6) AS qot,
  round(sum(m.duration_secs * (b.s / b.n::DOUBLE)) / sum(m.duration_secs), 6) AS qoc
FROM rated m JOIN sides a USING (game_id, period, start_secs, side)
JOIN sides b ON b.game_id = m.game_id AND b.period = m.period AND b.start_secs = m.start_secs AND b.side <> m.side
WHERE a.n > 1 GROUP BY 1""",
)
def k27(t):
    ratings = t.shifts.select("player_id").distinct().withColumn("rating", F.col("player_id") % 7)
    return attribution.stint_quality(stints(t), ratings, "home_ids", "away_ids", "duration_secs").select(
        "player_id", r("qot", 6, "qot"), r("qoc", 6, "qoc")
    )


@query(
    "k28_overlap_weighted_quality",
    cte(
        "shifts",
        pairs="""SELECT a.player_id AS focal, b.player_id AS partner, a.team_id = b.team_id AS same_side,
  CAST(sum(least(a.abs_end, b.abs_end) - greatest(a.abs_start, b.abs_start)) AS BIGINT) AS secs
FROM shifts a JOIN shifts b ON a.game_id = b.game_id AND a.player_id <> b.player_id
  AND a.abs_start < b.abs_end AND b.abs_start < a.abs_end GROUP BY 1, 2, 3""",
        rated="SELECT *, CASE WHEN partner % 9 <> 0 THEN partner % 7 END AS rating FROM pairs",
    )
    + """SELECT focal AS player_id, round(sum(CASE WHEN same_side THEN secs * rating END) / nullif(sum(CASE WHEN same_side AND rating IS NOT NULL THEN secs END), 0)::DOUBLE, 6) AS qot,
  round(sum(CASE WHEN NOT same_side THEN secs * rating END) / nullif(sum(CASE WHEN NOT same_side AND rating IS NOT NULL THEN secs END), 0)::DOUBLE, 6) AS qoc,
  CAST(coalesce(sum(CASE WHEN same_side AND rating IS NOT NULL THEN secs END), 0) AS BIGINT) AS qot_secs,
  CAST(coalesce(sum(CASE WHEN NOT same_side AND rating IS NOT NULL THEN secs END), 0) AS BIGINT) AS qoc_secs
FROM rated GROUP BY 1 HAVING qot_secs + qoc_secs > 0""",
)
def k28(t):
    players = t.shifts.select("player_id").distinct()
    ratings = players.withColumn("rating", F.when(F.col("player_id") % 9 != 0, F.col("player_id") % 7))
    rows = intervals.overlap_weighted_quality(
        t.shifts, ratings, ["game_id"], "player_id", "team_id", "abs_start", "abs_end"
    )
    return rows.where(F.col("mate_w") + F.col("opp_w") > 0).select(
        "player_id",
        r(div(F.col("mate_r").cast("double"), F.col("mate_w")), 6, "qot"),
        r(div(F.col("opp_r").cast("double"), F.col("opp_w")), 6, "qoc"),
        F.col("mate_w").cast("bigint").alias("qot_secs"),
        F.col("opp_w").cast("bigint").alias("qoc_secs"),
    )


@query(
    "k45_top_partner",
    cte(
        "shifts",
        pairs="""SELECT a.player_id AS player_id, b.player_id AS partner,
  CAST(sum(least(a.abs_end, b.abs_end) - greatest(a.abs_start, b.abs_start)) AS BIGINT) AS shared_secs
FROM shifts a JOIN shifts b ON a.game_id = b.game_id AND a.player_id <> b.player_id AND a.team_id = b.team_id
  AND a.abs_start < b.abs_end AND b.abs_start < a.abs_end GROUP BY 1, 2""",
    )
    + """SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY shared_secs DESC, partner) = 1""",
)
def k45(t):
    rows = intervals.top_partners(t.shifts, ["game_id"], "player_id", "team_id", "abs_start", "abs_end")
    return rows.select(F.col("focal").alias("player_id"), "partner", big("shared_secs"))


@query(
    "k46_group_triples",
    stint_cte(
        members=MEMBERS,
        fwd="""SELECT game_id, period, start_secs, side, any_value(duration_secs) AS secs,
  array_to_string(list_sort(list(player_id)), ',') AS trio, count(*) AS n FROM members
  WHERE player_id % 3 <> 0 GROUP BY 1, 2, 3, 4""",
    )
    + "SELECT trio, CAST(sum(secs) AS BIGINT) AS secs, count(*) AS n_segments FROM fwd WHERE n = 3 GROUP BY 1",
)
def k46(t):
    return attribution.group_time(
        stints(t), "home_ids", "away_ids", "duration_secs", lambda x: x % 3 != 0, 3
    ).select(joined("group").alias("trio"), F.col("secs").cast("bigint").alias("secs"), "n_segments")


@query(
    "k49_team_for_against",
    cte("shots")
    + """SELECT team, CAST(sum(f) AS BIGINT) AS xgf_c, CAST(sum(a) AS BIGINT) AS xga_c, round(100e0 * sum(f) / sum(f + a), 6) AS xgf_pct FROM (
  SELECT game_id % 1000 * 2 + team_id AS team, xg_c AS f, 0 AS a FROM shots UNION ALL
  SELECT game_id % 1000 * 2 + (1 - team_id), 0, xg_c FROM shots) GROUP BY 1""",
)
def k49(t):
    squad = F.col("game_id") % 1000 * 2
    rows = t.shots.select(
        (squad + F.col("team_id")).alias("own"), (squad + 1 - F.col("team_id")).alias("opp"), "xg_c"
    )
    out = attribution.for_against(rows, "own", "opp", "xg_c")
    return out.select(
        "team",
        F.col("total_for").alias("xgf_c"),
        F.col("total_against").alias("xga_c"),
        r(F.lit(100.0) * F.col("total_for") / (F.col("total_for") + F.col("total_against")), 6, "xgf_pct"),
    )

"""Ranks, running values, streaks and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.operators import modeling, ratings, reports, tables
from stintflow.operators.intervals import bin_of
from stintflow.plans.bindings import cte
from stintflow.plans.registry import query
from stintflow.plans.shape import big, r
from stintflow.scale import Running, running, top_k, with_ordinal, with_rank


@query(
    "w1_rank_first",
    cte("skater_players")
    + "SELECT player_id, row_number() OVER (PARTITION BY team, position ORDER BY icetime DESC, player_id) AS rk FROM skater_players",
)
def w1(t):
    rows = t.skater_totals("player_id", "team", "position").select("player_id", "team", "position", "icetime")
    return with_ordinal(rows, ["team", "position"], "icetime", "player_id", "rk", descending=True).select("player_id", "rk")


@query(
    "w2_rank_min_with_floor",
    """SELECT c_custkey AS player_id, CASE WHEN c_acctbal >= 0 THEN rank() OVER (PARTITION BY c_acctbal >= 0 ORDER BY c_custkey % 400 DESC) END AS rk FROM customer""",
)
def w2(t):
    rows = t.customer.select(F.col("c_custkey").alias("player_id"), (F.col("c_custkey") % 400).alias("v"), "c_acctbal")
    return ratings.rank_with_floor(rows, "v", F.col("c_acctbal") >= 0, "rk").select("player_id", "rk")


@query(
    "w3_percentile_within_group",
    """SELECT c_custkey, round((rank() OVER w + (count(*) OVER (PARTITION BY c_nationkey, c_custkey % 37) - 1) / 2e0) / count(*) OVER (PARTITION BY c_nationkey) * 100, 6) AS pct
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey % 37)""",
)
def w3(t):
    rows = t.customer.select("c_custkey", "c_nationkey", (F.col("c_custkey") % 37).alias("v"))
    return with_rank(rows, ["c_nationkey"], "v", "p", "pct").select("c_custkey", r(F.col("p") * 100, 6, "pct"))


@query(
    "w4_average_rank",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0 AS rk FROM lineitem""",
)
def w4(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_quantity")
    return with_rank(rows, [], "l_quantity", "rk", "average").select("l_orderkey", "line", "rk")


@query(
    "w5_entity_rank_per_metric",
    cte("skater_players", long="SELECT player_id, 'goals' AS metric, goals AS v FROM skater_players UNION ALL SELECT player_id, 'xg', xg_c FROM skater_players UNION ALL SELECT player_id, 'cf', cf FROM skater_players")
    + "SELECT player_id, metric, row_number() OVER (PARTITION BY metric ORDER BY v DESC, player_id) AS rk, count(*) OVER (PARTITION BY metric) AS total, v AS value FROM long",
)
def w5(t):
    rows = t.skater_totals("player_id")
    names = {"goals": "goals", "xg": "xg_c", "cf": "cf"}
    long = rows.select(
        "player_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in names.items()])).alias("s")
    ).select("player_id", "s.*")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = with_ordinal(long, ["metric"], "value", "player_id", "rk", descending=True)
    return ranked.withColumn("total", total)


@query(
    "w6_occurrence_index",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS occ FROM events",
)
def w6(t):
    rows = t.events.select("event_id", "user_id", "event_type")
    return with_ordinal(rows, ["user_id", "event_type"], None, "event_id", "n").select("event_id", (F.col("n") - 1).alias("occ"))


ORDER = ["abs_secs", "event_id"]


@query(
    "w7_lag_features",
    cte("plays")
    + """SELECT event_id, lag(event_type) OVER w AS prev_type, lag(team_id) OVER w AS prev_team, abs_secs - lag(abs_secs) OVER w AS gap
FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY abs_secs, event_id)""",
)
def w7(t):
    prev = F.struct("event_type", "team_id", "abs_secs")
    rows = running(t.plays, ["game_id"], bin_of(F.col("abs_secs"), 300), ORDER, {"p": Running("last", prev)})
    return rows.select(
        "event_id", F.col("p.event_type").alias("prev_type"), F.col("p.team_id").alias("prev_team"), (F.col("abs_secs") - F.col("p.abs_secs")).alias("gap")
    )


@query(
    "w8_time_since_last",
    cte("plays")
    + """SELECT event_id, least(600, coalesce(abs_secs - max(CASE WHEN event_type IN ('click', 'purchase') THEN abs_secs END) OVER (PARTITION BY game_id ORDER BY abs_secs, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9999)) AS since FROM plays""",
)
def w8(t):
    seen = F.when(F.col("event_type").isin("click", "purchase"), F.col("abs_secs"))
    rows = running(t.plays, ["game_id"], bin_of(F.col("abs_secs"), 300), ORDER, {"s": Running("last", seen)})
    gap = F.least(F.lit(600), F.coalesce(F.col("abs_secs") - F.col("s"), F.lit(9999)))
    return rows.select("event_id", gap.alias("since"))


@query(
    "w9_running_score",
    cte("plays")
    + """SELECT event_id, greatest(-3, least(3, CASE WHEN team_id = home_team_id THEN coalesce(d, 0) ELSE -coalesce(d, 0) END))::BIGINT AS score_state FROM (
  SELECT *, sum(CASE WHEN event_type = 'purchase' THEN CASE WHEN team_id = home_team_id THEN 1 ELSE -1 END ELSE 0 END) OVER (PARTITION BY game_id ORDER BY abs_secs, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM plays)""",
)
def w9(t):
    home = F.col("team_id") == F.col("home_team_id")
    step = F.when(F.col("event_type") == "purchase", F.when(home, 1).otherwise(-1)).otherwise(0)
    rows = running(t.plays, ["game_id"], bin_of(F.col("abs_secs"), 300), ORDER, {"d": Running("sum", step)})
    lead = F.coalesce("d", F.lit(0))
    state = F.greatest(F.lit(-3), F.least(F.lit(3), F.when(home, lead).otherwise(-lead)))
    return rows.select("event_id", state.cast("bigint").alias("score_state"))


@query(
    "w12_last_n_form",
    cte("team_games", l="SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM team_games QUALIFY rn <= 10")
    + """SELECT team, count(*) AS games, count(*) FILTER (result = 'W') AS wins, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga,
  CASE WHEN bool_or(rn = 1 AND result = 'W') THEN 'W' || CAST(coalesce(min(rn) FILTER (result <> 'W') - 1, count(*)) AS VARCHAR)
    ELSE 'L' || CAST(coalesce(min(rn) FILTER (result = 'W') - 1, count(*)) AS VARCHAR) END AS streak FROM l GROUP BY 1""",
)
def w12(t):
    return reports.last_n_form(t.team_games, 10)


@query(
    "w13_streak_current",
    cte("team_games", l="SELECT *, result = 'W' AS w, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM team_games", f="SELECT team, w AS fw FROM l WHERE rn = 1")
    + """SELECT team, CASE WHEN fw THEN 'W' ELSE 'L' END AS kind, coalesce(min(rn) FILTER (w <> fw) - 1, count(*)) AS length FROM l JOIN f USING (team) GROUP BY team, fw""",
)
def w13(t):
    return reports.current_streak(t.team_games)


@query(
    "w17_pool_zscore",
    """SELECT c_custkey, round((c_acctbal - mu) / sd, 6) AS z FROM customer JOIN (
  SELECT c_mktsegment AS g, avg(c_acctbal) AS mu, stddev_pop(c_acctbal) AS sd FROM customer WHERE c_acctbal >= 0 GROUP BY 1) ON c_mktsegment = g""",
)
def w17(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return tables.pool_zscore(rows, ["c_mktsegment"], "c_acctbal", F.col("c_acctbal") >= 0, "z").select("c_custkey", r("z", 6, "z"))


@query(
    "w18_latest_non_null",
    """SELECT o_custkey, arg_max(o_orderpriority, epoch(o_orderdate)::BIGINT * 1000000000 + o_orderkey) FILTER (o_orderstatus <> 'P') AS latest FROM orders GROUP BY 1""",
)
def w18(t):
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    at = F.when(value.isNotNull(), F.struct("o_orderdate", "o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.max_by(value, at).alias("latest"))


@query(
    "w19_cumulative_points",
    """SELECT o_orderkey, CAST(sum(pts) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS cum_points FROM (SELECT *, o_orderkey % 4 AS pts FROM orders)""",
)
def w19(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    chunk = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    out = reports.running_points(rows, "o_custkey", chunk, ["o_orderdate", "o_orderkey"], F.col("o_orderkey") % 4)
    return out.select("o_orderkey", "cum_points")


@query(
    "w20_chronological_split",
    cte("plays", g="SELECT game_id, min(event_id) AS day FROM plays GROUP BY 1")
    + "SELECT game_id, row_number() OVER (ORDER BY day, game_id) <= floor(count(*) OVER () * 0.8e0) AS is_early FROM g",
)
def w20(t):
    games = t.plays.groupBy("game_id").agg(F.min("event_id").alias("day"))
    return modeling.chronological_split(games, "game_id", "day", 0.8).select("game_id", "is_early")


SLOTS = """SELECT *, row_number() OVER (PARTITION BY team, grp ORDER BY icetime DESC, player_id) AS slot FROM (
  SELECT *, CASE WHEN position = 'D' THEN 'D' WHEN position <> 'G' THEN 'F' END AS grp FROM skater_players) WHERE grp IS NOT NULL
QUALIFY slot <= CASE WHEN grp = 'F' THEN 12 ELSE 6 END"""
MINUTES_SQL = "CASE WHEN grp = 'D' THEN [24, 24, 20, 20, 16, 16][slot] ELSE [22, 22, 22, 18, 18, 18, 14, 14, 14, 10, 10, 10][slot] END"


@query(
    "w21_depth_slots",
    cte("skater_players", s=SLOTS)
    + f"""SELECT player_id, slot, CAST({MINUTES_SQL} AS BIGINT) AS slot_minutes,
  CASE WHEN grp = 'D' THEN CASE WHEN slot <= 4 THEN 'top_d' ELSE 'bottom_d' END ELSE CASE WHEN slot <= 6 THEN 'top6_f' ELSE 'bottom6_f' END END AS unit FROM s""",
)
def w21(t):
    rows = t.skater_totals("player_id", "team", "position").select("player_id", "team", "position", "icetime")
    return ratings.depth_slots(rows, "icetime").select("player_id", big("slot"), big("slot_minutes"), "unit")


@query(
    "w22_best_in_row",
    cte("skater_players", c="SELECT position, 'goals' AS metric, player_id, goals AS v FROM skater_players UNION ALL SELECT position, 'hd', player_id, hd FROM skater_players")
    + """SELECT position, metric, player_id, v = m AS is_best, v = m AND n > 1 AS is_tie FROM c JOIN (
  SELECT position, metric, m, count(*) AS n FROM c JOIN (SELECT position, metric, max(v) AS m FROM c GROUP BY 1, 2) USING (position, metric) WHERE v = m GROUP BY 1, 2, 3) USING (position, metric)""",
)
def w22(t):
    rows = t.skater_totals("player_id", "position")
    long = rows.select(
        "player_id", "position",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("goals", "hd")])).alias("s"),
    ).select("player_id", "position", "s.*")
    counts = long.groupBy("position", "metric", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("position", "metric").agg(F.max_by(F.struct("v", "n"), "v").alias("b"))
    is_best = F.col("v") == F.col("b.v")
    return long.join(best, ["position", "metric"]).select(
        "position", "metric", "player_id", is_best.alias("is_best"), (is_best & (F.col("b.n") > 1)).alias("is_tie")
    )

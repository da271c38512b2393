"""Projections, filters and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.functions import classify
from stintflow.plans.bindings import cte
from stintflow.plans.registry import query
from stintflow.plans.shape import r

GID = "year(o_orderdate) * 1000000 + (2 + o_orderkey % 2) * 10000 + o_orderkey % 10000"


def with_gid(t):
    gid = F.year("o_orderdate") * 1000000 + (2 + F.col("o_orderkey") % 2) * 10000 + F.col("o_orderkey") % 10000
    return t.orders.select("o_orderkey", gid.cast("bigint").alias("gid"))


@query(
    "f1_id_decode",
    f"""SELECT o_orderkey, gid // 1000000 AS season, CAST(gid // 1000000 AS VARCHAR) || CAST(gid // 1000000 + 1 AS VARCHAR) AS season_str,
  (gid // 10000) % 100 AS game_type FROM (SELECT o_orderkey, CAST({GID} AS BIGINT) AS gid FROM orders)""",
)
def f1(t):
    return with_gid(t).select("o_orderkey", *classify.decode_game_id("gid"))


@query(
    "f2_conjunctive_filters",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate IS NOT NULL AND l_returnflag IN ('A', 'R') AND l_linestatus = 'F'""",
)
def f2(t):
    keep = (
        F.col("l_quantity").between(10, 20)
        & F.col("l_shipdate").isNotNull()
        & F.col("l_returnflag").isin("A", "R")
        & (F.col("l_linestatus") == "F")
    )
    return t.lineitem.where(keep).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity"
    )


@query(
    "f3_position_bucket",
    cte("contracts")
    + """SELECT 'F' AS bucket, player_id FROM contracts WHERE position IN ('C', 'L', 'R')
UNION ALL SELECT 'D', player_id FROM contracts WHERE position = 'D'
UNION ALL SELECT 'all', player_id FROM contracts""",
)
def f3(t):
    picked = F.filter(
        F.array(*[F.when(classify.in_position_bucket("position", b), F.lit(b)) for b in ("F", "D", "all")]),
        lambda b: b.isNotNull(),
    )
    return t.contracts.select(F.explode(picked).alias("bucket"), "player_id")


@query("f4_substring_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), lower('R#0000001'))")
def f4(t):
    return t.customer.where(classify.name_contains("c_name", "R#0000001")).select("c_custkey", "c_name")


@query(
    "f5_min_sample_flag",
    cte("skater_players")
    + """SELECT player_id, CASE WHEN icetime >= 900000 AND gp >= 400 THEN 'ok' ELSE 'small_sample' END AS sample_flag FROM skater_players""",
)
def f5(t):
    ok = (F.col("icetime") >= 900000) & (F.col("gp") >= 400)
    return t.skater_totals("player_id").select(
        "player_id", F.when(ok, "ok").otherwise("small_sample").alias("sample_flag")
    )


SKATERS = "SELECT event_id, 2 + k % 6 AS sf, 2 + (k // 6) % 6 AS sa FROM plays"


def with_strength(t):
    return t.plays.select("event_id", (2 + F.col("k") % 6).alias("sf"), (2 + F.expr("k div 6") % 6).alias("sa"))


@query(
    "f6_multiway_classification",
    cte("plays", s=SKATERS)
    + """SELECT event_id, CASE WHEN sf = 6 THEN 'extra_attacker' WHEN sf = 5 AND sa = 5 THEN '5v5' WHEN sf > sa THEN 'PP'
  WHEN sf < sa THEN 'PK' ELSE '3v3/4v4' END AS strength_group,
  CASE WHEN sf - sa >= 2 THEN 'lead2' WHEN sf - sa = 1 THEN 'lead1' WHEN sf - sa = 0 THEN 'tied' WHEN sf - sa = -1 THEN 'trail1' ELSE 'trail2' END AS score_bucket
FROM s""",
)
def f6(t):
    return with_strength(t).select(
        "event_id",
        classify.strength_group("sf", "sa").alias("strength_group"),
        classify.score_bucket(F.col("sf") - F.col("sa")).alias("score_bucket"),
    )


@query(
    "f7_drop_reason",
    cte("plays", s=SKATERS)
    + """SELECT event_id, CASE WHEN sf < 3 OR sf > 6 OR sa < 3 OR sa > 6 OR abs(sf - sa) > 2 OR sa = 6 THEN 'garbage_strength_state' END AS drop_reason FROM s""",
)
def f7(t):
    return with_strength(t).select("event_id", classify.drop_reason("sf", "sa").alias("drop_reason"))


CODES = "SELECT event_id, team_id = home_team_id AS is_home, CASE WHEN k % 19 = 0 THEN 'x' ELSE CAST(k % 2 AS VARCHAR) || CAST(3 + k % 3 AS VARCHAR) || CAST(3 + k % 4 AS VARCHAR) || CAST((k // 2) % 2 AS VARCHAR) END AS code FROM plays"


def with_code(t):
    k = F.col("k")
    code = F.concat(
        (k % 2).cast("string"), (3 + k % 3).cast("string"), (3 + k % 4).cast("string"), (F.expr("k div 2") % 2).cast("string")
    )
    return t.plays.select(
        "event_id",
        (F.col("team_id") == F.col("home_team_id")).alias("is_home"),
        F.when(k % 19 == 0, "x").otherwise(code).alias("code"),
    )


@query(
    "f8_situation_code_decode",
    cte("plays", c=CODES)
    + """SELECT event_id, CASE WHEN length(code) = 4 THEN CASE WHEN is_home THEN substr(code, 3, 1) || 'v' || substr(code, 2, 1)
    ELSE substr(code, 2, 1) || 'v' || substr(code, 3, 1) END END AS strength,
  CASE WHEN length(code) = 4 THEN CASE WHEN is_home THEN substr(code, 1, 1) = '0' ELSE substr(code, 4, 1) = '0' END ELSE false END AS empty_net,
  CASE WHEN length(code) = 4 THEN code = (CASE WHEN is_home THEN '1451' ELSE '1541' END) ELSE false END AS five_on_four
FROM c""",
)
def f8(t):
    return with_code(t).select("event_id", *classify.decode_situation("code", "is_home"))


@query(
    "f9_perspective_flip",
    cte("team_games")
    + """SELECT match_id, team, CASE WHEN is_home THEN gf ELSE ga END AS home_goals, CASE WHEN is_home THEN ga ELSE gf END AS away_goals,
  CASE WHEN is_home THEN team ELSE opp END AS home_team FROM team_games""",
)
def f9(t):
    flip = lambda a, b, name: classify.by_side("is_home", a, b).alias(name)
    return t.team_games.select(
        "match_id", "team", flip("gf", "ga", "home_goals"), flip("ga", "gf", "away_goals"), flip("team", "opp", "home_team")
    )


@query(
    "f10_role_projection",
    cte("plays")
    + """SELECT event_id, CASE WHEN event_type IN ('click', 'purchase', 'view') THEN player_id END AS shooter_id,
  CASE WHEN event_type = 'purchase' THEN player_id END AS scorer_id,
  CASE WHEN event_type = 'error' AND b.team_id IS DISTINCT FROM p.team_id THEN k END AS blocker_id
FROM plays p LEFT JOIN (SELECT DISTINCT player_id AS k, player_id % 2 AS team_id FROM plays) b USING (k)""",
)
def f10(t):
    roster = t.plays.select(F.col("player_id").alias("k"), F.col("team_id").alias("blocker_team")).distinct()
    kind = F.col("event_type")
    own = F.col("blocker_team").eqNullSafe(F.col("team_id"))
    return t.plays.join(roster, "k", "left").select(
        "event_id",
        F.when(kind.isin("click", "purchase", "view"), F.col("player_id")).alias("shooter_id"),
        F.when(kind == "purchase", F.col("player_id")).alias("scorer_id"),
        F.when((kind == "error") & ~own, F.col("k")).alias("blocker_id"),
    )


@query(
    "f11_clip",
    "SELECT c_custkey, greatest(-500e0, least(5000e0, c_acctbal)) AS clipped FROM customer",
)
def f11(t):
    return t.customer.select("c_custkey", classify.clip(F.col("c_acctbal"), -500.0, 5000.0).alias("clipped"))


@query(
    "f12_date_window_class",
    """SELECT o_orderkey, CASE WHEN d BETWEEN DATE '1998-10-07' AND DATE '1999-04-15' THEN 'regular'
  WHEN d > DATE '1999-04-15' AND d <= DATE '1999-06-21' THEN 'playoffs' WHEN d >= DATE '1998-09-12' AND d < DATE '1998-10-07' THEN 'preseason'
  WHEN month(d) >= 10 OR month(d) <= 3 THEN 'regular' WHEN month(d) BETWEEN 4 AND 6 THEN 'playoffs' ELSE 'offseason' END AS phase,
  CASE WHEN month(d) >= 10 THEN year(d) ELSE year(d) - 1 END::BIGINT AS season_start FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def f12(t):
    day = F.to_date("o_orderdate")
    dates = [F.lit(d).cast("date") for d in ("1998-09-12", "1998-10-07", "1999-04-15", "1999-06-21")]
    return t.orders.select(
        "o_orderkey",
        classify.season_phase(day, *dates).alias("phase"),
        classify.season_start(day).cast("bigint").alias("season_start"),
    )


VALUED = """SELECT *, CASE WHEN cap_hit <= 1.1e0 AND (age IS NULL OR age <= 23) THEN 'ELC' WHEN age >= 32 THEN 'Veteran'
  WHEN cap_hit < 5e0 AND (age IS NULL OR age <= 27) THEN 'Bridge' ELSE 'Market Rate' END AS contract_type FROM contracts"""


@query(
    "f13_contract_view_filters",
    cte("contracts", v=VALUED)
    + """SELECT 'not_elc' AS view, player_id FROM v WHERE contract_type <> 'ELC'
UNION ALL SELECT 'this_year', player_id FROM v WHERE expiry_year = 2026
UNION ALL SELECT 'two_plus', player_id FROM v WHERE expiry_year >= 2028
UNION ALL SELECT 'aging', player_id FROM v WHERE age >= 30""",
)
def f13(t):
    from stintflow.operators import contracts

    views = contracts.view_filters(2026)
    tags = F.array(*[F.when(cond, F.lit(name)) for name, cond in views.items()])
    rows = t.contracts.withColumn("contract_type", contracts.contract_type("cap_hit", "age"))
    return rows.select(F.explode(F.array_compact(tags)).alias("view"), "player_id")


@query(
    "f14_freshness_filter",
    cte("news")
    + """SELECT item_id, title FROM news WHERE (pub_ts IS NULL OR pub_ts >= TIMESTAMP '1998-06-01' - INTERVAL 14 DAY)
  AND NOT regexp_matches(title, '(?i)practice notes|mailbag')""",
)
def f14(t):
    fresh = classify.is_fresh("pub_ts", "1998-06-01", 14)
    return t.news.where(fresh & ~F.col("title").rlike("(?i)practice notes|mailbag")).select("item_id", "title")

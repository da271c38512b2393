"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.operators import contracts, reports
from stintflow.plans.bindings import cte
from stintflow.plans.q_aggregates import STANDINGS, standings
from stintflow.plans.q_filters import VALUED
from stintflow.plans.registry import query
from stintflow.plans.shape import big, r
from stintflow.scale import positions, top_k, with_ordinal


@query(
    "t1_top_bottom_k",
    """(SELECT 'top' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25)
UNION ALL (SELECT 'bottom', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25)""",
)
def t1(t):
    rows = t.customer.select("c_custkey", "c_acctbal")
    top = rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select(F.lit("top").alias("side"), "*")
    low = rows.orderBy("c_acctbal", "c_custkey").limit(25).select(F.lit("bottom").alias("side"), "*")
    return top.unionByName(low)


@query(
    "t2_nulls_last_sort",
    cte("contracts")
    + """SELECT player_id, age, gar, row_number() OVER (ORDER BY age DESC NULLS LAST, gar ASC NULLS LAST, player_id) AS pos FROM contracts""",
)
def t2(t):
    order = [F.col("age").desc_nulls_last(), F.col("gar").asc_nulls_last(), F.asc("player_id")]
    return positions(t.contracts.select("player_id", "age", "gar"), order, "pos")


@query(
    "t3_top_k_per_group",
    """SELECT c_nationkey::BIGINT AS team, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2""",
)
def t3(t):
    rows = t.customer.select(F.col("c_nationkey").cast("bigint").alias("team"), "c_custkey", "c_acctbal")
    return top_k(rows, ["team"], [F.desc("c_acctbal"), F.asc("c_custkey")], 2).drop("rn")


@query(
    "t4_leaderboards_one_scan",
    cte("skater_players", l="SELECT player_id, 'goals' AS metric, goals::DOUBLE AS value FROM skater_players UNION ALL SELECT player_id, 'hd', hd FROM skater_players UNION ALL SELECT player_id, 'blk', blk FROM skater_players")
    + "SELECT player_id, metric, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, player_id) AS rank FROM l QUALIFY rank <= 10",
)
def t4(t):
    rows = t.skater_totals("player_id")
    return reports.leaderboards(rows, "player_id", ["goals", "hd", "blk"], 10).select("player_id", "metric", "value", big("rank"))


@query(
    "t5_qualified_first",
    """SELECT *, row_number() OVER (ORDER BY ok DESC, c_acctbal DESC, c_custkey) AS pos FROM (SELECT c_custkey, c_acctbal, c_custkey % 3 <> 0 AS ok FROM customer)""",
)
def t5(t):
    rows = t.customer.select("c_custkey", "c_acctbal", (F.col("c_custkey") % 3 != 0).alias("ok"))
    return positions(rows, [F.desc("ok"), F.desc("c_acctbal"), F.asc("c_custkey")], "pos")


@query(
    "t6_custom_order",
    """SELECT n_name, row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 9 END, n_name) AS pos FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def t6(t):
    conf = F.when(F.col("r_name") == "EUROPE", 0).when(F.col("r_name") == "ASIA", 1).otherwise(9)
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", conf.alias("c"))
    return positions(rows, [F.asc("c"), F.asc("n_name")], "pos").select("n_name", "pos")


@query(
    "t7_every_nth",
    cte("plays", g="SELECT DISTINCT game_id FROM plays")
    + "SELECT game_id FROM g QUALIFY row_number() OVER (ORDER BY game_id) % 26 = 1 ORDER BY game_id LIMIT 50",
)
def t7(t):
    games = t.plays.select("game_id").distinct()
    return with_ordinal(games, [], None, "game_id", "n").where("n % 26 = 1").select("game_id").orderBy("game_id").limit(50)


@query(
    "t8_similar_entities",
    cte("skater_players", m="SELECT * FROM skater_players WHERE player_id = 17")
    + """SELECT p.player_id, round(abs(p.goals - m.goals) * 1e0 + abs(p.hd - m.hd) * 0.2e0, 6) AS score FROM skater_players p, m
WHERE p.player_id <> 17 AND p.position = m.position AND p.gp >= 20 ORDER BY score, p.player_id LIMIT 5""",
)
def t8(t):
    rows = t.skater_totals("player_id", "position")
    return reports.most_similar(rows, 17, "player_id", {"goals": 1.0, "hd": 0.2}, 20).select("player_id", "score")


@query(
    "t9_outliers_two_sided",
    cte("contracts", d="SELECT player_id, round(gar - xgar, 2) AS delta FROM contracts WHERE gar IS NOT NULL")
    + """(SELECT player_id, delta, 'over' AS side FROM d ORDER BY delta DESC, player_id LIMIT 10) UNION ALL (SELECT player_id, delta, 'under' FROM d ORDER BY delta, player_id LIMIT 10)""",
)
def t9(t):
    rows = t.contracts.where("gar IS NOT NULL").select("player_id", F.round(F.col("gar") - F.col("xgar"), 2).alias("delta"))
    return reports.outliers(rows, "delta", "player_id", 10)


@query(
    "t10_playoff_seeding",
    cte("team_games", s=STANDINGS, d="SELECT *, row_number() OVER (PARTITION BY conf, division ORDER BY points DESC, gf DESC, team) AS div_rank FROM s",
        w="SELECT team, row_number() OVER (PARTITION BY conf ORDER BY points DESC, gf DESC, team) AS wild_card FROM d WHERE div_rank > 3 QUALIFY wild_card <= 2",
        o="SELECT conf, division, row_number() OVER (PARTITION BY conf ORDER BY points DESC, division) AS div_order FROM d WHERE div_rank = 1")
    + """SELECT d.conf, d.team, d.points, d.div_rank, w.wild_card, CASE WHEN wild_card = 2 THEN 1 WHEN wild_card = 1 THEN 3 WHEN div_rank = 1 THEN div_order * 2 - 1 ELSE div_order * 2 END AS series
FROM d LEFT JOIN w USING (team) LEFT JOIN o ON o.conf = d.conf AND o.division = d.division WHERE div_rank <= 3 OR wild_card IS NOT NULL""",
)
def t10(t):
    return reports.playoff_seeds(standings(t)).select("conf", "team", "points", big("div_rank"), big("wild_card"), "series")


@query(
    "u1_union_all",
    """SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier""",
)
def u1(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query(
    "u2_drop_duplicates_keep_first",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def u2(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1).drop("rn")


@query(
    "u3_difference_intersection",
    """SELECT 'only_left' AS kind, k FROM (SELECT l_partkey AS k FROM lineitem EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'both', k FROM (SELECT l_partkey AS k FROM lineitem INTERSECT SELECT o_custkey FROM orders)""",
)
def u3(t):
    # keys of both sides are made distinct before they meet, in one shuffle of distinct keys
    a = t.lineitem.select(F.col("l_partkey").alias("k"), F.lit(True).alias("left"))
    b = t.orders.select(F.col("o_custkey").alias("k"), F.lit(False).alias("left"))
    keys = a.unionByName(b).groupBy("k").agg(F.max("left").alias("left"), F.min("left").alias("alone"))
    return keys.where("left").select(F.when(F.col("alone"), "only_left").otherwise("both").alias("kind"), "k")


@query(
    "u4_key_union",
    """SELECT DISTINCT k FROM (SELECT l_suppkey AS k FROM lineitem UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT c_custkey FROM customer)""",
)
def u4(t):
    parts = [t.lineitem.select(F.col("l_suppkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query(
    "u5_dedupe_by_link",
    cte("news")
    + """SELECT link, item_id, pool FROM (SELECT *, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END AS pool FROM news) QUALIFY row_number() OVER (PARTITION BY link ORDER BY pool, item_id) = 1""",
)
def u5(t):
    rows = t.news.select("link", "item_id", F.when(F.col("item_id") % 3 == 0, 0).otherwise(1).alias("pool"))
    best = F.min(F.struct("pool", "item_id")).alias("b")
    return rows.groupBy("link").agg(best).select("link", "b.item_id", F.col("b.pool").alias("pool"))


@query(
    "u6_melt_two_sides",
    cte("team_games") + "SELECT match_id, team, opp, gf, ga, is_home, result FROM team_games",
)
def u6(t):
    return t.team_games.select("match_id", "team", "opp", "gf", "ga", "is_home", "result")

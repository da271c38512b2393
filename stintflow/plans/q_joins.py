"""Equi joins, aligned joins and key resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.functions import text
from stintflow.operators import joins
from stintflow.plans.bindings import cte
from stintflow.plans.registry import query
from stintflow.plans.shape import div, r


@query(
    "j1_inner_join",
    """SELECT o_orderkey, l_linenumber::BIGINT AS line, o_totalprice, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def j1(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "o_totalprice", "l_quantity"
    )


@query(
    "j2_left_lookup",
    """SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey <> 3
LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def j2(t):
    dim = t.nation.where("n_nationkey <> 3").join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return t.customer.join(dim, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query(
    "j3_full_outer_fill",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(qty, 0) AS qty, coalesce(n_orders, 0) AS n_orders FROM
 (SELECT l_partkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1) a FULL JOIN
 (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) b ON a.k = b.k""",
)
def j3(t):
    a = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
    b = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    return joins.full_outer_filled(a, b, ["k"], ["qty", "n_orders"])


def sided(t):
    """Events of two kinds that share (squad, minute) keys many times over."""
    key = [F.col("game_id"), F.expr("abs_secs div 1800").alias("slot")]
    left = t.plays.where("event_type = 'click'").select(*key, F.col("event_id").alias("left_id"))
    right = t.plays.where("event_type = 'view'").select(
        *key, F.col("event_id").alias("right_id"), F.round(F.col("value") * 100).cast("bigint").alias("value_c")
    )
    return left, right


ALIGNED = {
    "a": "SELECT game_id, abs_secs // 1800 AS slot, event_id AS left_id, row_number() OVER (PARTITION BY game_id, abs_secs // 1800 ORDER BY event_id) - 1 AS occ FROM plays WHERE event_type = 'click'",
    "b": "SELECT game_id, abs_secs // 1800 AS slot, event_id AS right_id, CAST(round(value * 100) AS BIGINT) AS value_c, row_number() OVER (PARTITION BY game_id, abs_secs // 1800 ORDER BY event_id) - 1 AS occ FROM plays WHERE event_type = 'view'",
}


@query(
    "j4_occurrence_aligned_join",
    cte("plays", **ALIGNED)
    + """SELECT left_id, game_id, slot, occ, right_id, coalesce(value_c, 0) AS value_c, right_id IS NOT NULL AS matched
FROM a LEFT JOIN b USING (game_id, slot, occ)""",
)
def j4(t):
    left, right = sided(t)
    rows = joins.occurrence_join(left, right, ["game_id", "slot"], "left_id", "right_id")
    return rows.select(
        "left_id", "game_id", "slot", "occ", "right_id", F.coalesce("value_c", F.lit(0)).alias("value_c"), "matched"
    )


@query(
    "j5_row_aligned_join",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, occ, CAST(a.q AS BIGINT) AS qty_ordered, CAST(b.q AS BIGINT) AS qty_again FROM
 (SELECT l_orderkey, l_linenumber, q, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY id) - 1 AS occ FROM
   (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity AS q, l_partkey * 100000 + l_suppkey AS id FROM lineitem WHERE l_returnflag <> 'N') QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber, id) = 1) a JOIN
 (SELECT l_orderkey, l_linenumber, q, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY id) - 1 AS occ FROM
   (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity AS q, l_partkey * 100000 + l_suppkey AS id FROM lineitem WHERE l_returnflag = 'N') QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber, id) = 1) b
 USING (l_orderkey, l_linenumber, occ)""",
)
def j5(t):
    ident = (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id")
    key = ["l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")]

    def side(cond, name):
        rows = t.lineitem.where(cond).select(*key, ident, F.col("l_quantity").cast("bigint").alias("q")).distinct()
        once = rows.groupBy("l_orderkey", "l_linenumber", "id").agg(F.count(F.lit(1)).alias("c"), F.max("q").alias(name))
        return once.where("c = 1").select("l_orderkey", "l_linenumber", F.col("id").alias(f"{name}_id"), name)

    rows = joins.occurrence_join(
        side("l_returnflag <> 'N'", "qty_ordered"),
        side("l_returnflag = 'N'", "qty_again"),
        ["l_orderkey", "l_linenumber"],
        "qty_ordered_id",
        "qty_again_id",
    )
    return rows.where("matched").select("l_orderkey", "l_linenumber", "occ", "qty_ordered", "qty_again")


@query(
    "j11_semi_anti",
    """SELECT 'semi' AS kind, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'anti', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def j11(t):
    pending = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    ids = t.customer.select("c_custkey")
    semi = ids.join(pending, "c_custkey", "left_semi").select(F.lit("semi").alias("kind"), "c_custkey")
    anti = ids.join(pending, "c_custkey", "left_anti").select(F.lit("anti").alias("kind"), "c_custkey")
    return semi.unionByName(anti)


@query(
    "j12_opposing_side",
    cte("shots")
    + """SELECT a.game_id, a.team_id, a.shots, a.xg_c, coalesce(b.shots, 0) AS opp_shots, coalesce(b.xg_c, 0) AS opp_xg_c FROM
 (SELECT game_id, team_id, count(*) AS shots, CAST(sum(xg_c) AS BIGINT) AS xg_c FROM shots GROUP BY 1, 2) a LEFT JOIN
 (SELECT game_id, team_id, count(*) AS shots, CAST(sum(xg_c) AS BIGINT) AS xg_c FROM shots GROUP BY 1, 2) b
 ON a.game_id = b.game_id AND a.team_id <> b.team_id""",
)
def j12(t):
    # the game's two sides meet as columns of one aggregate instead of a self join
    side = lambda s, e: F.sum(F.when(F.col("team_id") == s, e))
    one = F.lit(1).cast("bigint")
    game = t.shots.groupBy("game_id").agg(
        *[side(s, one).alias(f"n{s}") for s in (0, 1)], *[side(s, F.col("xg_c")).alias(f"x{s}") for s in (0, 1)]
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    row = lambda s, o: F.struct(
        F.lit(s).cast("bigint").alias("team_id"),
        F.col(f"n{s}").alias("shots"),
        F.col(f"x{s}").alias("xg_c"),
        zero(f"n{o}").alias("opp_shots"),
        zero(f"x{o}").alias("opp_xg_c"),
    )
    return game.select("game_id", F.explode(F.array(row(0, 1), row(1, 0))).alias("s")).select("game_id", "s.*").where("shots > 0")


@query(
    "j13_name_normalised_join",
    """SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, regexp_replace(lower(replace(c_name, 'Customer', 'Ünit')), '[^a-z0-9]+', '', 'g') AS raw,
   'u' || regexp_replace(lower(replace(c_name, 'Customer', 'nit')), '[^a-z0-9]+', '', 'g') AS k FROM customer) c
JOIN (SELECT s_suppkey, regexp_replace(lower(replace(s_name, 'Supplier', 'unit-')), '[^a-z0-9]+', '', 'g') AS k FROM supplier) s USING (k)""",
)
def j13(t):
    a = t.customer.select("c_custkey", text.name_key(F.regexp_replace("c_name", "Customer", "Ünit")).alias("k"))
    b = t.supplier.select("s_suppkey", text.name_key(F.regexp_replace("s_name", "Supplier", "unit-")).alias("k"))
    return a.join(text.apply_aliases(b, "k", {"unitold": "unitnew"}), "k").select("c_custkey", "s_suppkey")


@query(
    "j14_key_resolution_preferred",
    """SELECT c_custkey, s_suppkey, c_nationkey = s_nationkey AS team_match FROM customer LEFT JOIN supplier ON c_custkey % 10 = s_suppkey % 10
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN c_nationkey = s_nationkey THEN 0 ELSE 1 END, s_suppkey NULLS LAST) = 1""",
)
def j14(t):
    # best candidate per (name key, team) and per name key: both are small aggregates, no candidate list is formed
    pool = t.supplier.select((F.col("s_suppkey") % 10).alias("nk"), "s_nationkey", "s_suppkey")
    exact = pool.groupBy("nk", F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("exact"))
    any_team = pool.groupBy("nk").agg(F.min("s_suppkey").alias("fallback"))
    rows = t.customer.withColumn("nk", F.col("c_custkey") % 10).join(exact, ["nk", "c_nationkey"], "left")
    return rows.join(any_team, "nk", "left").select(
        "c_custkey",
        F.coalesce("exact", "fallback").alias("s_suppkey"),
        F.col("exact").isNotNull().alias("team_match"),
    )


@query(
    "j15_cached_key_reuse",
    """SELECT o_orderkey, c_name AS cached_name, c_name IS NULL AS todo FROM orders LEFT JOIN
 (SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""",
)
def j15(t):
    snapshot = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    known, todo = joins.reuse_keys(t.orders.select("o_orderkey", "o_custkey"), snapshot, ["o_custkey"], "c_name")
    done = known.select("o_orderkey", F.col("c_name").alias("cached_name"), F.lit(False).alias("todo"))
    return done.unionByName(
        todo.select("o_orderkey", F.lit(None).cast("string").alias("cached_name"), F.lit(True).alias("todo"))
    )


@query(
    "j16_situations_widened",
    cte("skater_summary")
    + """SELECT player_id, season, """
    + ", ".join(
        f"CAST(coalesce(sum({m}) FILTER (situation = '{s}'), 0) AS BIGINT) AS {m}_{s}"
        for s in ("all", "5on5", "5on4", "4on5")
        for m in ("goals", "icetime")
    )
    + " FROM skater_summary GROUP BY 1, 2",
)
def j16(t):
    pick = lambda m, s: F.coalesce(F.sum(F.when(F.col("situation") == s, F.col(m))), F.lit(0)).alias(f"{m}_{s}")
    return t.skater_summary.groupBy("player_id", "season").agg(
        *[pick(m, s) for s in ("all", "5on5", "5on4", "4on5") for m in ("goals", "icetime")]
    )


@query(
    "j17_replicates_by_group",
    cte("shots", g="SELECT game_id, count(*) AS n, CAST(sum(is_goal) AS BIGINT) AS goals FROM shots GROUP BY 1")
    + """SELECT b AS rep, count(*) AS games, CAST(sum(n) AS BIGINT) AS n, CAST(sum(goals) AS BIGINT) AS goals FROM g, range(1, 21) t(b) GROUP BY 1""",
)
def j17(t):
    groups = t.shots.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.sum("is_goal").alias("goals"))
    reps = groups.withColumn("rep", F.explode(F.expr("sequence(1L, 20L)")))
    return reps.groupBy("rep").agg(F.count(F.lit(1)).alias("games"), F.sum("n").alias("n"), F.sum("goals").alias("goals"))

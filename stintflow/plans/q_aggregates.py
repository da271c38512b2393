"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.operators import intervals, tables
from stintflow.plans.bindings import cte
from stintflow.plans.q_intervals import MEMBERS, STINT_STATS, stint_cte, stint_stats
from stintflow.plans.registry import query
from stintflow.plans.shape import big, div, r
from stintflow.scale import quantiles, top_k, value_ranks, with_ordinal, with_ranks



@query(
    "a1_group_basics",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, count(*) AS n,
  round(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100e0, 4) AS sum_price, round(avg(CAST(l_quantity AS BIGINT)), 6) AS avg_qty,
  min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, min(l_orderkey) AS first_key
FROM lineitem GROUP BY 1, 2""",
)
def a1(t):
    qty = F.col("l_quantity").cast("bigint")
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(qty).alias("sum_qty"),
        F.count(F.lit(1)).alias("n"),
        r(F.sum(price) / 100.0, 4, "sum_price"),
        r(F.avg(qty), 6, "avg_qty"),
        F.min("l_quantity").alias("min_qty"),
        F.max("l_quantity").alias("max_qty"),
        F.min("l_orderkey").alias("first_key"),
    )


# the fixed weights shifted to the years the tables hold
WEIGHTS_SHIFTED = {y - 24: w for y, w in tables.SEASON_WEIGHTS.items()}
WEIGHT_SQL = (
    "CASE season " + " ".join(f"WHEN {y} THEN {w!r}::DOUBLE" for y, w in WEIGHTS_SHIFTED.items()) + " ELSE 0.05::DOUBLE END"
)


@query(
    "a2_season_weighted_rates",
    cte("skater_summary")
    + f"""SELECT player_id, round(sum(w * goals) / (sum(w * icetime) / 3600e0), 6) AS goals_60, round(sum(w * xg_c) / 100e0 / (sum(w * icetime) / 3600e0), 6) AS xg_60
FROM (SELECT *, {WEIGHT_SQL} AS w FROM skater_summary WHERE situation = 'all') GROUP BY 1""",
)
def a2(t):
    rows = t.skater_totals("player_id", "season").withColumn(
        "w", tables.season_weight(F.col("season"), WEIGHTS_SHIFTED)
    )
    hours = F.sum(F.col("w") * F.col("icetime")) / 3600.0
    return rows.groupBy("player_id").agg(
        r(F.sum(F.col("w") * F.col("goals")) / hours, 6, "goals_60"),
        r(F.sum(F.col("w") * F.col("xg_c")) / 100.0 / hours, 6, "xg_60"),
    )


@query(
    "a3_per_60_rate",
    cte("skater_summary")
    + """SELECT player_id, season, situation, CASE WHEN icetime > 0 THEN round(goals / (icetime / 3600e0), 6) ELSE 0 END AS goals_60 FROM skater_summary""",
)
def a3(t):
    return t.skater_summary.select(
        "player_id", "season", "situation", r(tables.per_60(F.col("goals"), F.col("icetime")), 6, "goals_60")
    )


@query(
    "a4_share_percentages",
    cte("skater_summary")
    + """SELECT team, season, situation, CASE WHEN cf + ca > 0 THEN round(100e0 * cf / (cf + ca), 6) END AS cf_pct,
  CASE WHEN onf + ona > 0 THEN round(100e0 * onf / (onf + ona), 6) ELSE 50 END AS xgf_pct,
  round((CASE WHEN sog > 0 THEN 100e0 * goals / sog ELSE 0 END) + (CASE WHEN ca > 0 THEN 100e0 * (ca - ga) / ca ELSE 0 END), 6) AS pdo
FROM (SELECT team, season, situation, sum(cf)::BIGINT cf, sum(ca)::BIGINT ca, sum(onf_c)::BIGINT onf, sum(ona_c)::BIGINT ona, sum(sog)::BIGINT sog, sum(goals)::BIGINT goals, sum(ga)::BIGINT ga
  FROM skater_summary GROUP BY 1, 2, 3)""",
)
def a4(t):
    g = t.skater_summary.groupBy("team", "season", "situation").agg(
        *[F.sum(c).alias(c) for c in ("cf", "ca", "onf_c", "ona_c", "sog", "goals", "ga")]
    )
    hundred = F.lit(100.0)
    pdo = div(hundred * F.col("goals"), F.col("sog"), 0.0) + div(hundred * (F.col("ca") - F.col("ga")), F.col("ca"), 0.0)
    return g.select(
        "team",
        "season",
        "situation",
        r(tables.share_pct(F.col("cf"), F.col("ca")), 6, "cf_pct"),
        r(tables.share_pct(F.col("onf_c"), F.col("ona_c"), 50.0), 6, "xgf_pct"),
        r(pdo, 6, "pdo"),
    )


@query(
    "a6_conditional_by_situation",
    cte("skater_lines")
    + """SELECT player_id, CAST(sum(goals) AS BIGINT) AS goals_all, """
    + ", ".join(
        f"CAST(coalesce(sum(goals) FILTER (situation = '{s}'), 0) AS BIGINT) AS goals_{s}" for s in ("5on5", "5on4", "4on5")
    )
    + " FROM skater_lines GROUP BY 1",
)
def a6(t):
    when = lambda s: F.sum(F.when(F.col("situation") == s, F.col("goals")).otherwise(0)).cast("bigint").alias(f"goals_{s}")
    return t.skater_lines.groupBy("player_id").agg(
        F.sum("goals").alias("goals_all"), *[when(s) for s in ("5on5", "5on4", "4on5")]
    )


@query(
    "a7_pivot_situations",
    cte("skater_lines")
    + """SELECT team, """
    + ", ".join(f"""CAST(sum(icetime) FILTER (situation = '{s}') AS BIGINT) AS "{s}" """ for s in ("5on5", "5on4", "4on5", "other"))
    + " FROM skater_lines GROUP BY 1",
)
def a7(t):
    return t.skater_lines.groupBy("team").pivot("situation", ["5on5", "5on4", "4on5", "other"]).agg(F.sum("icetime"))


@query(
    "a8_weighted_average",
    """SELECT c_nationkey::BIGINT AS team, round(CAST(sum(n * v) AS BIGINT) / CAST(sum(CASE WHEN v IS NOT NULL THEN n END) AS DOUBLE), 6) AS wavg FROM (
  SELECT c_nationkey, c_custkey % 50 + 1 AS n, CASE WHEN c_acctbal >= 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS v FROM customer) GROUP BY 1""",
)
def a8(t):
    value = F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") * 100).cast("bigint"))
    rows = t.customer.select("c_nationkey", (F.col("c_custkey") % 50 + 1).alias("n"), value.alias("v"))
    return rows.groupBy(F.col("c_nationkey").cast("bigint").alias("team")).agg(
        r(tables.weighted_mean(F.col("n"), F.col("v")), 6, "wavg")
    )


@query(
    "a9_distinct_games",
    cte("plays") + "SELECT player_id, count(DISTINCT game_id) AS games, count(DISTINCT event_type) AS kinds FROM plays GROUP BY 1",
)
def a9(t):
    return t.plays.groupBy("player_id").agg(
        F.countDistinct("game_id").alias("games"), F.countDistinct("event_type").alias("kinds")
    )


@query(
    "a11_leave_one_out_mean",
    cte("skater_players")
    + """SELECT player_id, round(100e0 * v - CASE WHEN n > 1 THEN (100e0 * s - 100e0 * v) / (n - 1) END, 4) AS rel FROM (
  SELECT player_id, cf AS v, sum(cf) OVER (PARTITION BY team)::BIGINT AS s, count(*) OVER (PARTITION BY team) AS n FROM skater_players)""",
)
def a11(t):
    rows = t.skater_totals("player_id", "team").withColumn("v", F.lit(100.0) * F.col("cf"))
    return tables.leave_one_out(rows, ["team"], "v", "rel").select("player_id", r("rel", 4, "rel"))


@query(
    "a12_off_ice_rate",
    cte("skater_players")
    + """SELECT player_id, round(on_60 - off_60, 6) AS rel_60 FROM (
  SELECT player_id, onf_c / (icetime / 3600e0) AS on_60, CASE WHEN ti > icetime THEN (tf - onf_c) / ((ti - icetime) / 3600e0) ELSE 0 END AS off_60 FROM (
    SELECT *, sum(onf_c) OVER (PARTITION BY team)::BIGINT AS tf, sum(icetime) OVER (PARTITION BY team)::BIGINT AS ti FROM skater_players))""",
)
def a12(t):
    players = t.skater_totals("player_id", "team").select("player_id", "team", "onf_c", "icetime")
    totals = t.skater_totals("team").select("team", F.col("onf_c").alias("tf"), F.col("icetime").alias("ti"))
    on = F.col("onf_c") / (F.col("icetime") / 3600.0)
    rest = F.col("ti") - F.col("icetime")
    off = F.when(rest > 0, (F.col("tf") - F.col("onf_c")) / (rest / 3600.0)).otherwise(0.0)
    return players.join(totals, "team").select("player_id", r(on - off, 6, "rel_60"))


TEAM_TOI = """SELECT c_custkey AS player_id, l_suppkey % 5 AS team, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS toi FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


def team_toi(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("player_id"), (F.col("l_suppkey") % 5).alias("team")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("toi")
    )


@query(
    "a14_ordered_team_list",
    f"WITH x AS ({TEAM_TOI}) SELECT player_id, string_agg(CAST(team AS VARCHAR), '/' ORDER BY toi DESC, team) AS labels FROM x GROUP BY 1",
)
def a14(t):
    return tables.ordered_list(team_toi(t), ["player_id"], "team", "toi")


@query(
    "a15_primary_team",
    f"WITH x AS ({TEAM_TOI}) SELECT player_id, team, toi FROM x QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY toi DESC, team) = 1",
)
def a15(t):
    best = F.max_by(F.struct("team", "toi"), F.struct(F.col("toi"), -F.col("team"))).alias("b")
    return team_toi(t).groupBy("player_id").agg(best).select("player_id", "b.team", "b.toi")


@query(
    "a16_mode_nonzero",
    """SELECT c_nationkey::BIGINT AS team, k AS mode_value FROM (
  SELECT c_nationkey, c_custkey % 6 AS k, count(*) AS n FROM customer WHERE c_custkey % 6 <> 0 GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, k) = 1""",
)
def a16(t):
    counts = (
        t.customer.select(F.col("c_nationkey").cast("bigint").alias("team"), (F.col("c_custkey") % 6).alias("k"))
        .where("k <> 0")
        .groupBy("team", "k")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("team").agg(F.max_by("k", F.struct(F.col("n"), -F.col("k"))).alias("mode_value"))


@query(
    "a17_histogram_overflow",
    cte("matches") + "SELECT least(home_goals + away_goals, 10) AS bucket, count(*) AS n FROM matches GROUP BY 1",
)
def a17(t):
    total = F.least(F.col("home_goals") + F.col("away_goals"), F.lit(10))
    return t.matches.groupBy(total.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a18_quantiles_spread",
    """SELECT c_nationkey::BIGINT AS team, round(quantile_cont(c_acctbal, 0.2), 6) AS p20, round(median(c_acctbal), 6) AS med,
  round(quantile_cont(c_acctbal, 0.95), 6) AS p95, round(stddev_pop(c_acctbal), 4) AS sd_pop, round(stddev_samp(c_acctbal), 4) AS sd_samp
FROM customer GROUP BY 1""",
)
def a18(t):
    rows = t.customer.select(F.col("c_nationkey").cast("bigint").alias("team"), "c_acctbal")
    q = quantiles(rows, ["team"], "c_acctbal", {"p20": 0.2, "med": 0.5, "p95": 0.95})
    s = rows.groupBy("team").agg(
        r(F.stddev_pop("c_acctbal"), 4, "sd_pop"), r(F.stddev_samp("c_acctbal"), 4, "sd_samp")
    )
    return q.join(s, "team").select("team", r("p20", 6, "p20"), r("med", 6, "med"), r("p95", 6, "p95"), "sd_pop", "sd_samp")


@query(
    "a19_correlations",
    cte("skater_players", rk="""SELECT *, rank() OVER (ORDER BY goals) + (count(*) OVER (PARTITION BY goals) - 1) / 2e0 AS rg,
  rank() OVER (ORDER BY xg_c) + (count(*) OVER (PARTITION BY xg_c) - 1) / 2e0 AS rx FROM skater_players""")
    + "SELECT round(corr(goals, xg_c), 6) AS pearson, round(corr(rg, rx), 6) AS spearman FROM rk",
)
def a19(t):
    rows = t.skater_totals("player_id").select("player_id", "goals", "xg_c")
    ranked = with_ranks(rows, [], {"rg": "goals", "rx": "xg_c"}, "average")
    return ranked.agg(r(F.corr("goals", "xg_c"), 6, "pearson"), r(F.corr("rg", "rx"), 6, "spearman"))


@query(
    "a20_ols_by_group",
    """SELECT c_mktsegment AS grp, round(CASE WHEN n >= 50 THEN s ELSE 0 END, 6) AS slope, round(CASE WHEN n >= 50 THEN i ELSE m END, 4) AS intercept,
  round(CASE WHEN n >= 50 THEN r2 ELSE 0 END, 6) AS r2, n FROM (
  SELECT c_mktsegment, regr_slope(c_acctbal, c_nationkey) AS s, regr_intercept(c_acctbal, c_nationkey) AS i, regr_r2(c_acctbal, c_nationkey) AS r2, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1)""",
)
def a20(t):
    rows = t.customer.select(F.col("c_mktsegment").alias("grp"), "c_acctbal", F.col("c_nationkey").cast("double").alias("x"))
    return tables.simple_ols(rows, ["grp"], "c_acctbal", "x").select(
        "grp", r("slope", 6, "slope"), r("intercept", 4, "intercept"), r("r2", 6, "r2"), "n"
    )


@query(
    "a21_tier_blocks",
    """SELECT CASE WHEN rk <= 30 THEN '1-30' WHEN rk <= 100 THEN '31-100' WHEN rk <= 300 THEN '101-300' ELSE '301+' END AS band, count(*) AS n,
  round(avg(c_acctbal), 4) AS predicted, round(avg(c_custkey), 4) AS actual FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer) GROUP BY 1""",
)
def a21(t):
    return tables.tier_blocks(t.customer, "c_acctbal", "c_custkey", "c_acctbal", "c_custkey").select(
        "band", "n", r("predicted", 4, "predicted"), r("actual", 4, "actual")
    )


SCORED = """SELECT l_returnflag, CAST(l_returnflag = 'R' AS BIGINT) AS y, (CAST(round(l_discount * 100) AS BIGINT) * 7 + CAST(l_quantity AS BIGINT)) / 130e0 AS p, CAST(l_quantity AS BIGINT) AS w FROM lineitem"""


def scored(t):
    p = (F.round(F.col("l_discount") * 100).cast("bigint") * 7 + F.col("l_quantity").cast("bigint")) / 130.0
    return t.lineitem.select(
        "l_linestatus", "l_returnflag", (F.col("l_returnflag") == "R").cast("bigint").alias("y"), p.alias("p"), F.col("l_quantity").cast("bigint").alias("w")
    )


@query(
    "a22_scoring_metrics",
    f"""WITH s AS ({SCORED}), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rk FROM s)
SELECT round(sum(w * (y - p) * (y - p)) / sum(w), 6) AS wmse, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((y - p) * (y - p)), 6) AS brier,
  round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""",
)
def a22(t):
    from stintflow.operators import modeling

    s = scored(t)
    auc = modeling.auc(s, "p", "y").scalar()
    y, p = F.col("y"), F.col("p")
    return s.agg(
        r(F.sum(F.col("w") * (y - p) * (y - p)) / F.sum("w"), 6, "wmse"),
        r(modeling.log_loss("p", "y"), 6, "log_loss"),
        r(F.avg((y - p) * (y - p)), 6, "brier"),
    ).withColumn("auc", F.round(auc, 6))


DECILE_EDGES = ", ".join(f"quantile_cont(p, 0.{i})" for i in range(1, 10))


@query(
    "a23_calibration_deciles",
    f"WITH s AS ({SCORED}), e AS (SELECT DISTINCT unnest([{DECILE_EDGES}]) AS x FROM s)"
    + """ SELECT CAST((SELECT count(*) FROM e WHERE x < p) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual FROM s GROUP BY 1""",
)
def a23(t):
    return tables.calibration_by_quantile(scored(t), "p", "y").select(
        big("bin"), "n", r("predicted", 6, "predicted"), r("actual", 6, "actual")
    )


@query(
    "a23_calibration_by_category",
    f"""WITH s AS (SELECT *, l_returnflag AS cat FROM ({SCORED}))
SELECT cat, n, round(predicted, 4) AS predicted, actual, round(actual / predicted, 6) AS ratio, actual < 150 OR actual / predicted BETWEEN 0.90 AND 1.10 AS gate_ok FROM (
  SELECT cat, count(*) AS n, sum(p) AS predicted, CAST(sum(y) AS BIGINT) AS actual FROM s GROUP BY 1)""",
)
def a23c(t):
    g = tables.calibration_by_category(scored(t).withColumnRenamed("l_returnflag", "cat"), "cat", "p", "y")
    return g.select("cat", "n", r("predicted", 4, "predicted"), "actual", r("ratio", 6, "ratio"), "gate_ok")


STANDINGS = """SELECT n_regionkey::BIGINT AS conf, team % 2 AS division, team, CAST(sum(CASE WHEN result = 'W' THEN 2 WHEN result = 'OTL' THEN 1 ELSE 0 END) AS BIGINT) AS points,
  CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, count(*) AS gp FROM team_games JOIN nation ON team = n_nationkey GROUP BY 1, 2, 3"""


def standings(t):
    pts = F.when(F.col("result") == "W", 2).when(F.col("result") == "OTL", 1).otherwise(0)
    conf = t.nation.select(F.col("n_nationkey").cast("bigint").alias("team"), F.col("n_regionkey").cast("bigint").alias("conf"))
    sums = t.team_games.groupBy("team").agg(
        F.sum(pts).cast("bigint").alias("points"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.count(F.lit(1)).alias("gp")
    )
    return sums.join(conf, "team").withColumn("division", F.col("team") % 2)


@query(
    "a24_standings_nesting",
    cte("team_games", s=STANDINGS)
    + """SELECT conf, division, string_agg(CAST(team AS VARCHAR) || ':' || CAST(points AS VARCHAR), ',' ORDER BY points DESC, gf DESC, team) AS teams FROM s GROUP BY 1, 2""",
)
def a24(t):
    entry = F.struct((-F.col("points")).alias("p"), (-F.col("gf")).alias("g"), "team")
    nested = standings(t).groupBy("conf", "division").agg(F.array_sort(F.collect_list(entry)).alias("list"))
    text = lambda e: F.concat(e["team"].cast("string"), F.lit(":"), (-e["p"]).cast("string"))
    return nested.select("conf", "division", F.array_join(F.transform("list", text), ",").alias("teams"))


@query(
    "a26_game_score",
    cte("skater_players")
    + """SELECT player_id, round_even(gs, 2) AS game_score, CASE WHEN gp > 0 THEN round_even(round_even(gs, 2) / gp, 3) ELSE 0 END AS per_game FROM (SELECT *,
  (750 * goals + 700 * a1 + 550 * a2 + 75 * sog + 75 * blk + 50 * pt + 150 * pd - 150 * pt + 10 * fow - 10 * fol + 50 * cf - 50 * ca + 150 * gf - 150 * ga) / 1000e0 AS gs FROM skater_players)""",
)
def a26(t):
    from stintflow.operators import reports

    rows = t.skater_totals("player_id").withColumn("pim", F.col("pt"))
    return reports.game_score(rows).select("player_id", "game_score", "per_game")


@query(
    "a27_recenter_total",
    cte("skater_players")
    + """SELECT player_id, round(xg_c * (SELECT sum(goals)::DOUBLE / sum(xg_c) FROM skater_players) - goals, 6) AS gsax FROM skater_players""",
)
def a27(t):
    from stintflow.operators import ratings

    rows = t.skater_totals("player_id").select("player_id", "xg_c", "goals")
    return ratings.recentre(rows, "xg_c", "goals", "gsax").select("player_id", r("gsax", 6, "gsax"))


@query(
    "a29_reconciliation_checks",
    stint_cte(stats=STINT_STATS)
    + """SELECT 'attempts' AS check_name, (SELECT CAST(sum(home_attempts + away_attempts) AS BIGINT) FROM stats) AS parts, (SELECT count(*) FROM shots) AS whole
UNION ALL SELECT 'goals', (SELECT CAST(sum(home_goals + away_goals) AS BIGINT) FROM stats), (SELECT CAST(sum(is_goal) AS BIGINT) FROM shots)
UNION ALL SELECT 'clock', (SELECT CAST(sum(duration_secs) AS BIGINT) FROM stints), (SELECT CAST(sum(e - s) AS BIGINT) FROM (SELECT min(abs_start) AS s, max(abs_end) AS e FROM shifts GROUP BY game_id, period))""",
)
def a29(t):
    from stintflow.operators import quality

    stats = stint_stats(t)
    return quality.conservation(stats, t.shots, t.shifts)


@query(
    "a30_grouping_sets",
    cte("skater_lines")
    + "SELECT player_id, coalesce(situation, 'all') AS situation, CAST(sum(goals) AS BIGINT) AS goals FROM skater_lines GROUP BY GROUPING SETS ((player_id), (player_id, situation))",
)
def a30(t):
    g = t.skater_lines.rollup("player_id", "situation").agg(F.sum("goals").alias("goals"), F.grouping_id().alias("gid"))
    return g.where("gid < 3").select("player_id", F.coalesce("situation", F.lit("all")).alias("situation"), "goals")


@query(
    "a31_position_averages",
    cte("skater_players")
    + """SELECT position, round(avg(goals::DOUBLE / sog), 6) AS share FROM skater_players WHERE icetime >= 800000 GROUP BY 1""",
)
def a31(t):
    rows = t.skater_totals("player_id", "position").where("icetime >= 800000")
    return rows.groupBy("position").agg(r(F.avg(F.col("goals") / F.col("sog")), 6, "share"))


@query(
    "a32_group_season_profile",
    """WITH g AS (SELECT year(l_shipdate)::BIGINT AS season, l_returnflag AS category, count(*) AS n, CAST(sum(CAST(l_linestatus = 'F' AS BIGINT)) AS BIGINT) AS hits FROM lineitem GROUP BY 1, 2)
SELECT season, category, n, round(hits / n::DOUBLE, 6) AS rate, round(n / sum(n) OVER (PARTITION BY season)::DOUBLE, 6) AS share FROM g""",
)
def a32(t):
    rows = t.lineitem.select(
        F.year("l_shipdate").cast("bigint").alias("season"), F.col("l_returnflag").alias("category"), (F.col("l_linestatus") == "F").cast("bigint").alias("hit")
    )
    g = rows.groupBy("season", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    whole = rows.groupBy("season").agg(F.count(F.lit(1)).alias("whole"))
    return g.join(whole, "season").select(
        "season", "category", "n", r(F.col("hits") / F.col("n"), 6, "rate"), r(F.col("n") / F.col("whole"), 6, "share")
    )

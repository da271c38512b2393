"""Sequential features, regression on segments, probability models."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.functions.classify import drop_reason
from stintflow.operators import block_ridge, events, modeling, regression, segments
from stintflow.operators.tables import map_with_default
from stintflow.plans.bindings import cte, position_of
from stintflow.plans.q_intervals import SEG_KEYS, STINT_STATS, goal_deltas, stint_cte, stint_stats
from stintflow.plans.registry import query
from stintflow.plans.shape import big, r
from stintflow.scale import Running, range_placed, running
from stintflow.session import cut_lineage

TYPE_OF = {"purchase": "goal", "click": "shot-on-goal", "view": "missed-shot", "signup": "faceoff", "error": "hit"}
TYPE_NAMES = ["none", *events.SHOT_TYPE_IDS]


def play_list(t):
    """Events with every skip rule in play: absent teams, empty nets, absent coordinates and zones."""
    k = F.col("k")
    zone = F.when(k % 3 == 0, "O").when(k % 3 == 1, "N").otherwise("D")
    code = F.when(k % 13 == 0, "0550").when(k % 13 == 1, "155").otherwise("1551")
    kind = map_with_default(F.col("event_type"), TYPE_OF, "other")
    return t.plays.select(
        "event_id",
        "game_id",
        "abs_secs",
        "period",
        kind.alias("type"),
        F.when(k % 17 != 0, F.col("team_id")).alias("team_id"),
        "home_team_id",
        F.when(k % 19 != 0, zone).alias("zone"),
        code.alias("situation_code"),
        F.when(k % 11 != 0, k - 50).alias("x"),
        (k * 7 % 85 - 42).alias("y"),
        F.element_at(F.array(*[F.lit(n) for n in TYPE_NAMES]), (k % 12 + 1).cast("int")).alias("shot_type"),
        F.col("player_id").alias("shooter_id"),
    )


PLAY_LIST = """SELECT event_id, game_id, abs_secs, period, CASE event_type WHEN 'purchase' THEN 'goal' WHEN 'click' THEN 'shot-on-goal' WHEN 'view' THEN 'missed-shot' WHEN 'signup' THEN 'faceoff' ELSE 'hit' END AS type,
  CASE WHEN k % 17 <> 0 THEN team_id END AS team_id, home_team_id, CASE WHEN k % 19 <> 0 THEN CASE k % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'N' ELSE 'D' END END AS zone,
  CASE k % 13 WHEN 0 THEN '0550' WHEN 1 THEN '155' ELSE '1551' END AS code, CASE WHEN k % 11 <> 0 THEN k - 50 END AS x, k * 7 % 85 - 42 AS y, k % 12 AS shot_type_id, player_id AS shooter_id FROM plays"""
FEATURE_CTES = {
    "pl": PLAY_LIST,
    "c": """SELECT *, type IN ('goal', 'shot-on-goal', 'missed-shot') AS is_shot, coalesce(team_id = home_team_id, false) AS is_home FROM pl""",
    "d": """SELECT *, is_shot AND team_id IS NOT NULL AND NOT (length(code) = 4 AND (CASE WHEN is_home THEN substr(code, 1, 1) ELSE substr(code, 4, 1) END) = '0') AND x IS NOT NULL AS counted,
  is_shot AND (team_id IS NOT NULL OR type <> 'missed-shot') AS marks FROM c""",
    "e": """SELECT *, lag(abs_secs) OVER w AS p_secs, lag(zone) OVER w AS p_zone, lag(type) OVER w AS p_type, lag(team_id) OVER w AS p_team,
  last_value(CASE WHEN marks THEN abs_secs END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_shot,
  coalesce(sum(CASE WHEN counted AND type = 'goal' THEN CASE WHEN is_home THEN 1 ELSE -1 END ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead
FROM d WINDOW w AS (PARTITION BY game_id ORDER BY abs_secs, event_id)""",
    "f": """SELECT event_id, (CASE WHEN x < 0 THEN -x ELSE x END)::BIGINT AS x_norm, (CASE WHEN x < 0 THEN -y ELSE y END)::BIGINT AS y_norm, shot_type_id,
  CAST(coalesce(abs_secs - p_secs <= 4 AND (CASE WHEN p_team IS NOT DISTINCT FROM team_id THEN p_zone ELSE CASE p_zone WHEN 'O' THEN 'D' WHEN 'D' THEN 'O' ELSE p_zone END END) IN ('N', 'D'), false) AS BIGINT) AS is_rush,
  CAST(coalesce(abs_secs - p_secs <= 3 AND p_type IN ('goal', 'shot-on-goal', 'missed-shot') AND p_team IS NOT DISTINCT FROM team_id, false) AS BIGINT) AS is_rebound,
  least(600, coalesce(abs_secs - last_shot, 9999)) AS time_since_last_shot, greatest(-3, least(3, CASE WHEN is_home THEN lead ELSE -lead END))::BIGINT AS score_state,
  is_home::BIGINT AS is_home, CAST(type = 'goal' AS BIGINT) AS is_goal, CAST(type <> 'missed-shot' AS BIGINT) AS on_goal, shooter_id FROM e WHERE counted""",
}


@query("k6_sequential_event_features", cte("plays", **FEATURE_CTES) + "SELECT * FROM f")
def k6(t):
    rows = events.sequential_shot_features(play_list(t), ["abs_secs", "event_id"])
    cols = (
        "event_id x_norm y_norm shot_type_id is_rush is_rebound time_since_last_shot score_state is_home is_goal on_goal shooter_id"
    ).split()
    return rows.select(*[big(c) if c == "shot_type_id" else F.col(c) for c in cols])


@query(
    "k7_shot_model_table",
    cte("plays", s="SELECT event_id, game_id, abs_secs, period, player_id AS shooter_id, k % 12 AS sid, k * 7 % 85 - 42 AS y, 2 + k % 6 AS sf, 2 + (k // 6) % 6 AS sa FROM plays",
        m="SELECT sid AS mode FROM s WHERE sid <> 0 GROUP BY 1 ORDER BY count(*) DESC, sid LIMIT 1")
    + """SELECT event_id, CASE WHEN sid = 0 THEN mode ELSE sid END AS shot_type_id, sid = 0 AS shot_type_imputed, abs(y) AS abs_y_norm, abs_secs - (period - 1) * 1200 AS time_in_period,
  CASE WHEN shooter_id % 5 = 0 THEN NULL WHEN (shooter_id % 2 = 0 AND y < 0) OR (shooter_id % 2 = 1 AND y > 0) THEN 1e0 ELSE 0e0 END AS off_wing,
  CASE WHEN sf < 3 OR sf > 6 OR sa < 3 OR sa > 6 OR abs(sf - sa) > 2 OR sa = 6 THEN 'garbage_strength_state' END AS train_drop_reason, CAST(game_id // 1000000000 AS VARCHAR) AS game_date FROM s, m""",
)
def k7(t):
    k = F.col("k")
    shots = t.plays.select(
        "event_id", "game_id", "abs_secs", "period", F.col("player_id").alias("shooter_id"), (k % 12).alias("shot_type_id"),
        (k * 7 % 85 - 42).alias("y_norm"), (2 + k % 6).alias("skaters_for"), (2 + F.expr("k div 6") % 6).alias("skaters_against"),
    )
    hands = t.plays.select("player_id").distinct().where("player_id % 5 <> 0").select(
        "player_id", F.when(F.col("player_id") % 2 == 0, "L").otherwise("R").alias("shoots")
    )
    dates = t.plays.select("game_id").distinct().select("game_id", F.expr("string(game_id div 1000000000)").alias("game_date"))
    return events.shot_model_table(shots, hands, dates).select(
        "event_id", "shot_type_id", "shot_type_imputed", "abs_y_norm", "time_in_period", "off_wing", "train_drop_reason", "game_date"
    )


def player_segments(t):
    rows = segments.score_diff_at_start(stint_stats(t), goal_deltas(t), ["game_id"])
    return cut_lineage(
        rows.where("size(home_ids) > 0 AND size(away_ids) > 0").select(
            F.concat_ws("-", "game_id", "period", "start_secs").alias("row_id"),
            F.col("game_id").alias("grp"),
            "home_ids",
            "away_ids",
            F.col("duration_secs").alias("secs"),
            "score_diff",
            F.col("home_xg_c").alias("home_value"),
            F.col("away_xg_c").alias("away_value"),
            "home_goals",
            "away_goals",
            "home_goalie",
            "away_goalie",
        )
    )


def player_design(t):
    """The design of all segments, the index of all their members, their number, and the segments."""
    rows = player_segments(t)
    members = rows.select(F.explode(F.concat("home_ids", "away_ids")).alias("player_id"))
    index = cut_lineage(regression.column_index(members, "player_id"))
    n = index.count()
    # norms, pair sums, folds and errors each read the design
    return cut_lineage(regression.two_row_design(rows, index, n, more={"goals": ("home_goals", "away_goals")})), index, n, rows


DESIGN_CTES = {
    "stats": STINT_STATS,
    "sd": """SELECT s.game_id, s.period, s.start_secs, coalesce(sum(CASE WHEN p.team_id = p.home_team_id THEN 1 WHEN p.team_id IS NOT NULL THEN -1 END), 0) AS d
FROM stints s LEFT JOIN shots p ON p.game_id = s.game_id AND p.is_goal = 1 AND p.abs_secs <= s.start_secs GROUP BY 1, 2, 3""",
    "base": "SELECT *, game_id || '-' || period || '-' || start_secs AS rid FROM stats JOIN sd USING (game_id, period, start_secs) WHERE home_ids <> '' AND away_ids <> ''",
    "rws": """SELECT rid || 'h' AS id, duration_secs AS w, home_xg_c AS v, home_ids AS o, away_ids AS e, d, 1 AS h FROM base UNION ALL
  SELECT rid || 'a', duration_secs, away_xg_c, away_ids, home_ids, -d, 0 FROM base""",
    "ix": """SELECT m, row_number() OVER (ORDER BY m) - 1 AS idx, count(*) OVER () AS n FROM (
  SELECT DISTINCT CAST(unnest(string_split(home_ids || ',' || away_ids, ',')) AS BIGINT) AS m FROM base)""",
    "terms": """SELECT id, w, v, 0::BIGINT AS col FROM rws UNION ALL SELECT id, w, v, 1 FROM rws WHERE h = 1
  UNION ALL SELECT id, w, v, CASE WHEN d >= 2 THEN 2 WHEN d = 1 THEN 3 WHEN d = -1 THEN 4 ELSE 5 END FROM rws WHERE d <> 0
  UNION ALL SELECT id, w, v, 6 + idx FROM (SELECT *, CAST(unnest(string_split(o, ',')) AS BIGINT) AS m FROM rws) JOIN ix USING (m)
  UNION ALL SELECT id, w, v, 6 + n + idx FROM (SELECT *, CAST(unnest(string_split(e, ',')) AS BIGINT) AS m FROM rws) JOIN ix USING (m)""",
}


@query(
    "k8_sparse_design",
    stint_cte(**DESIGN_CTES)
    + "SELECT id AS row_id, round(v / w::DOUBLE * 3600, 4) AS y, w::DOUBLE AS w, count(*) AS n_terms, CAST(sum(col) AS BIGINT) AS col_sum FROM terms GROUP BY id, v, w",
)
def k8(t):
    cols = F.aggregate("terms", F.lit(0).cast("bigint"), lambda acc, x: acc + x["col"])
    return player_design(t)[0].select("row_id", r("y", 4, "y"), "w", F.size("terms").cast("bigint").alias("n_terms"), cols.alias("col_sum"))


@query(
    "k9_gram_matrix",
    stint_cte(**DESIGN_CTES)
    + """SELECT a.col AS i, b.col AS j, round(CAST(sum(a.w) AS BIGINT)::DOUBLE, 3) AS v FROM terms a JOIN terms b ON a.id = b.id AND a.col <= b.col GROUP BY 1, 2
UNION ALL SELECT col, -1, round(CAST(sum(v) AS BIGINT) * 3600e0, 3) FROM terms GROUP BY 1""",
)
def k9(t):
    return regression.gram(player_design(t)[0]).select("i", "j", r("v", 3, "v"))


SEASON_WEIGHTS = {0: 1.0, 1: 0.75}  # the third season has the default
LEAST_SECS = 40000


@query(
    "k8_seasons_design",
    stint_cte(
        **DESIGN_CTES,
        mt="SELECT m, sum(duration_secs) AS toi FROM (SELECT duration_secs, CAST(unnest(string_split(home_ids || ',' || away_ids, ',')) AS BIGINT) AS m FROM base) GROUP BY 1",
        qx=f"SELECT m, row_number() OVER (ORDER BY m) - 1 AS idx, count(*) OVER () AS n FROM mt WHERE toi >= {LEAST_SECS}",
        sg="""SELECT *, CASE (game_id // 1000000000) % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.75e0 ELSE 0.5e0 END * CASE WHEN abs(d) > 3 THEN 0.5e0 ELSE 1 END AS w,
  greatest(-3000, least(3000, coalesce(((home_goalie * 7) % 11 - 5) * 1000, 0))) AS hg, greatest(-3000, least(3000, coalesce(((away_goalie * 7) % 11 - 5) * 1000, 0))) AS ag,
  home_xg_c / duration_secs::DOUBLE * 3600 AS hv, away_xg_c / duration_secs::DOUBLE * 3600 AS av FROM base""",
        tw="""SELECT rid || 'h' AS id, w, hv AS y, greatest(0, av - hg) AS z, home_ids AS o, away_ids AS e FROM sg
  UNION ALL SELECT rid || 'a', w, av, greatest(0, hv - ag), away_ids, home_ids FROM sg""",
        tt="""SELECT id, w, y, z, idx AS col FROM (SELECT *, CAST(unnest(string_split(o, ',')) AS BIGINT) AS m FROM tw) JOIN qx USING (m)
  UNION ALL SELECT id, w, y, z, n + idx FROM (SELECT *, CAST(unnest(string_split(e, ',')) AS BIGINT) AS m FROM tw) JOIN qx USING (m)""",
    )
    + """SELECT a.col AS i, b.col AS j, round(sum(a.w), 3) AS v FROM tt a JOIN tt b ON a.id = b.id AND a.col <= b.col GROUP BY 1, 2
UNION ALL SELECT col, -1, round(sum(w * y), 3) FROM tt GROUP BY 1 UNION ALL SELECT col, -2, round(sum(w * z), 3) FROM tt GROUP BY 1""",
)
def k8s(t):
    rows = player_segments(t).withColumn("season", F.expr("int((grp div 1000000000) % 3)"))
    spread = rows.select("secs", F.explode(F.concat("home_ids", "away_ids")).alias("player_id"))
    members = spread.groupBy("player_id").agg(F.sum("secs").alias("toi")).where(F.col("toi") >= LEAST_SECS)
    index = cut_lineage(regression.column_index(members, "player_id"))
    goalies = t.goalies.select(F.col("player_id").alias("goalie"), (((F.col("player_id") * 7) % 11 - 5) * 1000.0).alias("adjust"))
    design = regression.seasons_design(rows, index, index.count(), goalies, SEASON_WEIGHTS, 0.5, 3000.0)
    return regression.gram(design, [], ["y", "y_against"]).select("i", "j", r("v", 3, "v"))


GRID = [8000.0, 32000.0, 128000.0, 512000.0]
LAMBDA = 32000.0
KAPPA = 0.75
KAPPAS = [0.0, 0.25, 0.5, 0.75, 1.0]
FOLDS = 5
WIDEN = 2


def penalised():
    return F.col("i") >= regression.COVARIATES


def units_per_hour(design):
    """Targets in whole units, from hundredths."""
    return design.withColumn("y", F.col("y") / 100.0)


def slope_prior(n, name="prior", low=-5.0, high=5.0):
    """``i, prior``: a prior that rises along the index, for both blocks; covariates have none."""
    step = (high - low) / (2 * n - 1)
    return lambda spark: spark.range(2 * n).select((F.col("id") + regression.COVARIATES).alias("i"), (F.lit(low) + F.col("id") * step).alias(name))


FOLDS_CTE = """SELECT game_id, CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS fold FROM (
  SELECT game_id, row_number() OVER (ORDER BY count(*) DESC, game_id) - 1 AS p FROM base GROUP BY 1)"""

# What the ridge twins share: targets of whole units, parts, sums per subset of parts, and conjugate gradients step by step.
RIDGE_CTES = {
    "tp": "SELECT t.id, t.w, t.v, t.col, p.part FROM terms t JOIN parts p ON p.game_id = CAST(split_part(t.id, '-', 1) AS BIGINT)",
    "gp": "SELECT a.part, a.col AS i, b.col AS j, sum(a.w)::DOUBLE AS v FROM tp a JOIN tp b ON a.id = b.id GROUP BY 1, 2, 3",
    "bp": "SELECT part, col AS i, sum(v) * 36e0 AS b FROM tp GROUP BY 1, 2",
    "e": "SELECT u, i, j, sum(v) AS v FROM gp JOIN subsets USING (part) GROUP BY 1, 2, 3",
    "prior": "SELECT 6 + k AS i, -5 + k * (10e0 / (2 * n - 1)) AS v FROM (SELECT unnest(range(2 * n)) AS k, n FROM (SELECT max(n) AS n FROM ix))",
    "cols": "SELECT DISTINCT i FROM gp",
}
CG_STEPS = 60


def cg_ctes(systems: str, rhs: str) -> dict[str, str]:
    """CTEs up to ``sol``: ``s, i, x``; ``systems`` selects ``s, u, lam, kind`` and ``rhs`` selects ``u, kind, i, b``."""
    step = {
        "systems": systems,
        "rhs": rhs,
        "z0": """SELECT *, CASE WHEN d > 0 THEN r / d ELSE 0 END AS p FROM (
  SELECT s, y.u, lam, c.i, (c.i >= 6)::BIGINT AS pen, coalesce(e.v, 0) + lam * (c.i >= 6)::BIGINT AS d, 0e0 AS x, coalesce(b, 0e0) AS r
  FROM systems y CROSS JOIN cols c LEFT JOIN e ON e.u = y.u AND e.i = c.i AND e.j = c.i LEFT JOIN rhs ON rhs.u = y.u AND rhs.kind = y.kind AND rhs.i = c.i)""",
    }
    for k in range(CG_STEPS):
        step[f"m{k}"] = f"SELECT s, e.i, sum(e.v * z.p) AS m FROM z{k} z JOIN e ON e.u = z.u AND e.j = z.i GROUP BY 1, 2"
        step[f"q{k}"] = f"SELECT z.*, coalesce(m, 0) + z.lam * z.pen * z.p AS q FROM z{k} z LEFT JOIN m{k} m ON m.s = z.s AND m.i = z.i"
        step[f"a{k}"] = f"SELECT s, sum(CASE WHEN d > 0 THEN r * r / d ELSE 0 END) AS rr, sum(p * q) AS pq FROM q{k} GROUP BY 1"
        step[f"n{k}"] = f"""SELECT q.s, u, lam, i, pen, d, x + al * p AS x, r - al * q AS r, p, rr FROM q{k} q
  JOIN (SELECT s, rr, CASE WHEN pq > 0 THEN rr / pq ELSE 0 END AS al FROM a{k}) USING (s)"""
        step[f"z{k + 1}"] = f"""SELECT s, u, lam, i, pen, d, x, r, CASE WHEN d > 0 THEN r / d ELSE 0 END + be * p AS p FROM n{k} JOIN (
  SELECT s, CASE WHEN max(rr) > 0 THEN sum(CASE WHEN d > 0 THEN r * r / d ELSE 0 END) / max(rr) ELSE 0 END AS be FROM n{k} GROUP BY 1) USING (s)"""
    return step | {"sol": f"SELECT s, i, x FROM z{CG_STEPS}"}


def ridge_cte(parts: str, subsets: str, systems: str, rhs: str, **more: str) -> str:
    """The chain of CTEs from the design to the solutions, each evaluated once."""
    chain = stint_cte(**DESIGN_CTES, parts=parts, subsets=subsets, **RIDGE_CTES, **cg_ctes(systems, rhs), **more)
    return chain.replace(" AS (", " AS MATERIALIZED (")


@query(
    "k9_k13_ridge_with_prior",
    ridge_cte(
        "SELECT DISTINCT game_id, 0 AS part FROM base",
        "SELECT 0 AS u, 0 AS part",
        f"SELECT s, 0 AS u, {LAMBDA}e0 AS lam, kind FROM (VALUES (0, 'y'), (1, 'prior'), (2, 'goals')) t(s, kind)",
        """SELECT 0 AS u, 'y' AS kind, i, b FROM bp UNION ALL SELECT 0, 'prior', e.i, sum(e.v * p.v) FROM e JOIN prior p ON p.i = e.j GROUP BY e.i
  UNION ALL SELECT 0, 'goals', col, CAST(sum(CASE WHEN right(id, 1) = 'h' THEN home_goals ELSE away_goals END) AS BIGINT) * 3600e0
    FROM terms JOIN base ON rid = left(id, length(id) - 1) GROUP BY col""",
        beta=f"""SELECT s.i, max(x) FILTER (s = 0) + {KAPPA} * (coalesce(max(p.v), 0) - max(x) FILTER (s = 1)) AS xg,
  max(x) FILTER (s = 2) AS goals, coalesce(max(p.v), 0) AS prior FROM sol s LEFT JOIN prior p USING (i) GROUP BY 1""",
        toi="""SELECT m, CAST(sum(duration_secs) AS BIGINT) AS toi FROM (SELECT duration_secs, CAST(unnest(string_split(home_ids || ',' || away_ids, ',')) AS BIGINT) AS m FROM base) GROUP BY 1""",
        tm="""SELECT m, string_agg(team, '/' ORDER BY secs DESC, team) AS teams FROM (SELECT m, team, sum(duration_secs) AS secs FROM (
    SELECT duration_secs, m, m % 2 || '-' || (game_id // 100000000000) % 100 AS team
    FROM (SELECT game_id, duration_secs, CAST(unnest(string_split(home_ids || ',' || away_ids, ',')) AS BIGINT) AS m FROM base)) GROUP BY 1, 2) GROUP BY 1""",
    )
    + """SELECT ix.m AS player_id, c_name AS name, CASE ix.m % 10 WHEN 0 THEN 'G' WHEN 1 THEN 'D' WHEN 2 THEN 'D' WHEN 3 THEN 'D' WHEN 4 THEN 'C' WHEN 5 THEN 'C'
    WHEN 6 THEN 'C' WHEN 7 THEN 'L' WHEN 8 THEN 'L' ELSE 'R' END AS position, teams, round(toi / 60e0, 1) AS toi_min,
  round(o.xg, 4) AS offense, round(-d.xg, 4) AS defense, round(o.xg - d.xg, 4) AS total, round((o.xg - d.xg) * toi / 3600, 4) AS total_impact,
  round(o.prior, 4) AS prior_offense, round(-d.prior, 4) AS prior_defense, round(o.prior - d.prior, 4) AS prior_total,
  round(o.goals, 4) AS goals_offense, round(-d.goals, 4) AS goals_defense, round(o.goals - d.goals, 4) AS goals_total
FROM ix JOIN beta o ON o.i = 6 + idx JOIN beta d ON d.i = 6 + n + idx JOIN toi ON toi.m = ix.m JOIN tm ON tm.m = ix.m LEFT JOIN customer ON c_custkey = ix.m""",
)
def k9r(t):
    design, index, n, rows = player_design(t)
    goals = design.select("row_id", "grp", "w", "terms", (F.col("y") / 100.0).alias("y"), "goals").withColumn("part", F.lit(0).cast("bigint"))
    prior = slope_prior(n)(t.spark)
    moments = cut_lineage(regression.gram(goals, ["part"], ["y", "goals"]).withColumnRenamed("part", "u"))
    entries = cut_lineage(block_ridge.both_triangles(moments))
    solution = block_ridge.solve(entries, block_ridge.right_sides(moments, entries, [-1, "prior", -2], prior), [LAMBDA] * 3, penalised())
    fit = solution.join(prior, "i", "left").fillna(0.0, ["prior"]).select(
        "i", (F.col("x")[0] + KAPPA * (F.col("prior") - F.col("x")[1])).alias("xg"), F.col("x")[2].alias("goals"), "prior"
    )
    table = regression.coefficient_table(fit, index, n, ["xg", "prior", "goals"])
    spread = rows.select("grp", "secs", F.explode(F.concat("home_ids", "away_ids")).alias("player_id"))
    toi = spread.groupBy("player_id").agg(F.sum("secs").alias("toi"))
    team = F.concat_ws("-", F.col("player_id") % 2, F.expr("grp div 100000000000") % 100)
    teams = regression.ordered_list(spread.withColumn("team", team), "player_id", "team", "secs", "teams")
    named = t.customer.select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"))
    table = table.withColumn("total", F.col("xg_total"))
    table = regression.impact(table, toi, "player_id", "toi").join(teams, "player_id").join(named, "player_id", "left")
    rounded = {"xg_offense": "offense", "xg_defense": "defense", "total": "total", "total_impact": "total_impact"}
    rounded |= {f"{a}_{b}": f"{a}_{b}" for a in ("prior", "goals") for b in ("offense", "defense", "total")}
    return table.select(
        "player_id", "name", position_of("player_id").alias("position"), "teams", r(F.col("toi") / 60.0, 1, "toi_min"),
        *[r(c, 4, out) for c, out in rounded.items()],
    )


@query("k9_ridge_conjugate_gradient", stint_cte(**DESIGN_CTES) + "SELECT DISTINCT col AS i, true AS solved FROM terms")
def k9cg(t):
    g = cut_lineage(regression.gram(player_design(t)[0]))
    left = regression.residuals(g, regression.ridge_cg(g, penalised(), 8000.0, tol=1e-8), penalised(), 8000.0)
    scale = left.agg(F.max(F.abs("b")).alias("m")).scalar()
    return left.select("i", (F.abs("gap") <= 1e-6 * scale).alias("solved"))



def fold_parts(design, halves=None):
    """The design with a part per fold, or per (half, fold) where ``halves`` has ``grp, is_early``."""
    folds = modeling.assign_folds(design.select("grp"), "grp", FOLDS).select("grp", F.col("fold").alias("part"))
    tagged = units_per_hour(design).join(folds, "grp")
    if halves is None:
        return cut_lineage(tagged)
    tagged = tagged.join(halves.select("grp", "is_early"), "grp").withColumn("half", F.when(F.col("is_early"), 0).otherwise(1).cast("bigint"))
    return cut_lineage(tagged.withColumn("part", F.col("part") + FOLDS * F.col("half")))


def part_moments(tagged):
    return cut_lineage(regression.gram(tagged, ["part"])), cut_lineage(regression.target_norm(tagged, ["part"]))


# the grid goes on upwards at most WIDEN times; all of these are fitted by the twin
WIDE = [*GRID, *[GRID[-1] * 4.0**k for k in range(1, WIDEN + 1)]]


def walk_sql(by: str) -> dict[str, str]:
    """From ``errs`` (cell, kappa, lam, err) the penalties that the widening grid reaches and the best per ``by``."""
    out = {"r0": f"SELECT * FROM errs WHERE lam <= {GRID[-1]}"}
    for k in range(WIDEN):
        out[f"r{k + 1}"] = f"""SELECT * FROM r{k} UNION ALL SELECT * FROM errs WHERE lam = {WIDE[len(GRID) + k]} AND EXISTS (
  SELECT 1 FROM (SELECT arg_min(lam, err) AS b FROM r{k} GROUP BY {by}) WHERE b = {WIDE[len(GRID) + k - 1]})"""
    return out | {"best": f"SELECT {by}, arg_min(lam, err) AS lam FROM r{WIDEN} GROUP BY {by}"}


LAMS_SQL = "(VALUES " + ", ".join(f"({k}, {lam}e0)" for k, lam in enumerate(WIDE)) + ") l(k, lam)"


@query(
    "k10_ridge_cv_wmse",
    ridge_cte(
        f"SELECT game_id, fold AS part FROM ({FOLDS_CTE})",
        "SELECT a AS u, b AS part FROM range(5) x(a), range(5) y(b) WHERE a <> b",
        f"SELECT u * 100 + k AS s, u, lam, 'y' AS kind FROM range(5) x(u), {LAMS_SQL}",
        "SELECT u, 'y' AS kind, i, sum(b) AS b FROM bp JOIN subsets USING (part) GROUP BY 1, 3",
        pred="SELECT s, id, any_value(w) AS w, any_value(tp.v) AS v, sum(x) AS p FROM sol JOIN tp ON tp.part = s // 100 AND tp.col = sol.i GROUP BY 1, 2",
        fe="SELECT s // 100 AS fold, lam, sum(w * (v * 36e0 / w - p) ** 2) / sum(w) AS err, sum(w) AS weight, count(*) AS n FROM pred JOIN systems USING (s) GROUP BY 1, 2",
        errs="SELECT 0 AS cell, lam, avg(err) AS err FROM fe GROUP BY lam",
        **walk_sql("cell"),
    )
    + """SELECT lam, fold, n AS n_rows, CAST(weight AS BIGINT) AS weight, round(fe.err, 3) AS wmse, round(r.err, 3) AS mean_wmse, best.lam = r.lam AS chosen
FROM fe JOIN r"""
    + str(WIDEN)
    + """ r USING (lam), best""",
)
def k10(t):
    tagged = fold_parts(player_design(t)[0])
    g, norms = part_moments(tagged)
    found = block_ridge.search(g, norms, {0: list(range(FOLDS))}, GRID, penalised(), widen=WIDEN)
    rows = [
        (lam, part, err, found.errors[cell, lam, kappa], found.best[cell, kappa] == lam)
        for (cell, lam, kappa), each in found.folds.items()
        for part, err in each.items()
    ]
    scores = t.spark.createDataFrame(rows, "lam double, fold bigint, wmse double, mean_wmse double, chosen boolean")
    sizes = tagged.groupBy(F.col("part").alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("w").cast("bigint").alias("weight"))
    return scores.join(sizes, "fold").select("lam", "fold", "n_rows", "weight", r("wmse", 3, "wmse"), r("mean_wmse", 3, "mean_wmse"), "chosen")


def two_way(t):
    """The prior-strength test of the halves by date, with the design it ran on."""
    design, _, n, _ = player_design(t)
    games = design.select("grp").distinct().withColumn("day", F.expr("grp div 1000000000"))
    tagged = fold_parts(design, modeling.chronological_split(games, "grp", "day", 0.5))
    g, norms = part_moments(tagged)
    cells = {0: list(range(FOLDS)), 1: list(range(FOLDS, 2 * FOLDS))}
    return tagged, block_ridge.two_way_test(g, norms, cells, GRID, penalised(), KAPPAS, slope_prior(n)(t.spark), WIDEN)


HALVES_SQL = f"""SELECT game_id, fold + 5 * half AS part FROM ({FOLDS_CTE}) JOIN (
  SELECT game_id, CASE WHEN row_number() OVER (ORDER BY game_id // 1000000000, game_id) <= floor(count(*) OVER () * 0.5) THEN 0 ELSE 1 END AS half
  FROM (SELECT DISTINCT game_id FROM base)) USING (game_id)"""
# subsets 0 and 1 are the halves, 2 + p all other folds of part p's half
TWO_WAY_CTE = ridge_cte(
    HALVES_SQL,
    """SELECT part // 5 AS u, part FROM range(10) p(part) UNION ALL
  SELECT 2 + a, b FROM range(10) x(a), range(10) y(b) WHERE a <> b AND a // 5 = b // 5""",
    f"SELECT u * 1000 + k * 10 + kk AS s, u, lam, kind FROM range(12) x(u), {LAMS_SQL}, (VALUES (0, 'y'), (1, 'prior')) z(kk, kind)",
    """SELECT u, 'y' AS kind, i, sum(b) AS b FROM bp JOIN subsets USING (part) GROUP BY 1, 3
  UNION ALL SELECT u, 'prior', e.i, sum(e.v * p.v) FROM e JOIN prior p ON p.i = e.j GROUP BY u, e.i""",
    kap="SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS kappa",
    beta="""SELECT y.u, y.lam, kappa, a.i, a.x + kappa * (coalesce(p.v, 0) - b.x) AS x FROM sol a JOIN systems y ON y.s = a.s AND y.kind = 'y'
  JOIN sol b ON b.s = a.s + 1 AND b.i = a.i LEFT JOIN prior p ON p.i = a.i, kap""",
    quad="""SELECT b.u, b.lam, b.kappa, g.part, sum(g.v * b.x * c.x) AS q FROM gp g JOIN beta b ON b.i = g.i AND b.u = g.part + 2
  JOIN beta c ON c.i = g.j AND c.u = b.u AND c.lam = b.lam AND c.kappa = b.kappa GROUP BY 1, 2, 3, 4""",
    lin="SELECT b.u, b.lam, b.kappa, sum(g.b * b.x) AS l FROM bp g JOIN beta b ON b.i = g.i AND b.u = g.part + 2 GROUP BY 1, 2, 3",
    nrm="SELECT part, sum(w) AS sw, sum(v * 36e0 * v * 36e0 / w) AS yy FROM (SELECT DISTINCT part, id, w, v FROM tp) GROUP BY 1",
    errs="SELECT part // 5 AS cell, lam, kappa, avg((yy - 2 * l + q) / sw) AS err FROM quad JOIN lin USING (u, lam, kappa) JOIN nrm USING (part) GROUP BY 1, 2, 3",
    **walk_sql("cell, kappa"),
    fit="SELECT cell, kappa, i, x FROM best JOIN beta ON u = cell AND beta.lam = best.lam AND beta.kappa = best.kappa".replace("kappa, i", "best.kappa, i"),
    pred="""SELECT cell, kappa, id, any_value(CAST(split_part(id, '-', 1) AS BIGINT)) AS game_id, any_value(w) AS w, any_value(v) AS v, sum(x) AS p
  FROM fit JOIN tp ON tp.part // 5 <> cell AND tp.col = fit.i GROUP BY 1, 2, 3""",
)


@query(
    "k10_prior_strength_test",
    TWO_WAY_CTE
    + """SELECT kappa, max(lam) FILTER (cell = 0) AS lam_first, max(lam) FILTER (cell = 1) AS lam_second, round(avg(mse), 3) AS mse FROM (
  SELECT cell, kappa, sum(w * (v * 36e0 / w - p) ** 2) / sum(w) AS mse FROM pred GROUP BY 1, 2) JOIN best USING (cell, kappa) GROUP BY 1""",
)
def k10k(t):
    _, test = two_way(t)
    rows = [(k, test.search.best[0, k], test.search.best[1, k], test.errors[n]) for n, k in enumerate(KAPPAS)]
    out = t.spark.createDataFrame(rows, "kappa double, lam_first double, lam_second double, mse double")
    return out.select("kappa", "lam_first", "lam_second", r("mse", 3, "mse"))


@query(
    "k12_prior_from_rates",
    cte("skater_players", x="SELECT player_id, round(xg_c * 36e0 / icetime, 9) AS rate FROM skater_players")
    + "SELECT player_id, round((rate - (SELECT avg(rate) FROM x)) / (SELECT stddev_pop(rate) FROM x) * 0.25e0, 6) AS prior FROM x",
)
def k12(t):
    rates = t.skater_totals("player_id").select("player_id", F.round(F.col("xg_c") * 36.0 / F.col("icetime"), 9).alias("rate"))
    return regression.prior_from_rates(rates, "rate", 0.25, "prior").select("player_id", r("prior", 6, "prior"))


# the draw of modeling.poisson_weight in SQL
DRAW_SQL = "(c_custkey % 2147483647 * 48271 + rep * 69621) % 2147483647"


def replicate_ctes(source: str, reps: int, names: str) -> dict[str, str]:
    """CTE ``m``: per replicate the weighted mean of each of the columns ``names`` of ``source`` (c_custkey, w, ...)."""
    means = ", ".join(f"sum(k * {c})::DOUBLE / sum(k * w)::DOUBLE AS {c}" for c in names)
    cases = " ".join(f"WHEN u < {c!r}e0 THEN {i}" for i, c in enumerate(modeling.POISSON_CDF))
    return {
        "dr": f"SELECT *, {DRAW_SQL} AS x FROM {source}, range(1, {reps + 1}) r(rep)",
        "un": "SELECT *, ((x * x % 2147483647) * x % 2147483647 + 12345) % 2147483647 / 2147483647e0 AS u FROM dr",
        "kk": f"SELECT *, CASE {cases} ELSE {len(modeling.POISSON_CDF)} END AS k FROM un",
        "m": f"SELECT rep, {means} FROM kk GROUP BY 1",
    }


def step_down_ctes(names: str) -> dict[str, str]:
    """CTE ``pick``: the walk down from the best of ``avgs`` (one row), over ``ci`` (a, b, ci_lo, ci_hi); names ascend."""
    least = f"list_position([{', '.join(names)}], least({', '.join(names)}))"
    order = f"[{', '.join(repr(n) for n in names)}]"
    return {
        "start": f"SELECT {least} AS spot FROM avgs",
        "stay": f"SELECT max(n) AS n FROM (SELECT unnest(range(1, {len(names) + 1})) AS n), start WHERE n <= spot AND (n = 1 OR "
        f"(SELECT ci_hi FROM ci WHERE a = {order}[n] AND b = {order}[n - 1]) < 0)",
        "pick": f"SELECT CASE WHEN n = 1 OR (SELECT ci_hi FROM ci WHERE a = {order}[n] AND b = {order}[1]) < 0 THEN {order}[n] ELSE {order}[1] END AS chosen FROM stay",
    }


def pairs_sql(names: str) -> str:
    rows = [f"SELECT '{b}' AS a, '{a}' AS b, {b} - {a} AS d FROM m" for i, a in enumerate(names) for b in names[i + 1 :]]
    return f"SELECT a, b, avg(d) AS mean, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi FROM ({' UNION ALL '.join(rows)}) GROUP BY 1, 2"


STRENGTHS = "abcde"  # one letter per strength


@query(
    "k14_cluster_bootstrap_ci",
    TWO_WAY_CTE.rstrip()
    + ", "
    + ", ".join(
        f"{n} AS MATERIALIZED ({q})"
        for n, q in {
            "ge": "SELECT game_id AS c_custkey, max(gw) AS w, "
            + ", ".join(f"max(ge) FILTER (kappa = {k}) AS {c}" for c, k in zip(STRENGTHS, KAPPAS))
            + " FROM (SELECT game_id, kappa, sum(w) AS gw, sum(w * (v * 36e0 / w - p) ** 2) AS ge FROM pred GROUP BY 1, 2) GROUP BY 1",
            **replicate_ctes("ge", 1000, STRENGTHS),
            "ci": pairs_sql(STRENGTHS),
            "avgs": "SELECT "
            + ", ".join(f"avg(mse) FILTER (kappa = {k}) AS {c}" for c, k in zip(STRENGTHS, KAPPAS))
            + " FROM (SELECT cell, kappa, sum(w * (v * 36e0 / w - p) ** 2) / sum(w) AS mse FROM pred GROUP BY 1, 2)",
            **step_down_ctes(STRENGTHS),
        }.items()
    )
    + " SELECT a, b, round(mean, 3) AS mean, round(ci_lo, 3) AS ci_lo, round(ci_hi, 3) AS ci_hi, chosen FROM ci, pick",
)
def k14(t):
    tagged, test = two_way(t)
    scored_by = [test.coefs[1 - half].withColumn("half", F.lit(half).cast("bigint")) for half in (0, 1)]
    errors = cut_lineage(block_ridge.group_errors(tagged, scored_by[0].unionByName(scored_by[1]), len(KAPPAS), ["half"]))
    names = {c: f"e{k}" for k, c in enumerate(STRENGTHS)}
    ci = cut_lineage(modeling.cluster_bootstrap(errors, "grp", "w", names, reps=1000))
    chosen = modeling.step_down(ci, dict(zip(STRENGTHS, test.errors)))
    return ci.select("a", "b", *[r(c, 3, c) for c in ("mean", "ci_lo", "ci_hi")], F.lit(chosen).alias("chosen"))


ORDER_SUMS = """SELECT o_custkey AS c_custkey, count(*) AS w, CAST(sum(o_orderkey % 97) AS BIGINT) AS a, CAST(sum(o_orderkey % 89) AS BIGINT) AS b,
  CAST(sum(o_orderkey % 83) AS BIGINT) AS c FROM orders GROUP BY 1"""


def order_sums(t):
    k = F.col("o_orderkey")
    return t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("w"), F.sum(k % 97).alias("a"), F.sum(k % 89).alias("b"), F.sum(k % 83).alias("c")
    )


@query(
    "k14_bootstrap_of_orders",
    "WITH " + ", ".join(f"{n} AS ({q})" for n, q in {"g": ORDER_SUMS, **replicate_ctes("g", 200, "abc"), "ci": pairs_sql("abc")}.items())
    + " SELECT a, b, round(mean, 6) AS mean, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM ci",
)
def k14o(t):
    ci = modeling.cluster_bootstrap(order_sums(t), "o_custkey", "w", {n: n for n in "abc"}, reps=200)
    return ci.select("a", "b", *[r(c, 6, c) for c in ("mean", "ci_lo", "ci_hi")])


@query(
    "k14_step_down_choice",
    "WITH " + ", ".join(
        f"{n} AS ({q})"
        for n, q in {
            "g": ORDER_SUMS, **replicate_ctes("g", 500, "abc"), "ci": pairs_sql("abc"),
            "avgs": "SELECT sum(a)::DOUBLE / sum(w) AS a, sum(b)::DOUBLE / sum(w) AS b, sum(c)::DOUBLE / sum(w) AS c FROM g", **step_down_ctes("abc"),
        }.items()
    )
    + " SELECT a, b, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, chosen FROM ci, pick",
)
def k14s(t):
    groups = cut_lineage(order_sums(t))
    ci = cut_lineage(modeling.cluster_bootstrap(groups, "o_custkey", "w", {n: n for n in "abc"}, reps=500))
    means = groups.agg(*[(F.sum(c) / F.sum("w")).alias(c) for c in "abc"]).first().asDict()
    return ci.select("a", "b", r("ci_lo", 6, "ci_lo"), r("ci_hi", 6, "ci_hi"), F.lit(modeling.step_down(ci, means)).alias("chosen"))


FEATURES = ["qty", "disc", "tax", "price", "line", "month"]
WHOLE = modeling.BoostParams()  # up to 400 trees of depth 5; rows with is_stop end the training early


def returns(t):
    """Line items as attempts: was the item returned, with numeric features and the order as group."""
    d = F.col("l_quantity")
    return t.lineitem.select(
        F.col("l_orderkey").alias("grp"),
        "l_linestatus",
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        d.alias("qty"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_linenumber").cast("double").alias("line"),
        F.month("l_shipdate").cast("double").alias("month"),
        (F.col("l_orderkey") % 10 == 0).alias("is_stop"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_partkey").alias("part"),
        F.year("l_shipdate").alias("year"),
    )


LABELLED = "SELECT *, (l_returnflag = 'R')::BIGINT AS label FROM lineitem"


def base_loss(rows):
    """Log loss of the label's share, the score to beat."""
    p = F.avg("label")
    return rows.agg((-(p * F.log(p) + (1 - p) * F.log(1 - p))).alias("l")).scalar()


@query(
    "k16_boosted_probability",
    f"SELECT l_linestatus, count(*) AS n, CAST(sum(label) AS BIGINT) AS hits, true AS in_band, true AS better FROM ({LABELLED}) GROUP BY 1",
)
def k16(t):
    rows = returns(t)
    model = modeling.train_boosted(rows, FEATURES, "label", WHOLE, stop_flag="is_stop")
    scored = cut_lineage(modeling.score(model, rows, "p"))
    loss = scored.agg(modeling.log_loss("p", "label").alias("l")).scalar()
    return scored.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("hits"), F.avg("p").alias("p")
    ).select(
        "l_linestatus", "n", "hits", F.col("p").between(0.05, 0.6).alias("in_band"), (loss < base_loss(scored)).alias("better")
    )


TRIALS = [modeling.BoostParams(depth=d, step=step) for d in (4, 5) for step in (0.05, 0.1)]


@query("k16_grid_by_group_cv")
def k16g(t):
    """Default-size boosting over a grid, each fold stopping early on whole orders of its own, recent rows heavier."""
    brands = t.part.select(F.col("p_partkey").alias("part"), "p_brand")
    rows = returns(t).join(brands, "part").withColumn("weight", F.when(F.col("year") >= 1996, 1.0).otherwise(0.5))
    folds = modeling.assign_folds(rows.select("grp"), "grp", 5).select("grp", "fold")
    folded = cut_lineage(rows.join(folds, "grp"))
    results = modeling.grid_by_group_cv(folded, "fold", 5, FEATURES, "label", TRIALS, weight="weight", group="grp", categorical=["p_brand"])
    table = [(x.params.depth, x.params.step, f, loss, n, x.mean, k == 0) for k, x in enumerate(results) for f, (loss, n) in enumerate(x.folds)]
    return t.spark.createDataFrame(table, "depth int, step double, fold int, loss double, trees int, mean_loss double, chosen boolean")


def scored_out_of_fold(t, in_context=None):
    """Line items scored by models that did not see their order; rows ``in_context`` only train, in every fold."""
    rows = returns(t)
    pool = None if in_context is None else cut_lineage(rows.where(in_context))
    if in_context is not None:
        rows = rows.where(~in_context)
    folds = modeling.assign_folds(rows.select("grp"), "grp", 5).select("grp", "fold")
    folded = cut_lineage(rows.join(folds, "grp"))
    return cut_lineage(modeling.out_of_fold(folded, "fold", 5, FEATURES, "label", WHOLE, pool, stop_flag="is_stop"))


@query(
    "k17_isotonic_calibration",
    f"SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS hits, true AS rising, true AS keeps_sum, true AS better FROM ({LABELLED})",
)
def k17(t):
    scored = scored_out_of_fold(t)
    blocks = modeling.isotonic(scored, "oof", "label")
    cal = cut_lineage(modeling.apply_isotonic(blocks, scored, "oof", "cal"))
    line = range_placed(cal.groupBy("oof").agg(F.min("cal").alias("lo"), F.max("cal").alias("hi")), [F.col("oof")])
    before = running(line, [], F.col("_part"), ["_at"], {"top": Running("max", F.col("hi"))})
    rising = before.agg(F.coalesce(F.min(F.coalesce(F.col("lo") >= F.col("top"), F.lit(True))), F.lit(True)).alias("r")).scalar()
    square = lambda p: F.avg(F.pow(F.col(p) - F.col("label"), 2))
    return cal.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").cast("bigint").alias("hits"),
        (F.abs(F.sum("cal") - F.sum("label")) < 1e-6 * F.count(F.lit(1))).alias("keeps_sum"),
        (square("cal") <= square("oof") + 1e-12).alias("better"),
    ).withColumn("rising", rising)


@query(
    "k17_isotonic_levels",
    f"""WITH g AS (SELECT CAST(l_quantity AS BIGINT) * 10 + l_linenumber AS score, count(*) AS w, CAST(sum(label) AS BIGINT) AS y FROM ({LABELLED}) GROUP BY 1),
c AS (SELECT *, sum(w) OVER o AS cw, sum(y) OVER o AS cy, row_number() OVER o AS n FROM g WINDOW o AS (ORDER BY score)),
m AS (SELECT b.n, a.n AS s, min((b.cy - a.cy + a.y)::DOUBLE / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.n ORDER BY b.n DESC) AS least FROM c a JOIN c b ON a.n <= b.n)
SELECT score, w AS n, y AS hits, round(max(least), 9) AS level FROM m JOIN c USING (n) GROUP BY 1, 2, 3""",
)
def k17l(t):
    """Levels of the returned share over a score of many ties and reversals."""
    score = F.col("l_quantity").cast("bigint") * 10 + F.col("l_linenumber")
    rows = t.lineitem.select(score.cast("bigint").alias("score"), (F.col("l_returnflag") == "R").cast("bigint").alias("label"))
    levels = modeling.apply_isotonic(modeling.isotonic(rows, "score", "label"), rows, "score", "level")
    return levels.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"), r(F.max("level"), 9, "level"))


@query(
    "k18_group_folds",
    cte("plays", g="SELECT game_id, count(*) AS size FROM plays GROUP BY 1", o="SELECT *, row_number() OVER (ORDER BY size DESC, game_id) - 1 AS p FROM g")
    + "SELECT game_id, size, CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS fold FROM o",
)
def k18(t):
    return modeling.assign_folds(t.plays.select("game_id"), "game_id", 5)


@query(
    "k19_oof_scores",
    f"""WITH l AS ({LABELLED} WHERE l_orderkey % 5 <> 0), o AS (SELECT l_orderkey, row_number() OVER (ORDER BY count(*) DESC, l_orderkey) - 1 AS p FROM l GROUP BY 1),
f AS (SELECT l_orderkey, CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS fold FROM o)
SELECT fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS hits, true AS near_base FROM l JOIN f USING (l_orderkey) GROUP BY 1""",
)
def k19(t):
    # every fifth order is the fixed context: it trains every fold and is never scored
    scored = scored_out_of_fold(t, F.col("okey") % 5 == 0)
    return scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("hits"), modeling.log_loss("oof", "label").alias("l")
    ).select("fold", "n", "hits", (F.col("l") < 1.05 * base_loss(scored)).alias("near_base"))


@query("k20_what_if_scores", "SELECT l_linestatus, count(*) AS n, true AS is_share FROM lineitem GROUP BY 1")
def k20(t):
    rows = returns(t)
    model = modeling.train_boosted(rows, FEATURES, "label", WHOLE, stop_flag="is_stop")
    out = modeling.what_if(model, rows, "month", 6.0, "l_linestatus")
    return out.select("l_linestatus", "n", F.col("mean_p").between(0.0, 1.0).alias("is_share"))


@query("k21_feature_importance", f"SELECT unnest({FEATURES!r}) AS feature, true AS is_share, true AS sums_to_one FROM (SELECT 1)")
def k21(t):
    model = modeling.train_boosted(returns(t), FEATURES, "label", WHOLE, stop_flag="is_stop")
    table = modeling.feature_importance(model, FEATURES, t.spark)
    whole = table.agg(F.sum("importance").alias("s")).scalar()
    return table.select("feature", F.col("importance").between(0.0, 1.0).alias("is_share"), (F.abs(whole - 1.0) < 1e-6).alias("sums_to_one"))


@query("ud5_model_scoring", "SELECT l_orderkey AS grp, count(*) AS n, true AS in_range FROM lineitem GROUP BY 1")
def ud5(t):
    rows = returns(t)
    model = modeling.train_boosted(rows, FEATURES, "label", WHOLE, stop_flag="is_stop")
    return modeling.score(model, rows, "p").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), (F.min("p").between(0.0, 1.0) & F.max("p").between(0.0, 1.0)).alias("in_range")
    )


@query(
    "ud1_native_classifier",
    cte("plays", s="SELECT event_id, 2 + k % 6 AS sf, 2 + (k // 6) % 6 AS sa FROM plays")
    + "SELECT event_id, sf < 3 OR sf > 6 OR sa < 3 OR sa > 6 OR abs(sf - sa) > 2 OR sa = 6 AS garbage FROM s",
)
def ud1(t):
    rows = t.plays.select("event_id", (2 + F.col("k") % 6).alias("sf"), (2 + F.expr("k div 6") % 6).alias("sa"))
    return rows.select("event_id", drop_reason("sf", "sa").isNotNull().alias("garbage"))


@query(
    "ud2_sorted_set_aggregate",
    cte("plays") + "SELECT game_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM plays GROUP BY 1",
)
def ud2(t):
    return t.plays.groupBy("game_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))

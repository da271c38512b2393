"""Leaderboards, contract pages, goalie and team tables, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.functions import text
from stintflow.operators import attribution, contracts, intervals, quality, ratings, reports, segments, tables
from stintflow.plans.bindings import cte, position_of, position_sql
from stintflow.plans.q_aggregates import STANDINGS, WEIGHT_SQL, WEIGHTS_SHIFTED, standings
from stintflow.plans.q_filters import VALUED
from stintflow.plans.q_intervals import MEMBERS, ONICE, STINT_STATS, on_ice, stint_cte, stint_stats, stints
from stintflow.plans.q_scalars import VALUE_TABLE, rd, valued
from stintflow.plans.q_windows import MINUTES_SQL, SLOTS
from stintflow.plans.registry import query
from stintflow.plans.shape import big, div, r
from stintflow.scale import top_k, with_ordinal


@query(
    "a25_team_cap_rollup",
    cte("contracts", v=VALUED, f=VALUE_TABLE)
    + f"""SELECT team, n AS players_counted, {rd('cap')} AS total_cap, {rd('g')} AS total_gar, {rd('s')} AS total_surplus, CASE WHEN cap > 0 THEN {rd('g / cap')} ELSE 0 END AS avg_gar_per_dollar
FROM (SELECT team, count(*) AS n, round(sum(coalesce(cap_hit, 0)), 6) AS cap, round(coalesce(sum(gar), 0), 6) AS g, round(coalesce(sum(surplus_value), 0), 6) AS s FROM f GROUP BY 1)""",
)
def a25(t):
    return contracts.team_rollup(valued(t))


@query(
    "k39_contract_views",
    cte("contracts", v=VALUED, f=VALUE_TABLE)
    + """, views AS (SELECT 'best' AS view, player_id, surplus_value AS sort_value, -surplus_value AS o FROM f
UNION ALL SELECT 'def', player_id, def_gar_per_million, -def_gar_per_million FROM f WHERE coalesce(def_gar, 0) >= 1
UNION ALL SELECT 'off', player_id, off_gar_per_million, -off_gar_per_million FROM f
UNION ALL SELECT 'sustain', player_id, sustainability_score, sustainability_score FROM f
UNION ALL SELECT 'aging', player_id, surplus_value, -surplus_value FROM f WHERE age >= 30)
SELECT view, player_id, sort_value, row_number() OVER (PARTITION BY view ORDER BY o ASC NULLS LAST, player_id) AS pos FROM views""",
)
def k39(t):
    return contracts.views(valued(t))


@query(
    "k54_expiry_watch",
    cte("contracts", v=VALUED)
    + f"""SELECT player_id, gar, CASE WHEN coalesce(age, 0) + y >= 27 THEN 'UFA' ELSE 'RFA' END AS status, p AS projected_gar, {rd('p * 1.85e0')} AS projected_value,
  CASE WHEN {rd('p * 1.85e0')} >= 12 THEN 'High' WHEN {rd('p * 1.85e0')} >= 6 THEN 'Medium' WHEN p IS NOT NULL THEN 'Low' END AS priority FROM (
  SELECT *, {rd("gar * pow(0.92e0, greatest(0, least(y, age + y - CASE WHEN position = 'D' THEN 33 ELSE 30 END + 1)))")} AS p FROM (
    SELECT *, greatest(0, expiry_year - 2026) AS y FROM v WHERE contract_type = 'ELC'))""",
)
def k54(t):
    rows = t.contracts.withColumn("contract_type", contracts.contract_type("cap_hit", "age"))
    return contracts.expiry_watch(rows, 2026)


@query(
    "k55_contract_summary_text",
    cte("contracts", v=VALUED, f=VALUE_TABLE)
    + """SELECT player_id, concat_ws('; ', CASE contract_type WHEN 'ELC' THEN 'entry-level' WHEN 'Veteran' THEN 'veteran' WHEN 'Bridge' THEN 'bridge' END,
  CASE WHEN surplus_value > 5 THEN 'major surplus' WHEN surplus_value > 0 THEN 'positive surplus' WHEN surplus_value < -5 THEN 'overpay risk' WHEN surplus_value IS NOT NULL THEN 'slightly under market' END,
  CASE WHEN sustainability_score >= 3 THEN 'running hot' WHEN sustainability_score <= -3 THEN 'buy-low candidate' END, CASE WHEN age >= 32 THEN 'aging effects ahead' END) AS summary FROM f""",
)
def k55(t):
    return contracts.summary_text(valued(t))


@query(
    "k56_entity_compare",
    cte("contracts", v=VALUED, f=VALUE_TABLE, best="SELECT arg_min(gar_per_million, player_id) AS b FROM f WHERE gar_per_million > 0 AND name = 'Customer#000000007'")
    + """SELECT player_id, round(100e0 * (gar_per_million - b) / b, 4) AS pct_diff FROM f, best WHERE gar_per_million IS NOT NULL""",
)
def k56(t):
    table = valued(t)
    key = text.name_key(F.col("name"))
    anchor = table.where((F.col("gar_per_million") > 0) & (key == text.name_key(F.lit("CUSTOMER #000000007")))).agg(
        F.min_by("gar_per_million", "player_id").alias("b")
    )
    rows = table.where("gar_per_million IS NOT NULL").select("player_id", "gar_per_million").withColumn("_b", anchor.scalar())
    return rows.select("player_id", r(F.lit(100.0) * (F.col("gar_per_million") - F.col("_b")) / F.col("_b"), 4, "pct_diff"))


GOALIE_SHOTS = """SELECT p.shot_id, p.is_goal, p.xg_c, p.shot_id % 3 AS sit,
  (SELECT arg_max(i.player_id, i.dur * 1000000000 - i.player_id) FROM shifts_flagged i WHERE i.game_id = p.game_id AND i.abs_start < p.abs_secs AND p.abs_secs <= i.abs_end AND i.team_id <> p.team_id AND is_goalie) AS goalie FROM shots p"""


@query(
    "k26_k33_goalie_table",
    cte("shifts_flagged", "shots", sc=GOALIE_SHOTS, toi="SELECT player_id AS goalie, CAST(sum(dur) AS BIGINT) AS toi FROM shifts_flagged WHERE is_goalie GROUP BY 1")
    + """SELECT goalie, n_all AS all_shots, ga_all AS all_ga, round(xga_all, 6) AS all_xga, round(xga_all - ga_all, 6) AS all_gsax, round(1 - ga_all / n_all::DOUBLE, 6) AS all_sv,
  round((xga_all - ga_all) / (toi / 3600e0), 6) AS all_gsax_60, n_pk AS pk_shots, ga_pk AS pk_ga, round(CASE WHEN n_pk > 0 THEN (xga_pk - ga_pk) / n_pk * 100 END, 6) AS pk_gsax_100 FROM (
  SELECT goalie, count(*) AS n_all, CAST(sum(is_goal) AS BIGINT) AS ga_all, CAST(sum(xg_c) AS BIGINT) / 50000e0 AS xga_all, count(*) FILTER (sit = 0) AS n_pk,
    CAST(coalesce(sum(is_goal) FILTER (sit = 0), 0) AS BIGINT) AS ga_pk, CAST(coalesce(sum(xg_c) FILTER (sit = 0), 0) AS BIGINT) / 50000e0 AS xga_pk FROM sc WHERE goalie IS NOT NULL GROUP BY 1) JOIN toi USING (goalie)""",
)
def k26(t):
    faced = segments.onset_at(t.shots, t.shifts_flagged).where("goalie_against IS NOT NULL").select(
        "shot_id", F.col("goalie_against").alias("goalie")
    )
    shots = t.shots.join(faced, "shot_id").select("goalie", "is_goal", F.col("xg_c").alias("xg"), (F.col("shot_id") % 3).alias("sit"))
    toi = t.shifts_flagged.where("is_goalie").groupBy(F.col("player_id").alias("goalie")).agg(F.sum("dur").alias("toi_all"))
    toi = toi.withColumn("toi_pk", F.lit(0))
    # expected goals travel in whole hundredths and are scaled once per goalie
    g = reports.goalie_table(
        shots.withColumn("is_goal", F.col("is_goal") * 50000), toi, {"all": F.lit(True), "pk": F.col("sit") == 0}
    )
    scale = 50000.0
    return g.select(
        "goalie", "all_shots", F.expr("all_ga div 50000").alias("all_ga"), r(F.col("all_xga") / scale, 6, "all_xga"),
        r(F.col("all_gsax") / scale, 6, "all_gsax"), r(1 - F.col("all_ga") / scale / F.col("all_shots"), 6, "all_sv"),
        r(F.col("all_gsax_60") / scale, 6, "all_gsax_60"), "pk_shots", F.expr("pk_ga div 50000").alias("pk_ga"),
        r(F.col("pk_gsax_100") / scale, 6, "pk_gsax_100"),
    )



@query(
    "k25_value_above_replacement",
    cte(
        "skater_players",
        g="SELECT *, CASE WHEN position IN ('C', 'L', 'R') THEN 'F' WHEN position = 'D' THEN 'D' END AS grp, player_id % 3 AS squad FROM skater_players",
        k="SELECT *, row_number() OVER (PARTITION BY squad, grp ORDER BY icetime DESC, player_id) AS rk FROM g WHERE grp IS NOT NULL",
        rate="SELECT grp, sum(xg_c)::BIGINT / (sum(icetime)::BIGINT / 3600e0) AS rate FROM k WHERE rk > CASE WHEN grp = 'F' THEN 13 ELSE 7 END GROUP BY 1",
    )
    + """SELECT player_id, round(xg_c - coalesce((SELECT rate FROM rate WHERE rate.grp = CASE WHEN g.grp = 'D' THEN 'D' ELSE 'F' END), 0) * (icetime / 3600e0), 4) AS xgar FROM g""",
)
def k25(t):
    rows = t.skater_totals("player_id", "position").withColumn("team", F.col("player_id") % 3)
    return ratings.value_above_replacement(rows, "icetime", "xg_c").select("player_id", r("above_replacement", 4, "xgar"))


@query(
    "k29_share_of_team",
    cte("skater_summary", w=f"SELECT *, {WEIGHT_SQL} AS w FROM skater_summary WHERE situation = 'all'")
    + """SELECT p.player_id, round(p.g / t.g, 6) AS goal_share, round(p.a1 / t.a1, 6) AS p_assist_share, round(p.a2 / t.a2, 6) AS s_assist_share FROM
 (SELECT player_id, team, sum(w * goals) AS g, sum(w * a1) AS a1, sum(w * a2) AS a2 FROM w GROUP BY 1, 2) p JOIN
 (SELECT team, sum(w * goals) AS g, sum(w * a1) AS a1, sum(w * a2) AS a2 FROM w GROUP BY 1) t USING (team)""",
)
def k29(t):
    w = tables.season_weight(F.col("season"), WEIGHTS_SHIFTED)
    by_season = t.skater_totals("player_id", "team", "season")
    sums = lambda *by: by_season.groupBy(*by).agg(*[F.sum(w * F.col(c)).alias(c) for c in ("goals", "a1", "a2")])
    team = sums("team").select("team", *[F.col(c).alias(f"t_{c}") for c in ("goals", "a1", "a2")])
    names = {"goals": "goal_share", "a1": "p_assist_share", "a2": "s_assist_share"}
    return sums("player_id", "team").join(team, "team").select(
        "player_id", *[r(div(F.col(c), F.col(f"t_{c}"), 0.0), 6, n) for c, n in names.items()]
    )


def rated_players(t):
    """Players with two rates, ice time and position for the rating queries."""
    rows = t.skater_totals("player_id", "team", "position")
    return rows.select(
        "player_id", "team", "position", "gp", "icetime",
        (F.col("icetime") / 60.0).alias("toi_minutes"),
        *[F.round(F.col(c) * 3600.0 / F.col("icetime"), 9).alias(n) for n, c in RATES.items()],
        (F.col("pt") % 4 != 0).alias("pp_qualified"), (F.col("pd") % 5 != 0).alias("pk_qualified"),
    )


RATES = {
    "rapm_raw": "gf", "ixg_60": "xg_c", "ihdcf_60": "hd", "igsax_60": "goals", "rel_off_60": "cf", "rel_def_60": "fol",
    "primary_assists_60": "a1", "points_60": "a2", "pp_xgf_60": "onf_c", "pp_gae": "blk", "pk_xga_60": "ona_c", "sh_points_60": "fow",
}
RATED_SQL = (
    "SELECT player_id, team, position, gp, icetime, icetime / 60e0 AS toi_minutes, "
    + ", ".join(f"round({c} * 3600e0 / icetime, 9) AS {n}" for n, c in RATES.items())
    + ", pt % 4 <> 0 AS pp_qualified, pd % 5 <> 0 AS pk_qualified, CASE WHEN position = 'D' THEN 'D' ELSE 'F' END AS grp FROM skater_players"
)
POOL = 15000.0
PARAMS = ratings.CompositeParams(min_ev_minutes=POOL, min_replacement_minutes=15200.0)


def z_sql(value: str, mask: str, part: str = "") -> str:
    over = f"OVER ({part})"
    member = f"CASE WHEN {mask} THEN {value} END"
    return f"CASE WHEN stddev_pop({member}) {over} > 0 THEN ({value} - avg({member}) {over}) / stddev_pop({member}) {over} ELSE 0 END"


def blend_sql(value: str, mask: str) -> str:
    return f"0.4e0 * ({z_sql(value, mask)}) + 0.6e0 * ({z_sql(value, mask, 'PARTITION BY grp')})"


OK = f"toi_minutes >= {POOL}"
PPM, PKM = f"(pp_qualified AND {OK})", f"(pk_qualified AND {OK})"
COMPOSITE_CTES = {
    "rated": RATED_SQL,
    "zs": "SELECT *, "
    + ", ".join(
        [f"{blend_sql(v, OK)} AS {n}" for n, v in {"z_off": "rel_off_60", "z_def": "rel_def_60", "z_ixg": "ixg_60", "z_hd": "ihdcf_60", "z_gsax": "igsax_60", "z_pa": "primary_assists_60"}.items()]
        + [f"{blend_sql(v, PPM)} AS {n}" for n, v in {"z_ppx": "pp_xgf_60", "z_ppg": "pp_gae"}.items()]
        + [f"{blend_sql(v, PKM)} AS {n}" for n, v in {"z_pkx": "pk_xga_60", "z_shp": "sh_points_60"}.items()]
        + [f"{z_sql(v, OK)} AS {n}" for n, v in {"z_rapm": "rapm_raw", "z_pts": "points_60"}.items()]
    )
    + " FROM rated",
    "raws": """SELECT *, CASE WHEN position = 'D' THEN 0.25e0 * (z_ixg + z_hd + z_gsax + z_def) ELSE 0.4e0 * z_ixg + 0.3e0 * z_hd + 0.3e0 * z_gsax END AS r_ind,
  0.5e0 * z_off + 0.5e0 * z_def AS r_rel, 0.7e0 * z_pa + 0.3e0 * z_pts AS r_play, -0.7e0 * z_pkx + 0.3e0 * z_shp AS r_pk FROM zs""",
    "comps": f"""SELECT player_id, team, position, toi_minutes, z_rapm AS rapm, greatest(-3e0, least(3e0, CASE WHEN {OK} THEN {z_sql('r_ind', OK)} ELSE 0 END)) AS individual,
  CASE WHEN {OK} THEN {z_sql('r_rel', OK)} ELSE 0 END AS relative_xgf, greatest(-3e0, least(3e0, {z_sql('r_play', OK)})) AS playmaking,
  greatest(-3e0, least(3e0, CASE WHEN pp_qualified THEN 0.5e0 * z_ppx + 0.5e0 * z_ppg ELSE 0 END)) AS power_play,
  greatest(-3e0, least(3e0, CASE WHEN pk_qualified THEN {z_sql('r_pk', PKM)} ELSE 0 END)) AS penalty_kill FROM raws""",
    "rating": "SELECT *, 0.2e0 * rapm + 0.33e0 * individual + 0.17e0 * relative_xgf + 0.18e0 * playmaking + 0.07e0 * power_play + 0.05e0 * penalty_kill AS composite FROM comps",
}


@query(
    "k22_blended_zscore",
    cte("skater_players", rated=RATED_SQL) + f"SELECT player_id, round({blend_sql('ixg_60', OK)}, 6) AS z FROM rated",
)
def k22(t):
    rows = rated_players(t).withColumn("grp", F.when(F.col("position") == "D", "D").otherwise("F"))
    return ratings.blended_z(rows, "ixg_60", "grp", F.col("toi_minutes") >= POOL, "z").select("player_id", r("z", 6, "z"))


@query(
    "k23_composite_score",
    cte("skater_players", **COMPOSITE_CTES)
    + """SELECT player_id, round(rapm, 5) AS rapm, round(individual, 5) AS individual, round(relative_xgf, 5) AS relative_xgf, round(playmaking, 5) AS playmaking,
  round(power_play, 5) AS power_play, round(penalty_kill, 5) AS penalty_kill, round(composite, 5) AS composite FROM rating""",
)
def k23(t):
    rows = ratings.composite(rated_players(t), PARAMS)
    names = ("rapm", "individual", "relative_xgf", "playmaking", "power_play", "penalty_kill")
    return rows.select("player_id", *[r(f"{n}_component", 5, n) for n in names], r("composite_raw", 5, "composite"))


@query(
    "k24_replacement_rescale",
    cte("skater_players", **COMPOSITE_CTES, pool="SELECT composite FROM rating WHERE toi_minutes >= 15200")
    + """SELECT player_id, round((composite - (SELECT quantile_cont(composite, 0.2) FROM pool)) / (SELECT stddev_pop(composite) FROM pool) * 0.5e0, 5) AS war FROM rating""",
)
def k24(t):
    rows = ratings.composite(rated_players(t), PARAMS)
    pool = F.col("toi_minutes") >= PARAMS.min_replacement_minutes
    return ratings.replacement_rescale(rows, "composite_raw", pool, "war", PARAMS).select("player_id", r("war", 5, "war"))


def rounded_composite(t):
    rows = ratings.composite(rated_players(t), PARAMS)
    names = ("rapm", "individual", "relative_xgf", "playmaking", "power_play", "penalty_kill")
    return rows.select("player_id", "position", *[F.round(f"{n}_component", 4).alias(f"{n}_component") for n in names], F.round("composite_raw", 4).alias("composite_rating"))


COMPOSITE_ROUNDED = "SELECT player_id, position, round(composite, 4) AS c, " + ", ".join(
    f"round({n}, 4) AS {n}" for n in ("rapm", "individual", "relative_xgf", "playmaking", "power_play", "penalty_kill")
) + " FROM rating"
SIX = ("rapm", "individual", "relative_xgf", "playmaking", "power_play", "penalty_kill")


@query(
    "k38_archetype_text",
    cte("skater_players", **COMPOSITE_CTES, q=COMPOSITE_ROUNDED, p="SELECT *, (individual + playmaking + power_play) / 3 AS o, (penalty_kill + relative_xgf) / 2 AS d, CASE WHEN position = 'D' THEN 'defenseman' ELSE 'forward' END AS role, "
        + " + ".join(f"CAST({n} >= 0.3 AS INT)" for n in SIX) + " AS above, concat_ws(', ', " + ", ".join(f"CASE WHEN {n} >= 1 THEN '{n}' END" for n in SIX) + ") AS strong, concat_ws(', ', " + ", ".join(f"CASE WHEN {n} <= -0.6 THEN '{n}' END" for n in SIX) + ") AS weak FROM q")
    + """SELECT player_id, CASE WHEN c >= 1.5 THEN 'Elite' WHEN c >= 0.7 THEN 'Strong' WHEN c >= 0.2 THEN 'Solid' WHEN c >= -0.3 THEN 'Average' ELSE 'Below-average' END AS tier,
  CASE WHEN above >= 5 THEN 'two-way ' || role WHEN o > 0.8 AND d < 0.25 THEN 'offensive ' || role WHEN d > 0.6 AND o < 0.3 THEN 'defensive ' || role
    WHEN strong <> '' THEN role || ' strong in ' || strong ELSE 'balanced ' || role END AS archetype, weak FROM p""",
)
def k38(t):
    return reports.archetype(rounded_composite(t))


@query(
    "k30_team_strength_blend",
    cte(
        "skater_players",
        s=SLOTS,
        m=f"SELECT *, {MINUTES_SQL} AS mins, CASE WHEN grp = 'D' THEN CASE WHEN slot <= 4 THEN 'top_d' ELSE 'bottom_d' END ELSE CASE WHEN slot <= 6 THEN 'top6_f' ELSE 'bottom6_f' END END AS unit, hd - blk AS war FROM s",
        u="SELECT team, "
        + ", ".join(f"coalesce(sum(war * mins) FILTER (unit = '{x}') / sum(mins) FILTER (unit = '{x}')::DOUBLE, 0) AS {x}" for x in ("top6_f", "bottom6_f", "top_d", "bottom_d"))
        + " FROM m GROUP BY 1",
        k="SELECT team, hd - blk AS war, gp FROM skater_players WHERE position = 'G' QUALIFY row_number() OVER (PARTITION BY team ORDER BY gp DESC, player_id) <= 2",
        g="SELECT team, sum(war * gp)::BIGINT / sum(gp)::DOUBLE AS goalie FROM k GROUP BY 1",
        x="SELECT team, coalesce(top6_f, 0) AS top6_f, coalesce(bottom6_f, 0) AS bottom6_f, coalesce(top_d, 0) AS top_d, coalesce(bottom_d, 0) AS bottom_d, greatest(-1.5e0, least(1.5e0, coalesce(goalie, 0))) AS goalie FROM u FULL JOIN g USING (team)",
    )
    + "SELECT team, round(0.85e0 * ("
    + " + ".join(f"{w}e0 * ({z_sql(u, 'true')})" for u, w in ratings.UNIT_WEIGHTS.items())
    + "), 6) AS team_strength FROM x",
)
def k30(t):
    rows = t.skater_totals("player_id", "team", "position").withColumn("war", F.col("hd") - F.col("blk"))
    return ratings.team_strength(rows, "icetime", "war", "gp").select("team", r("team_strength", 6, "team_strength"))


@query(
    "k31_display_tables",
    cte("skater_players", q="SELECT *, CASE WHEN position = 'D' THEN 'D' WHEN position <> 'G' THEN 'F' END AS grp FROM skater_players")
    + """SELECT p.player_id, round(pct, 6) AS pctile, rk AS rank_total FROM skater_players p LEFT JOIN (
  SELECT player_id, (rank() OVER (PARTITION BY grp ORDER BY cf) + (count(*) OVER (PARTITION BY grp, cf) - 1) / 2e0) / count(*) OVER (PARTITION BY grp) * 100 AS pct FROM q WHERE grp IS NOT NULL AND gp >= 560) USING (player_id)
LEFT JOIN (SELECT player_id, rank() OVER (ORDER BY goals DESC) AS rk FROM skater_players WHERE icetime >= 900000) USING (player_id)""",
)
def k31(t):
    grp = F.when(F.col("position") == "D", "D").when(F.col("position") != "G", "F")
    rows = t.skater_totals("player_id", "position").withColumn("grp", grp)
    qualified = F.col("grp").isNotNull() & (F.col("gp") >= 560)
    a = ratings.percentile_in_group(rows, "grp", "cf", qualified, "pctile")
    b = ratings.rank_with_floor(a, "goals", F.col("icetime") >= 900000, "rank_total")
    return b.select("player_id", r("pctile", 6, "pctile"), "rank_total")


@query(
    "k47_lineup_share_allocation",
    cte(
        "skater_players",
        s=SLOTS,
        l=f"SELECT *, {MINUTES_SQL} AS mins, CASE WHEN grp = 'F' THEN (slot - 1) // 3 ELSE (slot - 1) // 2 END AS line, (hd - blk) / 10e0 AS war, goals / 1000e0 AS share, 8 + player_id % 15 AS hist FROM s",
        p="SELECT *, sum(war) OVER (PARTITION BY team, grp, line) AS lw, count(*) OVER (PARTITION BY team, grp, line) AS ln FROM l",
        q="SELECT *, greatest(0.4e0, least(2.5e0, mins / greatest(hist, 8)::DOUBLE)) AS ratio, greatest(0.7e0, least(1.4e0, 1 + 0.15e0 * (CASE WHEN ln > 1 THEN (lw - war) / (ln - 1) ELSE 0 END - 0.5e0))) AS mult FROM p",
    )
    + "SELECT player_id, round(ratio, 6) AS ratio, round(mult, 6) AS linemate_mult, round(share * ratio * mult / sum(share * ratio * mult) OVER (PARTITION BY team), 6) AS norm_share FROM q",
)
def k47(t):
    rows = t.skater_totals("player_id", "team", "position").select(
        "player_id", "team", "position", "icetime",
        ((F.col("hd") - F.col("blk")) / 10.0).alias("war"), (F.col("goals") / 1000.0).alias("share"),
        (8 + F.col("player_id") % 15).cast("double").alias("hist"),
    )
    slots = ratings.depth_slots(rows, "icetime")
    out = ratings.lineup_shares(slots, "share", "hist", "war", 0.5)
    return out.select("player_id", r("ratio", 6, "ratio"), r("linemate_mult", 6, "linemate_mult"), r("norm_share", 6, "norm_share"))


@query(
    "k32_entity_full_row",
    cte(
        "skater_summary",
        w="SELECT player_id, team, position, " + ", ".join(
            f"CAST(coalesce(sum({c}) FILTER (situation = '{s}'), 0) AS BIGINT) AS {c}_{n}"
            for s, n, cols in (("all", "a", "gp goals a1 a2 sog icetime pt"), ("5on5", "e", "icetime cf ca onf_c ona_c hd xg_c fow fol"), ("5on4", "p", "goals a1 a2 icetime"), ("4on5", "k", "icetime gf ga"))
            for c in cols.split()
        ) + " FROM skater_summary GROUP BY 1, 2, 3",
        b="""SELECT *, round(CASE WHEN cf_e + ca_e > 0 THEN 100e0 * cf_e / (cf_e + ca_e) ELSE 0 END, 4) AS cf_pct,
  round(coalesce(CASE WHEN player_id % 4 = 0 THEN 40e0 + player_id % 20 END, CASE WHEN onf_c_e + ona_c_e > 0 THEN 100e0 * onf_c_e / (onf_c_e + ona_c_e) ELSE 0 END), 4) AS xgf_pct FROM w""",
    )
    + """SELECT player_id, gp_a AS gp, goals_a + a1_a + a2_a AS points, round(100e0 * goals_a / sog_a, 4) AS shooting_pct, cf_pct, xgf_pct, round(100e0 * fow_e / (fow_e + fol_e), 4) AS zone_start_pct,
  round(xg_c_e / 100e0 / (icetime_e / 3600e0), 6) AS ixg_60, round(icetime_a / gp_a::DOUBLE / 60, 4) AS toi_per_game_min, goals_p + a1_p + a2_p AS pp_points, gf_k - ga_k AS pk_pm,
  round(icetime_p / gp_a::DOUBLE / 60, 4) AS pp_toi_per_game_min, CASE WHEN player_id % 4 = 0 THEN round(player_id / 10e0, 4) END AS model_gar,
  round(cf_pct - CASE WHEN count(*) OVER t > 1 THEN (sum(cf_pct) OVER t - cf_pct) / (count(*) OVER t - 1) END, 6) AS rel_cf_pct,
  round(xgf_pct - CASE WHEN count(*) OVER t > 1 THEN (sum(xgf_pct) OVER t - xgf_pct) / (count(*) OVER t - 1) END, 6) AS rel_xgf_pct FROM b WINDOW t AS (PARTITION BY team)""",
)
def k32(t):
    models = t.supplier.where("s_suppkey % 4 = 0").select(
        F.col("s_suppkey").alias("player_id"), (40.0 + F.col("s_suppkey") % 20).alias("model_xgf_pct"),
        F.round(F.col("s_suppkey") / 10.0, 4).alias("model_gar"),
    )
    rows = reports.full_rows(t.skater_summary, models)
    return rows.select(
        "player_id", "gp", "points", "shooting_pct", "cf_pct", "xgf_pct", "zone_start_pct", "ixg_60", "toi_per_game_min",
        "pp_points", "pk_pm", "pp_toi_per_game_min", "model_gar", r("rel_cf_pct", 6, "rel_cf_pct"), r("rel_xgf_pct", 6, "rel_xgf_pct"),
    )


@query(
    "k34_team_special_teams",
    cte("skater_lines", g="SELECT team, situation, CAST(sum(icetime) AS BIGINT) AS ice, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga FROM skater_lines GROUP BY 1, 2")
    + """SELECT team, round(p.gf / (p.ice / 3600e0), 6) AS pp_g_60, round(p.gf / (p.ice / 90e0) * 100, 6) AS pp_pct, round(k.ga / (k.ice / 3600e0), 6) AS pk_ga_60, round(100 - k.ga / (k.ice / 90e0) * 100, 6) AS pk_pct
FROM (SELECT * FROM g WHERE situation = '5on4') p FULL JOIN (SELECT * FROM g WHERE situation = '4on5') k USING (team)""",
)
def k34(t):
    at = lambda s, c: F.sum(F.when(F.col("situation") == s, F.col(c)))
    g = t.skater_totals("team", "situation").groupBy("team").agg(
        at("5on4", "icetime").alias("pi"), at("5on4", "gf").alias("pg"), at("4on5", "icetime").alias("ki"), at("4on5", "ga").alias("kg")
    )
    hours = lambda c: F.when(F.col(c) > 0, F.col(c) / 3600.0).otherwise(0.01)
    chances = lambda c: F.when(F.col(c) > 0, F.col(c) / 90.0).otherwise(1.0)
    return g.where("pi IS NOT NULL OR ki IS NOT NULL").select(
        "team", r(F.col("pg") / hours("pi"), 6, "pp_g_60"), r(F.col("pg") / chances("pi") * 100, 6, "pp_pct"),
        r(F.col("kg") / hours("ki"), 6, "pk_ga_60"), r(100 - F.col("kg") / chances("ki") * 100, 6, "pk_pct"),
    )


@query(
    "k35_head_to_head",
    cte("team_games")
    + """SELECT team, opp, count(*) FILTER (result = 'W') AS wins, count(*) FILTER (result = 'L') AS losses, count(*) FILTER (result = 'OTL') AS otl, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga,
  CAST(max(match_date) AS VARCHAR) AS last_met FROM team_games GROUP BY 1, 2""",
)
def k35(t):
    return reports.head_to_head(t.team_games)


SERIES_SQL = """SELECT CAST(n_nationkey AS BIGINT) AS team, CAST(l_linenumber AS BIGINT) AS round, count(DISTINCT l_orderkey) % 5 AS wins, count(DISTINCT l_partkey) % 4 AS opp_wins
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""


@query(
    "k36_playoff_form",
    cte("team_games", s=SERIES_SQL, last="SELECT team, max(round) AS round, arg_max(wins, round) AS wins, arg_max(opp_wins, round) AS opp_wins FROM s GROUP BY 1", cur="SELECT max(round) AS r FROM s",
        l="SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM team_games QUALIFY rn <= 10", f="""SELECT team, gf, ga, games, last_wins, CASE WHEN w1 THEN 'W' ELSE 'L' END || coalesce(CASE WHEN w1 THEN fl ELSE fw END - 1, games) AS streak FROM (SELECT team, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, count(*) AS games,
          count(*) FILTER (result = 'W') AS last_wins, arg_min(result = 'W', rn) AS w1, min(rn) FILTER (result = 'W') AS fw, min(rn) FILTER (result <> 'W') AS fl FROM l GROUP BY 1)""")
    + """SELECT team, CASE WHEN wins >= 4 OR opp_wins >= 4 THEN 'won series' WHEN wins > opp_wins THEN 'leads' WHEN wins < opp_wins THEN 'trails' ELSE 'tied' END || ' ' || wins || '-' || opp_wins || ' vs opp' AS situation, gf, ga, games, last_wins, streak
FROM last JOIN f USING (team) WHERE round = (SELECT r FROM cur) AND NOT (opp_wins >= 4)""",
)
def k36(t):
    nations = t.nation.select("n_nationkey")
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    series = rows.groupBy(
        F.col("n_nationkey").cast("bigint").alias("team"), F.col("l_linenumber").cast("bigint").alias("round")
    ).agg((F.countDistinct("l_orderkey") % 5).alias("wins"), (F.countDistinct("l_partkey") % 4).alias("opp_wins"))
    newest = series.groupBy("team").agg(F.max_by(F.struct("round", "wins", "opp_wins"), "round").alias("s")).select("team", "s.*")
    current = series.agg(F.max("round").alias("r")).scalar()
    complete = (F.col("wins") >= 4) | (F.col("opp_wins") >= 4)
    alive = newest.where((F.col("round") == current) & ~(F.col("opp_wins") >= 4))
    form = reports.last_n_form(t.team_games, 10)
    return alive.join(form.withColumnRenamed("wins", "last_wins"), "team").select(
        "team", text.series_text(F.col("wins"), F.col("opp_wins"), F.lit("opp"), complete).alias("situation"), "gf", "ga", "games", "last_wins", "streak"
    )


def bracket_sql(teams: int) -> str:
    order = ", ".join(map(str, reports.bracket_order(teams)))
    w = lambda a, b: f"coalesce((SELECT any_value(wins) FROM res WHERE team = p.{a} AND opp = p.{b}), 0)"
    parts = {
        "res": "SELECT team, opp, count(*) FILTER (result = 'W') % 6 AS wins FROM team_games GROUP BY 1, 2",
        "seeds": "SELECT team, row_number() OVER (ORDER BY sum(gf) DESC, team) AS seed FROM team_games GROUP BY 1",
        "t1": f"SELECT unnest(range({teams})) AS spot, unnest([{order}]) AS seed",
        "e1": "SELECT spot, team FROM t1 JOIN seeds USING (seed)",
    }
    rounds = teams.bit_length() - 1
    for k in range(1, rounds + 1):
        parts[f"p{k}"] = f"SELECT spot // 2 AS slot, max(team) FILTER (spot % 2 = 0) AS top, max(team) FILTER (spot % 2 = 1) AS bottom FROM e{k} GROUP BY 1"
        parts[f"s{k}"] = f"SELECT {k}::BIGINT AS round, *, CASE WHEN top IS NULL OR bottom IS NULL OR greatest(tw, bw) < 4 THEN NULL WHEN tw >= bw THEN top ELSE bottom END AS winner FROM (SELECT slot, top, bottom, {w('top', 'bottom')} AS tw, {w('bottom', 'top')} AS bw FROM p{k} p)"
        parts[f"e{k + 1}"] = f"SELECT slot AS spot, winner AS team FROM s{k}"
    rows = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, rounds + 1))
    return cte("team_games", **parts) + f"""SELECT round, CAST(slot AS BIGINT) AS slot, top, bottom, CASE WHEN top IS NULL OR bottom IS NULL THEN 0 ELSE tw END AS top_wins,
  CASE WHEN top IS NULL OR bottom IS NULL THEN 0 ELSE bw END AS bottom_wins, top IS NOT NULL AND bottom IS NOT NULL AND tw + bw > 0 AS started, winner IS NOT NULL AS complete, winner FROM ({rows})"""


@query("k36_bracket", bracket_sql(16))
def k36b(t):
    met = t.team_games.groupBy("team", "opp").agg((F.count(F.when(F.col("result") == "W", 1)) % 6).alias("wins"))
    goals = t.team_games.groupBy("team").agg(F.sum("gf").alias("gf"))
    seeds = with_ordinal(goals, [], "gf", "team", "seed", descending=True).select("seed", "team")
    return reports.bracket(seeds, met, 16)


@query(
    "k37_shot_chart_last_n",
    cte("shots", g="SELECT DISTINCT shooter_id, game_id FROM shots QUALIFY dense_rank() OVER (PARTITION BY shooter_id ORDER BY game_id DESC) <= 5")
    + "SELECT shot_id, shooter_id, game_id, is_goal FROM shots JOIN g USING (shooter_id, game_id)",
)
def k37(t):
    games = t.shots.select("shooter_id", "game_id").distinct()
    recent = top_k(games, ["shooter_id"], [F.desc("game_id")], 5).drop("rn")
    return t.shots.join(recent, ["shooter_id", "game_id"], "left_semi").select("shot_id", "shooter_id", "game_id", "is_goal")


@query(
    "k40_predicted_vs_actual",
    cte("contracts", c="SELECT player_id, position, gar AS actual, xgar AS predicted, gar - xgar AS delta FROM contracts WHERE gar IS NOT NULL")
    + """SELECT position, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(median(round(delta, 2)), 6) AS median_delta, round(stddev_samp(delta), 6) AS sd_delta,
  round(avg(abs(delta) / greatest(actual, 1)), 6) AS mean_pct FROM c GROUP BY 1""",
)
def k40(t):
    from stintflow.scale import quantiles

    rows = t.contracts.where("gar IS NOT NULL").select(
        "position", F.col("gar").alias("actual"), (F.col("gar") - F.col("xgar")).alias("delta")
    ).withColumn("d2", F.round("delta", 2))
    med = quantiles(rows, ["position"], "d2", {"m": 0.5})
    pct = F.abs("delta") / F.greatest(F.col("actual"), F.lit(1.0))
    agg = rows.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("delta"), 6, "mean_delta"), r(F.stddev_samp("delta"), 6, "sd_delta"), r(F.avg(pct), 6, "mean_pct")
    )
    return agg.join(med, "position").select("position", "n", "mean_delta", r("m", 6, "median_delta"), "sd_delta", "mean_pct")


@query(
    "k42_data_audit_coverage",
    """WITH c AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_shipdate IS NULL) AS nul FROM lineitem GROUP BY 1), e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 100 <> 7)
SELECT 'expected_keys' AS check_name, (SELECT count(*) FROM e) AS found UNION ALL SELECT 'missing_keys', (SELECT count(*) FROM e WHERE k NOT IN (SELECT k FROM c))
UNION ALL SELECT 'orphan_keys', (SELECT count(*) FROM c WHERE k NOT IN (SELECT k FROM e)) UNION ALL SELECT 'short_keys', (SELECT count(*) FROM c WHERE n < 2)
UNION ALL SELECT 'long_keys', (SELECT count(*) FROM c WHERE n > 8) UNION ALL SELECT 'null_l_shipdate', (SELECT CAST(sum(nul) AS BIGINT) FROM c)""",
)
def k42(t):
    expected = t.orders.where("o_orderkey % 100 <> 7").select(F.col("o_orderkey").alias("k"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_shipdate")
    return quality.audit_coverage(expected, rows, "k", 2, 8, ["l_shipdate"])


@query(
    "k42_duplicate_keys",
    "SELECT l_orderkey, l_linenumber::BIGINT AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def k42d(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"))
    return quality.duplicate_keys(rows, ["l_orderkey", "line"])


@query(
    "k43_team_reconciliation",
    cte("skater_players", g="SELECT team, sum(icetime * goals)::BIGINT / sum(icetime)::DOUBLE AS weighted, sum(goals)::BIGINT AS actual FROM skater_players GROUP BY 1")
    + "SELECT round(corr(weighted, actual), 6) AS corr, count(*) AS teams FROM g",
)
def k43(t):
    players = t.skater_totals("player_id", "team")
    teams = players.groupBy("team").agg(
        tables.weighted_mean(F.col("icetime"), F.col("goals")).alias("weighted"), F.sum("goals").alias("actual")
    )
    return teams.agg(r(F.corr("weighted", F.col("actual").cast("double")), 6, "corr"), F.count(F.lit(1)).alias("teams"))


@query(
    "k44_half_reliability",
    cte("skater_lines", h="SELECT player_id, sum(goals) FILTER (season < 1998)::BIGINT / nullif(count(*) FILTER (season < 1998), 0)::DOUBLE AS a, sum(goals) FILTER (season >= 1998)::BIGINT / nullif(count(*) FILTER (season >= 1998), 0)::DOUBLE AS b, count(*) AS n FROM skater_lines GROUP BY 1")
    + "SELECT round(corr(a, b), 6) AS corr, count(*) AS players FROM h WHERE n >= 100 AND a IS NOT NULL AND b IS NOT NULL",
)
def k44(t):
    early = F.col("season") < 1998
    half = lambda cond: div(F.sum(F.when(cond, F.col("goals"))).cast("double"), F.count(F.when(cond, 1)))
    rows = t.skater_lines.groupBy("player_id").agg(half(early).alias("a"), half(~early).alias("b"), F.count(F.lit(1)).alias("n"))
    kept = rows.where("n >= 100 AND a IS NOT NULL AND b IS NOT NULL")
    return kept.agg(r(F.corr("a", "b"), 6, "corr"), F.count(F.lit(1)).alias("players"))


@query(
    "k44_reliability_net_of_prior",
    cte("skater_lines", h="""SELECT player_id, sum(goals) FILTER (season < 1998)::BIGINT / nullif(count(*) FILTER (season < 1998), 0)::DOUBLE AS a,
  sum(goals) FILTER (season >= 1998)::BIGINT / nullif(count(*) FILTER (season >= 1998), 0)::DOUBLE AS b, (player_id % 7 - 3) * 0.02e0 AS p, count(*) AS n FROM skater_lines GROUP BY 1""")
    + """SELECT kappa, count(*) AS players, round(corr(a, b), 6) AS corr, round(corr(a - kappa * p, b - kappa * p), 6) AS net, round(corr(a, p), 6) AS first_prior, round(corr(b, p), 6) AS second_prior
FROM h, (SELECT unnest([0.0, 0.5, 0.75])::DOUBLE AS kappa) WHERE n >= 50 AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1""",
)
def k44n(t):
    early = F.col("season") < 1998
    half = lambda cond: div(F.sum(F.when(cond, F.col("goals"))).cast("double"), F.count(F.when(cond, 1)))
    rows = t.skater_lines.groupBy("player_id").agg(half(early).alias("a"), half(~early).alias("b"), F.count(F.lit(1)).alias("n"))
    rows = rows.where("n >= 50").withColumn("p", (F.col("player_id") % 7 - 3) * 0.02)
    out = reports.net_reliability(rows, "a", "b", "p", [0.0, 0.5, 0.75])
    return out.select("kappa", F.col("n").alias("players"), *[r(c, 6, c) for c in ("corr", "net", "first_prior", "second_prior")])


@query(
    "k48_goals_above_expected",
    cte("skater_lines")
    + f"""SELECT player_id, round(sum(w * goals) - sum(w * xg_c) / 100e0, 6) AS gae, round(coalesce(sum(w * goals) FILTER (situation = '5on4'), 0) - coalesce(sum(w * xg_c) FILTER (situation = '5on4'), 0) / 100e0, 6) AS gae_pp
FROM (SELECT *, {WEIGHT_SQL} AS w FROM skater_lines) GROUP BY 1""",
)
def k48(t):
    w = tables.season_weight(F.col("season"), WEIGHTS_SHIFTED)
    rows = t.skater_totals("player_id", "season", "situation").withColumn("w", w)
    pp = F.col("situation") == "5on4"
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col("w") * F.col(c))), F.lit(0.0))
    gae = lambda cond: total("goals", cond) - total("xg_c", cond) / 100.0
    return rows.groupBy("player_id").agg(r(gae(F.lit(True)), 6, "gae"), r(gae(pp), 6, "gae_pp"))


@query(
    "k50_onset_leaderboard",
    cte("skater_players")
    + """SELECT player_id, round(coalesce(CASE WHEN player_id % 3 = 0 THEN 50e0 + player_id % 10 END, 100e0 * onf_c / (onf_c + ona_c)), 4) AS xgf_pct, round(100e0 * cf / (cf + ca), 4) AS cf_pct
FROM skater_players WHERE icetime >= 800000 AND position IN ('C', 'L', 'R') ORDER BY xgf_pct DESC, player_id LIMIT 25""",
)
def k50(t):
    model = t.supplier.where("s_suppkey % 3 = 0").select(
        F.col("s_suppkey").alias("player_id"), (50.0 + F.col("s_suppkey") % 10).alias("model")
    )
    rows = t.skater_totals("player_id", "position").where(
        (F.col("icetime") >= 800000) & F.col("position").isin("C", "L", "R")
    ).join(model, "player_id", "left")
    return rows.select(
        "player_id",
        r(F.coalesce("model", tables.share_pct(F.col("onf_c"), F.col("ona_c"))), 4, "xgf_pct"),
        r(tables.share_pct(F.col("cf"), F.col("ca")), 4, "cf_pct"),
    ).orderBy(F.desc("xgf_pct"), "player_id").limit(25)


@query(
    "k51_profile_split",
    """SELECT o_custkey AS player_id, count(*) FILTER (o_orderstatus <> 'P') AS regular_gp, count(*) FILTER (o_orderstatus = 'P') AS playoff_gp, count(DISTINCT year(o_orderdate)) AS seasons,
  array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderdate DESC, o_orderkey DESC)[1:5], ',') AS last5 FROM orders GROUP BY 1""",
)
def k51(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    playoff = F.col("o_orderstatus") == "P"
    totals = rows.groupBy(F.col("o_custkey").alias("player_id")).agg(
        F.count(F.when(~playoff, 1)).alias("regular_gp"), F.count(F.when(playoff, 1)).alias("playoff_gp"), F.countDistinct(F.year("o_orderdate")).alias("seasons")
    )
    recent = top_k(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    listed = recent.groupBy(F.col("o_custkey").alias("player_id")).agg(F.array_sort(F.collect_list(F.struct("rn", "o_orderkey"))).alias("l"))
    text5 = F.array_join(F.transform("l", lambda e: e["o_orderkey"].cast("string")), ",")
    return totals.join(listed, "player_id").select("player_id", "regular_gp", "playoff_gp", "seasons", text5.alias("last5"))


@query(
    "k53_aligned_trajectory",
    cte("skater_lines", sp="SELECT DISTINCT season FROM skater_lines ORDER BY season DESC LIMIT 6", p="SELECT player_id, season, CAST(sum(CASE WHEN season % 3 <> player_id % 3 THEN goals END) AS BIGINT) AS goals FROM skater_lines GROUP BY 1, 2")
    + "SELECT player_id, season, goals FROM (SELECT DISTINCT player_id FROM p) CROSS JOIN sp LEFT JOIN p USING (player_id, season)",
)
def k53(t):
    # a third of the seasons have no value, as with players who sat out
    rows = t.skater_lines.withColumn("goals", F.when(F.col("season") % 3 != F.col("player_id") % 3, F.col("goals")))
    return reports.aligned_trajectory(rows, "player_id", "season", "goals", 6)


@query(
    "k57_rank_vs_benchmark",
    cte("skater_players")
    + """SELECT player_id, a AS our_rank, b AS their_rank, b - a AS delta FROM (SELECT player_id, rank() OVER (ORDER BY goals DESC) AS a, rank() OVER (ORDER BY xg_c DESC) AS b FROM skater_players)""",
)
def k57(t):
    return reports.rank_vs_benchmark(t.skater_totals("player_id"), "player_id", "goals", "xg_c")

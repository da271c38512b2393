"""Blended z-scores, the weighted composite, replacement levels and team strength."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.functions.classify import clip
from stintflow.operators.tables import pool_zscore
from stintflow.scale import quantiles, top_k, with_group_stats, with_ordinal, with_rank
from stintflow.session import cut_lineage

# Slot minutes by depth, unit weights and limits of the team model.
FORWARD_MINUTES = [22, 22, 22, 18, 18, 18, 14, 14, 14, 10, 10, 10]
DEFENSE_MINUTES = [24, 24, 20, 20, 16, 16]
UNIT_WEIGHTS = {"top6_f": 0.270, "bottom6_f": 0.162, "top_d": 0.197, "bottom_d": 0.072, "goalie": 0.300}
GOALIE_CAP = 1.5
COMPRESSION = 0.85
REPLACEMENT_RANK = {"F": 13, "D": 7}


@dataclass(frozen=True)
class CompositeParams:
    """Weights, gates and caps of the composite; other windows pass their own."""

    weights: dict[str, float] = field(
        default_factory=lambda: {
            "rapm": 0.20, "individual": 0.33, "relative_xgf": 0.17,
            "playmaking": 0.18, "power_play": 0.07, "penalty_kill": 0.05,
        }
    )
    min_ev_minutes: float = 200.0
    min_replacement_minutes: float = 500.0
    cap: float = 3.0
    blend_global: float = 0.40
    blend_position: float = 0.60
    replacement_quantile: float = 0.20
    war_unit: float = 0.5


def blended_z(df: DataFrame, value: str, group: str, in_pool: Column, out: str, params=CompositeParams()) -> DataFrame:
    """Global and group-relative z-scores of ``value`` against the reference pool, blended."""
    a = pool_zscore(df, [], value, in_pool, "_zg")
    b = pool_zscore(a, [group], value, in_pool, "_zp")
    mix = params.blend_global * F.col("_zg") + params.blend_position * F.col("_zp")
    return b.withColumn(out, mix).drop("_zg", "_zp")


def composite(df: DataFrame, params: CompositeParams = CompositeParams()) -> DataFrame:
    """Six-component rating.

    ``df`` has ``player_id, position, toi_minutes, pp_qualified, pk_qualified`` and the raw rates
    ``rapm_raw, ixg_60, ihdcf_60, igsax_60, rel_off_60, rel_def_60, primary_assists_60, points_60,
    pp_xgf_60, pp_gae, pk_xga_60, sh_points_60``. All statistics are aggregates over the pool joined
    back as single rows or per position group.
    """
    is_d = F.col("position") == "D"
    # three rounds of pool statistics follow; each would otherwise repeat the aggregation behind df
    rows = cut_lineage(df).withColumn("grp", F.when(is_d, "D").otherwise("F"))
    pool = F.col("toi_minutes") >= params.min_ev_minutes
    pp, pk = F.col("pp_qualified") & pool, F.col("pk_qualified") & pool
    blends = {
        "z_off": ("rel_off_60", pool), "z_def": ("rel_def_60", pool), "z_ixg": ("ixg_60", pool),
        "z_hd": ("ihdcf_60", pool), "z_gsax": ("igsax_60", pool), "z_pa": ("primary_assists_60", pool),
        "z_ppx": ("pp_xgf_60", pp), "z_ppg": ("pp_gae", pp), "z_pkx": ("pk_xga_60", pk), "z_shp": ("sh_points_60", pk),
    }
    plain = {"z_rapm": ("rapm_raw", pool), "z_pts": ("points_60", pool)}
    rows = _many_z(rows, {**blends, **plain}, [], "g")
    rows = _many_z(rows, blends, ["grp"], "p")
    mixed = {n: params.blend_global * F.col(f"{n}_g") + params.blend_position * F.col(f"{n}_p") for n in blends}
    rows = rows.select(*df.columns, *[c.alias(n) for n, c in mixed.items()], *[F.col(f"{n}_g").alias(n) for n in plain])
    forward = 0.40 * F.col("z_ixg") + 0.30 * F.col("z_hd") + 0.30 * F.col("z_gsax")
    defense = 0.25 * (F.col("z_ixg") + F.col("z_hd") + F.col("z_gsax") + F.col("z_def"))
    raw = {
        "individual": (F.when(is_d, defense).otherwise(forward), pool),
        "relative_xgf": (0.5 * F.col("z_off") + 0.5 * F.col("z_def"), pool),
        "playmaking": (0.70 * F.col("z_pa") + 0.30 * F.col("z_pts"), pool),
        "penalty_kill": (-0.70 * F.col("z_pkx") + 0.30 * F.col("z_shp"), pk),
    }
    rows = rows.select("*", *[e.alias(f"raw_{n}") for n, (e, _) in raw.items()])
    rows = _many_z(rows, {n: (f"raw_{n}", mask) for n, (_, mask) in raw.items()}, [], "f")
    gate = lambda cond, c: F.when(cond, c).otherwise(0.0)
    cap = lambda c: clip(c, -params.cap, params.cap)
    parts = {
        "rapm": F.col("z_rapm"),
        "individual": cap(gate(pool, F.col("individual_f"))),
        "relative_xgf": gate(pool, F.col("relative_xgf_f")),
        "playmaking": cap(F.col("playmaking_f")),
        "power_play": cap(gate(F.col("pp_qualified"), 0.5 * F.col("z_ppx") + 0.5 * F.col("z_ppg"))),
        "penalty_kill": cap(gate(F.col("pk_qualified"), F.col("penalty_kill_f"))),
    }
    rows = rows.select(*df.columns, *[e.alias(f"{n}_component") for n, e in parts.items()])
    total = sum(w * F.col(f"{n}_component") for n, w in params.weights.items())
    flag = F.when(pool, "ok").otherwise("small_sample")
    return rows.withColumn("composite_raw", total).withColumn("sample_size_flag", flag)


def _many_z(df: DataFrame, specs: dict[str, tuple[str, Column]], keys: list[str], suffix: str) -> DataFrame:
    """Several pool z-scores from one aggregate."""
    aggs = []
    for name, (value, mask) in specs.items():
        member = F.when(mask, F.col(value))
        aggs += [F.avg(member).alias(f"_mu_{name}"), F.stddev_pop(member).alias(f"_sd_{name}")]
    stats = with_group_stats(df, keys, aggs)
    zs = [
        F.when(F.col(f"_sd_{n}") > 0, (F.col(v) - F.col(f"_mu_{n}")) / F.col(f"_sd_{n}")).otherwise(0.0).alias(f"{n}_{suffix}")
        for n, (v, _) in specs.items()
    ]
    return stats.select(*df.columns, *zs)


def replacement_rescale(df: DataFrame, value: str, in_pool: Column, out: str, params=CompositeParams()) -> DataFrame:
    """``(value - replacement) / sd * unit`` where replacement is a low quantile of the pool."""
    df = cut_lineage(df)
    pool = df.where(in_pool).withColumn("_r", F.round(value, 9))
    level = quantiles(pool, [], "_r", {"q": params.replacement_quantile}).scalar()
    sd = pool.agg(F.stddev_pop(value).alias("sd")).scalar()
    rows = df.withColumn("_level", level).withColumn("_sd", sd)
    spread = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return rows.withColumn(out, (F.col(value) - F.col("_level")) / spread * params.war_unit).drop("_level", "_sd")


def value_above_replacement(df: DataFrame, toi: str, value: str) -> DataFrame:
    """Value less the rate of deep-bench players of the same group; unknown groups use the forward rate.

    ``df`` has ``player_id, team, position``. Depth is the rank by ice time within team and group.
    """
    grp = F.when(F.col("position").isin("C", "L", "R"), "F").when(F.col("position") == "D", "D")
    rows = df.withColumn("grp", grp)
    eligible = rows.where(F.col("grp").isNotNull() & F.col("team").isNotNull() & (F.col(toi) > 0))
    ranked = with_ordinal(eligible, ["team", "grp"], toi, "player_id", "team_rank", descending=True)
    bench = ranked.where(
        F.col("team_rank") > F.when(F.col("grp") == "F", REPLACEMENT_RANK["F"]).otherwise(REPLACEMENT_RANK["D"])
    )
    rates = bench.groupBy("grp").agg((F.sum(value) / (F.sum(toi) / 3600.0)).alias("rate"))
    # two rates at most, carried as one row
    one = rates.agg(
        F.struct(
            F.coalesce(F.max(F.when(F.col("grp") == "F", F.col("rate"))), F.lit(0.0)).alias("F"),
            F.coalesce(F.max(F.when(F.col("grp") == "D", F.col("rate"))), F.lit(0.0)).alias("D"),
        ).alias("s")
    ).scalar()
    base = F.when(F.col("grp") == "D", F.col("_rates.D")).otherwise(F.col("_rates.F"))
    return (
        rows.withColumn("_rates", one)
        .withColumn("above_replacement", F.col(value) - base * (F.col(toi) / 3600.0))
        .drop("_rates")
    )


def shrink(value: Column, prior: Column, exposure: Column, k: float) -> Column:
    """Pull toward the prior by exposure; without a prior the value passes through."""
    w = exposure / (exposure + k)
    return F.when(prior.isNotNull(), w * value + (1 - w) * prior).otherwise(value)


def recentre(df: DataFrame, expected: str, actual: str, out: str) -> DataFrame:
    """Scale expected values so that they sum to the actual ones, then take the difference."""
    factor = df.agg((F.sum(actual) / F.sum(expected)).alias("f")).scalar()
    return df.withColumn("_f", factor).withColumn(out, F.col(expected) * F.col("_f") - F.col(actual)).drop("_f")


def rescaled_shares(df: DataFrame, present: str, window: float, games: str, min_games: float) -> DataFrame:
    """Factor that lifts a partial history to the full window; thin histories stay as they are."""
    thin = (F.col(present) > 0) & (F.col(present) < window) & (F.col(games) >= min_games)
    return df.withColumn("rescale_factor", F.when(thin, F.lit(window) / F.col(present)).otherwise(1.0))


def thin_blend(history: Column, fitted: Column, average: Column, thin: Column, rated: Column, weight: float) -> Column:
    """History for full samples; thin ones mix in the fitted talent, or the average when unrated."""
    talent = F.when(rated, F.greatest(F.lit(0.0), fitted)).otherwise(average)
    return F.when(thin, weight * history + (1 - weight) * talent).otherwise(history)


def depth_slots(players: DataFrame, toi: str) -> DataFrame:
    """Slot index, tier and minutes per team and group by ice time; players beyond the slots are scratched.

    Only the first slots are ranked (a pruned top-k); the slot table is a literal.
    """
    grp = F.when(F.col("position") == "D", "D").when(F.col("position") != "G", "F")
    pool = players.withColumn("grp", grp).where(F.col("grp").isNotNull())
    slots = top_k(pool, ["team", "grp"], [F.desc(toi), F.asc("player_id")], len(FORWARD_MINUTES), "slot")
    slots = slots.where((F.col("grp") == "F") | (F.col("slot") <= len(DEFENSE_MINUTES)))
    minutes = lambda values: F.array(*[F.lit(v) for v in values])[F.col("slot") - 1]
    is_d = F.col("grp") == "D"
    unit = F.when(is_d, F.when(F.col("slot") <= 4, "top_d").otherwise("bottom_d")).otherwise(
        F.when(F.col("slot") <= 6, "top6_f").otherwise("bottom6_f")
    )
    return slots.withColumn(
        "slot_minutes", F.when(is_d, minutes(DEFENSE_MINUTES + [None] * 6)).otherwise(minutes(FORWARD_MINUTES))
    ).withColumn("unit", unit)


def team_strength(players: DataFrame, toi: str, war: str, games: str) -> DataFrame:
    """Slot-weighted unit averages and capped goalie blend per team, z-scored and weighted."""
    slots = depth_slots(players, toi)
    units = slots.groupBy("team").agg(
        *[
            F.coalesce(
                F.sum(F.when(F.col("unit") == u, F.col(war) * F.col("slot_minutes")))
                / F.sum(F.when(F.col("unit") == u, F.col("slot_minutes"))),
                F.lit(0.0),
            ).alias(u)
            for u in ("top6_f", "bottom6_f", "top_d", "bottom_d")
        ]
    )
    keepers = top_k(players.where("position = 'G'"), ["team"], [F.desc(games), F.asc("player_id")], 2, "_rn")
    blend = keepers.groupBy("team").agg(
        F.when(F.sum(games) > 0, F.sum(F.col(war) * F.col(games)) / F.sum(games)).otherwise(0.0).alias("goalie")
    )
    raw = units.join(blend, "team", "full").select(
        "team",
        *[F.coalesce(u, F.lit(0.0)).alias(u) for u in ("top6_f", "bottom6_f", "top_d", "bottom_d")],
        clip(F.coalesce("goalie", F.lit(0.0)), -GOALIE_CAP, GOALIE_CAP).alias("goalie"),
    )
    scored = _many_z(raw, {u: (u, F.lit(True)) for u in UNIT_WEIGHTS}, [], "z")
    total = sum(w * F.col(f"{u}_z") for u, w in UNIT_WEIGHTS.items())
    return scored.withColumn("team_strength", total * COMPRESSION)


def lineup_shares(slots: DataFrame, share: str, hist_toi: str, war: str, baseline: float) -> DataFrame:
    """Share per slot scaled by minutes and line mates, normalised to 1 within the team.

    A team holds at most eighteen slots, so its window is bounded.
    """
    line = F.when(F.col("grp") == "F", F.floor((F.col("slot") - 1) / 3)).otherwise(F.floor((F.col("slot") - 1) / 2))
    rows = slots.withColumn("line", line)
    lines = rows.groupBy("team", "grp", "line").agg(F.sum(war).alias("_w"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(lines, ["team", "grp", "line"])
    peers = F.when(F.col("_n") > 1, (F.col("_w") - F.col(war)) / (F.col("_n") - 1)).otherwise(0.0)
    mates = clip(1.0 + 0.15 * (peers - baseline), 0.70, 1.40)
    ratio = clip(F.col("slot_minutes") / F.greatest(F.col(hist_toi), F.lit(8.0)), 0.40, 2.5)
    rows = rows.withColumn("ratio", ratio).withColumn("linemate_mult", mates)
    rows = rows.withColumn("_s", F.col(share) * F.col("ratio") * F.col("linemate_mult"))
    whole = rows.groupBy("team").agg(F.sum("_s").alias("_t"))
    norm = F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(F.col("_s"))
    return rows.join(whole, "team").withColumn("norm_share", norm).drop("_w", "_n", "_s", "_t")


def percentile_in_group(df: DataFrame, group: str, value: str, qualified: Column, out: str) -> DataFrame:
    """Average-tie percentile within the group's qualified rows; others null."""
    ranked = with_rank(df.withColumn("_q", F.when(qualified, F.col(value))), [group], "_q", "_p", "pct")
    return ranked.withColumn(out, F.col("_p") * 100).drop("_q", "_p")


def rank_with_floor(df: DataFrame, value: str, eligible: Column, out: str) -> DataFrame:
    """Competition rank among eligible rows, best first; rows below the floor stay with null."""
    return with_rank(df.withColumn("_q", F.when(eligible, F.col(value))), [], "_q", out, "min", descending=True).drop("_q")

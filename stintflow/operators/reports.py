"""Report tables: game score, goalie tables, full rows, team pages, form and comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.operators.tables import leave_one_out, per_60, share_pct
from stintflow.scale import Running, running, top_k, with_ranks

# Game-score weight per counted event.
GAME_SCORE = {
    "goals": 0.75, "a1": 0.70, "a2": 0.55, "sog": 0.075, "blk": 0.075, "pim": 0.05, "pd": 0.15, "pt": -0.15,
    "fow": 0.01, "fol": -0.01, "cf": 0.05, "ca": -0.05, "gf": 0.15, "ga": -0.15,
}


def game_score(rows: DataFrame) -> DataFrame:
    """Weighted sum of counts, and per game; the weights act in thousandths so the sum stays whole."""
    milli = sum(int(round(w * 1000)) * F.col(c) for c, w in GAME_SCORE.items())
    per = F.when(F.col("gp") > 0, F.bround(F.col("game_score") / F.col("gp"), 3)).otherwise(0.0)
    return rows.withColumn("game_score", F.bround(milli / 1000.0, 2)).withColumn("per_game", per)


def quality_starts(games: DataFrame, goalie: str, shots: str, allowed: str) -> DataFrame:
    """Starts, quality starts and their rate; games without shots do not count as starts."""
    save = 1 - F.col(allowed) / F.col(shots)
    good = (save >= 0.917) | (F.col(allowed) <= 2)
    g = games.where(F.col(shots) >= 1).groupBy(goalie).agg(
        F.count(F.lit(1)).alias("starts"), F.count(F.when(good, 1)).alias("qs")
    )
    return g.withColumn("qs_pct", F.round(F.lit(100.0) * F.col("qs") / F.col("starts"), 1))


def goalie_table(shots: DataFrame, toi: DataFrame, situations: dict[str, Column]) -> DataFrame:
    """Shots, goals, expected goals, saves above expected and rates per goalie and situation, in one pass.

    ``shots`` has ``goalie, is_goal, xg``; ``toi`` has ``goalie`` and ``toi_<situation>`` seconds.
    """
    aggs = []
    for name, cond in situations.items():
        aggs += [
            F.count(F.when(cond, 1)).alias(f"{name}_shots"),
            F.coalesce(F.sum(F.when(cond, F.col("is_goal"))), F.lit(0)).alias(f"{name}_ga"),
            F.coalesce(F.sum(F.when(cond, F.col("xg"))), F.lit(0)).alias(f"{name}_xga"),
        ]
    g = shots.groupBy("goalie").agg(*aggs).join(toi, "goalie", "left")
    out = [F.col("goalie")]
    for name in situations:
        n, ga, xga = F.col(f"{name}_shots"), F.col(f"{name}_ga"), F.col(f"{name}_xga")
        secs = F.coalesce(f"toi_{name}", F.lit(0))
        per_shot = lambda v: F.when(n > 0, v / n)
        gsax = xga - ga
        out += [
            n, ga, xga, gsax.alias(f"{name}_gsax"), (1 - per_shot(ga)).alias(f"{name}_sv"),
            (1 - per_shot(xga)).alias(f"{name}_xsv"), (per_shot(gsax) * 100).alias(f"{name}_gsax_100"),
            F.when(secs > 0, gsax / (secs / 3600.0)).alias(f"{name}_gsax_60"),
        ]
    return g.select(*out)


def full_rows(situations: DataFrame, models: DataFrame) -> DataFrame:
    """One wide row per player from the four situation rows plus model lookups, with team-relative shares.

    Situations widen by one conditional aggregate; relative metrics leave the player out of the team mean.
    """
    pick = lambda sit, c: F.coalesce(F.sum(F.when(F.col("situation") == sit, F.col(c))), F.lit(0))
    need = {
        "all": ["gp", "goals", "a1", "a2", "sog", "icetime", "pt"],
        "5on5": ["icetime", "cf", "ca", "onf_c", "ona_c", "hd", "xg_c", "fow", "fol"],
        "5on4": ["goals", "a1", "a2", "icetime"],
        "4on5": ["icetime", "gf", "ga"],
    }
    wide = situations.groupBy("player_id", "team", "position").agg(
        *[pick(s, c).alias(f"{c}_{s}") for s, cols in need.items() for c in cols]
    )
    c = lambda name: F.col(f"`{name}`")
    per_game = lambda v: F.when(c("gp_all") > 0, v / c("gp_all")).otherwise(0.0)
    hours = c("icetime_5on5")
    rows = wide.join(models, "player_id", "left").select(
        "player_id", "team", "position",
        c("gp_all").alias("gp"), c("goals_all").alias("goals"),
        (c("a1_all") + c("a2_all")).alias("assists"),
        (c("goals_all") + c("a1_all") + c("a2_all")).alias("points"),
        c("sog_all").alias("shots"),
        F.round(F.when(c("sog_all") > 0, F.lit(100.0) * c("goals_all") / c("sog_all")).otherwise(0.0), 4).alias("shooting_pct"),
        c("pt_all").alias("pim"),
        F.round(per_game(c("icetime_all")) / 60, 4).alias("toi_per_game_min"),
        F.round(share_pct(c("cf_5on5"), c("ca_5on5"), 0.0), 4).alias("cf_pct"),
        F.round(F.coalesce("model_xgf_pct", share_pct(c("onf_c_5on5"), c("ona_c_5on5"), 0.0)), 4).alias("xgf_pct"),
        F.round(share_pct(c("fow_5on5"), c("fol_5on5"), 0.0), 4).alias("zone_start_pct"),
        F.round(per_60(c("xg_c_5on5") / 100.0, hours), 6).alias("ixg_60"),
        F.round(per_60(c("hd_5on5"), hours), 6).alias("ihdcf_60"),
        (c("goals_5on4") + c("a1_5on4") + c("a2_5on4")).alias("pp_points"),
        F.round(per_game(c("icetime_5on4")) / 60, 4).alias("pp_toi_per_game_min"),
        F.round(per_game(c("icetime_4on5")) / 60, 4).alias("pk_toi_per_game_min"),
        (c("gf_4on5") - c("ga_4on5")).alias("pk_pm"),
        "model_gar",
    )
    rel = leave_one_out(rows, ["team"], "cf_pct", "rel_cf_pct")
    return leave_one_out(rel, ["team"], "xgf_pct", "rel_xgf_pct")


def last_n_form(team_games: DataFrame, n: int) -> DataFrame:
    """Games, record, goals and current streak over each team's last ``n`` games (OT losses end a win run)."""
    recent = top_k(team_games, ["team"], [F.desc("match_date"), F.desc("match_id")], n)
    won = F.col("result") == "W"
    newest = F.min_by(won, "rn")
    first = recent.groupBy("team").agg(
        F.count(F.lit(1)).alias("games"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"),
        F.count(F.when(won, 1)).alias("wins"), newest.alias("_w"),
        F.min(F.when(won, F.col("rn"))).alias("_fw"), F.min(F.when(~won, F.col("rn"))).alias("_fl"),
    )
    run = F.coalesce(F.when(F.col("_w"), F.col("_fl")).otherwise(F.col("_fw")) - 1, F.col("games"))
    kind = F.when(F.col("_w"), "W").otherwise("L")
    return first.select("team", "games", "wins", "gf", "ga", F.concat(kind, run.cast("string")).alias("streak"))


def current_streak(team_games: DataFrame) -> DataFrame:
    """Length and kind of the trailing run over the whole history, from aggregates only.

    The run starts after the last game of the other kind, so its length is a count behind that game.
    """
    won = F.col("result") == "W"
    at = F.struct("match_date", "match_id")
    last = team_games.groupBy("team").agg(
        F.max_by(won, at).alias("_w"), F.max(F.when(won, at)).alias("_lw"), F.max(F.when(~won, at)).alias("_ll")
    )
    cut = last.select("team", "_w", F.when(F.col("_w"), F.col("_ll")).otherwise(F.col("_lw")).alias("_cut"))
    after = team_games.join(cut, "team").where(F.col("_cut").isNull() | (at > F.col("_cut")))
    return after.groupBy("team").agg(
        F.when(F.first("_w"), "W").otherwise("L").alias("kind"), F.count(F.lit(1)).alias("length")
    )


def running_points(games: DataFrame, entity: str, chunk: Column, order: list[str], points: Column) -> DataFrame:
    """Cumulative points per entity in game order."""
    return running(games, [entity], chunk, order, {"cum_points": Running("sum", points, inclusive=True)})


def head_to_head(team_games: DataFrame) -> DataFrame:
    """Record and goals of every ordered pair of opponents; one pair is a filter on the result."""
    won = lambda kind: F.count(F.when(F.col("result") == kind, 1))
    return team_games.groupBy("team", "opp").agg(
        won("W").alias("wins"), won("L").alias("losses"), won("OTL").alias("otl"),
        F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.max("match_date").cast("string").alias("last_met"),
    )


def playoff_seeds(standings: DataFrame) -> DataFrame:
    """Division seeds 1-3 and two wild cards per conference with their first-round pairing.

    Standings hold one row per team, so these windows see at most a conference.
    """
    from pyspark.sql import Window

    best = [F.desc("points"), F.desc("gf"), F.asc("team")]
    div = Window.partitionBy("conf", "division").orderBy(*best)
    rows = standings.withColumn("div_rank", F.row_number().over(div))
    rest = top_k(rows.where("div_rank > 3"), ["conf"], best, 2, "wild_card").select("team", "wild_card")
    rows = rows.join(rest, "team", "left").where((F.col("div_rank") <= 3) | F.col("wild_card").isNotNull())
    winner = Window.partitionBy("conf").orderBy(F.desc("points"), F.asc("division"))
    order = rows.where("div_rank = 1").select("conf", "division", F.row_number().over(winner).alias("div_order"))
    rows = rows.join(order, ["conf", "division"], "left")
    is_wild = F.col("wild_card").isNotNull()
    series = (
        F.when(is_wild, F.when(F.col("wild_card") == 2, 1).otherwise(3))
        .when(F.col("div_rank") == 1, F.col("div_order") * 2 - 1)
        .otherwise(F.col("div_order") * 2)
    )
    return rows.select("conf", "team", "points", "div_rank", "wild_card", series.cast("bigint").alias("series"))


def most_similar(rows: DataFrame, self_id, key: str, parts: dict[str, float], min_games: int, k: int = 5) -> DataFrame:
    """The ``k`` rows of the same position closest to one row by weighted absolute differences."""
    me = rows.where(F.col(key) == self_id).agg(
        F.struct(F.max("position").alias("position"), *[F.max(c).alias(c) for c in parts]).alias("me")
    ).scalar()
    score = sum(F.abs(F.col(c) - F.col(f"me.{c}")) * w for c, w in parts.items())
    peers = rows.withColumn("me", me).where(
        (F.col(key) != self_id) & (F.col("position") == F.col("me.position")) & (F.col("gp") >= min_games)
    )
    return peers.withColumn("score", F.round(score, 6)).drop("me").orderBy("score", key).limit(k)


def outliers(rows: DataFrame, delta: str, key: str, k: int) -> DataFrame:
    """The ``k`` most over- and the ``k`` most under-predicted rows."""
    over = rows.orderBy(F.desc(delta), key).limit(k).withColumn("side", F.lit("over"))
    under = rows.orderBy(F.asc(delta), key).limit(k).withColumn("side", F.lit("under"))
    return over.unionByName(under)


def leaderboards(rows: DataFrame, key: str, metrics: list[str], k: int) -> DataFrame:
    """Top ``k`` rows of several metrics from one scan, in long form."""
    stacked = rows.select(
        key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")
    ).select(key, "s.*")
    return top_k(stacked, ["metric"], [F.desc_nulls_last("value"), F.asc(key)], k, "rank")


def archetype(rows: DataFrame) -> DataFrame:
    """Tier and archetype label per rated player from the six components."""
    names = ["rapm", "individual", "relative_xgf", "playmaking", "power_play", "penalty_kill"]
    col = lambda n: F.col(f"{n}_component")
    comp = F.col("composite_rating")
    tier = (
        F.when(comp >= 1.5, "Elite").when(comp >= 0.7, "Strong").when(comp >= 0.2, "Solid")
        .when(comp >= -0.3, "Average").otherwise("Below-average")
    )
    pick = lambda test: F.array_compact(F.array(*[F.when(test(col(n)), F.lit(n)) for n in names]))
    strong, weak = pick(lambda c: c >= 1.0), pick(lambda c: c <= -0.6)
    above = F.size(pick(lambda c: c >= 0.3))
    offense = (col("individual") + col("playmaking") + col("power_play")) / 3
    defense = (col("penalty_kill") + col("relative_xgf")) / 2
    role = F.when(F.col("position") == "D", "defenseman").otherwise("forward")
    label = (
        F.when(above >= 5, F.concat(F.lit("two-way "), role))
        .when((offense > 0.8) & (defense < 0.25), F.concat(F.lit("offensive "), role))
        .when((defense > 0.6) & (offense < 0.3), F.concat(F.lit("defensive "), role))
        .when(F.size(strong) > 0, F.concat(role, F.lit(" strong in "), F.array_join(strong, ", ")))
        .otherwise(F.concat(F.lit("balanced "), role))
    )
    return rows.select("player_id", tier.alias("tier"), label.alias("archetype"), F.array_join(weak, ", ").alias("weak"))


def aligned_trajectory(rows: DataFrame, entity: str, season: str, value: str, last: int) -> DataFrame:
    """Every entity on the newest ``last`` seasons of the data, null where it has no value.

    The spine of seasons is one array scalar exploded per entity, so no table is crossed.
    """
    spine = rows.select(season).distinct().agg(
        F.slice(F.sort_array(F.collect_set(season), asc=False), 1, last).alias("s")
    ).scalar()
    grid = rows.select(entity).distinct().withColumn("_s", spine).select(entity, F.explode("_s").alias(season))
    values = rows.groupBy(entity, season).agg(F.sum(value).alias(value))
    return grid.join(values, [entity, season], "left")


def rank_vs_benchmark(rows: DataFrame, key: str, ours: str, theirs: str) -> DataFrame:
    """Competition ranks by two ratings and their difference."""
    ranked = with_ranks(rows, [], {"our_rank": ours, "their_rank": theirs}, "min", descending=True)
    return ranked.select(key, "our_rank", "their_rank", (F.col("their_rank") - F.col("our_rank")).alias("delta"))


def bracket_order(teams: int) -> list[int]:
    """Seeds in bracket order: the first meets the last, and the two best can only meet at the end."""
    order = [1]
    while len(order) < teams:
        n = 2 * len(order) + 1
        order = [x for seed in order for x in (seed, n - seed)]
    return order


def bracket(seeds: DataFrame, results: DataFrame, teams: int, needed: int = 4) -> DataFrame:
    """``round, slot, top, bottom, top_wins, bottom_wins, started, complete, winner``: all series of a knock-out tree.

    ``seeds`` is ``seed, team`` from 1 up to ``teams`` (a power of two), ``results`` is ``team, opp, wins``. A round is
    one row: its teams in bracket order, from which a recursive query makes the next one. A series without ``needed``
    wins has no winner yet, and its place in the next round stays empty. Results of the seeded teams only are gathered,
    at most ``teams * teams``.
    """
    spark = seeds.sparkSession
    place = F.map_from_arrays(F.lit(bracket_order(teams)), F.lit(list(range(teams))))
    seeded = seeds.where(F.col("seed") <= teams)
    line = F.transform(F.array_sort(F.collect_list(F.struct(place[F.col("seed").cast("int")].alias("at"), "team"))), lambda x: x["team"])
    among = results.join(seeded.select("team"), "team", "left_semi").join(seeded.select(F.col("team").alias("opp")), "opp", "left_semi")
    pair = F.struct(F.concat_ws("-", "team", "opp").alias("key"), F.col("wins").cast("bigint").alias("value"))
    wins = F.map_from_entries(F.collect_list(pair))
    view = f"bracket_{uuid.uuid4().hex}"
    start = seeded.agg(line.alias("teams")).withColumn("wins", among.agg(wins.alias("w")).scalar())
    start.createOrReplaceTempView(view)
    count = lambda a, b: f"coalesce(wins[concat_ws('-', teams[2 * i + {a}], teams[2 * i + {b}])], 0L)"
    winner = f"""CASE WHEN teams[2 * i] IS NULL OR teams[2 * i + 1] IS NULL OR greatest({count(0, 1)}, {count(1, 0)}) < {needed} THEN NULL
      WHEN {count(0, 1)} >= {count(1, 0)} THEN teams[2 * i] ELSE teams[2 * i + 1] END"""
    played = spark.sql(
        f"""WITH RECURSIVE rounds(round, teams, wins) AS (
          SELECT 1, teams, wins FROM {view} WHERE size(teams) = {teams}
          UNION ALL SELECT round + 1, transform(sequence(0, size(teams) div 2 - 1), i -> {winner}), wins FROM rounds WHERE size(teams) > 1)
        SELECT round, inline(transform(sequence(0, size(teams) div 2 - 1), i -> named_struct('slot', i, 'top', teams[2 * i], 'bottom', teams[2 * i + 1],
          'top_wins', {count(0, 1)}, 'bottom_wins', {count(1, 0)}, 'winner', {winner}))) FROM rounds WHERE size(teams) > 1"""
    )
    known = F.col("top").isNotNull() & F.col("bottom").isNotNull()
    # a place still empty has no wins
    wins_of = lambda c: F.when(known, F.col(c)).otherwise(0).cast("bigint").alias(c)
    return played.select(
        F.col("round").cast("bigint").alias("round"),
        F.col("slot").cast("bigint").alias("slot"),
        "top",
        "bottom",
        wins_of("top_wins"),
        wins_of("bottom_wins"),
        (known & (F.col("top_wins") + F.col("bottom_wins") > 0)).alias("started"),
        F.col("winner").isNotNull().alias("complete"),
        "winner",
    )


def net_reliability(rows: DataFrame, first: str, second: str, prior: str, kappas: list[float]) -> DataFrame:
    """Per prior strength: correlation of two halves, that net of the strength times the prior, and each half's with
    the prior. All of it follows from the six co-moments of one pass."""
    known = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(prior).isNotNull())
    cov = lambda a, b: F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double"))
    moments = known.agg(
        cov(first, first).alias("aa"), cov(second, second).alias("bb"), cov(prior, prior).alias("pp"),
        cov(first, second).alias("ab"), cov(first, prior).alias("ap"), cov(second, prior).alias("bp"), F.count(F.lit(1)).alias("n"),
    )
    each = moments.withColumn("kappa", F.explode(F.array(*[F.lit(float(k)) for k in kappas])))
    k = F.col("kappa")
    corr = lambda xy, x, y: F.when((x > 0) & (y > 0), xy / F.sqrt(x * y))
    less = lambda own, with_prior: F.col(own) - 2 * k * F.col(with_prior) + k * k * F.col("pp")
    net = F.col("ab") - k * (F.col("ap") + F.col("bp")) + k * k * F.col("pp")
    return each.select(
        "kappa",
        "n",
        corr(F.col("ab"), F.col("aa"), F.col("bb")).alias("corr"),
        corr(net, less("aa", "ap"), less("bb", "bp")).alias("net"),
        corr(F.col("ap"), F.col("aa"), F.col("pp")).alias("first_prior"),
        corr(F.col("bp"), F.col("bb"), F.col("pp")).alias("second_prior"),
    )

"""How the given tables stand in for the domain tables, once for Spark and once as SQL CTEs.

Sums that feed later comparisons run over whole numbers (cents, hundredths, seconds), so a value
does not depend on the order in which partial sums meet.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD_SECS = 28800
SQUAD = 40


def cents(name: str, scale: int = 100) -> Column:
    return F.round(F.col(name) * scale).cast("bigint")


def position_of(col: str) -> Column:
    slot = F.col(col) % 10
    return (
        F.when(slot == 0, "G")
        .when(slot <= 3, "D")
        .when(slot <= 6, "C")
        .when(slot <= 8, "L")
        .otherwise("R")
    )


def position_sql(col: str) -> str:
    return (
        f"CASE WHEN {col} % 10 = 0 THEN 'G' WHEN {col} % 10 <= 3 THEN 'D' "
        f"WHEN {col} % 10 <= 6 THEN 'C' WHEN {col} % 10 <= 8 THEN 'L' ELSE 'R' END"
    )


class Tables:
    """The given parquet tables of one folder and the domain views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def plays(self) -> DataFrame:
        """Flat play list: one game is a squad of 40 users on one day, a player's team is the id's parity."""
        secs = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("player_id"),
            (F.col("user_id") % 2).alias("team_id"),
            (F.expr(f"user_id div {SQUAD}") % 2).alias("home_team_id"),
            (
                F.date_format("ts", "yyyyMMdd").cast("bigint") * 1000000000 + F.expr(f"user_id div {SQUAD}")
            ).alias("game_id"),
            secs.cast("bigint").alias("abs_secs"),
            (F.floor(secs / PERIOD_SECS) + 1).cast("bigint").alias("period"),
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    @cached_property
    def shifts(self) -> DataFrame:
        """Presence intervals around every event, cut at the period's ends."""
        start = F.greatest((F.col("period") - 1) * PERIOD_SECS, F.col("abs_secs") - 300)
        end = F.least(
            F.col("abs_secs") + 1200 + F.floor(F.col("value") * 24).cast("bigint"), F.col("period") * PERIOD_SECS
        )
        return self.plays.select(
            F.col("event_id").alias("shift_id"),
            "game_id",
            "period",
            "player_id",
            "team_id",
            "home_team_id",
            start.alias("abs_start"),
            end.alias("abs_end"),
        ).withColumn("dur", F.col("abs_end") - F.col("abs_start"))

    @cached_property
    def shots(self) -> DataFrame:
        """Attempts; ``xg_c`` is the model value in hundredths."""
        return self.plays.where(F.col("event_type").isin("click", "purchase", "view")).select(
            F.col("event_id").alias("shot_id"),
            "game_id",
            "period",
            "abs_secs",
            F.col("player_id").alias("shooter_id"),
            "team_id",
            "home_team_id",
            (F.col("event_type") == "purchase").cast("bigint").alias("is_goal"),
            (F.col("event_type") != "view").cast("bigint").alias("on_goal"),
            cents("value").alias("xg_c"),
        )

    @cached_property
    def goalies(self) -> DataFrame:
        from stintflow.operators.intervals import long_presence_members

        return long_presence_members(self.shifts, ["game_id"], "player_id", "dur", 7800.0)

    @cached_property
    def shifts_flagged(self) -> DataFrame:
        flag = self.goalies.select("player_id", F.lit(True).alias("is_goalie"))
        return self.shifts.join(flag, "player_id", "left").withColumn(
            "is_goalie", F.coalesce("is_goalie", F.lit(False))
        )

    @cached_property
    def skater_lines(self) -> DataFrame:
        """Line items joined to their supplier, one scoring line per row."""
        sit = (
            F.when(F.col("l_linenumber") <= 4, "5on5")
            .when(F.col("l_linenumber") == 5, "5on4")
            .when(F.col("l_linenumber") == 6, "4on5")
            .otherwise("other")
        )
        even = F.col("l_partkey") % 2 == 0
        scored = F.col("l_returnflag") == "R"
        toi = F.col("l_quantity").cast("bigint")
        flag = lambda cond: F.when(cond, 1).otherwise(0).cast("bigint")
        return self.table("lineitem").join(
            self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey"
        ).select(
            F.col("l_suppkey").alias("player_id"),
            F.col("s_nationkey").cast("bigint").alias("team"),
            position_of("l_suppkey").alias("position"),
            F.year("l_shipdate").cast("bigint").alias("season"),
            sit.alias("situation"),
            F.lit(1).cast("bigint").alias("gp"),
            (toi * 60).alias("icetime"),
            flag(scored).alias("goals"),
            flag(F.col("l_returnflag") == "A").alias("a1"),
            flag(F.col("l_linestatus") == "F").alias("a2"),
            toi.alias("sog"),
            cents("l_discount").alias("xg_c"),
            flag(cents("l_discount") >= 7).alias("hd"),
            F.when(even, cents("l_extendedprice")).otherwise(F.lit(0).cast("bigint")).alias("onf_c"),
            F.when(~even, cents("l_extendedprice")).otherwise(F.lit(0).cast("bigint")).alias("ona_c"),
            F.when(even, toi).otherwise(F.lit(0).cast("bigint")).alias("cf"),
            F.when(~even, toi).otherwise(F.lit(0).cast("bigint")).alias("ca"),
            flag(scored & even).alias("gf"),
            flag(scored & ~even).alias("ga"),
            flag(cents("l_tax") >= 6).alias("pt"),
            flag(cents("l_tax") <= 1).alias("pd"),
            flag(F.col("l_partkey") % 3 == 0).alias("fow"),
            flag(F.col("l_partkey") % 3 == 1).alias("fol"),
            flag(F.col("l_partkey") % 5 == 0).alias("blk"),
        )

    def skater_totals(self, *by: str) -> DataFrame:
        """Season-summary sums by any of player_id, team, position, season, situation."""
        return self.skater_lines.groupBy(*by).agg(*[F.sum(m).alias(m) for m in MEASURES])

    @cached_property
    def skater_summary(self) -> DataFrame:
        """One row per player x team x season x situation, with an ``all`` row per player-season."""
        by = ["player_id", "team", "position", "season"]
        parts = self.skater_totals(*by, "situation")
        rows = parts.withColumn("situation", F.explode(F.array(F.lit("all"), "situation")))
        return rows.groupBy(*by, "situation").agg(*[F.sum(m).alias(m) for m in MEASURES])

    @cached_property
    def matches(self) -> DataFrame:
        """Schedule rows: one order is one game between the customer's nation and a numbered rival."""
        rival = (F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25
        return self.table("orders").join(
            self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
        ).select(
            F.col("o_orderkey").alias("match_id"),
            F.to_date("o_orderdate").alias("match_date"),
            F.col("c_nationkey").cast("bigint").alias("home"),
            rival.cast("bigint").alias("away"),
            (F.floor(F.col("o_totalprice")) % 7).cast("bigint").alias("home_goals"),
            (F.floor(F.col("o_totalprice") / 7) % 6).cast("bigint").alias("away_goals"),
            F.when(F.col("o_orderstatus") == "P", "OT").otherwise("REG").alias("last_period"),
        )

    @cached_property
    def team_games(self) -> DataFrame:
        """Schedule melted to one row per team and game."""
        side = lambda team, opp, gf, ga, home: F.struct(
            F.col(team).alias("team"),
            F.col(opp).alias("opp"),
            F.col(gf).alias("gf"),
            F.col(ga).alias("ga"),
            F.lit(home).alias("is_home"),
        )
        sides = F.array(
            side("home", "away", "home_goals", "away_goals", True),
            side("away", "home", "away_goals", "home_goals", False),
        )
        rows = self.matches.withColumn("s", F.explode(sides)).select(
            "match_id", "match_date", "last_period", "s.*"
        )
        return rows.withColumn(
            "result",
            F.when(F.col("gf") > F.col("ga"), "W").when(F.col("last_period") == "OT", "OTL").otherwise("L"),
        )

    @cached_property
    def contracts(self) -> DataFrame:
        """Customers as contracts; the value per customer comes from the customer's orders."""
        spend = self.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.sum(cents("o_totalprice")).alias("spend_c"), F.count(F.lit(1)).alias("n_orders")
        )
        pos = F.when(F.col("c_custkey") % 10 == 0, "G").when(F.col("c_custkey") % 3 == 0, "D").otherwise("C")
        return (
            self.table("customer")
            .join(spend, "c_custkey", "left")
            .select(
                F.col("c_custkey").alias("player_id"),
                F.col("c_name").alias("name"),
                F.col("c_nationkey").cast("bigint").alias("team"),
                pos.alias("position"),
                (F.floor((cents("c_acctbal") + 150000) / 10) / 10000.0).alias("cap_hit"),
                (2026 + F.col("c_custkey") % 6).cast("bigint").alias("expiry_year"),
                F.when(F.col("c_custkey") % 11 != 0, 18 + F.col("c_custkey") % 22).cast("bigint").alias("age"),
                F.round(F.col("spend_c") / 50000000.0, 2).alias("gar"),
                F.round(F.col("spend_c") / 60000000.0, 2).alias("xgar"),
                F.round(F.coalesce("n_orders", F.lit(0)) / 10.0, 3).alias("ixg_60"),
            )
        )

    @cached_property
    def news(self) -> DataFrame:
        """Orders as headlines: the key picks a template, the price is the amount, the customer the link."""
        pick = F.col("o_orderkey") % 10
        who = F.concat(F.lit("Player "), F.col("o_custkey").cast("string"))
        money = F.concat(F.lit("$"), (F.floor(F.col("o_totalprice") / 40000)).cast("string"), F.lit("M"))
        title = F.when(pick == 0, F.concat(who, F.lit(" signs six-year extension worth "), money))
        for i, parts in enumerate(NEWS_TEMPLATES, start=1):
            title = title.when(pick == i, F.concat(*[who if p == "@" else money if p == "$" else F.lit(p) for p in parts]))
        return self.table("orders").select(
            F.col("o_orderkey").alias("item_id"),
            title.alias("title"),
            F.when(F.col("o_orderkey") % 29 == 0, "").when(
                F.col("o_orderkey") % 23 != 0,
                F.concat(
                    F.lit("https://news.example/"),
                    F.when(F.col("o_orderkey") % 17 == 0, "video/").otherwise(""),
                    F.col("o_custkey").cast("string"),
                ),
            ).alias("link"),
            F.to_date("o_orderdate").alias("pub_date"),
            F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.col("o_orderdate")).alias("pub_ts"),
        )


MEASURES = (
    "gp icetime goals a1 a2 sog xg_c hd onf_c ona_c cf ca gf ga pt pd fow fol blk".split()
)

# Headline templates; "@" is the subject, "$" the amount.
NEWS_TEMPLATES = [
    ["Club acquires ", "@", " in trade for first-round pick"],
    ["@", " suspended three games"],
    ["@", " placed on injured reserve"],
    ["Club recalls ", "@", " from affiliate"],
    ["Why should the club trade ", "@", "?"],
    ["@", " placed on waivers"],
    ["@", " agrees to terms on ", "$", " deal"],
    ["Club named new head coach after ", "@", " report"],
    ["Practice notes: ", "@", " skates alone"],
]


def news_title_sql() -> str:
    who = "'Player ' || CAST(o_custkey AS VARCHAR)"
    money = "'$' || CAST(CAST(floor(o_totalprice / 40000) AS BIGINT) AS VARCHAR) || 'M'"
    cases = [f"WHEN 0 THEN {who} || ' signs six-year extension worth ' || {money}"]
    for i, parts in enumerate(NEWS_TEMPLATES, start=1):
        text = " || ".join(who if p == "@" else money if p == "$" else f"'{p}'" for p in parts)
        cases.append(f"WHEN {i} THEN {text}")
    return "CASE o_orderkey % 10 " + " ".join(cases) + " END"


CTES = {
    "plays": f"""
SELECT event_id, user_id AS player_id, user_id % 2 AS team_id, (user_id // {SQUAD}) % 2 AS home_team_id,
  CAST(strftime(ts, '%Y%m%d') AS BIGINT) * 1000000000 + user_id // {SQUAD} AS game_id,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS abs_secs,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) // {PERIOD_SECS} + 1 AS period,
  event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events""",
    "shifts": f"""
SELECT *, abs_end - abs_start AS dur FROM (
  SELECT event_id AS shift_id, game_id, period, player_id, team_id, home_team_id,
    greatest((period - 1) * {PERIOD_SECS}, abs_secs - 300) AS abs_start,
    least(abs_secs + 1200 + CAST(floor(value * 24) AS BIGINT), period * {PERIOD_SECS}) AS abs_end
  FROM plays)""",
    "shots": """
SELECT event_id AS shot_id, game_id, period, abs_secs, player_id AS shooter_id, team_id, home_team_id,
  CAST(event_type = 'purchase' AS BIGINT) AS is_goal, CAST(event_type <> 'view' AS BIGINT) AS on_goal,
  CAST(round(value * 100) AS BIGINT) AS xg_c
FROM plays WHERE event_type IN ('click', 'purchase', 'view')""",
    "goalies": """
SELECT DISTINCT player_id FROM (
  SELECT game_id, player_id FROM shifts GROUP BY 1, 2 HAVING avg(dur) > 7800)""",
    "shifts_flagged": """
SELECT s.*, player_id IN (SELECT player_id FROM goalies) AS is_goalie FROM shifts s""",
    "skater_lines": f"""
SELECT l_suppkey AS player_id, CAST(s_nationkey AS BIGINT) AS team, {position_sql('l_suppkey')} AS position,
  CAST(year(l_shipdate) AS BIGINT) AS season,
  CASE WHEN l_linenumber <= 4 THEN '5on5' WHEN l_linenumber = 5 THEN '5on4'
       WHEN l_linenumber = 6 THEN '4on5' ELSE 'other' END AS situation,
  1::BIGINT AS gp, CAST(l_quantity AS BIGINT) * 60 AS icetime, CAST(l_returnflag = 'R' AS BIGINT) AS goals,
  CAST(l_returnflag = 'A' AS BIGINT) AS a1, CAST(l_linestatus = 'F' AS BIGINT) AS a2,
  CAST(l_quantity AS BIGINT) AS sog, CAST(round(l_discount * 100) AS BIGINT) AS xg_c,
  CAST(round(l_discount * 100) >= 7 AS BIGINT) AS hd,
  CASE WHEN l_partkey % 2 = 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END AS onf_c,
  CASE WHEN l_partkey % 2 = 1 THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END AS ona_c,
  CASE WHEN l_partkey % 2 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS cf,
  CASE WHEN l_partkey % 2 = 1 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS ca,
  CAST(l_returnflag = 'R' AND l_partkey % 2 = 0 AS BIGINT) AS gf,
  CAST(l_returnflag = 'R' AND l_partkey % 2 = 1 AS BIGINT) AS ga,
  CAST(round(l_tax * 100) >= 6 AS BIGINT) AS pt, CAST(round(l_tax * 100) <= 1 AS BIGINT) AS pd,
  CAST(l_partkey % 3 = 0 AS BIGINT) AS fow, CAST(l_partkey % 3 = 1 AS BIGINT) AS fol,
  CAST(l_partkey % 5 = 0 AS BIGINT) AS blk
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "skater_summary": "SELECT player_id, team, position, season, situation, "
    + ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MEASURES)
    + " FROM (SELECT * FROM skater_lines UNION ALL SELECT * REPLACE ('all' AS situation) FROM skater_lines)"
    + " GROUP BY ALL",
    "skater_players": "SELECT player_id, team, position, "
    + ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MEASURES)
    + " FROM skater_lines GROUP BY ALL",
    "matches": """
SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, CAST(c_nationkey AS BIGINT) AS home,
  CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS BIGINT) AS away,
  CAST(floor(o_totalprice) AS BIGINT) % 7 AS home_goals, CAST(floor(o_totalprice / 7) AS BIGINT) % 6 AS away_goals,
  CASE WHEN o_orderstatus = 'P' THEN 'OT' ELSE 'REG' END AS last_period
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "team_games": """
SELECT *, CASE WHEN gf > ga THEN 'W' WHEN last_period = 'OT' THEN 'OTL' ELSE 'L' END AS result FROM (
  SELECT match_id, match_date, last_period, home AS team, away AS opp, home_goals AS gf, away_goals AS ga,
    true AS is_home FROM matches
  UNION ALL
  SELECT match_id, match_date, last_period, away, home, away_goals, home_goals, false FROM matches)""",
    "contracts": """
SELECT c_custkey AS player_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS team,
  CASE WHEN c_custkey % 10 = 0 THEN 'G' WHEN c_custkey % 3 = 0 THEN 'D' ELSE 'C' END AS position,
  floor((CAST(round(c_acctbal * 100) AS BIGINT) + 150000) / 10) / 10000.0::DOUBLE AS cap_hit,
  CAST(2026 + c_custkey % 6 AS BIGINT) AS expiry_year,
  CASE WHEN c_custkey % 11 <> 0 THEN 18 + c_custkey % 22 END AS age,
  round(spend_c / 50000000.0::DOUBLE, 2) AS gar, round(spend_c / 60000000.0::DOUBLE, 2) AS xgar,
  round(coalesce(n_orders, 0) / 10.0::DOUBLE, 3) AS ixg_60
FROM customer LEFT JOIN (
  SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spend_c, count(*) AS n_orders
  FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "news": f"""
SELECT o_orderkey AS item_id, {news_title_sql()} AS title,
  CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 23 <> 0 THEN 'https://news.example/'
    || CASE WHEN o_orderkey % 17 = 0 THEN 'video/' ELSE '' END || CAST(o_custkey AS VARCHAR) END AS link,
  CAST(o_orderdate AS DATE) AS pub_date,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS pub_ts
FROM orders""",
}

NEEDS = {
    "shifts": ["plays"],
    "shots": ["plays"],
    "goalies": ["shifts"],
    "shifts_flagged": ["shifts", "goalies"],
    "skater_summary": ["skater_lines"],
    "skater_players": ["skater_lines"],
    "team_games": ["matches"],
}


def cte(*names: str, **extra: str) -> str:
    """``WITH`` clause holding the named views, what they need, and any extra ones in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ", ".join(parts) + "\n"

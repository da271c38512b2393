"""Contract classes, aging, value per money and the views built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.scale import positions

# Fixed values of the contract model (money in $M).
MARKET_VALUE = 1.85
GOALIE_VALUE = 0.45
ENTRY_CAP, ENTRY_AGE = 1.1, 23
BRIDGE_CAP, BRIDGE_AGE = 5.0, 27
VETERAN_AGE = 32
DECLINE = 0.92
DECLINE_AGE = {"D": 33, "other": 30}
FREE_AGENT_AGE = 27


def money(value: Column | str) -> Column:
    """Two decimals, rounded as a decimal number so that a tie does not hang on binary noise."""
    exact = (F.col(value) if isinstance(value, str) else value).cast("decimal(20,6)")
    return F.round(exact, 2).cast("double")


def contract_type(cap: str, age: str) -> Column:
    c, a = F.col(cap), F.col(age)
    young = lambda limit: a.isNull() | (a <= limit)
    return (
        F.when((c <= ENTRY_CAP) & young(ENTRY_AGE), "ELC")
        .when(a >= VETERAN_AGE, "Veteran")
        .when((c < BRIDGE_CAP) & young(BRIDGE_AGE), "Bridge")
        .otherwise("Market Rate")
    )


def projected(value: Column, position: Column, age: Column, years: Column) -> Column:
    """Value after ``years``, losing 8 % for each year spent at or past the position's decline age."""
    onset = F.when(position == "D", DECLINE_AGE["D"]).otherwise(DECLINE_AGE["other"])
    declining = F.greatest(F.lit(0), F.least(years, age + years - onset + 1))
    return money(value * F.pow(F.lit(DECLINE), declining))


def offense_share(position: Column, ixg_60: Column, best: Column) -> Column:
    """Offensive part of the total, from the chance rate against the league's best, held in a band per role."""
    raw = F.coalesce(ixg_60, F.lit(0.0)) / F.when(best > 0, best).otherwise(1.0)
    band = lambda low, high, expr: F.greatest(F.lit(low), F.least(F.lit(high), expr))
    return F.when(position == "D", band(0.20, 0.55, 0.25 + raw * 0.45)).otherwise(band(0.45, 0.85, 0.50 + raw * 0.50))


def value_table(contracts: DataFrame) -> DataFrame:
    """Contract rows with type, offence/defence split, per-money rates, surplus, sustainability and outlook.

    Needs ``cap_hit, age, position, gar, xgar, ixg_60``; the league's best rate is one scalar.
    """
    best = contracts.agg(F.max("ixg_60").alias("m")).scalar()
    gar, cap, age, pos = F.col("gar"), F.col("cap_hit"), F.col("age"), F.col("position")
    per_money = lambda v: F.when(cap > 0, money(v / cap))
    multiplier = F.when(pos == "G", GOALIE_VALUE).otherwise(MARKET_VALUE)
    rows = contracts.withColumn("_best", best).withColumn(
        "off_gar", money(gar * offense_share(pos, F.col("ixg_60"), F.col("_best")))
    )
    rows = rows.withColumn("def_gar", money(gar - gar * offense_share(pos, F.col("ixg_60"), F.col("_best"))))
    age_flag = F.when(age < 25, "pre_peak").when(age <= 29, "peak").when(age >= 30, "post_peak")
    outlook = F.when(pos != "G", projected(gar, pos, age, F.lit(3)))
    return (
        rows.drop("_best")
        .withColumn("contract_type", contract_type("cap_hit", "age"))
        .withColumn("gar_per_million", per_money(gar))
        .withColumn("off_gar_per_million", per_money(F.col("off_gar")))
        .withColumn("def_gar_per_million", per_money(F.col("def_gar")))
        .withColumn("sustainability_score", money(gar - F.col("xgar")))
        .withColumn("expected_market_value", money(gar * multiplier))
        .withColumn("surplus_value", money(gar * multiplier - cap))
        .withColumn("age_flag", age_flag)
        .withColumn("projected_gar_y3", outlook)
        .withColumn("projected_surplus_y3", F.when(cap > 0, money(F.col("projected_gar_y3") * MARKET_VALUE - cap)))
    )


def view_filters(season_end: int) -> dict[str, Column]:
    """Named row filters of the contract page; all of them are independent of each other."""
    return {
        "not_elc": F.col("contract_type") != "ELC",
        "this_year": F.col("expiry_year") == season_end,
        "two_plus": F.col("expiry_year") >= season_end + 2,
        "aging": F.col("age") >= 30,
    }


# Default sort column per view and whether it ascends.
VIEW_SORTS = {
    "best": ("surplus_value", False),
    "def": ("def_gar_per_million", False),
    "off": ("off_gar_per_million", False),
    "sustain": ("sustainability_score", True),
    "aging": ("surplus_value", False),
}


# Which rows a view holds; the others hold all.
VIEW_ROWS = {"def": "coalesce(def_gar, 0.0) >= 1.0", "aging": "age >= 30"}


def views(table: DataFrame) -> DataFrame:
    """All rows of every view with their place in its default order, nulls last, from one pass over the table."""
    tags = []
    for name, (column, ascending) in VIEW_SORTS.items():
        value = F.col(column).cast("double")
        entry = F.struct(F.lit(name).alias("view"), value.alias("sort_value"), (value if ascending else -value).alias("_o"))
        tags.append(F.when(F.expr(VIEW_ROWS.get(name, "true")), entry))
    tagged = table.select("player_id", F.inline(F.array_compact(F.array(*tags))))
    order = [F.asc("view"), F.asc_nulls_last("_o"), F.asc("player_id")]
    placed = positions(tagged, order, "_all")
    first = placed.groupBy("view").agg((F.min("_all") - 1).alias("_before"))
    return placed.join(first, "view").select("view", "player_id", "sort_value", (F.col("_all") - F.col("_before")).alias("pos"))


def team_rollup(table: DataFrame) -> DataFrame:
    """Contracts, cap, value and surplus per team; value per dollar is 0 without cap."""
    g = table.groupBy("team").agg(
        F.count(F.lit(1)).alias("players_counted"),
        F.sum(F.coalesce("cap_hit", F.lit(0.0))).alias("cap"),
        F.coalesce(F.sum("gar"), F.lit(0.0)).alias("gar"),
        F.coalesce(F.sum("surplus_value"), F.lit(0.0)).alias("surplus"),
    )
    return g.select(
        "team",
        "players_counted",
        money("cap").alias("total_cap"),
        money("gar").alias("total_gar"),
        money("surplus").alias("total_surplus"),
        F.when(F.col("cap") > 0, money(F.col("gar") / F.col("cap"))).otherwise(0.0).alias("avg_gar_per_dollar"),
    )


def expiry_watch(table: DataFrame, season_end: int) -> DataFrame:
    """Entry-level contracts with the value at expiry, the free-agent class then, and a priority band."""
    years = F.greatest(F.lit(0), F.col("expiry_year") - season_end)
    at_expiry = F.coalesce("age", F.lit(0)) + years
    value = projected(F.col("gar"), F.col("position"), F.col("age"), years)
    market = money(value * MARKET_VALUE)
    return table.where("contract_type = 'ELC'").select(
        "player_id",
        "gar",
        F.when(at_expiry >= FREE_AGENT_AGE, "UFA").otherwise("RFA").alias("status"),
        value.alias("projected_gar"),
        market.alias("projected_value"),
        F.when(market >= 12, "High").when(market >= 6, "Medium").when(market.isNotNull(), "Low").alias("priority"),
    )


def summary_text(table: DataFrame) -> DataFrame:
    """Rule-based sentences per contract; codes are joined so that wording stays with the caller."""
    s, hot, age = F.col("surplus_value"), F.col("sustainability_score"), F.col("age")
    parts = [
        F.when(F.col("contract_type") == "ELC", "entry-level")
        .when(F.col("contract_type") == "Veteran", "veteran")
        .when(F.col("contract_type") == "Bridge", "bridge"),
        F.when(s > 5, "major surplus")
        .when(s > 0, "positive surplus")
        .when(s < -5, "overpay risk")
        .when(s.isNotNull(), "slightly under market"),
        F.when(hot >= 3, "running hot").when(hot <= -3, "buy-low candidate"),
        F.when(age >= VETERAN_AGE, "aging effects ahead"),
    ]
    return table.select("player_id", F.concat_ws("; ", *parts).alias("summary"))

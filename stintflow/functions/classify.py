"""Column expressions that decode, bucket or flag a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The skater counts a segment can really have.
MIN_SKATERS, MAX_SKATERS, MAX_SKATER_GAP = 3, 6, 2


def decode_game_id(gid: str) -> list[Column]:
    """Season start year, season label and game type packed in a game id."""
    year = F.expr(f"{gid} div 1000000")
    return [
        year.alias("season"),
        F.concat(year.cast("string"), (year + 1).cast("string")).alias("season_str"),
        (F.expr(f"{gid} div 10000") % 100).alias("game_type"),
    ]


def in_position_bucket(position: str, bucket: str) -> Column:
    if bucket == "all":
        return F.lit(True)
    return F.col(position).isin("C", "L", "R") if bucket == "F" else F.col(position) == bucket


def name_contains(name: str, text: str) -> Column:
    return F.contains(F.lower(F.col(name)), F.lit(text.lower()))


def strength_group(skaters_for: str, skaters_against: str) -> Column:
    f, a = F.col(skaters_for), F.col(skaters_against)
    return (
        F.when(f == 6, "extra_attacker")
        .when((f == 5) & (a == 5), "5v5")
        .when(f > a, "PP")
        .when(f < a, "PK")
        .otherwise("3v3/4v4")
    )


def score_bucket(diff: Column) -> Column:
    return (
        F.when(diff >= 2, "lead2")
        .when(diff == 1, "lead1")
        .when(diff == 0, "tied")
        .when(diff == -1, "trail1")
        .otherwise("trail2")
    )


def drop_reason(skaters_for: str, skaters_against: str) -> Column:
    """Why a row is unfit for training, null when it is fit; the row itself stays."""
    f, a = F.col(skaters_for), F.col(skaters_against)
    possible = f.between(MIN_SKATERS, MAX_SKATERS) & a.between(MIN_SKATERS, MAX_SKATERS - 1)
    fit = possible & (F.abs(f - a) <= MAX_SKATER_GAP)
    return F.when(~fit, "garbage_strength_state")


def decode_situation(code: str, is_home: str) -> list[Column]:
    """Strength as the event owner sees it, whether the opposing net is empty, and the 5-on-4 test.

    The code lists away goalie, away skaters, home skaters, home goalie; other lengths decode to nothing.
    """
    c, home = F.col(code), F.col(is_home)
    digit = lambda i: F.substring(c, i, 1)
    valid = F.length(c) == 4
    own = F.when(home, digit(3)).otherwise(digit(2))
    other = F.when(home, digit(2)).otherwise(digit(3))
    opposing_goalie = F.when(home, digit(1)).otherwise(digit(4))
    five_on_four = c == F.when(home, "1451").otherwise("1541")
    return [
        F.when(valid, F.concat(own, F.lit("v"), other)).alias("strength"),
        F.when(valid, opposing_goalie == "0").otherwise(F.lit(False)).alias("empty_net"),
        F.when(valid, five_on_four).otherwise(F.lit(False)).alias("five_on_four"),
    ]


def by_side(flag: str, when_true: str, when_false: str) -> Column:
    return F.when(F.col(flag), F.col(when_true)).otherwise(F.col(when_false))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def season_phase(day: Column, preseason: Column, start: Column, end: Column, playoffs_end: Column) -> Column:
    """Phase of a date by the season's own dates; outside or without them, by the month."""
    month = F.month(day)
    by_month = (
        F.when((month >= 10) | (month <= 3), "regular").when(month.between(4, 6), "playoffs").otherwise("offseason")
    )
    return (
        F.when(day.between(start, end), "regular")
        .when((day > end) & (day <= playoffs_end), "playoffs")
        .when((day >= preseason) & (day < start), "preseason")
        .otherwise(by_month)
    )


def season_start(day: Column) -> Column:
    return F.when(F.month(day) >= 10, F.year(day)).otherwise(F.year(day) - 1)


def is_fresh(stamp: str, as_of: str, days: int) -> Column:
    """Undated rows stay, dated ones only within ``days`` of ``as_of``."""
    cutoff = F.to_timestamp_ntz(F.lit(f"{as_of} 00:00:00")) - F.expr(f"INTERVAL {days} DAYS")
    return F.col(stamp).isNull() | (F.col(stamp) >= cutoff)

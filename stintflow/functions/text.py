"""Names, labels and headline rules as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _decompositions() -> dict[str, str]:
    """Every character beyond ASCII whose compatibility decomposition has ASCII in it, and that ASCII."""
    out = {}
    for code in range(0x80, 0x110000):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode() if not 0xD800 <= code < 0xE000 else ""
        if plain:
            out[chr(code)] = plain
    return out


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Single characters and what they become, and those that become several."""
    all_of = _decompositions()
    single = {c: p for c, p in all_of.items() if len(p) == 1}
    return "".join(single), "".join(single.values()), {c: p for c, p in all_of.items() if len(p) > 1}


# Characters that betray UTF-8 bytes once read as Latin-1.
MOJIBAKE = "[ÃÂ�]"


def fold(value: Column) -> Column:
    """Lower-case ASCII of the compatibility decomposition; what has none is dropped."""
    single, plain, several = _folding()
    table = F.map_from_arrays(F.split(F.lit("\n".join(several)), "\n"), F.split(F.lit("\n".join(several.values())), "\n"))
    spelled = F.array_join(F.transform(F.split(value, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    # one pass each: first for any letter beyond ASCII, then for one that becomes several
    whole = F.when(value.rlike("[^\\x00-\\x7F]") & (F.translate(value, "".join(several), "") != value), spelled).otherwise(value)
    return F.lower(F.regexp_replace(F.translate(whole, single, plain), "[^\\x00-\\x7F]+", ""))


def name_key(value: Column) -> Column:
    return F.regexp_replace(fold(value), "[^a-z0-9]+", "")


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def apply_aliases(df: DataFrame, key: str, aliases: dict[str, str]) -> DataFrame:
    """Replace known alternative keys by the canonical one."""
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return df.withColumn(key, F.coalesce(F.create_map(*pairs)[F.col(key)], F.col(key)))


def flip_name(value: Column) -> Column:
    """``Last, First`` to ``First Last``; other names only trimmed."""
    parts = F.split(value, ",", 2)
    return F.when(F.contains(value, F.lit(",")), F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(parts[0]))).otherwise(
        F.trim(value)
    )


def primary_position(value: Column) -> Column:
    """First listed position, upper case; any goalie is G and any defender D."""
    first = F.upper(F.trim(F.split(value, ",")[0]))
    return (
        F.when(value.isNull(), "")
        .when(F.contains(first, F.lit("G")), "G")
        .when(F.contains(first, F.lit("D")), "D")
        .otherwise(first)
    )


def badness(value: Column) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, MOJIBAKE, ""))


def repair_mojibake(value: Column) -> Column:
    """Undo one Latin-1/UTF-8 mix-up when that leaves fewer suspicious characters."""
    latin = ~value.rlike("[^\\x00-\\xFF]")
    fixed = F.when(
        latin & (badness(value) > 0), F.decode(F.encode(F.when(latin, value), "ISO-8859-1"), "UTF-8")
    )
    return F.when(badness(fixed) < badness(value), fixed).otherwise(value)


def cleanest_variant(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key the variant with the fewest suspicious characters (then the first by text), repaired."""
    best = F.min_by(name, F.struct(badness(F.col(name)), F.col(name))).alias("_n")
    return df.groupBy(*keys).agg(best).select(*keys, repair_mojibake(F.col("_n")).alias(name))


def clock_to_secs(value: Column) -> Column:
    """``MM:SS`` to seconds, 0 for anything else."""
    ok = value.rlike("^\\s*[0-9]+:[0-9]+\\s*$")
    part = lambda i: F.trim(F.split_part(value, F.lit(":"), F.lit(i))).try_cast("bigint")
    return F.coalesce(F.when(ok, part(1) * 60 + part(2)), F.lit(0))


def secs_to_clock(secs: Column) -> Column:
    whole = secs.cast("bigint")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def season_label(start_year: Column) -> Column:
    return F.format_string("%d-%02d", start_year, (start_year + 1) % 100)


def series_text(wins: Column, opp_wins: Column, opponent: Column, complete: Column) -> Column:
    verb = F.when(complete, "won series").when(wins > opp_wins, "leads").when(wins < opp_wins, "trails").otherwise("tied")
    record = F.concat(wins.cast("string"), F.lit("-"), opp_wins.cast("string"))
    return F.concat_ws(" ", verb, record, F.lit("vs"), opponent.cast("string"))

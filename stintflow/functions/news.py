"""Headline scoring, transaction classes and the executed-move test.

Every rule is one regular expression over the whole title, so a headline is scored inside a single
projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.scale import top_k

# Topic patterns and their additive weights.
TOPICS = [
    (
        r"(?i)\b(fired|relieved of (?:his |their )?dut|steps? down|named (?:the )?(?:new )?(?:head |interim )?coach|"
        r"hire[sd]?|as (?:the )?(?:new )?(?:head |interim )?coach|behind the bench|new (?:head )?coach|"
        r"general manager|new gm|named gm)\b",
        5.0,
    ),
    (r"(?i)\bsuspend", 5.0),
    (r"(?i)\b(retire[sd]?|retirement|hangs? (?:them|it) up)\b", 4.0),
    (r"(?i)\b(buyout|bought out|placed on (?:unconditional )?waivers? for the purpose)\b", 3.5),
    (r"(?i)\bsign-?and-?trade\b", 3.5),
    (r"(?i)\bnamed (?:team |new )?captain\b", 3.0),
    (
        r"(?i)\b(requests? (?:a )?trade|trade request|no-?trade|holdout|holding out|contract dispute|"
        r"submits? .{0,20}trade list)\b",
        3.0,
    ),
    (r"(?i)\b(blockbuster|landmark|record[- ](?:deal|contract|extension|signing))\b", 3.5),
]
# Speculation, money, term, pick and trade patterns.
SPECULATION = (
    r"(?i)(\?)|^\W*(why|should|could|would|how|what|is it|did|will)\b|\b(smart bet|overpay|should be careful|preview|"
    r"rumou?rs?|report:|insider|mailbag|grade[sd]?|takeaways?|analysis|what we learned|power rankings|way-too-early|"
    r"dangle|big board|trade bait|could be|might be|linked to|interested in)\b"
)
MONEY = r"(?i)\$\s?(\d+(?:\.\d+)?)\s*(?:m\b|million)"
LONG_TERM = r"(?i)\b(eight|seven|six)-year\b"
PICK = r"(?i)\b(no\.?\s*\d+\s*(?:overall\s*)?pick|first[- ]round pick|1st[- ]round pick)\b"
TRADE_VERB = r"(?i)\b(trade[ds]?|trading|acquir|sign-?and-?trade)"
# Transaction classes in the order they are tried.
TRANSACTION_CLASSES = [
    (r"(?i)\bsuspen", "SUSPENSION"),
    (r"(?i)\b(injured reserve|ltir|\bir\b|placed on (?:long-term )?injured)", "IR"),
    (r"(?i)\b(waiv|claim)", "WAIVER"),
    (r"(?i)\brecall", "RECALL"),
    (r"(?i)sign-?and-?trade", "TRADE"),
    (r"(?i)\b(re-?sign|signs?|signed|signing|inks?|extension|extends?)\b", "SIGNING"),
    (r"(?i)\b(trade[ds]?|trading|acquir)\b", "TRADE"),
]
SIGNING_MOVE = (
    r"(?i)\b(signs?|signed|re-?signs?|re-?signed|inks?|agree[sd]? to (?:a |terms)|signing|extension|extend[sd]?)\b"
)
TRADE_MOVE = r"(?i)\b(trade[sd]?|trading|acquir(?:e|es|ed|ing)|deals?|dealt|sign-?and-?trade)\b"
TRADE_TALK = (
    r"(?i)\b(trade (?:list|calls?|talks?|rumou?rs?|request|deadline|preview|market|board|bait|chip|winners?|losers?)|"
    r"after .{0,30}\btrade\b|are more trades|on the (?:trade )?block|trade (?:scenarios?|targets?))\b"
)
BIG_NEWS = 3.0


def speculative(title: str, link: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(link), F.lit(""))), F.lit("/video/")) | F.coalesce(
        F.col(title).rlike(SPECULATION), F.lit(False)
    )


def transaction_type(title: str) -> Column:
    pattern, name = TRANSACTION_CLASSES[0]
    chain = F.when(F.col(title).rlike(pattern), name)
    for pattern, name in TRANSACTION_CLASSES[1:]:
        chain = chain.when(F.col(title).rlike(pattern), name)
    return chain.otherwise("OTHER")


def money_score(title: str) -> Column:
    """Best tier among the amounts named; a long term alone reaches the top tier."""
    amounts = F.transform(F.regexp_extract_all(F.col(title), F.lit(MONEY), F.lit(1)), lambda a: a.cast("double"))
    tier = lambda a: F.when(a >= 9, 2.0).when(a >= 6, 1.5).when(a >= 4, 1.0).otherwise(0.0)
    best = F.coalesce(F.array_max(F.transform(amounts, tier)), F.lit(0.0))
    return F.when(F.col(title).rlike(LONG_TERM), 2.0).otherwise(best)


def big_news_score(title: str, link: str, kind: str, marquee: list[str] = ()) -> Column:
    """Additive score of a headline; ``marquee`` names add 2 when one appears as a whole word."""
    t = F.col(title)
    score = sum((F.when(t.rlike(p), w).otherwise(0.0) for p, w in TOPICS), F.lit(0.0)) + money_score(title)
    if marquee:
        score = score + F.when(t.rlike(r"(?i)\b(?:" + "|".join(marquee) + r")\b"), 2.0).otherwise(0.0)
    is_trade = (F.col(kind) == "TRADE") | t.rlike(TRADE_VERB)
    score = score + F.when(is_trade, F.when(t.rlike(PICK), 3.0).otherwise(1.0)).otherwise(0.0)
    score = score + F.when(F.col(kind) == "SUSPENSION", 4.0).when(F.col(kind) == "IR", 1.0).otherwise(0.0)
    return score - F.when(speculative(title, link), 4.0).otherwise(0.0)


def is_real_move(title: str, link: str, kind: str) -> Column:
    """Reads like an executed signing or trade."""
    t, k = F.col(title), F.col(kind)
    move = (
        F.when(k == "SIGNING", t.rlike(SIGNING_MOVE))
        .when(k == "TRADE", ~t.rlike(TRADE_TALK) & t.rlike(TRADE_MOVE))
        .otherwise(False)
    )
    return ~speculative(title, link) & move


def editorial_feed(items: DataFrame, pulse: int = 8, moves: int = 10, marquee: list[str] = ()) -> DataFrame:
    """Three capped sections: highest scoring news, executed signings, executed trades.

    Among the highest scoring news a link appears once (the first item wins); an item without a link stands
    for itself. Signings and trades keep all items. Sections sort by score and recency.
    """
    rows = items.withColumn("kind", transaction_type("title"))
    rows = rows.withColumn("score", big_news_score("title", "link", "kind", marquee))
    real = is_real_move("title", "link", "kind")
    tags = F.array_compact(
        F.array(
            F.when(F.col("score") >= BIG_NEWS, "pulse"),
            F.when(real & (F.col("kind") == "SIGNING"), "signings"),
            F.when(real & (F.col("kind") == "TRADE"), "trades"),
        )
    )
    in_pulse = F.col("section") == "pulse"
    own = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    story = F.when(in_pulse, F.coalesce(F.nullif(F.col("link"), F.lit("")), own)).otherwise(own)
    tagged = rows.withColumn("section", F.explode(tags)).withColumn("_story", story)
    rest = [c for c in tagged.columns if c not in ("section", "_story")]
    once = tagged.groupBy("section", "_story").agg(F.min_by(F.struct(*rest), "item_id").alias("r")).select("section", "r.*")
    order = [
        F.when(in_pulse, F.col("score")).otherwise(0.0).desc(),
        F.desc_nulls_last("pub_date"),
        F.asc("item_id"),
    ]
    return top_k(once, ["section"], order, max(pulse, moves), "position").where(
        F.col("position") <= F.when(in_pulse, pulse).otherwise(moves)
    )

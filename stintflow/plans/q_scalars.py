"""Scalar functions over names, text, clocks, coordinates, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.functions import geometry, jsonx, news, text
from stintflow.operators import contracts, ratings, reports, tables
from stintflow.plans.bindings import cte
from stintflow.plans.q_filters import VALUED
from stintflow.plans.registry import query
from stintflow.plans.shape import big, joined, r

ACC = "translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


@query(
    "str1_name_normalise",
    f"SELECT doc_id, md5(regexp_replace({ACC}, '[^a-z0-9]+', '', 'g')) AS key_md5 FROM documents",
)
def str1(t):
    return t.documents.select("doc_id", F.md5(text.name_key(F.col("text"))).alias("key_md5"))


NFKD_CASES = [("É", "e"), ("e\u0301", "e"), ("ﬁ", "fi"), ("ø", ""), ("½", "12"), ("Ⅷ", "viii"), ("Ｚ", "z"), ("ĳ", "ij")]


@query(
    "str1_nfkd_names",
    "SELECT c_custkey, 'customer' || CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(NFKD_CASES))
    + " END || regexp_extract(c_name, '[0-9]+') AS key FROM customer",
)
def str1n(t):
    letter = F.element_at(F.array(*[F.lit(x) for x, _ in NFKD_CASES]), (F.col("c_custkey") % 8 + 1).cast("int"))
    name = F.concat(F.lit("Customer "), letter, F.lit(" #"), F.regexp_extract("c_name", "[0-9]+", 0))
    return t.customer.select("c_custkey", text.name_key(name).alias("key"))


@query(
    "str2_slug",
    "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part",
)
def str2(t):
    return t.part.select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query(
    "str3_flip_and_position",
    """SELECT p_partkey, trim(split_part(p_brand, '#', 2)) || ' ' || p_name AS flipped,
  CASE p_partkey % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'RW' WHEN 2 THEN 'G' ELSE '' END AS position FROM part""",
)
def str3(t):
    listed = F.concat(F.col("p_name"), F.lit(", "), F.split_part("p_brand", F.lit("#"), F.lit(2)))
    raw = F.element_at(F.array(*[F.lit(x) for x in ("rd, ld", "RW, LW", "g", None)]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", text.flip_name(listed).alias("flipped"), text.primary_position(raw).alias("position"))


@query(
    "str4_mojibake_repair",
    "SELECT doc_id, md5(text) AS fixed_md5, regexp_matches(text, '[^\\x00-\\x7F]') AS was_broken FROM documents",
)
def str4(t):
    # break every text by reading its UTF-8 bytes as Latin-1, then repair it
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.documents.select("doc_id", F.md5(text.repair_mojibake(broken)).alias("fixed_md5"), (broken != F.col("text")).alias("was_broken"))


@query("str4_cleanest_variant", "SELECT doc_id, md5(text) AS name_md5 FROM documents")
def str4c(t):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    rows = t.documents.select("doc_id", F.explode(F.array(broken, F.col("text"))).alias("name"))
    return text.cleanest_variant(rows, ["doc_id"], "name").select("doc_id", F.md5("name").alias("name_md5"))


CLOCK = "CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE lpad(CAST((abs_secs % 1200) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs_secs % 60 AS VARCHAR), 2, '0') END"


@query(
    "str5_dt3_clock",
    cte("plays", c=f"SELECT event_id, period, {CLOCK} AS clock FROM plays")
    + """SELECT event_id, clock, CASE WHEN clock = 'bad' THEN 0 ELSE CAST(split_part(clock, ':', 1) AS BIGINT) * 60 + CAST(split_part(clock, ':', 2) AS BIGINT) END AS secs,
  (period - 1) * 1200 + CASE WHEN clock = 'bad' THEN 0 ELSE CAST(split_part(clock, ':', 1) AS BIGINT) * 60 + CAST(split_part(clock, ':', 2) AS BIGINT) END AS game_secs,
  CASE WHEN clock = 'bad' THEN '0:00' ELSE CAST(CAST(split_part(clock, ':', 1) AS BIGINT) AS VARCHAR) || ':' || split_part(clock, ':', 2) END AS shown FROM c""",
)
def str5(t):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(
        F.concat(two(F.expr("(abs_secs % 1200) div 60")), F.lit(":"), two(F.col("abs_secs") % 60))
    )
    rows = t.plays.select("event_id", "period", clock.alias("clock")).withColumn("secs", text.clock_to_secs(F.col("clock")))
    return rows.select(
        "event_id", "clock", "secs", geometry.absolute_secs("period", "secs").alias("game_secs"), text.secs_to_clock(F.col("secs")).alias("shown")
    )


def sql_rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(title, {sql_rx(p)}) THEN '{n}'" for p, n in news.TRANSACTION_CLASSES) + " ELSE 'OTHER' END"
SPEC_SQL = f"(contains(lower(coalesce(link, '')), '/video/') OR regexp_matches(title, {sql_rx(news.SPECULATION)}))"
MONEY_SQL = f"""CASE WHEN regexp_matches(title, {sql_rx(news.LONG_TERM)}) THEN 2e0 ELSE coalesce(list_max(list_transform(regexp_extract_all(title, {sql_rx(news.MONEY)}, 1),
  lambda a: CASE WHEN CAST(a AS DOUBLE) >= 9 THEN 2e0 WHEN CAST(a AS DOUBLE) >= 6 THEN 1.5e0 WHEN CAST(a AS DOUBLE) >= 4 THEN 1e0 ELSE 0e0 END)), 0e0) END"""
SCORE_SQL = (
    " + ".join(f"CASE WHEN regexp_matches(title, {sql_rx(p)}) THEN {w}::DOUBLE ELSE 0e0 END" for p, w in news.TOPICS)
    + f" + {MONEY_SQL}"
    + f" + CASE WHEN kind = 'TRADE' OR regexp_matches(title, {sql_rx(news.TRADE_VERB)}) THEN CASE WHEN regexp_matches(title, {sql_rx(news.PICK)}) THEN 3e0 ELSE 1e0 END ELSE 0e0 END"
    + " + CASE kind WHEN 'SUSPENSION' THEN 4e0 WHEN 'IR' THEN 1e0 ELSE 0e0 END"
    + f" - CASE WHEN {SPEC_SQL} THEN 4e0 ELSE 0e0 END"
)
REAL_SQL = f"""(NOT {SPEC_SQL} AND CASE kind WHEN 'SIGNING' THEN regexp_matches(title, {sql_rx(news.SIGNING_MOVE)})
  WHEN 'TRADE' THEN NOT regexp_matches(title, {sql_rx(news.TRADE_TALK)}) AND regexp_matches(title, {sql_rx(news.TRADE_MOVE)}) ELSE false END)"""
KINDED = f"SELECT *, {KIND_SQL} AS kind FROM news"


def kinded(t):
    return t.news.withColumn("kind", news.transaction_type("title"))


@query("str6_headline_score", cte("news", k=KINDED) + f"SELECT item_id, {SCORE_SQL} AS score FROM k")
def str6(t):
    return kinded(t).select("item_id", news.big_news_score("title", "link", "kind").alias("score"))


@query("str7_transaction_type", cte("news", k=KINDED) + "SELECT item_id, kind FROM k")
def str7(t):
    return kinded(t).select("item_id", "kind")


@query("str8_real_move", cte("news", k=KINDED) + f"SELECT item_id, {REAL_SQL} AS real_move FROM k")
def str8(t):
    return kinded(t).select("item_id", news.is_real_move("title", "link", "kind").alias("real_move"))


@query(
    "k41_editorial_feed",
    cte("news", k=KINDED, s=f"SELECT *, {SCORE_SQL} AS score, {REAL_SQL} AS real FROM k",
        x="SELECT *, 'pulse' AS section, score AS sk FROM s WHERE score >= 3 QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(link, ''), 'item ' || item_id) ORDER BY item_id) = 1 UNION ALL SELECT *, 'signings', 0e0 FROM s WHERE real AND kind = 'SIGNING' UNION ALL SELECT *, 'trades', 0e0 FROM s WHERE real AND kind = 'TRADE'")
    + """SELECT section, row_number() OVER (PARTITION BY section ORDER BY sk DESC, pub_date DESC, item_id) AS position, item_id, title, score FROM x QUALIFY position <= CASE section WHEN 'pulse' THEN 8 ELSE 10 END""",
)
def k41(t):
    return news.editorial_feed(t.news).select("section", big("position"), "item_id", "title", "score")


@query(
    "str9_labels",
    """SELECT o_orderkey, CAST(o_orderkey % 7 AS VARCHAR) || 'v' || CAST(o_orderkey % 6 AS VARCHAR) AS strength,
  CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS season,
  CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 7 >= 4 THEN 'won series' WHEN o_orderkey % 7 > o_orderkey % 5 THEN 'leads' WHEN o_orderkey % 7 < o_orderkey % 5 THEN 'trails' ELSE 'tied' END
   || ' ' || CAST(o_orderkey % 7 AS VARCHAR) || '-' || CAST(o_orderkey % 5 AS VARCHAR) || ' vs T' AS series FROM orders""",
)
def str9(t):
    wins, opp = F.col("o_orderkey") % 7, F.col("o_orderkey") % 5
    return t.orders.select(
        "o_orderkey",
        F.concat(wins.cast("string"), F.lit("v"), (F.col("o_orderkey") % 6).cast("string")).alias("strength"),
        text.season_label(F.year("o_orderdate")).alias("season"),
        text.series_text(wins, opp, F.lit("T"), (opp == 4) | (wins >= 4)).alias("series"),
    )


@query(
    "dt1_age_and_years_left",
    """SELECT o_orderkey, date_diff('year', d, DATE '2024-06-15') - CASE WHEN month(d) * 100 + day(d) > 615 THEN 1 ELSE 0 END AS age,
  greatest(0, year(d) + 30 - 2024)::BIGINT AS years_left FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def dt1(t):
    born = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        geometry.age_at(born, F.lit("2024-06-15").cast("date")).cast("bigint").alias("age"),
        F.greatest(F.lit(0), F.year(born) + 30 - 2024).cast("bigint").alias("years_left"),
    )


@query(
    "dt2_timestamp_parse",
    """SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS utc, strftime(CAST(ts AS DATE) + INTERVAL 7 DAY, '%Y-%m-%d') AS week_later FROM events""",
)
def dt2(t):
    rfc = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0500"))
    return t.events.select(
        "event_id",
        F.date_format(geometry.rfc822_to_utc(rfc), "yyyy-MM-dd HH:mm:ss").alias("utc"),
        F.date_format(F.date_add(F.to_date("ts"), 7), "yyyy-MM-dd").alias("week_later"),
    )


XY = "SELECT event_id, player_id, k - 50 AS x, (k * 7) % 85 - 42 AS y FROM plays"


@query(
    "m1_coordinates",
    cte("plays", p=XY)
    + """SELECT event_id, abs(x)::BIGINT AS x_norm, (CASE WHEN x < 0 THEN -y ELSE y END)::BIGINT AS y_norm, round(sqrt((89e0 - abs(x)) * (89e0 - abs(x)) + y * y), 6) AS distance,
  round(CASE WHEN abs(x) = 89 THEN CASE WHEN y <> 0 THEN pi() / 2 ELSE 0 END ELSE atan2(abs(y)::DOUBLE, 89e0 - abs(x)) END, 6) AS angle FROM p""",
)
def m1(t):
    rows = t.plays.select("event_id", (F.col("k") - 50).alias("x"), (F.col("k") * 7 % 85 - 42).alias("y"))
    g = geometry.shot_geometry(rows, "x", "y")
    return g.select("event_id", "x_norm", "y_norm", r("distance_from_net", 6, "distance"), r("angle_from_center", 6, "angle"))


@query(
    "m2_off_wing",
    cte("plays", p=XY)
    + """SELECT event_id, CASE WHEN player_id % 5 = 0 THEN NULL WHEN player_id % 2 = 0 AND y < 0 THEN 1e0 WHEN player_id % 2 = 1 AND y > 0 THEN 1e0 ELSE 0e0 END AS off_wing FROM p""",
)
def m2(t):
    hand = F.when(F.col("player_id") % 5 != 0, F.when(F.col("player_id") % 2 == 0, "L").otherwise("R"))
    return t.plays.select("event_id", geometry.off_wing(hand, F.col("k") * 7 % 85 - 42).alias("off_wing"))


@query(
    "m4_shrink_to_prior",
    """SELECT c_custkey, round(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal ELSE n / (n + 20e0) * c_acctbal + (1 - n / (n + 20e0)) * 1000e0 END, 6) AS shrunk
FROM (SELECT c_custkey, c_acctbal, c_custkey % 90 AS n FROM customer)""",
)
def m4(t):
    prior = F.when(F.col("c_custkey") % 4 != 0, F.lit(1000.0))
    return t.customer.select("c_custkey", r(ratings.shrink(F.col("c_acctbal"), prior, F.col("c_custkey") % 90, 20.0), 6, "shrunk"))


def rd(expr: str) -> str:
    """SQL for two decimals rounded as a decimal number."""
    return f"round(CAST({expr} AS DECIMAL(20, 6)), 2)::DOUBLE"


DECLINED = "gar * pow(0.92e0, greatest(0, least(3, age + 3 - CASE WHEN position = 'D' THEN 33 ELSE 30 END + 1)))"
VALUE_TABLE = f"""SELECT *, CASE WHEN cap_hit > 0 THEN {rd('gar / cap_hit')} END AS gar_per_million,
  CASE WHEN cap_hit > 0 THEN {rd('off_gar / cap_hit')} END AS off_gar_per_million,
  CASE WHEN cap_hit > 0 THEN {rd('def_gar / cap_hit')} END AS def_gar_per_million,
  {rd('gar - xgar')} AS sustainability_score, {rd('gar * mult')} AS expected_market_value, {rd('gar * mult - cap_hit')} AS surplus_value,
  CASE WHEN age < 25 THEN 'pre_peak' WHEN age <= 29 THEN 'peak' WHEN age >= 30 THEN 'post_peak' END AS age_flag,
  CASE WHEN position <> 'G' THEN {rd(DECLINED)} END AS projected_gar_y3 FROM (
  SELECT *, {rd('gar * s')} AS off_gar, {rd('gar - gar * s')} AS def_gar FROM (
    SELECT *, CASE WHEN position = 'G' THEN 0.45e0 ELSE 1.85e0 END AS mult,
      CASE WHEN position = 'D' THEN greatest(0.2e0, least(0.55e0, 0.25e0 + ixg_60 / (SELECT max(ixg_60) FROM contracts) * 0.45e0))
        ELSE greatest(0.45e0, least(0.85e0, 0.5e0 + ixg_60 / (SELECT max(ixg_60) FROM contracts) * 0.5e0)) END AS s FROM v))"""


def valued(t):
    return contracts.value_table(t.contracts)


@query(
    "m5_k39_contract_value",
    cte("contracts", v=VALUED, f=VALUE_TABLE)
    + f"""SELECT player_id, contract_type, off_gar, def_gar, gar_per_million, off_gar_per_million, def_gar_per_million, sustainability_score, expected_market_value,
  surplus_value, age_flag, projected_gar_y3, CASE WHEN cap_hit > 0 THEN {rd('projected_gar_y3 * 1.85e0 - cap_hit')} END AS projected_surplus_y3 FROM f""",
)
def m5(t):
    cols = (
        "player_id contract_type off_gar def_gar gar_per_million off_gar_per_million def_gar_per_million sustainability_score "
        "expected_market_value surplus_value age_flag projected_gar_y3 projected_surplus_y3"
    ).split()
    return valued(t).select(*cols)


@query("m3_age_projection", cte("contracts") + f"SELECT player_id, {rd(DECLINED)} AS y3 FROM contracts")
def m3(t):
    value = contracts.projected(F.col("gar"), F.col("position"), F.col("age"), F.lit(3))
    return t.contracts.select("player_id", value.alias("y3"))


@query(
    "m6_quality_start_rate",
    cte("team_games")
    + """SELECT team, count(*) AS starts, count(*) FILTER (1 - ga / n >= 0.917e0 OR ga <= 2) AS qs, round(100e0 * count(*) FILTER (1 - ga / n >= 0.917e0 OR ga <= 2) / count(*), 1) AS qs_pct
FROM (SELECT *, (ga + match_id % 40)::DOUBLE AS n FROM team_games) WHERE n >= 1 GROUP BY 1""",
)
def m6(t):
    rows = t.team_games.withColumn("shots", F.col("ga") + F.col("match_id") % 40)
    return reports.quality_starts(rows, "team", "shots", "ga")


@query(
    "m7_dilution_rescale",
    cte("skater_lines", p="SELECT player_id, coalesce(sum(DISTINCT CASE WHEN season <= 1990 + player_id % 12 THEN season - 1990 END), 0)::BIGINT AS present, count(CASE WHEN season <= 1990 + player_id % 12 THEN 1 END) AS games FROM skater_lines GROUP BY 1")
    + """SELECT player_id, round(CASE WHEN present > 0 AND present < 56 AND games >= 30 THEN 56e0 / present ELSE 1 END, 6) AS rescale_factor FROM p""",
)
def m7(t):
    # players differ in how much of the record they were there for; the others' seasons count as absent
    there = F.col("season") <= 1990 + F.col("player_id") % 12
    rows = t.skater_lines.select("player_id", F.when(there, F.col("season") - 1990).alias("s"))
    seasons = rows.distinct().groupBy("player_id").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("present"))
    games = rows.groupBy("player_id").agg(F.count("s").alias("games"))
    return ratings.rescaled_shares(seasons.join(games, "player_id"), "present", 56.0, "games", 30).select("player_id", r("rescale_factor", 6, "rescale_factor"))


@query(
    "m8_thin_sample_blend",
    """SELECT c_custkey, round(CASE WHEN c_acctbal < 2000 THEN 0.4e0 * h + (1 - 0.4e0) * CASE WHEN c_custkey % 3 <> 0 THEN greatest(0, 0.001e0 * c_acctbal) ELSE 0.5e0 END ELSE h END, 6) AS share FROM (SELECT *, c_nationkey / 25e0 AS h FROM customer)""",
)
def m8(t):
    bal = F.col("c_acctbal")
    share = ratings.thin_blend(
        F.col("c_nationkey") / 25.0, 0.001 * bal, F.lit(0.5), bal < 2000, F.col("c_custkey") % 3 != 0, 0.4
    )
    return t.customer.select("c_custkey", r(share, 6, "share"))


@query(
    "m9_half_even",
    """SELECT o_orderkey, round_even(o_orderkey / 8e0, 2) AS half_even, round_even(o_orderkey / 2e0, 0) AS half_even_0 FROM orders""",
)
def m9(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.bround(k / 8.0, 2).alias("half_even"), F.bround(k / 2.0, 0).alias("half_even_0"))


@query(
    "ar1_array_functions",
    """SELECT vec_id, len(l)::BIGINT AS n, array_to_string(list_sort(list_distinct(l)), ',') AS steps, list_contains(l, 1) AS has_one, array_to_string(list_sort(list_filter(list_distinct(l), lambda x: x <> 1 AND x <> 2)), ',') AS rest,
  round((list_sum(l) - l[1]) / (len(l) - 1)::DOUBLE, 6) AS mean_less_first FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 10)::BIGINT) AS l FROM embeddings)""",
)
def ar1(t):
    steps = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 10)).alias("l"))
    whole = F.aggregate("l", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    rows = steps.select(
        "vec_id",
        F.size("l").cast("bigint").alias("n"),
        F.array_sort(F.array_distinct("l")).alias("steps"),
        F.array_contains("l", F.lit(1).cast("bigint")).alias("has_one"),
        F.array_sort(F.array_except("l", F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))).alias("rest"),
        r((whole - F.get("l", F.lit(0))) / (F.size("l") - 1), 6, "mean_less_first"),
    )
    return rows.select("vec_id", "n", joined("steps"), "has_one", joined("rest"), "mean_less_first")


@query(
    "ar2_ragged_flatten",
    """SELECT vec_id, (unnest(range(len(embedding)::BIGINT)))::BIGINT AS pos, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings""",
)
def ar2(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", big("pos"), r(F.col("value").cast("double"), 6, "value")
    )


@query(
    "map1_lookup_with_default",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'O' ELSE 'N' END AS zone FROM orders""",
)
def map1(t):
    return t.orders.select("o_orderkey", tables.map_with_default(F.col("o_orderstatus"), {"F": "D", "O": "O"}, "N").alias("zone"))


@query(
    "js1_json_get_with_default",
    """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, 'none' AS missing, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'plain ' || event_type END AS name FROM events""",
)
def js1(t):
    # the same field arrives as a plain string or as {"default": ...}
    union = F.when(
        F.col("event_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("event_type").alias("default")).alias("name")))
    ).otherwise(F.to_json(F.struct(F.concat(F.lit("plain "), "event_type").alias("name"))))
    return t.events.select(
        "event_id",
        jsonx.get("props", "$.k", "bigint", 0).alias("k"),
        jsonx.get("props", "$.absent", "string", "none").alias("missing"),
        jsonx.text_or_default(union, "name").alias("name"),
    )


@query(
    "js2_k52_nested_flatten",
    """SELECT l_orderkey AS game, l_linenumber::BIGINT AS period, l_partkey AS goal, l_suppkey AS scorer FROM lineitem""",
)
def js2(t):
    goals = F.array(F.struct(F.col("l_partkey").alias("goal"), F.col("l_suppkey").alias("scorer")))
    periods = F.array(F.struct(F.col("l_linenumber").alias("period"), goals.alias("goals")))
    games = t.lineitem.select("l_orderkey", F.to_json(periods).alias("doc"))
    schema = "array<struct<period: bigint, goals: array<struct<goal: bigint, scorer: bigint>>>>"
    return jsonx.flatten_nested(games, "doc", schema, "l_orderkey", "goals").select(
        F.col("l_orderkey").alias("game"), "period", "goal", "scorer"
    )


def game_documents(t):
    """One summary per order: names are plain strings or objects, some games have no stars or no marked starter."""
    name = F.concat(F.lit("P"), F.col("l_partkey"))
    named = lambda rest: F.when(F.col("l_partkey") % 2 == 0, F.to_json(F.struct(name.alias("name"), *rest))).otherwise(
        F.to_json(F.struct(F.struct(name.alias("default")).alias("name"), *rest))
    )
    star = named([F.col("l_linenumber").alias("star"), F.concat(F.lit("T"), F.col("l_suppkey") % 5).alias("team")])
    goalie = named([(F.col("l_quantity") > 25).alias("starter"), F.col("l_quantity").cast("bigint").alias("saves")])
    of = lambda text, cond: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct("l_linenumber", "l_partkey", "l_quantity", text.alias("t"))))), lambda x: x["t"]
    )
    games = t.lineitem.groupBy("l_orderkey").agg(
        of(star, F.col("l_linenumber") <= 3).alias("stars"),
        of(goalie, F.col("l_linenumber") % 2 == 0).alias("home"),
        of(goalie, F.col("l_linenumber") % 2 == 1).alias("away"),
    )
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    summary = F.when(F.col("l_orderkey") % 7 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"threeStars":'), listed("stars"), F.lit("}")))
    text_doc = F.concat(
        F.lit('{"summary":'), summary, F.lit(',"boxscore":{"home":{"goalies":'), listed("home"), F.lit('},"away":{"goalies":'), listed("away"), F.lit("}}}")
    )
    return games.select(F.col("l_orderkey").alias("game"), F.parse_json(text_doc).alias("doc"))


@query(
    "k52_three_stars",
    """SELECT l_orderkey AS game, l_linenumber::BIGINT AS star, 'P' || l_partkey AS name, 'T' || (l_suppkey % 5) AS team FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 7 <> 0""",
)
def k52s(t):
    return jsonx.three_stars(game_documents(t), "game", "doc")


@query(
    "k52_starters",
    """SELECT game, side, arg_min(name, line) FILTER (starts) AS name, arg_min(saves, line) FILTER (starts) AS saves FROM (
  SELECT l_orderkey AS game, s.side, (l_linenumber * 100000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS line, 'P' || l_partkey AS name, CAST(l_quantity AS BIGINT) AS saves,
    l_quantity > 25 AND (l_linenumber % 2 = 0) = (s.side = 'home') AS starts FROM lineitem, (VALUES ('home'), ('away')) s(side)) GROUP BY 1, 2""",
)
def k52g(t):
    return jsonx.starters(game_documents(t), "game", "doc")

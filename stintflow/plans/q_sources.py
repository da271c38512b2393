"""Sources and sinks, exercised on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.operators.joins import first_non_empty
from stintflow.plans.bindings import cte
from stintflow.plans.registry import query
from stintflow.plans.shape import big, r
from stintflow.session import scratch_path
from stintflow.sources import documents, files


@query("src1_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def src1(t):
    return files.scan_parquet(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query(
    "src2_csv_scan_coerced",
    "SELECT c_name, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal, 0e0 AS absent FROM customer",
)
def src2(t):
    path = scratch_path(t.spark, "csv")
    bad = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    t.customer.select(bad.alias("c_acctbal"), "c_custkey", "c_name").write.option("header", True).csv(path)
    return files.scan_csv(t.spark, path, ["c_name"], ["c_acctbal", "absent"])


KINDS = ["goal", "shot-on-goal", "missed-shot", "blocked-shot", "hit", "takeaway", "penalty", "faceoff", "stoppage"]
# the detail fields of landed plays, as whole numbers beyond the player's
DETAILS = {
    "scoringPlayerId": 0, "shootingPlayerId": 0, "assist1PlayerId": 2, "assist2PlayerId": 4, "hittingPlayerId": 6, "hitteePlayerId": 7,
    "playerId": 8, "servedByPlayerId": 9, "drawnByPlayerId": 10, "winningPlayerId": 11, "losingPlayerId": 12, "goalieInNetId": 13,
}


def land_games(t, kinds: bool = False) -> str:
    """Play-by-play documents, each holding at most fifty plays of one game.

    With ``kinds`` every play has one of ``KINDS`` and all detail fields, whether its kind uses them or not.
    """
    path = scratch_path(t.spark, "games")
    piece = F.expr("event_id div 50")
    clock = F.format_string("%02d:%02d", F.expr("(abs_secs % 1200) div 60"), F.col("abs_secs") % 60)
    play = F.struct(
        F.col("event_id").alias("eventId"),
        F.struct(F.col("period").alias("number"), F.lit("REG").alias("periodType")).alias("periodDescriptor"),
        clock.alias("timeInPeriod"),
        F.lit("1551").alias("situationCode"),
        F.col("event_type").alias("typeDescKey"),
        F.struct(F.col("team_id").alias("eventOwnerTeamId"), F.col("player_id").alias("shootingPlayerId")).alias("details"),
    )
    if kinds:
        id_, player = F.col("event_id"), F.col("player_id")
        details = F.struct(
            F.col("team_id").alias("eventOwnerTeamId"),
            *[(player + more).alias(name) for name, more in DETAILS.items()],
            (player + id_ % 2).alias("blockingPlayerId"),
            F.when(id_ % 3 != 0, player + 20).alias("committedByPlayerId"),
            F.lit("hooking").alias("descKey"),
            (2 + id_ % 4).alias("duration"),
        )
        kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (id_ % len(KINDS) + 1).cast("int"))
        period = F.struct(F.col("period").alias("number"), F.when(id_ % 10 == 9, "SO").otherwise("REG").alias("periodType"))
        play = play.withField("details", details).withField("typeDescKey", kind).withField("periodDescriptor", period)
    spot = F.struct(F.col("team_id").alias("teamId"), F.col("player_id").alias("playerId"), F.lit("C").alias("positionCode"))
    docs = t.plays.groupBy(F.col("game_id").alias("id"), "home_team_id", piece.alias("piece")).agg(
        F.collect_list(play).alias("plays"), F.collect_set(spot).alias("rosterSpots")
    )
    docs.select(
        "id", F.substring(F.col("id").cast("string"), 1, 8).alias("gameDate"), F.struct(F.col("home_team_id").alias("id")).alias("homeTeam"), "plays", "rosterSpots"
    ).write.json(path)
    return path


@query(
    "src3_flatten_plays",
    cte("plays") + "SELECT game_id, event_id, home_team_id, period, (period - 1) * 1200 + abs_secs % 1200 AS abs_secs, event_type AS type, team_id, player_id AS shooter_id FROM plays",
)
def src3(t):
    rows = documents.flatten_plays(documents.read_games(t.spark, land_games(t)))
    return rows.select("game_id", "event_id", "home_team_id", "period", "abs_secs", "type", "team_id", "shooter_id")


@query(
    "src3_f10_play_roles",
    cte("plays", p=f"SELECT *, {KINDS!r}[event_id % {len(KINDS)} + 1] AS type FROM plays WHERE event_id % 10 <> 9")
    + """SELECT game_id, event_id, type, CASE WHEN type IN ('goal', 'shot-on-goal', 'missed-shot', 'blocked-shot') THEN player_id END AS shooter_id,
  CASE type WHEN 'goal' THEN player_id END AS scorer_id, CASE type WHEN 'goal' THEN player_id + 2 END AS assist1_id, CASE type WHEN 'goal' THEN player_id + 4 END AS assist2_id,
  CASE WHEN type = 'blocked-shot' AND event_id % 2 = 1 THEN player_id + 1 END AS blocker_id,
  CASE type WHEN 'hit' THEN player_id + 6 END AS hitter_id, CASE type WHEN 'hit' THEN player_id + 7 END AS hittee_id, CASE type WHEN 'takeaway' THEN player_id + 8 END AS player_id,
  CASE type WHEN 'penalty' THEN player_id + CASE WHEN event_id % 3 <> 0 THEN 20 ELSE 9 END END AS committed_by_id, CASE type WHEN 'penalty' THEN player_id + 10 END AS drawn_by_id,
  CASE type WHEN 'penalty' THEN 'hooking' END AS penalty_type, CASE type WHEN 'penalty' THEN 2 + event_id % 4 END AS penalty_minutes,
  CASE type WHEN 'faceoff' THEN player_id + 11 END AS faceoff_winner_id, CASE type WHEN 'faceoff' THEN player_id + 12 END AS faceoff_loser_id,
  CASE WHEN type IN ('goal', 'shot-on-goal', 'missed-shot', 'blocked-shot') THEN player_id + 13 END AS goalie_in_net_id FROM p""",
)
def src3f(t):
    return documents.flatten_roles(documents.read_games(t.spark, land_games(t, kinds=True)))


@query("src3_flatten_rosters", cte("plays") + "SELECT DISTINCT game_id, player_id, team_id FROM plays")
def src3r(t):
    return documents.flatten_rosters(documents.read_games(t.spark, land_games(t))).select("game_id", "player_id", "team_id")


@query("src3_src8_games_table", cte("plays") + "SELECT DISTINCT game_id, CAST(game_id // 1000000000 AS VARCHAR) AS date, home_team_id FROM plays")
def src3g(t):
    return documents.flatten_games(documents.read_games(t.spark, land_games(t))).select("game_id", "date", "home_team_id")


@query("src4_json_map_rows", cte("plays") + "SELECT DISTINCT CAST(game_id AS VARCHAR) AS key, home_team_id AS value FROM plays")
def src4(t):
    games = t.plays.select("game_id", "home_team_id").distinct()
    entry = F.struct(F.col("game_id").cast("string").alias("k"), F.col("home_team_id").alias("v"))
    docs = games.groupBy(F.expr("game_id div 100")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("doc"))
    return documents.json_map_rows(docs, "doc", "bigint")


@query("src5_contract_snapshot", cte("contracts") + "SELECT name, CAST(team AS VARCHAR) AS team, position, cap_hit, expiry_year, age FROM contracts")
def src5(t):
    path = scratch_path(t.spark, "snapshot")
    row = F.struct("name", F.col("team").cast("string").alias("team"), "position", "cap_hit", "expiry_year", "age")
    docs = t.contracts.groupBy(F.expr("player_id div 100")).agg(F.collect_list(row).alias("contracts"))
    whole = F.struct(F.struct(F.lit("landed").alias("source")).alias("_meta"), "contracts")
    # snapshots are indented documents, one per file
    docs.select(F.to_json(whole, {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return documents.read_contract_snapshot(t.spark, path)


@query(
    "src5_positional_decode",
    """SELECT 'First ' || c_name AS name, 'T' || c_nationkey AS team, CASE c_custkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'LW' ELSE 'G' END AS position, round((c_custkey % 140) / 10e0, 4) AS cap_hit,
  2000 + c_custkey % 9 AS expiry_year, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 40 END AS age FROM customer WHERE c_custkey % 140 > 0 AND c_custkey % 9 > 0""",
)
def src5p(t):
    k = F.col("c_custkey")
    pos = F.when(k % 3 == 0, "RD, LD").when(k % 3 == 1, "LW, C").otherwise("G")
    row = F.array(
        F.concat("c_name", F.lit(", First")), F.concat(F.lit(" t"), F.col("c_nationkey").cast("string")), pos,
        (k % 140).cast("string"), (k % 9).cast("string"), F.when(k % 5 != 0, (k % 40).cast("string")),
    )
    rows = t.customer.select(row.alias("row")).select(*documents.decode_contract_row(F.col("row"), 0, 1, 2, 3, 4, 5))
    return documents.valid_contracts(rows)


@query(
    "src6_feed_items",
    cte("news") + "SELECT title, coalesce(link, '') AS link, strftime(pub_ts, '%Y-%m-%d %H:%M:%S') AS pub_utc FROM news",
)
def src6(t):
    path = scratch_path(t.spark, "feed")
    stamp = F.coalesce(F.concat(F.date_format("pub_ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000")), F.lit("undated"))
    item = F.concat(
        F.lit("<item><title>"), "title", F.lit("</title><link>"), F.coalesce("link", F.lit("")), F.lit("</link><pubDate>"), stamp, F.lit("</pubDate></item>")
    )
    # feed documents of a hundred items, one per line
    docs = t.news.groupBy(F.expr("item_id div 100")).agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    docs.select(F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>"))).write.text(path)
    rows = documents.parse_feed(t.spark.read.text(path), "value")
    return rows.select("title", F.coalesce("link", F.lit("")).alias("link"), F.date_format("pub_ts", "yyyy-MM-dd HH:mm:ss").alias("pub_utc"))


@query(
    "src7_html_rows",
    """WITH e AS (SELECT page_id, unnest(range(1::BIGINT, len(k) + 1)) AS pos, unnest(k) AS kind, unnest(x) AS raw FROM (
  SELECT page_id, regexp_extract_all(html, '(?s)<(h1|p|li)(?:\\s[^>]*)?>(.*?)</(?:h1|p|li)>', 1) AS k, regexp_extract_all(html, '(?s)<(h1|p|li)(?:\\s[^>]*)?>(.*?)</(?:h1|p|li)>', 2) AS x FROM pages)),
s AS (SELECT page_id, pos - 1 AS pos, kind, trim(regexp_replace(raw, '(?s)<[^>]*>', '', 'g')) AS text FROM e)
SELECT page_id, pos, kind, md5(text) AS text_md5, md5(heading) AS heading_md5 FROM (
  SELECT *, last_value(CASE WHEN kind = 'h1' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM s) WHERE kind <> 'h1'""",
)
def src7(t):
    rows = documents.html_elements(t.pages, "page_id", "html", ["h1", "p", "li"])
    return documents.carry_heading(rows, "page_id", "h1").select(
        "page_id", big("pos"), "kind", F.md5("text").alias("text_md5"), F.md5("heading").alias("heading_md5")
    )


@query(
    "src7_table_records",
    """SELECT o_custkey // 20 AS page_id, 'Customer ' || o_custkey AS heading, CAST(o_orderkey AS VARCHAR) AS number, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day,
  o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS season, CAST(o_orderkey % 7 AS VARCHAR) AS goals FROM orders""",
)
def src7r(t):
    names = ["number", "status", "day", "priority", "season", "goals"]
    values = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), F.year("o_orderdate").cast("string"), (F.col("o_orderkey") % 7).cast("string")]
    cell = lambda v: F.concat(F.lit("<td> <b>"), v, F.lit("</b></td>"))
    row = F.concat(F.lit("<tr class='r'>"), *[cell(v) for v in values], F.lit("</tr><tr><td>a</td><td>b</td></tr>"))
    listed = t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    head = F.concat(F.lit("<tr><th colspan=6>Customer "), F.col("o_custkey").cast("string"), F.lit("</th></tr>"), "rows")
    pages = listed.groupBy(F.expr("o_custkey div 20").alias("page_id")).agg(F.concat_ws("", F.lit("<table>"), F.collect_list(head), F.lit("</table>")).alias("html"))
    return documents.html_records(pages, "page_id", "html", names).drop("pos")


def land_orders(t) -> str:
    path = scratch_path(t.spark, "season")
    files.write_by_season(t.orders.withColumn("season", F.year("o_orderdate")), path)
    return path


@query(
    "src8_season_table",
    "SELECT year(o_orderdate)::BIGINT AS season, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY 1",
)
def src8(t):
    rows = t.spark.read.parquet(land_orders(t))
    return rows.groupBy(F.col("season").cast("bigint").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))


@query(
    "src9_union_with_supplement",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders",
)
def src9(t):
    base, extra = scratch_path(t.spark, "base"), scratch_path(t.spark, "extra")
    t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey").write.parquet(base)
    t.orders.where("o_orderkey % 4 = 0").select("o_orderkey", "o_orderpriority").write.parquet(extra)
    return files.union_present(t.spark, [base, extra, f"{extra}-absent"])


@query(
    "src10_sinks_with_meta",
    """SELECT fmt, c_custkey, c_name, n, s FROM customer, (SELECT unnest(['csv', 'json', 'parquet']) AS fmt), (SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer)""",
)
def src10(t):
    rows = t.customer.select("c_custkey", "c_name")
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(t.spark, fmt)
        files.write_with_meta(rows, path, fmt, {"n": F.count(F.lit(1)), "s": F.sum("c_custkey")})
        meta = t.spark.read.schema("n bigint, s bigint").json(f"{path}/meta").select(F.lit(fmt).alias("fmt"), "n", "s")
        back = files.read_written(t.spark, path, fmt, "c_custkey bigint, c_name string").withColumn("fmt", F.lit(fmt))
        part = back.join(meta, "fmt")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "src11_anti_manifest",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def src11(t):
    manifest = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return files.land_new(t.orders.select("o_orderkey", "o_custkey"), manifest, "o_custkey")


@query("src12_priority_fallback", "SELECT s_suppkey AS k, s_name AS name, 1::BIGINT AS priority FROM supplier")
def src12(t):
    empty = t.customer.where("c_acctbal > 1e12").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    second = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    third = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return first_non_empty(empty, second, third).select("k", "name", big("priority"))


@query(
    "src13_key_universe",
    """WITH y AS (SELECT DISTINCT year(o_orderdate)::BIGINT AS season FROM orders), r AS (SELECT unnest([(1, 8), (2, 4), (3, 2), (4, 1)]) AS p)
SELECT season, season * 1000000 + 20000 + n AS game_id FROM y, range(1, 1313) t(n) UNION ALL
SELECT season, season * 1000000 + 30000 + p[1] * 100 + m * 10 + g FROM y, r, range(1, 9) a(m), range(1, 8) b(g) WHERE m <= p[2]""",
)
def src13(t):
    seasons = t.orders.select(F.year("o_orderdate").cast("bigint").alias("season")).distinct()
    return files.game_universe(seasons, "season")


@query(
    "src14_season_pruning",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998",
)
def src14(t):
    rows = t.spark.read.parquet(land_orders(t)).where(F.col("season").between(1997, 1998))
    return rows.select("o_orderkey", "o_totalprice")

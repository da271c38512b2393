"""Nested documents: play-by-play JSON, JSON maps, contract snapshots, feeds and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintflow.functions.geometry import rfc822_to_utc
from stintflow.functions.text import clock_to_secs, flip_name, primary_position

GAME_SCHEMA = """
id bigint, gameDate string, venue struct<default: string>, homeTeam struct<id: bigint>, awayTeam struct<id: bigint>,
rosterSpots array<struct<teamId: bigint, playerId: bigint, positionCode: string,
  firstName: struct<default: string>, lastName: struct<default: string>>>,
plays array<struct<eventId: bigint, periodDescriptor: struct<number: bigint, periodType: string>, timeInPeriod: string,
  situationCode: string, typeDescKey: string, details: struct<eventOwnerTeamId: bigint, xCoord: bigint, yCoord: bigint,
  zoneCode: string, shotType: string, shootingPlayerId: bigint, scoringPlayerId: bigint, assist1PlayerId: bigint,
  assist2PlayerId: bigint, blockingPlayerId: bigint, hittingPlayerId: bigint, hitteePlayerId: bigint, playerId: bigint,
  committedByPlayerId: bigint, servedByPlayerId: bigint, drawnByPlayerId: bigint, descKey: string, duration: bigint,
  winningPlayerId: bigint, losingPlayerId: bigint, goalieInNetId: bigint>>>
"""
# The kinds of play in which a role is filled, and the detail fields that name it, first one first.
SHOTS = ("shot-on-goal", "missed-shot", "blocked-shot")
ROLES = [
    ("shooter_id", SHOTS, ("shootingPlayerId",)),
    ("scorer_id", ("goal",), ("scoringPlayerId",)),
    ("assist1_id", ("goal",), ("assist1PlayerId",)),
    ("assist2_id", ("goal",), ("assist2PlayerId",)),
    ("blocker_id", ("blocked-shot",), ("blockingPlayerId",)),
    ("hitter_id", ("hit",), ("hittingPlayerId",)),
    ("hittee_id", ("hit",), ("hitteePlayerId",)),
    ("player_id", ("takeaway", "giveaway"), ("playerId",)),
    ("committed_by_id", ("penalty",), ("committedByPlayerId", "servedByPlayerId")),
    ("drawn_by_id", ("penalty",), ("drawnByPlayerId",)),
    ("penalty_type", ("penalty",), ("descKey",)),
    ("penalty_minutes", ("penalty",), ("duration",)),
    ("faceoff_winner_id", ("faceoff",), ("winningPlayerId",)),
    ("faceoff_loser_id", ("faceoff",), ("losingPlayerId",)),
    ("goalie_in_net_id", ("goal", *SHOTS), ("goalieInNetId",)),
]


def read_games(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GAME_SCHEMA).json(path)


def flatten_plays(games: DataFrame) -> DataFrame:
    """One row per play with the game's home team and the clock in seconds since the game began."""
    p = games.select(F.col("id").alias("game_id"), F.col("homeTeam.id").alias("home_team_id"), F.explode("plays").alias("p"))
    d = "p.details."
    period = F.coalesce("p.periodDescriptor.number", F.lit(1))
    return p.select(
        "game_id",
        "home_team_id",
        F.col("p.eventId").alias("event_id"),
        period.alias("period"),
        ((F.greatest(period, F.lit(1)) - 1) * 1200 + clock_to_secs(F.coalesce("p.timeInPeriod", F.lit("")))).alias("abs_secs"),
        F.col("p.typeDescKey").alias("type"),
        F.col("p.situationCode").alias("situation_code"),
        F.col(d + "eventOwnerTeamId").alias("team_id"),
        F.col(d + "xCoord").alias("x"),
        F.col(d + "yCoord").alias("y"),
        F.col(d + "zoneCode").alias("zone"),
        F.coalesce(d + "shootingPlayerId", d + "scoringPlayerId").alias("shooter_id"),
    )


def flatten_roles(games: DataFrame) -> DataFrame:
    """One row per play outside shootouts: who filled which role in it; roles a play does not have are null.

    The scorer of a goal is its shooter. A blocker on the side of the shot is a mistake of the feed and goes.
    """
    p = games.select(F.col("id").alias("game_id"), "rosterSpots", F.explode("plays").alias("p")).where(
        F.coalesce("p.periodDescriptor.periodType", F.lit("")) != "SO"
    )
    kind = F.col("p.typeDescKey")
    role = lambda kinds, fields: F.when(kind.isin(*kinds), F.coalesce(*[f"p.details.{f}" for f in fields]))
    columns = {name: role(kinds, fields) for name, kinds, fields in ROLES}
    columns["shooter_id"] = F.coalesce(columns["shooter_id"], columns["scorer_id"])
    owner, blocker = F.col("p.details.eventOwnerTeamId"), F.col("p.details.blockingPlayerId")
    own_side = F.exists("rosterSpots", lambda s: (s["playerId"] == blocker) & (s["teamId"] == owner))
    columns["blocker_id"] = F.when(~F.coalesce(own_side, F.lit(False)), columns["blocker_id"])
    return p.select("game_id", F.col("p.eventId").alias("event_id"), kind.alias("type"), *[c.alias(n) for n, c in columns.items()])


def flatten_rosters(games: DataFrame) -> DataFrame:
    spot = games.select(F.col("id").alias("game_id"), F.explode("rosterSpots").alias("s"))
    name = F.concat_ws(" ", "s.firstName.default", "s.lastName.default")
    return spot.select(
        "game_id", F.col("s.playerId").alias("player_id"), F.col("s.teamId").alias("team_id"), F.col("s.positionCode").alias("position_code"), name.alias("full_name")
    ).dropDuplicates(["game_id", "player_id"])


def flatten_games(games: DataFrame) -> DataFrame:
    return games.select(
        F.col("id").alias("game_id"), F.col("gameDate").alias("date"), F.col("homeTeam.id").alias("home_team_id"),
        F.col("awayTeam.id").alias("away_team_id"), F.col("venue.default").alias("venue"),
    ).dropDuplicates(["game_id"])


def json_map_rows(docs: DataFrame, doc: str, value_type: str) -> DataFrame:
    """A JSON object used as a map, one row per entry."""
    return docs.select(F.explode(F.from_json(doc, f"map<string, {value_type}>")).alias("key", "value"))


def read_contract_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files, one document each, with ``_meta`` and ``contracts``: one row per contract.

    A document may span lines; one that does not parse is an error.
    """
    schema = """_meta struct<source: string>, contracts array<struct<name: string, team: string, position: string,
      cap_hit: double, expiry_year: bigint, age: bigint>>"""
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return docs.select(F.explode("contracts").alias("c")).select("c.*")


def decode_contract_row(row: Column, name: int, team: int, position: int, cap: int, expiry: int, age: int) -> list[Column]:
    """A positional text array as contract columns: money is tenths of $M, the expiry year has two digits."""
    at = lambda i: F.get(row, F.lit(i))
    cap_hit = F.round(at(cap).try_cast("double") / 10.0, 4)
    return [
        flip_name(at(name)).alias("name"),
        F.upper(F.trim(at(team))).alias("team"),
        primary_position(at(position)).alias("position"),
        cap_hit.alias("cap_hit"),
        (2000 + at(expiry).try_cast("bigint")).alias("expiry_year"),
        at(age).try_cast("bigint").alias("age"),
    ]


def valid_contracts(rows: DataFrame) -> DataFrame:
    """Unsigned, unnamed and dateless rows drop out."""
    return rows.where("name <> '' AND team <> '' AND cap_hit > 0 AND expiry_year > 2000")


FEED_SCHEMA = "channel struct<item: array<struct<title: string, link: string, pubDate: string>>>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files, one document each."""
    return parse_feed(spark.read.text(path, wholetext=True), "value")


def parse_feed(docs: DataFrame, doc: str) -> DataFrame:
    """RSS documents to items with their date in UTC (null when it does not parse)."""
    items = docs.select(F.explode(F.from_xml(doc, FEED_SCHEMA)["channel"]["item"]).alias("i")).select("i.*")
    dated = F.col("pubDate").rlike("^[A-Za-z]{3}, [0-9]+ [A-Za-z]{3} [0-9]{4} [0-9:]{8} ")
    stamp = F.when(dated, rfc822_to_utc(F.col("pubDate")))
    return items.select(F.trim("title").alias("title"), F.trim("link").alias("link"), stamp.alias("pub_ts"))


def html_elements(pages: DataFrame, key: str, html: str, tags: list[str]) -> DataFrame:
    """Elements of the given tags in page order with their inner text, markup stripped."""
    names = "|".join(tags)
    kinds = F.regexp_extract_all(F.col(html), F.lit(f"(?s)<({names})(?:\\s[^>]*)?>(.*?)</(?:{names})>"), F.lit(1))
    texts = F.regexp_extract_all(F.col(html), F.lit(f"(?s)<({names})(?:\\s[^>]*)?>(.*?)</(?:{names})>"), F.lit(2))
    strip = lambda x: F.trim(F.regexp_replace(x, "(?s)<[^>]*>", ""))
    rows = pages.select(key, F.posexplode(F.arrays_zip(kinds.alias("k"), texts.alias("t"))).alias("pos", "e"))
    return rows.select(key, "pos", F.col("e.k").alias("kind"), strip(F.col("e.t")).alias("text"))


def carry_heading(elements: DataFrame, key: str, heading_kind: str) -> DataFrame:
    """Rows below a heading get the heading's text; a window here holds one page."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.col("kind") == heading_kind, F.col("text")), ignorenulls=True).over(w)
    return elements.withColumn("heading", heading).where(F.col("kind") != heading_kind)


def html_records(pages: DataFrame, key: str, html: str, names: list[str]) -> DataFrame:
    """Table rows as records under the heading row before them: ``key, pos, heading`` and the named cells.

    A row with a single cell is a heading; a row with as many cells as ``names`` is a record; others drop out.
    """
    inner = F.regexp_extract_all(F.col(html), F.lit("(?s)<tr(?:\\s[^>]*)?>(.*?)</tr>"), F.lit(1))
    strip = lambda x: F.trim(F.regexp_replace(x, "(?s)<[^>]*>", ""))
    rows = pages.select(key, F.posexplode(inner).alias("pos", "row"))
    found = F.regexp_extract_all("row", F.lit("(?s)<t[dh](?:\\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1))
    rows = rows.select(key, "pos", F.transform(found, strip).alias("cells"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.size("cells") == 1, F.col("cells")[0]), ignorenulls=True).over(w)
    held = rows.withColumn("heading", heading).where(F.size("cells") == len(names))
    return held.select(key, "pos", "heading", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])

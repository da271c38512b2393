"""Streaming queries, each drained over the event files and compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.plans.bindings import Tables, cte
from stintflow.plans.q_models import FEATURE_CTES, play_list
from stintflow.plans.registry import query

from stintflow.session import scratch_path
from stintflow.streaming import streams


PARTS = 4


def event_stream(t, extra=()):
    """The events as they would arrive: several files in order of time, one per micro-batch."""
    folder, files = streams.land_in_order(t.events, "ts", PARTS, extra)
    rows = streams.file_stream(t.spark, folder, "*.parquet", t.events.schema, per_trigger=files)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


def stamp(col):
    return F.date_format(F.col(col).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


@query("s1_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def s1(t):
    rows = streams.dedupe(event_stream(t), "ts", ["user_id", "event_type"], "60 days")
    return streams.drain(rows, "append").select("user_id", "event_type")


def sums():
    return [F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")]


@query(
    "s2_s3_stream_tumbling",
    """SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""",
)
def s3(t):
    # the first two days come once more at the very end, behind the watermark: they must not count twice
    start = t.events.agg(F.min("ts").alias("m")).scalar()
    late = t.events.where(F.col("ts") < start + F.expr("INTERVAL 2 DAYS"))
    rows = streams.tumbling(event_stream(t, [late]), "ts", "10 minutes", ["event_type"], sums(), "1 day")
    final = streams.latest_per_key(streams.drain(rows, "update"), ["w", "event_type"])
    return final.select(stamp("w.start").alias("start"), "event_type", "n", "cents")


@query(
    "s3_stream_sliding",
    """SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * i) MINUTE, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events, range(0, 2) r(i) GROUP BY 1""",
)
def s3s(t):
    rows = streams.tumbling(event_stream(t), "ts", "1 hour", [], sums(), "1 day", slide="30 minutes")
    final = streams.latest_per_key(streams.drain(rows, "update"), ["w"])
    return final.select(stamp("w.start").alias("start"), "n", "cents")


@query(
    "s3_stream_session",
    """WITH l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM s GROUP BY user_id, sid""",
)
def s3x(t):
    # one row far ahead closes all sessions, so that each is emitted once and its state goes
    rows = streams.sessions(event_stream(t, [closing_row(t, -1)]), "ts", "2 hours", ["user_id"], sums(), "1 day")
    return streams.drain(rows, "append").where("user_id >= 0").select("user_id", stamp("w.start").alias("start"), "n", "cents")


def played_at():
    day = F.to_timestamp(F.expr("string(game_id div 1000000000)"), "yyyyMMdd")
    return (day.cast("bigint") + F.col("abs_secs")).cast("timestamp")


def closing_row(t, user):
    """One row far ahead of all others, which moves the watermark past them."""
    last = t.events.orderBy(F.desc("ts"), "event_id").limit(1)
    kind = t.events.schema["user_id"].dataType
    return last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 100 DAYS")).withColumn("user_id", F.lit(user).cast(kind))


def live_features(t, extra, report=None):
    """Plays may come a minute out of order; the watermark allows for 40 days, so that late ones reach their game."""
    plays = play_list(_StreamTables(t, extra)).withColumn("at", played_at())
    return streams.drain(streams.shot_features(plays, "at", "40 days", 60), "append", report)


@query(
    "s4_stream_state_features",
    cte("plays", **FEATURE_CTES) + "SELECT event_id, is_rush, is_rebound, time_since_last_shot, score_state, is_goal FROM f",
)
def s4(t):
    rows = live_features(t, [closing_row(t, -1)]).where("NOT is_late")
    return rows.select("event_id", "is_rush", "is_rebound", "time_since_last_shot", "score_state", "is_goal")


@query(
    "s4_stream_late_plays",
    """SELECT (SELECT count(*) FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 2 DAY) AS n_late,
  (SELECT count(DISTINCT (strftime(ts, '%Y%m%d'), user_id // 40)) FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 2 DAY) AS late_games, 0::BIGINT AS open_games""",
)
def s4l(t):
    # the first two days come again when all else is in: each play is late, and after the closing row no game is open but its own
    start = t.events.agg(F.min("ts").alias("m")).scalar()
    again = t.events.where(F.col("ts") < start + F.expr("INTERVAL 2 DAYS"))
    report = {}
    late = live_features(t, [again, closing_row(t, -1)], report).where("is_late")
    counted = late.agg(F.count(F.lit(1)).alias("n_late"), F.countDistinct("game_id").alias("late_games"))
    return counted.withColumn("open_games", F.lit(report["state_rows"] - 1).cast("bigint"))


class _StreamTables(Tables):
    """The same views with the event table read as a stream."""

    def __init__(self, t: Tables, extra=()):
        super().__init__(t.spark, t.sf_dir)
        self._extra = extra

    def table(self, name: str):
        if name != "events":
            return super().table(name)
        rows = super().table(name)
        folder, files = streams.land_in_order(rows, "ts", PARTS, self._extra)
        return streams.file_stream(self.spark, folder, "*.parquet", rows.schema, per_trigger=files)


@query("s5_incremental_landing", "SELECT event_id, user_id FROM events")
def s5(t):
    target = scratch_path(t.spark, "landed")
    rows = event_stream(t).select("event_id", "user_id")
    streams.land_incrementally(rows, target, "event_id", scratch_path(t.spark, "progress"))
    return t.spark.read.parquet(target).select("event_id", "user_id")


@query(
    "s6_stream_static_enrichment",
    "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 9 <> 0",
)
def s6(t):
    dim = t.customer.where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    rows = streams.enrich(event_stream(t).select("event_id", "user_id"), dim, "user_id")
    return streams.drain(rows, "append").select("event_id", "c_mktsegment")


@query(
    "ud3_rows_from_documents",
    "SELECT doc_id, count(*) AS n_lines, CAST(sum(length(x)) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY 1",
)
def ud3(t):
    """One document in, many rows out; a built-in does it, so no user code runs."""
    rows = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("line")).cast("bigint").alias("n_chars"))

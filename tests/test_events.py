"""Sequential features against a plain Python walk, batch and streaming."""

import math

import pytest
from pyspark.sql import functions as F

from stintflow.functions.classify import drop_reason
from stintflow.operators import events
from stintflow.plans.bindings import Tables
from stintflow.plans.q_models import play_list
from stintflow.streaming import streams

SF = "/root/testdata/sf0.001"


def walk(plays):
    """One game in order: the expected features by event id."""
    lead = 0
    last = shot_at = None
    out = {}
    for p in plays:
        shot = p.type in events.SHOT_TYPES
        home = p.team_id == p.home_team_id
        goalie = p.situation_code[0 if home else 3] if len(p.situation_code) == 4 else None
        if shot and p.team_id is not None and goalie != "0" and p.x is not None and p.y is not None:
            gap = math.inf if last is None else p.abs_secs - last.abs_secs
            same = last is not None and last.team_id == p.team_id
            zone = None if last is None else last.zone
            if zone and not same:
                zone = {"O": "D", "D": "O"}.get(zone, zone)
            since = 600 if shot_at is None else min(600, p.abs_secs - shot_at)
            state = max(-3, min(3, lead if home else -lead))
            rebound = last is not None and gap <= 3 and same and last.type in events.SHOT_TYPES
            out[p.event_id] = (int(gap <= 4 and zone in ("N", "D")), int(rebound), since, state, int(p.type == "goal"))
            if p.type == "goal":
                lead += 1 if home else -1
        if shot and (p.team_id is not None or p.type in events.ON_NET_TYPES):
            shot_at = p.abs_secs
        last = p
    return out


COLS = ["event_id", "is_rush", "is_rebound", "time_since_last_shot", "score_state", "is_goal"]


@pytest.fixture(scope="module")
def expected(spark):
    rows = play_list(Tables(spark, SF)).orderBy("game_id", "abs_secs", "event_id").collect()
    want, games = {}, {}
    for r in rows:
        games.setdefault(r.game_id, []).append(r)
    for plays in games.values():
        want.update(walk(plays))
    return want


def test_batch_features(spark, expected):
    out = events.sequential_shot_features(play_list(Tables(spark, SF)), ["abs_secs", "event_id"], chunk_secs=900)
    assert {r[0]: tuple(r[1:]) for r in out.select(*COLS).collect()} == expected


def with_time(plays):
    day = F.to_timestamp(F.expr("string(game_id div 1000000000)"), "yyyyMMdd")
    return plays.withColumn("at", (day.cast("bigint") + F.col("abs_secs")).cast("timestamp"))


def test_plays_out_of_order_wait_and_state_goes(spark, tmp_path):
    """Plays of one game shuffled within a minute, one that comes much later, and a row that closes the game."""
    folder, schema = str(tmp_path / "shuffled"), None
    game = [("goal", 10), ("hit", 14), ("shot-on-goal", 16), ("missed-shot", 70), ("goal", 95), ("hit", 300), ("goal", 304)]
    rows = [(k, 20240101000000001, s, kind, 1, 1, "N", "1551", 5, 5) for k, (kind, s) in enumerate(game)]
    columns = "event_id long, game_id long, abs_secs long, type string, team_id long, home_team_id long, zone string, situation_code string, x long, y long"
    end = (99, 20240301000000002, 5, "hit", 1, 1, "N", "1551", 5, 5)
    deliveries = [[rows[2], rows[0]], [rows[1], rows[4], rows[3]], [rows[6]], [rows[5], rows[1]], [end]]
    for part in deliveries:
        frame = with_time(spark.createDataFrame(part, columns))
        frame.coalesce(1).write.mode("append").parquet(folder)
        schema = frame.schema
    stream, report = streams.file_stream(spark, folder, "*.parquet", schema, per_trigger=1), {}
    out = streams.drain(streams.shot_features(stream, "at", "1 day", 60), "append", report).collect()
    plays = spark.createDataFrame(rows, columns).collect()
    assert {r.event_id: (r.is_rush, r.is_rebound, r.time_since_last_shot, r.score_state, r.is_goal) for r in out if not r.is_late} == walk(plays)
    assert [r.event_id for r in out if r.is_late] == [1]
    assert report == {"state_rows": 1, "dropped": 0}


def test_stream_over_several_batches_equals_batch(spark, expected, tmp_path):
    folder = str(tmp_path / "plays")
    plays = with_time(play_list(Tables(spark, SF))).withColumn("part", F.expr("abs_secs div 21600"))
    for i in range(4):
        plays.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
    stream = streams.file_stream(spark, folder, "*.parquet", plays.drop("part").schema, per_trigger=1)
    out = streams.drain(streams.shot_features(stream, "at", "40 days"), "append")
    assert out.select("batch_id").distinct().count() == 4
    assert {r[0]: tuple(r[1:]) for r in out.select(*COLS).collect()} == expected


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "late")
    for i, stamp in enumerate(["2024-01-10 00:00:00", "2024-01-11 12:00:00", "2024-01-01 00:00:00"]):
        rows = spark.createDataFrame([(i, stamp)], "id int, s string").select("id", F.to_timestamp("s").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(folder)
    stream = streams.file_stream(spark, folder, "*.parquet", rows.schema, per_trigger=1)
    agg = streams.tumbling(stream, "ts", "1 hour", [], [F.count(F.lit(1)).alias("n")], "1 day")
    final = streams.latest_per_key(streams.drain(agg, "update"), ["w"])
    assert final.agg(F.sum("n")).first()[0] == 2


@pytest.mark.parametrize("pair,drop", [((2, 5), 1), ((6, 6), 1), ((5, 6), 1), ((3, 6), 1), ((6, 3), 1), ((6, 4), 0), ((5, 5), 0)])
def test_garbage_strength(spark, pair, drop):
    row = spark.createDataFrame([pair], "f int, a int").select(drop_reason("f", "a").alias("r")).first()
    assert (row.r is not None) == bool(drop)

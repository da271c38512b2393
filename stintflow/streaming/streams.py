"""Structured Streaming forms of the periodic jobs."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stintflow.operators.events import MAX_LEAD, MAX_SINCE_SHOT, ON_NET_TYPES, REBOUND_SECS, RUSH_SECS, SHOT_TYPES
from stintflow.session import scratch_path


def file_stream(spark: SparkSession, folder: str, name: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Files of one name pattern as a stream; ``per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def land_in_order(rows: DataFrame, ts: str, parts: int, extra: list[DataFrame] = ()) -> tuple[str, int]:
    """Write rows in ``parts`` deliveries by rising time, then each of ``extra`` as one more; returns the folder and
    the files per delivery.

    Rows of one second stay in one delivery; a delivery is dealt to as many files as there are shuffle partitions, so
    it is written in parallel. A stream that takes that many files per trigger replays a source that delivers over
    time, for tests and backfills.
    """
    spark = rows.sparkSession
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "arrivals")
    second = F.date_trunc("second", F.col(ts)).cast("timestamp").cast("bigint")
    cuts = rows.agg(F.percentile_approx(second, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    lane = sum([F.when(second > c, 1).otherwise(0) for c in cuts], F.lit(0))
    for k in range(parts):
        rows.where(lane == k).repartition(lanes).write.mode("append").parquet(folder)
    for more in extra:
        more.select(*rows.columns).repartition(lanes).write.mode("append").parquet(folder)
    return folder, lanes


def drain(stream: DataFrame, mode: str, report: dict | None = None) -> DataFrame:
    """Run a stream over what is available now and return what it emitted, tagged by batch.

    Each batch lands under its own id and overwrites it when replayed, so a restarted batch leaves no duplicates.
    ``report`` receives how many rows of state the last batch left and how many rows came behind the watermark.
    """
    spark = stream.sparkSession
    out, check = scratch_path(spark, "stream"), scratch_path(spark, "progress")

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    handle = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(land)
        .option("checkpointLocation", check)
        .trigger(availableNow=True)
        .start()
    )
    handle.awaitTermination()
    if report is not None:
        steps = [p.stateOperators for p in handle.recentProgress if p.stateOperators]
        report["state_rows"] = sum(op.numRowsTotal for op in steps[-1]) if steps else 0
        report["dropped"] = sum(op.numRowsDroppedByWatermark for ops in steps for op in ops)
    return spark.read.option("basePath", out).parquet(out)


def latest_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Final state of an update-mode sink: the newest batch wins per key."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    best = F.max_by(F.struct(*values), "batch_id").alias("v")
    return updates.groupBy(*keys).agg(best).select(*keys, "v.*")


def dedupe(stream: DataFrame, ts: str, keys: list[str], lateness: str) -> DataFrame:
    """First arrival per key within the lateness bound; state of older keys is dropped."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, ts: str, width: str, keys: list[str], aggs, lateness: str, slide: str | None = None) -> DataFrame:
    """Window aggregate; with ``slide`` windows overlap. Rows later than ``lateness`` are left out."""
    bucket = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, lateness).groupBy(bucket.alias("w"), *keys).agg(*aggs)


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], aggs, lateness: str) -> DataFrame:
    return stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)


def enrich(stream: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Stream-static left join; a small dimension is broadcast by its own statistics."""
    return stream.join(dim, on, "left")


def land_incrementally(stream: DataFrame, target: str, key: str, check: str) -> None:
    """Append rows with unseen keys per micro-batch; replaying a batch rewrites only its own folder."""
    spark = stream.sparkSession

    def land(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates([key])
        if batch_id > 0:
            seen = spark.read.option("basePath", target).parquet(target).where(F.col("batch_id") < batch_id)
            fresh = fresh.join(seen.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(land).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


# task code travels with the plan, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURE_SCHEMA = (
    "game_id bigint, event_id bigint, is_rush bigint, is_rebound bigint, time_since_last_shot bigint, score_state bigint, "
    "is_goal bigint, is_late boolean"
)
STATE_SCHEMA = "abs_secs bigint, event_id bigint, zone string, type string, team double, last_shot double, lead bigint, waiting binary"


def _placed(key, chunks: Iterator[pd.DataFrame], state: GroupState, reorder_secs: int):
    """The plays that can be placed now, those that wait, those that came too late, and what was stored."""
    old = state.get if state.exists else None
    waiting = pickle.loads(old[7]) if old is not None and old[7] else None
    if state.hasTimedOut:
        return waiting, None, None, old
    plays = pd.concat(list(chunks), ignore_index=True)
    late = pd.Series(False, index=plays.index)
    if old is not None and old[0] is not None:
        # a play older than the newest one handled cannot be placed any more
        late = (plays.abs_secs < old[0]) | ((plays.abs_secs == old[0]) & (plays.event_id <= old[1]))
    if waiting is not None:
        late |= plays.event_id.isin(waiting.event_id)
    whole = plays[~late] if waiting is None else pd.concat([waiting, plays[~late]], ignore_index=True)
    ready = whole.abs_secs <= whole.abs_secs.max() - reorder_secs
    return whole[ready], whole[~ready], plays[late], old


def _features(reorder_secs: int):
    def run(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        plays, waiting, late, old = _placed(key, chunks, state, reorder_secs)
        if late is not None and len(late):
            ids = {"game_id": late.game_id, "event_id": late.event_id}
            yield pd.DataFrame(ids | {c: None for c in ("is_rush", "is_rebound", "time_since_last_shot", "score_state", "is_goal")} | {"is_late": True})
        kept = None if old is None or old[0] is None else tuple(old[:7])
        if plays is not None and len(plays):
            out, kept = _walk(plays.sort_values(["abs_secs", "event_id"], ignore_index=True), kept)
            yield out
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.dumps(waiting) if waiting is not None and len(waiting) else None
        state.update((*(kept or (None,) * 6 + (0,)), held))
        # once the watermark is past the newest play nothing more can come: the rest is placed and the state goes
        newest = max(int(frame.at_ms.max()) for frame in (plays, waiting, late) if frame is not None and len(frame))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1)

    return run


def _walk(plays: pd.DataFrame, old: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Features of plays in order: whole-column steps seeded with the last event, shot and lead; and what to store."""
    is_shot = plays.type.isin(SHOT_TYPES)
    is_home = plays.team_id.eq(plays.home_team_id)
    goalie = np.where(is_home, plays.situation_code.str[0], plays.situation_code.str[3])
    empty = plays.situation_code.str.len().eq(4) & (goalie == "0")
    counted = is_shot & plays.team_id.notna() & ~empty & plays.x.notna() & plays.y.notna()
    marks = is_shot & (plays.team_id.notna() | plays.type.isin(ON_NET_TYPES))
    step = np.where(counted & plays.type.eq("goal"), np.where(is_home, 1, -1), 0)
    before = lambda col, seed: pd.concat([pd.Series([seed], dtype=col.dtype), col[:-1]], ignore_index=True)
    text = lambda col: col.astype(object).where(col.notna(), None)
    prev_secs = before(plays.abs_secs.astype("float64"), old[0] if old else np.nan)
    prev_zone = before(text(plays.zone), old[2] if old else None)
    prev_type = before(text(plays.type), old[3] if old else None)
    prev_team = before(plays.team_id.astype("float64"), old[4] if old and old[4] is not None else np.nan)
    shot_secs = plays.abs_secs.astype("float64").where(marks)
    last_shot = before(shot_secs.ffill(), np.nan).fillna(old[5] if old and old[5] is not None else np.nan)
    lead = (old[6] if old else 0) + before(pd.Series(step).cumsum(), 0)
    gap = plays.abs_secs - prev_secs
    same = prev_team.eq(plays.team_id) | (prev_team.isna() & plays.team_id.isna())
    zone = prev_zone.where(same, prev_zone.replace({"O": "D", "D": "O"}))
    own = np.where(is_home, lead, -lead)
    out = pd.DataFrame(
        {
            "game_id": plays.game_id,
            "event_id": plays.event_id,
            "is_rush": ((gap <= RUSH_SECS) & zone.isin(["N", "D"])).astype("int64"),
            "is_rebound": ((gap <= REBOUND_SECS) & prev_type.isin(SHOT_TYPES) & same).astype("int64"),
            "time_since_last_shot": (plays.abs_secs - last_shot).fillna(9999).clip(upper=MAX_SINCE_SHOT).astype("int64"),
            "score_state": np.clip(own, -MAX_LEAD, MAX_LEAD).astype("int64"),
            "is_goal": plays.type.eq("goal").astype("int64"),
        }
    )[counted]
    end = plays.iloc[-1]
    none = lambda v: None if pd.isna(v) else v
    newest_shot = shot_secs.ffill().iloc[-1]
    kept_shot = none(newest_shot) if not pd.isna(newest_shot) else (old[5] if old else None)
    store = (
        int(end.abs_secs), int(end.event_id), none(end.zone), none(end.type), none(float(end.team_id)),
        None if kept_shot is None else float(kept_shot), int((old[6] if old else 0) + step.sum()),
    )
    return out.assign(is_late=False), store


def shot_features(stream: DataFrame, at: str, lateness: str, reorder_secs: int = 0) -> DataFrame:
    """Sequential shot features per game as plays arrive, equal to the batch operator on ordered input.

    A play waits until one of its game came that is ``reorder_secs`` younger, so plays may arrive in another order by
    that much. One that comes later still gives a row ``is_late`` with its id and no features. When the watermark, which
    follows the column ``at`` by ``lateness``, has passed a game's newest play, what still waits is placed and the
    game's state goes. The state is seven scalars and the waiting plays; a micro-batch is held per game, so bound it by
    files per trigger.
    """
    rows = stream.withWatermark(at, lateness).withColumn("at_ms", F.unix_millis(at))
    return rows.groupBy("game_id").applyInPandasWithState(
        _features(reorder_secs), FEATURE_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )

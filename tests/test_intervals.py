"""Hand-made interval fixtures and brute-force comparisons."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintflow.operators import intervals, joins, segments

SHIFT_SCHEMA = (
    "shift_id bigint, game_id bigint, period bigint, player_id bigint, team_id bigint, home_team_id bigint,"
    "abs_start bigint, abs_end bigint, is_goalie boolean"
)
A, B, C, G1, G2 = 1, 2, 3, 8, 9


def shifts(spark, rows):
    """rows of (player, team, start, end[, goalie]) in one game whose home team is 0"""
    full = [(i, 100, 1, p, team, 0, s, e, bool(rest and rest[0])) for i, (p, team, s, e, *rest) in enumerate(rows)]
    df = spark.createDataFrame(full, SHIFT_SCHEMA)
    return df.withColumn("dur", F.col("abs_end") - F.col("abs_start"))


@pytest.mark.parametrize("closed,want", [("right", {A}), ("both", {A, B}), ("left", {B})])
def test_touching_intervals(spark, closed, want):
    ivs = shifts(spark, [(A, 0, 0, 40), (B, 0, 40, 80)]).select("game_id", "player_id", "abs_start", "abs_end")
    pts = spark.createDataFrame([(100, 40)], "game_id bigint, t bigint")
    rows = intervals.points_in_intervals(pts, ivs, ["game_id"], "t", "abs_start", "abs_end", closed, 7)
    assert {r.player_id for r in rows.collect()} == want


def test_bins_do_not_change_the_join(spark):
    ivs = spark.createDataFrame([(1, i, 3 * i, 3 * i + 50) for i in range(60)], "k bigint, m bigint, s bigint, e bigint")
    pts = spark.createDataFrame([(1, t) for t in range(0, 250, 3)], "k bigint, t bigint")
    for closed in ("right", "left", "both"):
        sizes = {
            intervals.points_in_intervals(pts, ivs, ["k"], "t", "s", "e", closed, w).count() for w in (1, 10, 50, 1000)
        }
        assert len(sizes) == 1


def test_self_overlap(spark):
    df = shifts(spark, [(A, 0, 0, 50), (A, 0, 30, 60), (A, 0, 60, 70)])
    assert intervals.self_overlap_rows(df, ["game_id", "player_id"], "abs_start", "abs_end", "shift_id").count() == 2
    union = intervals.union_time(df, ["game_id", "player_id"], "abs_start", "abs_end", width=20).first()
    assert union.union_secs == 70


def test_gap_stays_as_empty_segment(spark):
    out = segments.constant_set_segments(shifts(spark, [(A, 0, 0, 20), (B, 0, 30, 50)])).orderBy("start_secs").collect()
    assert [(r.start_secs, r.end_secs, r.home_ids, r.flag_empty_side) for r in out] == [
        (0, 20, [A], False),
        (20, 30, [], True),
        (30, 50, [B], False),
    ]


def test_equal_neighbours_merge(spark):
    out = segments.constant_set_segments(shifts(spark, [(C, 0, 0, 60), (A, 0, 0, 30), (A, 0, 30, 60)])).collect()
    assert [(r.start_secs, r.end_secs, r.home_ids) for r in out] == [(0, 60, [A, C])]


@pytest.mark.parametrize("first,second,want", [(1200, 90, G1), (500, 500, G1)])
def test_two_goalies(spark, first, second, want):
    df = shifts(spark, [(G1, 0, 0, first, True), (G2, 0, 0, second, True)])
    seg = segments.constant_set_segments(df).orderBy("start_secs").first()
    assert seg.home_goalie == want and seg.flag_two_goalies


def test_occurrence_join_does_not_fan_out(spark):
    left = spark.createDataFrame([(1, 5, 10), (2, 5, 10), (3, 5, 10)], "lid bigint, g bigint, t bigint")
    right = spark.createDataFrame([(7, 5, 10, 0.1), (8, 5, 10, 0.2)], "rid bigint, g bigint, t bigint, xg double")
    rows = joins.occurrence_join(left, right, ["g", "t"], "lid", "rid").orderBy("lid").collect()
    assert [(r.lid, r.rid, r.matched) for r in rows] == [(1, 7, True), (2, 8, True), (3, None, False)]


def points(spark, rows):
    return spark.createDataFrame(
        [(i, 100, 1, t, who, team, 0, goal, 1) for i, (t, who, team, goal) in enumerate(rows)],
        "shot_id bigint, game_id bigint, period bigint, abs_secs bigint, shooter_id bigint, team_id bigint,"
        "home_team_id bigint, is_goal bigint, xg_c bigint",
    )


def test_unmatched_points_are_kept(spark):
    segs = segments.constant_set_segments(shifts(spark, [(A, 0, 0, 20)]))
    found = segments.segment_of_point(points(spark, [(10, A, 0, 0), (25, A, 0, 0)]), segs, ["game_id", "period"], "abs_secs")
    assert found.where("start_secs IS NULL").count() == 1 and found.count() == 2


def test_absent_shooter_keeps_defaults(spark):
    df = shifts(spark, [(A, 0, 0, 20), (B, 1, 0, 20)])
    row = segments.onset_at(points(spark, [(10, 77, 0, 0)]), df).first()
    assert (row.skaters_for, row.on_for, row.for_team, row.flag_shooter_absent, row.flag_none_for) == (0, None, None, True, False)
    other = points(spark, [(10, A, 0, 0)]).withColumn("game_id", F.lit(5).cast("bigint"))
    assert segments.onset_at(other, df).first().flag_shooter_absent is False


def test_onset_counts_flags(spark):
    df = shifts(spark, [(A, 0, 0, 20), (A, 0, 5, 20), (B, 0, 10, 30), (C, 1, 0, 20), (G1, 1, 0, 40, True), (G2, 1, 5, 20, True)])
    row = segments.onset_at(points(spark, [(20, A, 0, 1)]), df).first()
    assert (row.on_for, row.on_against, row.goalie_against) == ([A, B], [C], G1)
    assert row.flag_boundary and row.flag_two_goalies and row.empty_net_for and not row.flag_shooter_absent


def test_goal_at_segment_start_has_counted(spark):
    segs = segments.constant_set_segments(shifts(spark, [(A, 0, 0, 20), (B, 1, 20, 40)]))
    goals = spark.createDataFrame([(100, 20, 1)], "game_id bigint, abs_secs bigint, delta bigint")
    out = segments.score_diff_at_start(segs, goals, ["game_id"]).orderBy("start_secs").collect()
    assert [r.score_diff for r in out] == [0, 1]


def test_segments_equal_brute_force_and_tile_the_clock(spark):
    def brute_segments(pdf):
        """Grouped-map oracle: walk the boundaries of one game and period in plain Python."""
        bounds = sorted(set(pdf.abs_start) | set(pdf.abs_end))
        rows, prev = [], None
        for a, b in zip(bounds, bounds[1:]):
            on = pdf[(pdf.abs_start <= a) & (pdf.abs_end >= b)]
            state = tuple(
                ",".join(str(x) for x in sorted(set(on[(on.team_id == on.home_team_id) == home].player_id))) for home in (True, False)
            )
            if prev == state:
                rows[-1]["end_secs"] = b
            else:
                rows.append({"start_secs": a, "end_secs": b, "home": state[0], "away": state[1]})
            prev = state
        out = pd.DataFrame(rows)
        out["game_id"], out["period"] = pdf.game_id.iloc[0], pdf.period.iloc[0]
        return out[["game_id", "period", "start_secs", "end_secs", "home", "away"]]

    from stintflow.plans.bindings import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    df = t.shifts.withColumn("is_goalie", F.lit(False)).cache()
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    got = segments.constant_set_segments(df).select(
        "game_id", "period", "start_secs", "end_secs", text("home_ids").alias("home"), text("away_ids").alias("away")
    )
    want = df.groupBy("game_id", "period").applyInPandas(
        brute_segments, "game_id bigint, period bigint, start_secs bigint, end_secs bigint, home string, away string"
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    span = df.groupBy("game_id", "period").agg((F.max("abs_end") - F.min("abs_start")).alias("s"))
    whole = span.agg(F.sum("s")).first()[0]
    assert got.agg(F.sum(F.col("end_secs") - F.col("start_secs"))).first()[0] == whole


def test_overlap_pairs_with_one_hot_member(spark):
    rows = [(A, 0, i, i + 30) for i in range(0, 200, 2)] + [(B, 0, 10, 60), (C, 1, 50, 90)]
    df = shifts(spark, rows)
    got = {(r.focal, r.partner): r.shared_secs for r in intervals.overlap_pair_seconds(df, ["game_id"], "player_id", "team_id", "abs_start", "abs_end", width=25).collect()}
    want = {}
    for (p, _, s, e), (q, _, s2, e2) in itertools.product(rows, rows):
        if p != q and min(e, e2) > max(s, s2):
            want[(p, q)] = want.get((p, q), 0) + min(e, e2) - max(s, s2)
    assert got == want


def test_hot_member_is_reduced_before_the_range_join(spark):
    rows = [(A, 0, i % 100, 100 + i % 3) for i in range(3000)]
    lean = intervals.drop_contained(shifts(spark, rows), ["game_id", "player_id"], "abs_start", "abs_end")
    assert lean.count() <= 3


def test_nearest_within_tolerance(spark):
    a = spark.createDataFrame([(1, 5, 100), (2, 5, 500)], "id bigint, g bigint, t bigint")
    b = spark.createDataFrame([(5, 99), (5, 101), (5, 503)], "g bigint, u bigint")
    got = {r.id: r.u for r in intervals.nearest_within(a, b, ["g"], "t", "u", 2).collect()}
    assert got == {1: 99, 2: None}


def test_top_partners_equal_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for k in range(400):
        lo = rng.randrange(0, 9000)
        rows.append((k % 3, rng.randrange(14), lo, lo + rng.randrange(1, 1500)))
    shifts = spark.createDataFrame(rows, "g int, m int, lo int, hi int").withColumn("side", F.col("m") % 2)
    pairs = intervals.overlap_pair_seconds(shifts, ["g"], "m", "side", "lo", "hi").where("same_side").collect()
    want = {}
    for p in sorted(pairs, key=lambda p: (-p.shared_secs, p.partner)):
        want.setdefault(p.focal, (p.partner, p.shared_secs))
    got = intervals.top_partners(shifts, ["g"], "m", "side", "lo", "hi")
    assert {r.focal: (r.partner, r.shared_secs) for r in got.collect()} == want

"""Knock-out trees, correlations net of a prior, and summaries of uneven shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintflow.functions import jsonx
from stintflow.operators import reports


def test_bracket_order():
    assert reports.bracket_order(8) == [1, 8, 4, 5, 2, 7, 3, 6]


def test_bracket_winners_advance(spark):
    seeds = spark.createDataFrame([(k, 10 * k) for k in range(1, 6)], "seed bigint, team bigint")
    wins = [(10, 40, 4), (40, 10, 2), (30, 20, 4), (20, 30, 3), (10, 30, 3), (30, 10, 1), (50, 10, 9)]
    rows = reports.bracket(seeds, spark.createDataFrame(wins, "team bigint, opp bigint, wins bigint"), 4).collect()
    got = {(r.round, r.slot): (r.top, r.bottom, r.top_wins, r.bottom_wins, r.started, r.complete, r.winner) for r in rows}
    assert got == {
        (1, 0): (10, 40, 4, 2, True, True, 10),
        (1, 1): (20, 30, 3, 4, True, True, 30),
        (2, 0): (10, 30, 3, 1, True, False, None),
    }


def test_bracket_before_the_first_game(spark):
    seeds = spark.createDataFrame([(k, k) for k in range(1, 5)], "seed bigint, team bigint")
    rows = reports.bracket(seeds, spark.createDataFrame([], "team bigint, opp bigint, wins bigint"), 4).collect()
    assert [(r.started, r.complete) for r in rows] == [(False, False)] * 3
    assert [(r.top, r.bottom) for r in sorted(rows, key=lambda r: (r.round, r.slot))] == [(1, 4), (2, 3), (None, None)]


def test_net_reliability(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=60)
    a, b = p + rng.normal(size=60), p + rng.normal(size=60)
    rows = spark.createDataFrame([tuple(map(float, x)) for x in zip(a, b, p)] + [(None, 1.0, 1.0)], "a double, b double, p double")
    for r in reports.net_reliability(rows, "a", "b", "p", [0.0, 0.75]).collect():
        assert r.n == 60 and r.corr == pytest.approx(np.corrcoef(a, b)[0, 1])
        assert r.net == pytest.approx(np.corrcoef(a - r.kappa * p, b - r.kappa * p)[0, 1])
        assert (r.first_prior, r.second_prior) == pytest.approx((np.corrcoef(a, p)[0, 1], np.corrcoef(b, p)[0, 1]))


def test_summaries_of_uneven_shape(spark):
    docs = [
        (1, '{"summary": {"threeStars": [{"star": 1, "name": {"default": "A"}, "team": "x"}, {"star": 2, "name": "B", "team": {"default": "y"}}]},'
            ' "boxscore": {"home": {"goalies": [{"name": "G1"}, {"name": {"default": "G2"}, "starter": true, "saves": 9}, {"name": "G3", "starter": true}]}, "away": {}}}'),
        (2, '{"summary": {"threeStars": null}}'),
        (3, "{}"),
    ]
    rows = spark.createDataFrame(docs, "g int, t string").select("g", F.parse_json("t").alias("doc"))
    assert [tuple(r) for r in jsonx.three_stars(rows, "g", "doc").orderBy("star").collect()] == [(1, 1, "A", "x"), (1, 2, "B", "y")]
    got = {(r.g, r.side): (r.name, r.saves) for r in jsonx.starters(rows, "g", "doc").collect()}
    assert got.pop((1, "home")) == ("G2", 9)
    assert len(got) == 5 and set(got.values()) == {(None, None)}

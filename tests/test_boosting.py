"""Boosting on binned rows against MLlib's, whose candidate splits are equal where the sample is all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintflow.operators import boosting, modeling
from stintflow.operators.boosting import BoostParams


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 4000
    a, b, c = rng.random(n), np.round(rng.normal(size=n), 1), rng.integers(0, 9, n)
    p = 1 / (1 + np.exp(-(3 * (a > 0.4) * (b > 0) - 2 + 1.5 * np.isin(c, [1, 4, 7]))))
    y = (rng.random(n) < p).astype(float)
    of = [(float(a[i]), float(b[i]), "abcdefghi"[c[i]] if i % 71 else None, float(y[i]), 1.0 + i % 3 * 0.5, i % 5 == 0, i % 3) for i in range(n)]
    return spark.createDataFrame(of, "a double, b double, c string, y double, w double, s boolean, fold int").repartition(3).cache()


@pytest.mark.parametrize("more", [{}, {"weight": "w", "stop_flag": "s", "categorical": ["c"]}])
def test_trees_are_those_of_mllib(rows, monkeypatch, more):
    monkeypatch.setattr(boosting, "BLOCK", 500)
    monkeypatch.setattr(boosting, "PENDING", 2)
    grid = [BoostParams(trees=5, depth=3, step=0.3), BoostParams(trees=3, depth=2, step=0.1)]
    models = boosting.train(rows, ["a", "b"], "y", grid, **more)
    scored = boosting.score(models, rows, ["p0", "p1"])
    for k, params in enumerate(grid):
        want = modeling.train_boosted(rows, ["a", "b"], "y", params, **more)
        assert len(models[k].trees) == want.stages[-1].getNumTrees
        gap = F.abs(F.col(f"p{k}") - F.col("want"))
        assert modeling.score(want, scored, "want").agg(F.max(gap)).first()[0] < 1e-12


def test_sums_of_many_tasks_and_value_above_empty_nodes(rows, monkeypatch):
    whole = boosting.train(rows, ["a", "b"], "y", [BoostParams(trees=2, depth=2)])[0]
    monkeypatch.setattr(boosting, "BLOCK", 100)
    monkeypatch.setattr(boosting, "HELD", 2)
    monkeypatch.setattr(boosting, "DIRECT", 16)
    dealt = boosting.train(rows, ["a", "b"], "y", [BoostParams(trees=2, depth=2)])[0]
    for one, other in zip(whole.trees, dealt.trees):
        assert (one.feature == other.feature).all() and one.value == pytest.approx(other.value)
    flat = boosting.train(rows.withColumn("a", F.lit(1.0)), ["a"], "y", [BoostParams(trees=1, depth=2)])[0]
    assert flat.trees[0].value[0] == pytest.approx(2 * rows.agg(F.avg("y")).first()[0] - 1)


def test_judged_as_mllib_judges():
    model = boosting.Booster(BoostParams(trees=9), None)
    for count, error in ((1, 1.0), (2, 0.9), (3, 0.8), (4, 0.795)):
        model.trees = [None] * count
        model.judge(error)
    assert model.done and model.best == 3


def test_missing_labels_and_features_are_errors(rows):
    for name in ("y", "a"):
        with pytest.raises(ValueError):
            boosting.train(rows.withColumn(name, F.when(F.col("b") != 0, F.col(name))), ["a", "b"], "y", [BoostParams(trees=1)])


def test_parameter_sets_share_the_passes(rows, monkeypatch):
    """Four parameter sets of a fold took four trainings; they take the passes of one."""
    passes, run = [], boosting._sum_up
    monkeypatch.setattr(boosting, "_sum_up", lambda *of: passes.append(1) or run(*of))
    grid = [BoostParams(trees=2, depth=d, step=s) for d in (2, 3) for s in (0.1, 0.2)]
    found = modeling.grid_by_group_cv(rows, "fold", 3, ["a", "b"], "y", grid)
    assert len(passes) == 3 * 2 * 3 and len(found) == 4 and all(len(x.folds) == 3 for x in found)


def test_sample_of_rows_is_cut_at_equal_weights():
    values = np.arange(1000.0)
    cuts = boosting.thresholds(values, np.ones(1000), 3)
    assert cuts == pytest.approx([249.5, 499.5, 749.5])
    assert boosting.thresholds(np.array([1.0, 1.0, 3.0]), np.ones(3), 31).tolist() == [2.0]
    assert boosting.thresholds(np.ones(5), np.ones(5), 31).size == 0


def test_out_of_fold_scores_are_those_of_a_fit_per_fold(rows, monkeypatch):
    """Each fold shuffled all its training rows for a fit; blocks of bins are dealt out instead."""
    params, used = BoostParams(trees=3, depth=2), ["a", "b", "y", "s"]
    df, context = rows.where("b <= 1"), rows.where("b > 1").select(*used)
    wanted = [modeling.train_boosted(df.where(F.col("fold") != k).select(*used).unionByName(context), ["a", "b"], "y", params, stop_flag="s") for k in range(3)]
    monkeypatch.setattr(modeling, "train_boosted", None)
    scored = modeling.out_of_fold(df, "fold", 3, ["a", "b"], "y", params, context, stop_flag="s").cache()
    assert scored.columns == [*df.columns, "oof"] and scored.count() == df.count()
    for k, model in enumerate(wanted):
        both = modeling.score(model, scored.where(F.col("fold") == k), "want")
        assert both.agg(F.max(F.abs(F.col("want") - F.col("oof")))).first()[0] < 1e-12

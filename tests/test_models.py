"""Ridge against closed forms, fold and resampling helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintflow.operators import block_ridge, modeling, regression
from stintflow.operators.ratings import shrink


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    order, n = 12, 80
    x = (rng.random((n, order)) < 0.4).astype(float)
    x[:, 0] = 1.0
    y, w = rng.normal(size=n), rng.integers(1, 50, n).astype(float)
    rows = [
        (str(i), int(i % 4), float(y[i]), float(w[i]), [(int(j), 1.0) for j in np.flatnonzero(x[i])]) for i in range(n)
    ]
    schema = "row_id string, grp bigint, y double, w double, terms array<struct<col: bigint, val: double>>"
    return x, y, w, spark.createDataFrame(rows, schema)


def closed_form(x, y, w, lam, mask, prior):
    a = x.T @ (w[:, None] * x) + lam * np.diag(mask)
    return prior + np.linalg.solve(a, x.T @ (w * (y - x @ prior)))


def penalty(order, free):
    return (np.arange(order) >= free).astype(float)


def prior_table(spark, prior):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(prior)], "i bigint, prior double")


def moments_of(design):
    parted = design.withColumn("part", F.col("grp"))
    return regression.gram(parted, ["part"]).cache(), regression.target_norm(parted, ["part"]).cache()


def test_many_systems_at_once(small, spark):
    """Subsets, penalties and a prior in one run, one column missing from a subset, going on from a start."""
    x, y, w, design = small
    order, grp, prior = x.shape[1], np.arange(len(y)) % 4, np.linspace(-1, 1, x.shape[1])
    g, _ = moments_of(design.where("NOT (grp = 3 AND exists(terms, t -> t.col = 11))").unionByName(design.where("grp = 3 AND exists(terms, t -> t.col = 11)").withColumn("grp", F.lit(9).cast("bigint"))))
    lone = (grp == 3) & (x[:, 11] > 0)
    subsets = {0: [0, 1, 2, 3, 9], 1: [0, 1], 5: [3]}
    rows = {0: np.ones(len(y), bool), 1: grp < 2, 5: (grp == 3) & ~lone}
    moments = block_ridge.subset_moments(g, subsets)
    entries = block_ridge.both_triangles(moments)
    rhs = block_ridge.right_sides(moments, entries, [-1, -1, "prior", "prior"], prior_table(spark, prior))
    penalised = F.col("i") >= 3
    for start in (None, block_ridge.solve(entries, rhs, [2.0, 60.0, 2.0, 60.0], penalised, tol=1e-3)):
        got = block_ridge.solve(entries, rhs, [1.0, 50.0, 1.0, 50.0], penalised, start)
        fits = block_ridge._coefficients(got, [(0, 0.0), (1, 0.0), (0, 0.75), (1, 0.75)], 2, prior_table(spark, prior))
        beta = {u: np.zeros((order, 4)) for u in subsets}
        for r in fits.collect():
            beta[r.u][r.i] = r.beta
        for u, m in rows.items():
            for k, (lam, kappa) in enumerate([(1.0, 0.0), (50.0, 0.0), (1.0, 0.75), (50.0, 0.75)]):
                want = closed_form(x[m], y[m], w[m], lam, penalty(order, 3), kappa * prior)
                np.testing.assert_allclose(beta[u][:, k], want, atol=1e-7)


def test_no_convergence_is_an_error(small):
    g, _ = moments_of(small[3])
    moments = block_ridge.subset_moments(g, {0: [0, 1, 2, 3]})
    entries = block_ridge.both_triangles(moments)
    with pytest.raises(ArithmeticError):
        block_ridge.solve(entries, block_ridge.right_sides(moments, entries, [-1]), [1.0], F.col("i") >= 3, steps=2)


def test_conjugate_gradient_equals_direct_solution(small, spark):
    x, y, w, design = small
    order = x.shape[1]
    prior = np.linspace(-1, 1, order)
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(prior)], "i bigint, prior double")
    out = regression.ridge_cg(regression.gram(design), F.col("i") >= 3, 20.0, table, steps=30, tol=1e-9)
    got = np.array([r.x for r in out.orderBy("i").collect()])
    np.testing.assert_allclose(got, closed_form(x, y, w, 20.0, penalty(order, 3), prior), atol=1e-6)


def refit_errors(x, y, w, grp, parts, lam, kappa, prior):
    errs = []
    for k in parts:
        fit, held = np.isin(grp, parts) & (grp != k), grp == k
        beta = closed_form(x[fit], y[fit], w[fit], lam, penalty(x.shape[1], 3), kappa * prior)
        errs.append((w[held] * (y[held] - x[held] @ beta) ** 2).sum() / w[held].sum())
    return np.mean(errs)


def test_search_equals_refitting_each_fold(small, spark):
    x, y, w, design = small
    grp, prior = np.arange(len(y)) % 4, np.linspace(-1, 1, x.shape[1])
    g, norms = moments_of(design)
    found = block_ridge.search(g, norms, {0: [0, 1, 2, 3]}, [1.0, 4.0], F.col("i") >= 3, [0.0, 1.0], prior_table(spark, prior), widen=2)
    for (cell, lam, kappa), err in found.errors.items():
        assert err == pytest.approx(refit_errors(x, y, w, grp, [0, 1, 2, 3], lam, kappa, prior), rel=1e-8)
    assert len({lam for _, lam, _ in found.errors}) == 4  # the best is beyond the upper edge
    for kappa in (0.0, 1.0):
        assert found.best[0, kappa] == min((err, lam) for (_, lam, k), err in found.errors.items() if k == kappa)[1]


def test_two_way_test_and_group_errors(small, spark):
    x, y, w, design = small
    grp, prior, kappas = np.arange(len(y)) % 4, np.linspace(-1, 1, x.shape[1]), [0.0, 0.5]
    g, norms = moments_of(design)
    test = block_ridge.two_way_test(g, norms, {0: [0, 1], 1: [2, 3]}, [1.0, 8.0, 64.0], F.col("i") >= 3, kappas, prior_table(spark, prior), widen=1)
    halved = design.withColumn("half", F.floor(F.col("grp") / 2))
    scored = [test.coefs[1 - h].withColumn("half", F.lit(h).cast("bigint")) for h in (0, 1)]
    groups = {r.grp: r for r in block_ridge.group_errors(halved, scored[0].unionByName(scored[1]), 2, ["half"]).collect()}
    for n, kappa in enumerate(kappas):
        ways = []
        for fit, held in ((grp < 2, grp >= 2), (grp >= 2, grp < 2)):
            lam = test.search.best[0 if fit[0] else 1, kappa]
            beta = closed_form(x[fit], y[fit], w[fit], lam, penalty(x.shape[1], 3), kappa * prior)
            gap = w * (y - x @ beta) ** 2
            ways.append(gap[held].sum() / w[held].sum())
            for k in set(grp[held].tolist()):
                assert groups[k][f"e{n}"] == pytest.approx(gap[grp == k].sum())
        assert test.errors[n] == pytest.approx(np.mean(ways))


def test_two_targets_and_ordered_lists(small, spark):
    design = small[3].withColumn("z", F.col("y") * 2)
    got = {(r.i, r.j): r.v for r in regression.gram(design, [], ["y", "z"]).collect()}
    assert all(got[i, -2] == pytest.approx(2 * v) for (i, j), v in got.items() if j == -1)
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 5), (1, "c", 4), (1, "b", 2), (2, "z", 1)], "k int, t string, s int")
    assert {r.k: r.ts for r in regression.ordered_list(rows, "k", "t", "s", "ts").collect()} == {1: "a/b/c", 2: "z"}


def test_two_row_design(spark):
    segs = spark.createDataFrame(
        [("s", 1, [4, 5], [6], 60, 2, 3.0, 1.0)],
        "row_id string, grp bigint, home_ids array<bigint>, away_ids array<bigint>, secs bigint, score_diff bigint, home_value double, away_value double",
    )
    index = regression.column_index(spark.createDataFrame([(4,), (5,), (6,)], "m bigint"), "m")
    rows = {r.row_id: r for r in regression.two_row_design(segs, index, 3).collect()}
    cols = lambda r: sorted(t.col for t in r.terms)
    assert cols(rows["sh"]) == [0, 1, 2, 6, 7, 11] and rows["sh"].y == 180.0
    assert cols(rows["sa"]) == [0, 5, 8, 9, 10] and rows["sa"].y == 60.0


def test_folds_keep_groups_whole_and_even(spark):
    rows = spark.createDataFrame([(g,) for g in range(20) for _ in range(g + 1)], "g bigint")
    folds = modeling.assign_folds(rows, "g", 4).toPandas()
    assert folds.groupby("fold")["size"].sum().max() - folds.groupby("fold")["size"].sum().min() <= 10
    assert folds.g.is_unique


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "p double, y int")
    assert modeling.auc(rows, "p", "y").first().auc == pytest.approx(0.875)


def test_poisson_weights_have_unit_mean(spark):
    w = spark.range(40000).select(modeling.poisson_weight(F.lit(3), F.col("id")).alias("w"))
    m, v = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(m - 1) < 0.03 and abs(v - 1) < 0.05


def test_bootstrap_interval_covers_a_clear_gap(spark):
    rows = [(i, 10.0, 10.0 * (1 + 0.01 * (i % 7)), 10.0 * (2 + 0.01 * (i % 5))) for i in range(200)]
    groups = spark.createDataFrame(rows, "g bigint, w double, a double, b double")
    ci = modeling.cluster_bootstrap(groups, "g", "w", {"a": "a", "b": "b"}, reps=200).first()
    assert (ci.a, ci.b) == ("b", "a") and 0.9 < ci.ci_lo < ci.mean < ci.ci_hi < 1.1


def test_replicates_are_the_column_draws(spark):
    groups = spark.createDataFrame([(2**40 + i * 7, 1.0 + i % 3, float(i)) for i in range(50)], "g bigint, w double, a double").withColumn("b", F.col("a") * F.col("w"))
    drawn = groups.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("k", modeling.poisson_weight(F.col("rep"), F.col("g")))
    diff = sorted(r.d for r in drawn.groupBy("rep").agg((F.sum(F.col("k") * (F.col("b") - F.col("a"))) / F.sum(F.col("k") * F.col("w"))).alias("d")).collect())
    ci = modeling.cluster_bootstrap(groups, "g", "w", {"a": "a", "b": "b"}, reps=40).first()
    assert ci["mean"] == pytest.approx(np.mean(diff)) and ci.ci_lo == pytest.approx(np.percentile(diff, 2.5))


def test_step_down_choice():
    avg = {0.0: 5.0, 0.5: 4.0, 1.0: 3.9}
    near, clear = (-0.2, 0.1), (-2.0, -0.5)
    assert modeling.step_down_choice([0.0, 0.5, 1.0], avg, {(1.0, 0.5): near, (0.5, 0.0): clear}) == 0.5
    assert modeling.step_down_choice([0.0, 0.5, 1.0], avg, {(1.0, 0.5): near, (0.5, 0.0): near}) == 0.0


def test_shrink_passes_through_without_prior(spark):
    rows = spark.createDataFrame([(4.0, 2.0, 10.0), (4.0, None, 10.0)], "v double, p double, n double")
    got = [r.s for r in rows.select(shrink(F.col("v"), F.col("p"), F.col("n"), 10.0).alias("s")).collect()]
    assert got == [3.0, 4.0]


def rising_levels(x, y):
    """Plain pooling of neighbours over distinct scores."""
    out = []
    for v in sorted(set(x)):
        out.append([[v], [b for a, b in zip(x, y) if a == v]])
        while len(out) > 1 and np.mean(out[-2][1]) >= np.mean(out[-1][1]):
            vs, ys = out.pop()
            out[-1] = [out[-1][0] + vs, out[-1][1] + ys]
    return {v: np.mean(ys) for vs, ys in out for v in vs}


@pytest.mark.parametrize("shape", ["noise", "falling", "sawtooth", "rising", "one"])
def test_isotonic_levels(spark, shape):
    rng = np.random.default_rng(1)
    n = 1 if shape == "one" else 600
    x = rng.integers(0, 150, n)
    at = {"noise": lambda v: 0.2 + v / 300, "falling": lambda v: 1 - v / 150, "sawtooth": lambda v: (v % 40) / 40, "rising": lambda v: float(v > 70), "one": lambda v: 1.0}[shape]
    y = [int(rng.random() < at(v)) for v in x.tolist()]
    rows = spark.createDataFrame([(int(a), b) for a, b in zip(x, y)] + [(None, 1)], "x int, y int")
    blocks = modeling.isotonic(rows, "x", "y")
    want = rising_levels(x.tolist(), y)
    got = {r.x: r.c for r in modeling.apply_isotonic(blocks, rows, "x", "c").collect()}
    assert got.pop(None) is None
    assert got == pytest.approx(want)
    ends = spark.createDataFrame([(-5.0,), (500.0,)], "x double")
    low, high = (r.c for r in modeling.apply_isotonic(blocks, ends, "x", "c").orderBy("x").collect())
    assert (low, high) == pytest.approx((min(want.values()), max(want.values())))


def test_scores_between_blocks_are_interpolated(spark):
    rows = spark.createDataFrame([(0.0, 0), (1.0, 0), (3.0, 1)], "x double, y int")
    new = spark.createDataFrame([(2.0,), (2.5,)], "x double")
    got = modeling.apply_isotonic(modeling.isotonic(rows, "x", "y"), new, "x", "c").orderBy("x").collect()
    assert [r.c for r in got] == pytest.approx([0.5, 0.75])


def test_grid_prefers_the_deeper_trees(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i // 3), float(a), "uv"[int(b > 0.5)], float((a > 0.5) ^ (b > 0.5)), 1.0 + i % 2) for i, (a, b) in enumerate(rng.random((600, 2)))]
    df = spark.createDataFrame(rows, "g bigint, a double, c string, y double, w double").withColumn("fold", F.col("g") % 3)
    grid = [modeling.BoostParams(trees=4, depth=1), modeling.BoostParams(trees=4, depth=3)]
    best, other = modeling.grid_by_group_cv(df, "fold", 3, ["a"], "y", grid, weight="w", group="g", categorical=["c"])
    assert best.params.depth == 3 and best.mean < other.mean and len(best.folds) == 3
    assert all(1 <= trees <= 4 for _, trees in best.folds)


def test_seasons_design(spark):
    segs = spark.createDataFrame(
        [("s", 1, [4, 5], [6, 9], 60, 5, 3.0, 1.0, 1, 100, 200), ("e", 1, [9], [9], 30, 0, 1.0, 1.0, 2, None, 100)],
        "row_id string, grp bigint, home_ids array<bigint>, away_ids array<bigint>, secs bigint, score_diff bigint, home_value double, away_value double, season int, home_goalie int, away_goalie int",
    )
    index = regression.column_index(spark.createDataFrame([(4,), (5,), (6,)], "m bigint"), "m")
    goalies = spark.createDataFrame([(100, 20.0), (200, 500.0)], "goalie int, adjust double")
    rows = {r.row_id: r for r in regression.seasons_design(segs, index, 3, goalies, {1: 0.8}, 0.1, 150.0).collect()}
    cols = lambda r: sorted(t.col for t in r.terms)
    assert cols(rows["sh"]) == [0, 1, 5] and cols(rows["sa"]) == [2, 3, 4] and cols(rows["eh"]) == []
    assert (rows["sh"].w, rows["eh"].w) == (0.4, 0.1)
    assert (rows["sh"].y, rows["sh"].y_against) == (180.0, 40.0) and (rows["sa"].y, rows["sa"].y_against) == (60.0, 30.0)
    assert (rows["ea"].y, rows["ea"].y_against) == (120.0, 100.0)

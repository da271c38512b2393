"""Systems solved directly on blocks of columns against conjugate gradients on the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintflow.operators import block_ridge, column_blocks, regression


@pytest.fixture(scope="module")
def moments(spark):
    """Three hubs, two blocks of five columns and a column of its own; column 7 is missing from the parts 0 and 1."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(160):
        block = [[3, 4, 5, 6, 7], [8, 9, 10, 11, 12], [13]][k % 3]
        cols = [0, *rng.permutation([1, 2])[: rng.integers(0, 3)], *rng.permutation(block)[: rng.integers(1, 4)]]
        part = k % 4
        terms = sorted((int(c), float(rng.integers(1, 3))) for c in cols if not (c == 7 and part < 2))
        rows.append((k, part, float(rng.normal()), float(rng.integers(1, 9)), terms))
    design = spark.createDataFrame(rows, "grp int, part bigint, y double, w double, terms array<struct<col: bigint, val: double>>")
    return regression.gram(design, ["part"]).cache(), regression.target_norm(design, ["part"]).cache()


def priors(spark):
    return spark.createDataFrame([(i, float(i) / 10 if i % 4 else None) for i in range(2, 14)], "i bigint, prior double")


def penalised():
    return F.col("i") >= 3


def test_components_are_what_links_reach(spark):
    rng = np.random.default_rng(4)
    pairs = [tuple(sorted(map(int, p))) for p in rng.integers(0, 300, (170, 2)) if p[0] != p[1]] + [(k, k + 1) for k in range(400, 440)]
    root = {v: v for p in pairs for v in p}
    for _ in root:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    found = column_blocks.components(spark.createDataFrame(pairs, "i bigint, j bigint"))
    assert {r.i: r.block for r in found.collect()} == root
    assert column_blocks.components(spark.createDataFrame([], "i bigint, j bigint")) is None


def test_two_way_test_needs_no_steps(moments, spark, monkeypatch):
    """All systems went through conjugate gradients, a job per step over all entries."""
    of = lambda: block_ridge.two_way_test(*moments, {0: [0, 1], 1: [2, 3]}, [1.0, 8.0], penalised(), [0.0, 0.5], priors(spark), widen=1)
    fits = lambda test: {(cell, r.i): r.beta for cell, coefs in test.coefs.items() for r in coefs.collect()}
    with monkeypatch.context() as patch:
        patch.setattr(block_ridge, "solve", None)
        direct = of()
    monkeypatch.setattr(block_ridge, "blocks_of", lambda *of: None)
    steps = of()
    assert direct.search.best == steps.search.best and direct.errors == pytest.approx(steps.errors, rel=1e-8)
    assert direct.search.errors == pytest.approx(steps.search.errors, rel=1e-8)
    got, want = fits(direct), fits(steps)
    assert got.keys() == want.keys() and all(got[at] == pytest.approx(want[at], abs=1e-8) for at in want)


def test_blocks_of_many_tasks_fill_no_task(moments, monkeypatch):
    monkeypatch.setattr(column_blocks, "TASK_BYTES", 8)
    blocks = column_blocks.blocks_of(moments[0], penalised())
    try:
        assert blocks.packed.rdd.getNumPartitions() > 100 and blocks.packed.count() == 3
    finally:
        blocks.release()


@pytest.mark.parametrize("why", ["wide", "hubs", "twins"])
def test_other_systems_go_by_steps(moments, monkeypatch, why):
    g, norms = moments
    if why == "twins":  # column 1 is column 2 once more
        of = lambda c: F.when(F.col(c) == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col(c)))
        g = g.where("i <> 1 AND j <> 1").select("part", F.explode(of("i")).alias("i"), "j", "v").select("part", F.col("i").cast("bigint"), F.explode(of("j")).alias("j"), "v")
        g = g.withColumn("j", F.col("j").cast("bigint")).where("j < 0 OR i <= j").cache()
    else:
        monkeypatch.setattr(column_blocks, {"wide": "WIDEST", "hubs": "HUBS"}[why], 2)
    seen, solve = [], block_ridge.solve
    monkeypatch.setattr(block_ridge, "solve", lambda *of, **more: seen.append(1) or solve(*of, **more))
    found = block_ridge.search(g, norms, {0: [0, 1, 2, 3]}, [4.0], penalised(), widen=0)
    assert seen and found.errors[0, 4.0, 0.0] > 0

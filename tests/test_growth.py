"""What must not grow with the input: the share of one task, what passes through the driver, rows that meet."""

import os
import re
import sys
from types import SimpleNamespace

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from stintflow.operators import modeling, regression
from stintflow.plans import q_sorts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_rows_are_dealt_out(spark, monkeypatch):
    one = spark.range(2000).coalesce(1).select((F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 7).cast("double").alias("x"))
    dealt = modeling.evenly(one, 100)
    assert dealt.rdd.getNumPartitions() >= 20 and max(map(len, dealt.rdd.glom().collect())) <= 110
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, one.collect()))
    seen = []
    fit = modeling.Pipeline.fit
    monkeypatch.setattr(modeling.Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    modeling.train_boosted(one, ["x"], "y", modeling.BoostParams(trees=1, depth=1))
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_conjugate_gradient_broadcasts_nothing(spark, monkeypatch):
    plans, write = [], regression.cut_lineage
    monkeypatch.setattr(regression, "cut_lineage", lambda df: plans.append(plan(df)) or write(df))
    full = [(i, j, 4.0 if i == j else 1.0) for i in range(5) for j in range(i, 5)] + [(i, -1, float(i)) for i in range(5)]
    g = spark.createDataFrame(full, "i bigint, j bigint, v double")
    x = regression.ridge_cg(g, F.col("i") >= 0, 2.0)
    left = regression.residuals(g, x, F.col("i") >= 0, 2.0).collect()
    assert len(left) == 5 and all(abs(r.gap) < 1e-8 for r in left)
    assert not any("Broadcast" in p for p in plans)


def test_kept_entries_lie_in_as_many_tasks_as_they_fill(spark, monkeypatch):
    for count, parts in ((0, 1), (10, 1), (400_001, 3), (10**9, int(spark.conf.get("spark.sql.shuffle.partitions")))):
        held, got = regression.dealt(spark.range(9), ["id"], count)
        assert got == parts == held.rdd.getNumPartitions() and held.count() == 9
        held.unpersist()
    plans, write = [], regression.cut_lineage
    monkeypatch.setattr(regression, "cut_lineage", lambda df: plans.append(plan(df)) or write(df))
    g = spark.createDataFrame([(i, j, 4.0 - (i != j)) for i in range(4) for j in range(i, 4)] + [(i, -1, i + 1.0) for i in range(4)], "i bigint, j bigint, v double")
    regression.ridge_cg(g, F.col("i") >= 0, 2.0)
    assert any("REPARTITION_BY_NUM" in p for p in plans)
    # neither side of the join with the entries is dealt out again
    assert not any(re.search(r"hashpartitioning\(j#\d+L?, \d+\), ENSURE", p) for p in plans)


def test_pairs_of_terms_are_no_rows(spark, monkeypatch):
    rows = [(k, k % 3 or None, float(k), None if k == 4 else 2.0, [(c, float(c + 1)) for c in range(k % 5)]) for k in range(12)]
    rows.append((1, 2, 1.0, 3.0, [(1, 2.0), (1, 5.0)]))  # a column twice, and one without terms
    rows.append((1, 2, None, 3.0, None))
    design = spark.createDataFrame(rows, "grp int, part int, y double, w double, terms array<struct<col: bigint, val: double>>")
    want = {}
    for _, part, y, w, terms in rows:
        for c, v in terms or []:
            for d, u in [*[t for t in terms if t[0] >= c], (-1, y)]:
                was = want.setdefault((part, c, d))
                want[part, c, d] = was if w is None or u is None else (was or 0.0) + w * v * u
    for at_once in (1 << 20, 6):
        monkeypatch.setattr(regression, "PAIRS", at_once)
        sums = regression.gram(design, ["part"])
        assert {tuple(r)[:3]: r.v for r in sums.collect()} == want
    assert "Generate" not in plan(sums)


def test_difference_and_intersection_meet_distinct_keys(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,), (5,)], "l_partkey bigint")
    b = spark.createDataFrame([(2,), (2,), (None,), (7,)], "o_custkey bigint")
    got = q_sorts.u3(SimpleNamespace(lineitem=a, orders=b))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("only_left", 1), ("only_left", 5), ("both", 2), ("both", None)], key=str)
    assert "Join" not in plan(got) and got.columns == ["kind", "k"]

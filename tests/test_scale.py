"""Skew-safe helpers against pandas, with one key holding a third or more of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintflow.scale import Running, quantiles, running, top_k, value_ranks, with_ordinal, with_rank


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 6000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "key": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n)),
            "t": rng.integers(0, 5000, n),
            "v": np.where(rng.random(n) < 0.3, 5, rng.integers(0, 200, n)).astype("float64"),
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_running_matches_plain_windows(skewed):
    pdf, df = skewed
    specs = {
        "s": Running("sum", F.col("v")),
        "si": Running("sum", F.col("v"), inclusive=True),
        "m": Running("max", F.col("v")),
        "l": Running("last", F.when(F.col("v") > 150, F.col("id"))),
    }
    out = running(df, ["key"], F.floor(F.col("t") / 250), ["t", "id"], specs)
    got = out.toPandas().sort_values("id", ignore_index=True)
    want = pdf.sort_values(["t", "id"]).copy()
    g = want.groupby("key")
    want["si"] = g.v.cumsum()
    want["s"] = (want.si - want.v).where(g.cumcount() > 0)
    want["m"] = g.v.transform(lambda x: x.cummax().shift())
    want["l"] = want.id.where(want.v > 150).groupby(want.key).transform(lambda x: x.ffill().shift())
    want = want.sort_values("id", ignore_index=True)
    for c in ("s", "si", "m", "l"):
        np.testing.assert_allclose(got[c].astype("float64"), want[c].astype("float64"), equal_nan=True)


@pytest.mark.parametrize("ties", ["min", "average", "pct"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks(skewed, ties, descending):
    pdf, df = skewed
    got = with_rank(df, ["key"], "v", "r", ties, descending).toPandas().sort_values("id").r.astype("float64").to_numpy()
    method = "average" if ties == "pct" else ties
    want = pdf.groupby("key").v.rank(method=method, ascending=not descending, pct=ties == "pct").to_numpy()
    np.testing.assert_allclose(got, want)


def test_ordinal_breaks_ties_by_id(skewed):
    pdf, df = skewed
    got = with_ordinal(df, ["key"], "v", "id", "n", descending=True).toPandas().sort_values("id").n.to_numpy()
    order = pdf.sort_values(["v", "id"], ascending=[False, True])
    want = (order.groupby("key").cumcount() + 1).sort_index().to_numpy()
    assert (got == want).all()


def test_ordinal_keeps_ids_beyond_double_precision(spark):
    ids = [2**60 + i for i in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = {r.id: r.n for r in with_ordinal(df, [], None, "id", "n").collect()}
    assert got == {v: i + 1 for i, v in enumerate(ids)}


def test_quantiles_interpolate(skewed):
    pdf, df = skewed
    got = quantiles(df, ["key"], "v", {"a": 0.2, "b": 0.5, "c": 0.97}).toPandas().set_index("key")
    for name, p in (("a", 0.2), ("b", 0.5), ("c", 0.97)):
        want = pdf.groupby("key").v.quantile(p)
        np.testing.assert_allclose(got[name].sort_index(), want.sort_index())


def test_rank_counts_ties_before_ordering(skewed):
    _, df = skewed
    ranks = value_ranks(df, ["key"], "v")
    assert ranks.groupBy("key", "v").count().where("count > 1").count() == 0


def test_top_k_prunes_before_the_shuffle(skewed):
    _, df = skewed
    plan = top_k(df, ["key"], [F.desc("v"), F.asc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("pair", [("half_up", 0.125, 0.12), ("half_even", 2.5, 2.0)])
def test_half_even(spark, pair):
    _, value, want = pair
    digits = 2 if value < 1 else 0
    assert spark.range(1).select(F.bround(F.lit(value), digits).alias("x")).first().x == want

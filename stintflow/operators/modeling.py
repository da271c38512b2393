"""Event-probability models: folds, training, out-of-fold scores, calibration, resampling."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.operators import boosting
from stintflow.operators.boosting import BoostParams
from stintflow.scale import Running, positions, quantiles, range_placed, running, value_ranks, with_ordinal
from stintflow.session import cut_lineage, forget

TASK_ROWS = 250_000  # a training task holds this many rows in memory, over all trees


def log_loss(p: str, y: str, eps: float = 1e-15) -> Column:
    prob = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return F.avg(-(F.col(y) * F.log(prob) + (1 - F.col(y)) * F.log(1 - prob)))


def auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Area under the ROC curve by average ranks; equal scores are counted before they are ordered."""
    ranks = value_ranks(df, [], p)
    hits = df.groupBy(p).agg(F.sum(y).alias("pos"))
    rows = ranks.join(hits, p)
    rank_sum = F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2))
    pos, n = F.sum("pos"), F.sum("n")
    return rows.agg(((rank_sum - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("auc"))


def assign_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """``group -> fold``: groups in falling size dealt out back and forth over the folds."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    placed = with_ordinal(sizes, [], "size", group, "_pos", descending=True)
    turn = F.floor((F.col("_pos") - 1) / k)
    step = (F.col("_pos") - 1) % k
    fold = F.when(turn % 2 == 0, step).otherwise(k - 1 - step)
    return placed.select(group, "size", fold.cast("bigint").alias("fold"))


def chronological_split(groups: DataFrame, group: str, day: str, share: float) -> DataFrame:
    """Mark the earliest ``share`` of groups, ordered by day and then id."""
    placed = with_ordinal(groups, [], day, group, "_pos")
    total = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = placed.withColumn("_total", total)
    return cut.withColumn("is_early", F.col("_pos") <= F.floor(F.col("_total") * share)).drop("_pos", "_total")


def evenly(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt out to tasks of at most about ``rows`` rows, whatever the files, and to every core."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))
    return df.repartition(parts)


def train_boosted(
    df: DataFrame, features: list[str], label: str, params: BoostParams = BoostParams(),
    weight: str | None = None, stop_flag: str | None = None, categorical: list[str] = [],
) -> PipelineModel:
    """Gradient-boosted trees; ``stop_flag`` marks rows that only decide when to stop.

    ``categorical`` columns are indexed by falling frequency and split as sets of values; a value that training did
    not see is one more category.
    """
    names = [f"_{c}_index" for c in categorical]
    stages = [StringIndexer(inputCols=categorical, outputCols=names, handleInvalid="keep")] if categorical else []
    gbt = GBTClassifier(
        featuresCol="_features", labelCol=label, maxIter=params.trees, maxDepth=params.depth,
        stepSize=params.step, seed=params.seed,
    )
    if weight:
        gbt = gbt.setWeightCol(weight)
    if stop_flag:
        gbt = gbt.setValidationIndicatorCol(stop_flag)
    assembler = VectorAssembler(inputCols=[*features, *names], outputCol="_features", handleInvalid="keep")
    df = evenly(df.select(*{c: None for c in [*features, *categorical, label, weight, stop_flag] if c}))
    return Pipeline(stages=[*stages, assembler, gbt]).fit(df)


def score(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*df.columns, out)


def out_of_fold(
    df: DataFrame, fold: str, k: int, features: list[str], label: str, params: BoostParams = BoostParams(),
    context: DataFrame | None = None, out: str = "oof", stop_flag: str | None = None, parallel: int = 4,
) -> DataFrame:
    """Score each fold with a model trained on the other folds plus a fixed context pool; ``parallel`` fits at a time."""
    used = [*features, label, *([stop_flag] if stop_flag else [])]

    def part(held):
        train = df.where(F.col(fold) != held).select(*used)
        if context is not None:
            train = train.unionByName(context.select(*used))
        models = boosting.train(train, features, label, [params], stop_flag=stop_flag)
        return boosting.score(models, df.where(F.col(fold) == held), [out])

    parts = _at_once(df.sparkSession, part, range(k), parallel)
    return reduce(DataFrame.unionByName, parts)


def _at_once(spark, job, args, parallel: int) -> list:
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(job), args))


@dataclass(frozen=True)
class Trial:
    """One parameter set: held-out log loss and trees kept per fold."""

    params: BoostParams
    folds: list[tuple[float, int]]

    @property
    def mean(self) -> float:
        return sum(loss for loss, _ in self.folds) / len(self.folds)


def grid_by_group_cv(
    df: DataFrame, fold: str, k: int, features: list[str], label: str, grid: list[BoostParams], weight: str | None = None,
    group: str | None = None, stop_share: float = 0.15, categorical: list[str] = [], parallel: int = 4,
) -> list[Trial]:
    """Held-out log loss per parameter set and fold, best set first; fits run ``parallel`` at a time.

    With ``group``, that share of the training groups of a fold, picked by hash, only decides when to stop. The loss
    is not weighted, the fits are. The parameter sets of a fold are trained together, in the same passes over its rows.
    """
    stop = F.lit(False) if group is None else F.pmod(F.xxhash64(F.lit("stop"), group), F.lit(1000)) < int(stop_share * 1000)
    rows = df.withColumn("_stop", stop)
    names = [f"_p{n}" for n in range(len(grid))]

    def fit(held):
        models = boosting.train(rows.where(F.col(fold) != held), features, label, grid, weight, "_stop" if group else None, categorical)
        scored = boosting.score(models, rows.where(F.col(fold) == held), names)
        losses = scored.agg(*[log_loss(p, label).alias(p) for p in names]).first()
        return [(losses[p], len(model.trees)) for p, model in zip(names, models)]

    done = _at_once(rows.sparkSession, fit, range(k), parallel)
    return sorted((Trial(params, [of[at] for of in done]) for at, params in enumerate(grid)), key=lambda x: x.mean)


def feature_importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, weights)), "feature string, importance double")


def what_if(model: PipelineModel, df: DataFrame, column: str, value, by: str) -> DataFrame:
    """Mean prediction per category when one feature is overridden."""
    changed = df.withColumn(column, F.lit(value).cast(df.schema[column].dataType))
    return score(model, changed, "p").groupBy(by).agg(F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("n"))


def _pool_adjacent(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks in order of ``lo``, neighbours pooled until their means rise; means are compared as whole fractions."""
    rows = rows.sort_values("lo")
    out: list[list] = []
    for lo, hi, w, y in zip(rows["lo"].tolist(), rows["hi"].tolist(), rows["w"].tolist(), rows["y"].tolist()):
        out.append([lo, hi, w, y])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi, w, y = out.pop()
            out[-1] = [out[-1][0], hi, out[-1][2] + w, out[-1][3] + y]
    lo, hi, w, y = zip(*out)
    return pd.DataFrame({"range": rows["range"].iloc[0], "lo": lo, "hi": hi, "w": w, "y": y, "level": np.array(y, float) / np.array(w, float)})


_BLOCKS = "range bigint, lo double, hi double, w double, y double, level double"


def isotonic(df: DataFrame, p: str, y: str) -> DataFrame:
    """Rising levels of ``y`` over the score: blocks ``lo, hi, w, y, level``, written; fit on scores of unseen rows.

    Equal scores are counted first. Each range of the scores is pooled by itself; then ranges are merged two by two,
    and of two ranges only the blocks meet whose levels the other one's overlap, as no others can be pooled.
    """
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("lo")).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum(F.col(y).cast("double")).alias("y")
    )
    placed = range_placed(known, [F.col("lo")]).select(F.col("_part").cast("bigint").alias("range"), "lo", F.col("lo").alias("hi"), "w", "y")
    blocks = cut_lineage(placed.groupBy("range").applyInPandas(_pool_adjacent, _BLOCKS))
    span, parts = 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while span < parts:
        sided = blocks.withColumn("pair", F.floor(F.col("range") / (2 * span))).withColumn("left", F.floor(F.col("range") / span) % 2 == 0)
        ends = sided.groupBy("pair").agg(F.max(F.when(F.col("left"), F.col("level"))).alias("top"), F.min(F.when(~F.col("left"), F.col("level"))).alias("bottom"))
        joined = sided.join(ends, "pair")
        border = F.coalesce(F.when(F.col("left"), F.col("level") >= F.col("bottom")).otherwise(F.col("level") <= F.col("top")), F.lit(False))
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        met = joined.where(border).groupBy("pair").applyInPandas(_pool_adjacent, _BLOCKS)
        merged = cut_lineage(joined.where(~border).select(*names).unionByName(met))
        forget(blocks)
        blocks, span = merged, 2 * span
    return blocks.select("lo", "hi", "w", "y", "level")


def apply_isotonic(blocks: DataFrame, df: DataFrame, p: str, out: str) -> DataFrame:
    """Add the level of each score: of the block it lies in, on the line between two blocks, or of the nearest end."""
    placed = positions(blocks.select("lo", "hi", "level"), [F.col("lo")], "_n")
    after = placed.select((F.col("_n") - 1).alias("_n"), F.col("lo").alias("next_lo"), F.col("level").alias("next_level"))
    steps = placed.join(after, "_n", "left").select(F.col("lo").alias("x"), F.lit(0).alias("kind"), F.struct("hi", "level", "next_lo", "next_level").alias("s"))
    scores = df.where(F.col(p).isNotNull()).select(F.col(p).cast("double").alias("x")).distinct()
    line = range_placed(steps.unionByName(scores.withColumn("kind", F.lit(1)).withColumn("s", F.lit(None).cast(steps.schema["s"].dataType))), [F.col("x"), F.col("kind")])
    found = running(line, [], F.col("_part"), ["_at"], {"b": Running("last", F.col("s"), inclusive=True)}).where("kind = 1")
    first = placed.agg(F.min_by("level", "lo").alias("l")).scalar()
    slope = (F.col("b.next_level") - F.col("b.level")) / (F.col("b.next_lo") - F.col("b.hi"))
    inside = (F.col("x") <= F.col("b.hi")) | F.col("b.next_lo").isNull()
    level = F.when(F.col("b").isNull(), first).when(inside, F.col("b.level")).otherwise(F.col("b.level") + slope * (F.col("x") - F.col("b.hi")))
    levels = cut_lineage(found.select(F.col("x").alias("_x"), level.alias(out)))
    return df.join(levels, F.col(p).cast("double") == F.col("_x"), "left").drop("_x")


# Cumulative Poisson(1) probabilities.
POISSON_CDF = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675882]
PRIME = 2147483647


def poisson_weight(rep: Column, key: Column) -> Column:
    """Poisson(1) draw by whole-number arithmetic on replicate and key, so a retried task draws the same number.

    ``key`` is a whole number. The cube modulo a prime keeps replicates from being shifts of each other.
    """
    x = (F.pmod(key, F.lit(PRIME)) * 48271 + rep.cast("bigint") * 69621) % PRIME
    u = ((x * x % PRIME) * x % PRIME + 12345) % PRIME / float(PRIME)
    weight = F.lit(len(POISSON_CDF))
    for i in range(len(POISSON_CDF) - 1, -1, -1):
        weight = F.when(u < POISSON_CDF[i], i).otherwise(weight)
    return weight


def _replicate_sums(reps: int):
    """Per task one array per column: the sums over its clusters for all replicates at once."""

    def run(batches):
        rep = np.arange(1, reps + 1, dtype=np.int64) * 69621
        total = None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            for at in range(0, len(key), 1024):
                x = (key[at : at + 1024, None] % PRIME * 48271 + rep) % PRIME
                u = ((x * x % PRIME) * x % PRIME + 12345) % PRIME / float(PRIME)
                drawn = np.searchsorted(POISSON_CDF, u.ravel(), "right").reshape(u.shape)
                part = values[:, at : at + 1024] @ drawn
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([row.tolist() for row in total.T.copy()])], ["sums"]).append_column("rep", pa.array(range(1, reps + 1)))

    return run


def cluster_bootstrap(groups: DataFrame, key: str, weight: str, totals: dict[str, str], reps: int = 1000) -> DataFrame:
    """Percentile intervals of the difference of every two candidates' weighted means.

    ``groups`` holds one row per cluster: its whole-number key, its weight and one weighted sum per candidate. A task
    adds up its clusters for all replicates at once and leaves one row per replicate; the draws are those of
    :func:`poisson_weight`.
    """
    rows = groups.select(F.pmod(F.col(key), F.lit(PRIME)).alias("key"), F.col(weight).cast("double"), *[F.col(c).cast("double") for c in totals.values()])
    sums = rows.mapInArrow(_replicate_sums(reps), "sums array<double>, rep bigint")
    at = [F.sum(F.col("sums")[k]).alias(f"_s{k}") for k in range(len(totals) + 1)]
    means = sums.groupBy("rep").agg(*at).select("rep", *[(F.col(f"_s{k}") / F.col("_s0")).alias(n) for k, n in enumerate(totals, 1)])
    names = list(totals)
    pairs = [(a, b) for i, b in enumerate(names) for a in names[i + 1 :]]
    rows = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs])
    )
    return means.select(rows.alias("s")).groupBy("s.a", "s.b").agg(
        F.avg("s.d").alias("mean"),
        F.percentile("s.d", F.lit(0.025)).alias("ci_lo"),
        F.percentile("s.d", F.lit(0.975)).alias("ci_hi"),
    )


def step_down_choice(candidates: list[float], average: dict[float, float], ci: dict[tuple[float, float], tuple[float, float]]) -> float:
    """Smallest candidate not significantly worse than the best; it must also beat the first one."""
    order = sorted(candidates)
    pick = min(order, key=lambda c: average[c])
    while pick != order[0] and ci[(pick, order[order.index(pick) - 1])][1] >= 0:
        pick = order[order.index(pick) - 1]
    return pick if pick == order[0] or ci[(pick, order[0])][1] < 0 else order[0]


def step_down(ci: DataFrame, average: dict[str, float]) -> str:
    """:func:`step_down_choice` on the intervals of :func:`cluster_bootstrap`; the candidates' names ascend."""
    rows = ci.collect()  # a row per pair of candidates
    return step_down_choice(list(average), average, {(row["a"], row["b"]): (row["ci_lo"], row["ci_hi"]) for row in rows})

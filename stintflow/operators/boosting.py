"""Gradient-boosted trees on binned rows, several parameter sets at once.

The rows of a training set are cut into bins once and kept as blocks of a byte per feature. A pass over the blocks adds
up, for one level of the trees of all parameter sets, the weights and residuals per node, feature and bin; only these
sums leave the tasks. The validation error of a tree comes with the first pass of the next one. Trees, residuals,
candidate splits and the rule for stopping are those of MLlib's GBTClassifier with its default settings.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32  # MLlib's default for candidate splits and categories
TOL = 0.01  # MLlib's default: a tree that improves the validation error by a smaller part ends the training
SAMPLED = max(BINS * BINS, 10_000)  # MLlib's: rows from which candidate splits are taken
BLOCK = 32_768  # rows of a block
PENDING = 8  # trees that passes evaluate anew before their sum is kept with the blocks
HELD = 64  # blocks of a task, where there are more than tasks
DIRECT = 64  # sums of as many tasks are added up by the driver, those of more by tasks first


@dataclass(frozen=True)
class BoostParams:
    trees: int = 400
    depth: int = 5
    step: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class Codes:
    """How values become bins: thresholds per numeric feature, values by falling frequency per categorical one."""

    numeric: dict[str, np.ndarray]
    categorical: dict[str, list[str]]

    def width(self) -> int:
        return len(self.numeric) + len(self.categorical)

    def columns(self) -> list[Column]:
        return [F.col(c).cast("double") for c in self.numeric] + [F.col(c).cast("string") for c in self.categorical]

    def bins(self, arrays: list[pa.Array]) -> np.ndarray:
        """A row of bytes per feature; a missing number lies above all thresholds, an unknown value after all others."""
        out = np.empty((self.width(), len(arrays[0])), np.uint8)
        for at, cuts in enumerate(self.numeric.values()):
            out[at] = np.searchsorted(cuts, arrays[at].fill_null(np.nan).to_numpy(zero_copy_only=False), "left")
        for at, names in enumerate(self.categorical.values(), len(self.numeric)):
            found = pc.index_in(arrays[at], value_set=pa.array(names, pa.string()), skip_nulls=True)
            out[at] = found.fill_null(len(names)).to_numpy(zero_copy_only=False)
        return out


@dataclass
class Tree:
    """A complete tree, level after level: per node its feature and which bins go right, and a value per leaf.

    A node that is not split sends all rows to the left.
    """

    feature: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.value).bit_length() - 1

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row, counted within its level, after ``levels`` splits."""
        n = bins.shape[1]
        node, row, flat, sides = np.zeros(n, np.int64), np.arange(n), bins.ravel(), self.right.ravel()
        for level in range(levels):
            at = node + ((1 << level) - 1)
            if level == 0:
                side = self.right[0][bins[self.feature[0]]]
            else:
                side = sides[at * BINS + flat[self.feature[at] * n + row]]
            node = 2 * node + side
        return node


@dataclass
class Booster:
    """One parameter set in training, then its model: the sum of ``trees``, the first one whole, the others by the step."""

    params: BoostParams
    codes: Codes
    trees: list[Tree] = field(default_factory=list)
    best: int = 1
    error: float | None = None
    done: bool = False

    def step_of(self, tree: int) -> float:
        return 1.0 if tree == 0 else self.params.step

    def add(self, bins: np.ndarray, total: np.ndarray, low: int, high: int) -> np.ndarray:
        for t in range(low, high):
            total += self.step_of(t) * self.trees[t].value[self.trees[t].nodes(bins, self.params.depth)]
        return total

    def judge(self, error: float) -> None:
        """MLlib's rule after each tree that is not the first: too small a gain on the validation rows ends the training."""
        if self.error is None:
            self.error = error
        elif self.error - error < TOL * max(error, 0.01):
            self.done = True
        else:
            self.error, self.best = error, len(self.trees)
        self.done |= len(self.trees) == self.params.trees


def thresholds(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts between distinct values: all of them, or at about equal weights, as MLlib chooses them."""
    known = ~np.isnan(values)
    found, place = np.unique(values[known], return_inverse=True)
    if len(found) < 2:
        return np.empty(0)
    middle = (found[:-1] + found[1:]) / 2.0
    if len(middle) <= most:
        return middle
    upto = np.cumsum(np.bincount(place, weights[known]))
    stride = weights.sum() / (most + 1)
    cuts, target = [], stride
    for at in range(1, len(found)):
        if abs(upto[at - 1] - target) < abs(upto[at] - target):
            cuts.append(middle[at - 1])
            target += stride
    return np.array(cuts[:most])


def codes_of(df: DataFrame, features: list[str], categorical: list[str], count: int) -> Codes:
    """Candidate splits from a sample of the rows ``_w`` and ``not _stop`` as MLlib's, categories from all rows."""
    names = {}
    for c in categorical:
        by = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        rows = by.orderBy(F.col("n").desc(), "v").limit(BINS).collect()
        if len(rows) == BINS:
            raise ValueError(f"{c} has more than {BINS - 1} values")
        names[c] = [row["v"] for row in rows]
    fit = df.where(~F.col("_stop"))
    if count > SAMPLED:
        fit = fit.sample(False, SAMPLED / count, 42)
    seen = fit.select("_w", *[F.col(c).cast("double").alias(c) for c in features]).toPandas()
    weights = seen["_w"].to_numpy(float)
    return Codes({c: thresholds(seen[c].to_numpy(float), weights, min(BINS, count) - 1) for c in features}, names)


def _blocks(codes: Codes):
    """Arrow batches of ``_y``, ``_w``, ``_stop`` and the features to blocks of at most ``BLOCK`` rows, training rows first."""

    def block(rows):
        stop = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(stop, kind="stable")
        y = rows.column(0).to_numpy(zero_copy_only=False)[order]
        w = rows.column(1).to_numpy(zero_copy_only=False)[order]
        bins = codes.bins([c.combine_chunks() for c in rows.columns[3:]])[:, order]
        weights = b"" if (w == 1.0).all() else w.tobytes()
        return _batch([len(y), int((~stop).sum()), y.astype(np.int8).tobytes(), weights, bins.tobytes(), b""])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= BLOCK:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK))
                held, size = table.slice(BLOCK).to_batches(), size - BLOCK
        if size:
            yield block(pa.Table.from_batches(held))

    return run


BLOCK_SCHEMA = "n bigint, fit bigint, y binary, w binary, bins binary, total binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]


def _batch(cells: list) -> pa.RecordBatch:
    types = [pa.int64()] * 2 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=BLOCK_NAMES)


@dataclass
class _Block:
    """Signs of the labels, weights (none: all one) and bins of some rows, the first ``fit`` of which train."""

    fit: int
    y: np.ndarray
    w: np.ndarray | None
    bins: np.ndarray
    total: np.ndarray | None
    cells: list

    @classmethod
    def each(cls, batches):
        for batch in batches:
            for at in range(batch.num_rows):
                n, fit = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                cells = [batch.column(k)[at].as_buffer() for k in range(2, 6)]
                y, w, bins, total = (np.frombuffer(c, t) if c.size else None for c, t in zip(cells, (np.int8, float, np.uint8, float)))
                yield cls(fit, y * 2.0 - 1.0, w, bins.reshape(-1, n), None if total is None else total.reshape(-1, n), [n, fit, *cells])

    def sum_of(self, models: list[Booster], k: int, since: int) -> np.ndarray:
        """What the trees of a model add up to: the kept sum of those before ``since``, and the others."""
        kept = np.zeros(len(self.y)) if self.total is None else self.total[k].copy()
        return models[k].add(self.bins, kept, since, len(models[k].trees))


def _twin(models: list[Booster], growing: list[Tree | None], level: int, k: int) -> int:
    """The first model whose sums are those of model ``k``: all trees so far are equal, as the first ones of any step are."""

    def so_far(at):
        trees = [(models[at].step_of(t), tree.depth, tree.right.tobytes(), tree.feature.tobytes(), tree.value.tobytes()) for t, tree in enumerate(models[at].trees)]
        above = (1 << level) - 1
        return trees, growing[at].right[:above].tobytes(), growing[at].feature[:above].tobytes()

    return next(at for at, tree in enumerate(growing) if tree is not None and so_far(at) == so_far(k))


def _level(models: list[Booster], growing: list[Tree | None], level: int, since: int):
    """Sums per model: weight and validation error, then weights and weighted residuals per feature, node and bin."""
    size = BINS << level
    on = [k for k, tree in enumerate(growing) if tree is not None and _twin(models, growing, level, k) == k]

    def run(batches):
        sums = None
        for block in _Block.each(batches):
            fit, y, bins = block.fit, block.y, block.bins
            if sums is None:
                sums = np.zeros((len(models), 2 + 2 * len(bins) * size))
            for k in on:
                total = block.sum_of(models, k, since)
                if level == 0 and fit < len(y):
                    loss = 2.0 * np.logaddexp(0.0, -2.0 * y[fit:] * total[fit:])
                    sums[k, 0] += len(loss) if block.w is None else block.w[fit:].sum()
                    sums[k, 1] += loss.sum() if block.w is None else (block.w[fit:] * loss).sum()
                wanted = y[:fit]
                if models[k].trees:
                    with np.errstate(over="ignore"):
                        wanted = 4.0 * wanted / (1.0 + np.exp(2.0 * wanted * total[:fit]))
                weight = None if block.w is None else block.w[:fit]
                mass = wanted if weight is None else weight * wanted
                base = growing[k].nodes(bins[:, :fit], level) * BINS
                cells = sums[k, 2:].reshape(2, len(bins), size)
                for f in range(len(bins)):
                    code = base + bins[f, :fit]
                    cells[0, f] += np.bincount(code, weight, size)
                    cells[1, f] += np.bincount(code, mass, size)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64()))], ["s"])

    return run


def _added(batches):
    total = None
    for batch in batches:
        for cell in batch.column(0):
            part = cell.values.to_numpy(zero_copy_only=False)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])


def _sum_up(blocks: DataFrame, parts: int, level) -> np.ndarray:
    """The sums of all tasks, at most some hundred kilobytes each; those of many tasks are added up in a few before the driver."""
    rows = blocks.mapInArrow(level, "s array<double>")
    if parts > DIRECT:
        rows = rows.repartition(DIRECT // 8).mapInArrow(_added, "s array<double>")
    return sum(np.array(row["s"]) for row in rows.collect())


def _kept(models: list[Booster], since: int):
    """Blocks with the sums of all trees so far."""

    def run(batches):
        for block in _Block.each(batches):
            total = np.stack([block.sum_of(models, k, since) for k in range(len(models))])
            yield _batch([c if isinstance(c, int) else c.to_pybytes() for c in block.cells[:-1]] + [total.tobytes()])

    return run


def _grow(tree: Tree, level: int, weights: np.ndarray, masses: np.ndarray, codes: Codes) -> None:
    """Split the nodes of a level where the variance falls most; ``weights`` and ``masses`` are per feature, node and bin.

    Categories are ordered by their mean. The first of equal splits is taken.
    """
    numeric = len(codes.numeric)
    for node in range(1 << level):
        at = (1 << level) - 1 + node
        w, s = weights[:, node], masses[:, node]
        whole, mass = w[0].sum(), s[0].sum()
        best = None
        for f in range(codes.width()):
            if f < numeric:
                order = np.arange(len(codes.numeric[list(codes.numeric)[f]]) + 1)
            else:
                size = len(codes.categorical[list(codes.categorical)[f - numeric]]) + 1
                mean = np.divide(s[f, :size], w[f, :size], out=np.full(size, np.inf), where=w[f, :size] > 0)
                order = np.argsort(mean, kind="stable")
            left, held = np.cumsum(w[f, order])[:-1], np.cumsum(s[f, order])[:-1]
            rest = whole - left
            valid = (np.cumsum(w[f, order] > 0)[:-1] > 0) & (np.cumsum((w[f, order] > 0)[::-1])[::-1][1:] > 0)
            if not valid.any():
                continue
            gain = np.full(len(left), -np.inf)
            gain[valid] = held[valid] ** 2 / left[valid] + (mass - held[valid]) ** 2 / rest[valid] - mass**2 / whole
            k = int(np.argmax(gain))
            # what binary noise leaves of no gain is none
            if gain[k] > 1e-12 * (gain[k] + mass**2 / whole) and (best is None or gain[k] > best[0]):
                best = gain[k], order[: k + 1], f, held[k] / left[k], (mass - held[k]) / rest[k]
        tree.right[at] = False
        ends = (mass / whole,) * 2 if whole > 0 else None
        if best is not None:
            tree.feature[at], tree.right[at] = best[2], True
            tree.right[at, best[1]] = False
            ends = best[3:]
        span = len(tree.value) >> (level + 1)
        for side in range(2 if ends else 0):  # a node without rows keeps the value from above
            tree.value[(2 * node + side) * span : (2 * node + side + 1) * span] = ends[side]


def _seed(depth: int) -> Tree:
    nodes = (1 << depth) - 1
    return Tree(np.zeros(nodes, np.int64), np.zeros((nodes, BINS), bool), np.zeros(1 << depth))


def train(
    df: DataFrame, features: list[str], label: str, grid: list[BoostParams], weight: str | None = None,
    stop_flag: str | None = None, categorical: list[str] = [],
) -> list[Booster]:
    """A model per parameter set on the same rows; ``stop_flag`` marks rows that only decide when to stop.

    ``categorical`` columns are split as sets of values; a value that training did not see is one more category. The
    label is 0 or 1.
    """
    spark = df.sparkSession
    stop = F.col(stop_flag).cast("boolean") if stop_flag else F.lit(False)
    rows = df.select(
        F.col(label).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), stop.alias("_stop"),
        *dict.fromkeys([*features, *categorical]),
    ).where(F.col("_stop").isNotNull())
    whole = [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in features]
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_stop")).alias("fit"),
        F.count_if(reduce(and_, whole, F.col("_y").isin(0.0, 1.0) & (F.col("_w") >= 0))).alias("good"),
    ).first()
    if size["good"] < size["n"]:
        raise ValueError("labels must be 0 or 1, weights not negative, numeric features finite, none missing")
    if size["fit"] == 0 or (stop_flag and size["fit"] == size["n"]):
        raise ValueError("no rows to train on, or none to decide when to stop")
    codes = codes_of(rows, features, categorical, size["fit"])
    full = -(-size["n"] // BLOCK)
    parts = max(min(4 * spark.sparkContext.defaultParallelism, full), -(-full // HELD))
    made = rows.select("_y", "_w", "_stop", *codes.columns()).mapInArrow(_blocks(codes), BLOCK_SCHEMA)
    blocks = made.repartition(parts).persist(StorageLevel.DISK_ONLY)
    models, since = [Booster(params, codes) for params in grid], 0
    try:
        for turn in range(max(p.trees for p in grid) + 1):
            # with rows to judge by, a pass follows the last tree too
            growing = [None if m.done or not (stop_flag or turn < m.params.trees) else _seed(m.params.depth) for m in models]
            for level in range(max(p.depth for p in grid)):
                on = [tree if tree is not None and level < tree.depth else None for tree in growing]
                if not any(on):
                    break
                sums = _sum_up(blocks, parts, _level(models, on, level, since)).reshape(len(models), -1)
                sums = [tree and sums[_twin(models, on, level, k)] for k, tree in enumerate(on)]
                for k, (model, tree) in enumerate(zip(models, on)):
                    if tree is None:
                        continue
                    if level == 0 and model.trees and stop_flag:
                        model.judge(sums[k][1] / sums[k][0])
                        if model.done:
                            growing[k] = None
                            continue
                    cells = sums[k][2:].reshape(2, codes.width(), 1 << level, BINS)
                    _grow(tree, level, cells[0], cells[1], codes)
            for model, tree in zip(models, growing):
                if tree:
                    model.trees.append(tree)
            if not any(growing):
                break
            if turn + 1 - since >= PENDING:
                before, blocks = blocks, blocks.mapInArrow(_kept(models, since), BLOCK_SCHEMA).persist(StorageLevel.DISK_ONLY)
                blocks.count()
                before.unpersist()
                since = turn + 1
    finally:
        blocks.unpersist()
    for model in models:
        if stop_flag:
            del model.trees[model.best :]
    return models


def score(models: list[Booster], df: DataFrame, outs: list[str]) -> DataFrame:
    """``df`` with a column per model: the probability of label 1. The models were trained together."""
    codes = models[0].codes
    kinds = [pa.float64()] * len(codes.numeric) + [pa.string()] * len(codes.categorical)

    def probability(columns: pd.DataFrame) -> pd.DataFrame:
        bins = codes.bins([pa.array(columns[c], t, from_pandas=True) for c, t in zip(columns, kinds)])
        with np.errstate(over="ignore"):
            return pd.DataFrame({out: 1.0 / (1.0 + np.exp(-2.0 * m.add(bins, np.zeros(len(columns)), 0, len(m.trees)))) for out, m in zip(outs, models)})

    of = F.pandas_udf(probability, ", ".join(f"{out} double" for out in outs))
    scored = df.withColumn("_ps", of(F.struct(*[c.alias(f"f{k}") for k, c in enumerate(codes.columns())])))
    return scored.select(*df.columns, *[f"_ps.{out}" for out in outs])

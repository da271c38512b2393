"""Ridge systems whose penalised columns fall into blocks that never meet in a row, solved directly.

Players of different groups of teams share no row, so without the few unpenalised columns (hubs), which meet all, the
normal equations fall apart into blocks. The blocks are found in the entries themselves. A task holds one block of all
parts at a time, solves all systems on it, and leaves its share of the equations of the hubs; once these are solved,
each block has its own solution. Only sums as large as the hubs' equations pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.session import cut_lineage, forget

# The widest block and the most hubs that are solved directly; bytes of blocks that one task reads.
WIDEST, HUBS, TASK_BYTES = 1024, 64, 32 << 20
# what is left of a hub beside the other columns, as a share, below which the systems count as singular
LEAST = 1e-9


def components(pairs: DataFrame) -> DataFrame | None:
    """``i, block`` from pairs ``i, j``: the least column that a column is linked with; none if there are no pairs.

    In a round each column goes to its least neighbour, and pairs go with their columns until none is left.
    """
    edges, labels = cut_lineage(pairs), None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
        to = cut_lineage(both.groupBy("i").agg(F.least("i", F.min("j")).alias("to")))
        if labels is None:
            moved = to.withColumnRenamed("to", "block")
        else:
            on = labels.join(to.toDF("block", "to"), "block", "left")
            moved = on.select("i", F.coalesce("to", "block").alias("block"))
        ends = edges.join(to, "i").select(F.col("to").alias("i"), "j").join(to.toDF("j", "_to"), "j").select("i", F.col("_to").alias("j"))
        written, fewer = cut_lineage(moved), cut_lineage(ends.where("i <> j").distinct())
        for old in (edges, to, *([labels] if labels is not None else [])):
            forget(old)
        labels, edges = written, fewer
    forget(edges)
    return labels


def _pack(parts: list[int], hubs: list[int]):
    """The rows ``part, i, j, v, prior`` of a block as one row of dense arrays; a row's column ``block`` comes first."""

    def run(table):
        part, i, j, v = (table[c].to_numpy() for c in ("part", "i", "j", "v"))
        where = lambda of, values: (np.searchsorted(of, values), np.isin(values, of))
        hub, at = np.array(sorted(hubs), np.int64), np.searchsorted(parts, part)
        own = np.unique(i[(i == j)])
        m, size = len(own), len(parts)
        left, left_own = where(own, i)
        right, right_own = where(own, j)
        square, border, line = np.zeros((size, m, m)), np.zeros((size, m, len(hub))), np.zeros((size, m))
        pick = left_own & right_own
        square[at[pick], left[pick], right[pick]] = v[pick]
        square[at[pick], right[pick], left[pick]] = v[pick]
        pick = left_own & (j == -1)
        line[at[pick], left[pick]] = v[pick]
        for mine, other, place in ((left_own, j, left), (right_own, i, right)):
            spot, is_hub = where(hub, other)
            pick = mine & is_hub
            border[at[pick], place[pick], spot[pick]] = v[pick]
        prior = np.zeros(m)
        pick = i == j
        prior[left[pick]] = table["prior"].to_numpy()[pick]
        cells = [x.tobytes() for x in (own, square, border, line, prior)]
        return pa.table([pa.array([c], pa.binary()) for c in cells], names=PACKED)

    return run


PACKED = ["own", "square", "border", "line", "prior"]


def _unpacked(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            own, square, border, line, prior = (np.frombuffer(c[at].as_buffer(), np.int64 if k == 0 else float) for k, c in enumerate(batch.columns))
            m, size = len(own), len(line) // len(own)
            yield own, square.reshape(size, m, m), border.reshape(size, m, -1), line.reshape(size, m), prior


def _inner(block, parts: list[int], lams: list[float], hub_prior: np.ndarray):
    """Per penalty the solutions of a block on the sum of ``parts`` for: its border, its target, its own prior."""
    _, square, border, line, prior = block
    whole, edge = square[parts].sum(0), border[parts].sum(0)
    right = np.column_stack([edge, line[parts].sum(0), whole @ prior + edge @ hub_prior])
    return edge, np.stack([np.linalg.solve(whole + lam * np.eye(len(whole)), right) for lam in lams])


def _sums(rows: DataFrame, shape: tuple) -> np.ndarray:
    """The sum of the arrays that the tasks leave; a task of some blocks leaves one."""
    total = np.zeros(int(np.prod(shape)))
    for row in rows.repartition(8).mapInArrow(_added, "s array<double>").collect():
        total += np.array(row["s"])
    return total.reshape(shape)


def _added(batches):
    total = None
    for batch in batches:
        for cell in batch.column(0):
            part = cell.values.to_numpy(zero_copy_only=False)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield _row(total)


def _row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["s"])


def _bent(y: np.ndarray, with_prior: np.ndarray, prior: np.ndarray, kappa: float) -> np.ndarray:
    return y + kappa * (prior - with_prior)


@dataclass
class Blocks:
    """Blocks of the moments ``part, i, j, v`` with what the driver holds of the hubs: per part their square and target."""

    packed: DataFrame
    parts: list[int]
    hubs: list[int]
    corner: np.ndarray
    line: np.ndarray
    prior: np.ndarray

    def _at(self, parts: list[int]) -> list[int]:
        return [self.parts.index(p) for p in parts if p in self.parts]

    def solve_hubs(self, subsets: dict[int, list[int]], lams: list[float]) -> dict:
        """``(u, lam) -> `` a row per hub of its solutions for the target and for the prior.

        Raises ``LinAlgError`` where hubs repeat each other or the sum of others.
        """
        at, hub_prior, count = {u: self._at(parts) for u, parts in subsets.items()}, self.prior, len(self.hubs)
        shape = (len(at), len(lams) + 1, count, count + 2)

        def run(batches):
            total = np.zeros(shape)
            for block in _unpacked(batches):
                for n, parts in enumerate(at.values()):
                    edge, inner = _inner(block, parts, lams, hub_prior)
                    total[n, :-1] += np.einsum("mh,lmc->lhc", edge, inner)
                    total[n, -1, :, 0] += edge.T @ block[4]
            yield _row(total)

        total, out = _sums(self.packed.mapInArrow(run, "s array<double>"), shape), {}
        for n, (u, parts) in enumerate(at.items()):
            corner, line = self.corner[parts].sum(0), self.line[parts].sum(0)
            there = np.flatnonzero(np.diag(corner) > 0)
            scale = 1.0 / np.sqrt(np.diag(corner)[there])
            right = np.column_stack([line, total[n, -1, :, 0] + corner @ hub_prior])
            for k, lam in enumerate(lams):
                left = ((corner - total[n, k, :, :count])[np.ix_(there, there)]) * np.outer(scale, scale)
                if len(there) and np.linalg.eigvalsh(left)[0] < LEAST:
                    raise np.linalg.LinAlgError("the unpenalised columns repeat each other")
                found = np.zeros((count, 2))
                found[there] = scale[:, None] * np.linalg.solve(left, scale[:, None] * (right - total[n, k, :, count:])[there])
                out[u, lam] = found
        return out

    def _fit(self, hubs: dict, u: int, slots: list[tuple[float, float]]) -> np.ndarray:
        """The coefficients of the hubs, a column per ``(penalty, kappa)``."""
        return np.stack([_bent(hubs[u, lam][:, 0], hubs[u, lam][:, 1], self.prior, kappa) for lam, kappa in slots], 1)

    def _block_fit(self, subsets: dict[int, list[int]], hubs: dict, slots: dict[int, list[tuple[float, float]]]):
        """A function of a block and a subset to the block's coefficients, a column per slot of the subset."""
        at, hub_prior = {u: self._at(subsets[u]) for u in slots}, self.prior
        lams = {u: list(dict.fromkeys(lam for lam, _ in each)) for u, each in slots.items()}
        hubs = {key: value for key, value in hubs.items() if key[0] in slots}

        def fit(block, u):
            edge, inner = _inner(block, at[u], lams[u], hub_prior)
            count = edge.shape[1]
            x = {lam: inner[k][:, count:] - inner[k][:, :count] @ hubs[u, lam] for k, lam in enumerate(lams[u])}
            return np.stack([_bent(x[lam][:, 0], x[lam][:, 1], block[4], kappa) for lam, kappa in slots[u]], 1)

        return fit

    def held_out_errors(
        self, norms: dict[int, tuple[float, float]], subsets: dict[int, list[int]], pairs: list[tuple[int, int]], hubs: dict,
        slots: dict[int, list[tuple[float, float]]],
    ) -> dict:
        """``(u, part) -> [error per slot]``: weighted mean squared error of the fits on a subset on the rows of a part."""
        width = len(next(iter(slots.values())))
        fit, outer = self._block_fit(subsets, hubs, slots), {u: self._fit(hubs, u, each) for u, each in slots.items()}
        held = {u: [(n, self.parts.index(part)) for n, (v, part) in enumerate(pairs) if v == u] for u in slots}
        shape = (len(pairs), 2, width)

        def run(batches):
            total = np.zeros(shape)
            for block in _unpacked(batches):
                for u, each in held.items():
                    beta = fit(block, u)
                    for n, part in each:
                        _, square, border, line, _ = block
                        total[n, 0] += (beta * (square[part] @ beta + 2.0 * border[part] @ outer[u])).sum(0)
                        total[n, 1] += line[part] @ beta
            yield _row(total)

        total, out = _sums(self.packed.mapInArrow(run, "s array<double>"), shape), {}
        for n, (u, part) in enumerate(pairs):
            corner, line = self.corner[self.parts.index(part)], self.line[self.parts.index(part)]
            square = total[n, 0] + (outer[u] * (corner @ outer[u])).sum(0)
            yy, sw = norms[part]
            out[u, part] = ((yy - 2 * (total[n, 1] + line @ outer[u]) + square) / sw).tolist()
        return out

    def fits(self, subsets: dict[int, list[int]], hubs: dict, u: int, slots: list[tuple[float, float]]) -> DataFrame:
        """``i, beta`` of a subset, with a slot per ``(penalty, kappa)``."""
        fit = self._block_fit(subsets, hubs, {u: slots})

        def run(batches):
            for block in _unpacked(batches):
                beta = fit(block, u)
                yield pa.RecordBatch.from_arrays([pa.array(block[0]), pa.array(list(beta), pa.list_(pa.float64()))], ["i", "beta"])

        outer = self._fit(hubs, u, slots)
        rows = self.packed.mapInArrow(run, "i bigint, beta array<double>")
        more = [(i, beta.tolist()) for i, beta in zip(self.hubs, outer)]
        return rows.unionAll(rows.sparkSession.createDataFrame(more, rows.schema)) if more else rows

    def release(self) -> None:
        self.packed.unpersist()


def blocks_of(g: DataFrame, penalised: Column, prior: DataFrame | None = None) -> Blocks | None:
    """The blocks of the moments ``part, i, j, v``, or none where one of them or the hubs are too wide."""
    spark = g.sparkSession
    flag = F.coalesce(penalised, F.lit(False))
    g = g.where(F.col("part").isNotNull()).fillna(0.0, ["v"])
    turned = g.select("part", F.col("i").alias("_i"), F.col("j").alias("i"), "v").withColumn("_right", flag & (F.col("i") >= 0))
    known = turned.select("part", F.col("_i").alias("i"), F.col("i").alias("j"), "v", "_right").withColumn("_left", flag)
    # both hubs, or a hub and the target
    middle = known.where("NOT _left AND NOT _right AND j >= -1").select("part", "i", "j", "v")
    hubs = sorted(row["i"] for row in middle.where("i = j").select("i").distinct().limit(HUBS + 1).collect())
    if len(hubs) > HUBS:
        return None
    labels = components(known.where("_left AND _right AND i < j").select("i", "j").distinct())
    own = known.where("_left AND i = j").select("i").distinct()
    own = own.withColumn("block", F.col("i")) if labels is None else own.join(labels, "i", "left").withColumn("block", F.coalesce("block", "i"))
    if prior is None:
        own = own.withColumn("prior", F.lit(0.0))
    else:
        own = own.join(prior.select("i", "prior"), "i", "left").fillna(0.0, ["prior"])
    own = cut_lineage(own)
    parts = sorted(row["part"] for row in g.select("part").distinct().collect())
    sizes = own.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    size = sizes.agg(F.max("m").alias("widest"), F.sum(F.col("m") * (F.col("m") + len(hubs) + 1)).alias("cells")).first()
    if not size["widest"] or size["widest"] > WIDEST:
        return None
    corner, line = np.zeros((len(parts), len(hubs), len(hubs))), np.zeros((len(parts), len(hubs)))
    for row in middle.collect():  # a row per part and pair of hubs
        part, i = parts.index(row["part"]), hubs.index(row["i"])
        if row["j"] < 0:
            line[part, i] = row["v"]
        else:
            corner[part, i, hubs.index(row["j"])] = corner[part, hubs.index(row["j"]), i] = row["v"]
    hub_prior = {} if prior is None else {row["i"]: row["prior"] for row in prior.where(F.col("i").isin(hubs)).collect()}
    key = F.when(F.col("_left"), F.col("i")).otherwise(F.col("j"))
    rows = known.where("(_left OR _right) AND j >= -1").select("part", "i", "j", "v", key.alias("_key"))
    rows = rows.join(own.toDF("_key", "block", "prior"), "_key").select("block", "part", "i", "j", "v", "prior")
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-size["cells"] * 8 * len(parts) // TASK_BYTES))
    made = rows.repartition(tasks, "block").groupBy("block").applyInArrow(_pack(parts, hubs), ", ".join(f"{c} binary" for c in PACKED))
    packed = made.persist(StorageLevel.DISK_ONLY)
    return Blocks(packed, parts, hubs, corner, line, np.array([hub_prior.get(i) or 0.0 for i in hubs]))

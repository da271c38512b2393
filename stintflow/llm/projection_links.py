"""Near-duplicate embeddings by counting collisions on many sorted one-dimensional projections.

Vectors of one label are scaled to unit length; equal ones are one class. Two at the wanted cosine lie ``REACH``
apart, so on a random projection they differ by ``REACH`` times a normal draw. Each of ``PROJECTIONS`` projections is
sorted; a window around a query's place collects those that collide with it there. A pair that collides on at least
``threshold()`` of them, which a pair at the wanted cosine misses with a chance below ``1 - RECALL``, is verified on
the whole vectors in double precision.

The first projections also lay out the work: they cut a label into cells wider than any window that matters, so only
neighbouring cells meet, and a cell with too many classes is cut into tiles, all pairs of which meet. How many of
them cut is chosen by the label's size. A meeting of two tiles returns a row per class with links: how many vectors
it is linked to there, and the head of the group those links put it in; a large group never becomes all of its pairs.
"""

from __future__ import annotations

from itertools import product
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintflow.llm.common import spans
from stintflow.llm.components import components
from stintflow.llm.simhash import _unite
from stintflow.session import cut_lineage

COSINE = 0.98
PROJECTIONS = 16
WINDOW = 2.5  # half a window, in distances of a pair at the wanted cosine
CELL = 4.0  # width of a cell, likewise; farther apart than that are 6 of 100,000 such pairs on a projection
RECALL = 0.999
LEADS = 4  # projections that may cut a label into cells
TILE = 2048
DENSE = 6  # projections counted for all pairs of two tiles, before the pairs out of reach go
SEED = 13
_ROWS = 256  # queries whose windows are counted at once
_LOT = 1 << 15  # pairs verified at once


def reach(cosine: float = COSINE) -> float:
    return sqrt(2.0 - 2.0 * cosine)


def threshold(projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The greatest count that a pair at the wanted cosine reaches with a chance of ``recall`` or more."""
    hit = erf(window / sqrt(2.0))
    chance = 0.0
    for count in range(projections, 0, -1):
        chance += comb(projections, count) * hit**count * (1 - hit) ** (projections - count)
        if chance >= recall:
            return count
    return 1


def directions(dim: int) -> np.ndarray:
    """``(dim, PROJECTIONS)`` normal draws, the same in every task and run."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


def unit(vec: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so that no square leaves the range."""
    vec = vec / np.abs(vec).max(axis=1, keepdims=True)
    return vec / np.sqrt((vec * vec).sum(axis=1, keepdims=True))


def linkable(vec: str):
    """Finite components, one of them not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vec).isNotNull() & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0)


def _place(width: float):
    """Unit vectors as bytes, and their cell: a byte per lead, of the place on its projection."""

    def run(batches):
        for batch in batches:
            at = batch.column("dim").to_numpy()
            vec, lead = batch.column("vec"), batch.column("leads").to_numpy()
            flat, ends = vec.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(at)]
            raw, cell = [None] * len(at), np.zeros(len(at), np.int64)
            for dim in np.unique(at).tolist():
                rows = np.flatnonzero(at == dim)
                u = unit(flat[spans(ends[rows], at[rows])].reshape(len(rows), dim))
                steps = np.clip(np.floor(u @ directions(dim)[:, :LEADS] / width), -60, 60).astype(np.int64) + 64
                used = np.arange(LEADS)[None, :] < lead[rows][:, None]
                cell[rows] = (np.where(used, steps, 0) << (8 * np.arange(LEADS))).sum(axis=1)
                for row, x in zip(rows.tolist(), u):
                    raw[row] = x.tobytes()
            keep = [batch.column(c) for c in ("gid", "dim", "node", "weight")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(cell), pa.array(raw, pa.binary())], ["gid", "dim", "node", "weight", "cell", "vec"]
            )

    return run


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("node")
    first = rows.iloc[0]
    return pd.DataFrame(
        {
            "gid": [first["gid"]],
            "cell": [first["cell"]],
            "sub": [first["sub"]],
            "dim": [first["dim"]],
            "nodes": [rows["node"].to_numpy(np.int64).tobytes()],
            "weights": [rows["weight"].to_numpy(np.int64).tobytes()],
            "vecs": [b"".join(rows["vec"])],
        }
    )


def colliding(a: np.ndarray, b: np.ndarray, window: float, least: int):
    """Row numbers ``i, j`` of the pairs of two tiles that collide on ``least`` of their projections, in lots.

    ``a, b`` are places ``(row, projection)``; a projection's window reaches ``window`` to both sides of a query.
    """
    many = a.shape[1]
    dense, spare = min(DENSE, many), many - least
    order = np.argsort(b[:, :dense], axis=0, kind="stable")
    line = np.take_along_axis(b[:, :dense], order, axis=0)
    for at in range(0, len(a), _ROWS):
        query = a[at : at + _ROWS]
        counts = np.zeros((len(query), len(b)), np.uint8)
        for k in range(dense):
            low = np.searchsorted(line[:, k], query[:, k] - window, "left")
            high = np.searchsorted(line[:, k], query[:, k] + window, "right")
            met = order[spans(low, high - low), k]
            counts[np.repeat(np.arange(len(query)), high - low), met] += 1
        i, j = np.nonzero(counts >= max(0, dense - spare))
        seen = counts[i, j].astype(np.int64)
        for k in range(dense, many):
            seen += np.abs(query[i, k] - b[j, k]) <= window
            on = seen >= k + 1 - spare
            i, j, seen = i[on], j[on], seen[on]
        yield i + at, j


def _verified(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), _LOT):
        lot = slice(at, at + _LOT)
        out[lot] = np.einsum("ij,ij->i", u[i[lot]], v[j[lot]]) >= cosine
    return out


def tile_links(u: np.ndarray, v: np.ndarray | None, wu: np.ndarray, wv: np.ndarray | None, cosine: float = COSINE):
    """Of two tiles of unit vectors (``v`` None: of one), per row of both: weight linked to, and head of its group."""
    same = v is None
    v, wv = (u, wu) if same else (v, wv)
    shift = 0 if same else len(u)
    ways = directions(u.shape[1])
    a = u @ ways
    b = a if same else v @ ways
    total = len(u) + (0 if same else len(v))
    linked, labels = np.zeros(total, np.int64), np.arange(total)
    for i, j in colliding(a, b, WINDOW * reach(cosine), threshold()):
        if same:
            once = i < j
            i, j = i[once], j[once]
        on = _verified(u, v, i, j, cosine)
        i, j = i[on], j[on]
        if len(i):
            np.add.at(linked, i, wv[j])
            np.add.at(linked, j + shift, wu[i])
            labels = _unite(labels, i, j + shift)
    return linked, labels


def _meet(cosine: float):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                of = lambda side: (
                    np.frombuffer(row[f"nodes_{side}"], np.int64),
                    np.frombuffer(row[f"weights_{side}"], np.int64),
                    np.frombuffer(row[f"vecs_{side}"], np.float64).reshape(-1, row["dim"]),
                )
                nodes, wu, u = of("l")
                if row["same"]:
                    linked, labels = tile_links(u, None, wu, None, cosine)
                else:
                    more, wv, v = of("r")
                    linked, labels = tile_links(u, v, wu, wv, cosine)
                    nodes = np.concatenate([nodes, more])
                found = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[found]), pa.array(nodes[labels[found]]), pa.array(linked[found])], ["node", "head", "links"]
                )

    return run


def class_links(classes: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``node, head, links`` rows of the linked classes ``node, label, vec, weight``, one per meeting of two tiles."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = classes.withColumn("dim", F.size("vec"))
    leads = F.least(F.lit(LEADS), F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / tile) / F.log(F.lit(4.0))))).cast("int")
    groups = sized.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("leads", leads)
    groups = cut_lineage(groups.withColumn("gid", F.monotonically_increasing_id()))
    placed = cut_lineage(
        sized.join(groups, ["label", "dim"])
        .select("gid", "dim", "leads", "node", "weight", "vec")
        .mapInArrow(_place(CELL * reach(cosine)), "gid bigint, dim int, node bigint, weight bigint, cell bigint, vec binary")
    )
    cells = cut_lineage(
        placed.groupBy("gid", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("subs")).join(groups.select("gid", "leads"), "gid")
    )
    tiles = cut_lineage(
        placed.join(cells.select("gid", "cell", "subs"), ["gid", "cell"])
        .withColumn("sub", F.pmod(F.xxhash64("node"), "subs"))
        .select("gid", "cell", "sub", "dim", "node", "weight", "vec")
        .groupBy("gid", "cell", "sub")
        .applyInPandas(_pack, "gid bigint, cell bigint, sub bigint, dim int, nodes binary, weights binary, vecs binary")
    )
    near = F.array(F.lit(0).cast("bigint"))
    for many in range(1, LEADS + 1):
        ways = [sum(d << (8 * k) for k, d in enumerate(step)) for step in product((-1, 0, 1), repeat=many)]
        near = F.when(F.col("leads") == many, F.array(*[F.lit(w).cast("bigint") for w in sorted(ways) if w >= 0])).otherwise(near)
    pairs = cells.withColumn("step", F.explode(near)).withColumn("other", F.col("cell") + F.col("step"))
    others = cells.select("gid", F.col("cell").alias("other"), F.col("subs").alias("other_subs"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    pairs = (
        pairs.join(others, ["gid", "other"])
        .withColumn("sub", upto("subs"))
        .withColumn("other_sub", upto("other_subs"))
        .where((F.col("cell") != F.col("other")) | (F.col("sub") <= F.col("other_sub")))
        .select("gid", "cell", "sub", "other", "other_sub")
    )
    left = tiles.toDF("gid", "cell", "sub", "dim", "nodes_l", "weights_l", "vecs_l")
    right = tiles.drop("dim").toDF("gid", "other", "other_sub", "nodes_r", "weights_r", "vecs_r")
    same = (F.col("cell") == F.col("other")) & (F.col("sub") == F.col("other_sub"))
    # a number of tasks that does not follow the bytes: the work follows the pairs
    dealt = pairs.join(left, ["gid", "cell", "sub"]).repartition(parts, "gid", "other", "other_sub")
    met = dealt.join(right.repartition(parts, "gid", "other", "other_sub"), ["gid", "other", "other_sub"])
    columns = ["dim", same.alias("same"), "nodes_l", "weights_l", "vecs_l", "nodes_r", "weights_r", "vecs_r"]
    return met.select(*columns).mapInArrow(_meet(cosine), "node bigint, head bigint, links bigint")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tile: int = TILE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per vector.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine is at least
    ``cosine``; pairs beyond it may be missed with a chance of about ``1 - RECALL``, no pair below it is linked.
    Vectors that are null, zero or hold null or non-finite components link with nothing. ``component_id`` is the
    smallest id reachable, a null one only where there is no other; ``kept`` where it is the row's own (null too).
    Repeated rows each get a row and link with each other. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    # 128 bits name a vector; the second hash starts from another seed
    keyed = rows.withColumn("on", F.col("label").isNotNull() & F.coalesce(linkable("vec"), F.lit(False))).withColumns(
        {"key": F.xxhash64("vec"), "more": F.xxhash64(F.lit("second"), "vec")}
    )
    names = cut_lineage(keyed.select("vec_id", "label", "on", "key", "more"))
    whole = keyed.where("on").groupBy("label", "key", "more").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("vec").alias("vec")
    )
    classes = cut_lineage(whole.withColumn("node", F.monotonically_increasing_id()))
    found = cut_lineage(class_links(classes.select("node", "label", "vec", "weight"), cosine, tile))
    links = cut_lineage(found.groupBy("node").agg(F.sum("links").alias("links")))
    member = cut_lineage(components(found.select(F.col("node").alias("u"), F.col("head").alias("v"))))
    rooted = cut_lineage(
        classes.drop("vec")
        .join(links, "node", "left")
        .join(member, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    known = cut_lineage(
        rooted.join(least, "root").select(
            "label", "key", "more", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        )
    )
    single = names.where("NOT on").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    own = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    joined = names.where("on").join(known, ["label", "key", "more"]).select("vec_id", "n_links", "component_id", own)
    return single.unionAll(joined)

"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are cut into tiles by the population counts of their four 16-bit words; a tile with
more than ``TILE`` fingerprints is cut further by hash. Two fingerprints within the radius differ in their
counts by no more than the radius in all, so tile pairs beyond that are skipped unread. Each remaining pair
is compared exactly with numpy's exclusive-or and bit counts. A pair of tiles yields not its links but a
star per group of linked fingerprints, at most one row per fingerprint, so a large group of near copies
never becomes all of its pairs. Stars are merged to components on the cluster.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintflow.llm.common import KEY, id_text, key_of, slices, text_of, with_key, words
from stintflow.llm.components import components
from stintflow.session import cut_lineage

SHINGLE = 3
SEED = 42
RADIUS = 3
TILE = 4096
PARTS = 4
_SIDE = 64 // PARTS + 1
_LOT = 1 << 16


def fingerprint(text: str) -> int:
    """64 bits, each set if set in over half of the shingles' XXH64; no words: zero; signed."""
    from xxhash import xxh64_intdigest

    tokens = words(text)
    if not tokens:
        return 0
    whole = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    if len(tokens) <= SHINGLE:
        parts = [whole]
    else:
        starts = (ends - [len(t) + 1 for t in tokens])[: len(tokens) - SHINGLE + 1]
        parts = [whole[a:b] for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist())]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(parts), _LOT):
        hashes = np.array([xxh64_intdigest(p, SEED) for p in parts[at : at + _LOT]], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(parts), bitorder="little").view("<i8")[0])


def _add_fingerprints(batches):
    for batch in slices(batches, 1024):
        out = batch.drop(columns="text")
        out["fp"] = [fingerprint(t) for t in batch["text"]]
        yield out


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``text_key`` (xxhash64 of the text) and signed ``fp`` of every row, with its ``doc_id``."""
    id_type = docs.schema["doc_id"].dataType
    texts = docs.select(id_text("doc_id").alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = texts.mapInPandas(_add_fingerprints, "doc_id string, text_key bigint, fp bigint")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))


def _unite(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest label of each linked group, by repeated minima along the links and label jumps."""
    while True:
        low = np.minimum(labels[u], labels[v])
        new = labels.copy()
        for end in (u, v, labels[u], labels[v]):
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def linked_stars(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two tiles (``b`` None: of one) and the head of the group that their links put them in."""
    both = a if b is None else np.concatenate([a, b])
    right, shift = (a, 0) if b is None else (b, len(a))
    labels = np.arange(len(both))
    rows = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(a), rows):
        apart = np.bitwise_count(a[at : at + rows, None] ^ right[None, :])
        i, j = np.nonzero(apart <= radius)
        i, j = i + at, j + shift
        keep = i != j
        if keep.any():
            labels = _unite(labels, i[keep], j[keep])
    moved = np.flatnonzero(labels != np.arange(len(both)))
    return both[moved], both[labels[moved]]


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            us, vs = [], []
            for row in batch.itertuples(index=False):
                a = np.frombuffer(row.left, "<u8")
                u, v = linked_stars(a, None if row.same else np.frombuffer(row.right, "<u8"), radius)
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return run


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "cell": [int(rows["cell"].iloc[0])],
            "sub": [int(rows["sub"].iloc[0])],
            "fps": [rows["fp"].to_numpy(np.int64).view("<u8").tobytes()],
        }
    )


def _steps(radius: int) -> list[tuple]:
    """Differences of word counts within the radius, one of each opposite two."""
    zero = (0,) * PARTS
    return [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius and d >= zero]


def link(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``u, v`` that connect the distinct fingerprints ``fp`` exactly as links within ``radius`` do."""
    width = 64 // PARTS
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1)) for k in range(PARTS)]
    cell = sum((c * _SIDE**k for k, c in enumerate(counts)), F.lit(0)).cast("bigint")
    placed = fps.select("fp", cell.alias("cell"))
    # at most _SIDE ** PARTS rows, whatever the input
    cells = cut_lineage(
        placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("subs"))
    )
    tiles = cut_lineage(
        placed.join(cells, "cell")
        .select("fp", "cell", F.pmod(F.xxhash64("fp"), "subs").alias("sub"))
        .groupBy("cell", "sub")
        .applyInPandas(_pack, "cell bigint, sub bigint, fps binary")
    )
    word = lambda k: F.expr(f"(cell div {_SIDE**k}) % {_SIDE}")
    near = []
    for step in _steps(radius):
        fits = [word(k) + d for k, d in enumerate(step)]
        inside = [(f >= 0) & (f < _SIDE) for f, d in zip(fits, step) if d]
        other = F.col("cell") + sum(d * _SIDE**k for k, d in enumerate(step))
        ok = F.lit(True)
        for test in inside:
            ok = ok & test
        near.append(F.when(ok, other))
    pairs = cells.select("cell", "subs", F.explode(F.array_compact(F.array(*near))).alias("other"))
    pairs = (
        pairs.join(cells.select(F.col("cell").alias("other"), F.col("subs").alias("other_subs")), "other")
        .withColumn("sub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("subs") - 1)))
        .withColumn("other_sub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("other_subs") - 1)))
        .where((F.col("cell") != F.col("other")) | (F.col("sub") <= F.col("other_sub")))
        .select("cell", "sub", "other", "other_sub")
    )
    second = tiles.select(F.col("cell").alias("other"), F.col("sub").alias("other_sub"), F.col("fps").alias("right"))
    joined = (
        pairs.join(tiles, ["cell", "sub"])
        .join(second, ["other", "other_sub"])
        .select(
            F.col("fps").alias("left"),
            "right",
            ((F.col("cell") == F.col("other")) & (F.col("sub") == F.col("other_sub"))).alias("same"),
        )
    )
    return joined.mapInPandas(_compare(radius), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: ``doc_id, text_key, fp, component_id, root``.

    ``component_id`` is the smallest id that can be reached over links between fingerprints that differ in
    at most ``radius`` bits, the document's own included. Null and empty texts have fingerprint zero and
    link like any other. Null ids never are the smallest unless no other is there. Repeated rows each get
    a row; equal fingerprints are compared once. An empty table gives no rows. Other columns are not read.
    ``root`` is the component's smallest fingerprint, which names the component also where no id does.
    """
    rows = cut_lineage(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = cut_lineage(components(cut_lineage(link(nodes.select("fp"), radius, tile))))
    rooted = cut_lineage(
        nodes.join(member, nodes["fp"] == member["node"]).select("fp", "least", "root")
    )
    named = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    shared = rooted.join(named, "root").select("fp", "component_id", "root")
    single = nodes.join(member, nodes["fp"] == member["node"], "left_anti").select(
        "fp", F.col("least").alias("component_id"), F.col("fp").alias("root")
    )
    return rows.join(cut_lineage(shared.unionAll(single)), "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id (then text hash), all columns as they are."""
    found = near_duplicates(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("h"))
    keys = cut_lineage(heads.select(key_of(F.col("h.doc_id"), F.col("h.text_key")).alias(KEY)))
    return with_key(docs, id_col, text_col).join(keys, KEY).dropDuplicates([KEY]).select(*docs.columns)

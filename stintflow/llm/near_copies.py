"""Near copies by SimHash of five-word shingles, every link verified on the whole sets.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8 (a shorter
text is one shingle) and SimHash shows them near each other. Texts with equal sets are one class. A class has a
fingerprint of ``BITS`` bits. At a similarity of 0.8 two of them differ in 15 % of the bits, 39 of 256 with a
standard deviation below 6; ``RADIUS`` lies over four deviations beyond, so by this estimate the fingerprints lose a few
in 100,000 links at the threshold (one in 200 between sets of four and five shingles) and fewer above it, while
unrelated texts, which differ in half of the bits, never come near.

Fingerprints are compared in tiles. As sets that differ in size by over a quarter cannot be linked, tiles hold
sets of nearly one size and only tiles of neighbouring sizes meet. Each pair of tiles yields the classes that have
some other one within the radius, not the pairs. The shingles of these classes are brought together once per pair
of tiles and compared there; what comes out is a forest of verified links, at most one row per class, so a large
group never becomes all of its pairs. Shingles are their 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintflow.llm.common import KEY, id_text, key_of, slices, spans, text_of, with_key, words
from stintflow.llm.components import components
from stintflow.session import cut_lineage, passing_tables

SHINGLE = 5
BITS, RADIUS = 256, 64
FIRST_RADIUS = 22  # of the first 64 bits, which are compared before the others
LEAST = 4  # smaller sets are only similar to equal ones
TILE, TILE_SHINGLES = 1 << 13, 1 << 21
_STEPS = 4  # size classes to a factor of 5/4
_PER_LOG = _STEPS / math.log(1.2501)
_LOT = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CLASS = "doc_id string, text_key bigint, set_key bigint, n int, fp binary"
_MEETING = "cell int, sub bigint, other int, other_sub bigint"


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; no words: none."""
    from xxhash import xxh64_intdigest

    tokens = words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens))
    width = min(SHINGLE, len(codes))
    n = len(codes) - width + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ codes[k : k + n]) * _FACTOR
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _set_key(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    key = xxh64_intdigest(hashes.tobytes())
    return key - (1 << 64) if key >> 63 else key


def fingerprint(hashes: np.ndarray) -> bytes:
    """``BITS`` bits, each set if set in over half of the shingles' hashes, four derived from each shingle."""
    votes = np.zeros(BITS, np.int64)
    salts = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * _FACTOR
    for at in range(0, len(hashes), 4080):
        mixed = hashes[at : at + 4080, None] + salts
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1)
        for part in range(0, len(bits), 255):  # a byte holds the sum of so many
            votes += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes)).tobytes()


def _classes(batches):
    for batch in slices(batches, 1024):
        out = batch.drop(columns="text")
        sets = [shingle_set(t) for t in batch["text"]]
        out["set_key"] = [_set_key(s) for s in sets]
        out["n"] = [len(s) for s in sets]
        out["fp"] = [fingerprint(s) for s in sets]
        yield out


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "cell": [rows["cell"].iloc[0]],
            "sub": [rows["sub"].iloc[0]],
            "keys": [rows["set_key"].to_numpy(np.int64).tobytes()],
            "sizes": [rows["n"].to_numpy(np.int64).tobytes()],
            "fps": [b"".join(rows["fp"])],
        }
    )


def _codes(fps: bytes) -> np.ndarray:
    """The words of 64 bits of all fingerprints, one row per word."""
    return np.ascontiguousarray(np.frombuffer(fps, np.uint64).reshape(-1, BITS // 64).T)


def _near(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints ``x, y`` of sets of ``n`` and ``m`` shingles may be linked."""
    apart = np.bitwise_count(x ^ y).astype(np.int64)
    return (apart[0] <= FIRST_RADIUS) & (apart.sum(axis=0) <= RADIUS) & (5 * n >= 4 * m) & (5 * m >= 4 * n)


def near_ones(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each of two tiles, which of its fingerprints have one in the other tile (``same``: another one) nearby."""
    left, right = np.zeros(len(n), bool), np.zeros(len(m), bool)
    rows = max(1, _LOT // max(1, len(m)))
    for at in range(0, len(n), rows):
        close = np.bitwise_count(a[0, at : at + rows, None] ^ b[0]) <= FIRST_RADIUS
        i, j = np.divmod(np.flatnonzero(close), len(m))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        near = _near(a[:, i], n[i], b[:, j], m[j])
        left[i[near]] = True
        right[j[near]] = True
    return (left | right,) * 2 if same else (left, right)


def _compare(batches):
    for batch in batches:
        for row in batch.itertuples(index=False):
            same = (row.cell, row.sub) == (row.other, row.other_sub)
            sides = [(np.frombuffer(k, np.int64), np.frombuffer(s, np.int64), _codes(f)) for k, s, f in ((row.keys, row.sizes, row.fps), (row.keys2, row.sizes2, row.fps2))]
            (keys, n, a), (keys2, m, b) = sides
            left, right = near_ones(a, n, b, m, same)
            found = [keys[left]] if same else [keys[left], keys2[right]]
            side = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pd.DataFrame({"cell": row.cell, "sub": row.sub, "other": row.other, "other_sub": row.other_sub, "side": side, "set_key": np.concatenate(found)})


def _sets(batches):
    for batch in slices(batches, 1024):
        sets = [shingle_set(t) for t in batch["text"]]
        yield pd.DataFrame({"set_key": batch["set_key"], "fp": batch["fp"], "hashes": [s.tobytes() for s in sets]})


def linked_forest(sets: list[np.ndarray], codes: np.ndarray, side: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links of similarity 0.8 that connect the sets as all such links between near fingerprints do; ``side`` ascends
    and sets of one side meet only if ``same``. A pair that is connected already is not compared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = times[ids] > 1  # a shingle of one set is never shared
    owner = np.repeat(np.arange(len(sets)), sizes)[kept]
    ids = ids[kept]
    counts = np.bincount(owner, minlength=len(sets))
    starts = np.cumsum(counts) - counts
    mine, label, links = np.zeros(len(times), bool), np.arange(len(sets)), []
    second = int(np.searchsorted(side, 1))
    for i in range(len(sets) if same else second):
        first = i + 1 if same else second
        j = first + np.flatnonzero(label[first:] != label[i])
        j = j[_near(codes[:, i : i + 1], sizes[i], codes[:, j], sizes[j])]
        j = j[counts[j] > 0]
        if not len(j):
            continue
        own = ids[starts[i] : starts[i] + counts[i]]
        mine[own] = True
        shared = np.add.reduceat(mine[ids[spans(starts[j], counts[j])]], np.cumsum(counts[j]) - counts[j], dtype=np.int64)
        mine[own] = False
        j = j[9 * shared >= 4 * (sizes[i] + sizes[j])]
        groups, at = np.unique(label[j], return_index=True)
        links += [(i, int(k)) for k in j[at]]
        label[np.isin(label, groups)] = label[i]
    return links


def _verify(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["side", "set_key"])
    sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
    head, key = rows.iloc[0], rows["set_key"].to_numpy()
    same = (head["cell"], head["sub"]) == (head["other"], head["other_sub"])
    links = linked_forest(sets, _codes(b"".join(rows["fp"])), rows["side"].to_numpy(), same)
    return pd.DataFrame({"u": [key[i] for i, _ in links], "v": [key[j] for _, j in links]}, dtype=np.int64)


def similar_links(texts: DataFrame, heads: DataFrame, tile: int = TILE) -> DataFrame:
    """``u, v``: links that connect the classes ``set_key, text_key, n, fp`` of the texts ``text, text_key``."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = heads.where(F.col("n") >= LEAST).select("set_key", "n", "fp", F.floor(F.log("n") * _PER_LOG).cast("int").alias("cell"))
    # a row per size class, a few hundred whatever the input
    subs = F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("n") / TILE_SHINGLES)).alias("subs")
    cells = cut_lineage(placed.groupBy("cell").agg(subs))
    cut = placed.join(cells, "cell").withColumn("sub", F.pmod(F.xxhash64("set_key"), "subs"))
    tiles = cut_lineage(cut.groupBy("cell", "sub").applyInPandas(_pack, "cell int, sub bigint, keys binary, sizes binary, fps binary"))
    counted = lambda subs: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(subs) - 1))
    pairs = cells.select("cell", "subs", F.explode(F.array(*[F.col("cell") + k for k in range(_STEPS + 1)])).alias("other"))
    pairs = pairs.join(cells.toDF("other", "other_subs"), "other").withColumn("sub", counted("subs")).withColumn("other_sub", counted("other_subs"))
    pairs = pairs.where((F.col("cell") != F.col("other")) | (F.col("sub") <= F.col("other_sub"))).select("cell", "sub", "other", "other_sub")
    meeting = pairs.join(tiles, ["cell", "sub"]).join(tiles.toDF("other", "other_sub", "keys2", "sizes2", "fps2"), ["other", "other_sub"])
    meeting = meeting.repartition(parts)  # few rows, much work in each
    near = cut_lineage(meeting.mapInPandas(_compare, _MEETING + ", side int, set_key bigint"))
    needed = near.select("set_key").distinct().join(heads.select("set_key", "text_key", "fp"), "set_key")
    wanted = texts.join(needed, "text_key").select("set_key", "fp", "text").dropDuplicates(["set_key"])
    sets = cut_lineage(wanted.mapInPandas(_sets, "set_key bigint, fp binary, hashes binary"))
    together = near.join(sets, "set_key").groupBy("cell", "sub", "other", "other_sub")
    return cut_lineage(together.applyInPandas(_verify, "u bigint, v bigint"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_key, set_key`` of every row, and ``node, root`` of the classes that have links."""
    id_type = docs.schema[id_col].dataType
    texts = docs.select(text_of(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    named = docs.select(id_text(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = cut_lineage(named.mapInPandas(_classes, _CLASS))
    rows = found.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text_key", "set_key")
    head = F.min(F.struct("text_key", "n", "fp")).alias("h")
    heads = cut_lineage(found.groupBy("set_key").agg(head).select("set_key", "h.*"))
    return rows, cut_lineage(components(similar_links(texts, heads)))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, the one with the smallest id (null last, then text hash), all
    columns as they are. Texts without words are copies of each other."""
    # only the decisions outlive the tables made on the way
    with passing_tables(docs.sparkSession) as tables:
        rows, member = similar_classes(docs, id_col, text_col)
        rooted = rows.join(member, rows["set_key"] == member["node"], "left").select(
            "doc_id", "text_key", F.coalesce("root", "set_key").alias("root")
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("h")
        keys = rooted.groupBy("root").agg(first).select(key_of(F.col("h.doc_id"), F.col("h.text_key")).alias(KEY))
        keys = tables.keep(cut_lineage(keys))
    return with_key(docs, id_col, text_col).join(keys, KEY).dropDuplicates([KEY]).select(*docs.columns)

"""Vector codes by Ball k-means: eight codebooks of sixteen entries, all in whole numbers.

A vector is cut into equal parts; each part position has its own codebook. A round assigns every part to its
nearest entry and moves the entries. An entry's ball is its centre and the farthest part assigned to it; only
entries whose centres lie within twice that radius are its neighbours. A part nearer to its entry than half the way
to the nearest neighbour is in the stable core and keeps its entry unseen. The rings around the core, bounded by half
the ways to the neighbours in order of distance, tell each other part exactly which neighbours can be nearer.

Vectors travel as packed blocks. A round reads the blocks of the one before, writes them with new codes, and with
each block the sums, counts and radii of its parts; these are added up on the cluster, so the driver meets only
numbers of the codebooks, whose size is fixed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintflow.scale import join_null_safe
from stintflow.session import cut_lineage, forget

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 4096
# Beyond this the squared distances of a code could leave the range of a long.
LIMIT = 1 << 27


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, vec`` of the rows whose vector has only finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    return rows.where(F.col("vec").isNotNull() & F.forall("vec", finite))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``; the product is exact, as ``SCALE`` is a power of two."""
    scaled = np.floor(x * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"components of {LIMIT // SCALE} and beyond have no code")
    return scaled.astype(np.int64)


@dataclass
class Codebooks:
    """Centres ``(part, entry, position)``, and a bound on each ball's radius (None before the first round)."""

    centres: np.ndarray
    radius: np.ndarray | None = None


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def nearest(points: np.ndarray, centres: np.ndarray, codes: np.ndarray | None, radius: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre, ties to the lower index; exact.

    ``codes`` are the entries of the round before and ``radius`` bounds how far the parts of each entry lie from
    its centre as it is now; without them every entry is a candidate.
    """
    if codes is None:
        rows = np.repeat(np.arange(len(points)), len(centres))
        entries = np.tile(np.arange(len(centres)), len(points))
        out, own = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    else:
        own = _gaps(points, centres[codes])
        apart = _gaps(centres[:, None], centres[None])
        # neighbours: balls that half the way to the other centre does not clear
        near = apart <= (4.0 * radius * radius * (1 + 1e-9) + 1)[:, None]
        np.fill_diagonal(near, False)
        core = np.where(near, apart, np.iinfo(np.int64).max).min(axis=1)
        open_rows = np.flatnonzero(4 * own >= core[codes])
        mine = codes[open_rows]
        # the ring of a part: neighbours within twice its distance; itself too, for ties and the least
        fits = near[mine] & (apart[mine] <= 4 * own[open_rows][:, None])
        fits[np.arange(len(mine)), mine] = True
        at, entries = np.nonzero(fits)
        rows, out = open_rows[at], codes.astype(np.int64)
    if len(rows):
        far = _gaps(points[rows], centres[entries])
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.minimum.reduceat(far, starts)
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
        best = np.flatnonzero(far == least[group])
        first = best[np.r_[True, group[best][1:] != group[best][:-1]]]
        out[rows[starts]] = entries[first]
        own[rows[starts]] = least
    return out, own


def _pack(batches):
    """Vectors to blocks of at most ``BLOCK``: ids and labels as they came, components as whole numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            vec = part.column("vec")
            lengths = np.unique(np.diff(vec.offsets.to_numpy()))
            if len(lengths) != 1:
                raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
            x = whole_numbers(vec.flatten().to_numpy(zero_copy_only=False))
            ends = pa.array([0, part.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(ends, part.column("vec_id")),
                    pa.ListArray.from_arrays(ends, part.column("label")),
                    pa.array([x.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([None], pa.binary()),
                ],
                ["vec_ids", "labels", "parts", "codes"],
            )


def _points(raw: bytes, books: Codebooks) -> np.ndarray:
    size = books.centres.shape[2]
    x = np.frombuffer(raw, np.int32)
    if size and len(x) % (PARTS * size):
        raise ValueError(f"a vector's length is not {PARTS * size}, that of the vector with the smallest id")
    return x.reshape(-1, PARTS, size).astype(np.int64)


def _assign(raw: bytes, before: bytes | None, n: int, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts, their codes and squared distances ``(vector, part)`` of one block."""
    x = _points(raw, books) if books.centres.shape[2] else np.zeros((n, PARTS, 0), np.int64)
    if len(x) != n:
        raise ValueError("vectors of different lengths")
    old = None if before is None else np.frombuffer(before, np.uint8).reshape(-1, PARTS)
    codes, far = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS), np.int64)
    for p in range(PARTS):
        args = (None, None) if old is None or books.radius is None else (old[:, p], books.radius[p])
        codes[:, p], far[:, p] = nearest(x[:, p], books.centres[p], *args)
    return x, codes, far


def _round(books: Codebooks):
    """Blocks with new codes and the sums over their parts: components, then count and farthest part per entry."""

    def run(batches):
        k, size = books.centres.shape[1:]
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                raw, before = row.column("parts")[0].as_py(), row.column("codes")[0].as_py()
                n = len(row.column("vec_ids")[0])
                x, codes, gaps = _assign(raw, before, n, books)
                sums = np.zeros((PARTS, k, size), np.int64)
                counts, far = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k), np.int64)
                for p in range(PARTS):
                    np.add.at(sums[p], codes[:, p], x[:, p])
                    np.add.at(counts[p], codes[:, p], 1)
                    np.maximum.at(far[p], codes[:, p], gaps[:, p])
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("vec_ids"),
                        row.column("labels"),
                        row.column("parts"),
                        pa.array([codes.tobytes()], pa.binary()),
                        pa.array([np.r_[sums.ravel(), counts.ravel()].tolist()], pa.list_(pa.int64())),
                        pa.array([far.ravel().tolist()], pa.list_(pa.int64())),
                    ],
                    ["vec_ids", "labels", "parts", "codes", "sums", "far"],
                )

    return run


def _moved(books: Codebooks, blocks: DataFrame) -> Codebooks:
    """The centres of the parts assigned to each entry; the balls' bound grows by the way a centre moves."""
    k, size = books.centres.shape[1:]
    total = np.zeros(PARTS * k * (size + 1), np.int64)
    far = np.zeros(PARTS * k, np.int64)
    # PARTS * ENTRIES * (part length + 2) rows, whatever the input
    for name, out, add in (("sums", total, F.sum), ("far", far, F.max)):
        spread = blocks.select(F.posexplode(name).alias("at", "v"))
        for row in spread.groupBy("at").agg(add("v").alias("v")).collect():
            out[row["at"]] = row["v"]
    sums, counts = total[: PARTS * k * size].reshape(PARTS, k, size), total[PARTS * k * size :].reshape(PARTS, k, 1)
    centres = np.where(counts > 0, sums // np.maximum(counts, 1), books.centres)
    way = np.sqrt(_gaps(centres, books.centres).astype(float))
    return Codebooks(centres, np.sqrt(far.reshape(PARTS, k).astype(float)) + way)


def _finish(books: Codebooks):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                ids, labels = row.column("vec_ids").flatten(), row.column("labels").flatten()
                _, codes, gaps = _assign(row.column("parts")[0].as_py(), row.column("codes")[0].as_py(), len(ids), books)
                text = codes.tobytes().hex()
                width = 2 * PARTS
                code = [text[i : i + width] for i in range(0, len(text), width)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code), pa.array(gaps.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return run


def first_codebooks(rows: DataFrame) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; of equal ids the smaller vector first, null ids last."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").collect()
    if not first:
        return None
    lengths = {len(r["vec"]) for r in first}
    if len(lengths) != 1 or len(first[0]["vec"]) % PARTS:
        raise ValueError(f"vectors of lengths {sorted(lengths)} have no {PARTS} equal parts")
    x = whole_numbers(np.array([r["vec"] for r in first], float))
    return Codebooks(x.reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy())


def ball_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """``vec_id, label, code, error`` of every kept vector, and the codebooks ``(part, entry, position)``.

    Rows whose vector is null or holds null or non-finite components are dropped. Ids and labels may be null or
    repeat; repeated rows each get a row. With fewer than sixteen rows the codebooks have as many entries. Vectors
    must share one length, a multiple of eight, with components below ``LIMIT / SCALE``; others raise ValueError.
    A table without kept rows gives no rows and no codebooks. Other columns are not read.
    """
    rows = kept_vectors(vectors, id_col, vec_col, label_col)
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    books = first_codebooks(rows)
    if books is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), None
    kind = f"vec_ids array<{id_type}>, labels array<{label_type}>, parts binary, codes binary"
    blocks = cut_lineage(rows.mapInArrow(_pack, kind))
    for _ in range(ROUNDS):
        done = cut_lineage(blocks.select("vec_ids", "labels", "parts", "codes").mapInArrow(_round(books), f"{kind}, sums array<bigint>, far array<bigint>"))
        forget(blocks)
        blocks, books = done, _moved(books, done)
    coded = cut_lineage(
        blocks.select("vec_ids", "labels", "parts", "codes").mapInArrow(
            _finish(books), f"vec_id {id_type}, label {label_type}, code string, error bigint"
        )
    )
    forget(blocks)
    return coded, books.centres


def codebooks_digest(centres: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centres.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the error of all vectors with the same label (null being one)."""
    return join_null_safe(coded, cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error"))), ["label"])

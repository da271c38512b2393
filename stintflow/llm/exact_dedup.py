"""Exact deduplication with a two-pass Bloom filter.

Pass one builds two bitmaps over hash cells: hit at all, and hit again. A text whose cells were all
hit again may repeat; only those rows are shuffled to be grouped by their digest. All other rows are
certainly single and pass straight through. The filter has a fixed largest size; more rows than it
serves well are handled in several slices of the hash space, one filter each, so nothing that is
broadcast grows beyond ``MAX_CELLS / 8`` bytes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintflow.llm.common import SPACE, id_text, text_of, with_row
from stintflow.session import cut_lineage

CELLS_PER_ROW = 16
PROBES = 4
SEGMENT = 1 << 16
MAX_CELLS = 1 << 28


def normal_digest(text: str = "text"):
    """SHA-256 of the text with every run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(text_of(text), SPACE, " ").cast("binary"), 256)


def _cells(digests: pd.Series, cells: int) -> np.ndarray:
    """``PROBES`` cell numbers per digest, from its leading 64 bits and the next 64 as a stride."""
    raw = np.frombuffer(bytes.fromhex("".join(digests.str[:32])), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    step = raw[:, 1] | np.uint64(1)
    probe = np.arange(PROBES, dtype=np.uint64)
    return ((raw[:, :1] + probe * step[:, None]) & np.uint64(cells - 1)).astype(np.int64)


def _hits(cells: int):
    """Per task and segment: offsets of cells hit once or more, and of those hit again."""

    def run(batches):
        seen = np.zeros(0, np.int64)
        again = np.zeros(0, np.int64)
        for batch in batches:
            new, counts = np.unique(_cells(batch["digest"], cells).ravel(), return_counts=True)
            again = np.union1d(again, np.union1d(new[counts > 1], np.intersect1d(seen, new, assume_unique=True)))
            seen = np.union1d(seen, new)
        segments = np.unique(seen // SEGMENT)
        for segment in segments:
            low, high = segment * SEGMENT, (segment + 1) * SEGMENT
            part = [a[np.searchsorted(a, low) : np.searchsorted(a, high)] - low for a in (seen, again)]
            yield pd.DataFrame(
                {
                    "segment": [int(segment)],
                    "seen": [part[0].astype("<u2").tobytes()],
                    "again": [part[1].astype("<u2").tobytes()],
                }
            )

    return run


def _merge_segment(rows: pd.DataFrame) -> pd.DataFrame:
    """Bitmap of the cells of one segment that were hit again, in one task or in two."""
    hits = np.zeros(SEGMENT, np.uint8)
    for seen, again in zip(rows["seen"], rows["again"]):
        offsets = np.frombuffer(seen, "<u2")
        hits[offsets] = np.minimum(hits[offsets] + 1, 2)
        hits[np.frombuffer(again, "<u2")] = 2
    return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "bits": [np.packbits(hits > 1).tobytes()]})


def _repeat_filter(digests: DataFrame, cells: int) -> np.ndarray:
    merged = (
        digests.mapInPandas(_hits(cells), "segment bigint, seen binary, again binary")
        .groupBy("segment")
        .applyInPandas(_merge_segment, "segment bigint, bits binary")
    )
    bits = np.zeros((cells + 7) // 8, np.uint8)
    for row in merged.collect():  # at most cells / 8 bytes
        at = row["segment"] * SEGMENT // 8
        part = np.frombuffer(row["bits"], np.uint8)[: len(bits) - at]
        bits[at : at + len(part)] = part
    return bits


def _test(shared, cells: int):
    def run(batches):
        bits = shared.value
        for batch in batches:
            at = _cells(batch["digest"], cells)
            again = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            batch["again"] = again.all(axis=1)
            yield batch

    return run


def flag_possible_repeats(table: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """Add boolean ``again`` to a written table with a hex ``digest``: false only for single digests.

    The rows of one slice of the hash space are handled together; there is one slice as long as
    ``CELLS_PER_ROW`` cells per row fit into ``max_cells``.
    """
    rows = table.count()
    parts = max(1, math.ceil(rows * CELLS_PER_ROW / max_cells))
    cells = min(max_cells, max(SEGMENT, 1 << math.ceil(math.log2(max(1, rows * CELLS_PER_ROW / parts)))))
    schema = table.withColumn("again", F.lit(True)).schema
    out = []
    for part in range(parts):
        mine = table if parts == 1 else table.where(F.pmod(F.xxhash64("digest"), F.lit(parts)) == part)
        bits = _repeat_filter(mine.select("digest"), cells)
        shared = table.sparkSession.sparkContext.broadcast(bits)
        out.append(mine.mapInPandas(_test(shared, cells), schema))
    return reduce(DataFrame.unionAll, out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of white space became one space. The row with the
    smallest id stays; a null id comes last, and of rows that share the smallest id one stays. A null
    text is the empty text, which is a text like any other. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    id_type = docs.schema[id_col].dataType
    table = with_row(docs.select(id_text(id_col).alias("doc_id"), normal_digest(text_col).alias("digest")))
    flagged = cut_lineage(flag_possible_repeats(table, max_cells).withColumn("doc_id", F.col("doc_id").cast(id_type)))
    single = flagged.where(~F.col("again")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    maybe = flagged.where("again").select("doc_id", "_row", "digest")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    # written, so that the join below shuffles both sides and a hot digest can be split
    groups = cut_lineage(maybe.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")))
    grouped = maybe.join(groups, "digest").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("first._row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return single.unionAll(grouped)



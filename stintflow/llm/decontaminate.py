"""Benchmark decontamination as a prefix-filtered set join.

A window is a run of item words; as a set of word shingles it is contained in a document passage only
if its rarest shingle is. So each window is joined by that one necessary shingle (a prefix of length
one in order of rarity, counted over all documents), positions and lengths rule out windows that do
not fit into the document there, and what is left is compared word by word.

Documents are read twice: to count the benchmark's shingles, and to emit candidates. A fixed-size
bitmap of the wanted shingles, the only thing that is broadcast, keeps all other words in the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintflow.llm.common import KEY, id_text, key_of, text_of, with_key, with_row
from stintflow.llm.wordscan import Words, chunks, mix
from stintflow.session import cut_lineage

WINDOW = 10
SHINGLE = 3
BITMAP_BITS = 24
_WEIGHTS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)

# ASCII digits and letters, and every byte of a character beyond ASCII
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True


def _lowered(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass").lower() for t in texts]


def _shingles(scan: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which ``size`` words of one text begin, and the hashes of those runs."""
    hashes = scan.hashes()
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(scan.doc[:n] == scan.doc[size - 1 :])
    total = np.full(len(at), np.uint64(size))
    for k in range(size):
        total += hashes[at + k] * _WEIGHTS[k]
    return at, mix(total)


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _window_rows(batches):
    """Distinct windows of each item with their shingles in order."""
    for batch in batches:
        out = []
        for item, text in zip(batch["item_id"], _lowered(batch["text"])):
            scan = Words([text], INSIDE)
            n = len(scan.starts)
            length = min(WINDOW, n)
            if not n:
                continue
            size = min(SHINGLE, length)
            _, hashes = _shingles(scan, size)
            signed = hashes.view(np.int64)
            for start in range(n - length + 1):
                shingles = signed[start : start + length - size + 1]
                out.append((item, scan.words(start, start + length).decode("utf-8", "surrogatepass"), length, size, shingles.tolist()))
        yield pd.DataFrame(out, columns=["item_id", "window", "length", "size", "shingles"])


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """Bitmap over the leading bits of a long column ``shingle``; its size is fixed."""
    segment = 1 << 16

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(segment, np.uint8)
        bits[rows["bit"].to_numpy() % segment] = 1
        return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    bit = F.shiftrightunsigned(F.col("shingle"), 64 - BITMAP_BITS)
    marks = shingles.select(bit.alias("bit")).distinct().withColumn("segment", F.expr(f"bit div {segment}"))
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for row in marks.groupBy("segment").applyInPandas(merge, "segment bigint, bits binary").collect():
        at = row["segment"] * segment // 8
        out[at : at + segment // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _wanted(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _count_shingles(shared, sizes: list[int]):
    def run(batches):
        bits = shared.value
        for batch in batches:
            for _, texts in chunks(_lowered(batch["text"])):
                scan = Words(texts, INSIDE)
                for size in sizes:
                    _, hashes = _shingles(scan, size)
                    found, counts = np.unique(hashes[_wanted(bits, hashes)].view(np.int64), return_counts=True)
                    yield pd.DataFrame({"shingle": found, "n": counts})

    return run


CANDIDATES = "array<struct<shingle:bigint,at:bigint,low:bigint,near:string>>"


def _candidates(shared, sizes: list[int]):
    """Per document: its number of words, and the wanted shingles with the words around them."""

    def run(batches):
        bits = shared.value
        for batch in batches:
            lowered = _lowered(batch["text"])
            counts = np.zeros(len(batch), np.int64)
            found: list[list] = [[] for _ in lowered]
            for base, texts in chunks(lowered):
                scan = Words(texts, INSIDE)
                counts[base : base + len(texts)] = scan.count
                for size in sizes:
                    at, hashes = _shingles(scan, size)
                    keep = _wanted(bits, hashes)
                    for word, shingle in zip(at[keep], hashes[keep].view(np.int64)):
                        doc = scan.doc[word]
                        first, n = scan.first[doc], scan.count[doc]
                        low = max(first, word - WINDOW + size)
                        high = min(first + n, word + WINDOW)
                        near = scan.words(low, high).decode("utf-8", "surrogatepass")
                        found[base + doc].append((int(shingle), int(word - first), int(low - first), near))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "text_key": batch["text_key"],
                    "n_words": counts,
                    "found": [[dict(zip(("shingle", "at", "low", "near"), f)) for f in fs] for fs in found],
                }
            )

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, n_hit, n_items, items, contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` lists the items with an
    occurring window, as sorted strings; ``text_key`` is the xxhash64 of the text, to join back by.
    Null and empty texts have no words and no hits; an item without words has no window; an item id
    that is null is the empty string; rows of one item id are one item. Repeated documents get a row
    each. With an empty benchmark nothing is hit. Other columns are not read, whatever their names.
    """
    id_type = docs.schema[id_col].dataType
    texts = docs.select(id_text(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), text_of(item_text_col).alias("text")
    )
    windows = cut_lineage(
        items.mapInPandas(_window_rows, "item_id string, window string, length bigint, size bigint, shingles array<bigint>")
    )
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most SHINGLE values
    spark = docs.sparkSession

    every = _bitmap(windows.select(F.explode("shingles").alias("shingle")))
    counts = (
        texts.select("text")
        .mapInPandas(_count_shingles(spark.sparkContext.broadcast(every), sizes), "shingle bigint, n bigint")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
    )
    placed = (
        windows.dropDuplicates(["window"])
        .select("window", "length", F.posexplode("shingles").alias("offset", "shingle"))
        .join(counts, "shingle", "left")
    )
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset"))
    prefixes = cut_lineage(
        placed.groupBy("window", "length").agg(rarest.alias("r")).select("window", "length", "r.shingle", "r.offset")
    )

    wanted = _bitmap(prefixes.select("shingle"))
    scanned = with_row(
        texts.mapInPandas(
            _candidates(spark.sparkContext.broadcast(wanted), sizes),
            f"doc_id string, text_key bigint, n_words bigint, found {CANDIDATES}",
        ).withColumn("doc_id", F.col("doc_id").cast(id_type))
    )
    start = F.col("at") - F.col("offset")
    inside = F.array_join(F.slice(F.split("near", " "), (start - F.col("low") + 1).cast("int"), F.col("length").cast("int")), " ")
    hits = (
        scanned.where(F.size("found") > 0)
        .select("_row", "n_words", F.inline("found"))
        .join(prefixes, "shingle")
        .where((start >= F.col("low")) & (start + F.col("length") <= F.col("n_words")))
        .where(inside == F.col("window"))
        .select("_row", start.alias("start"), "length", "window")
    )
    hits = cut_lineage(hits.distinct())
    covered = hits.groupBy("_row").agg(F.collect_set(F.struct("start", "length")).alias("runs"))
    listed = (
        hits.select("_row", "window")
        .distinct()
        .join(windows.select("window", "item_id").distinct(), "window")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    positions = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1))))
    return (
        scanned.select("_row", "doc_id", "text_key", "n_words")
        .join(covered.select("_row", F.size(positions).cast("bigint").alias("n_hit")), "_row", "left")
        .join(listed, "_row", "left")
        .select(
            "doc_id",
            "text_key",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, all columns as they are."""
    found = decontaminate(docs, benchmark, id_col, text_col).where("contaminated")
    bad = cut_lineage(found.select(key_of(F.col("doc_id"), F.col("text_key")).alias(KEY)).distinct())
    return with_key(docs, id_col, text_col).join(bad, KEY, "left_anti").select(*docs.columns)

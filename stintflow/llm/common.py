"""What several operators share: word patterns, keyed tables, batch helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintflow.session import cut_lineage

# White space that separates words, as a Java or RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def id_text(column: str) -> Column:
    """An id as text for its way through pandas, where a null among whole numbers would make them floats."""
    return F.col(column).cast("string")


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """Write ``df`` with a number per row and go on from the table, so the number never changes."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def with_stored_order(df: DataFrame, part: str = "_part", file: str = "_file", at: str = "_at") -> DataFrame:
    """``df`` with columns that sort its rows as they are stored: partition and name of the file, row in it.

    Tables that Spark wrote name each file after the partition it holds. A table without files is sorted
    by its partitions and the rows in them.
    """
    try:
        stored = df.metadataColumn("_metadata")
        path = stored["file_path"]
        number = F.regexp_extract(path, r"part-(\d+)[^/]*$", 1)
        partition = F.when(number != "", number).cast("bigint")
        return df.select("*", partition.alias(part), path.alias(file), stored["row_index"].alias(at))
    except AnalysisException:
        row = F.monotonically_increasing_id()
        return df.select("*", F.lit(0).cast("bigint").alias(part), F.lit("").alias(file), row.alias(at))


def words(text: str) -> list[bytes]:
    """ASCII lower-cased words; ``bytes.split`` cuts at exactly the white space of ``SPACE``."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def remainder(column: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``; a null value counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def slices(batches: Iterable, size: int) -> Iterator:
    """Arrow or pandas batches cut to at most ``size`` rows."""
    for batch in batches:
        for at in range(0, len(batch), size):
            yield batch.iloc[at : at + size]


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + counts[i] - 1`` for every i, one after the other."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)


KEY = "_llm_key"


def key_of(id_column: Column, text_key: Column) -> Column:
    """One string for a document's id (null too) and the hash of its text, to bring decisions back to rows."""
    return F.concat_ws(":", F.coalesce(id_column.cast("string"), F.lit("null")), text_key.cast("string"))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.withColumn(KEY, key_of(F.col(id_col), F.xxhash64(text_of(text_col))))

"""The corpus pipeline: from raw documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the
next one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stintflow.llm.common import table, with_stored_order
from stintflow.llm.decontaminate import drop_contaminated
from stintflow.llm.mixing import mixed_documents
from stintflow.llm.near_copies import keep_one_similar
from stintflow.llm.quality import keep_good
from stintflow.llm.token_files import file_digests, write_token_files
from stintflow.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash of five-word shingles, similarity of at least 0.8."""
    return keep_one_similar(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in training order."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix, and what a reader finds in them: one row per document."""
    import public_tokenizers

    placed = with_stored_order(docs.select("doc_id", "text"), "part", "file", "at")
    folder = write_token_files(placed, public_tokenizers.path("byte_bpe_50k.json"), order=("part", "file", "at"))
    return file_digests(spark, folder)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("token files", tokens),
]
ORACLE_SQL = None  # a trained classifier decides


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

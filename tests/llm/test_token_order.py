"""Token files in another order than that of the ids, and the order in which a table is stored."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stintflow.llm import mixing, token_files
from stintflow.llm.common import with_stored_order

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ORDER = ("_part", "_file", "_at")


def corpus(spark):
    return spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("word "), F.col("id").cast("string"), F.repeat(F.lit(" w"), (F.col("id") % 9).cast("int"))).alias("text"),
        F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"),
    )


def in_files(spark, docs):
    folder = token_files.write_token_files(with_stored_order(docs), VOCABULARY, files=7, order=ORDER)
    return [r.doc_id for r in token_files.file_digests(spark, folder).orderBy("start").collect()]


def test_files_follow_the_mix(spark, tmp_path):
    mixed = mixing.mixed_documents(corpus(spark))
    mixed.write.parquet(str(tmp_path / "mixed"))
    plan = mixing.plan_mix(corpus(spark), cut=False).select("doc_id", "_row", F.inline("copies")).orderBy("position", "_row")
    want = [r.doc_id for r in plan.collect()]
    got = in_files(spark, spark.read.parquet(str(tmp_path / "mixed")))
    assert got == want and got != sorted(got)


def test_many_files_sort_by_number(spark, tmp_path):
    for number, low in ((99_999, 0), (100_000, 10), (7, 20)):
        corpus(spark).where(F.col("doc_id").between(low, low + 9)).coalesce(1).write.parquet(str(tmp_path / f"{number}"))
        (part,) = (tmp_path / f"{number}").glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"part-{number:05d}-x.parquet").write_bytes(part.read_bytes())
    got = in_files(spark, spark.read.parquet(str(tmp_path / "all")))
    assert got == [*range(20, 30), *range(10), *range(10, 20)]


@pytest.mark.parametrize("rows", [[], [(5, "b"), (None, None), (2, ""), (5, "b")]])
def test_tables_without_files(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert in_files(spark, docs) == [i for i, _ in rows]


def test_a_column_of_that_name_is_no_hindrance(spark, tmp_path):
    corpus(spark).limit(5).withColumn("_metadata", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "clash"))
    assert in_files(spark, spark.read.parquet(str(tmp_path / "clash"))) == [0, 1, 2, 3, 4]


def test_without_an_order_the_ids_decide(spark):
    folder = token_files.write_token_files(corpus(spark).orderBy(F.desc("doc_id")), VOCABULARY, files=3)
    assert [r.doc_id for r in token_files.file_digests(spark, folder).orderBy("start").collect()] == list(range(3000))

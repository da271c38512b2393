"""Readers and writers on landed files."""

import os

import pytest
from pyspark.sql import functions as F

from stintflow.functions import news, text
from stintflow.operators.joins import first_non_empty
from stintflow.session import cut_lineage, passing_tables, scratch_path
from stintflow.sources import documents, files


def test_season_filter_reads_only_its_directories(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_by_season(spark.range(100).withColumn("season", (F.col("id") % 4 + 2000).cast("int")), path)
    rows = spark.read.parquet(path).where("season = 2001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and rows.count() == 25


def test_column_pruning_reaches_the_scan(spark):
    df = files.scan_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 10")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan and "GreaterThan(l_quantity,10.0)" in plan


def test_union_skips_absent_supplement(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.range(3).write.parquet(path)
    assert files.union_present(spark, [path, str(tmp_path / "none")]).count() == 3
    with pytest.raises(FileNotFoundError):
        files.union_present(spark, [str(tmp_path / "none")])


def test_fallback_takes_first_source_with_rows(spark):
    empty = spark.range(0)
    assert [r.id for r in first_non_empty(empty, spark.range(2), spark.range(9)).select("id").collect()] == [0, 1]


def test_html_heading_carries_to_rows(spark):
    html = "<table><tr class='h'><th>Ann</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>"
    page = spark.createDataFrame([(1, html)], "id bigint, html string")
    rows = documents.carry_heading(documents.html_elements(page, "id", "html", ["th", "td"]), "id", "th").collect()
    assert [(r.heading, r.text) for r in rows] == [("Ann", "1"), ("Ann", "2")]


@pytest.mark.parametrize(
    "title,kind,score",
    [
        ("Club signs star to eight-year, $11.5M extension", "SIGNING", 2.0),
        ("Wing traded for first-round pick", "TRADE", 3.0),
        ("Coach fired after loss", "OTHER", 5.0),
        ("Should they trade him?", "TRADE", -3.0),
        ("Defender suspended", "SUSPENSION", 9.0),
    ],
)
def test_headline_rules(spark, title, kind, score):
    row = spark.createDataFrame([(title, "x")], "title string, link string").withColumn("kind", news.transaction_type("title"))
    got = row.select("kind", news.big_news_score("title", "link", "kind").alias("s")).first()
    assert (got.kind, got.s) == (kind, score)


def test_names(spark):
    row = spark.createDataFrame([("Müller, José",)], "n string").select(
        text.name_key(F.col("n")).alias("k"), text.slug(F.col("n")).alias("s"), text.flip_name(F.col("n")).alias("f")
    ).first()
    assert tuple(row) == ("mullerjose", "muller-jose", "José Müller")


def test_cleanest_variant(spark):
    rows = spark.createDataFrame([(1, "BÃ¤ck"), (1, "Bäck"), (2, "LÃ©gar")], "id bigint, name string")
    got = {r.id: r.name for r in text.cleanest_variant(rows, ["id"], "name").collect()}
    assert got == {1: "Bäck", 2: "Légar"}


def test_clock(spark):
    rows = spark.createDataFrame([("12:34",), ("bad",), (None,)], "c string")
    assert [r.s for r in rows.select(text.clock_to_secs(F.col("c")).alias("s")).collect()] == [754, 0, 0]


def test_scratch_paths_follow_the_session_setting(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_passing_tables_go_and_kept_ones_stay(spark):
    with passing_tables(spark) as scope:
        gone = cut_lineage(spark.range(3))
        kept = scope.keep(cut_lineage(gone.selectExpr("id + 1 AS id")))
        folders = [os.path.dirname(df.inputFiles()[0]).removeprefix("file:").replace("///", "/") for df in (gone, kept)]
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
    assert [os.path.isdir(f) for f in folders] == [False, True]

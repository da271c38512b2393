"""Aggregates, shares and reference-pool statistics used by many reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.scale import quantiles, with_group_stats, with_ordinal

# Recency weight per season start year and the weight of any other season.
SEASON_WEIGHTS = {
    2025: 1.00, 2024: 0.82, 2023: 0.67, 2022: 0.55, 2021: 0.42, 2020: 0.34 * (56 / 82),
    2019: 0.28 * (69.5 / 82), 2018: 0.23, 2017: 0.19, 2016: 0.15, 2015: 0.12, 2014: 0.10,
    2013: 0.07, 2012: 0.06 * (48 / 82), 2011: 0.05, 2010: 0.04,
}
DEFAULT_WEIGHT = 0.05


def map_with_default(key: Column, mapping: dict, default) -> Column:
    """Literal lookup with a default for unknown keys."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def season_weight(season: Column, weights: dict = SEASON_WEIGHTS, default: float = DEFAULT_WEIGHT) -> Column:
    return map_with_default(season.cast("int"), weights, default)


def per_60(value: Column, secs: Column) -> Column:
    return F.when(secs > 0, value / (secs / 3600.0)).otherwise(F.lit(0.0))


def share_pct(own: Column, other: Column, default=None) -> Column:
    return F.when(own + other > 0, F.lit(100.0) * own / (own + other)).otherwise(F.lit(default))


def weighted_mean(weight: Column, value: Column) -> Column:
    """Mean of ``value``; rows without a value count in neither sum."""
    return F.sum(weight * value) / F.sum(F.when(value.isNotNull(), weight))


def ordered_list(df: DataFrame, keys: list[str], label: str, order: str, sep: str = "/") -> DataFrame:
    """Labels of a key joined in descending ``order`` (then by label); one entry per label."""
    entry = F.struct((-F.col(order)).alias("o"), F.col(label).alias("l"))
    items = F.array_sort(F.collect_list(entry))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda e: e["l"].cast("string")), sep).alias("labels"))


def leave_one_out(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Value less the mean of the other rows of its key; null for a row on its own."""
    stats = with_group_stats(df, keys, [F.sum(value).alias("_s"), F.count(value).alias("_n")])
    others = F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1))
    return stats.withColumn(out, F.col(value) - others).drop("_s", "_n")


def pool_zscore(df: DataFrame, keys: list[str], value: str, in_pool: Column, out: str) -> DataFrame:
    """Z-score of every row against the pool's mean and population deviation; a flat pool gives 0."""
    member = F.when(in_pool, F.col(value))
    stats = with_group_stats(df, keys, [F.avg(member).alias("_mu"), F.stddev_pop(member).alias("_sd")])
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mu")) / F.col("_sd")).otherwise(F.lit(0.0))
    return stats.withColumn(out, z).drop("_mu", "_sd")


def simple_ols(df: DataFrame, keys: list[str], y: str, x: str, min_rows: int = 50) -> DataFrame:
    """Slope, intercept and R2 per group; short groups fall back to the mean of ``y``."""
    fit = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("r2"),
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
        F.avg(F.when(F.col(x).isNotNull(), F.col(y))).alias("m"),
    )
    enough = F.col("n") >= min_rows
    return fit.select(
        *keys,
        F.when(enough, F.col("s")).otherwise(0.0).alias("slope"),
        F.when(enough, F.col("i")).otherwise(F.col("m")).alias("intercept"),
        F.when(enough, F.col("r2")).otherwise(0.0).alias("r2"),
        "n",
    )


def rank_band(rank: Column) -> Column:
    return F.when(rank <= 30, "1-30").when(rank <= 100, "31-100").when(rank <= 300, "101-300").otherwise("301+")


def tier_blocks(df: DataFrame, value: str, tiebreak: str, predicted: str, actual: str) -> DataFrame:
    """Mean predicted and actual per rank band."""
    ranked = with_ordinal(df, [], value, tiebreak, "_rk", descending=True)
    return ranked.groupBy(rank_band(F.col("_rk")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(predicted).alias("predicted"), F.avg(actual).alias("actual")
    )


def calibration_by_quantile(df: DataFrame, predicted: str, actual: str, bins: int = 10) -> DataFrame:
    """Mean predicted and actual per quantile bin; edges interpolate and bins are right-closed."""
    edges = quantiles(df, [], predicted, {f"q{i}": i / bins for i in range(1, bins)})
    row = edges.select(F.array(*edges.columns).alias("e")).scalar()
    placed = df.withColumn("_edges", row).withColumn(
        "bin", F.size(F.filter(F.array_distinct("_edges"), lambda e: e < F.col(predicted)))
    )
    return placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(predicted).alias("predicted"), F.avg(actual).alias("actual")
    )


def calibration_by_category(df: DataFrame, category: str, predicted: str, actual: str) -> DataFrame:
    """Actual over predicted per category, with the ratio gate for categories that are large enough."""
    g = df.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), F.sum(predicted).alias("predicted"), F.sum(actual).alias("actual")
    )
    ratio = F.when(F.col("predicted") > 0, F.col("actual") / F.col("predicted"))
    gate = (F.col("actual") < 150) | ratio.isNull() | ratio.between(0.90, 1.10)
    return g.withColumn("ratio", ratio).withColumn("gate_ok", gate)

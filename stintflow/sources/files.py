"""Tabular files: scans, unions, partitioned tables, resumable landing, sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, text_cols: list[str], numeric_cols: list[str]) -> DataFrame:
    """CSV with permissive numbers: bad text becomes 0 and a numeric column the file lacks is 0.

    Columns go by the name in the header, in whatever order; everything is read as text, so only the first
    line is read beforehand. A file of the folder whose header differs is an error.
    """
    header = spark.read.option("header", True).csv(path).schema
    raw = spark.read.schema(header).option("header", True).option("enforceSchema", False).csv(path)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in raw.columns else F.lit(0.0)
    clean = lambda c: F.when(F.isnan(number(c)), 0.0).otherwise(number(c)).alias(c)
    return raw.select(*text_cols, *[clean(c) for c in numeric_cols])


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def union_present(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of the files that exist; supplements may be absent or lack columns."""
    frames = [f for f in (read_if_present(spark, p) for p in paths) if f is not None]
    if not frames:
        raise FileNotFoundError(f"none of {paths} exists")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_by_season(df: DataFrame, path: str, season: str = "season") -> None:
    """One directory per season, rows of a season spread over several writers by AQE's rebalancing."""
    df.hint("rebalance", season).write.mode("overwrite").partitionBy(season).parquet(path)


def land_new(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not landed yet (nor been marked empty)."""
    return rows.join(manifest.select(key).distinct(), key, "left_anti")


def read_written(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    """The rows of :func:`write_with_meta`."""
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(f"{path}/data")


def write_with_meta(df: DataFrame, path: str, fmt: str, meta: dict[str, Column]) -> None:
    """Write rows plus a one-row JSON side table of aggregates."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(f"{path}/data")
    df.agg(*[c.alias(n) for n, c in meta.items()]).write.mode("overwrite").json(f"{path}/meta")


def game_universe(seasons: DataFrame, season: str) -> DataFrame:
    """All possible game ids per season: 1312 regular games and the playoff grid of rounds, series and games."""
    regular = F.transform(F.sequence(F.lit(1), F.lit(1312)), lambda n: (20000 + n).cast("bigint"))
    # fixed values: series per round
    grid = [30000 + rnd * 100 + m * 10 + g for rnd, n in ((1, 8), (2, 4), (3, 2), (4, 1)) for m in range(1, n + 1) for g in range(1, 8)]
    tails = F.concat(regular, F.array(*[F.lit(x).cast("bigint") for x in grid]))
    return seasons.select(season, F.explode(tails).alias("_t")).select(season, (F.col(season) * 1000000 + F.col("_t")).alias("game_id"))

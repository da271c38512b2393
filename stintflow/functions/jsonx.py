"""Reading values out of JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(doc: str, path: str, kind: str, default) -> Column:
    return F.coalesce(F.get_json_object(F.col(doc), path).try_cast(kind), F.lit(default))


def text_or_default(doc: Column, field: str) -> Column:
    """A field that is either a plain string or an object with a ``default`` entry."""
    return F.coalesce(F.get_json_object(doc, f"$.{field}.default"), F.get_json_object(doc, f"$.{field}"))


def flatten_nested(df: DataFrame, doc: str, schema: str, key: str, inner: str) -> DataFrame:
    """An array of objects that each hold an array: one row per inner element with the outer fields carried."""
    outer = df.select(key, F.explode(F.from_json(doc, schema)).alias("o")).select(key, "o.*")
    carried = [c for c in outer.columns if c != inner]
    return outer.select(*carried, F.explode(inner).alias("i")).select(*carried, "i.*")


def items(doc: str, path: str) -> Column:
    """The array at ``path`` of a variant column, element by element whatever their shape; none where there is no array."""
    return F.coalesce(F.try_variant_get(F.col(doc), path, "array<variant>"), F.array().cast("array<variant>"))


def plain_or_default(value: Column, field: str) -> Column:
    """A field of a variant that is a plain string in some documents and an object with ``default`` in others."""
    return F.coalesce(F.try_variant_get(value, f"$.{field}.default", "string"), F.try_variant_get(value, f"$.{field}", "string"))


def three_stars(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """One row per star of a game summary: its place, name and team."""
    stars = docs.select(key, F.explode(items(doc, "$.summary.threeStars")).alias("s"))
    return stars.select(
        key, F.try_variant_get("s", "$.star", "bigint").alias("star"), plain_or_default(F.col("s"), "name").alias("name"),
        plain_or_default(F.col("s"), "team").alias("team"),
    )


def starters(docs: DataFrame, key: str, doc: str, sides: tuple[str, ...] = ("away", "home")) -> DataFrame:
    """Per game and side the first goalie marked as starter, with saves; nulls where none is marked."""
    is_starter = lambda g: F.coalesce(F.try_variant_get(g, "$.starter", "boolean"), F.lit(False))
    first = lambda side: F.get(F.filter(items(doc, f"$.boxscore.{side}.goalies"), is_starter), F.lit(0))
    rows = docs.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), first(s).alias("_goalie")) for s in sides])).alias("x")).select(key, "x.*")
    return rows.select(
        key, "side", plain_or_default(F.col("_goalie"), "name").alias("name"), F.try_variant_get("_goalie", "$.saves", "bigint").alias("saves")
    )

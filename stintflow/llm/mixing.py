"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target number of words. Its documents, in a fixed random order and repeated as
often as needed, form a stream that is taken up to the target. The weight schedule of a source says
how dense its stream lies along the training run: the integral of the schedule is the share of the
target that is used up at a time, and its inverse gives each copy of a document its position.

Prefix sums run per (source, slice of the random order), with one summary row carried per slice, so a
source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintflow.llm.common import WORD, text_of, with_row
from stintflow.scale import START, Running, running
from stintflow.session import cut_lineage

WEIGHTS = (1, 2, 3)
# (time, weight) knots, dealt to the sources in turn like the weights: even, rising, falling
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _dealt(values: tuple, rank: Column, make) -> Column:
    """The value whose turn it is: values repeat along the rank."""
    turn = F.pmod(rank, F.lit(len(values)))
    column = make(values[0])
    for i, value in enumerate(values[1:], start=1):
        column = F.when(turn == i, make(value)).otherwise(column)
    return column


def _segments(knots: tuple) -> Column:
    """Linear pieces of a schedule: begin, weight there, slope, and the area before."""
    pieces, area = [], 0.0
    for (x0, w0), (x1, w1) in zip(knots, knots[1:]):
        pieces.append(F.struct(*[F.lit(float(v)).alias(n) for n, v in (("x", x0), ("w", w0), ("slope", (w1 - w0) / (x1 - x0)), ("area", area))]))
        area += (w0 + w1) / 2 * (x1 - x0)
    return F.struct(F.array(*pieces).alias("pieces"), F.lit(area).alias("total"))


def _time_of(share: Column, schedule: Column) -> Column:
    """The time at which ``share`` of the schedule's integral is used up."""
    area = share * schedule["total"]
    piece = F.element_at(F.filter(schedule["pieces"], lambda p: p["area"] <= area), -1)
    rest = area - piece["area"]
    root = F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["slope"] * rest, F.lit(0.0)))
    step = F.when(rest > 0, 2 * rest / (piece["w"] + root)).otherwise(F.lit(0.0))
    return piece["x"] + step


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: ``slot, source, source_size, target, schedule``; one row per source is all it holds.

    Sources rank by code point, null last. The words of all documents are shared by weight; a target
    stops at ``repeats`` times its source and the excess goes to the others. In order of capacity per
    weight the common level rises while sources fill up and falls afterwards, so it is the highest
    level met on the way.
    """
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("slot", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    )
    full = F.col("source_size") * repeats
    weighed = ranked.withColumn("weight", _dealt(weights, F.col("slot"), lambda w: F.lit(float(w))))
    by_fill = Window.orderBy(full / F.col("weight"), "slot")
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(full).over(by_fill.rowsBetween(START, -1)), F.lit(0))
    levels = weighed.withColumn("level", left / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max("level").over(Window.partitionBy())
    return levels.select(
        "slot",
        "source",
        "source_size",
        F.least(full.cast("double"), F.col("weight") * level).alias("target"),
        _dealt(schedules, F.col("slot"), _segments).alias("schedule"),
    )


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
    cut: bool = True,
    weights: tuple = WEIGHTS,
    schedules: tuple = SCHEDULES,
    repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per document: ``_row, doc_id, size, source_size, target, taken, copies`` and the columns of ``keep``.

    ``copies`` holds a struct ``copy, words, position`` for each time the mix takes the document;
    ``position`` is the time in the run, 0 to 1. With ``cut`` the last copy of a source is cut at a
    word so that the target is met exactly; without it copies are whole, and the last one is taken if
    at least half of it fits. Null and empty texts have size 0 and are never taken; null sources form
    one source; a source without words gets target 0. Repeated documents count each. An empty table
    gives no rows.
    """
    names = {c: f"_keep_{i}" for i, c in enumerate(keep)}
    table = with_row(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(text_of(text_col)).alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("draw"),
            *[F.col(c).alias(n) for c, n in names.items()],
        )
    )
    narrow = table.select("_row", "doc_id", "source", "size", "draw")
    targets = cut_lineage(source_targets(narrow, weights, schedules, repeats))
    placed = narrow.join(targets, narrow["source"].eqNullSafe(targets["source"])).select(
        "_row", "doc_id", "size", "draw", "slot", "source_size", "target", "schedule"
    )
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = max(1, math.ceil(math.log(4 * partitions, 16)))
    ordered = running(placed, ["slot"], F.substring("draw", 1, digits), ["draw", "_row"], {"before": Running("sum", F.col("size"))})

    goal = F.floor(F.col("target") + 0.5)
    copies = []
    for copy in range(repeats):
        begin = F.coalesce("before", F.lit(0)) + copy * F.col("source_size")
        room = F.greatest(F.least(goal - begin, F.col("size")), F.lit(0))
        words = room if cut else F.when((room * 2 >= F.col("size")) & (room > 0), F.col("size")).otherwise(F.lit(0))
        at = F.when(words > 0, _time_of(F.least(begin / goal, F.lit(1.0)), F.col("schedule")))
        copies.append(F.struct(F.lit(copy).alias("copy"), words.cast("bigint").alias("words"), at.alias("position")))
    mixed = ordered.select(
        "_row",
        "doc_id",
        "size",
        "source_size",
        "target",
        F.filter(F.array(*copies), lambda c: c["words"] > 0).alias("copies"),
    ).withColumn("taken", F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]))
    if not keep:
        return mixed
    return mixed.join(table.select("_row", *[F.col(n).alias(c) for c, n in names.items()]), "_row")


def training_order(mix: DataFrame) -> DataFrame:
    """The mix as documents in training order: one row per copy, range-sorted by its position."""
    rows = mix.select(*[c for c in mix.columns if c != "copies"], F.inline("copies"))
    return rows.repartitionByRange(F.col("position"), F.col("_row")).sortWithinPartitions("position", "_row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Whole documents in training order, repeated as often as the mix takes them, all columns as they are."""
    names = {c: f"_mixed_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    mix = plan_mix(renamed, names[id_col], names[text_col], names[source_col], keep=tuple(names.values()), cut=False)
    return training_order(mix).select(*[F.col(n).alias(c) for c, n in names.items()])

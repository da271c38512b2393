"""Building blocks that keep one hot key from landing in one task.

A window over ``PARTITION BY key`` sorts the whole key inside a single task. The helpers here split
a key into ordered chunks first, run the window per ``(key, chunk)``, and carry a one-row summary of
every chunk to the chunks after it, so the largest task holds one chunk and not one key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintflow.session import cut_lineage

START = Window.unboundedPreceding


@dataclass(frozen=True)
class Running:
    """One running value: ``sum``, ``max`` or ``last`` (newest non-null) of ``value``.

    ``inclusive`` counts the current row; otherwise only the rows before it.
    """

    kind: str
    value: Column
    inclusive: bool = False


def _over(kind: str, col: Column, window) -> Column:
    if kind == "sum":
        return F.sum(col).over(window)
    if kind == "max":
        return F.max(col).over(window)
    return F.last(col, ignorenulls=True).over(window)


def _summary(kind: str, col: Column, order: list[str]) -> Column:
    if kind == "sum":
        return F.sum(col)
    if kind == "max":
        return F.max(col)
    return F.max_by(col, F.when(col.isNotNull(), F.struct(*order)))


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    if kind == "max":
        return F.greatest(carried, local)
    return F.coalesce(local, carried)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null meets null; the right side adds its other columns."""
    names = {c: f"_r_{c}" for c in keys}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    if not keys:
        raise ValueError("keys are needed")
    cond = None
    for c, other in names.items():
        same = left[c].eqNullSafe(renamed[other])
        cond = same if cond is None else cond & same
    return left.join(renamed, cond, how).drop(*names.values())


def running(
    df: DataFrame, keys: list[str], chunk: Column, order: list[str], specs: dict[str, Running]
) -> DataFrame:
    """Add running values over ``order`` within ``keys``; ``chunk`` must not decrease along ``order``.

    A null key is a key like any other.
    """
    src = df.withColumn("_chunk", chunk)
    for name, spec in specs.items():
        src = src.withColumn(f"_v_{name}", spec.value)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    inside = src.select(
        "*",
        *[
            _over(s.kind, F.col(f"_v_{n}"), local.rowsBetween(START, 0 if s.inclusive else -1)).alias(f"_l_{n}")
            for n, s in specs.items()
        ],
    )
    chunks = src.groupBy(*keys, "_chunk").agg(
        *[_summary(s.kind, F.col(f"_v_{n}"), order).alias(f"_s_{n}") for n, s in specs.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(START, -1)
    carry = chunks.select(
        *keys,
        "_chunk",
        *[_over(s.kind, F.col(f"_s_{n}"), earlier).alias(f"_c_{n}") for n, s in specs.items()],
    )
    joined = join_null_safe(inside, carry, [*keys, "_chunk"])
    return joined.select(
        *df.columns,
        *[_combine(s.kind, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, s in specs.items()],
    )


def range_placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` written in ``order``, dealt to as many ranges as there are shuffle partitions.

    ``_part`` numbers the ranges and ``_at`` the rows inside one. Any type that sorts will do, and a hot
    key is cut wherever the rest of the order differs.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return cut_lineage(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", row))


def positions(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """All rows with their 1-based place in a complete ordering; only one row per range meets in one task."""
    placed = range_placed(df, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(START, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(out))


def _ranked(df: DataFrame, keys: list[str], values: list[str], descending: bool = False) -> DataFrame:
    """One row per ``(keys, values)``: ``n`` rows share it, ``before`` rows of the key precede it.

    Equal values are counted first, so ties never travel as rows. ``descending`` turns the first value.
    """
    known = df.where(F.col(values[0]).isNotNull()).groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("n"))
    first = F.col(values[0]).desc() if descending else F.col(values[0]).asc()
    placed = range_placed(known, [*[F.col(k) for k in keys], first, *[F.col(v) for v in values[1:]]])
    ranked = running(placed, keys, F.col("_part"), ["_at"], {"before": Running("sum", F.col("n"))})
    return ranked.select(*keys, *values, "n", F.coalesce("before", F.lit(0)).alias("before"))


def value_ranks(df: DataFrame, keys: list[str], value: str, descending: bool = False) -> DataFrame:
    """One row per ``(keys, value)``: ``n`` rows share it, ``before`` rows precede it, ``total`` in the group."""
    ranked = _ranked(df, keys, [value], descending)
    if not keys:
        return ranked.withColumn("total", ranked.agg(F.sum("n").alias("t")).scalar())
    return join_null_safe(ranked, ranked.groupBy(*keys).agg(F.sum("n").alias("total")), keys)


def _rank_of(ties: str) -> Column:
    average = F.col("before") + (F.col("n") + 1) / 2
    return {"min": F.col("before") + 1, "average": average, "pct": average / F.col("total")}[ties]


def with_rank(
    df: DataFrame, keys: list[str], value: str, out: str, ties: str = "min", descending: bool = False
) -> DataFrame:
    """Add a rank with ties by ``min``, ``average`` or ``pct`` (average rank / group size); null stays null."""
    ranks = value_ranks(df, keys, value, descending)
    return join_null_safe(df, ranks.select(*keys, value, _rank_of(ties).alias(out)), [*keys, value])


def with_ranks(df: DataFrame, keys: list[str], values: dict[str, str], ties: str = "min", descending: bool = False) -> DataFrame:
    """Add one rank per entry of ``values`` (out -> value); the input is evaluated once."""
    base = cut_lineage(df)
    out = base
    for name, value in values.items():
        ranks = value_ranks(base, keys, value, descending).select(*keys, value, _rank_of(ties).alias(name))
        out = join_null_safe(out, ranks, [*keys, value])
    return out


def with_ordinal(
    df: DataFrame, keys: list[str], value: str | None, tiebreak: str, out: str, descending: bool = False
) -> DataFrame:
    """Add a 1-based position, ordered by ``value`` and then the unique ``tiebreak`` ascending."""
    values = [tiebreak] if value is None else [value, tiebreak]
    places = _ranked(df, keys, values, descending and value is not None)
    return join_null_safe(df, places.select(*keys, *values, (F.col("before") + 1).alias(out)), [*keys, *values])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group without holding a group in one buffer."""
    ranks = value_ranks(df, keys, value).where(F.col("total").isNotNull())
    aggs = []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        for suffix, index in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            holds = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{suffix}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_f"))
    picked = ranks.groupBy(*keys).agg(*aggs) if keys else ranks.agg(*aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"_{n}_lo") + F.col(f"_{n}_f") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n)
            for n in probs
        ],
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rn") -> DataFrame:
    """Top ``k`` rows per group; Spark prunes to ``k`` per map task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def with_group_stats(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Attach per-group aggregates by a join of pre-aggregated rows, not by a window over the group."""
    if not keys:
        row = df.agg(F.struct(*aggs).alias("s")).scalar()
        return df.withColumn("_row", row).select(*df.columns, "_row.*")
    return df.join(df.groupBy(*keys).agg(*aggs), keys, "left")

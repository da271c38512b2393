"""Joins and measures over overlapping time intervals.

Every range join is an equi join on ``(key, time bin)`` plus the exact range test: the interval is
repeated for the bins it covers, a point lies in one bin. A key that holds a large share of the rows
is thereby cut along its own time line. Closedness is always named by the caller:
``right`` is ``start < t <= end``, ``left`` is ``start <= t < end``, ``both`` is ``start <= t <= end``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintflow.scale import Running, running
from stintflow.session import cut_lineage

CHUNK = 300  # seconds of one running-window chunk: a key is cut into that many pieces of its clock

_LOW = {"right": 1, "left": 0, "both": 0}
_HIGH = {"right": 0, "left": -1, "both": 0}


def bin_of(t: Column, width: int) -> Column:
    return F.floor(t / width)


def spread_over_bins(intervals: DataFrame, start: str, end: str, width: int, closed: str) -> DataFrame:
    """Repeat every interval for each bin it touches; empty intervals vanish."""
    low = bin_of(F.col(start) + _LOW[closed], width)
    high = bin_of(F.col(end) + _HIGH[closed], width)
    return intervals.withColumn("_bin", F.explode(F.when(low <= high, F.sequence(low, high))))


def covers(start: Column, end: Column, t: Column, closed: str) -> Column:
    return {
        "right": (start < t) & (t <= end),
        "left": (start <= t) & (t < end),
        "both": (start <= t) & (t <= end),
    }[closed]


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    t: str,
    start: str,
    end: str,
    closed: str,
    width: int,
    how: str = "inner",
) -> DataFrame:
    """All (point, covering interval) rows; non-key columns of the two sides must not clash."""
    left = points.withColumn("_bin", bin_of(F.col(t), width)).alias("p")
    right = spread_over_bins(intervals, start, end, width, closed).alias("i")
    cond = F.col("p._bin") == F.col("i._bin")
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    cond = cond & covers(F.col(f"i.{start}"), F.col(f"i.{end}"), F.col(f"p.{t}"), closed)
    keep = [F.col(f"p.{c}") for c in points.columns] + [
        F.col(f"i.{c}") for c in intervals.columns if c not in keys
    ]
    return left.join(right, cond, how).select(*keep)


def nearest_within(
    points: DataFrame, others: DataFrame, keys: list[str], t: str, other_t: str, tolerance: int
) -> DataFrame:
    """The closest other row within ``tolerance`` per point (then the earlier one); null when none.

    Equal points are matched once and all come back.
    """
    columns = points.columns
    points = points.groupBy(*columns).agg(F.count(F.lit(1)).alias("_times"))
    reach = others.withColumn("_from", F.col(other_t) - tolerance).withColumn("_to", F.col(other_t) + tolerance)
    pairs = points_in_intervals(points, reach, keys, t, "_from", "_to", "both", max(4 * tolerance, 60), "left")
    other_cols = [c for c in others.columns if c not in keys]
    best = F.min_by(
        F.struct(*other_cols),
        F.when(F.col(other_t).isNotNull(), F.struct(F.abs(F.col(t) - F.col(other_t)), F.col(other_t))),
    )
    found = pairs.groupBy(*points.columns).agg(best.alias("_m"))
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))).alias("_copy")
    return found.select(*columns, "_m", times).select(*columns, "_m.*")


def long_presence_members(
    intervals: DataFrame, keys: list[str], member: str, dur: str, threshold: float
) -> DataFrame:
    """Members whose mean interval length passes the threshold in at least one key."""
    means = intervals.groupBy(*keys, member).agg(F.avg(dur).alias("_mean"))
    return means.where(F.col("_mean") > threshold).select(member).distinct()


def _with_reach(intervals: DataFrame, keys: list[str], start: str, end: str, tie: list[str], width: int) -> DataFrame:
    """Add ``_reach``: the furthest end among the key's earlier intervals."""
    return running(
        intervals, keys, bin_of(F.col(start), width), [start, *tie], {"_reach": Running("max", F.col(end))}
    )


def union_time(intervals: DataFrame, keys: list[str], start: str, end: str, width: int = CHUNK) -> DataFrame:
    """Length of the union of each key's intervals."""
    rows = _with_reach(intervals, keys, start, end, [end], width)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce("_reach", F.col(start))))
    return rows.groupBy(*keys).agg(F.sum(fresh).alias("union_secs"))


def drop_contained(intervals: DataFrame, keys: list[str], start: str, end: str, width: int = CHUNK) -> DataFrame:
    """Remove intervals that lie inside another of the same key.

    Coverage and the longest covering interval of every instant stay as they are, while one key keeps
    at most one interval per start second, however many rows it arrived with.
    """
    longest = intervals.groupBy(*keys, start).agg(F.max(end).alias(end))
    rows = _with_reach(longest, keys, start, end, [], width)
    return rows.where(F.col("_reach").isNull() | (F.col(end) > F.col("_reach"))).drop("_reach")


def self_overlap_rows(
    intervals: DataFrame, keys: list[str], start: str, end: str, row_id: str, width: int = CHUNK
) -> DataFrame:
    """Rows that overlap another row of the same key: an earlier one reaches in, or the next starts inside."""
    live = intervals.where(F.col(end) > F.col(start))
    fwd = _with_reach(live, keys, start, end, [row_id], width)
    negated = fwd.withColumn("_neg", -F.col(start)).withColumn("_negid", -F.col(row_id))
    # walking backwards, the newest start seen is the next interval's start
    both = running(
        negated, keys, bin_of(F.col("_neg"), width), ["_neg", "_negid"], {"_next": Running("last", F.col(start))}
    )
    hit = (F.col("_reach") > F.col(start)) | (F.col("_next") < F.col(end))
    return both.where(hit).select(*intervals.columns)


def presence_steps(intervals: DataFrame, keys: list[str], start: str, end: str, width: int = CHUNK) -> DataFrame:
    """Step function per key: ``(lo, hi, cnt)`` pieces with the number of open intervals, gaps left out."""
    delta = (
        intervals.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.col(start).alias("t"), F.lit(1).alias("d")),
                    F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")),
                )
            ).alias("_e"),
        )
        .groupBy(*keys, F.col("_e.t").alias("t"))
        .agg(F.sum("_e.d").alias("d"))
    )
    open_count = running(
        delta, keys, bin_of(F.col("t"), width), ["t"], {"cnt": Running("sum", F.col("d"), inclusive=True)}
    )
    step = open_count.withColumn("_neg", -F.col("t"))
    nxt = running(step, keys, bin_of(F.col("_neg"), width), ["_neg"], {"hi": Running("last", F.col("t"))})
    return nxt.where((F.col("cnt") > 0) & F.col("hi").isNotNull()).select(*keys, F.col("t").alias("lo"), "hi", "cnt")


def _pieces(intervals: DataFrame, keys: list[str], member: str, side: str, start: str, end: str, width: int) -> DataFrame:
    """How often a member is there, ``cnt``, from ``lo`` to ``hi``, cut at the edges of time bins."""
    steps = presence_steps(intervals, [*keys, member, side], start, end)
    return (
        spread_over_bins(steps, "lo", "hi", width, "left")
        .withColumn("lo", F.greatest("lo", F.col("_bin") * width))
        .withColumn("hi", F.least("hi", (F.col("_bin") + 1) * width))
    )


def overlap_pair_seconds(
    intervals: DataFrame, keys: list[str], member: str, side: str, start: str, end: str, width: int = 3600
) -> DataFrame:
    """Shared seconds of every two members present together, summed over keys.

    A member's intervals become one step function first, so many rows of one member count once with a
    weight; the pieces are then clipped to time bins and met inside them.
    """
    clipped = _pieces(intervals, keys, member, side, start, end, width)
    a, b = clipped.alias("a"), clipped.alias("b")
    cond = F.col("a._bin") == F.col("b._bin")
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cond = (
        cond
        & (F.col(f"a.{member}") < F.col(f"b.{member}"))
        & (F.col("a.lo") < F.col("b.hi"))
        & (F.col("b.lo") < F.col("a.hi"))
    )
    secs = (F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")) * F.col("a.cnt") * F.col("b.cnt")
    met = (
        a.join(b, cond)
        .groupBy(
            F.col(f"a.{member}").alias("low"),
            F.col(f"b.{member}").alias("high"),
            (F.col(f"a.{side}") == F.col(f"b.{side}")).alias("same_side"),
        )
        .agg(F.sum(secs).alias("shared_secs"))
    )
    # both directions only after the sums
    way = lambda one, other: F.struct(F.col(one).alias("focal"), F.col(other).alias("partner"))
    both = F.inline(F.array(way("low", "high"), way("high", "low")))
    return met.select("same_side", "shared_secs", both).select("focal", "partner", "same_side", "shared_secs")


def top_partners(
    intervals: DataFrame, keys: list[str], member: str, side: str, start: str, end: str, width: int = 3600
) -> DataFrame:
    """``focal, partner, shared_secs``: the member of the same side each one shares most time with, ties to the lower.

    Of two members in one time bin, the time shared is at most the time of either, times how often the other is there
    at once. These bounds take a row per member and bin. The candidate with the greatest bound is summed exactly; then
    only those whose bound reaches that sum are. All other pairs are never laid beside each other.
    """
    pieces = cut_lineage(_pieces(intervals, keys, member, side, start, end, width))
    place = [*keys, side, "_bin"]
    totals = pieces.groupBy(*place, member).agg(F.sum(F.col("cnt") * (F.col("hi") - F.col("lo"))).alias("secs"), F.max("cnt").alias("peak"))
    one, two = (totals.select(*place, *[F.col(c).alias(f"{c}_{x}") for c in (member, "secs", "peak")]) for x in "ab")
    most = F.least(F.col("secs_a") * F.col("peak_b"), F.col("secs_b") * F.col("peak_a"))
    met = one.join(two, place).where(F.col(f"{member}_a") < F.col(f"{member}_b")).groupBy(
        F.col(f"{member}_a").alias("low"), F.col(f"{member}_b").alias("high")
    ).agg(F.sum(most).alias("bound"))
    way = lambda a, b: F.struct(F.col(a).alias("focal"), F.col(b).alias("partner"))
    bounds = cut_lineage(met.select("low", "high", "bound", F.inline(F.array(way("low", "high"), way("high", "low")))))
    best = F.max_by(F.struct("low", "high", "partner"), F.struct(F.col("bound"), -F.col("partner"))).alias("b")
    first = cut_lineage(bounds.groupBy("focal").agg(best).select("focal", "b.*"))

    def summed(pairs: DataFrame) -> DataFrame:
        left = pieces.select(*place, *[F.col(c).alias(f"{c}_a") for c in (member, "lo", "hi", "cnt")])
        right = pieces.select(*place, *[F.col(c).alias(f"{c}_b") for c in (member, "lo", "hi", "cnt")])
        near = pairs.select(F.col("low").alias(f"{member}_a"), F.col("high").alias(f"{member}_b")).distinct()
        laid = near.join(left, f"{member}_a").join(right, [*place, f"{member}_b"])
        secs = F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b")
        return laid.where("lo_a < hi_b AND lo_b < hi_a").groupBy(F.col(f"{member}_a").alias("low"), F.col(f"{member}_b").alias("high")).agg(
            F.sum(secs * F.col("cnt_a") * F.col("cnt_b")).alias("shared_secs")
        )

    known = cut_lineage(summed(first))
    floor = first.join(known, ["low", "high"], "left").select("focal", F.coalesce("shared_secs", F.lit(0)).alias("least"))
    contend = cut_lineage(bounds.join(floor, "focal").where("bound >= least"))
    rest = summed(contend.join(known, ["low", "high"], "left_anti"))
    exact = contend.join(cut_lineage(known.unionByName(rest)), ["low", "high"])
    top = F.max_by(F.struct("partner", "shared_secs"), F.struct(F.col("shared_secs"), -F.col("partner"))).alias("t")
    return exact.groupBy("focal").agg(top).select("focal", "t.*")


def elementary_segments(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Consecutive boundary pairs ``(t0, t1)`` per key; distinct boundaries bound a key by its clock."""
    bounds = intervals.select(*keys, F.explode(F.array(start, end)).alias("t0")).distinct()
    window = Window.partitionBy(*keys).orderBy("t0")
    return bounds.withColumn("t1", F.lead("t0").over(window)).where(F.col("t1").isNotNull())


def overlap_weighted_quality(
    intervals: DataFrame,
    ratings: DataFrame,
    keys: list[str],
    member: str,
    side: str,
    start: str,
    end: str,
    width: int = 3600,
) -> DataFrame:
    """Average rating of team mates and opponents weighted by shared seconds, without forming pairs.

    On each elementary segment the weighted sums per side are known once; a member's share is the
    side's sum less the member's own part. ``ratings`` has ``member`` and ``rating``; members without
    a rating count on neither side of the fraction.
    """
    segments = elementary_segments(intervals, keys, start, end)
    steps = presence_steps(intervals, [*keys, member, side], start, end)
    present = points_in_intervals(segments, steps, keys, "t0", "lo", "hi", "left", width)
    rated = present.join(ratings.select(member, "rating"), member, "left").select(
        *keys,
        "t0",
        (F.col("t1") - F.col("t0")).alias("len"),
        member,
        side,
        "cnt",
        F.when(F.col("rating").isNotNull(), F.col("cnt")).otherwise(0).alias("own_w"),
        F.coalesce(F.col("cnt") * F.col("rating"), F.lit(0)).alias("own_r"),
    )
    per_side = rated.groupBy(*keys, "t0", side).agg(F.sum("own_w").alias("side_w"), F.sum("own_r").alias("side_r"))
    per_all = per_side.groupBy(*keys, "t0").agg(F.sum("side_w").alias("all_w"), F.sum("side_r").alias("all_r"))
    rows = rated.join(per_side, [*keys, "t0", side]).join(per_all, [*keys, "t0"])
    scale = F.col("len") * F.col("cnt")
    return rows.groupBy(member).agg(
        F.sum(scale * (F.col("side_r") - F.col("own_r"))).alias("mate_r"),
        F.sum(scale * (F.col("side_w") - F.col("own_w"))).alias("mate_w"),
        F.sum(scale * (F.col("all_r") - F.col("side_r"))).alias("opp_r"),
        F.sum(scale * (F.col("all_w") - F.col("side_w"))).alias("opp_w"),
    )

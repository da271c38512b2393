"""Weighted ridge with an unpenalised block and a prior on sparse two-row designs.

A design row is ``(row_id, grp, y, w, terms)`` with ``terms`` an array of ``(col, val)`` holding its few
non-zeros. The normal equations are sums over rows, so tasks add up the pairs inside each row, a batch of rows at
a time, and one aggregation adds up the tasks' sums; rows never meet each other. They stay distributed whatever their order: conjugate
gradients run on their entries, one system here, many at once in ``block_ridge``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from stintflow.scale import with_ordinal
from stintflow.session import cut_lineage, forget

COVARIATES = 6
# Covariate columns. 0 intercept, 1 home attacking, 2-5 score state of the attacker.


def column_index(members: DataFrame, member: str) -> DataFrame:
    """``member -> idx``, numbered from 0 in ascending order."""
    ids = members.select(member).distinct()
    return with_ordinal(ids, [], None, member, "_n").select(member, (F.col("_n") - 1).alias("idx"))


def two_row_design(
    segments: DataFrame, index: DataFrame, n_members: int, home: str = "home_value", away: str = "away_value", more: dict[str, tuple[str, str]] = {}
) -> DataFrame:
    """Each segment attacked from both sides: attackers in the offence block, defenders in the defence block.

    ``segments`` has ``row_id, grp, home_ids, away_ids, secs, score_diff`` and the two values. The target
    is the value per hour, the weight is the duration. ``more`` names further targets by their home and away value.
    """
    member = lambda ids, side: F.transform(ids, lambda m: F.struct(m.alias("member"), F.lit(side).alias("side")))
    extra = [f"_{s}_{name}" for name in more for s in "ha"]
    scalars = ["row_id", "grp", "secs", "score_diff", "_hv", "_av", *extra]
    named = {f"_{s}_{name}": F.col(c) for name, pair in more.items() for s, c in zip("ha", pair)}
    spread = segments.withColumns({"_hv": F.col(home), "_av": F.col(away), **named}).select(
        *scalars, F.inline(F.concat(member("home_ids", 0), member("away_ids", 1)))
    )
    # the row's own values ride along as keys, so regrouping is the only shuffle of the rows
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("idx")))
    indexed = spread.join(index.withColumnRenamed(index.columns[0], "member"), "member").groupBy(*scalars).agg(
        of(0).alias("home"), of(1).alias("away")
    )
    side = lambda name, off, dfn, value, diff, at_home: F.struct(
        *[F.col(f"_{name}_{x}").alias(x) for x in more],
        F.concat(F.col("row_id").cast("string"), F.lit(name)).alias("row_id"),
        F.col(off).alias("off"),
        F.col(dfn).alias("dfn"),
        F.col(value).alias("value"),
        diff.alias("diff"),
        F.lit(at_home).alias("at_home"),
    )
    lead = F.col("score_diff")
    both = F.array(side("h", "home", "away", "_hv", lead, 1), side("a", "away", "home", "_av", -lead, 0))
    rows = indexed.select("grp", "secs", F.explode(both).alias("s")).select("grp", "secs", "s.*")
    block = lambda ids, base: F.transform(ids, lambda i: F.struct((i + base).cast("bigint").alias("col"), F.lit(1.0).alias("val")))
    bucket = F.when(F.col("diff") >= 2, 2).when(F.col("diff") == 1, 3).when(F.col("diff") == -1, 4).when(F.col("diff") <= -2, 5)
    term = lambda cond, col: F.when(cond, F.struct(col.cast("bigint").alias("col"), F.lit(1.0).alias("val")))
    fixed = F.array_compact(
        F.array(
            term(F.lit(True), F.lit(0)), term(F.col("at_home") == 1, F.lit(1)), term(bucket.isNotNull(), bucket),
        )
    )
    return rows.select(
        "row_id",
        "grp",
        (F.col("value") / F.col("secs") * 3600.0).alias("y"),
        F.col("secs").cast("double").alias("w"),
        *[(F.col(x) / F.col("secs") * 3600.0).alias(x) for x in more],
        F.concat(fixed, block("off", COVARIATES), block("dfn", COVARIATES + n_members)).alias("terms"),
    )


# Half the weight beyond a lead of this many; the largest goalie adjustment per hour.
FAR_LEAD, FAR_WEIGHT = 3, 0.5


def seasons_design(
    segments: DataFrame, index: DataFrame, n_members: int, goalies: DataFrame, weights: dict[int, float],
    default_weight: float, cap: float,
) -> DataFrame:
    """Several seasons in one design, with rows weighted by season and score and defence targets free of the goalie.

    ``segments`` is as for :func:`two_row_design`, with ``season, home_goalie, away_goalie``; ``goalies`` is
    ``goalie, adjust``, saved value above average per hour. A row has an offence target ``y`` (own value per hour) and
    a defence target ``y_against``: the value conceded per hour less the own goalie's part, which is held within
    ``cap`` and never takes the target below zero. There are no covariates: columns 0 and up are the offence block,
    those from ``n_members`` the defence block; members missing from ``index`` have no column.
    """
    season = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("season")]
    weight = F.coalesce(season, F.lit(default_weight)) * F.when(F.abs("score_diff") > FAR_LEAD, FAR_WEIGHT).otherwise(1.0)
    held = goalies.select("goalie", F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("adjust"))).alias("_a"))
    rows = segments.where("secs > 0")
    for side in ("home", "away"):
        rows = rows.join(held.toDF(f"{side}_goalie", f"_{side}"), f"{side}_goalie", "left").fillna(0.0, [f"_{side}"])
    hourly = lambda c: F.col(c) / F.col("secs") * 3600.0
    rows = rows.select(
        "row_id", "grp", "home_ids", "away_ids", weight.alias("w"), hourly("home_value").alias("_h"), hourly("away_value").alias("_v"), "_home", "_away"
    )
    member = lambda ids, side: F.transform(ids, lambda m: F.struct(m.alias("member"), F.lit(side).alias("side")))
    scalars = ["row_id", "grp", "w", "_h", "_v", "_home", "_away"]
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("idx")))
    # an outer join: a segment none of whose members has a column still gives its two rows
    indexed = (
        rows.select(*scalars, F.inline(F.concat(member("home_ids", 0), member("away_ids", 1))))
        .join(index.toDF("member", "idx"), "member", "left")
        .groupBy(*scalars)
        .agg(of(0).alias("home"), of(1).alias("away"))
    )
    block = lambda ids, base: F.transform(ids, lambda i: F.struct((i + base).cast("bigint").alias("col"), F.lit(1.0).alias("val")))
    row = lambda mark, off, dfn, own, other, adjust: F.struct(
        F.concat(F.col("row_id").cast("string"), F.lit(mark)).alias("row_id"),
        F.col(own).alias("y"),
        F.greatest(F.lit(0.0), F.col(other) - F.col(adjust)).alias("y_against"),
        F.concat(block(off, 0), block(dfn, n_members)).alias("terms"),
    )
    both = F.array(row("h", "home", "away", "_h", "_v", "_home"), row("a", "away", "home", "_v", "_h", "_away"))
    return indexed.select("grp", "w", F.inline(both))


# Rows, and pairs of terms in them, that a task adds up at once.
ROWS, PAIRS = 1024, 1 << 20


def _pair_sums(by: list[str], width: int, schema):
    """Turns Arrow batches of ``by``, ``w``, ``t0 ..`` (targets), ``cols`` and ``vals`` (lists) into their moments.

    Nulls are as in SQL: a product with one adds nothing, and a sum of nothing else is null.
    """

    def numbers(array):
        return array.fill_null(0.0).to_numpy(zero_copy_only=False), array.is_valid().to_numpy(zero_copy_only=False)

    def sizes(rows):
        return pc.fill_null(pc.list_value_length(rows["cols"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def sums(code, value, known, codes):
        """The codes that occur, below ``codes``, and the sum of each."""
        if codes > 4 * len(code):
            found, code = np.unique(code, return_inverse=True)
        else:
            found = np.arange(codes)
        met = np.bincount(code, minlength=len(found)) > 0
        total = np.bincount(code, np.where(known, value, 0.0), len(found))
        none = np.bincount(code, known, len(found)) == 0
        return found[met], pa.array(total[met], mask=none[met])

    def moments(rows):
        size = sizes(rows)
        row = np.repeat(np.arange(len(size)), size)
        (val, has), (w, weighed) = numbers(rows["vals"].flatten()), numbers(rows["w"])
        group, first = np.zeros(len(size), np.int64), np.zeros(1, np.int64)
        for name in by:
            code = rows[name].dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, first, group = np.unique(group * (len(size) + 1) + code, return_index=True, return_inverse=True)
        names, place = np.unique(rows["cols"].flatten().to_numpy(), return_inverse=True)
        n, groups = len(names), len(first)
        # every term with every one of its row that does not come before it
        each = size[row]
        a = np.repeat(np.arange(len(row)), each)
        b = np.arange(len(a)) + np.repeat((np.cumsum(size) - size)[row] - (np.cumsum(each) - each), each)
        kept = place[b] >= place[a]
        a, b = a[kept], b[kept]
        spot, term, sure = group[row] * n + place, w[row] * val, weighed[row] & has
        code, total = sums(spot[a] * n + place[b], term[a] * val[b], sure[a] & has[b], groups * n * n)
        found = [(code // n, names[code % n], total)]
        for k in range(width):
            y, known = numbers(rows[f"t{k}"])
            code, total = sums(spot, term * y[row], sure & known[row], groups * n)
            found.append((code, np.full(len(code), -k - 1), total))
        for spot, j, total in found:
            of = [rows[name].take(pa.array(first[spot // n])) for name in by]
            yield pa.RecordBatch.from_arrays([*of, pa.array(names[spot % n]), pa.array(j), total], schema=schema)

    def run(batches):
        for batch in batches:
            size = sizes(batch)
            block = np.arange(len(size)) // ROWS + np.cumsum(size * size) // PAIRS
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(size)]
            for low, high in zip(edges, edges[1:]):
                if low < high:
                    yield from moments(batch.slice(low, high - low))

    return run


def gram(design: DataFrame, by: list[str] = [], targets: list[str] = ["y"]) -> DataFrame:
    """Upper triangle of XᵀWX (``i <= j``) and, with ``j = -1, -2 ...``, XᵀWy per target; per ``by`` group when given.

    Rows are brought together by ``grp``, whose rows share columns, and tasks add up the pairs of some rows at a time:
    only these sums become rows of Spark's. Rows of a group meet in one task but are never held together there. Columns are never null.
    """
    double = lambda c: F.col(c).cast("double")
    flat = design.where(F.size("terms") > 0).select(
        *dict.fromkeys([*by, "grp"]), double("w").alias("w"), *[double(y).alias(f"t{k}") for k, y in enumerate(targets)],
        F.col("terms.col").cast("array<bigint>").alias("cols"), F.col("terms.val").cast("array<double>").alias("vals"),
    )
    near = flat.repartition("grp").sortWithinPartitions(*by, "grp").drop(*({"grp"} - set(by)))
    groups = [design.schema[name] for name in by]
    out = StructType([*groups, StructField("i", LongType()), StructField("j", LongType()), StructField("v", DoubleType())])
    summed = near.mapInArrow(_pair_sums(by, len(targets), to_arrow_schema(out)), out)
    return summed.groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def target_norm(design: DataFrame, by: list[str] = []) -> DataFrame:
    return design.groupBy(*by).agg(F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy"), F.sum("w").alias("sw"))


# Fixed value: entries of a matrix that one task holds, as long as that takes no more tasks than a shuffle has.
ENTRIES = 200_000


def dealt(entries: DataFrame, by: list[str], count: int) -> tuple[DataFrame, int]:
    """``count`` entries dealt out by ``by`` and kept on disk for many steps, and to how many partitions.

    A step has a task per partition, whatever that holds, so a small matrix lies in few; adaptive execution cannot
    merge partitions that are kept. They are filled here, as only then is it known to a join how they lie.
    """
    most = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, -(-count // ENTRIES)))
    held = entries.repartition(parts, *by).sortWithinPartitions(*by).persist(StorageLevel.DISK_ONLY)
    held.count()
    return held, parts


def ridge_cg(
    g: DataFrame, penalised: Column, lam: float, prior: DataFrame | None = None, steps: int = 1000, tol: float = 1e-10
) -> DataFrame:
    """Conjugate gradients on distributed Gram entries, for designs too wide for one machine.

    ``g`` is :func:`gram` output, ``penalised`` a condition on ``i``. Every step is one join and one
    aggregation over the entries and writes one table of vectors, in place of the one before. Raises when
    the residual is not below ``tol`` of its start after ``steps``.
    """
    upper = g.where("j >= 0")
    mirrored = upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    plain, parts = dealt(upper.unionByName(mirrored), ["j"], 2 * g.count())
    try:
        return _descend(g, plain, parts, penalised, lam, prior, steps, tol)
    finally:
        plain.unpersist()


def _descend(
    g: DataFrame, plain: DataFrame, parts: int, penalised: Column, lam: float, prior: DataFrame | None, steps: int, tol: float
) -> DataFrame:
    """The steps of :func:`ridge_cg` on both triangles ``plain``, which lie dealt out by ``j`` to ``parts``; only vectors move, in
    shuffles, as a broadcast in each step would pass through the driver."""
    entries = plain.withColumn("v", F.when((F.col("i") == F.col("j")) & penalised, F.col("v") + lam).otherwise(F.col("v")))
    rhs = g.where("j = -1").select("i", F.col("v").alias("b"))
    if prior is not None:
        shift = plain.join(prior.select(F.col("i").alias("j"), "prior"), "j").groupBy("i").agg(
            F.sum(F.col("v") * F.col("prior")).alias("s")
        )
        rhs = rhs.join(shift, "i", "left").select("i", (F.col("b") - F.coalesce("s", F.lit(0.0))).alias("b"))
    written = cut_lineage(rhs.select("i", F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("p")))
    state = written
    rr = state.agg(F.sum(F.col("r") * F.col("r")).alias("s")).first()["s"]
    stop, step = tol * tol * rr, 0
    while rr > stop:
        if step == steps:
            raise ArithmeticError(f"no convergence: squared residual {rr:g} after {steps} steps, wanted {stop:g}")
        ap = entries.join(state.select(F.col("i").alias("j"), "p").repartition(parts, "j").hint("merge"), "j").groupBy("i").agg(
            F.sum(F.col("v") * F.col("p")).alias("ap")
        )
        moved = cut_lineage(state.join(ap.hint("merge"), "i"))
        forget(written)
        written = moved
        alpha = rr / moved.agg(F.sum(F.col("p") * F.col("ap")).alias("s")).first()["s"]
        moved = moved.withColumn("x", F.col("x") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("ap"))
        fresh = moved.agg(F.sum(F.col("r") * F.col("r")).alias("s")).first()["s"]
        state = moved.select("i", "x", "r", (F.col("r") + (fresh / rr) * F.col("p")).alias("p"))
        rr, step = fresh, step + 1
    result = cut_lineage(state.select("i", "x"))
    forget(written)
    if prior is None:
        return result
    return result.join(prior, "i", "left").select("i", (F.col("x") + F.coalesce("prior", F.lit(0.0))).alias("x"))


def residuals(g: DataFrame, solution: DataFrame, penalised: Column, lam: float) -> DataFrame:
    """``i, b, gap``: right side of the normal equations and what the solution ``i, x`` leaves of it."""
    upper = g.where("j >= 0")
    mirrored = upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    product = upper.unionByName(mirrored).join(solution.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(
        F.sum(F.col("v") * F.col("x")).alias("ax")
    )
    own = solution.select("i", F.when(penalised, lam * F.col("x")).otherwise(0.0).alias("px"))
    rhs = g.where("j = -1").select("i", F.col("v").alias("b"))
    return rhs.join(product, "i").join(own, "i").select("i", "b", (F.col("ax") + F.col("px") - F.col("b")).alias("gap"))


def coefficient_table(coefs: DataFrame, index: DataFrame, n_members: int, names: list[str]) -> DataFrame:
    """Member coefficients with the defence sign flipped so that positive is good on both sides.

    ``coefs`` is ``i`` and the columns ``names``; each gives ``<name>_offense``, ``<name>_defense`` and ``<name>_total``.
    """
    placed = coefs.where(F.col("i") >= COVARIATES).select(
        (F.pmod(F.col("i") - COVARIATES, F.lit(n_members))).alias("idx"), (F.col("i") >= COVARIATES + n_members).alias("_def"), *names
    )
    sides = [F.max(F.when(F.col("_def") == is_def, F.col(n) * sign)).alias(f"{n}_{side}") for n in names for side, is_def, sign in (("offense", False, 1.0), ("defense", True, -1.0))]
    table = index.join(placed.groupBy("idx").agg(*sides), "idx")
    return table.withColumns({f"{n}_total": F.col(f"{n}_offense") + F.col(f"{n}_defense") for n in names})


def ordered_list(rows: DataFrame, key: str, item: str, weight: str, out: str, sep: str = "/") -> DataFrame:
    """Per key its items by falling total weight, then by name, as one string; a key has few items."""
    sums = rows.groupBy(key, item).agg(F.sum(weight).alias("_w"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_w")).alias("w"), F.col(item).alias("item"))))
    return sums.groupBy(key).agg(F.array_join(F.transform(ranked, lambda x: x["item"]), sep).alias(out))


def impact(coefficients: DataFrame, toi: DataFrame, member: str, secs: str) -> DataFrame:
    """Total scaled by hours played."""
    return coefficients.join(toi, member, "left").withColumn(
        "total_impact", F.col("total") * F.coalesce(secs, F.lit(0)) / 3600.0
    )


def prior_from_rates(rates: DataFrame, value: str, target_sd: float, out: str) -> DataFrame:
    """Centre observed rates and scale them to the wanted spread."""
    row = rates.agg(F.struct(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd")).alias("s")).scalar()
    z = F.when(F.col("_s.sd") > 0, (F.col(value) - F.col("_s.mu")) / F.col("_s.sd")).otherwise(0.0)
    return rates.withColumn("_s", row).withColumn(out, z * target_sd).drop("_s")

"""Many ridge systems at once, none of whose matrices any one machine holds.

The normal equations stay a table ``(part, i, j, v)`` with one part per fold. A subset of parts (all folds but one,
one half of the season) is a sum of parts, ``(u, i, j, v)``. All systems on all subsets are solved together by
conjugate gradients: a row of the state holds, for one column of the design, the values of every system on its subset
side by side, so a step is one join with the entries and one aggregation, whatever the number of penalties and targets.
The entries are dealt out by column once and stay where they are; only the vectors move. Scalars of the steps, a
handful per system, are all that the driver sees.

Where the columns fall into blocks beside the unpenalised ones, a search solves its systems directly instead
(``column_blocks``).

A prior costs one more target instead of one more system per strength: with ``A d0 = b`` and ``A d1 = A0 prior``, where
``A`` is ``A0`` plus the penalty, the fit for strength ``kappa`` is ``kappa * prior + d0 - kappa * d1``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.operators.column_blocks import Blocks, blocks_of
from stintflow.operators.regression import dealt
from stintflow.session import cut_lineage, forget

TOL = 1e-12
STEPS = 500


def _array(values) -> Column:
    return F.array(*values)


def _each(width: int, text: str) -> str:
    """An SQL array with ``text`` for each slot, ``#`` standing for the slot's number."""
    return "array(" + ", ".join(text.replace("#", str(k)) for k in range(width)) + ")"


def _table(spark, rows: list[tuple], names: str) -> DataFrame:
    """A few rows of whole numbers and lists of doubles as a table of known size, which a join may broadcast."""
    cell = lambda x: f"array({', '.join(f'{v!r}D' for v in x)})" if isinstance(x, list) else f"{x}L"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(cell, row)) + ')' for row in rows)} AS t({names})")


def subset_moments(g: DataFrame, subsets: dict[int, list[int]]) -> DataFrame:
    """Sums ``u, i, j, v`` of the parts of each subset, from ``part, i, j, v`` of :func:`regression.gram`."""
    spark = g.sparkSession
    pairs = _table(spark, [(u, p) for u, parts in subsets.items() for p in parts], "u, part")
    return g.join(pairs, "part").groupBy("u", "i", "j").agg(F.sum("v").alias("v"))


def both_triangles(moments: DataFrame) -> DataFrame:
    upper = moments.where("j >= 0")
    mirrored = upper.where("i < j").select("u", F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return upper.select("u", "i", "j", "v").unionAll(mirrored)


def _product(entries: DataFrame, vectors: DataFrame, name: str, width: int, parts: int | None = None) -> DataFrame:
    """``u, i, out``: the entries, which may lie dealt out to ``parts``, times the vectors ``u, i, name`` (an array of ``width``)."""
    other = vectors.selectExpr("u", "i AS j", f"{name} AS _p")
    if parts:
        other = other.repartition(parts, "u", "j")
    summed = entries.join(other, ["u", "j"]).groupBy("u", "i").agg(*[F.expr(f"sum(v * _p[{k}]) AS _s{k}") for k in range(width)])
    return summed.selectExpr("u", "i", _each(width, "_s#") + " AS out")


def solve(
    entries: DataFrame, rhs: DataFrame, lams: list[float], penalised: Column, start: DataFrame | None = None,
    tol: float = TOL, steps: int = STEPS,
) -> DataFrame:
    """``u, i, x``: for each subset and slot ``k`` the solution of (A + lams[k] * penalised) x[k] = b[k].

    ``entries`` is symmetric ``u, i, j, v``, ``rhs`` is ``u, i, b`` with an array of a slot per penalty, ``start`` is
    ``u, i, x`` to go on from. Raises when a residual is not below ``tol`` of its right side after ``steps``.
    """
    spark = entries.sparkSession
    width = len(lams)
    slots = range(width)
    held, parts = dealt(entries, ["u", "j"], entries.count())
    written: list[DataFrame] = []
    try:
        pen = F.when(penalised, 1.0).otherwise(0.0)
        diagonal = held.where("i = j").select("u", "i", F.col("v").alias("_d"))
        inverse = lambda k: F.when(F.col("_d") + F.col("pen") * lams[k] > 0, 1.0 / (F.col("_d") + F.col("pen") * lams[k])).otherwise(0.0)
        base = rhs.withColumn("pen", pen).join(diagonal, ["u", "i"], "left").fillna(0.0, ["_d"])
        base = base.select("u", "i", "pen", "b", _array(inverse(k) for k in slots).alias("w"))
        if start is None:
            base = base.withColumns({"x": _array([F.lit(0.0)] * width), "r": F.col("b")})
        else:
            base = base.join(start, ["u", "i"]).join(_product(held, start, "x", width, parts), ["u", "i"], "left")
            gap = lambda k: F.col("b")[k] - F.coalesce(F.col("out")[k], F.lit(0.0)) - F.col("pen") * lams[k] * F.col("x")[k]
            base = base.withColumn("r", _array(gap(k) for k in slots)).drop("out")
        state = cut_lineage(base.withColumn("p", _array(F.col("w")[k] * F.col("r")[k] for k in slots)))
        written.append(state)
        scale = [F.expr(f"sum(b[{k}] * b[{k}] * w[{k}]) AS b{k}") for k in slots]
        stop = {row["u"]: [tol * tol * row[f"b{k}"] for k in slots] for row in state.groupBy("u").agg(*scale).collect()}
        lam = "array(" + ", ".join(f"{x!r}D" for x in lams) + ")"
        # a column that the subset's rows lack meets nothing
        full = _each(width, f"coalesce(out[#], 0D) + pen * {lam}[#] * p[#]") + " AS q"
        terms = {"rr": "r[#] * w[#] * r[#]", "pq": "p[#] * q[#]", "rq": "r[#] * w[#] * q[#]", "qq": "q[#] * w[#] * q[#]"}
        dots = [F.expr(f"sum({text.replace('#', str(k))}) AS {name}{k}") for k in slots for name, text in terms.items()]
        ahead = [_each(width, "x[#] + alpha[#] * p[#]") + " AS x", _each(width, "r[#] - alpha[#] * q[#]") + " AS r"]
        turned = _each(width, "w[#] * r[#] + beta[#] * p[#]") + " AS p"
        for _ in range(steps):
            ap = _product(held, state, "p", width, parts)
            moved = cut_lineage(state.join(ap, ["u", "i"], "left").selectExpr("u", "i", "pen", "w", "x", "r", "p", full))
            written.append(moved)
            forget(written.pop(0))
            rows, left = [], False
            for row in moved.groupBy("u").agg(*dots).collect():  # a row per subset
                alphas, betas = [], []
                for k in slots:
                    rr, pq = row[f"rr{k}"], row[f"pq{k}"]
                    on = rr > stop[row["u"]][k] and pq > 0
                    left |= on
                    alpha = rr / pq if on else 0.0
                    after = max(0.0, rr - 2 * alpha * row[f"rq{k}"] + alpha * alpha * row[f"qq{k}"])
                    alphas.append(alpha)
                    betas.append(after / rr if on else 0.0)
                rows.append((row["u"], alphas, betas))
            if not left:
                return cut_lineage(moved.select("u", "i", "x"))
            step = moved.join(_table(spark, rows, "u, alpha, beta"), "u")
            state = step.selectExpr("u", "i", "pen", "w", "p", "beta", *ahead).selectExpr("u", "i", "pen", "w", "x", "r", turned)
        raise ArithmeticError(f"no convergence after {steps} steps")
    finally:
        held.unpersist()
        for table in written:
            forget(table)


def right_sides(moments: DataFrame, entries: DataFrame, targets: list[int | str], priors: DataFrame | None = None) -> DataFrame:
    """``u, i, b``: per target a slot; a whole number ``-j`` is a column of the moments, a name a column of ``priors``
    (``i`` and the name), of which the product with the entries is taken. Every subset has a row for every column of
    any of them, as one that its rows lack keeps its prior."""
    subsets = F.explode(F.array(*[F.lit(row["u"]) for row in moments.select("u").distinct().orderBy("u").collect()])).alias("u")
    columns = moments.where("i = j").select("i").distinct().select(subsets, "i")
    out = columns
    of = lambda j: F.sum(F.when(F.col("j") == j, F.col("v"))).alias(f"_t{-j}")
    plain = sorted({t for t in targets if isinstance(t, int)})
    if plain:
        out = out.join(moments.where("j < 0").groupBy("u", "i").agg(*map(of, plain)), ["u", "i"], "left")
    names = [t for t in targets if isinstance(t, str)]
    if names:
        wide = columns.join(priors.select("i", _array(F.coalesce(c, F.lit(0.0)) for c in names).alias("_v")), "i")
        product = _product(entries, wide, "_v", len(names))
        out = out.join(product.select("u", "i", *[F.col("out")[k].alias(f"_n{k}") for k in range(len(names))]), ["u", "i"], "left")
    pick = lambda t: F.col(f"_t{-t}") if isinstance(t, int) else F.col(f"_n{names.index(t)}")
    return out.select("u", "i", _array(F.coalesce(pick(t), F.lit(0.0)) for t in targets).alias("b"))


def held_out_errors(g: DataFrame, norms: DataFrame, coefs: DataFrame, pairs: list[tuple[int, int]], width: int) -> dict:
    """``(u, part) -> [error per slot]``: weighted mean squared error of the fit ``u, i, beta`` on the rows of a part.

    Expanded over the moments of the part, so the rows are not read again: sums of ``v * beta_i * beta_j``.
    """
    spark = g.sparkSession
    table = _table(spark, pairs, "u, part")
    left = coefs.join(table, "u").select("u", "part", "i", F.col("beta").alias("_x"))
    right = left.select("u", "part", F.col("i").alias("j"), F.col("_x").alias("_y"))
    times = F.col("v") * F.when(F.col("i") < F.col("j"), 2.0).otherwise(1.0)
    square = g.where("j >= 0").join(left, ["part", "i"]).join(right, ["u", "part", "j"]).groupBy("u", "part").agg(
        *[F.sum(times * F.col("_x")[k] * F.col("_y")[k]).alias(f"s{k}") for k in range(width)]
    )
    line = g.where("j = -1").join(left, ["part", "i"]).groupBy("u", "part").agg(
        *[F.sum(F.col("v") * F.col("_x")[k]).alias(f"t{k}") for k in range(width)]
    )
    whole = square.join(line, ["u", "part"]).join(norms, "part")
    return {
        (row["u"], row["part"]): [(row["yy"] - 2 * row[f"t{k}"] + row[f"s{k}"]) / row["sw"] for k in range(width)]
        for row in whole.collect()  # a row per fold
    }


@dataclass
class Search:
    """What a penalty search leaves: mean held-out error per (cell, penalty, kappa), the choice per (cell, kappa), and
    the fits of whole cells: a table ``u, i, x`` per batch of penalties, or the blocks with the solutions of the hubs."""

    errors: dict = field(default_factory=dict)
    folds: dict = field(default_factory=dict)
    best: dict = field(default_factory=dict)
    fits: list[tuple[list[float], DataFrame]] = field(default_factory=list)
    blocks: Blocks | None = None
    hubs: dict = field(default_factory=dict)
    parts: dict = field(default_factory=dict)  # of each subset


def _coefficients(solution: DataFrame, slots: list[tuple[int, float]], count: int, prior: DataFrame | None) -> DataFrame:
    """``u, i, beta`` with a fit per ``(penalty number, kappa)``; ``x`` holds ``count`` plain fits, then those of the prior."""
    if prior is None:
        return solution.select("u", "i", _array(F.col("x")[k] for k, _ in slots).alias("beta"))
    joined = solution.join(prior.select("i", F.col("prior").alias("_b")), "i", "left").fillna(0.0, ["_b"])
    fit = lambda k, kappa: F.col("x")[k] + F.lit(kappa) * (F.col("_b") - F.col("x")[count + k])
    return joined.select("u", "i", _array(fit(k, kappa) for k, kappa in slots).alias("beta"))


def search(
    g: DataFrame, norms: DataFrame, cells: dict[int, list[int]], grid: list[float], penalised: Column,
    kappas: list[float] = [0.0], prior: DataFrame | None = None, widen: int = 8,
) -> Search:
    """Held-out error per penalty and prior strength, by leaving out each part of a cell in turn.

    ``g`` is ``part, i, j, v`` and ``norms`` is ``part, yy, sw``. While the best penalty of some cell and strength is
    an edge of the grid, the grid goes on by its own ratio there, ``widen`` times at most.
    """
    found = _search(g, norms, cells, grid, penalised, kappas, prior, widen)
    if found.blocks is not None:
        found.blocks.release()
    return found


def _search(
    g: DataFrame, norms: DataFrame, cells: dict[int, list[int]], grid: list[float], penalised: Column,
    kappas: list[float], prior: DataFrame | None, widen: int,
) -> Search:
    """:func:`search`, directly on blocks of columns where there are such, else by conjugate gradients."""
    subsets = {cell: parts for cell, parts in cells.items()}
    pairs, first = [], max(cells) + 1
    for cell, parts in cells.items():
        for part in parts:
            subsets[first] = [p for p in parts if p != part]
            pairs.append((cell, first, part))
            first += 1
    blocks = blocks_of(g, penalised, prior) if min(grid) > 0 else None
    if blocks is not None:
        sizes = _sizes(norms)
        found = Search(blocks=blocks, parts=subsets)
        held = [(u, part) for _, u, part in pairs if part in sizes]

        def direct(todo, origin):
            found.hubs |= blocks.solve_hubs(subsets, todo)
            slots = [(lam, kappa) for lam in todo for kappa in kappas]
            return blocks.held_out_errors(sizes, subsets, held, found.hubs, {u: slots for u, _ in held})

        try:
            return _walk(found, direct, pairs, cells, grid, kappas, widen)
        except np.linalg.LinAlgError:  # no single solution: go the way that also then leads to one
            blocks.release()
    moments = cut_lineage(subset_moments(g, subsets))
    entries = cut_lineage(both_triangles(moments))
    found = Search()

    def descend(todo, origin):
        targets = [-1] * len(todo) + (["prior"] * len(todo) if prior is not None else [])
        rhs = right_sides(moments, entries, targets, prior)
        start = None
        if origin is not None:  # the solution next to each new penalty
            lams, solution = found.fits[origin[0]]
            turn = [origin[1]] * len(todo) if prior is None else [origin[1]] * len(todo) + [len(lams) + origin[1]] * len(todo)
            start = solution.select("u", "i", _array(F.col("x")[k] for k in turn).alias("x"))
        solution = solve(entries, rhs, (todo * 2 if prior is not None else todo), penalised, start)
        found.fits.append((todo, solution))
        slots = [(k, kappa) for k in range(len(todo)) for kappa in kappas]
        coefs = _coefficients(solution, slots, len(todo), prior)
        return held_out_errors(g, norms, coefs, [(u, part) for _, u, part in pairs], len(slots))

    return _walk(found, descend, pairs, cells, grid, kappas, widen)


def _sizes(norms: DataFrame) -> dict[int, tuple[float, float]]:
    return {row["part"]: (row["yy"], row["sw"]) for row in norms.collect()}  # a row per fold


def _walk(found: Search, score, pairs: list[tuple[int, int, int]], cells: dict, grid: list[float], kappas: list[float], widen: int) -> Search:
    """The errors of a grid and of what it goes on to; ``score`` takes the penalties and where the edge they go on from is."""
    order = sorted(grid)
    ratio = order[-1] / order[-2] if len(order) > 1 else 2.0
    todo, origin, batches = order, None, []
    for _ in range(widen + 1):
        scored = score(todo, origin)
        batches.append(todo)
        slots = [(k, kappa) for k in range(len(todo)) for kappa in kappas]
        for at, (k, kappa) in enumerate(slots):
            for cell in cells:
                each = {part: scored[u, part][at] for c, u, part in pairs if c == cell}
                found.folds[cell, todo[k], kappa] = each
                found.errors[cell, todo[k], kappa] = sum(each.values()) / len(each)
        known = sorted({lam for _, lam, _ in found.errors})
        for cell in cells:
            for kappa in kappas:
                found.best[cell, kappa] = min(known, key=lambda lam: found.errors[cell, lam, kappa])
        chosen = set(found.best.values())
        edge = known[-1] if known[-1] in chosen else known[0] if known[0] in chosen else None
        if edge is None:
            break
        origin = next((n, lams.index(edge)) for n, lams in enumerate(batches) if edge in lams)
        todo = [edge * ratio] if edge == known[-1] else [edge / ratio]
    return found


def chosen_fits(found: Search, cell: int, kappas: list[float], prior: DataFrame | None) -> DataFrame:
    """``i, beta`` of a whole cell, a slot per kappa, each at its own chosen penalty."""
    if found.blocks is not None:
        return found.blocks.fits(found.parts, found.hubs, cell, [(found.best[cell, kappa], kappa) for kappa in kappas])
    out = None
    for n, (lams, solution) in enumerate(found.fits):
        mine = [(k, lams.index(found.best[cell, kappa])) for k, kappa in enumerate(kappas) if found.best[cell, kappa] in lams]
        if not mine:
            continue
        coefs = _coefficients(solution.where(F.col("u") == cell), [(at, kappas[k]) for k, at in mine], len(lams), prior)
        named = coefs.select("i", *[F.col("beta")[n].alias(f"_k{k}") for n, (k, _) in enumerate(mine)])
        out = named if out is None else out.join(named, "i")
    return out.select("i", _array(F.col(f"_k{k}") for k in range(len(kappas))).alias("beta"))


@dataclass(frozen=True)
class Halves:
    """Fits on either half of the groups, scored on the other one."""

    search: Search
    coefs: dict  # cell -> ``i, beta`` with a slot per kappa
    errors: list[float]  # mean of both directions per kappa


def two_way_test(
    g: DataFrame, norms: DataFrame, cells: dict[int, list[int]], grid: list[float], penalised: Column,
    kappas: list[float], prior: DataFrame, widen: int = 8,
) -> Halves:
    """For each prior strength, fit on one half at its own penalty and score on the other, both ways."""
    found = _search(g, norms, cells, grid, penalised, kappas, prior, widen)
    (a, b) = cells
    coefs = {cell: cut_lineage(chosen_fits(found, cell, kappas, prior)) for cell in cells}
    sizes = _sizes(norms)
    weights = {part: sw for part, (_, sw) in sizes.items()}
    pairs = [(x, part) for x, y in ((a, b), (b, a)) for part in cells[y]]
    if found.blocks is not None:
        slots = {cell: [(found.best[cell, kappa], kappa) for kappa in kappas] for cell in cells}
        scored = found.blocks.held_out_errors(sizes, found.parts, pairs, found.hubs, slots)
        found.blocks.release()
    else:
        whole = lambda cell: coefs[cell].select(F.lit(cell).cast("bigint").alias("u"), "i", "beta")
        scored = held_out_errors(g, norms, whole(a).unionAll(whole(b)), pairs, len(kappas))
    errors = []
    for k in range(len(kappas)):
        ways = []
        for x, y in ((a, b), (b, a)):
            ways.append(sum(scored[x, p][k] * weights[p] for p in cells[y]) / sum(weights[p] for p in cells[y]))
        errors.append(sum(ways) / 2)
    return Halves(found, coefs, errors)


def group_errors(design: DataFrame, coefs: DataFrame, width: int, by: list[str] = []) -> DataFrame:
    """``grp, w`` and the weighted squared errors ``e0, e1 ...`` of several fits, per group of rows.

    ``coefs`` is ``i, beta``, with the columns ``by`` of the design too where rows are scored by different fits.
    """
    terms = design.select("row_id", *by, F.inline("terms"))
    met = terms.join(coefs.withColumnRenamed("i", "col"), [*by, "col"]).groupBy("row_id").agg(
        *[F.sum(F.col("val") * F.col("beta")[k]).alias(f"_p{k}") for k in range(width)]
    )
    gap = lambda k: F.col("y") - F.coalesce(F.col(f"_p{k}"), F.lit(0.0))
    rows = design.select("row_id", "grp", "y", "w").join(met, "row_id", "left")
    return rows.groupBy("grp").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * gap(k) * gap(k)).alias(f"e{k}") for k in range(width)])

"""Samples whose shares of categories follow targets (problem 1).

One pass over the active members fills reservoirs, one per panel and combination of categories (cell): the members of lowest
hash, at most the panel's sample size, with a count of all. They are mergeable: each task keeps its own over its rows, and the
lowest of the union are those of the whole. Only then, with the final counts, are quotas set: raking fits the cells to the targets of
all dimensions within what the cells hold, whole numbers follow by largest remainders and moves of single places, and minima are repaired by moving single places.
The reservoirs are trimmed to the quotas by hash, which is uniform within a cell.

Skew: a panel or a cell of any size gives each task at most sample-size rows per cell. Quotas are set over the cells of one panel, of which there
are at most as many as combinations of categories.

Defined results: null in a dimension is a category of its own that has no target; persons without demographics count as null
in all; repeated rows and several active rows of a person in a panel count once; rows with null panel or person are left out; a
null proportion, sample size or minimum counts as 0; a panel without targets isn't sampled; targets for other dimensions than
the three are reported with no one available.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.session import ship

DIMENSIONS = ["sexo", "tramo_etario", "localidad"]
NONE = "\x00"  # stands for null inside the tasks
CELL = ["panel_id", *DIMENSIONS]
BROADCAST_ROWS = 100_000


def active_members(membership: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct active members of each panel with their categories, distributed by person."""
    active = membership.filter("estado = 'activo' and panel_id is not null and id_persona is not null").select("panel_id", "id_persona")
    values = people.filter("id_persona is not null").select("id_persona", *DIMENSIONS)
    # one exchange by person serves the removal of repeated rows and the join
    parts = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = active.repartition(parts, "id_persona").dropDuplicates(["id_persona", "panel_id"])
    return once.join(values.repartition(parts, "id_persona").dropDuplicates(["id_persona"]), "id_persona", "left")


def reservoirs(members: DataFrame, sizes: DataFrame, seed: int = 0) -> DataFrame:
    """The members of lowest hash of each cell with `rango` (from 1) in the cell and `n` of all members of the cell.

    sizes: panel_id, n_muestra; a row per panel.
    """
    ship(members.sparkSession)
    small = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sized = members.join(F.broadcast(sizes) if small else sizes, "panel_id")
    rows = sized.select("panel_id", *(F.coalesce(d, F.lit(NONE)).alias(d) for d in DIMENSIONS), "id_persona", "n_muestra", F.xxhash64("id_persona", F.lit(seed)).alias("h"))

    def run(batches):
        kept, counts = None, None
        for pdf in batches:
            n = pdf.groupby(CELL, sort=False).size()
            counts = n if counts is None else counts.add(n, fill_value=0)
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            pdf = pdf.sort_values(["h", "id_persona"], kind="stable")
            kept = pdf[pdf.groupby(CELL, sort=False).cumcount() < pdf["n_muestra"].clip(lower=1)]
        if kept is not None and len(kept):
            first = kept.groupby(CELL, sort=False).cumcount() == 0
            n = counts.reindex(pd.MultiIndex.from_frame(kept[CELL])).to_numpy()
            yield kept[[*CELL, "id_persona", "h"]].assign(n=np.where(first, n, 0).astype("int64"))

    partial = rows.mapInPandas(run, "panel_id long, sexo string, tramo_etario string, localidad string, id_persona string, h long, n long")
    cell = Window.partitionBy(*CELL)
    return partial.withColumn("rango", F.row_number().over(cell.orderBy("h", "id_persona"))).withColumn("n", F.sum("n").over(cell))


def clean_targets(targets: DataFrame) -> DataFrame:
    return targets.filter("panel_id is not null").select(
        "panel_id",
        "dimension",
        "categoria",
        F.coalesce("proporcion_objetivo", F.lit(0.0)).alias("proporcion_objetivo"),
        F.coalesce("n_muestra", F.lit(0)).alias("n_muestra"),
        F.coalesce("minimo_categoria", F.lit(0)).alias("minimo_categoria"),
    ).distinct()


def cells_of(held: DataFrame) -> DataFrame:
    """Each cell once, with the number of its members."""
    return held.filter("rango = 1").select(*CELL, "n")


def availability(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with `disponibles`, the active members of the category, `requeridos`, and `agotada`: fewer than required."""
    stacked = cells.select("panel_id", "n", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("categoria")) for d in DIMENSIONS))).alias("x"))
    counted = stacked.select("panel_id", "x.dimension", "x.categoria", "n").groupBy("panel_id", "dimension", "categoria").agg(F.sum("n").alias("disponibles"))
    required = F.greatest(F.col("proporcion_objetivo") * F.col("n_muestra"), F.col("minimo_categoria").cast("double"))
    return (
        targets.join(counted, ["panel_id", "dimension", "categoria"], "left")
        .withColumn("disponibles", F.coalesce("disponibles", F.lit(0)))
        .withColumn("requeridos", required)
        .withColumn("agotada", F.col("disponibles") < F.col("requeridos"))
    )


def allocate(counts: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], minima: list[np.ndarray], n: int) -> np.ndarray:
    """Whole quotas of the cells: at most their counts, n in total (or all there are), close to the goals of each dimension's categories.

    codes: per dimension the category number of each cell; goals: places per category, negative where there is no target.
    """
    counts = counts.astype(float)
    n = int(min(n, counts.sum()))
    if not n:
        return np.zeros(len(counts), int)
    wanted = []
    for code, goal, least in zip(codes, goals, minima):
        have = np.bincount(code, counts, len(goal))
        g = np.where(goal < 0, 0, np.minimum(np.maximum(goal, least), have))
        free = np.where(goal < 0, have, 0.0)
        if g.sum() < n and free.sum():
            g = g + free * min(1, (n - g.sum()) / free.sum())
        if g.sum() < n:  # the rest goes where people are left
            left = have - g
            g = g + left * (n - g.sum()) / max(left.sum(), 1e-9)
        wanted.append(g * n / g.sum())
    x = counts * n / counts.sum()
    while True:  # until a round moves no cell by a thousandth of a place
        before = x
        for code, g in zip(codes, wanted):
            now = np.bincount(code, x, len(g))
            x = np.minimum(x * (g / np.maximum(now, 1e-12))[code], counts)
        gap = n - x.sum()
        if gap > 0 and (room := counts - x).sum() > 0:
            x = x + room * min(1, gap / room.sum())
        if np.abs(x - before).max() < 1e-3:
            break
    x = np.minimum(x * (n / x.sum()), counts)
    out = np.floor(x + 1e-9).astype(int)
    order = np.lexsort((np.arange(len(x)), -(x - out)))
    while (short := n - out.sum()) > 0:
        open_ = order[out[order] < counts[order]]
        out[open_[:short]] += 1
    apart = lambda q: sum(np.abs(np.bincount(k, q, len(g)) - g).sum() for k, g in zip(codes, wanted))
    far = apart(out)
    while True:  # rounding leaves small deviations; single places move while that lessens them, which ends as there are finitely many quotas
        over = sum((np.bincount(k, out, len(g)) - g)[k] for k, g in zip(codes, wanted))
        gives, takes = np.flatnonzero(out > 0), np.flatnonzero(out < counts)
        if not len(gives) or not len(takes):
            break
        moved = out.copy()
        moved[gives[np.argmax(over[gives])]] -= 1
        moved[takes[np.argmin(over[takes])]] += 1
        if (nearer := apart(moved)) >= far - 1e-9:
            break
        out, far = moved, nearer
    # minima: single places move to a cell of the category from the cell whose categories are furthest above their goals
    for d, least in enumerate(minima):
        have = np.bincount(codes[d], counts, len(least))
        for c in np.flatnonzero(np.minimum(least, have) > np.bincount(codes[d], out, len(least))):
            for _ in range(int(min(least[c], have[c]) - np.bincount(codes[d], out, len(least))[c])):
                sums = [np.bincount(k, out, len(g)) for k, g in zip(codes, wanted)]
                over = sum((s - g)[k] for s, g, k in zip(sums, wanted, codes))
                takes = np.flatnonzero((codes[d] == c) & (out < counts))
                spare = np.all([(s > np.minimum(m, s))[k] | (m[k] == 0) for s, m, k in zip(sums, minima, codes)], 0)
                gives = np.flatnonzero((codes[d] != c) & (out > 0) & spare)
                if not len(takes) or not len(gives):
                    break
                out[gives[np.argmax(over[gives])]] -= 1
                out[takes[np.argmin(over[takes])]] += 1
    return out


def quotas(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells with their quota `cupo`."""
    ship(cells.sparkSession)
    shape = "panel_id long, sexo string, tramo_etario string, localidad string, n long"

    def run(_, cell: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
        if not len(cell) or not len(target):
            return pd.DataFrame(columns=[*CELL, "n", "cupo"])
        n = int(target["n_muestra"].max())
        codes, goals, minima = [], [], []
        for d in DIMENSIONS:
            code, names = pd.factorize(cell[d])
            own = target[target["dimension"] == d].drop_duplicates("categoria").set_index("categoria")
            codes.append(code)
            goals.append((own["proporcion_objetivo"].reindex(names) * n).fillna(-1).to_numpy())
            minima.append(own["minimo_categoria"].reindex(names).fillna(0).to_numpy())
        return cell.assign(cupo=allocate(cell["n"].to_numpy(), codes, goals, minima, n))

    return cells.groupBy("panel_id").cogroup(targets.groupBy("panel_id")).applyInPandas(run, f"{shape}, cupo long")


def sample(membership: DataFrame, people: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sample (panel_id, id_persona, sexo, tramo_etario, localidad) and the report on all targets.

    Report: the columns of availability, `asignados` (drawn of the category), `faltan` (required less drawn, 0 at least) and its `causa`: agotada (the
    category has too few), redondeo (less than a place), otras_dimensiones (the targets of other dimensions or the sample's size leave no place).
    """
    targets = clean_targets(targets)
    held = held_reservoirs(membership, people, targets, seed)
    cells = cells_of(held)
    set_ = quotas(cells, targets).select(*CELL, "cupo")
    value = [F.nullif(d, F.lit(NONE)).alias(d) for d in DIMENSIONS]
    drawn = held.join(set_, CELL).filter("rango <= cupo").select("panel_id", "id_persona", *value)
    stacked = set_.select("panel_id", "cupo", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("categoria")) for d in DIMENSIONS))).alias("x"))
    given = stacked.select("panel_id", "x.dimension", "x.categoria", "cupo").groupBy("panel_id", "dimension", "categoria").agg(F.sum("cupo").alias("asignados"))
    report = (
        availability(cells, targets)
        .join(given, ["panel_id", "dimension", "categoria"], "left")
        .withColumn("asignados", F.coalesce("asignados", F.lit(0)))
        .withColumn("faltan", F.greatest(F.col("requeridos") - F.col("asignados"), F.lit(0.0)))
        .withColumn("causa", F.when(F.col("faltan") <= 0, None).when(F.col("agotada"), "agotada").when(F.col("faltan") < 1, "redondeo").otherwise("otras_dimensiones"))
    )
    return drawn, report


def held_reservoirs(membership: DataFrame, people: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    sizes = targets.groupBy("panel_id").agg(F.max("n_muestra").alias("n_muestra"))
    return reservoirs(active_members(membership, people), sizes, seed)


def unmet(membership: DataFrame, people: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """The targets that the members can't meet, from the reservoirs' counts."""
    targets = clean_targets(targets)
    return availability(cells_of(held_reservoirs(membership, people, targets, seed)), targets).filter("agotada")

"""Rule-based samples by quotas and the closed form of a greedy optimiser."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators.segments import first_reason


@dataclass(frozen=True)
class Limits:
    """Caps of calls and days that must pass between calls; None: no cap."""

    recent: int | None = 3
    total: int | None = None
    days: int = 14


@dataclass(frozen=True)
class Weights:
    balance: float = 10.0
    fatigue: float = 1.0
    equity: float = 0.5


def exclusions(candidates: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Candidates with the first reason against calling them. candidates: recientes, totales, dias (since the last call), ya."""
    reasons = [("ya_en_encuesta", F.col("ya"))]
    if limits.recent is not None:
        reasons.append(("tope_ventana", F.col("recientes") >= limits.recent))
    if limits.total is not None:
        reasons.append(("tope_total", F.col("totales") >= limits.total))
    reasons.append(("muy_reciente", F.col("dias") < limits.days))
    return candidates.withColumn("motivo", first_reason(reasons))


def quotas(missing: DataFrame, size: int) -> DataFrame:
    """cupo of each category: its share of all that are missing, rounded half to even. missing: categoria, faltan; a row per category."""
    total = F.sum(F.greatest("faltan", F.lit(0))).over(Window.partitionBy())
    return missing.filter("faltan > 0").withColumn("cupo", F.bround(size * F.col("faltan") / total).cast("long")).select("categoria", "faltan", "cupo")


def even_quotas(categories: DataFrame, size: int) -> DataFrame:
    """The same cupo for each category, where no one is missing or there are no targets. categories: categoria; a row per category."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return categories.select("categoria", F.lit(0).cast("long").alias("faltan"), F.floor(size / n).cast("long").alias("cupo"))


def by_quota(eligible: DataFrame, quota: DataFrame, key: str, size: int) -> DataFrame:
    """At most `size` people: the first of each category up to its quota, categories that lack most first, then, while there is room, the
    others of these categories. Least called first: recientes, totales, most answers, key. With `orden` in the category and `completa`: beyond the quota.

    quota: categoria, faltan, cupo; a row per category. A category gives at most its quota and `size` more, which are kept before any exchange.
    """
    priority = ["recientes", "totales", F.desc("respondidas"), key]
    placed = eligible.join(quota.select("categoria", "faltan", "cupo"), "categoria").withColumn("orden", F.row_number().over(Window.partitionBy("categoria").orderBy(*priority)))
    placed = placed.filter(F.col("orden") <= 2 * size).filter(F.col("orden") <= F.col("cupo") + size).withColumn("completa", F.col("orden") > F.col("cupo"))
    own = lambda c: F.when(~F.col("completa"), c)
    return placed.orderBy("completa", F.desc_nulls_last(own(F.col("faltan"))), own(F.col("categoria")), own(F.col("orden")), *priority).limit(size).drop("faltan", "cupo")


def shortfalls(eligible: DataFrame, quota: DataFrame) -> DataFrame:
    """(categoria, faltan, cupo, elegibles) of the quotas that the eligible don't fill."""
    have = eligible.groupBy("categoria").agg(F.count(F.lit(1)).alias("elegibles"))
    out = quota.join(have, "categoria", "left").withColumn("elegibles", F.coalesce("elegibles", F.lit(0)))
    return out.filter((F.col("faltan") > 0) & (F.col("elegibles") < F.col("cupo"))).select("categoria", "faltan", "cupo", "elegibles")


def alternatives(candidates: DataFrame, targets: DataFrame, size: int, limits: Limits, steps: int = 3) -> DataFrame:
    """(opcion, tope, elegibles, tamano, disimilitud, alcanza) of what can be done where the optimiser falls short: a smaller sample or the gap as it is (tope
    as given), or a cap of recent calls relaxed by 1 to `steps`. Not offered: steps beyond the first that suffices or brings no one.

    The optimiser takes of each category as many as there are, up to its target, so its size and shares follow from the counts of one pass. targets:
    categoria, meta, with no more than `size` places in all.
    """
    free = dataclasses.replace(limits, recent=None)
    open_ = exclusions(candidates, free).filter("motivo is null")
    caps = [limits.recent + k for k in range(steps + 1)]
    counts = open_.groupBy("categoria").agg(*(F.count_if(F.col("recientes") < c).alias(f"n{c}") for c in caps))
    each = targets.join(counts, "categoria", "left").select("categoria", "meta", F.explode(F.array(*(F.struct(F.lit(c).alias("tope"), F.coalesce(f"n{c}", F.lit(0)).alias("n")) for c in caps))).alias("x")).select("categoria", "meta", "x.*")
    taken = F.least("n", "meta")
    each = each.withColumn("tomadas", taken).withColumn("total", F.sum("tomadas").over(Window.partitionBy("tope")))
    off = F.sum(F.abs(F.col("tomadas") / F.greatest("total", F.lit(1)) - F.col("meta") / size)) / 2
    by_cap = each.groupBy("tope").agg(F.sum("n").alias("elegibles"), F.sum("tomadas").alias("tamano"), F.round(off, 4).alias("disimilitud"), (F.sum("tomadas") >= F.least(F.sum("meta"), F.lit(size))).alias("alcanza"))
    w = Window.orderBy("tope")  # steps + 1 rows
    before = by_cap.withColumn("nadie", F.col("elegibles") == F.first("elegibles").over(w)).withColumn("ya", F.coalesce(F.max((F.col("alcanza") | (F.col("nadie") & (F.col("tope") > caps[0]))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offered = before.filter("ya = 0")
    names = F.when(F.col("tope") > caps[0], F.array(F.lit("aflojar_la_fatiga"))).when(~F.col("alcanza"), F.array(F.lit("reducir_el_tamano"), F.lit("aceptar_la_brecha"))).otherwise(F.array(F.lit("factible")))
    return offered.select(F.explode(names).alias("opcion"), "tope", "elegibles", "tamano", "disimilitud", "alcanza")


def optimised(eligible: DataFrame, targets: DataFrame, size: int, key: str, weights: Weights = Weights(), cap: int = 3) -> DataFrame:
    """The choice of a greedy optimiser that at each step takes the candidate of highest marginal score, and stops when no category lacks anyone.

    Closed form: within a category the costs of candidates are fixed and the gain of balance only falls as places are taken, so
    the greedy takes each category in the order of cost. The k-th of a category has the score it would have with k - 1
    taken; the `size` highest scores of all, among the first target-many of each category, are the choice. Scores are rounded so that equal
    ones tie as on paper; ties go to fewer recent and total calls, more answers, then the higher key.

    targets: categoria, meta (places). Only the best `meta` of a category are kept before the global order.
    """
    mean = eligible.agg(F.avg("totales")).scalar()
    cost = weights.fatigue * F.least(F.lit(1.0), F.col("recientes") / F.lit(max(1, cap))) + weights.equity * F.col("totales") / (1 + mean)
    tie = [F.asc("recientes"), F.asc("totales"), F.desc("respondidas"), F.desc(key)]
    costed = eligible.withColumn("costo", F.round(cost, 12)).join(F.broadcast(targets.select("categoria", "meta")), "categoria")
    within = Window.partitionBy("categoria").orderBy("costo", *tie)
    ranked = costed.withColumn("k", F.row_number().over(within)).filter(F.col("k") <= size).filter(F.col("k") <= F.col("meta"))
    deficit = F.col("meta") - F.col("k") + 1
    scored = ranked.withColumn("puntaje", F.round(weights.balance * (2 * deficit - 1) / F.lit(max(1, size)) - F.col("costo"), 12))
    return scored.orderBy(F.desc("puntaje"), *tie).limit(size).select(key, "categoria", "k", "puntaje")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many both samples have in common and each alone."""
    both = a.select(key, F.lit(1).alias("x")).join(b.select(key, F.lit(1).alias("y")), key, "full")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("ambos"), F.count_if(F.col("y").isNull()).alias("solo_a"), F.count_if(F.col("x").isNull()).alias("solo_b"))

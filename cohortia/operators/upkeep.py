"""Keeping tables in order: recognition of rows, erasure, marks, first touches, consolidation of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators.segments import first_reason


def erased(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables without the rows of the erased keys; tables that lack the key stay."""
    return {name: df.join(gone.select(key), key, "left_anti") if key in df.columns else df for name, df in tables.items()}


def orphans(units: DataFrame, answers: DataFrame, key: str = "hash") -> DataFrame:
    """Units that no answer has any more."""
    return units.join(answers.select(key), key, "left_anti")


def marked(df: DataFrame, listed: DataFrame, key: str, name: str) -> DataFrame:
    """df with a flag for keys on a list; nothing is hidden."""
    on = listed.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(on, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def first_touch(sends: DataFrame, keys: list[str], at: str, message: str) -> DataFrame:
    """(keys..., at, message): the first send to each key; equal times go to the lower message."""
    first = F.min(F.struct(at, message)).alias("x")
    return sends.groupBy(*keys).agg(first).select(*keys, f"x.{at}", f"x.{message}")


def listed_sends(sends: DataFrame, person: str, at: str, message: str) -> DataFrame:
    """(person, envios): each person's sends in order, as an array of (at, message)."""
    return sends.groupBy(person).agg(F.array_sort(F.collect_list(F.struct(at, message))).alias("envios"))


def by_priority(rows: DataFrame, keys: list[str], value: str, priority: list[str], tie: str) -> DataFrame:
    """One row per key: that of the value first in the list, values not listed last, then the lowest tie."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(value))
    rank = F.when(F.coalesce(place, F.lit(0)) == 0, len(priority) + 1).otherwise(place)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, tie))
    return rows.withColumn("__n", first).filter("__n = 1").drop("__n")


def consolidated(batches: DataFrame, job: str, order: str, sums: list[str], lists: list[str], firsts: list[str]) -> DataFrame:
    """One result per job: sums of numbers, distinct elements of lists, first values by order."""
    out = [F.sum(c).alias(c) for c in sums]
    out += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    out += [F.min_by(c, order).alias(c) for c in firsts]
    return batches.groupBy(job).agg(*out)


def progress(batches: DataFrame, job: str, state: str, cost: str, at: str, states: list[str]) -> DataFrame:
    """Batches of each job by state, cost, and seconds from first to last."""
    seconds = F.timestamp_diff("SECOND", F.min(at), F.max(at))
    return batches.groupBy(job).agg(*(F.count_if(F.col(state) == s).alias(s) for s in states), F.round(F.sum(cost), 4).alias("costo"), seconds.alias("segundos"))


def calibration(batches: DataFrame, order: Column, tokens: str, units: str, last: int = 200, least: int = 3) -> DataFrame:
    """(lotes, por_unidad): tokens per unit over the last batches; null if they are too few."""
    recent = batches.orderBy(order).limit(last)
    n = F.count(F.lit(1))
    return recent.agg(n.alias("lotes"), F.when(n >= least, F.round(F.round(F.sum(tokens), 4) / F.nullif(F.sum(units), F.lit(0)), 6)).alias("por_unidad"))


def recognised(rows: DataFrame) -> DataFrame:
    """rows with `clase` by the first layer that knows them. rows: con_datos, con_id, por_id, por_respuesta, por_datos (people found), dudoso."""
    classes = [
        ("existente", F.col("por_id").isNotNull()),
        ("id_desconocido", F.col("con_id")),
        ("reconocido", F.coalesce("por_respuesta", "por_datos").isNotNull()),
        ("revision", F.col("dudoso")),
        ("a_crear", F.col("con_datos")),
    ]
    return rows.withColumn("clase", F.coalesce(first_reason(classes), F.lit("sin_datos"))).withColumn("persona", F.coalesce("por_id", "por_respuesta", "por_datos"))


def deletable(created: DataFrame, blockers: dict[str, DataFrame], key: str) -> DataFrame:
    """created with `impide`: the first table, in the order given, that holds the person elsewhere; null: may be deleted."""
    out, reasons = created, []
    for name, df in blockers.items():
        out = marked(out, df, key, f"__{name}")
        reasons.append((name, F.col(f"__{name}")))
    return out.withColumn("impide", first_reason(reasons)).drop(*(f"__{n}" for n in blockers))


def unmapped_options(questions: DataFrame, options: str, mapping: str) -> DataFrame:
    """questions with `sin_mapa`: the codes of their options that the mapping lacks."""
    return questions.withColumn("sin_mapa", F.array_sort(F.array_except(F.map_keys(options), F.map_keys(mapping))))


def rounds(ranking: DataFrame, top: int, budget: int = 3) -> DataFrame:
    """Which units a verification in rounds judges, when verdicts are known: units by rank until `top` pertinent ones, at most budget * top.

    ranking: rango (from 1), pertinente. A round asks for as many units as are lacking, so the units judged are those up to the
    one that completes the number, a prefix of the ranking.
    """
    before = F.coalesce(F.sum(F.col("pertinente").cast("int")).over(Window.orderBy("rango").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = ranking.filter(F.col("rango") <= budget * top)  # bounded before the window over all
    return first.withColumn("__b", before).filter(F.col("__b") < top).drop("__b")

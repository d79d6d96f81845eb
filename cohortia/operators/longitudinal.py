"""Change over waves and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transitions(answers: DataFrame, first, second, wave: str, person: str, category: str) -> DataFrame:
    """(desde, hasta, personas): people by category in two waves; null where someone answered one only. One scan, by conditional aggregation."""
    both = answers.filter(F.col(wave).isin(first, second)).groupBy(person).agg(F.max(F.when(F.col(wave) == first, F.col(category))).alias("desde"), F.max(F.when(F.col(wave) == second, F.col(category))).alias("hasta"))
    return both.groupBy("desde", "hasta").agg(F.count(F.lit(1)).alias("personas"))


def timeline(facts: DataFrame, person: str, at: str, tie: str) -> DataFrame:
    """facts with `paso` (from 1) and days since the person's fact before."""
    w = Window.partitionBy(person).orderBy(F.asc_nulls_last(at), tie)
    days = F.date_diff(F.col(at).cast("date"), F.lag(at).over(w).cast("date"))
    return facts.withColumn("paso", F.row_number().over(w)).withColumn("dias", days)


def closed_intervals(changes: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """changes with `hasta`, the time of the next change of the key."""
    return changes.withColumn("hasta", F.lead(at).over(Window.partitionBy(*keys).orderBy(at, tie)))


def changed_between_loads(history: DataFrame, keys: list[str], value: str, load: str) -> DataFrame:
    """Number of loads and of different values of each key, and whether the value changed."""
    out = history.groupBy(*keys).agg(F.count_distinct(load).alias("cargas"), F.count_distinct(value).alias("valores"))
    return out.withColumn("cambio", F.col("valores") > 1)


def first_appearance(links: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """links with `vinculo`: primera for the first of each key, repetida for the rest."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return links.withColumn("vinculo", F.when(n == 1, "primera").otherwise("repetida"))


def revert_preview(history: DataFrame, keys: list[str], load: str, undone, value: str, at: str) -> DataFrame:
    """What undoing a load does to answers it wrote last: accion restaura with the value of the latest version left, or borra."""
    version = F.struct(at, load)
    other = F.col(load) != undone
    state = history.groupBy(*keys).agg(
        F.max_by(load, version).alias("ultima"),
        F.max_by(F.when(other, F.col(value)), F.when(other, version)).alias("anterior"),
        F.count_if(other).alias("otras"),
    )
    touched = state.filter(F.col("ultima") == undone)
    return touched.select(*keys, F.when(F.col("otras") > 0, "restaura").otherwise("borra").alias("accion"), "anterior")


def earlier_loads(links: DataFrame, person: str, load: str, at: str) -> DataFrame:
    """(load, reutilizados): how many people of each load were in an earlier one, by time and then load."""
    first = F.min(F.struct(F.col(at).alias("t"), F.col(load).alias("c"))).over(Window.partitionBy(person))
    marked = links.withColumn("primera", first)
    again = F.struct(F.col(at).alias("t"), F.col(load).alias("c")) > F.col("primera")
    return marked.groupBy(load).agg(F.count_distinct(F.when(again, F.col(person))).alias("reutilizados"), F.count_distinct(person).alias("personas"))

"""Participation of people in waves: rates, recency, concentration, fatigue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.expressions import call_band, ratio, recency_band, whole_days


def by_wave(facts: DataFrame) -> DataFrame:
    """Called, answered, rate, suspicious answers, first and last call of each wave. facts: ola, persona, convocado_en, respondio, calidad."""
    out = facts.groupBy("ola").agg(
        F.count(F.lit(1)).alias("convocados"),
        F.count_if("respondio").alias("respondieron"),
        F.count_if(F.col("calidad") == "sospechoso").alias("sospechosos"),
        F.min("convocado_en").alias("primero"),
        F.max("convocado_en").alias("ultimo"),
    )
    return out.withColumn("tasa", ratio(F.col("respondieron"), F.col("convocados")))


def profiles(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Calls, answers and last contact of each member, those never called included. members: persona."""
    counts = facts.groupBy("persona").agg(F.count(F.lit(1)).alias("n"), F.count_if("respondio").alias("r"), F.max("convocado_en").alias("ultimo_contacto"))
    return members.join(counts, "persona", "left").select("persona", F.coalesce("n", F.lit(0)).alias("convocatorias"), F.coalesce("r", F.lit(0)).alias("respuestas"), "ultimo_contacto")


def recency(profile: DataFrame, now: Column) -> DataFrame:
    """Members by time since the last contact and by number of calls, five and more together."""
    days = whole_days(now, F.col("ultimo_contacto"))
    return profile.groupBy(recency_band(days).alias("recencia"), call_band(F.col("convocatorias")).alias("llamados")).agg(F.count(F.lit(1)).alias("personas"))


def ranked(df: DataFrame, order: list[Column], buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """df with `puesto`, the place in a total order, without sorting all in one task: rows are sorted by ranges, numbered
    within them, and moved up by the sizes of the ranges before. Also the one-row count of df."""
    spread = df.repartitionByRange(buckets, *order).withColumn("__part", F.spark_partition_id())
    inner = Window.partitionBy("__part").orderBy(*order)
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = spread.withColumn("puesto", F.row_number().over(inner)).join(F.broadcast(before.drop("__n")), "__part")
    return out.withColumn("puesto", F.col("puesto") + F.col("__before")).drop("__part", "__before"), df.agg(F.count(F.lit(1)).alias("n"))


def upper_median(values: DataFrame, column: str, group: list[str]) -> DataFrame:
    """The element at place n // 2 (from 0) of the sorted values of each group, from the distribution of the distinct values."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("k"))
    up_to = Window.partitionBy(*group).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("k").over(Window.partitionBy(*group))
    placed = counts.withColumn("hasta", F.sum("k").over(up_to)).withColumn("lugar", F.floor(total / 2))
    return placed.filter((F.col("hasta") > F.col("lugar")) & (F.col("hasta") - F.col("k") <= F.col("lugar"))).select(*group, F.col(column).alias("mediana"))


def concentration(profile: DataFrame) -> DataFrame:
    """Share of all calls that the tenth of members with most calls has; the tenth is at least one member, rounded half to even.

    Members count by their number of calls; only in the last, cut class does the number of members matter, not who they are.
    """
    classes = profile.groupBy("convocatorias").agg(F.count(F.lit(1)).alias("k"))
    up_to = Window.orderBy(F.desc("convocatorias")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    head = F.greatest(F.lit(1), F.bround(0.1 * F.sum("k").over(every)).cast("long"))
    placed = classes.withColumn("cabeza", head).withColumn("hasta", F.sum("k").over(up_to)).withColumn("total", F.sum(F.col("convocatorias") * F.col("k")).over(every))
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("k"), F.col("cabeza") - F.col("hasta") + F.col("k")))
    return placed.agg(F.max("cabeza").alias("cabeza"), F.sum(taken * F.col("convocatorias")).alias("llamados"), F.max("total").alias("total")).withColumn("proporcion", ratio(F.col("llamados"), F.col("total")))


def fatigue(facts: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Calls of the last days, all calls, answers and last call of each person."""
    recent = F.col("convocado_en") >= now - F.make_interval(days=F.lit(days))
    return facts.groupBy("persona").agg(F.count_if(recent).alias("recientes"), F.count(F.lit(1)).alias("totales"), F.count_if("respondio").alias("respondidas"), F.max("convocado_en").alias("ultima"))


def dormant(profiles: DataFrame, key: str, most: int) -> DataFrame:
    """(key, ultimo_contacto, puesto): people that were called and never answered, those called longest ago first."""
    top = profiles.filter("convocatorias > 0 and respuestas = 0").select(key, "ultimo_contacto").orderBy("ultimo_contacto", key).limit(most)
    return top.withColumn("puesto", F.row_number().over(Window.orderBy("ultimo_contacto", key)))

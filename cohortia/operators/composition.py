"""Composition of populations against targets, cross tables and response by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.expressions import ratio

MISSING = "(sin dato)"
SMALL_BASE = 30


def observed(population: DataFrame, group: list[str], dimensions: list[str]) -> DataFrame:
    """(group..., dimension, categoria, n): people by category; null values are MISSING."""
    entries = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(MISSING)).alias("categoria")) for d in dimensions))
    return population.select(*group, F.explode(entries).alias("x")).groupBy(*group, "x.dimension", "x.categoria").agg(F.count(F.lit(1)).alias("n"))


def against_targets(counts: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """Observed and target categories with proportion over those with data, gap, expected, missing and surplus people.

    targets: group..., dimension, categoria, proporcion. Expected counts are of all people, those without data included.
    """
    place = [*group, "dimension"]
    over = Window.partitionBy(*place)
    joined = counts.join(targets, [*place, "categoria"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    known = F.sum(F.when(F.col("categoria") != MISSING, F.col("n")).otherwise(0)).over(over)
    all_people = F.sum("n").over(over)
    out = joined.withColumn("con_dato", known).withColumn("total", all_people).filter(F.col("categoria") != MISSING)
    out = out.withColumn("actual", F.when(F.col("con_dato") > 0, F.round(F.col("n") / F.col("con_dato"), 4)).otherwise(0.0))
    out = out.withColumn("esperados", F.bround(F.col("proporcion") * F.col("total")).cast("long"))
    return (
        out.withColumn("brecha", F.round(F.col("actual") - F.col("proporcion"), 4))
        .withColumn("faltan", F.greatest(F.lit(0).cast("long"), F.col("esperados") - F.col("n")))
        .withColumn("sobran", F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("esperados")))
    )


def dissimilarity(compared: DataFrame, group: list[str]) -> DataFrame:
    """Half the sum of absolute gaps of each dimension, summed in ten-thousandths, so that the order of rows doesn't tell; halves go up."""
    tenths = F.sum(F.round(F.abs(F.coalesce("brecha", F.lit(0.0))) * 10_000).cast("long"))
    return compared.groupBy(*group, "dimension").agg((F.floor((tenths + 1) / 2) / 10_000).alias("disimilitud"))


def cross_table(population: DataFrame, a: str, b: str) -> DataFrame:
    """Cells of two attributes with shares of row, column and all, and whether the column's base is small. People lacking either are left out."""
    cells = population.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    row, column, every = (F.sum("n").over(Window.partitionBy(*k)) for k in ([a], [b], []))
    return cells.select(
        a, b, "n", F.round(F.col("n") / row, 4).alias("pct_fila"), F.round(F.col("n") / column, 4).alias("pct_columna"), F.round(F.col("n") / every, 4).alias("pct_total"), column.alias("base"), (column < SMALL_BASE).alias("base_chica")
    )


def cross_matrix(population: DataFrame, a: str, b: str, columns: list[str]) -> DataFrame:
    """The counts as a matrix: rows by a, a column for each given value of b."""
    return population.filter(F.col(a).isNotNull()).groupBy(a).pivot(b, columns).agg(F.count(F.lit(1))).na.fill(0, columns)


def response_by_category(facts: DataFrame, category: str, called: Column, answered: Column) -> DataFrame:
    """Called and answered people by category with the rate."""
    counted = facts.groupBy(F.coalesce(F.col(category), F.lit(MISSING)).alias("categoria")).agg(F.count_if(called).alias("convocados"), F.count_if(called & answered).alias("respondieron"))
    return counted.withColumn("tasa", ratio(F.col("respondieron"), F.col("convocados")))


def invalid_targets(targets: DataFrame, group: list[str], tolerance: float = 0.005) -> DataFrame:
    """Dimensions whose proportions don't add up to 1 or leave [0, 1]."""
    sums = targets.groupBy(*group, "dimension").agg(F.round(F.sum("proporcion"), 6).alias("suma"), F.min("proporcion").alias("menor"), F.max("proporcion").alias("mayor"))
    return sums.filter((F.abs(F.col("suma") - 1) > tolerance) | (F.col("menor") < 0) | (F.col("mayor") > 1))

"""Checks of answers: speed, straight lines, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def speeder(duration: Column, threshold: float = 120) -> Column:
    """Whether the duration is below the threshold; null where none was measured."""
    return duration < threshold


def straight_lines(answers: DataFrame, by: list[str], value: str = "valor", items: int = 4, threshold: float = 0.25) -> DataFrame:
    """For each battery of a respondent with enough answers: whether they hardly vary. Numbers: population variance strictly below
    the threshold; otherwise all equal."""
    number = F.expr(f"try_cast({value} as double)")
    out = answers.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.var_pop(number), 6).alias("varianza"),
        F.count_if(number.isNull()).alias("no_numericos"),
        F.count_distinct(value).alias("distintos"),
    )
    flat = F.when(F.col("no_numericos") == 0, F.col("varianza") < threshold).otherwise(F.col("distintos") == 1)
    return out.filter(F.col("items") >= items).withColumn("plano", flat)


def same_content(answers: DataFrame, respondent: str, text: str) -> DataFrame:
    """Groups of respondents who gave the same texts the same number of times: huella, personas, primera.

    The print of a respondent is the number of texts and two sums over their hashes (96 bits), which don't depend on order and
    need no list of anyone's texts.
    """
    part = lambda at: F.sum(F.conv(F.substring(F.md5(text), at, 12), 16, 10).cast("decimal(20,0)"))
    prints = answers.filter(F.col(text).isNotNull()).groupBy(respondent).agg(F.concat_ws("-", F.count(F.lit(1)), part(1), part(13)).alias("huella"))
    return prints.groupBy("huella").agg(F.count(F.lit(1)).alias("personas"), F.min(respondent).alias("primera")).filter("personas > 1")


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with the count."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("veces")).filter("veces > 1")


def run(facts: DataFrame) -> DataFrame:
    """State and reasons of each fact: answered and unreviewed ones are judged, reviewed ones keep their state, the rest is pending.

    facts: respondio, revisado (state set by people or null), rapido, plano, copia (nullable flags).
    """
    flag = lambda name: F.when(F.coalesce(F.col(name), F.lit(False)), F.lit(name))
    reasons = F.concat_ws(",", flag("rapido"), flag("plano"), flag("copia"))
    automatic = F.when(~F.col("respondio"), "pendiente").when(reasons != "", "sospechoso").otherwise("ok")
    judged = F.col("revisado").isNull() & F.col("respondio")
    return facts.withColumn("estado", F.coalesce("revisado", automatic)).withColumn("motivos", F.when(judged, reasons).otherwise(F.lit("")))


def latest_kept(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the order given (the first of it)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")

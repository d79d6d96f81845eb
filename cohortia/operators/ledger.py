"""Append-only ledgers: balances and consumption of lots in due order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balances(movements: DataFrame, holder: str, amount: str) -> DataFrame:
    return movements.groupBy(holder).agg(F.round(F.coalesce(F.sum(amount), F.lit(0.0)), 2).alias("saldo"))


def expired(lots: DataFrame, balance: DataFrame, holder: str, amount: str, due: str, key: str) -> DataFrame:
    """(holder, key, descuento): what each due lot takes from the holder's balance, lots in order of due time, none below zero.

    Consuming one after the other equals a running sum: what is left of the balance after the lots before, at most the lot.
    """
    before = F.coalesce(F.sum(amount).over(Window.partitionBy(holder).orderBy(due, key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    joined = lots.join(balance, holder).withColumn("antes", before)
    taken = F.greatest(F.lit(0.0), F.least(F.col(amount), F.col("saldo") - F.col("antes")))
    return joined.select(holder, key, F.round(taken, 2).alias("descuento"))

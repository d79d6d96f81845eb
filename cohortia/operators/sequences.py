"""Neighbours in ordered groups, for groups of any size.

A group that holds very many rows is divided into consecutive ranges of its order, so that no task sorts it whole. Windows run within
the ranges; what crosses a range's edge comes from a table of the ranges' first or last rows. The rows of divided groups are
kept apart, in the shared folder, so that those tables don't read all rows again. Other groups use plain window functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators import skew
from cohortia.session import cut

RANGE = "__rango"
EDGE_BYTES = 200


@dataclass(frozen=True)
class Neighbours:
    """lead, lag and fill in groups given by keys, in the order of `order` (ascending, nulls first); of divided groups with `heavy`."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    heavy: skew.Heavy | None = None

    @property
    def group(self) -> list[str]:
        return [*self.keys, RANGE] if self.heavy else [*self.keys]

    def _window(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def _from_ranges(self, df: DataFrame, value, out: str, previous: bool, every: bool = False) -> DataFrame:
        """df with out filled from the nearest range before or after where it is null."""
        place = F.struct(*self.order)
        edge = (F.max_by if previous else F.min_by)(value, place)
        edges = df.filter(F.col(RANGE).isNotNull()).groupBy(*self.group).agg(edge.alias("edge"))
        by_range = Window.partitionBy(*self.keys).orderBy(RANGE)
        if every:
            beyond = F.last("edge", ignorenulls=True).over(by_range.rowsBetween(Window.unboundedPreceding, -1))
        else:
            beyond = (F.lag if previous else F.lead)("edge").over(by_range)
        edges = edges.select(*self.group, beyond.alias("beyond"))
        edges = self.heavy.side(edges, EDGE_BYTES, self.heavy.count * self.heavy.ranges)
        return df.join(edges, self.group, "left").withColumn(out, F.coalesce(out, "beyond")).drop("beyond")

    def lead(self, df: DataFrame, columns: list[str], out: str) -> DataFrame:
        """df with out: a struct of the columns of the next row, null at the end."""
        value = F.struct(*columns)
        df = df.withColumn(out, F.lead(value).over(self._window()))
        return self._from_ranges(df, value, out, False) if self.heavy else df

    def lag(self, df: DataFrame, columns: list[str], out: str) -> DataFrame:
        """df with out: a struct of the columns of the row before, null at the beginning."""
        value = F.struct(*columns)
        df = df.withColumn(out, F.lag(value).over(self._window()))
        return self._from_ranges(df, value, out, True) if self.heavy else df

    def fill(self, df: DataFrame, column: str) -> DataFrame:
        """df with nulls of the column replaced by the last value before."""
        up_to = self._window().rowsBetween(Window.unboundedPreceding, 0)
        filled = df.withColumn(column, F.last(column, ignorenulls=True).over(up_to))
        return self._from_ranges(filled, F.col(column), column, True, every=True) if self.heavy else filled


def divided(df: DataFrame, keys: list[str], order: tuple[str, ...], floor: int = skew.FLOOR) -> list[tuple[DataFrame, Neighbours]]:
    """df in one or two parts, each distributed by its groups and with RANGE: the usual groups (null), and those divided by the first, numeric column of order."""
    none = F.lit(None).cast("int")
    heavy = skew.heavy_keys(df, keys, floor)
    if heavy is None:
        return [(df.withColumn(RANGE, none).repartition(*keys), Neighbours((*keys,), order))]
    large = cut(heavy.only(df))
    bounds = heavy.side(skew.range_bounds(large, keys, order[0], heavy.ranges), 8 * heavy.ranges)
    marked = large.join(bounds, keys).withColumn(RANGE, skew.range_of("bounds", F.col(order[0]))).drop("bounds")
    return [
        (heavy.without(df).withColumn(RANGE, none).repartition(*keys), Neighbours((*keys,), order)),
        (marked.repartition(*keys, RANGE), Neighbours((*keys,), order, heavy)),
    ]

"""Detection of heavy keys and their division into ranges.

Heavy keys are all keys with more than `floor` rows. They are found by one aggregation and kept as a table, as their number grows with the data;
it is broadcast only if its counted size allows that. The number of ranges grows with the largest of them, up to MOST_RANGES.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.session import cut

FLOOR, RANGES, MOST_RANGES = 20_000, 64, 4_096
BROADCAST_BYTES = 32 * 2**20


@dataclass(frozen=True)
class Heavy:
    """Heavy keys: `table` has the keys and their counts `n`."""

    table: DataFrame
    keys: tuple[str, ...]
    count: int
    largest: int
    key_bytes: int
    ranges: int

    def side(self, df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
        """df, which has at most `rows` rows (one per heavy key if not given) of row_bytes beside the keys; marked for broadcast if that is small."""
        rows = self.count if rows is None else rows
        return F.broadcast(df) if rows * (row_bytes + self.key_bytes // self.count + 16) <= BROADCAST_BYTES else df

    def only(self, df: DataFrame) -> DataFrame:
        return df.join(self.side(self.table.select(*self.keys), 8), [*self.keys], "left_semi")

    def without(self, df: DataFrame) -> DataFrame:
        return df.join(self.side(self.table.select(*self.keys), 8), [*self.keys], "left_anti")


def heavy_keys(df: DataFrame, keys: list[str], floor: int = FLOOR) -> Heavy | None:
    """The keys of df with more than floor rows; None if there are none. Null keys count as others."""
    counts = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > floor))
    width = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0))
    known = counts.agg(F.count(F.lit(1)).alias("count"), F.max("n").alias("largest"), F.sum(width).alias("bytes")).first()
    if not known["count"]:
        return None
    return Heavy(counts, tuple(keys), known["count"], known["largest"], known["bytes"], max(RANGES, min(MOST_RANGES, known["largest"] // FLOOR)))


def range_bounds(df: DataFrame, keys: list[str], order: str, ranges: int = RANGES) -> DataFrame:
    """For each key the ascending quantiles of `order` that divide its rows: keys..., `bounds` array of less than `ranges` values."""
    points = [i / ranges for i in range(1, ranges)]
    return df.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(order), points, max(10_000, 4 * ranges)))).alias("bounds"))


def range_of(bounds: str, value) -> F.Column:
    """Number of the bounds at or below the value; null values belong to range 0."""
    return F.coalesce(F.size(F.filter(F.col(bounds), lambda b: b <= value)), F.lit(0))

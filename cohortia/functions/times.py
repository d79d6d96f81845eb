"""Times without zone as numbers and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp, whatever its kind; independent of the session's zone for times without one."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(F.col(name))
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")


def text_of(time: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss, or - for null."""
    return F.coalesce(F.substring(time.cast("string"), 1, 19), F.lit("-"))

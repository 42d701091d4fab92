"""Times as numbers, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(time: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970.  A time without a zone is counted as it stands, so that a change of the clock doesn't move it."""
    if isinstance(kind, T.TimestampNTZType):
        since = time - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")
    return F.unix_micros(time.cast("timestamp"))

"""Time columns as plain seconds, whatever their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double seconds; timestamps are read in the session zone (UTC)."""
    kind = df.schema[name].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp")) / 1e6
    return F.col(name).cast("double")

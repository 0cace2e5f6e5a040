"""Missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(value: Column) -> Column:
    """NaN means missing; in a panel missing is NULL."""
    return F.when(~F.isnan(value), value)

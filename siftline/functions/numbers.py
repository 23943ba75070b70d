"""Numbers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many digits, by its binary value; Spark's round goes by its shortest decimal form, so
    that 0.14275, which is stored as a little less, would become 0.1428."""
    scale = 10.0**digits
    up = F.floor(F.abs(x) * scale + 0.5) / scale
    return F.when(x < 0, -up).otherwise(up)

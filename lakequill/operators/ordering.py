"""Sort keys with the null placement of the SQL dialect served: ascending nulls last, descending nulls first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def asc(c: Column | str) -> Column:
    return _column(c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    return _column(c).desc_nulls_first()

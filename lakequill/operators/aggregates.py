"""Ordered and JSON aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_agg(value: Column, order: Column | None = None) -> Column:
    """Values in order, nulls dropped; null for no rows."""
    kept = F.collect_list(F.when(value.isNotNull(), F.struct((value if order is None else order).alias("k"), value.alias("v"))))
    return F.when(F.size(kept) > 0, F.transform(F.array_sort(kept), lambda x: x["v"]))


def json_agg(value: Column, order: Column) -> Column:
    """JSON array text, nulls kept, null for no rows."""
    kept = F.array_sort(F.collect_list(F.struct(order.alias("k"), value.alias("v"))))
    items = F.transform(kept, lambda x: F.coalesce(F.to_json(F.struct(x["v"].alias("v")), {"ignoreNullFields": "false"}), F.lit("")))
    return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(F.transform(items, lambda s: F.substring(s, F.lit(6), F.length(s) - 6)), ","), F.lit("]")))


def json_object_agg(key: Column, value: Column) -> Column:
    """JSON object text by rising key; null keys dropped, null for no rows."""
    kept = F.array_sort(F.collect_list(F.when(key.isNotNull(), F.struct(key.cast("string").alias("key"), value.alias("value")))))
    return F.when(F.size(kept) > 0, F.to_json(F.map_from_entries(kept)))


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))

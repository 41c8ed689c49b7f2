"""Window frames that Spark has no syntax for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.sources.copy import staging_path


def over_groups(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, **aggregates: Column) -> DataFrame:
    """Aggregates over a GROUPS frame from ``start`` to ``end`` peer groups away.

    Peer groups are numbered by dense_rank, and the frame is a RANGE over the
    numbers; both windows share one exchange and, within it, the partitioning.
    """
    numbered = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy("_group").rangeBetween(start, end)
    return numbered.withColumns({name: a.over(w) for name, a in aggregates.items()}).drop("_group")


def prefix_totals(df: DataFrame, order: list[Column], values: list[str], name: str = "totals") -> DataFrame:
    """``df`` with ``<value>_before``: the sum of each value over all rows that sort before, ``order`` being unique.

    Rows are dealt by range and written, so that their ranges stand; a range sums
    its own rows, and what precedes it is summed over one row for each range.
    """
    spark, path = df.sparkSession, staging_path(df.sparkSession, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(*before)
    per = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    along = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(*before)  # one row for each range
    offsets = per.select("_part", *[F.coalesce(F.sum(f"_{v}").over(along), F.lit(0)).alias(f"_{v}") for v in values])
    local = placed.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    out = local.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, *[(F.col(f"{v}_before") + F.col(f"_{v}")).cast("bigint").alias(f"{v}_before") for v in values])


def global_ranks(df: DataFrame, keys: dict[str, Callable[[str], Column]], rank: str = "rank", dense: str = "dense_rank") -> DataFrame:
    """rank and dense_rank over the whole table, without a window of all rows in one task.

    ``keys`` are columns with their order (``asc`` or ``desc``).  Rows are counted
    for each key before the shuffle, the distinct keys take prefix sums over ranges, and
    rows meet their key's rank by an equality join.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    counts = df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count("*").alias("_rows"), F.lit(1).alias("_one"))
    placed = prefix_totals(counts, [order(n) for n, order in zip(names, keys.values(), strict=True)], ["_rows", "_one"], "ranks")
    meets = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        meets = meets & F.col(f"`{k}`").eqNullSafe(F.col(n))
    joined = df.join(placed, meets)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_rows_before") + 1).alias(rank), (F.col("_one_before") + 1).alias(dense))

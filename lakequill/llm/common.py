"""Shared tables, prefix sums and components for the corpus operators."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where none is set."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lakequill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Workspace:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    They are deleted by :meth:`drop`, or when the driver's process ends, as the
    DataFrames that read them are lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.number = itertools.count()
        atexit.register(self._end)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{next(self.number)}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._kept_at)

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # Spark has gone already; the folder's owner clears it
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(ws: Workspace, df: DataFrame, order: list[Column], values: list[str], name: str) -> DataFrame:
    """``df`` with ``<value>_before``: the sum of each value over all rows that sort before.

    Rows are dealt by range; a partition sums its own rows, and what precedes a
    partition is summed over one row per partition.
    """
    sums = [f"{v}_before" for v in values]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), [0] * len(values)
        for b in batches:
            columns = list(b.columns)
            for i, v in enumerate(values):
                x = b.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
                columns.append(pa.array(np.cumsum(x) - x + so_far[i]))
                so_far[i] += int(x.sum())
            columns.append(pa.array(np.full(b.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *sums, "_part"])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{s}` bigint" for s in sums] + ["_part int"])
    n = min(partitions(df.sparkSession), 64)
    placed = ws.keep(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(local, fields), name)
    w = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(v).cast("bigint").alias(f"_{v}") for v in values])
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{v}").over(w), F.lit(0)).alias(f"_{v}") for v in values])
    out = placed.join(F.broadcast(offsets), "_part")  # at most 64 rows
    return out.select(*df.columns, *[(F.col(s) + F.col(f"_{v}")).alias(s) for s, v in zip(sums, values, strict=True)])


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, comp), comp the least node.

    Each round takes the least label among the neighbours and then follows the
    label's own label, so a path halves in a round; rounds end when no label
    changes.  No row holds a neighbour list, so a hub costs rows, not memory.
    """
    both = ws.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = ws.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), f"{name}-0")
    for i in itertools.count(1):
        of = labels.select(F.col("node").alias("b"), "comp")
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        hop = labels.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        new = ws.keep(step.join(hop, "to").select("node", F.least("to", "next").alias("comp"), "was"), f"{name}-{i}")
        changed = new.filter("comp <> was").limit(1).count()
        ws.drop(labels)
        labels = new.select("node", "comp")
        labels._kept_at = new._kept_at
        if not changed:
            ws.drop(both)
            return labels


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys (integers without nulls), across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in keys], 1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        for i, j in itertools.pairwise([0, *cuts.tolist(), b.num_rows]):
            if held and tuple(k[i]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = tuple(k[i])
    if held:
        yield pa.Table.from_batches(held)

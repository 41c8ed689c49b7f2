"""COPY to and from delimited files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# What stands for null and for the separator in the two formats.
FORMATS = {"csv": {"sep": ",", "nullValue": ""}, "text": {"sep": "\t", "nullValue": "\\N"}}


def copy_to(df: DataFrame, path: str, form: str = "csv", header: bool = False, delimiter: str | None = None) -> None:
    options = FORMATS[form] | ({"sep": delimiter} if delimiter else {})
    df.write.mode("overwrite").options(header=header, emptyValue='""', timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", **options).csv(path)


def copy_from(spark: SparkSession, path: str, schema: StructType | str, form: str = "csv", header: bool = False, delimiter: str | None = None) -> DataFrame:
    options = FORMATS[form] | ({"sep": delimiter} if delimiter else {})
    return spark.read.schema(schema).options(header=header, mode="FAILFAST", timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", **options).csv(path)


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lakequill-staging-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in local mode, where none is set, one that ends with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

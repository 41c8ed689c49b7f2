"""Tables of a folder of Parquet files, as DataFrames and as views for SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, args: dict | None = None) -> DataFrame:
    """Run SQL text over the folder; only tables that the text names are opened."""
    for name in NAMES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text, args=args) if args else spark.sql(text)


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table_name, column_name, ordinal_position) of the given tables, as information_schema.columns has them."""
    rows = [(t, f.name, i) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position bigint")

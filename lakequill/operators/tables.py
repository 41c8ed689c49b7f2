"""Declared tables as plans: defaults, generated columns, constraints, domains, sequences and index layouts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import insert_rows
from .windows import prefix_totals


def require(df: DataFrame, test: Column, message: str) -> DataFrame:
    """``df``; reading a row for which ``test`` is false is an error (null passes)."""
    return df.filter(F.when(test == F.lit(False), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def require_unique(df: DataFrame, keys: list[Column], message: str) -> DataFrame:
    """``df``; two rows with equal keys, none of them null, are an error."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & k.isNotNull()
    numbered = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    return require(numbered, (F.col("_nth") == 1) | ~whole, message).drop("_nth")


@dataclass(frozen=True)
class Domain:
    """CREATE DOMAIN: a type with a check on its values."""

    name: str
    type: str
    check: Callable[[Column], Column] = lambda value: F.lit(True)
    not_null: bool = False

    def cast(self, value: Column) -> Column:
        """The value in the domain; an error where the check is false, or for a null that isn't allowed."""
        typed = value.cast(self.type)
        wrong = (self.check(typed) == F.lit(False)) | (typed.isNull() if self.not_null else F.lit(False))
        return F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit(f"value for domain {self.name} violates its check")).cast(self.type)).otherwise(typed)


@dataclass(frozen=True)
class Field:
    """A column of a table: its type or domain, DEFAULT, NOT NULL, or GENERATED ALWAYS AS (SQL) STORED."""

    name: str
    type: str | Domain
    default: Column | None = None
    not_null: bool = False
    generated: str | None = None


@dataclass(frozen=True)
class Table:
    """CREATE TABLE: columns, PRIMARY KEY, UNIQUE keys and named CHECKs (SQL)."""

    fields: tuple[Field, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)

    def empty(self, spark: SparkSession) -> DataFrame:
        kinds = [f.type.type if isinstance(f.type, Domain) else f.type for f in self.fields]
        return spark.createDataFrame([], ", ".join(f"`{f.name}` {kind}" for f, kind in zip(self.fields, kinds, strict=True)))

    def insert(self, target: DataFrame, rows: DataFrame) -> DataFrame:
        """``target`` with ``rows``: defaults and generated columns filled in; a row that breaks a constraint is an error when it is read."""
        made = insert_rows(target.limit(0), rows.drop(*[f.name for f in self.fields if f.generated]), {f.name: f.default for f in self.fields if f.default is not None})
        made = made.withColumns({f.name: f.type.cast(F.col(f.name)) for f in self.fields if isinstance(f.type, Domain)}) if any(isinstance(f.type, Domain) for f in self.fields) else made
        for f in self.fields:
            if f.generated:
                made = made.withColumn(f.name, F.expr(f.generated).cast(target.schema[f.name].dataType))
        for f in self.fields:
            if f.not_null or f.name in self.primary_key:
                made = require(made, F.col(f"`{f.name}`").isNotNull(), f"null value in column {f.name} violates not-null constraint")
        for name, test in self.checks.items():
            made = require(made, F.expr(test), f"new row violates check constraint {name}")
        out = target.unionByName(made)
        for keys in (*((self.primary_key,) if self.primary_key else ()), *self.unique):
            out = require_unique(out, [F.col(f"`{k}`") for k in keys], f"duplicate key value violates unique constraint on {', '.join(keys)}")
        return out


def nextval(df: DataFrame, order: list[Column], name: str = "nextval", start: int = 1, step: int = 1) -> DataFrame:
    """``df`` with the values of a sequence by ``order`` (unique), without gaps and without all rows in one task."""
    numbered = prefix_totals(df.withColumn("_one", F.lit(1)), order, ["_one"], "sequence")
    return numbered.withColumn(name, F.lit(start).cast("bigint") + F.col("_one_before") * step).drop("_one", "_one_before")


def currval(df: DataFrame, name: str = "nextval") -> DataFrame:
    """The value that the sequence gave last; null before any."""
    return df.agg(F.max(name).alias("currval"))


def index_layout(df: DataFrame, path: str, keys: dict[str, Column], unique: bool = False) -> DataFrame:
    """CREATE [UNIQUE] INDEX as layout: rows dealt by range of the keys (columns or expressions, kept under their names), sorted and written.

    Filters on the keys skip files and row groups by their statistics.
    """
    made = df.withColumns(keys)
    if unique:
        made = require_unique(made, [F.col(k) for k in keys], f"could not create unique index on {', '.join(keys)}")
    made.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
    return df.sparkSession.read.parquet(path)

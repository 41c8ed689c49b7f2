"""Relational operators that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.sources.copy import staging_path


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def compare_all(df: DataFrame, value: str, op: str, values: DataFrame) -> DataFrame:
    """``df`` with column verdict: value op ALL (values), with the null rules of SQL.

    For < <= > >= only the least or greatest of ``values``, whether one is null
    and whether any is there matter; for = and <> also both ends, or whether
    the value is among them.  So the set shrinks to one row, but for <>, which joins.
    """
    if op == "<>":
        return _member(df, value, values, found=False)
    return _compare(df, value, op, values, every=True)


def compare_any(df: DataFrame, value: str, op: str, values: DataFrame) -> DataFrame:
    """``df`` with column verdict: value op ANY (values), with the null rules of SQL; = joins, the others see one row."""
    if op == "=":
        return _member(df, value, values, found=True)
    return _compare(df, value, op, values, every=False)


def _summary(values: DataFrame) -> DataFrame:
    v = F.col(f"`{values.columns[0]}`")
    return values.agg(F.struct(F.count("*").alias("n"), F.count(v).alias("known"), F.min(v).alias("least"), F.max(v).alias("most")).alias("_set"))


def _verdict(df: DataFrame, decided: Column, every: bool) -> DataFrame:
    """The verdict from that on the known values; the first that settles it wins, then nulls make it unknown."""
    s = F.col("_set")
    decided = F.when(s["known"] > 0, decided)
    settled = F.when(decided == F.lit(not every), F.lit(not every))
    verdict = F.when(s["n"] == 0, F.lit(every)).otherwise(F.coalesce(settled, F.when(s["known"] == s["n"], decided)))
    return df.withColumn("verdict", verdict).drop("_set")


def _compare(df: DataFrame, value: str, op: str, values: DataFrame, every: bool) -> DataFrame:
    s, x = F.col("_set"), F.col(value)
    edge = s["least"] if (op in ("<", "<=")) == every else s["most"]
    tests = {"<": x < edge, "<=": x <= edge, ">": x > edge, ">=": x >= edge, "=": (x == s["least"]) & (x == s["most"]), "<>": (x != s["least"]) | (x != s["most"])}
    return _verdict(df.crossJoin(F.broadcast(_summary(values))), tests[op], every)  # one row


def _member(df: DataFrame, value: str, values: DataFrame, found: bool) -> DataFrame:
    """= ANY (found) and <> ALL: one join with the distinct values."""
    known = values.select(F.col(f"`{values.columns[0]}`").alias("_value")).dropna().distinct()
    joined = df.join(known, F.col(value) == F.col("_value"), "left").crossJoin(F.broadcast(_summary(values)))
    decided = F.when(F.col(value).isNotNull(), F.col("_value").isNotNull() == F.lit(found))
    return _verdict(joined.withColumn("_decided", decided), F.col("_decided"), not found).drop("_value", "_decided")


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs with start <= at < end, by an equality join on bins of ``width``: no pair of bins is compared in full.

    A span is repeated once for each bin that it touches.
    """
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    s = spans.filter(F.col(start) < F.col(end))
    s = s.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.ceil(F.col(end) / width) - 1)))
    return p.join(s, "_bin").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1_000_000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rounds on the new rows only, duplicates dropped, until none is new.

    Each round's rows are written to the shared folder, which cuts lineage.
    """
    spark, root = seed.sparkSession, staging_path(seed.sparkSession, "recursive")
    new = seed.distinct()
    for i in count():
        if i > most:
            raise RuntimeError(f"no end of the recursion after {most} rounds")
        new.write.parquet(f"{root}/round={i}")
        new = spark.read.schema(seed.schema).parquet(f"{root}/round={i}")
        if not new.limit(1).count():
            break
        seen = spark.read.schema(seed.schema).parquet(*[f"{root}/round={k}" for k in range(i + 1)])
        new = step(new).select(*seed.columns).distinct().subtract(seen)
    return spark.read.schema(seed.schema).parquet(*[f"{root}/round={k}" for k in range(i + 1)])


def insert_rows(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``target`` with ``rows``; columns that the rows lack take their default or null."""
    defaults = defaults or {}
    lacking = [c for c in target.columns if c not in rows.columns]
    filled = rows.withColumns({c: defaults.get(c, F.lit(None)).cast(target.schema[c].dataType) for c in lacking}) if lacking else rows
    return target.unionByName(filled.select(*target.columns))


def _first_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the least by its other columns; rows with a null in their key are apart from all."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    others = [F.col(f"`{c}`") for c in rows.columns if c not in keys]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*others or [F.lit(0)]))
    return rows.withColumn("_number", F.when(whole, number).otherwise(1)).filter("_number = 1").drop("_number")


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows whose key is new, one of each key (the least by its other columns); a key with a null never conflicts."""
    return target.unionByName(_first_of_each(rows, keys).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Callable[[Column, Column], Column]], where: Callable[[DataFrame, DataFrame], Column] | None = None) -> DataFrame:
    """ON CONFLICT (keys) DO UPDATE: one full join; ``update`` gets the old value and the excluded one.

    Two of ``rows`` with one key are an error, as a row can't be changed twice; a
    key with a null never conflicts.
    """
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) > 1
    for k in keys:
        again = again & F.col(k).isNotNull()
    twice = F.when(F.col("_again"), F.raise_error(F.lit("ON CONFLICT DO UPDATE can't affect a row a second time")).cast("boolean")).otherwise(F.lit(True))
    rows = rows.withColumn("_again", again).filter(twice).drop("_again")
    old, new = target.alias("old"), rows.withColumn("_new", F.lit(True)).alias("new")
    joined = old.withColumn("_old", F.lit(True)).alias("old").join(new, keys, "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        was, excluded = F.col(f"old.{c}"), F.col(f"new.{c}") if c in rows.columns else F.lit(None)
        changed = update[c](was, excluded) if c in update else was
        both = F.col("_old") & F.col("_new")
        if where:
            both = both & F.coalesce(where(old, new), F.lit(False))
        out.append(F.when(F.col("_old").isNull() & F.col("_new"), excluded).when(both, changed).otherwise(was).alias(c))
    return joined.select(*out)


class Change(NamedTuple):
    """A statement's outcome: the table after it, and what RETURNING tells of the rows it touched."""

    table: DataFrame
    returning: DataFrame


def insert_returning(target: DataFrame, rows: DataFrame, returning: list[Column], defaults: dict[str, Column] | None = None) -> Change:
    """INSERT ... RETURNING: expressions over the new rows, defaults filled in."""
    return Change(insert_rows(target, rows, defaults), insert_rows(target.limit(0), rows, defaults).select(*returning))


def update_returning(target: DataFrame, values: dict[str, Column], where: Column, returning: list[Column]) -> Change:
    """UPDATE ... RETURNING: expressions over the new values of the rows that changed."""
    hit = target.filter(F.coalesce(where, F.lit(False)))
    return Change(update_rows(target, values, where), update_rows(hit, values, F.lit(True)).select(*returning))


def delete_returning(target: DataFrame, where: Column, returning: list[Column]) -> Change:
    """DELETE ... RETURNING: expressions over the rows that went."""
    return Change(delete_rows(target, where), target.filter(F.coalesce(where, F.lit(False))).select(*returning))


def delete_using_returning(target: DataFrame, source: DataFrame, keys: list[str], returning: list[Column]) -> Change:
    """DELETE ... USING ... RETURNING, each row once."""
    return Change(delete_using(target, source, keys), target.join(source.select(*keys), keys, "left_semi").select(*returning))


def update_rows(target: DataFrame, values: dict[str, Column], where: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, values[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """UPDATE ... FROM: rows that meet a source row (columns not in target) take the values; of several source rows the least by its columns."""
    joined = target.join(_first_of_each(source, keys).withColumn("_hit", F.lit(True)), keys, "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def delete_rows(target: DataFrame, where: Column) -> DataFrame:
    return target.filter(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source.select(*keys), keys, "left_anti")


def violations(df: DataFrame, *, not_null: list[str] = (), unique: list[list[str]] = (), checks: dict[str, Column] | None = None, foreign: dict[str, tuple[list[str], DataFrame, list[str]]] | None = None) -> DataFrame:
    """One row (kind, name, n) for each constraint, n the number of rows that break it."""
    parts = []

    def add(kind: str, name: str, bad: DataFrame) -> None:
        parts.append(bad.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n"))

    for c in not_null:
        add("not_null", c, df.filter(F.col(c).isNull()))
    for keys in unique:
        add("unique", ",".join(keys), df.dropna(subset=keys).groupBy(*keys).count().filter("count > 1"))
    for name, test in (checks or {}).items():
        add("check", name, df.filter(~test))  # null passes
    for name, (own, other, theirs) in (foreign or {}).items():
        on = [df[a] == other[b] for a, b in zip(own, theirs, strict=True)]
        add("foreign", name, df.dropna(subset=own).join(other, on, "left_anti"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile(df: DataFrame) -> DataFrame:
    """ANALYZE: one row for each column with its rows, nulls, distinct values, least and greatest, in one pass."""
    fields = [f.name for f in df.schema.fields]
    aggs = [a for c in fields for a in (F.count(c).alias(f"n_{c}"), F.countDistinct(c).alias(f"d_{c}"), F.min(c).cast("string").alias(f"l_{c}"), F.max(c).cast("string").alias(f"g_{c}"))]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("n_rows"), (F.col("rows") - F.col(f"n_{c}")).alias("n_nulls"), F.col(f"d_{c}").alias("n_distinct"), F.col(f"l_{c}").alias("least"), F.col(f"g_{c}").alias("greatest")) for c in fields])
    return one.select(F.inline(each))

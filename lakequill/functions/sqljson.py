"""SQL/JSON: JSON_VALUE, JSON_QUERY, JSON_SERIALIZE, constructors, and JSON_TABLE as an operator on DataFrames.

Paths are evaluated in Arrow batches; types, defaults and errors are left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsonpath import Path, dump, parse

#: ON EMPTY and ON ERROR: null, an error, or (as any other value) a default.
NULL, ERROR = "null on", "error on"


def _plain(x: Any) -> str | None:
    """A JSON value as SQL text: strings without quotes, null as null."""
    return None if x is None else x if isinstance(x, str) else dump(x)


def _cells(f, kind: str):
    """``f`` over parsed documents; null for null and malformed ones."""

    @F.pandas_udf(kind)
    def apply(docs: pd.Series) -> pd.Series:
        out = []
        for x in docs:
            try:
                out.append(None if x is None else f(parse(x)))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return apply


def _cell(found: list, scalar: bool) -> str | None:
    """What a path found, in one text: e for nothing, x for what is no single scalar if one is asked for, v and the value, null for JSON null."""
    if not found:
        return "e"
    if scalar and (len(found) > 1 or isinstance(found[0], (dict, list))):
        return "x"
    return None if found[0] is None else "v" + _plain(found[0])


def _otherwise(what: Any, kind: str, why: str) -> Column:
    if what is ERROR:
        return F.raise_error(F.lit(why)).cast(kind)
    return F.lit(None if what is NULL else what).cast(kind)


def _typed(cell: Column, kind: str, on_empty: Any, on_error: Any) -> Column:
    state, text = F.substring(cell, 1, 1), F.substr(cell, F.lit(2))
    value = text if kind == "string" else text.try_cast(kind)
    wrong = (state == "x") | ((state == "v") & value.isNull())
    return F.when(state == "e", _otherwise(on_empty, kind, "no SQL/JSON item")).when(wrong, _otherwise(on_error, kind, "SQL/JSON item of another type")).otherwise(value)


def json_value(doc: Column, path: str, returning: str = "string", on_empty: Any = NULL, on_error: Any = NULL, variables: dict | None = None) -> Column:
    """JSON_VALUE(doc, path RETURNING type ... ON EMPTY ... ON ERROR): a scalar; JSON null is null."""
    run = Path(path)
    return _typed(_cells(lambda d: _cell(run(d, variables), True), "string")(doc), returning, on_empty, on_error)


def json_query(doc: Column, path: str, wrapper: bool = False, on_empty: Any = NULL, variables: dict | None = None) -> Column:
    """JSON_QUERY(doc, path [WITH WRAPPER] ... ON EMPTY): JSON text; several items are an array with and without wrapper."""
    run = Path(path)

    def query(d: Any) -> str:
        found = run(d, variables)
        return "v" + dump(found if len(found) > 1 or wrapper and found else found[0]) if found else "e"

    return _typed(_cells(query, "string")(doc), "string", on_empty, ERROR)


def json_serialize(doc: Column) -> Column:
    """JSON_SERIALIZE: the document's text in normal form."""
    return _cells(dump, "string")(doc)


def json_object(absent_on_null: bool = False, unique_keys: bool = False, **members: Column) -> Column:
    """JSON_OBJECT(key VALUE value, ... {NULL | ABSENT} ON NULL [WITH UNIQUE KEYS]); names can't repeat, but for case where keys are to be unique."""
    if unique_keys and len({k.lower() for k in members}) < len(members):
        raise ValueError("duplicate JSON object key")
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]), {"ignoreNullFields": str(absent_on_null).lower()})


def json_array(*items: Column, null_on_null: bool = False) -> Column:
    """JSON_ARRAY(item, ... {ABSENT | NULL} ON NULL): items of any types."""
    texts = [F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}) for x in items]
    parts = [F.when(x.isNotNull() | F.lit(null_on_null), F.substring(t, F.lit(6), F.length(t) - 6)) for x, t in zip(items, texts, strict=True)]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


@dataclass(frozen=True)
class Item:
    """A column of JSON_TABLE: ``name type PATH path DEFAULT ... ON EMPTY DEFAULT ... ON ERROR``; type json keeps JSON text (FORMAT JSON)."""

    name: str
    type: str = "string"
    path: str = ""
    on_empty: Any = NULL
    on_error: Any = ERROR


@dataclass(frozen=True)
class Exists:
    """``name boolean EXISTS PATH path``."""

    name: str
    path: str


@dataclass(frozen=True)
class Ordinality:
    """``name FOR ORDINALITY``: from 1 in each parent."""

    name: str


@dataclass(frozen=True)
class Nested:
    """``NESTED PATH path COLUMNS (...)``: a row without matches goes; siblings multiply."""

    path: str
    columns: tuple


def _leaves(columns: tuple) -> Iterator[Item | Exists | Ordinality]:
    for c in columns:
        if isinstance(c, Nested):
            yield from _leaves(c.columns)
        else:
            yield c


def _compiled(columns: tuple) -> list[tuple[str, Any, Any]]:
    out = []
    for c in columns:
        if isinstance(c, Nested):
            out.append(("nested", Path(c.path), _compiled(c.columns)))
        elif isinstance(c, Ordinality):
            out.append(("number", None, None))
        else:
            path = c.path or f"$.{dump(c.name)}"
            out.append(("exists" if isinstance(c, Exists) else "json" if c.type == "json" else "item", Path(path), None))
    return out


def _rows(element: Any, number: int, columns: list) -> list[list[str | None]]:
    rows: list[list[str | None]] = [[]]
    for what, path, inner in columns:
        if what == "nested":
            more = [r for i, x in enumerate(path(element), 1) for r in _rows(x, i, inner)]
            rows = [a + b for b in more for a in rows]
            continue
        if what == "number":
            cell = f"v{number}"
        else:
            found = path(element)
            cell = f"v{bool(found)}".lower() if what == "exists" else ("v" + dump(found[0]) if found else "e") if what == "json" else _cell(found, False)
        rows = [r + [cell] for r in rows]
    return rows


def json_table(df: DataFrame, doc: Column, path: str, *columns: Item | Exists | Ordinality | Nested) -> DataFrame:
    """``df, LATERAL JSON_TABLE(doc, path COLUMNS (...))``: the columns of ``df`` and those named.

    ``$`` in the path of a column is the row's element.  Null and malformed
    documents, and those where ``path`` finds nothing, give no rows.
    """
    run, compiled, leaves = Path(path), _compiled(columns), list(_leaves(columns))
    rows = _cells(lambda d: [r for i, x in enumerate(run(d), 1) for r in _rows(x, i, compiled)], "array<array<string>>")(doc)
    out = []
    for i, c in enumerate(leaves):
        cell = F.col("_json_table_row")[i]
        if isinstance(c, Item):
            out.append(_typed(cell, "string" if c.type == "json" else c.type, c.on_empty, c.on_error).alias(c.name))
        else:
            out.append(F.substr(cell, F.lit(2)).cast("bigint" if isinstance(c, Ordinality) else "boolean").alias(c.name))
    return df.withColumn("_json_table_row", F.explode(rows)).select(*[F.col(f"`{c}`") for c in df.columns], *out)

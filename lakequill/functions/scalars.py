"""String, number and array functions with the semantics of the dialect served, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring_from(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """A start below 1 counts as 1."""
    at = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    return F.substr(s, at) if length is None else F.substr(s, at, F.lit(length) if isinstance(length, int) else length)


def concat_all(*parts: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *parts)


def regexp_replace_first(s: Column, pattern: str, to: str) -> Column:
    """The first match only; groups in ``to`` are $1, $2, ..."""
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", to)
    return F.regexp_replace(s, f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{shifted}${pattern_groups(pattern) + 2}")


def pattern_groups(pattern: str) -> int:
    return re.compile(pattern).groups


def regexp_match(s: Column, pattern: str) -> Column:
    """Groups of the first match (the match itself without groups) as an array; null without a match."""
    n = pattern_groups(pattern)
    return F.when(F.regexp_like(s, F.lit(pattern)), F.array(*[F.regexp_extract(s, pattern, i) for i in (range(1, n + 1) if n else [0])]))


def similar_to(s: Column, pattern: str) -> Column:
    """% and _ as in LIKE; every other character is itself."""
    return s.rlike("(?s)^" + "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern) + "$")


def quote_ident(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))


def format_text(pattern: str, *args: Column) -> Column:
    """%s the text (nulls as <NULL>), %I a quoted name, %L a quoted literal (nulls as NULL), %% a percent sign."""
    parts, rest = [], list(args)
    for piece in re.split(r"(%[sIL%])", pattern):
        if piece == "%%":
            parts.append(F.lit("%"))
        elif piece in ("%s", "%I", "%L"):
            x = rest.pop(0).cast("string")
            quoted = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
            parts.append(F.coalesce(x, F.lit("<NULL>")) if piece == "%s" else quote_ident(x) if piece == "%I" else F.coalesce(quoted, F.lit("NULL")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def array_position(a: Column, x: Column) -> Column:
    """Null if absent."""
    return F.nullif(F.array_position(a, x), F.lit(0).cast("bigint"))


def string_to_array(s: Column, delimiter: str, null: str | None = None) -> Column:
    """An empty delimiter splits into characters; pieces equal to ``null`` become null."""
    parts = F.split(s, re.escape(delimiter)) if delimiter else F.filter(F.split(s, ""), lambda x: x != "")
    return parts if null is None else F.transform(parts, lambda x: F.when(x != null, x))


def int_range(lower: Column, upper: Column) -> Column:
    """[lower, upper) as a struct."""
    return F.struct(lower.alias("lower"), upper.alias("upper"), (lower >= upper).alias("empty"))


def range_contains(r: Column, x: Column) -> Column:
    return (r["lower"] <= x) & (x < r["upper"])


def ranges_overlap(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & (a["lower"] < b["upper"]) & (b["lower"] < a["upper"])


def multirange_contains(ranges: Column, x: Column) -> Column:
    return F.exists(ranges, lambda r: range_contains(r, x))


def inet(s: Column) -> Column:
    """The IPv4 address, with its prefix length if it has one; null for what is no address."""
    byte = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.when(s.rlike(rf"^{byte}(\.{byte}){{3}}(/(3[0-2]|[12]?[0-9]))?$"), s)


def json_path_of(target: str) -> list[str]:
    """The path of a subscripted column, as in ``col['a'][0]``: ["a", "0"]."""
    return [a or b for a, b in re.findall(r"\[(?:'([^']*)'|(-?\d+))\]", target)]


def enum_place(label: Column, labels: list[str]) -> Column:
    """The place of a label among the declared ones, from 0; null for any other."""
    return (array_position(F.array(*[F.lit(x) for x in labels]), label) - 1).cast("int")

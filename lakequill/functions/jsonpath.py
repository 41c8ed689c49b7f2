"""JSON documents beyond what the built-in functions say: path queries in lax mode, containment, changes.

A path is compiled once into a chain of steps; the Column builders at the end
run it in Arrow-batched pandas UDFs.  Plain member paths are better served by
``get_json_object`` or ``variant_get``, which stay inside generated code.
"""

from __future__ import annotations

import json
import math
import operator
import re
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = re.compile(
    r"\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>\"(?:[^\"\\]|\\.)*\")|(?P<op>\.\*\*|\.\.|&&|\|\||==|!=|<>|<=|>=|[$@.\[\]()*?!<>+\-/%,:])|(?P<name>[A-Za-z_][\w]*))"
)
COMPARE = {"==": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
Eval = Callable[[list, Any, Any, dict], list]


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parse(text: str) -> Any:
    """A document; numbers keep their digits, NaN and Infinity are refused."""
    return json.loads(text, parse_float=Decimal, parse_constant=_refuse)


def _kind(x: Any) -> str:
    return "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float, Decimal)) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def _unwrapped(items: list) -> Iterator[Any]:
    for x in items:
        yield from x if isinstance(x, list) else [x]


class Path:
    """A compiled path: ``$.a[*] ? (@.b > $min && exists(@.c)).d.size()`` and so on.

    The words lax and strict may stand in front; evaluation is lax after both.
    """

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, re.sub(r"^(?:lax|strict)(?=[\s$@(])", "", text.strip()).strip()
        while at < len(text):
            m = TOKENS.match(text, at)
            if not m:
                raise ValueError(f"bad JSON path at {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.run = self._predicate()
        if self.at < len(self.tokens):
            raise ValueError(f"bad JSON path near {self.tokens[self.at][1]!r}")

    def __call__(self, document: Any, variables: dict | None = None) -> list:
        return self.run(document, document, variables or {})

    def _peek(self, *ops: str) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in ops else None

    def _take(self, *ops: str) -> str | None:
        found = self._peek(*ops)
        self.at += found is not None
        return found

    def _need(self, op: str) -> None:
        if not self._take(op):
            raise ValueError(f"JSON path lacks {op!r}")

    def _predicate(self):
        left = self._both()
        while self._take("||"):
            right = self._both()
            left = lambda r, c, v, a=left, b=right: [_or(_truth(a(r, c, v)), _truth(b(r, c, v)))]
        return left

    def _both(self):
        left = self._negated()
        while self._take("&&"):
            right = self._negated()
            left = lambda r, c, v, a=left, b=right: [_and(_truth(a(r, c, v)), _truth(b(r, c, v)))]
        return left

    def _negated(self):
        if self._take("!"):
            inner = self._negated()
            return lambda r, c, v: [None if (t := _truth(inner(r, c, v))) is None else not t]
        if self._take("exists"):
            self._need("(")
            inner = self._predicate()
            self._need(")")
            return lambda r, c, v: [bool(inner(r, c, v))]
        return self._compared()

    def _compared(self):
        left = self._sum()
        if op := self._take(*COMPARE):
            right = self._sum()
            return lambda r, c, v: [_compare(op, left(r, c, v), right(r, c, v))]
        if self._take("like_regex"):
            pattern = json.loads(self.tokens[self.at][1])
            self.at += 1
            flags = 0
            if self._take("flag"):
                flags = re.I if "i" in self.tokens[self.at][1] else 0
                self.at += 1
            return lambda r, c, v: [any(isinstance(x, str) and re.search(pattern, x, flags) for x in _unwrapped(left(r, c, v)))]
        if self._take("starts"):
            self._need("with")
            right = self._sum()
            return lambda r, c, v: [any(isinstance(x, str) and x.startswith(p) for x in _unwrapped(left(r, c, v)) for p in right(r, c, v) if isinstance(p, str))]
        return left

    def _sum(self):
        left = self._product()
        while op := self._take("+", "-"):
            left = _arithmetic(op, left, self._product())
        return left

    def _product(self):
        left = self._signed()
        while op := self._take("*", "/", "%"):
            left = _arithmetic(op, left, self._signed())
        return left

    def _signed(self):
        if self._take("-"):
            inner = self._signed()
            return lambda r, c, v: [-x for x in inner(r, c, v) if _kind(x) == "number"]
        return self._steps(self._base())

    def _base(self):
        if self._take("$"):
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
                name = self.tokens[self.at][1]
                self.at += 1
                return lambda r, c, v: [v[name]] if name in v else []
            return lambda r, c, v: [r]
        if self._take("@"):
            return lambda r, c, v: [c]
        if self._take("("):
            inner = self._predicate()
            self._need(")")
            return inner
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind in ("num", "str") or text in ("true", "false", "null"):
            value = parse(text)
            return lambda r, c, v: [value]
        raise ValueError(f"bad JSON path near {text!r}")

    def _steps(self, run):
        while True:
            if self._take("..", ".**"):
                if self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "str"):
                    run = self._member(_then(run, _descend), dotted=True)
                else:
                    run = _then(run, _descend)
            elif self._take("."):
                run = self._member(run)
            elif self._take("["):
                run = self._index(run)
            elif self._take("?"):
                self._need("(")
                test = self._predicate()
                self._need(")")
                run = lambda r, c, v, a=run, t=test: [x for x in _unwrapped(a(r, c, v)) if _truth(t(r, x, v))]
            else:
                return run

    def _member(self, run, dotted: bool = False):
        if self._take("*"):
            return lambda r, c, v: [y for x in _unwrapped(run(r, c, v)) if isinstance(x, dict) for y in x.values()]
        kind, text = self.tokens[self.at]
        self.at += 1
        name = json.loads(text) if kind == "str" else text
        if kind == "name" and self._peek("(") and name in METHODS:
            self._need("(")
            self._need(")")
            return lambda r, c, v: [y for x in run(r, c, v) for y in METHODS[name](x)]
        if dotted:
            return lambda r, c, v: [x[name] for x in run(r, c, v) if isinstance(x, dict) and name in x]
        return lambda r, c, v: [x[name] for x in _unwrapped(run(r, c, v)) if isinstance(x, dict) and name in x]

    def _index(self, run):
        if self._take("*"):
            self._need("]")
            return lambda r, c, v: list(_unwrapped(run(r, c, v)))
        picks = []
        while True:
            first = self._place()
            picks.append((first, self._place() if self._take("to") else None))
            if not self._take(","):
                break
        self._need("]")

        def pick(x: Any) -> Iterator[Any]:
            items = x if isinstance(x, list) else [x]
            for first, end in picks:
                a = first(len(items))
                b = a if end is None else end(len(items))
                yield from items[a : b + 1] if a >= 0 else []

        return lambda r, c, v: [y for x in run(r, c, v) for y in pick(x)]


    def _place(self) -> Callable[[int], int]:
        """A subscript as a function of the array's length: a number, from the end if negative, or last with an offset."""
        if self._take("last"):
            sign = self._take("+", "-")
            offset = self._integer() * (-1 if sign == "-" else 1) if sign else 0
            return lambda n: n - 1 + offset
        negative = bool(self._take("-"))
        number = self._integer()
        return lambda n: n - number if negative else number

    def _integer(self) -> int:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "num" or not text.isdigit():
            raise ValueError(f"bad JSON path subscript near {text!r}")
        self.at += 1
        return int(text)


def _then(run, f):
    return lambda r, c, v: [y for x in run(r, c, v) for y in f(x)]


def _descend(x: Any) -> Iterator[Any]:
    yield x
    for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else []:
        yield from _descend(y)


def _truth(items: list) -> bool | None:
    return items[0] if len(items) == 1 and (items[0] is None or isinstance(items[0], bool)) else (None if items else False)


def _and(a, b):
    return False if a is False or b is False else None if a is None or b is None else True


def _or(a, b):
    return True if a is True or b is True else None if a is None or b is None else False


def _compare(op: str, left: list, right: list) -> bool | None:
    unknown = False
    for x in _unwrapped(left):
        for y in _unwrapped(right):
            if x is None or y is None:
                if op in ("==", "!=", "<>") and (x is None and y is None) == (op == "=="):
                    return True
            elif _kind(x) != _kind(y) or _kind(x) in ("array", "object"):
                unknown = True
            elif COMPARE[op](x, y):
                return True
    return None if unknown else False


def _whole(x: Any) -> Any:
    return int(x) if isinstance(x, Decimal) and x.is_finite() and x == x.to_integral_value() else x


def _arithmetic(op: str, left, right):
    """Whole results are integers; a remainder has the sign of the dividend."""
    f = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": lambda a, b: _whole(Decimal(a) / Decimal(b)), "%": lambda a, b: _whole(Decimal(a) % Decimal(b))}[op]

    def run(r, c, v):
        a, b = left(r, c, v), right(r, c, v)
        return [f(a[0], b[0])] if len(a) == len(b) == 1 and _kind(a[0]) == _kind(b[0]) == "number" and not (op in "/%" and b[0] == 0) else []

    return run


def _number(x: Any) -> list:
    try:
        number = Decimal(x) if isinstance(x, str) or _kind(x) == "number" else None
    except InvalidOperation:
        return []
    return [number] if number is not None and number.is_finite() else []


METHODS: dict[str, Callable[[Any], list]] = {
    "size": lambda x: [len(x) if isinstance(x, list) else 1],
    "type": lambda x: [_kind(x)],
    "double": lambda x: [y for i in (x if isinstance(x, list) else [x]) for y in _number(i)],
    "abs": lambda x: [abs(i) for i in (x if isinstance(x, list) else [x]) if _kind(i) == "number"],
    "floor": lambda x: [math.floor(i) for i in (x if isinstance(x, list) else [x]) if _kind(i) == "number"],
    "ceiling": lambda x: [math.ceil(i) for i in (x if isinstance(x, list) else [x]) if _kind(i) == "number"],
    "datetime": lambda x: [i for i in (x if isinstance(x, list) else [x]) if isinstance(i, str)],
    "keyvalue": lambda x: [{"key": k, "value": y} for i in (x if isinstance(x, list) else [x]) if isinstance(i, dict) for k, y in i.items()],
}


def contains(a: Any, b: Any) -> bool:
    """a @> b: every member or element of b is contained in one of a; an array contains a scalar element."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(contains(x, y) if isinstance(y, (dict, list)) == isinstance(x, (dict, list)) else False for x in a) for y in (b if isinstance(b, list) else [b]))
    return not isinstance(b, (dict, list)) and _kind(a) == _kind(b) and a == b


def _at(x: Any, key: str) -> Any:
    if isinstance(x, list):
        try:
            i = int(key)
        except ValueError:
            return None
        return i if -len(x) <= i < len(x) else None
    return key if isinstance(x, dict) and key in x else None


def set_path(x: Any, path: list[str], value: Any, create: bool = True, insert: bool = False, after: bool = False) -> Any:
    if not path:
        return x
    key, rest = path[0], path[1:]
    at = _at(x, key)
    if rest:
        if at is None:
            return x
        out = x.copy()
        out[at] = set_path(x[at], rest, value, create, insert, after)
        return out
    out = x.copy() if isinstance(x, (dict, list)) else x
    if isinstance(x, dict):
        if at is None and create or at is not None and not insert:
            out[key] = value
    elif isinstance(x, list):
        if at is not None and insert:
            out.insert((at + len(x) if at < 0 else at) + after, value)
        elif at is not None:
            out[at] = value
        elif create and key.lstrip("-").isdigit():
            out.insert(0 if key.startswith("-") else len(x), value)
    return out


def delete_path(x: Any, path: list[str]) -> Any:
    at = _at(x, path[0]) if path else None
    if at is None:
        return x
    out = x.copy()
    if path[1:]:
        out[at] = delete_path(x[at], path[1:])
    else:
        del out[at]
    return out


def strip_nulls(x: Any) -> Any:
    return {k: strip_nulls(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [strip_nulls(v) for v in x] if isinstance(x, list) else x


def merge(a: Any, b: Any) -> Any:
    """a || b: objects merge, anything else becomes elements."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a | b
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def _text(x: Any) -> str:
    if isinstance(x, Decimal):
        return format(x, "f") if abs(x.adjusted()) <= 400 else str(x).lower()
    return json.dumps(x, ensure_ascii=False)


def dump(x: Any, pretty: bool = False, indent: str = "") -> str:
    """Keys by length, then text; numbers with all their digits."""
    deeper = indent + "    " if pretty else ""
    if isinstance(x, dict):
        parts, ends = [f"{json.dumps(k, ensure_ascii=False)}: {dump(x[k], pretty, deeper)}" for k in sorted(x, key=lambda k: (len(k), k))], "{}"
    elif isinstance(x, list):
        parts, ends = [dump(y, pretty, deeper) for y in x], "[]"
    else:
        return _text(x)
    if not pretty or not parts:
        return ends[0] + ", ".join(parts) + ends[1]
    return f"{ends[0]}\n{deeper}" + f",\n{deeper}".join(parts) + f"\n{indent}{ends[1]}"


def _udf(f: Callable[..., Any], kind: str):
    @F.pandas_udf(kind)
    def apply(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            if any(x is None for x in row):
                out.append(None)
                continue
            try:
                documents = [parse(x) for x in row]
            except ValueError:
                out.append(None)
                continue
            out.append(f(*documents))
        return pd.Series(out, dtype=object)

    return apply


def path_query(doc: Column, path: str, variables: dict | None = None) -> Column:
    """All matches as an array of JSON texts; null or malformed documents give null."""
    run = Path(path)
    return _udf(lambda d: [dump(x) for x in run(d, variables)], "array<string>")(doc)


def path_query_first(doc: Column, path: str, variables: dict | None = None) -> Column:
    return F.try_element_at(path_query(doc, path, variables), F.lit(1))


def path_exists(doc: Column, path: str, variables: dict | None = None) -> Column:
    run = Path(path)
    return _udf(lambda d: bool(run(d, variables)), "boolean")(doc)


def path_match(doc: Column, path: str, variables: dict | None = None) -> Column:
    run = Path(path)
    return _udf(lambda d: _truth(run(d, variables)), "boolean")(doc)


def json_contains(a: Column, b: Column) -> Column:
    return _udf(contains, "boolean")(a, b)


def json_concat(a: Column, b: Column) -> Column:
    return _udf(lambda x, y: dump(merge(x, y)), "string")(a, b)


def json_set(doc: Column, path: list[str], value: Any, create: bool = True) -> Column:
    return _udf(lambda d: dump(set_path(d, path, value, create)), "string")(doc)


def json_set_lax(doc: Column, path: list[str], value: Any, create: bool = True, null: str = "use_json_null") -> Column:
    """jsonb_set_lax: what a null ``value`` does is use_json_null, delete_key, return_target or raise_exception."""
    if value is None and null == "raise_exception":
        raise ValueError("jsonb_set_lax: the new value is null")
    if value is None and null in ("delete_key", "return_target"):
        return json_delete(doc, path if null == "delete_key" else [])
    return json_set(doc, path, value, create)


def json_insert(doc: Column, path: list[str], value: Any, after: bool = False) -> Column:
    return _udf(lambda d: dump(set_path(d, path, value, True, True, after)), "string")(doc)


def json_delete(doc: Column, path: list[str]) -> Column:
    return _udf(lambda d: dump(delete_path(d, path)), "string")(doc)


def json_strip_nulls(doc: Column) -> Column:
    return _udf(lambda d: dump(strip_nulls(d)), "string")(doc)


def json_pretty(doc: Column) -> Column:
    return _udf(lambda d: dump(d, True), "string")(doc)


def json_typeof(doc: Column) -> Column:
    """The type of a document, from its schema as a variant: no Python."""
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json(doc)), "^[A-Z]+", 0)
    names = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    out = F.when(kind.isNotNull(), F.lit("number"))
    for variant, name in names.items():
        out = F.when(kind == variant, F.lit(name)).otherwise(out)
    return out


def is_json(doc: Column, kind: str = "value") -> Column:
    """IS JSON VALUE, OBJECT, ARRAY or SCALAR; null for null."""
    found = json_typeof(doc)
    tests = {"value": found.isNotNull(), "object": found == "object", "array": found == "array", "scalar": ~found.isin("object", "array")}
    return F.when(doc.isNotNull(), F.coalesce(tests[kind], F.lit(False)))


def has_any_key(doc: Column, *keys: str) -> Column:
    """doc ?| keys: a member of an object, or a string in an array, is one of them."""
    return _udf(lambda d: any(k in d for k in keys) if isinstance(d, (dict, list)) else d in keys if isinstance(d, str) else False, "boolean")(doc)


def has_all_keys(doc: Column, *keys: str) -> Column:
    """doc ?& keys."""
    return _udf(lambda d: all(k in d for k in keys) if isinstance(d, (dict, list)) else len(set(keys)) == 1 and d == keys[0], "boolean")(doc)


def json_get(doc: Column, *path: str | int) -> Column:
    """-> and #>: the JSON text at a path; negative array indexes count from the end."""

    def get(d: Any) -> str | None:
        for key in path:
            at = _at(d, str(key)) if not (isinstance(key, str) and isinstance(d, list)) else None
            if at is None:
                return None
            d = d[at]
        return dump(d)

    return _udf(get, "string")(doc)

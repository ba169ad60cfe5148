"""The metadata filter: a nested dict of conditions, compiled to one boolean Column.

Every condition is two-valued: a missing field or a type that doesn't fit is false (true under $ne and $nin), never
null, so negation is exact. Fields come from a resolver, over a VARIANT or over a struct of known types; filters over a
struct, and simple ones over a VARIANT, reach the scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.errors import QueryError


@dataclass(frozen=True)
class Value:
    """What can be asked about a field: its kind, and its value as each kind (null where it isn't of that kind)."""

    present: Column
    is_null: Column
    number: Column
    #: Whole numbers as they are stored: compared with whole numbers, these are exact and reach the scan.
    whole: Column | None
    only_whole: bool
    string: Column
    printed: Column
    json: Column
    any_element: Callable[[Callable[[Value], Column]], Column]
    has_key: Callable[[str], Column]


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _leaf(c: Column) -> Column:
    """The same as `_sure`, with the bare condition as a conjunct of its own: a scan can take that over."""
    return c & _sure(c)


def _none(_: Any) -> Column:
    return F.lit(False)


def variant_value(v: Column, depth: int = 0) -> Value:
    """A VARIANT: SQL null if missing, variant null if JSON null."""
    kind = F.schema_of_variant(v)
    as_type = lambda t: F.try_variant_get(v, "$", t)
    numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    number = F.when(numeric, as_type("double")).when(kind == "BOOLEAN", as_type("boolean").cast("int").cast("double"))
    string = F.when(kind == "STRING", as_type("string"))
    printed = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(as_type("string"))).when(kind == "STRING", as_type("string")).when(numeric, as_type("string"))
    elements = lambda test: F.when(kind.startswith("ARRAY"), F.exists(as_type("array<variant>"), lambda e: _sure(test(variant_value(e, depth + 1))))) if depth < 1 else F.lit(False)
    return Value(
        v.isNotNull(),
        F.is_variant_null(v),
        number,
        F.when(kind == "BIGINT", as_type("bigint")),
        False,
        string,
        printed,
        F.to_json(v),
        elements,
        lambda k: F.when(kind.startswith("OBJECT"), F.try_variant_get(v, _path([k]), "variant").isNotNull()),
    )


def _path(keys: list[str]) -> str:
    return "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)


class VariantFields:
    """Fields of a VARIANT column; dots in a name descend objects."""

    def __init__(self, column: str) -> None:
        self.column = column

    def __call__(self, name: str) -> Value:
        return variant_value(F.try_variant_get(F.col(self.column), _path(name.split(".")), "variant"))


def typed_value(v: Column, kind: T.DataType) -> Value:
    """A column of known type; null counts as missing."""
    none = F.lit(None)
    boolean = isinstance(kind, T.BooleanType)
    number = v.cast("double") if isinstance(kind, T.NumericType) else v.cast("int").cast("double") if boolean else none.cast("double")
    string = v if isinstance(kind, T.StringType) else none.cast("string")
    elements: Callable = _none
    if isinstance(kind, T.ArrayType):
        elements = lambda test: F.exists(v, lambda e: _sure(test(typed_value(e, kind.elementType))))
    keys: Callable = _none
    if isinstance(kind, T.StructType):
        keys = lambda k: F.lit(k in kind.names) & v.getField(k).isNotNull() if k in kind.names else F.lit(False)
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
    whole = isinstance(kind, T.IntegralType)
    number = v if isinstance(kind, T.DoubleType) else number
    return Value(v.isNotNull(), F.lit(False), number, v if whole else None, whole, string, none.cast("string") if nested else F.initcap(v.cast("string")) if boolean else v.cast("string"), F.to_json(v) if nested else none.cast("string"), elements, keys)


class StructFields:
    """Fields of typed columns, given the schema they are in; an unknown name is always missing."""

    def __init__(self, schema: T.StructType, prefix: str = "") -> None:
        self.schema, self.prefix = schema, prefix

    def __call__(self, name: str) -> Value:
        kind: T.DataType = self.schema
        column = F.col(self.prefix) if self.prefix else None
        for key in name.split("."):
            if not isinstance(kind, T.StructType) or key not in kind.names:
                return typed_value(F.lit(None).cast("string"), T.StringType())
            kind = kind[key].dataType
            column = F.col(f"`{key}`") if column is None else column.getField(key)
        return typed_value(column, kind)


def _as_whole(x: Any) -> int | None:
    """The whole number that `x` is, if a long holds it."""
    if isinstance(x, bool) or not isinstance(x, (int, float)) or (isinstance(x, float) and not x.is_integer()):
        return None
    return int(x) if -(1 << 63) <= x < 1 << 63 else None


def _numeric(v: Value, x: Any, test: Callable[[Column, Any], Column]) -> Column:
    """`test` of a number's value and `x`: as whole numbers where both are, else as doubles."""
    n = _as_whole(x)
    if v.whole is None or n is None:
        return test(v.number, F.lit(float(x)))
    exact = test(v.whole, F.lit(n))
    return exact if v.only_whole else F.when(v.whole.isNotNull(), exact).otherwise(test(v.number, F.lit(float(x))))


def _equal(v: Value, x: Any) -> Column:
    if x is None:
        return v.is_null
    if isinstance(x, (bool, int, float)):
        return _numeric(v, x, lambda a, b: a == b)
    if isinstance(x, str):
        return v.string == F.lit(x)
    if isinstance(x, (list, tuple, dict)):
        return v.json == F.to_json(F.parse_json(F.lit(json.dumps(x))))
    return F.lit(False)


#: The ordering operators.
_ORDER: dict[str, Callable[[Column, Any], Column]] = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def _compare(op: str) -> Callable[[Value, Any], Column]:
    def run(v: Value, x: Any) -> Column:
        if isinstance(x, (bool, int, float)):
            return _numeric(v, x, _ORDER[op])
        return _ORDER[op](v.string, F.lit(x)) if isinstance(x, str) else F.lit(False)

    return run


def _within(v: Value, x: Any) -> Column | None:
    """Membership of a value in `x`; null if `x` can't have members or the value can't be asked for."""
    if isinstance(x, str):
        return F.when(v.string.isNotNull(), F.contains(F.lit(x), v.string))
    if isinstance(x, dict):
        x = list(x)
    if not isinstance(x, (list, tuple, set, frozenset)):
        return None
    x = list(x)
    whole = [n for y in x if (n := _as_whole(y)) is not None]
    numbers = [y for y in x if isinstance(y, (bool, int, float))]
    strings = [y for y in x if isinstance(y, str)]
    if strings and len(strings) == len(x):
        return v.string.isin(*strings)
    if v.only_whole and whole and len(whole) == len(x):
        return v.whole.isin(*whole)
    found = F.lit(False)
    for y in numbers:
        found = found | _sure(_numeric(v, y, lambda a, b: a == b))
    if strings:
        found = found | _sure(v.string.isin(*strings))
    for y in x:
        if y is None or isinstance(y, (list, tuple, dict)):
            found = found | _sure(_equal(v, y))
    if numbers and len(numbers) == len(x):
        return F.when(v.number.isNotNull(), found)
    return found


def _contains(v: Value, x: Any) -> Column:
    found = _sure(v.any_element(lambda e: _equal(e, x)))
    if isinstance(x, str):
        found = found | _sure(F.contains(v.string, F.lit(x))) | _sure(v.has_key(x))
    return found


def _regex(v: Value, x: Any) -> Column:
    if not isinstance(x, str):
        raise QueryError("$regex takes a string")
    try:
        re.compile(x)
    except re.error as e:
        raise QueryError(f"not a regular expression: {x!r}") from e
    return v.printed.rlike(x)


def _between(v: Value, x: Any) -> Column:
    if not isinstance(x, (list, tuple)) or len(x) != 2:
        raise QueryError("$between takes two bounds")
    return _leaf(_compare("$gte")(v, x[0])) & _leaf(_compare("$lte")(v, x[1]))


def _condition(op: str, v: Value, x: Any) -> Column:
    if op == "$exists":
        return v.present if x else ~v.present
    if op == "$eq":
        return _leaf(_equal(v, x))
    if op == "$ne":
        return ~_sure(_equal(v, x))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return _leaf(_compare(op)(v, x))
    if op == "$in":
        found = _within(v, x)
        return F.lit(False) if found is None else _leaf(found)
    if op == "$nin":
        found = _within(v, x)
        outside = F.lit(False) if found is None else _sure(~found) if isinstance(x, str) else ~_sure(found)
        return ~v.present | outside
    if op == "$contains":
        return _contains(v, x)
    if op == "$regex":
        return _sure(_regex(v, x))
    if op == "$between":
        return _between(v, x)
    raise QueryError(f"no such operator: {op}")


@dataclass
class Filter:
    """A compiled filter, and what the planner needs of it."""

    predicate: Column
    fields: set[str] = field(default_factory=set)
    equality_fields: set[str] = field(default_factory=set)
    clauses: int = 0

    @property
    def is_trivial(self) -> bool:
        return not self.clauses

    @property
    def selectivity(self) -> float:
        """A fixed prior: a tenth per field with an equality, a third per other clause, within [0.001, 1]."""
        equalities = len(self.equality_fields)
        return min(1.0, max(0.001, 0.1**equalities * 0.33 ** max(0, self.clauses - equalities)))


def compile_filter(spec: dict | None, fields: Callable[[str], Value]) -> Filter:
    """The Column of a filter. Unknown operators, wherever they stand, and malformed operands are QueryErrors."""
    out = Filter(F.lit(True))

    def many(nodes: Any, op: str) -> list[Column]:
        if not isinstance(nodes, (list, tuple)):
            raise QueryError(f"{op} takes a list")
        return [visit(n) for n in nodes]

    def visit(node: Any) -> Column:
        if not isinstance(node, dict):
            raise QueryError(f"a filter is a dict, not {type(node).__name__}")
        total = F.lit(True)
        for name, given in node.items():
            if name == "$and":
                for c in many(given, name):
                    total = total & c
            elif name == "$or":
                either = F.lit(False)
                for c in many(given, name):
                    either = either | c
                total = total & either
            elif name == "$not":
                total = total & ~visit(given)
            elif name.startswith("$"):
                raise QueryError(f"no such operator: {name}")
            else:
                ops = given if isinstance(given, dict) and any(str(o).startswith("$") for o in given) else {"$eq": given}
                out.clauses += 1
                out.fields.add(name)
                value = fields(name)
                for op, x in ops.items():
                    if op == "$eq":
                        out.equality_fields.add(name)
                    total = total & _condition(op, value, x)
        return total

    if spec:
        out.predicate = visit(spec)
    return out

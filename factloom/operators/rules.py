"""Rules compiled to columns: field and cross-field assertions, transitions and derived expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD = {
    "minLength": lambda c, v: F.length(c) >= v, "maxLength": lambda c, v: F.length(c) <= v,
    "minimum": lambda c, v: c >= v, "maximum": lambda c, v: c <= v,
    "exclusiveMinimum": lambda c, v: c > v, "exclusiveMaximum": lambda c, v: c < v,
    "multipleOf": lambda c, v: c % v == 0, "enum": lambda c, v: c.isin(*v),
}
CROSS = {
    "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
    "eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "requiredIf": lambda a, b: b.isNull() | a.isNotNull(),
}


def field(column: str, name: str, value) -> Column:
    """An absent value breaks no rule."""
    return F.coalesce(FIELD[name](F.col(column), value), F.lit(True))


def cross(a: str, name: str, b: str) -> Column:
    return F.coalesce(CROSS[name](F.col(a), F.col(b)), F.lit(True))


def exclusive(*columns: str) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) <= 1


def derived(tree) -> Column:
    """A column from ["add" | "sub" | "mul" | "div", left, right], {"ref": name} or {"const": number}; x / 0 is null."""
    if isinstance(tree, dict):
        return F.col(tree["ref"]) if "ref" in tree else F.lit(tree["const"])
    name, a, b = tree
    if name == "div" and b == {"const": 0}:
        raise ValueError("a derived expression divides by the literal 0")
    x, y = derived(a), derived(b)
    return {"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: F.try_divide(x, y)}[name]()

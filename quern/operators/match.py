"""The query language of $match: conditions on paths, where any element of an array may meet a condition."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import PipelineError
from quern.functions import expr as E


def _any_element(v: E.Value, test: Callable[[E.Value], Column]) -> Column:
    """The test on the value, or on any element of it."""
    if isinstance(v.type, T.ArrayType):
        return F.coalesce(F.exists(v.col, lambda x: F.coalesce(test(E.Value(x, v.type.elementType)), F.lit(False))), F.lit(False))
    return F.coalesce(test(v), F.lit(False))


def _equals(v: E.Value, want: Any) -> Column:
    if want is None:
        return v.col.isNull()
    if isinstance(want, (list, dict)):
        return F.coalesce(E.equal(v, E.compile(want, {})), F.lit(False)) if isinstance(want, dict) or isinstance(v.type, T.ArrayType) else F.lit(False)
    w = E.literal(want)
    return _any_element(v, lambda x: E.equal(x, w) if x.kind == w.kind else F.lit(False))


def _ordered(v: E.Value, op: str, want: Any) -> Column:
    w = E.literal(want)
    # only values of the same kind compare here
    return _any_element(v, lambda x: E.compare(op, x, w) & x.col.isNotNull() if x.kind == w.kind else F.lit(False))


def _one(v: E.Value, op: str, arg: Any, options: str) -> Column:
    if op == "$eq":
        return _equals(v, arg)
    if op == "$ne":
        return ~_equals(v, arg)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return _ordered(v, op, arg)
    if op == "$in":
        plain = [x for x in arg if x is not None and not isinstance(x, (list, dict, bool))]
        if len(plain) == len(arg) and plain and not isinstance(v.type, T.ArrayType) and {E.literal(x).kind for x in plain} == {v.kind}:
            return F.coalesce(v.col.isin(plain), F.lit(False))  # can be pushed into a scan
        return E._any([_equals(v, x) for x in arg])
    if op == "$nin":
        return ~_one(v, "$in", arg, options)
    if op == "$exists":
        return v.col.isNotNull() if arg else v.col.isNull()
    if op == "$not":
        return ~_conditions(v, arg)
    if op == "$all":
        return E._all([_equals(v, x) for x in arg])
    if op == "$size":
        return F.coalesce(F.size(v.col) == arg, F.lit(False)) if isinstance(v.type, T.ArrayType) else F.lit(False)
    if op == "$elemMatch":
        if not isinstance(v.type, T.ArrayType):
            return F.lit(False)
        t = v.type.elementType
        if any(not k.startswith("$") for k in arg):
            test = lambda x: condition(arg, lambda p: _steps(E.Value(x, t), p))
        else:
            test = lambda x: _conditions(E.Value(x, t), arg)
        return F.coalesce(F.exists(v.col, test), F.lit(False))
    if op == "$regex":
        return _any_element(v, lambda x: F.regexp_like(x.col, F.lit(("(?i)" if "i" in options else "") + arg)) if x.kind == "string" else F.lit(False))
    if op == "$type":
        names = [arg] if not isinstance(arg, list) else arg
        return E.OPERATORS["$type"]("$x", {"$x": v}).col.isin(names) | (F.lit("number" in names and v.kind == "number") & v.col.isNotNull())
    raise PipelineError(f"no match operator {op}")


def _steps(v: E.Value, dotted: str) -> E.Value:
    for name in dotted.split("."):
        v = E.step(v, name)
    return v


def _conditions(v: E.Value, spec: Any) -> Column:
    if isinstance(spec, dict) and spec and all(k.startswith("$") for k in spec):
        options = spec.get("$options", "")
        return E._all([_one(v, op, arg, options) for op, arg in spec.items() if op != "$options"])
    return _equals(v, spec)


def condition(spec: dict[str, Any], at: Callable[[str], E.Value], scope: E.Scope | None = None) -> Column:
    parts = []
    for k, arg in spec.items():
        if k in ("$and", "$or", "$nor"):
            own = [condition(x, at, scope) for x in arg]
            parts.append(E._all(own) if k == "$and" else E._any(own) if k == "$or" else ~E._any(own))
        elif k == "$expr":
            if scope is None:
                raise PipelineError("$expr isn't allowed here")
            parts.append(E.truth(E.compile(arg, scope)))
        elif k == "$comment":
            continue
        elif k.startswith("$"):
            raise PipelineError(f"no match operator {k}")
        else:
            parts.append(_conditions(at(k), arg))
    out = parts[0] if parts else F.lit(True)
    for p in parts[1:]:
        out = out & p
    return out


def match(spec: dict[str, Any], scope: E.Scope) -> Column:
    return condition(spec, lambda p: E.path(scope, p), scope)

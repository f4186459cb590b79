"""Compiles an expression to a typed Column.

Spark's typed columns stand for documents: struct for fixed fields, map for keys that are data, array
for lists. An absent field is NULL. A path picks struct fields and map keys and fans out over arrays.
Every compiled value carries its DataType, so the form of each operator is chosen while compiling and
everything stays in built-in functions. Comparisons follow the document order: null before numbers,
numbers before strings, strings before objects, arrays and booleans; values of different kinds are never equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import PipelineError


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, T.NullType):
            return "null"
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
            return "string"
        if isinstance(t, (T.StructType, T.MapType)):
            return "object"
        if isinstance(t, T.ArrayType):
            return "array"
        if isinstance(t, T.BooleanType):
            return "bool"
        return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


Scope = dict[str, Value]
ORDER = ("null", "number", "string", "object", "array", "bool", "date", "other")
def null() -> Value:
    return Value(F.lit(None), T.NullType())


def root(schema: T.StructType) -> Scope:
    """The scope of a document: its fields by name, and itself as ROOT."""
    own = {f"${f.name}": Value(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields}
    return {**own, "ROOT": Value(F.struct(*(F.col(f"`{f.name}`") for f in schema.fields)) if schema.fields else F.lit(None), schema)}


def step(v: Value, name: str) -> Value:
    """One part of a path."""
    t = v.type
    if isinstance(t, T.StructType):
        return Value(v.col.getField(name), t[name].dataType) if name in t.names else null()
    if isinstance(t, T.MapType):
        return Value(F.try_element_at(v.col, F.lit(name)), t.valueType)
    if isinstance(t, T.ArrayType):
        inner = step(Value(F.lit(None), t.elementType), name)
        if isinstance(inner.type, T.NullType):
            return null()
        picked = F.transform(v.col, lambda x: step(Value(x, t.elementType), name).col)
        if isinstance(t.elementType, T.ArrayType) or isinstance(t.elementType, (T.StructType, T.MapType)):
            return Value(F.filter(picked, lambda x: x.isNotNull()), T.ArrayType(inner.type))
        return null()
    return null()


def path(scope: Scope, dotted: str) -> Value:
    """``a.b.c`` from the document."""
    first, *rest = dotted.split(".")
    v = scope.get(f"${first}", null())
    for name in rest:
        v = step(v, name)
    return v


def literal(x: Any) -> Value:
    if x is None:
        return null()
    if isinstance(x, bool):
        return Value(F.lit(x), T.BooleanType())
    if isinstance(x, int):
        return Value(F.lit(x).cast("long"), T.LongType())
    if isinstance(x, float):
        return Value(F.lit(x), T.DoubleType())
    if isinstance(x, str):
        return Value(F.lit(x), T.StringType())
    raise PipelineError(f"no literal: {x!r}")


def common_type(values: list[Value]) -> T.DataType:
    own = [v.type for v in values if not isinstance(v.type, T.NullType)]
    if not own:
        return T.NullType()
    if all(t == own[0] for t in own):
        return own[0]
    kinds = {v.kind for v in values if v.kind != "null"}
    if kinds == {"number"}:
        return T.DoubleType() if any(isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) for t in own) else T.LongType()
    if kinds == {"array"}:
        return T.ArrayType(common_type([Value(F.lit(None), t.elementType) for t in own]))
    if kinds == {"object"}:
        if any(isinstance(t, T.MapType) for t in own):
            return next(t for t in own if isinstance(t, T.MapType))
        return max(own, key=lambda t: len(t.names))
    return T.StringType()


def cast(v: Value, t: T.DataType) -> Column:
    if v.type == t or isinstance(t, T.NullType):
        return v.col
    if isinstance(v.type, T.StructType) and isinstance(t, T.StructType):
        return F.when(v.col.isNotNull(), F.struct(*(cast(step(v, f.name), f.dataType).alias(f.name) for f in t.fields)))
    if v.kind == "object" and not isinstance(t, (T.StructType, T.MapType)):
        return F.to_json(v.col)
    return v.col.cast(t)


def nothing(t: T.DataType) -> Column:
    return F.array().cast(t)


def number(v: Value) -> Column:
    return v.col if v.kind == "number" else F.lit(None).cast("double") if v.kind != "null" else F.lit(None).cast("long")


def truth(v: Value) -> Column:
    """Null, false and zero are false, all else is true."""
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind == "number":
        return F.coalesce(v.col != 0, F.lit(False))
    return F.lit(False) if v.kind == "null" else v.col.isNotNull()


def equal(a: Value, b: Value) -> Column:
    if "null" in (a.kind, b.kind):
        return a.col.isNull() & b.col.isNull() if a.kind == b.kind == "null" else (b if a.kind == "null" else a).col.isNull()
    if a.kind != b.kind:
        return a.col.isNull() & b.col.isNull()
    if isinstance(a.type, T.MapType) or isinstance(b.type, T.MapType):
        return F.coalesce(F.to_json(a.col) == F.to_json(b.col), a.col.isNull() & b.col.isNull())
    if a.type != b.type and a.kind in ("array", "object"):
        t = common_type([a, b])
        return cast(a, t).eqNullSafe(cast(b, t))
    return a.col.eqNullSafe(b.col)


def less(a: Value, b: Value) -> Column:
    """a < b in document order, null first."""
    null_first = a.col.isNull() & b.col.isNotNull()
    if "null" in (a.kind, b.kind):
        return null_first
    if a.kind != b.kind:
        return a.col.isNull() & b.col.isNotNull() | a.col.isNotNull() & b.col.isNotNull() & F.lit(ORDER.index(a.kind) < ORDER.index(b.kind))
    return F.coalesce(a.col < b.col, null_first)


def compare(op: str, a: Value, b: Value) -> Column:
    if op == "$eq":
        return equal(a, b)
    if op == "$ne":
        return ~equal(a, b)
    if op == "$lt":
        return less(a, b)
    if op == "$gt":
        return less(b, a)
    if op == "$lte":
        return ~less(b, a)
    return ~less(a, b)


def as_array(v: Value) -> Value:
    """The array, empty where it is null."""
    if isinstance(v.type, T.ArrayType):
        return Value(F.coalesce(v.col, nothing(v.type)), v.type)
    if v.kind == "null":
        return Value(F.array(), T.ArrayType(T.NullType()))
    raise PipelineError(f"an array is needed, not {v.type.simpleString()}")


def entries(v: Value) -> Value:
    """An object as array of {k, v}, in the map's own order; absent fields have no entry."""
    if isinstance(v.type, T.MapType):
        t = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", v.type.valueType)]))
        return Value(F.transform(F.map_entries(v.col), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))), t)
    if isinstance(v.type, T.StructType):
        own = [Value(v.col.getField(f.name), f.dataType) for f in v.type.fields]
        t = common_type(own)
        t = T.StringType() if isinstance(t, T.NullType) else t
        pairs = [F.when(x.col.isNotNull(), F.struct(F.lit(f.name).alias("k"), cast(x, t).alias("v"))) for f, x in zip(v.type.fields, own, strict=True)]
        out = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", t)]))
        return Value(F.when(v.col.isNotNull(), F.filter(F.array(*pairs), lambda x: x.isNotNull())) if pairs else nothing(out), out)
    if v.kind == "null":
        return Value(F.lit(None).cast("array<struct<k:string,v:string>>"), T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])))
    raise PipelineError("$objectToArray needs an object")


TYPE_NAMES = {"null": "missing", "string": "string", "object": "object", "array": "array", "bool": "bool", "date": "date", "other": "binData"}


def compile(e: Any, scope: Scope) -> Value:  # noqa: A001
    if isinstance(e, str) and e.startswith("$$"):
        name, *rest = e[2:].split(".")
        if name == "CURRENT":
            name = "ROOT"
        if name == "REMOVE":
            return null()
        if name not in scope:
            raise PipelineError(f"no variable $${name}")
        if name == "ROOT" and rest:
            return path(scope, ".".join(rest))
        v = scope[name]
        for x in rest:
            v = step(v, x)
        return v
    if isinstance(e, str) and e.startswith("$"):
        return path(scope, e[1:])
    if isinstance(e, list):
        own = [compile(x, scope) for x in e]
        t = common_type(own)
        return Value(F.array(*(cast(v, t) for v in own)), T.ArrayType(t))
    if isinstance(e, dict):
        if len(e) == 1 and next(iter(e)).startswith("$"):
            ((op, args),) = e.items()
            if op not in OPERATORS:
                raise PipelineError(f"no expression operator {op}")
            return OPERATORS[op](args, scope)
        if any(k.startswith("$") for k in e):
            raise PipelineError(f"more than one operator: {sorted(e)}")
        return struct({k: compile(v, scope) for k, v in e.items()})
    return literal(e)


def struct(fields: dict[str, Value]) -> Value:
    if not fields:
        return Value(F.create_map().cast("map<string,string>"), T.MapType(T.StringType(), T.StringType()))
    return Value(F.struct(*(v.col.alias(k) for k, v in fields.items())), T.StructType([T.StructField(k, v.type) for k, v in fields.items()]))


def _many(args: Any, scope: Scope) -> list[Value]:
    return [compile(x, scope) for x in (args if isinstance(args, list) else [args])]


def _pair(f: Callable[[Value, Value], Value]):
    def run(args: Any, scope: Scope) -> Value:
        if not isinstance(args, list) or len(args) != 2:
            raise PipelineError("two arguments are needed")
        return f(compile(args[0], scope), compile(args[1], scope))

    return run


def _one(f: Callable[[Value], Value]):
    def run(args: Any, scope: Scope) -> Value:
        if isinstance(args, list) and len(args) == 1:
            args = args[0]
        return f(compile(args, scope))

    return run


def _bool(c: Column) -> Value:
    return Value(c, T.BooleanType())


def _choose(cases: list[tuple[Column, Value]], default: Value) -> Value:
    t = common_type([*(v for _, v in cases), default])
    out = cast(default, t)
    if isinstance(default.type, T.NullType) and not isinstance(t, T.NullType):
        out = F.lit(None).cast(t)
    for cond, v in reversed(cases):
        out = F.when(cond, F.lit(None).cast(t) if isinstance(v.type, T.NullType) else cast(v, t)).otherwise(out)
    return Value(out, t)


def _cond(args: Any, scope: Scope) -> Value:
    if isinstance(args, dict):
        args = [args["if"], args["then"], args.get("else")]
    test, then, other = (compile(x, scope) for x in args)
    return _choose([(truth(test), then)], other)


def _switch(args: dict, scope: Scope) -> Value:
    return _choose([(truth(compile(b["case"], scope)), compile(b["then"], scope)) for b in args["branches"]], compile(args.get("default"), scope))


def _if_null(args: list, scope: Scope) -> Value:
    own = _many(args, scope)
    empty = isinstance(args[-1], dict) and not args[-1]
    kinds = own[:-1] if (empty and own[0].kind == "object") or (args[-1] == [] and own[0].kind == "array") else own
    t = common_type(kinds)
    if isinstance(t, T.NullType):
        return null()
    if empty and isinstance(t, T.MapType):
        return Value(F.coalesce(*(v.col for v in own[:-1]), F.create_map().cast(t)), t)
    if empty and isinstance(t, T.StructType):
        return Value(own[0].col, t)  # no fields: entries() and paths find nothing in null either
    return Value(F.coalesce(*(F.lit(None).cast(t) if v.kind == "null" else cast(v, t) for v in own)), t)


def _filter(args: dict, scope: Scope) -> Value:
    v, name = as_array(compile(args["input"], scope)), args.get("as", "this")
    if v.type.elementType == T.NullType():
        return v
    kept = F.filter(v.col, lambda x: truth(compile(args["cond"], {**scope, name: Value(x, v.type.elementType)})))
    return Value(F.slice(kept, 1, compile(args["limit"], scope).col.cast("int")) if "limit" in args else kept, v.type)


def _map(args: dict, scope: Scope) -> Value:
    v, name, made = as_array(compile(args["input"], scope)), args.get("as", "this"), []

    def body(x: Column) -> Column:
        made.append(compile(args["in"], {**scope, name: Value(x, v.type.elementType)}))
        return made[-1].col

    out = F.transform(v.col, body)
    return Value(out, T.ArrayType(made[-1].type))


def _reduce(args: dict, scope: Scope) -> Value:
    v, start = as_array(compile(args["input"], scope)), compile(args["initialValue"], scope)
    seen: list[Value] = []

    def body(acc: Column, x: Column, t: T.DataType) -> Column:
        seen.append(compile(args["in"], {**scope, "value": Value(acc, t), "this": Value(x, v.type.elementType)}))
        return seen[-1].col

    F.aggregate(v.col, start.col, lambda a, x: body(a, x, start.type))
    t = common_type([start, seen[-1]])
    return Value(F.aggregate(v.col, cast(start, t), lambda a, x: body(a, x, t).cast(t)), t)


def _in(v: Value, hay: Value) -> Value:
    hay = as_array(hay)
    return _bool(F.exists(hay.col, lambda x: equal(Value(x, hay.type.elementType), v)) if hay.type.elementType != T.NullType() else F.lit(False) if v.kind != "null" else F.exists(hay.col, lambda x: x.isNull()))


def _together(own: list[Value]) -> tuple[list[Column], T.DataType]:
    t = common_type(own)
    if not isinstance(t, T.ArrayType):
        t = T.ArrayType(T.StringType())
    t = T.ArrayType(T.StringType()) if isinstance(t.elementType, T.NullType) else t
    return [F.lit(None).cast(t) if v.kind == "null" else cast(v, t) for v in own], t


def _sets(f: Callable[[Column, Column], Column], empty_if_null: bool = False):
    def run(args: list, scope: Scope) -> Value:
        cols, t = _together(_many(args, scope))
        out = F.array_distinct(cols[0])
        for c in cols[1:]:
            out = f(out, c)
        return Value(F.array_sort(out) if not isinstance(t.elementType, (T.StructType, T.MapType)) else out, t)

    return run


def _subset(a: Value, b: Value) -> Value:
    (x, y), _ = _together([a, b])
    return _bool(F.size(F.array_except(x, y)) == 0)


def _same_set(a: Value, b: Value) -> Value:
    (x, y), _ = _together([a, b])
    return _bool((F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0))


def _arith(f: Callable[[Column, Column], Column], whole: bool = True):
    def run(args: Any, scope: Scope) -> Value:
        own = _many(args, scope)
        t = common_type(own) if whole and all(v.kind == "number" for v in own) else T.DoubleType()
        t = T.LongType() if isinstance(t, T.IntegralType) else t
        out = number(own[0]).cast(t)
        for v in own[1:]:
            out = f(out, number(v).cast(t))
        return Value(out, t)

    return run


def _fold(pick: Callable[..., Column], f: str):
    """$max and the like as expression: over several values, or over one array."""

    def run(args: Any, scope: Scope) -> Value:
        own = _many(args, scope)
        if len(own) == 1 and isinstance(own[0].type, T.ArrayType):
            return Value(pick(own[0].col), own[0].type.elementType)
        if len(own) == 1:
            return own[0]
        t = common_type(own)
        return Value(getattr(F, f)(*(v.col.cast(t) for v in own)), t)

    return run


def _sum(args: Any, scope: Scope) -> Value:
    own = _many(args, scope)
    if len(own) == 1 and isinstance(own[0].type, T.ArrayType):
        v = own[0]
        if not isinstance(v.type.elementType, T.NumericType):
            return literal(0)
        t = T.LongType() if isinstance(v.type.elementType, T.IntegralType) else T.DoubleType()
        return Value(F.aggregate(F.coalesce(v.col, nothing(v.type)), F.lit(0).cast(t), lambda a, x: a + F.coalesce(x.cast(t), F.lit(0).cast(t))), t)
    t = T.LongType() if all(isinstance(v.type, T.IntegralType) for v in own) else T.DoubleType()
    out = F.lit(0).cast(t)
    for v in own:
        out = out + F.coalesce(number(v).cast(t), F.lit(0).cast(t))
    return Value(out, t)


def _avg(args: Any, scope: Scope) -> Value:
    v = compile(args, scope) if not isinstance(args, list) else compile(args, scope)
    if not isinstance(v.type, T.ArrayType):
        return Value(number(v).cast("double"), T.DoubleType())
    own = F.filter(v.col, lambda x: x.isNotNull())
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return Value(F.when(F.size(own) > 0, total / F.size(own)), T.DoubleType())


def _concat(args: list, scope: Scope) -> Value:
    return Value(F.concat(*(v.col.cast("string") for v in _many(args, scope))), T.StringType())


def _concat_arrays(args: list, scope: Scope) -> Value:
    cols, t = _together(_many(args, scope))
    return Value(F.concat(*cols), t)


def _to_object(v: Value) -> Value:
    e = v.type.elementType
    if isinstance(e, T.StructType) and {"k", "v"} <= set(e.names):
        pairs, t = F.transform(v.col, lambda x: F.struct(x["k"], x["v"])), e["v"].dataType
    else:
        pairs, t = F.transform(v.col, lambda x: F.struct(x[0], x[1])), e.elementType
    # of equal keys the last one counts
    once = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y[_first(e)] == x[_first(e)]))
    return Value(F.map_from_entries(once), T.MapType(T.StringType(), t))


def _first(e: T.DataType) -> str:
    return "k" if isinstance(e, T.StructType) else "col1"


def _slice(args: list, scope: Scope) -> Value:
    v, *n = _many(args, scope)
    if len(n) == 1:
        k = n[0].col.cast("int")
        return Value(F.when(k >= 0, F.slice(v.col, F.lit(1), k)).otherwise(F.slice(v.col, F.greatest(F.size(v.col) + k + 1, F.lit(1)), F.least(-k, F.size(v.col)))), v.type)
    at, k = (x.col.cast("int") for x in n)
    at = F.when(at >= 0, at).otherwise(F.greatest(F.size(v.col) + at, F.lit(0)))
    return Value(F.slice(v.col, at + 1, k), v.type)


def _element(v: Value, i: Value) -> Value:
    if v.kind == "null":
        return null()
    k = i.col.cast("int")
    return Value(F.get(v.col, F.when(k < 0, F.size(v.col) + k).otherwise(k)), v.type.elementType)


def _type(v: Value) -> Value:
    if v.kind == "number":
        name = "double" if isinstance(v.type, (T.DoubleType, T.FloatType)) else "decimal" if isinstance(v.type, T.DecimalType) else "long" if isinstance(v.type, T.LongType) else "int"
    else:
        name = TYPE_NAMES[v.kind]
    return Value(F.when(v.col.isNotNull(), F.lit(name)).otherwise(F.lit("missing")), T.StringType())


def _let(args: dict, scope: Scope) -> Value:
    return compile(args["in"], {**scope, **{k: compile(v, scope) for k, v in args["vars"].items()}})


def _get_field(args: Any, scope: Scope) -> Value:
    name, of = (args["field"], args.get("input", "$$ROOT")) if isinstance(args, dict) else (args, "$$ROOT")
    return step(compile(of, scope), name)


def _set_field(args: dict, scope: Scope) -> Value:
    v, new = compile(args["input"], scope), compile(args["value"], scope)
    if isinstance(v.type, T.MapType):
        one = F.create_map(F.lit(args["field"]), cast(new, v.type.valueType))
        return Value(F.map_concat(F.map_filter(v.col, lambda k, _: k != args["field"]), one), v.type)
    fields = {f.name: Value(v.col.getField(f.name), f.dataType) for f in v.type.fields} | {args["field"]: new}
    return struct(fields)


def _text(f: Callable[..., Column], kind: T.DataType = T.StringType()):
    return lambda args, scope: Value(f(*(v.col for v in _many(args, scope))), kind)


def _date_part(f: Callable[[Column], Column]):
    return _one(lambda v: Value(f(v.col.cast("timestamp_ntz")).cast("int"), T.IntegerType()))


# Names of the pipeline language.
OPERATORS: dict[str, Callable[[Any, Scope], Value]] = {
    **{op: _pair(lambda a, b, op=op: _bool(compare(op, a, b))) for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")},
    "$cmp": _pair(lambda a, b: Value(F.when(less(a, b), -1).when(less(b, a), 1).otherwise(0), T.IntegerType())),
    "$and": lambda args, scope: _bool(_all([truth(v) for v in _many(args, scope)])),
    "$or": lambda args, scope: _bool(_any([truth(v) for v in _many(args, scope)])),
    "$not": _one(lambda v: _bool(~truth(v))),
    "$in": _pair(_in),
    "$cond": _cond,
    "$switch": _switch,
    "$ifNull": _if_null,
    "$literal": lambda args, scope: literal(args) if not isinstance(args, (list, dict)) else compile(args, {}),
    "$let": _let,
    "$size": _one(lambda v: Value(F.size(as_array(v).col), T.IntegerType())),
    "$filter": _filter,
    "$map": _map,
    "$reduce": _reduce,
    "$isArray": _one(lambda v: _bool(v.col.isNotNull() if isinstance(v.type, T.ArrayType) else F.lit(False))),
    "$isNumber": _one(lambda v: _bool(v.col.isNotNull() if v.kind == "number" else F.lit(False))),
    "$arrayElemAt": _pair(_element),
    "$first": _one(lambda v: _element(v, literal(0))),
    "$last": _one(lambda v: _element(v, literal(-1))),
    "$slice": _slice,
    "$concatArrays": _concat_arrays,
    "$reverseArray": _one(lambda v: Value(F.reverse(v.col), v.type)),
    "$sortArray": lambda args, scope: (lambda v: Value(F.sort_array(v.col, args["sortBy"] == 1), v.type))(compile(args["input"], scope)),
    "$range": lambda args, scope: (lambda n: Value(F.when(n[0] < n[1], F.sequence(n[0], n[1] - 1, *n[2:])).otherwise(F.array().cast("array<int>")), T.ArrayType(T.IntegerType())))([v.col.cast("int") for v in _many(args, scope)]),
    "$objectToArray": _one(entries),
    "$arrayToObject": _one(_to_object),
    "$getField": _get_field,
    "$setField": _set_field,
    "$mergeObjects": lambda args, scope: _merge(_many(args, scope)),
    "$setIntersection": _sets(F.array_intersect),
    "$setUnion": _sets(F.array_union),
    "$setDifference": _sets(F.array_except),
    "$setIsSubset": _pair(_subset),
    "$setEquals": _pair(_same_set),
    "$anyElementTrue": _one(lambda v: _bool(F.exists(as_array(v).col, lambda x: truth(Value(x, v.type.elementType))))),
    "$allElementsTrue": _one(lambda v: _bool(F.forall(as_array(v).col, lambda x: truth(Value(x, v.type.elementType))))),
    "$type": _one(_type),
    "$add": _arith(lambda a, b: a + b),
    "$subtract": _arith(lambda a, b: a - b),
    "$multiply": _arith(lambda a, b: a * b),
    "$divide": _arith(lambda a, b: F.try_divide(a, b), whole=False),
    "$mod": _arith(lambda a, b: F.try_mod(a, b)),
    "$pow": _arith(F.pow, whole=False),
    "$abs": _one(lambda v: Value(F.abs(number(v)), v.type)),
    "$ceil": _one(lambda v: Value(F.ceil(number(v)).cast("long"), T.LongType())),
    "$floor": _one(lambda v: Value(F.floor(number(v)).cast("long"), T.LongType())),
    "$sqrt": _one(lambda v: Value(F.sqrt(number(v)), T.DoubleType())),
    "$ln": _one(lambda v: Value(F.ln(number(v)), T.DoubleType())),
    "$log10": _one(lambda v: Value(F.log10(number(v)), T.DoubleType())),
    "$exp": _one(lambda v: Value(F.exp(number(v)), T.DoubleType())),
    "$round": lambda args, scope: (lambda v: Value(F.bround(number(v[0]), args[1] if isinstance(args, list) and len(args) > 1 else 0), v[0].type))(_many(args, scope)),
    "$trunc": _one(lambda v: Value(F.when(number(v) < 0, F.ceil(number(v))).otherwise(F.floor(number(v))).cast("long"), T.LongType())),
    "$max": _fold(F.array_max, "greatest"),
    "$min": _fold(F.array_min, "least"),
    "$sum": _sum,
    "$avg": _avg,
    "$concat": _concat,
    "$toLower": _one(lambda v: Value(F.coalesce(F.lower(v.col.cast("string")), F.lit("")), T.StringType())),
    "$toUpper": _one(lambda v: Value(F.coalesce(F.upper(v.col.cast("string")), F.lit("")), T.StringType())),
    "$substr": lambda args, scope: (lambda v: Value(F.substring(v[0].col.cast("string"), v[1].col.cast("int") + 1, F.when(v[2].col < 0, F.lit(1 << 30)).otherwise(v[2].col).cast("int")), T.StringType()))(_many(args, scope)),
    "$strLenCP": _text(F.length, T.IntegerType()),
    "$split": _pair(lambda a, b: Value(F.split(a.col, F.concat(F.lit("\\Q"), b.col, F.lit("\\E"))), T.ArrayType(T.StringType()))),
    "$trim": lambda args, scope: Value(F.trim(compile(args["input"], scope).col), T.StringType()),
    "$regexMatch": lambda args, scope: _bool(F.coalesce(F.regexp_like(compile(args["input"], scope).col, F.lit(("(?i)" if "i" in args.get("options", "") else "") + args["regex"])), F.lit(False))),
    "$replaceAll": lambda args, scope: Value(F.replace(compile(args["input"], scope).col, compile(args["find"], scope).col, compile(args["replacement"], scope).col), T.StringType()),
    "$toString": _one(lambda v: Value(v.col.cast("string"), T.StringType())),
    "$toInt": _one(lambda v: Value(v.col.try_cast("int"), T.IntegerType())),
    "$toLong": _one(lambda v: Value(v.col.try_cast("long"), T.LongType())),
    "$toDouble": _one(lambda v: Value(v.col.try_cast("double"), T.DoubleType())),
    "$toBool": _one(lambda v: Value(F.when(v.col.isNotNull(), truth(v)), T.BooleanType())),
    "$toDate": _one(lambda v: Value(v.col.try_cast("timestamp_ntz"), T.TimestampNTZType())),
    "$year": _date_part(F.year),
    "$month": _date_part(F.month),
    "$dayOfMonth": _date_part(F.dayofmonth),
}
OPERATORS["$substrCP"] = OPERATORS["$substrBytes"] = OPERATORS["$substr"]


def _merge(own: list[Value]) -> Value:
    if all(isinstance(v.type, T.StructType) for v in own):
        fields: dict[str, Value] = {}
        for v in own:
            for f in v.type.fields:
                new = Value(v.col.getField(f.name), f.dataType)
                fields[f.name] = _choose([(new.col.isNotNull(), new)], fields[f.name]) if f.name in fields else new
        return struct(fields)
    t = next(v.type for v in own if isinstance(v.type, T.MapType))
    maps = [F.coalesce(v.col, F.create_map().cast(t)) for v in own if isinstance(v.type, T.MapType)]
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(F.map_filter(out, lambda k, _, m=m: ~F.map_contains_key(m, k)), m)
    return Value(out, t)


def _all(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c
    return out


def _any(cols: list[Column]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c
    return out

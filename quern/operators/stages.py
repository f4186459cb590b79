"""Compiles stages, one after the other, to DataFrame operations.

Only the plan is built here; Catalyst prunes columns, pushes filters into the scan and picks joins. The
order of a result is that of its last $sort; $first, $last and $push follow the order of a $sort before them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import PipelineError
from quern.functions import expr as E
from quern.operators.match import match
from quern.plans import policy
from quern.plans.parse import parse
from quern.plans.rewrite import rewrite

Collections = Mapping[str, DataFrame]


@dataclass(frozen=True)
class State:
    df: DataFrame
    collections: Collections
    order: tuple[tuple[str, int], ...] = ()
    outer: Mapping[str, E.Value] | None = None

    @property
    def scope(self) -> E.Scope:
        return {**(self.outer or {}), **E.root(self.df.schema)}

    def to(self, df: DataFrame, order: tuple[tuple[str, int], ...] = ()) -> State:
        return replace(self, df=df, order=order)


def name(c: str) -> str:
    return f"`{c}`"


def _set(base: E.Value | None, parts: list[str], new: E.Value) -> E.Value:
    """base with the value at a path replaced or added; arrays on the way get it in every element."""
    if not parts:
        return new
    t = base.type if base else T.NullType()
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType)):
        made: list[E.Value] = []

        def body(x: Column) -> Column:
            made.append(_set(E.Value(x, t.elementType), parts, new))
            return made[-1].col

        out = F.transform(base.col, body)
        return E.Value(out, T.ArrayType(made[-1].type))
    if isinstance(t, T.MapType):
        inner = _set(E.Value(F.try_element_at(base.col, F.lit(parts[0])), t.valueType), parts[1:], new)
        one = F.create_map(F.lit(parts[0]), E.cast(inner, t.valueType))
        return E.Value(F.map_concat(F.map_filter(F.coalesce(base.col, F.create_map().cast(t)), lambda k, _: k != parts[0]), one), t)
    fields = {f.name: E.Value(base.col.getField(f.name), f.dataType) for f in t.fields} if isinstance(t, T.StructType) else {}
    fields[parts[0]] = _set(fields.get(parts[0]), parts[1:], new)
    return E.struct(fields)


def _add_fields(s: State, spec: dict[str, Any]) -> State:
    scope, columns = s.scope, {f.name: E.Value(F.col(name(f.name)), f.dataType) for f in s.df.schema.fields}

    def put(path: list[str], e: Any) -> None:
        if isinstance(e, dict) and e and not any(k.startswith("$") for k in e):
            for k, x in e.items():
                put([*path, *k.split(".")], x)
            return
        v = E.compile(e, scope)
        if e == "$$REMOVE":
            columns.pop(path[0], None) if len(path) == 1 else None
            return
        columns[path[0]] = _set(columns.get(path[0]), path[1:], v)

    for k, e in spec.items():
        put(k.split("."), e)
    return s.to(s.df.select(*(v.col.alias(k) for k, v in columns.items())), s.order)


def _is_flag(x: Any) -> bool:
    return isinstance(x, (bool, int, float)) and not isinstance(x, str)


def _without(v: E.Value, parts: list[str]) -> E.Value | None:
    if not parts:
        return None
    if isinstance(v.type, T.ArrayType):
        inner: list[E.Value | None] = []
        F.transform(v.col, lambda x: (inner.append(_without(E.Value(x, v.type.elementType), parts)), x)[1])
        if inner[-1] is None:
            return v
        return E.Value(F.transform(v.col, lambda x: _without(E.Value(x, v.type.elementType), parts).col), T.ArrayType(inner[-1].type))
    if isinstance(v.type, T.MapType):
        return E.Value(F.map_filter(v.col, lambda k, _: k != parts[0]), v.type) if len(parts) == 1 else v
    if not isinstance(v.type, T.StructType):
        return v
    out = {}
    for f in v.type.fields:
        x: E.Value | None = E.Value(v.col.getField(f.name), f.dataType)
        if f.name == parts[0]:
            x = _without(x, parts[1:])
        if x is not None:
            out[f.name] = x
    made = E.struct(out)
    return E.Value(F.when(v.col.isNotNull(), made.col), made.type)


def _unset(s: State, paths: list[str]) -> State:
    columns: dict[str, E.Value] = {f.name: E.Value(F.col(name(f.name)), f.dataType) for f in s.df.schema.fields}
    for p in paths:
        first, *rest = p.split(".")
        if first in columns:
            left = _without(columns[first], rest)
            columns.pop(first) if left is None else columns.update({first: left})
    return s.to(s.df.select(*(v.col.alias(k) for k, v in columns.items())), s.order)


def _only(v: E.Value, keep: dict[str, Any]) -> E.Value | None:
    """The parts of a value that a tree of inclusions keeps."""
    if isinstance(v.type, T.ArrayType):
        made: list[E.Value | None] = []
        F.transform(v.col, lambda x: (made.append(_only(E.Value(x, v.type.elementType), keep)), x)[1])
        if made[-1] is None:
            return None
        return E.Value(F.transform(v.col, lambda x: _only(E.Value(x, v.type.elementType), keep).col), T.ArrayType(made[-1].type))
    if isinstance(v.type, T.MapType):
        return E.Value(F.map_filter(v.col, lambda k, _: k.isin(list(keep))), v.type)
    if not isinstance(v.type, T.StructType):
        return None
    out = {}
    for k, below in keep.items():
        if k in v.type.names:
            x: E.Value | None = E.Value(v.col.getField(k), v.type[k].dataType)
            x = _only(x, below) if below else x
            if x is not None:
                out[k] = x
    made = E.struct(out)
    return E.Value(F.when(v.col.isNotNull(), made.col), made.type)


def _project(s: State, spec: dict[str, Any]) -> State:
    flat: dict[str, Any] = {}

    def flatten(prefix: str, e: Any) -> None:
        if isinstance(e, dict) and e and not any(k.startswith("$") for k in e):
            for k, x in e.items():
                flatten(f"{prefix}.{k}" if prefix else k, x)
        else:
            flat[prefix] = e

    for k, e in spec.items():
        flatten(k, e)
    out_paths = [k for k, e in flat.items() if _is_flag(e) and not e]
    if all(_is_flag(e) and not e for e in flat.values()):
        return _unset(s, out_paths)
    if any(k != "_id" for k in out_paths):
        raise PipelineError("$project can't both include and exclude")
    scope, tree, columns = s.scope, {}, {}
    if "_id" in s.df.columns and "_id" not in out_paths and not any(k.split(".")[0] == "_id" for k in flat):
        flat = {"_id": 1, **flat}
    for k, e in flat.items():
        if k in out_paths:
            continue
        parts = k.split(".")
        if _is_flag(e):
            at = tree.setdefault(parts[0], {})
            for p in parts[1:]:
                at = at.setdefault(p, {})
            if parts[0] not in columns:
                columns[parts[0]] = None
        else:
            v = E.compile(e, scope)
            base = columns.get(parts[0])
            columns[parts[0]] = _set(base, parts[1:], v)
    done = {}
    for k, v in columns.items():
        if v is None:
            own = scope.get(f"${k}")
            v = own if own is None or not tree[k] else _only(own, tree[k])
            if v is None:
                continue
        done[k] = v
    types = {k: F.lit(None).cast("string") if isinstance(v.type, T.NullType) else v.col for k, v in done.items()}
    if not types:
        return s.to(s.df.select(F.struct().alias("_id")).select(), ())
    kept = tuple((k, d) for k, d in s.order if k.split(".")[0] in done and tree.get(k.split(".")[0]) == {})
    return s.to(s.df.select(*(c.alias(k) for k, c in types.items())), kept if len(kept) == len(s.order) else ())


def _unwind(s: State, spec: Any) -> State:
    options = {"path": spec} if isinstance(spec, str) else spec
    parts, keep, index = options["path"].lstrip("$").split("."), options.get("preserveNullAndEmptyArrays"), options.get("includeArrayIndex")
    v = E.path(s.scope, ".".join(parts))
    if isinstance(v.type, T.NullType):
        return s if keep else s.to(s.df.where(F.lit(False)))
    if not isinstance(v.type, T.ArrayType):
        # a single value stands for itself
        df = s.df if keep else s.df.where(v.col.isNotNull())
        return s.to(df.withColumn(index, F.lit(None).cast("long")) if index else df, s.order)
    col = F.when(F.size(v.col) > 0, v.col) if keep else v.col
    if index:
        df = s.df.select("*", (F.posexplode_outer if keep else F.posexplode)(col).alias("__at", "__one"))
    else:
        df = s.df.select("*", (F.explode_outer if keep else F.explode)(col).alias("__one"))
    own = {f.name: E.Value(F.col(name(f.name)), f.dataType) for f in s.df.schema.fields}
    own[parts[0]] = _set(own[parts[0]], parts[1:], E.Value(F.col("__one"), v.type.elementType))
    columns = [x.col.alias(k) for k, x in own.items() if k != index]
    if index:
        columns.append(F.col("__at").cast("long").alias(index))
    return s.to(df.select(*columns), s.order)


# --- accumulators ----------------------------------------------------------------------------------


def _summed(v: E.Value) -> Column:
    t = "long" if isinstance(v.type, T.IntegralType) else "double"
    return F.coalesce(F.sum(E.number(v).cast(t)), F.lit(0).cast(t))


def _in_order(v: E.Value, last: bool, rank: Column | None) -> Column:
    if rank is None:
        return F.last(v.col) if last else F.first(v.col)
    # min_by passes over null values only if they are bare: the struct keeps them
    return (F.max_by if last else F.min_by)(F.struct(v.col.alias("v")), rank)["v"]


def _pushed(v: E.Value, rank: Column | None) -> Column:
    if rank is None:
        return F.collect_list(F.struct(v.col.alias("v")))["v"]
    return F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), v.col.alias("v")))), lambda x: x["v"])


def accumulator(spec: dict[str, Any], scope: E.Scope, rank: Column | None) -> Column:
    ((op, arg),) = spec.items()
    if op == "$count":
        return F.count(F.lit(1))
    v = E.compile(arg, scope)
    plain: dict[str, Callable[[], Column]] = {
        "$sum": lambda: F.count(F.lit(1)) * E.literal(arg).col if isinstance(arg, (int, float)) and not isinstance(arg, bool) else _summed(v),
        "$avg": lambda: F.avg(E.number(v)),
        "$min": lambda: F.min(v.col),
        "$max": lambda: F.max(v.col),
        "$first": lambda: _in_order(v, False, rank),
        "$last": lambda: _in_order(v, True, rank),
        "$push": lambda: _pushed(v, rank),
        "$addToSet": lambda: F.array_sort(F.collect_set(v.col)),
        "$stdDevPop": lambda: F.stddev_pop(E.number(v)),
        "$stdDevSamp": lambda: F.stddev_samp(E.number(v)),
    }
    if op not in plain:
        raise PipelineError(f"no accumulator {op}")
    return plain[op]()


def _ranked(s: State, needed: bool, keys: list[Column]) -> tuple[DataFrame, Column | None]:
    """A rank inside each group that follows the order of the last $sort."""
    if not needed or not s.order:
        return s.df, None
    by = [E.path(s.scope, k).col.asc() if d > 0 else E.path(s.scope, k).col.desc() for k, d in s.order]
    return s.df.withColumn("__rank", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*by))), F.col("__rank")


def _group(s: State, spec: dict[str, Any]) -> State:
    key, rest = E.compile(spec["_id"], s.scope), {k: v for k, v in spec.items() if k != "_id"}
    alone = isinstance(key.type, T.NullType)
    ordered = any(next(iter(a)) in ("$first", "$last", "$push") for a in rest.values())
    df, rank = _ranked(s, ordered, [] if alone else [key.col])
    aggs = [accumulator(a, s.scope, rank).alias(k) for k, a in rest.items()]
    if alone:
        out = df.agg(*aggs, F.count(F.lit(1)).alias("__n")).where("__n > 0")  # no documents, no group
        return s.to(out.select(F.lit(None).cast("string").alias("_id"), *map(name, rest)))
    grouped = df.groupBy(key.col.alias("_id"))
    return s.to(grouped.agg(*aggs) if aggs else grouped.agg(F.lit(1).alias("__n")).drop("__n"))


def _sort(s: State, spec: dict[str, int]) -> State:
    scope, by, order = s.scope, [], []
    for k, d in spec.items():
        v = E.path(scope, k)
        if isinstance(v.type, T.NullType):
            continue
        c = v.col
        if isinstance(v.type, T.MapType):
            c = F.to_json(c)
        elif isinstance(v.type, T.ArrayType):
            c = (F.array_min if d > 0 else F.array_max)(c)
        by.append(c.asc() if d > 0 else c.desc())
        order.append((k, int(d)))
    return s.to(s.df.orderBy(*by) if by else s.df, tuple(order))


def _lookup(s: State, spec: dict[str, Any]) -> State:
    foreign, into = s.collections[spec["from"]], spec["as"]
    let = {k: E.compile(e, s.scope) for k, e in spec.get("let", {}).items()}
    stages = spec.get("pipeline", [])
    keyed, keys = foreign, []
    left = s.df
    if "localField" in spec:
        v = E.path(s.scope, spec["localField"])
        left = left.withColumn("__k0", v.col)
        f = E.path(E.root(foreign.schema), spec["foreignField"])
        keyed = foreign.withColumn("__f0", f.col)
        if isinstance(f.type, T.ArrayType):
            keyed = keyed.withColumn("__f0", F.explode(F.array_distinct("__f0")))
        keys.append(0)
        many = isinstance(v.type, T.ArrayType)
    else:
        many = False
    if let:
        # equalities between a variable and a foreign path become join keys; the rest of the body runs on the right
        body, rest = [], []
        for st in stages:
            test = st.get("$match", {}).get("$expr") if not rest and set(st) == {"$match"} and set(st["$match"]) == {"$expr"} else None
            conjuncts = test["$and"] if isinstance(test, dict) and "$and" in test else [test] if test is not None else []
            left_over = []
            for c in conjuncts:
                pair = c.get("$eq") if isinstance(c, dict) else None
                var = next((x for x in pair or [] if isinstance(x, str) and x.startswith("$$") and x[2:].split(".")[0] in let), None)
                if var is None:
                    left_over.append(c)
                    continue
                other = next(x for x in pair if x != var)
                v = let[var[2:].split(".")[0]]
                for part in var[2:].split(".")[1:]:
                    v = E.step(v, part)
                n = len(keys)
                left, keyed = left.withColumn(f"__k{n}", v.col), keyed.withColumn(f"__f{n}", E.compile(other, E.root(foreign.schema)).col)
                keys.append(n)
            if test is None:
                rest.append(st)
            elif left_over:
                body.append({"$match": {"$expr": {"$and": left_over}}})
        stages = body + rest
        if any(f"$${k}" in str(stages) for k in let):
            raise PipelineError("a $lookup may use its variables in equalities of its first $match only")
    held = keyed.select(*(f"__f{n}" for n in keys), F.struct(*(name(c) for c in foreign.columns)).alias("__doc")) if keys else None
    if stages:
        if keys and any(k not in ("$match", "$project", "$addFields", "$set", "$unset", "$unwind") for st in stages for k in st):
            # stages that see all matches of one document together run per key
            inner = {c: E.Value(F.col(c), keyed.schema[c].dataType) for c in (f"__f{n}" for n in keys)}
            return _lookup_grouped(s, left, keyed, keys, stages, into, inner)
        done = run(keyed, [_carry(st, keys) for st in stages], s.collections)
        cols = [c for c in done.columns if not c.startswith("__f")]
        held = done.select(*(f"__f{n}" for n in keys), F.struct(*map(name, cols)).alias("__doc"))
    elif held is None:
        held = foreign.select(F.struct(*map(name, foreign.columns)).alias("__doc"))
    lists = F.collect_list("__doc").alias("__docs")
    if not keys:
        # uncorrelated: one list for all documents
        out = left.crossJoin(held.agg(lists))
    elif many:
        tagged = left.withColumn("__row", F.monotonically_increasing_id())
        hit = tagged.select("__row", F.explode(F.array_distinct("__k0")).alias("__k0")).join(held, F.col("__k0") == F.col("__f0")).groupBy("__row").agg(F.array_distinct(F.collect_list("__doc")).alias("__docs"))
        out = tagged.join(hit, "__row", "left").drop("__row")
    else:
        per = held.groupBy(*(f"__f{n}" for n in keys)).agg(lists)
        on = E._all([F.col(f"__k{n}").eqNullSafe(F.col(f"__f{n}")) for n in keys[:1]]) if "localField" in spec else F.col("__k0") == F.col("__f0")
        for n in keys[1:]:
            on = on & (F.col(f"__k{n}") == F.col(f"__f{n}"))
        out = left.join(per, on, "left")
    t = T.ArrayType(held.schema["__doc"].dataType)
    return s.to(out.withColumn(into, F.coalesce("__docs", F.array().cast(t))).select(*(name(c) for c in s.df.columns if c != into), name(into)))


def _carry(stage: dict[str, Any], keys: list[int]) -> dict[str, Any]:
    if "$project" in stage and not all(_is_flag(e) and not e for e in stage["$project"].values()):
        return {"$project": {**stage["$project"], **{f"__f{n}": 1 for n in keys}}}
    return stage


def _lookup_grouped(s: State, left: DataFrame, keyed: DataFrame, keys: list[int], stages: list[dict], into: str, inner: dict[str, E.Value]) -> State:
    """Bodies with $group, $sort or $limit: the stages run with the keys added to every group, and limits per key."""
    cols = [f"__f{n}" for n in keys]
    df, order = keyed, ()
    for st in stages:
        ((op, spec),) = st.items()
        state = State(df, s.collections, order)
        if op == "$group":
            key = E.compile(spec["_id"], state.scope)
            ident = key.col if not isinstance(key.type, T.NullType) else F.lit(None).cast("string")
            ranked, rank = _ranked(state, any(next(iter(a)) in ("$first", "$last", "$push") for k, a in spec.items() if k != "_id"), [F.col(c) for c in cols] + [ident])
            df = ranked.groupBy(*cols, ident.alias("_id")).agg(*(accumulator(a, state.scope, rank).alias(k) for k, a in spec.items() if k != "_id"))
            order = ()
        elif op == "$sort":
            order = tuple((k, int(d)) for k, d in spec.items())
        elif op in ("$limit", "$skip"):
            by = [E.path(state.scope, k).col.asc() if d > 0 else E.path(state.scope, k).col.desc() for k, d in order] or [F.lit(0)]
            n = df.withColumn("__n", F.row_number().over(Window.partitionBy(*cols).orderBy(*by)))
            df = (n.where(F.col("__n") <= spec) if op == "$limit" else n.where(F.col("__n") > spec)).drop("__n")
        elif op == "$count":
            df = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(spec))
        else:
            df = apply(State(df, s.collections), _carry(st, keys)).df
    state = State(df, s.collections, order)
    doc = F.struct(*(name(c) for c in df.columns if c not in cols))
    if order:
        df, rank = _ranked(state, True, [F.col(c) for c in cols])
        listed = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), doc.alias("d")))), lambda x: x["d"])
    else:
        listed = F.collect_list(doc)
    per = df.groupBy(*cols).agg(listed.alias("__docs"))
    on = E._all([F.col(f"__k{n}") == F.col(f"__f{n}") for n in keys])
    out = left.join(per, on, "left")
    return s.to(out.withColumn(into, F.coalesce("__docs", F.array().cast(per.schema["__docs"].dataType))).select(*(name(c) for c in s.df.columns if c != into), name(into)))


def _graph_lookup(s: State, spec: dict[str, Any]) -> State:
    """Breadth first, a join for each depth; ends when a round finds nothing new."""
    foreign, into = s.collections[spec["from"]], spec["as"]
    if spec.get("restrictSearchWithMatch"):
        foreign = run(foreign, [{"$match": spec["restrictSearchWithMatch"]}], s.collections)
    scope = E.root(foreign.schema)
    to, frm = E.path(scope, spec["connectToField"]), E.path(scope, spec["connectFromField"])
    nodes = foreign.select(to.col.alias("__to"), (frm.col if isinstance(frm.type, T.ArrayType) else F.array(frm.col)).alias("__next"), F.struct(*map(name, foreign.columns)).alias("__doc"))
    keep = lambda df: df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()
    base = keep(s.df.withColumn("__row", F.monotonically_increasing_id()))  # rows must not be numbered again in another order
    start = E.compile(spec["startWith"], s.scope)
    wave = base.select("__row", F.explode(start.col if isinstance(start.type, T.ArrayType) else F.array(start.col)).alias("__key")).where("__key is not null").distinct()
    seen, depth, most = None, 0, spec.get("maxDepth")
    while most is None or depth <= most:
        hit = wave.join(nodes, F.col("__key") == F.col("__to")).select("__row", "__to", "__next", "__doc", F.lit(depth).cast("long").alias("__depth"))
        if seen is not None:
            hit = hit.join(seen.select("__row", "__to").distinct(), ["__row", "__to"], "left_anti")
        hit = keep(hit)
        if hit.isEmpty():
            break
        seen = hit if seen is None else seen.unionByName(hit)
        wave = hit.select("__row", F.explode("__next").alias("__key")).where("__key is not null").distinct()
        depth += 1
    deep = spec.get("depthField")
    t = foreign.schema if not deep else T.StructType([*foreign.schema.fields, T.StructField(deep, T.LongType())])
    if seen is None:
        return s.to(base.drop("__row").withColumn(into, F.array().cast(T.ArrayType(t))))
    doc = F.col("__doc") if not deep else F.col("__doc").withField(deep, F.col("__depth"))
    per = seen.groupBy("__row").agg(F.collect_list(doc).alias(into))
    return s.to(base.drop(into).join(per, "__row", "left").withColumn(into, F.coalesce(into, F.array().cast(T.ArrayType(t)))).drop("__row"))


def _facet(s: State, spec: dict[str, list]) -> State:
    out = None
    for k, stages in spec.items():
        own = run_state(State(s.df, s.collections), stages)
        df, rank = _ranked(own, True, [])
        doc = F.struct(*(name(c) for c in own.df.columns))
        listed = F.collect_list(doc) if rank is None else F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), doc.alias("d")))), lambda x: x["d"])
        one = df.agg(listed.alias(k))
        out = one if out is None else out.crossJoin(one)  # one row each
    return s.to(out)


def _bucket(s: State, spec: dict[str, Any]) -> State:
    v, bounds = E.compile(spec["groupBy"], s.scope), spec["boundaries"]
    key = F.lit(spec.get("default")) if spec.get("default") is not None else F.lit(None)
    same = all(isinstance(x, (int, float)) for x in [*bounds, spec.get("default", 0)])
    to = (lambda x: F.lit(x)) if same else (lambda x: F.lit(x).cast("string"))
    key = to(spec["default"]) if "default" in spec else key
    for low, high in reversed(list(zip(bounds, bounds[1:], strict=False))):
        key = F.when((v.col >= F.lit(low)) & (v.col < F.lit(high)), to(low)).otherwise(key)
    output = spec.get("output", {"count": {"$sum": 1}})
    grouped = s.df.groupBy(key.alias("_id")).agg(*(accumulator(a, s.scope, None).alias(k) for k, a in output.items()))
    return s.to(grouped if "default" in spec else grouped.where("_id is not null"))


def _bucket_auto(s: State, spec: dict[str, Any]) -> State:
    """Buckets of near equal counts: values are counted first, so only distinct values are ranked."""
    v, n = E.compile(spec["groupBy"], s.scope), spec["buckets"]
    values = s.df.groupBy(v.col.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("__c").over(Window.partitionBy(F.lit(0)))
    no = values.select(F.col("__v").alias("__w"), F.least(F.lit(n - 1), F.floor((upto - F.col("__c")) * n / whole)).alias("__b"))
    output = spec.get("output", {"count": {"$sum": 1}})
    df = s.df.withColumn("__v", v.col).join(no, F.col("__v").eqNullSafe(F.col("__w"))).drop("__w")
    out = df.groupBy("__b").agg(F.min("__v").alias("min"), F.max("__v").alias("__top"), *(accumulator(a, s.scope, None).alias(k) for k, a in output.items()))
    top = F.coalesce(F.lead("min").over(Window.orderBy("__b")), F.col("__top"))
    return s.to(out.select(F.struct("min", top.alias("max")).alias("_id"), *map(name, output)))


def _window_fields(s: State, spec: dict[str, Any]) -> State:
    scope = s.scope
    part = E.compile(spec["partitionBy"], scope).col if spec.get("partitionBy") is not None else F.lit(0)
    by = [E.path(scope, k).col.asc() if d > 0 else E.path(scope, k).col.desc() for k, d in spec.get("sortBy", {}).items()]
    w = Window.partitionBy(part).orderBy(*by) if by else Window.partitionBy(part)
    end = {"unbounded": (Window.unboundedPreceding, Window.unboundedFollowing), "current": (0, 0)}
    columns: dict[str, Column] = {}
    for k, e in spec["output"].items():
        frame, ((op, arg),) = e.get("window", {}).get("documents"), [(a, b) for a, b in e.items() if a != "window"]
        over = w
        if frame:
            over = w.rowsBetween(*(end[x][i] if isinstance(x, str) else x for i, x in enumerate(frame)))
        elif "range" in e.get("window", {}):
            over = w.rangeBetween(*(end[x][i] if isinstance(x, str) else x for i, x in enumerate(e["window"]["range"])))
        else:
            over = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if op in ("$rank", "$denseRank", "$documentNumber"):
            c = {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number}[op]().over(w)
        elif op == "$shift":
            v = E.compile(arg["output"], scope)
            c = F.lag(v.col, -arg["by"], arg.get("default")).over(w)
        elif op == "$sum" and not isinstance(arg, (int, float)):
            v = E.compile(arg, scope)
            t = "long" if isinstance(v.type, T.IntegralType) else "double"
            c = F.coalesce(F.sum(E.number(v).cast(t)).over(over), F.lit(0).cast(t))
        elif op == "$push":
            c = F.collect_list(E.compile(arg, scope).col).over(over)
        elif op == "$addToSet":
            c = F.array_sort(F.collect_set(E.compile(arg, scope).col).over(over))
        else:
            plain = {"$first": F.first, "$last": F.last, "$min": F.min, "$max": F.max, "$avg": F.avg, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}
            c = F.count(F.lit(1)).over(over) * (arg if op == "$sum" else 1) if op in ("$sum", "$count") else plain[op](E.compile(arg, scope).col).over(over)
        columns[k] = c
    # windows are columns first: a dotted output goes into the field that its path names
    made = s.df.withColumns({f"__w{i}": c for i, c in enumerate(columns.values())})
    own = {f.name: E.Value(F.col(name(f.name)), f.dataType) for f in s.df.schema.fields}
    for i, k in enumerate(columns):
        path = k.split(".")
        own[path[0]] = _set(own.get(path[0]), path[1:], E.Value(F.col(f"__w{i}"), made.schema[f"__w{i}"].dataType))
    return s.to(made.select(*(v.col.alias(k) for k, v in own.items())), tuple(spec.get("sortBy", {}).items()))


def _densify(s: State, spec: dict[str, Any]) -> State:
    field, step_, bounds = spec["field"], spec["range"]["step"], spec["range"]["bounds"]
    parts = spec.get("partitionByFields", [])
    v = E.path(s.scope, field)
    df = s.df.withColumn("__v", v.col)
    unit = spec["range"].get("unit")
    every = F.expr(f"interval {step_} {unit}") if unit else F.lit(step_).cast(v.type)
    if bounds == "full":
        ends = df.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        grid = df.select(*map(name, parts)).distinct().crossJoin(ends) if parts else ends  # ends is one row
    elif bounds == "partition":
        grid = df.groupBy(*map(name, parts)).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    else:
        low, high = (F.lit(x).cast(v.type) for x in bounds)
        grid = (df.select(*map(name, parts)).distinct() if parts else df.agg(F.lit(1).alias("__x")).drop("__x")).withColumn("__lo", low).withColumn("__hi", high - every)
    grid = grid.where("__lo is not null").select(*map(name, parts), F.explode(F.sequence("__lo", "__hi", every)).alias("__v"))
    new = grid.join(df.select(*map(name, parts), "__v").distinct(), [*parts, "__v"], "left_anti")
    return s.to(s.df.unionByName(new.withColumnRenamed("__v", field), allowMissingColumns=True))


def _fill(s: State, spec: dict[str, Any]) -> State:
    parts = [F.col(name(x)) for x in spec.get("partitionByFields", [])] or ([E.compile(spec["partitionBy"], s.scope).col] if "partitionBy" in spec else [F.lit(0)])
    by = [F.col(name(k)).asc() if d > 0 else F.col(name(k)).desc() for k, d in spec.get("sortBy", {}).items()]
    columns = {}
    for k, how in spec["output"].items():
        c = F.col(name(k))
        if "value" in how:
            columns[k] = F.coalesce(c, E.compile(how["value"], s.scope).col)
            continue
        w = Window.partitionBy(*parts).orderBy(*by)
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        if how["method"] == "locf":
            columns[k] = F.last(c, ignorenulls=True).over(back)
        else:
            x = F.col(name(next(iter(spec["sortBy"])))).cast("double")
            at = F.when(c.isNotNull(), x)
            x0, y0, x1, y1 = F.last(at, True).over(back), F.last(c, True).over(back), F.first(at, True).over(ahead), F.first(c, True).over(ahead)
            columns[k] = F.coalesce(c.cast("double"), y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return s.to(s.df.withColumns(columns), s.order)


def _replace_root(s: State, e: Any) -> State:
    v = E.compile(e, s.scope)
    if not isinstance(v.type, T.StructType):
        raise PipelineError("the new root must be an object with known fields")
    return s.to(s.df.where(v.col.isNotNull()).select(*(v.col.getField(f).alias(f) for f in v.type.names)))


def _union(s: State, spec: Any) -> State:
    other = spec if isinstance(spec, str) else spec.get("coll")
    df = s.collections[other]
    if isinstance(spec, dict) and spec.get("pipeline"):
        df = run(df, spec["pipeline"], s.collections)
    return s.to(s.df.unionByName(df, allowMissingColumns=True))


def _sort_by_count(s: State, e: Any) -> State:
    return _sort(_group(s, {"_id": e, "count": {"$sum": 1}}), {"count": -1, "_id": 1})


# Names of the pipeline language.
STAGES: dict[str, Callable[[State, Any], State]] = {
    "$match": lambda s, x: s.to(s.df.where(match(x, s.scope)), s.order),
    "$project": _project,
    "$addFields": _add_fields,
    "$set": _add_fields,
    "$unset": lambda s, x: _unset(s, [x] if isinstance(x, str) else x),
    "$unwind": _unwind,
    "$group": _group,
    "$sort": _sort,
    "$limit": lambda s, x: s.to(s.df.limit(x), s.order),
    "$skip": lambda s, x: s.to(s.df.offset(x), s.order),
    "$count": lambda s, x: s.to(s.df.agg(F.count(F.lit(1)).alias(x)).where(F.col(name(x)) > 0)),
    "$sortByCount": _sort_by_count,
    "$bucket": _bucket,
    "$bucketAuto": _bucket_auto,
    "$lookup": _lookup,
    "$graphLookup": _graph_lookup,
    "$unionWith": _union,
    "$facet": _facet,
    "$setWindowFields": _window_fields,
    "$densify": _densify,
    "$fill": _fill,
    "$replaceRoot": lambda s, x: _replace_root(s, x["newRoot"]),
    "$replaceWith": _replace_root,
}


def apply(s: State, stage: dict[str, Any]) -> State:
    if len(stage) != 1:
        raise PipelineError(f"a stage has one operator, not {sorted(stage)}")
    ((op, spec),) = stage.items()
    if op not in STAGES:
        raise PipelineError(f"no stage {op}")
    return STAGES[op](s, spec)


def run_state(s: State, stages: list[dict[str, Any]]) -> State:
    for stage in rewrite(stages):
        s = apply(s, stage)
    return s


def run(df: DataFrame, stages: list[dict[str, Any]], collections: Collections | None = None) -> DataFrame:
    policy.check(stages)
    return run_state(State(df, collections or {}), stages).df


def aggregate(collections: Collections, text: str) -> DataFrame:
    """The DataFrame of a pipeline text over named collections."""
    collection, stages = parse(text)
    policy.check(stages, text)
    if collection not in collections:
        raise PipelineError(f"no collection {collection}")
    return run(collections[collection], stages, collections)

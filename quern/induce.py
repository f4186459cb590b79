"""Schema induction: paths, types, free keys and stored values of documents.

A document is read as JSON. Objects and arrays are opened as VARIANT entries, one Spark expression for
each level: to ``DEPTH`` and ``ITEMS`` of each array for the lattice of ``induce``, all of them for audits and value indexes. Everything that is
then known about a path is an aggregate over (path, document), so a collection of any size is induced
without gathering documents anywhere. Only the finished index, one entry for each path, reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH, ITEMS = 7, 8
# What keys look like that are data and not names.
DATA_KEY = r"^(?:\d{4}(?:-\d{1,2}){0,2}|\d{1,2}:\d{2}|[A-Z0-9]{2,}(?:[-_][A-Z0-9]+)*|[A-Z]|\d+(?:\.\d+)?)$"
FIELD_KEY = r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$"
NUMBER_KEY = r"^\d+(?:\.\d+)?$"
NAMED_MAP = r"(?:^by_|_by_|_bag$|_index$)"
# Names of fields that hold identifiers, and how many of their values are shown.
ID_FIELD, EXAMPLES = r"(?i)(?:^|_)(?:id|uuid|code|key)$", 2


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "bool").when(s == "VOID", "null").otherwise("number")


def levels(t: T.DataType) -> int | None:
    """Levels of nodes below a type; None if values of it may have any number."""
    if isinstance(t, T.VariantType):
        return None
    below = [f.dataType for f in t.fields] if isinstance(t, T.StructType) else [t.valueType] if isinstance(t, T.MapType) else [t.elementType] if isinstance(t, T.ArrayType) else None
    if below is None:
        return 0
    deep = [levels(x) for x in below]
    return None if None in deep else 1 + max(deep, default=0)


def walk(df: DataFrame, id_col: str = "_id", depth: int | None = None, items: int | None = None) -> DataFrame:
    """(doc, path, parent, key, kind, value, level, size): one row for every node of every document; array elements go by ``[]``.

    All levels and all elements, unless depth or items is given; size is the length of an array, whatever items is.
    """
    nodes = _nodes(df, id_col, depth, items)
    return nodes.drop("form", "shape")


def _nodes(df: DataFrame, id_col: str, depth: int | None, items: int | None) -> DataFrame:
    """walk() with form, the path in which each map's keys are ``<*>``, and shape, what is passed on the way: o object or field, k key of a map, a array."""
    if depth is None and (depth := levels(df.schema)) is None:
        depth = 16
        while not _nodes(df, id_col, depth, items).where(f"level = {depth} and kind in ('object', 'array')").isEmpty():
            depth *= 2
    doc = F.parse_json(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    none = F.lit(None).cast("string")
    now = df.select(F.col(id_col).cast("string").alias("doc"), F.lit("").alias("path"), none.alias("parent"), none.alias("key"), doc.alias("v"), F.lit(True).alias("open"), F.lit(0).alias("level"), F.lit("").alias("form"), F.lit("o").alias("shape"))
    # every round turns each node of the last level into itself and its children: one plan without branches
    for _ in range(depth):
        now = now.withColumn("map", F.when(F.col("open"), _is_map(F.col("key"), F.try_variant_get("v", "$", "map<string,variant>"))))
        below_ = lambda c: F.when(F.col(c) == "", F.lit("")).otherwise(F.concat(c, F.lit(".")))
        node = lambda path, key, v, form, shape: F.struct(path.alias("path"), F.col("path").alias("parent"), key.alias("key"), v.alias("v"), F.lit(True).alias("open"), (F.col("level") + 1).alias("level"), form.alias("form"), F.concat("shape", shape).alias("shape"))
        fields = F.transform(
            F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")),
            lambda e: node(F.concat(below_("path"), e["key"]), e["key"], e["value"], F.concat(below_("form"), F.when(F.col("map"), "<*>").otherwise(e["key"])), F.when(F.col("map"), "k").otherwise("o")),  # noqa: B023
        )
        array = F.try_variant_get("v", "$", "array<variant>")
        elements = F.transform(
            F.slice(array, 1, items) if items is not None else array,
            lambda x: node(F.concat("path", F.lit("[]")), none, x, F.concat("form", F.lit("[]")), F.when(_kind(x) == "object", "ao").otherwise("a")),  # noqa: B023
        )
        kind = _kind(F.col("v"))
        below = F.when(F.col("open") & (kind == "object"), fields).when(F.col("open") & (kind == "array"), elements)
        itself = F.array(F.struct("path", "parent", "key", "v", F.lit(False).alias("open"), "level", "form", "shape"))
        now = now.select("doc", F.explode(F.concat(itself, F.coalesce(below, F.slice(itself, 1, 0)))).alias("n")).select("doc", "n.*")
    typed = now.where("path <> ''").withColumn("kind", _kind(F.col("v")))
    return typed.select(
        "doc", "path", "parent", "key", "kind", F.when(F.col("kind").isin("string", "number", "bool"), F.try_variant_get("v", "$", "string")).alias("value"), "level",
        F.when(F.col("kind") == "array", F.size(F.try_variant_get("v", "$", "array<variant>"))).alias("size"), "form", "shape",
    )


def _is_map(leaf: Column, fields: Column) -> Column:
    """Are the keys of this one object data? By the audit's rule: by its name, or if there are two and all look like data."""
    leaf, keys = F.coalesce(leaf, F.lit("")), F.map_keys(fields)
    data = lambda k: k.rlike(r"^\d+$| ") | (k.rlike(r"\d") & k.rlike("[-/:]")) | ((F.length(k) >= 24) & k.contains("-"))
    return F.coalesce((F.size(keys) > 0) & ~leaf.startswith("_") & (leaf.rlike(NAMED_MAP) | ((F.size(keys) >= 2) & F.forall(keys, data))), F.lit(False))


def object_keys(nodes: DataFrame) -> DataFrame:
    """(path, docs, keys, average, data_like, field_like, numeric): the keys of each object path over all documents."""
    per_key = nodes.where("key is not null").groupBy("parent", "key").agg(F.count(F.lit(1)).alias("n"))
    like = lambda rx: F.count_if(F.col("key").rlike(rx))
    keys = per_key.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("members"), like(DATA_KEY).alias("data_like"), like(FIELD_KEY).alias("field_like"), like(NUMBER_KEY).alias("numeric"))
    docs = nodes.where("kind = 'object'").groupBy("path").agg(F.count(F.lit(1)).alias("objects"))
    return keys.join(docs, "path").withColumn("average", F.col("members") / F.col("objects"))


#: Name -> when the keys of a path are data, over object_keys().
RULES: dict[str, str] = {
    "prolific": "keys > greatest(8, 3 * average) and keys > 6",
    "data_dominated": "data_like >= greatest(2, 0.6 * keys) and data_like >= field_like",
    "numeric": "numeric >= 0.6 * keys and keys >= 2",
    "named": f"regexp_like(path, '{NAMED_MAP}')",
    "wide": "keys > 24 or (keys > 12 and data_like >= 4)",
}
#: The rules of each user of the index: the solver's default, the audit's and the viewer's.
RULE_SETS = {"default": ("prolific", "data_dominated"), "signals": ("prolific", "data_dominated", "numeric"), "audit": ("named", "data_dominated"), "viewer": ("named", "wide")}


def key_signals(nodes: DataFrame) -> DataFrame:
    """(path, numeric, uniform, as_value): further signs that a path's keys are data.

    numeric: most keys are numbers. uniform: objects have but part of the keys (under 85 %), three or more there are, and all members have one
    form. as_value: most keys are stored as values too, compared in normal form by a join.
    """
    keys = object_keys(nodes).select("path", "keys", "average", F.col("numeric").alias("numbers"))
    inner = nodes.where("key is not null").groupBy(F.col("parent").alias("doc_parent"), "doc", "path", "kind").agg(F.lit(1).alias("_")).select("doc_parent", "doc", "path", "kind")
    below = nodes.where("key is not null").select("doc", F.col("parent").alias("path"), F.col("key").alias("k")).groupBy("doc", "path").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("form"))
    member = inner.join(below, ["doc", "path"], "left").select(F.col("doc_parent").alias("path"), F.concat_ws(":", "kind", "form").alias("form")).where("form <> 'null'")
    forms = member.groupBy("path").agg(F.count_distinct("form").alias("forms"))
    stored = nodes.where("value is not null").select(normal(F.col("value")).alias("norm")).distinct().withColumn("stored", F.lit(1))
    named = nodes.where("key is not null").select(F.col("parent").alias("path"), "key").distinct().withColumn("norm", normal(F.col("key"))).join(stored, "norm", "left").groupBy("path").agg(F.count("stored").alias("as_values"))
    most = lambda c: F.coalesce(F.col(c), F.lit(0)) >= F.greatest(F.lit(2.0), 0.6 * F.col("keys"))
    uniform = (F.col("keys") >= 3) & (F.col("average") < 0.85 * F.col("keys")) & (F.coalesce("forms", F.lit(0)) == 1)
    return keys.join(forms, "path", "left").join(named, "path", "left").select("path", most("numbers").alias("numeric"), uniform.alias("uniform"), most("as_values").alias("as_value"))


def dynamic_paths(nodes: DataFrame, rules: str = "default") -> list[str]:
    """Paths whose keys are data. Judged again once keys are collapsed, so that maps inside maps are found too."""
    cond = " or ".join(f"({RULES[r]})" for r in RULE_SETS[rules])
    found: list[str] = []
    for _ in range(3):
        own = nodes if not found else collapse(nodes, found)
        new = {r.path for r in object_keys(own).where(cond).where("path <> ''").select("path").collect()} - set(found)
        if rules == "signals":
            new |= {r.path for r in key_signals(own).where("(numeric or uniform or as_value) and path <> ''").select("path").collect()} - set(found)
        if not new:
            break
        found = sorted({*found, *new}, key=lambda p: (p.count("."), p))
    return found



def collapse(nodes: DataFrame, dynamic: list[str]) -> DataFrame:
    """The nodes with every key that is data replaced by ``<*>`` in paths and parents."""
    out = nodes
    for p in sorted(dynamic, key=lambda p: (p.count("."), p)):
        rx = "^(" + re.escape(p).replace(r"<\*>", r"<\*>") + r")\.[^.\[]+"
        for c in ("path", "parent"):
            out = out.withColumn(c, F.regexp_replace(c, rx, "$1.<*>"))
    return out


@dataclass
class Index:
    """What is known of a collection: type counts by path, and maps whose keys are data."""

    collection: str
    types: dict[str, dict[str, int]] = field(default_factory=dict)
    dynamic: list[str] = field(default_factory=list)
    example: str = "<*>"

    @property
    def paths(self) -> set[str]:
        """All paths without marks for arrays, with every prefix."""
        out = set()
        for p in self.types:
            parts = p.replace("[]", "").split(".")
            out |= {".".join(parts[: i + 1]) for i in range(len(parts))}
        return out

    def dominant(self, path: str) -> str:
        return max(sorted(self.types[path]), key=lambda k: self.types[path][k])

    def resolves(self, dotted: str) -> bool:
        """Does a path of a pipeline lead anywhere? Any key will do below a map whose keys are data."""
        want = dotted.split(".")
        return any(len(want) <= len(own) and all(a in ("<*>", b) for a, b in zip(own, want, strict=False)) for own in (p.split(".") for p in self.paths))

    def card(self, most: int = 400, mode: str = "lattice") -> str:
        """The shallowest paths with their types, as text; mode toplevel shows fields of the document alone, nocollapse an example for each key that is data."""
        own = sorted(self.types, key=lambda p: (p.count(".") + p.count("[]"), p))
        if mode == "toplevel":
            own = [p for p in own if "." not in p and "[]" not in p]
        show = lambda p: p.replace("<*>", self.example) if mode == "nocollapse" else p
        return "\n".join(f"{self.collection}.{show(p)}: {self.dominant(p)}" for p in own[:most])


def induce(df: DataFrame, collection: str, rules: str = "default", id_col: str = "_id") -> Index:
    nodes = walk(df, id_col, DEPTH, ITEMS)
    dynamic = dynamic_paths(nodes, rules)
    counts = collapse(nodes, dynamic).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")).collect()
    index = Index(collection, dynamic=dynamic)
    for r in counts:
        index.types.setdefault(r.path, {})[r.kind] = r.n
    return index


def lattice(nodes: DataFrame) -> DataFrame:
    """(path, kind, n, dominant): nodes of each path by kind; dominant marks the most common kind (of equal ones the first by name)."""
    from pyspark.sql import Window

    counts = nodes.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("dominant", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "kind")) == 1)


def shape_profile(nodes: DataFrame, documents: int) -> DataFrame:
    """(path, present, kinds, least, most, average): share of documents that have a path, its kinds, and the lengths of its arrays."""
    return nodes.groupBy("path").agg(
        F.round(F.count_distinct(F.when(F.col("kind") != "null", F.col("doc"))) / F.lit(max(1, documents)), 6).alias("present"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"),
        F.min("size").alias("least"), F.max("size").alias("most"), F.round(F.avg("size"), 6).alias("average"),
    )


def id_examples(nodes: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(path, example): the least values of fields whose names say that they identify."""
    own = nodes.where("value is not null").where(F.element_at(F.split("path", r"[.]"), -1).rlike(ID_FIELD)).select("path", F.col("value").alias("example")).distinct()
    from pyspark.sql import Window

    return own.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("example"))).where(F.col("n") <= most).drop("n")


def frequent_keys(nodes: DataFrame, most: int = 10) -> DataFrame:
    """(path, key, n): the most frequent keys of each path."""
    from pyspark.sql import Window

    counts = nodes.where("key is not null").groupBy(F.col("parent").alias("path"), "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "key"))).where(F.col("r") <= most).drop("r")


def introspect(nodes: DataFrame, dynamic: list[str]) -> DataFrame:
    """(path, kind, dynamic): the dominant kind of each path, keys that are data collapsed, and whether its keys are."""
    return lattice(collapse(nodes, dynamic)).where("dominant").select("path", "kind", F.col("path").isin(*dynamic).alias("dynamic") if dynamic else F.lit(False).alias("dynamic"))


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s_\-]+", " "))


def value_index(nodes: DataFrame, collection: str, dynamic: list[str], places: int = 20) -> DataFrame:
    """(norm, collection, path, kind, form): where a value is stored, strings of 2 to 60 characters and keys that are data.

    nodes has to be a walk() without limits: a value left out of it counts as stored nowhere.
    """
    own = collapse(nodes, dynamic)
    values = own.where("kind = 'string' and length(value) between 2 and 60").select("path", F.lit("value").alias("kind"), F.col("value").alias("form"))
    keys = own.where("path like '%<*>' and key is not null").select("path", F.lit("key").alias("kind"), F.col("key").alias("form"))
    forms = values.unionByName(keys).groupBy(normal(F.col("form")).alias("norm"), "path", "kind", "form").agg(F.count(F.lit(1)).alias("n"))
    return forms.select("norm", F.lit(collection).alias("collection"), "path", "kind", "form", "n").groupBy("norm").agg(F.slice(F.sort_array(F.collect_set(F.struct("collection", "path", "kind", "form"))), 1, places).alias("at")).select("norm", F.explode("at").alias("a")).select("norm", "a.*")


def literals(question: str) -> dict[str, list[str]]:
    """Values that a question names: quoted text, words in capitals and dates for sure, names by their capitals perhaps."""
    hard = re.findall(r"\"([^\"]+)\"|'([^']+)'|\b(\d{4}-\d{2}(?:-\d{2})?)\b|\b([A-Z][A-Z0-9_-]{1,})\b", question)
    soft = re.findall(r"(?<!^)(?<![.!?] )\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b", question)
    return {"hard": list(dict.fromkeys(x for m in hard for x in m if x)), "soft": list(dict.fromkeys(soft))}


def witnesses(index: DataFrame, named: list[str], most: int = 6) -> dict[str, list[dict]]:
    """For each literal the places where it is stored: exactly, or for a date prefix the values that start with it."""
    out: dict[str, list[dict]] = {}
    for x in named:
        norm = " ".join(re.sub(r"[\s_\-]+", " ", x.lower()).split())
        hit = index.where(F.col("norm") == norm).limit(most + 1).collect()
        if not hit and re.fullmatch(r"\d{4}(-\d{2}){0,2}", x):
            hit = index.where(F.col("form").startswith(x)).orderBy("form").limit(most).collect()
        out[x] = [r.asDict() for r in hit]
    return out


def audit(df: DataFrame, id_col: str = "_id") -> dict:
    """Depth, maps by the audit's rule, (least, most, average) array lengths, presence of each top field, shapes and presence states, over all levels and elements.

    rich says only that there are four levels, a map and an array; gate() asks for more.
    """
    nodes = _nodes(df, id_col, None, None).cache()
    n = df.count()
    dynamic = dynamic_paths(nodes, "audit")
    depth = nodes.agg(F.max("level")).first()[0] or 0
    lengths = nodes.where("kind = 'array'").groupBy("form").agg(F.min("size"), F.max("size"), F.avg("size")).collect()
    present = nodes.where("parent = '' and kind <> 'null'").groupBy("key").agg(F.countDistinct("doc").alias("n")).collect()
    shapes = {k: sorted(r.form for r in nodes.where(cond).select("form").distinct().collect()) for k, cond in SHAPES.items()}
    states = nodes.where("key is not null and kind = 'string'").groupBy(F.lower("value").alias("state")).count().where(F.col("state").isin(*STATES)).collect()
    nodes.unpersist()
    return {
        "documents": n, "depth": depth, "dynamic": dynamic, "arrays": {r[0]: tuple(r[1:]) for r in lengths}, "presence": {r.key: r.n / n if n else 0.0 for r in present},
        "rich": depth >= 4 and bool(dynamic) and bool(lengths), "shapes": shapes, "states": {r.state: r["count"] for r in states},
    }


#: Name -> nodes that complete a shape, over what _nodes() passes on the way: a map of arrays of objects, and an array of objects that hold a map.
SHAPES = {"key_array_object": "shape rlike 'o.*k.*a.*o' and (key is null or shape like '%k')", "array_object_key": "shape rlike 'a.*o.*k' and shape like '%k'"}
STATES = ("present", "missing", "empty", "null")


def gate(*reports: dict, least: int = 4) -> list[str]:
    """What the collections of a database, by their audits, lack of native structure; nothing if they pass."""
    depth = max((r["depth"] for r in reports), default=0)
    has = lambda k, *names: any(r[k].get(x) for r in reports for x in names)
    out = [] if depth >= least else [f"depth {depth}, at least {least} is asked for"]
    out += [f"no path of shape {x}" for x in SHAPES if not has("shapes", x)]
    return out if has("states", "present") and has("states", *STATES[1:]) else [*out, "no presence states"]

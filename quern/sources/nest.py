"""Helpers that nest flat rows into documents: maps keyed by data, event arrays, tags, presence states.

Each takes and returns DataFrames or Columns; grouping aggregates before it shuffles wherever the
result allows, and a document is never larger than the rows of its own entity.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(prefix: str, *parts: Column) -> Column:
    """A readable document key such as ``customer:17``."""
    return F.concat_ws(":", F.lit(prefix), *(p.cast("string") for p in parts))


def safe_key(c: Column) -> Column:
    """A map key that paths can address: no dot, no dollar sign, no white space."""
    return F.regexp_replace(F.replace(F.replace(c, F.lit("."), F.lit("_dot_")), F.lit("$"), F.lit("S")), r"\s+", "_")


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def keyed_map(rows: DataFrame, by: Sequence[str], map_key: Column, values: Mapping[str, Column], into: str, ordered: bool = True) -> DataFrame:
    """One row for each ``by``: a map from key to a struct of aggregates, in key order; null keys are left out. Not ordered: for values that hold maps."""
    inner = rows.withColumn("__k", map_key).where("__k is not null").groupBy(*by, "__k").agg(*(c.alias(k) for k, c in values.items()))
    pair = F.struct(F.col("__k").alias("key"), F.struct(*values).alias("value"))
    pairs = F.collect_list(pair)
    return inner.groupBy(*by).agg(F.map_from_entries(F.array_sort(pairs) if ordered else pairs).alias(into))


def event_array(rows: DataFrame, by: Sequence[str], order: Sequence[Column], fields: Mapping[str, Column], into: str, most: int | None = None) -> DataFrame:
    """One row for each ``by``: its events as array of structs, in order; with ``most``, the first so many."""
    if most:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most)
    pair = F.struct(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("o"), F.struct(*(c.alias(k) for k, c in fields.items())).alias("e"))
    listed = F.collect_list(pair)
    if "map<" in rows.select(*fields.values()).schema.simpleString():  # maps have no order: compare what is sorted by alone
        ordered = F.array_sort(listed, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    else:
        ordered = F.sort_array(listed)
    return rows.groupBy(*by).agg(F.transform(ordered, lambda x: x["e"]).alias(into))


def tags(cases: Mapping[str, Column]) -> Column:
    """The names of the conditions that hold."""
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in cases.items())), lambda x: x.isNotNull())


def presence(c: Column, empty: Column | None = None) -> Column:
    """null, empty or present, in words."""
    out = F.when(c.isNull(), "null")
    if empty is not None:
        out = out.when(empty, "empty")
    return out.otherwise("present")


def value_state(c: Column) -> Column:
    return F.struct(c.alias("value"), presence(c).alias("presence_state"))


def unpivot_map(columns: Sequence[str]) -> Column:
    """Sparse columns as a map of those that have a value."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*map(F.col, columns))), lambda _, v: v.isNotNull())


def code_map(columns: Mapping[str, Column], groups: Mapping[str, str], bucket: Callable[[Column], Column]) -> Column:
    """Columns as a map from code to value, presence state, group and bucket."""
    cell = lambda k, c: F.struct(c.alias("value"), presence(c).alias("presence_state"), F.lit(groups[k]).alias("group"), bucket(c).alias("bucket"))
    return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(cell(k, c) for k, c in columns.items())))


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group; ``order`` should end with a unique column."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*by, "__r.*")


def lower_quantile(values: Column, p: float) -> Column:
    """The order statistic at int((n - 1) * p) of an array."""
    kept = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.get(kept, F.floor((F.size(kept) - 1) * F.lit(p)).cast("int"))


def adjacency(edges: DataFrame, a: str, b: str, by: Sequence[str], into: str) -> DataFrame:
    """Undirected edges as a map from node to its sorted neighbours."""
    both = edges.select(*by, F.col(a).alias("__n"), F.col(b).alias("__m")).unionByName(edges.select(*by, F.col(b).alias("__n"), F.col(a).alias("__m")))
    lists = both.groupBy(*by, "__n").agg(F.array_sort(F.collect_set("__m")).alias("__ms"))
    return lists.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("__n").cast("string").alias("key"), F.col("__ms").alias("value"))))).alias(into))

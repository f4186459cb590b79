"""Table access, bounded reads and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.policy import canonical_value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; gzip is read as it is."""
    return spark.read.json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", "UTF-8").csv(path)


def preview(df: DataFrame, n: int = 5) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.limit(n).collect()]


def bounded(df: DataFrame, most: int) -> tuple[list[dict[str, Any]], bool]:
    """At most ``most`` rows, and whether there are more: one row beyond is read as proof."""
    rows = df.limit(most + 1).collect()
    return [r.asDict(recursive=True) for r in rows[:most]], len(rows) > most


def stream(df: DataFrame) -> Iterator[dict[str, Any]]:
    for r in df.toLocalIterator():
        yield r.asDict(recursive=True)


def front(df: DataFrame, n: int, order: str = "_id") -> DataFrame:
    """The first n documents in key order: a sample that reruns repeat."""
    return df.orderBy(order).limit(n)


def numbered(df: DataFrame, order: str = "_id") -> DataFrame:
    """df with ``_ord``, each document's place from 0 in key order: range partitions are counted, then numbered from their offsets."""
    parts = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    parts = parts.withColumn("__n", nth)
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__p", F.coalesce(F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each partition
    return parts.join(F.broadcast(before), "__p").withColumn("_ord", F.col("__before") + F.col("__n") - 1).drop("__p", "__n", "__before")


def stride(df: DataFrame, n: int, order: str = "_id") -> DataFrame:
    """Every k-th document in key order, k being count / n rounded up."""
    step = max(1, -(-df.count() // n))
    return numbered(df, order).where(F.pmod("_ord", F.lit(step)) == 0).drop("_ord")


def counted(collections: Mapping[str, DataFrame]) -> list[tuple[str, int]]:
    """The collections of a world with their numbers of documents."""
    return [(name, collections[name].count()) for name in sorted(collections)]


def find_one(df: DataFrame, condition: Any, fields: Sequence[str] = ()) -> dict[str, Any] | None:
    """One document that meets a condition, with the fields asked for; None if there is none."""
    rows = df.where(condition).select(*(fields or ["*"])).limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else None


def snapshot(collections: Mapping[str, DataFrame], n: int, order: str = "_id") -> dict[str, list[Any]]:
    """The first n documents of every collection, fit for JSON."""
    return {name: [json.loads(r.j) for r in front(df, n, order).select(F.to_json(F.struct("*")).alias("j")).collect()] for name, df in sorted(collections.items())}


def digest(df: DataFrame, n: int = 3, most: int = 60, order: str = "_id") -> dict[str, Any]:
    """The first documents with long texts and arrays cut, and the texts seen in them."""
    seen: set[str] = set()

    def short(x: Any) -> Any:
        if isinstance(x, str):
            seen.add(x[:most])
            return x[:most]
        return {k: short(v) for k, v in x.items()} if isinstance(x, dict) else [short(v) for v in x[:n]] if isinstance(x, list) else x

    return {"documents": [short(x) for x in snapshot({"own": df}, n, order)["own"]], "values": sorted(seen)}


def observed(df: DataFrame, rows: int = 5, most: int = 2000) -> dict[str, Any]:
    """What a look at a result shows: how many rows there are, and the first ones as text of bounded length."""
    text = json.dumps(preview(df, rows), default=str, ensure_ascii=False)
    return {"rows": df.count(), "shown": text[:most], "cut": len(text) > most}


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON catalogue or workload: an array of objects, a row for each."""
    return spark.read.option("multiLine", True).json(path)


def extended(df: DataFrame) -> DataFrame:
    """Documents with values in Extended JSON ({"$oid": ...}, {"$date": ...}) as plain columns of text."""
    plain = lambda f: F.coalesce(*(F.col(f"`{f.name}`").getField(k.name).cast("string") for k in f.dataType.fields)).alias(f.name)
    wrapped = lambda f: isinstance(f.dataType, T.StructType) and f.dataType.fields and all(k.name in ("$oid", "$date", "$numberLong") for k in f.dataType.fields)
    return df.select(*(plain(f) if wrapped(f) else F.col(f"`{f.name}`") for f in df.schema.fields))


def release(spark: SparkSession, path: str, dbs: Sequence[str] = (), ids: Sequence[Any] = (), most: int | None = None) -> DataFrame:
    """The records of a release, by database and id, in order of both."""
    rows = catalogue(spark, path)
    if dbs:
        rows = rows.where(F.col("db_id").isin(*dbs))
    if ids:
        rows = rows.where(F.col("record_id").isin(*ids))
    rows = rows.orderBy("db_id", "record_id")
    return rows.limit(most) if most else rows


def by_join_key(df: DataFrame, key: str, table_name: str, buckets: int = 64) -> None:
    """What stands for an index: a table bucketed by a join key, so that joins on it need no shuffle. Results don't depend on it."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table_name)


def to_yaml(x: Any, indent: int = 0) -> str:
    """Plain data as YAML; texts are written as JSON does, which YAML reads."""
    pad = "  " * indent
    if isinstance(x, dict) and x:
        return "".join(f"{pad}{json.dumps(str(k))}:" + (f"\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {to_yaml(v).strip()}\n") for k, v in x.items())
    if isinstance(x, list) and x:
        return "".join(f"{pad}-" + (f"\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {to_yaml(v).strip()}\n") for v in x)
    return f"{pad}{json.dumps(x, ensure_ascii=False, default=str)}\n"


def to_markdown(rows: Sequence[dict[str, Any]]) -> str:
    """Rows as a table of Markdown."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *(line(["" if r.get(k) is None else r[k] for k in names]) for r in rows)])


def exists(df: DataFrame, condition: Any) -> bool:
    return not df.where(condition).limit(1).isEmpty()


def raw_documents(df: DataFrame, n: int = 3, most_bytes: int = 12_288, order: str = "_id") -> list[dict[str, Any]]:
    """The first documents as JSON, cut to so many bytes, with hashes of the whole and of the visible text."""
    out = []
    for r in front(df, n, order).select(F.to_json(F.struct("*")).alias("j")).collect():
        whole = r.j.encode()
        seen = whole[:most_bytes].decode("utf-8", "ignore")
        out.append({"text": seen, "truncated": len(whole) > most_bytes, "sha256": hashlib.sha256(whole).hexdigest(), "visible_sha256": hashlib.sha256(seen.encode()).hexdigest()})
    return out


def world_signature(collections: dict[str, DataFrame]) -> str:
    """A hash of all documents of all collections, whatever their order: row hashes are summed where they are."""
    parts = {}
    for name, df in sorted(collections.items()):
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
        a = df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("x")).agg(F.count(F.lit(1)), F.sum("x")).first()
        parts[name] = [a[0], str(a[1] or 0)]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("row"))


def write(df: DataFrame, path: str, kind: str = "json") -> None:
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes)) if kind == "csv" else df
    writer = flat.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def normalised(rows: list[dict[str, Any]]) -> list[Any]:
    return [canonical_value(r) for r in rows]

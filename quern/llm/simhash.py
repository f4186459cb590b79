"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link when at most two bits differ. They are cut into two segments of 32 bits:
of two linked fingerprints, one segment differs by at most one bit. Every fingerprint is indexed under
each segment with each one of its bits blanked; equal keys meet in an equality join and pairs are
verified on all 64 bits. Equal fingerprints are one row throughout, so copies never multiply.

Pairs of a bucket grow with its square, so a bucket of more than ``pairs_up_to`` different fingerprints isn't
expanded into pairs; for it there is an exact way without pairs. Its members are
indexed under their whole fingerprint and its 64 one-bit neighbours instead: two fingerprints share
such a key exactly if at most two bits differ, so each key links its members to the least of them, with
no pair to verify and no link lost.

Defined cases: null and blank texts have fingerprint zero and link like others; texts of fewer words
than a shingle are one shingle; null ids get a component but never name one (null if it has no other);
repeated rows each get a row; an empty table gives no rows; further columns are ignored, and
``representatives`` carries them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.llm.graph import components

SHINGLE, SEED = 3, 42
PAIRS_UP_TO = 32
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: only A-Z, and only the white space from tab to return
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in words], out=starts[1:])
    ends = starts[min(SHINGLE, len(words)) :] - 1
    counts, at = np.zeros(64, dtype=np.int64), 0
    while at < n:
        own = slice(at, min(n, at + BLOCK))
        pieces = map(joined.__getitem__, map(slice, starts[own].tolist(), ends[own].tolist()))
        hashes = np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), dtype="<u8", count=own.stop - own.start)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at = own.stop
    bits = np.packbits(2 * counts > n, bitorder="little").view("<i8")
    return int(bits[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def links(fps: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Edges (u, v) that connect exactly what links of at most two bits connect, from distinct fingerprints (fp)."""
    # key: segment (1 bit), blanked bit (5), segment without it (32)
    segment = "transform(array(shiftrightunsigned(fp, 32), fp & 4294967295L), (s, k) -> transform(sequence(0, 31), i -> shiftleft(cast(k * 32 + i as bigint), 32) | (s & ~shiftleft(1L, i))))"
    variants = fps.select("fp", F.explode(F.flatten(F.expr(segment))).alias("key"))
    shared = written(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = written(variants.join(shared, "key"))
    few = members.where(F.col("n") <= pairs_up_to).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = "flatten(transform(fps, (a, i) -> transform(filter(slice(fps, i + 2, size(fps)), b -> bit_count(a ^ b) <= 2), b -> struct(a as u, b as v))))"
    edges = few.select(F.explode(F.expr(pairs)).alias("e")).select("e.*").distinct()
    crowd = members.where(F.col("n") > pairs_up_to).select("fp").distinct()
    near = crowd.select("fp", F.explode(F.expr("array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp)")).alias("key"))
    near = written(near)
    hubs = written(near.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("other")).where("hub <> other").drop("other"))
    stars = near.join(hubs, "key").select(F.col("fp").alias("u"), F.col("hub").alias("v")).where("u <> v").distinct()
    return edges.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(id, fp, component): component is the least id that links lead to, the document's own included."""
    sigs = written(fingerprints(docs, id_col, text_col))
    fps = sigs.groupBy("fp").agg(F.min("id").alias("least"))
    fps = written(fps)
    roots = written(components(links(fps.select("fp"), pairs_up_to)).withColumnRenamed("node", "fp"))
    rooted = written(fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = written(rooted.join(least, "root").select("fp", "component"))
    return sigs.join(named, "fp").select("id", "fp", "component")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """The rows of docs that stay: one for each component, the one with the least id (of rows that share it, the least text hash)."""
    keyed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))
    found = near_duplicates(keyed.select(F.struct("_id", "_h").alias("_key"), "_text"), "_key", "_text", pairs_up_to)
    # ids are compared with their text's hash, null ids last; structs of a null id are equal where null ids aren't
    first = F.min(F.struct(F.col("id._id").isNull().alias("n"), F.col("id._id").alias("i"), F.col("id._h").alias("h"))).alias("k")
    stay = found.groupBy("component").agg(first).select(F.struct("k.i").alias("_i"), F.col("k.h").alias("_h"))
    rows = keyed.drop("_text").withColumn("_i", F.struct(F.col("_id").alias("i")))
    kept = rows.join(written(stay), ["_i", "_h"]).withColumn("_no", F.row_number().over(Window.partitionBy("_i", "_h").orderBy(F.lit(0))))
    return kept.where("_no = 1").select("_row.*")

"""Sharding by a hierarchical weighted hash tree.

A document descends from the root to a region, then to a rack, then to a shard. At each node every
child draws ``-ln(u) / weight`` with u from the hash of the document's key and the child's name, and
the least draw wins: a child gets documents in proportion to its weight (the sum of its leaves), and a
draw depends on that child alone. So changing weights moves documents only into or out of the subtrees
whose weights change. A new shard is a new region: no weight inside the old regions changes, and the
only movement is into the new shard.

Slots number a shard's documents from 0 without gaps, in hash order or, for a table that was written in an
order, in that order (``placed``: by file and row). They are counted per (shard, hash bucket or block of a
file) first and numbered inside it, so no shard has to pass through one task.

Defined cases: null text has no bytes (size 1) and the CRC of the empty string; null doc_id is hashed as
a value of its own; repeated rows get slots of their own (of equal rows either may come first); null and repeated
ids are dealt to buckets by their texts too; an empty table gives no rows; further columns are carried if asked for, and one that has the name of a column made here gets
``input_`` before it; internal names start with ``_shard_``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import common

BUCKETS = 1024
#: Rows of a file that are numbered at a time.
BLOCK = 4096
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """Shards 0 to n - 1 of equal weight, per_rack to a rack and racks to a region."""
    return [Leaf(f"region{i // (racks * per_rack)}", f"rack{i // per_rack}", i) for i in range(shards)]


def grown(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    n = max(x.shard for x in leaves) + 1
    return [*leaves, Leaf(f"region+{n}", f"rack+{n}", n, weight)]


def _descend(key: Column, leaves: Sequence[Leaf], level: int) -> Column:
    """The shard that the key reaches below a node whose leaves are given."""
    name = (lambda x: x.region, lambda x: f"{x.region}/{x.rack}", lambda x: f"{x.region}/{x.rack}/{x.shard}")[level]
    children: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        children.setdefault(name(leaf), []).append(leaf)
    below = [F.lit(own[0].shard) if level == 2 else _descend(key, own, level + 1) for own in children.values()]
    if len(below) == 1:
        return below[0]

    def draw(child: str, own: list[Leaf]) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child)), 11).cast("double") + 0.5) / float(1 << 53)
        return -F.log(u) / sum(x.weight for x in own)

    draws = [draw(child, own) for child, own in children.items()]
    out = below[-1]
    least = F.least(*draws)
    for d, b in reversed(list(zip(draws[:-1], below[:-1], strict=True))):
        out = F.when(d == least, b).otherwise(out)
    return out


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    return _descend(key, [x for x in leaves if x.weight > 0], 0).cast("int")


def placed(docs: DataFrame) -> tuple[DataFrame, Column, Column] | None:
    """A Parquet table with its rows' places: (table with _shard_file and _shard_row, block, place in it); None for other tables."""
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("_shard_file"), F.col("_metadata.row_index").alias("_shard_row"))
    except AnalysisException:  # not read from files
        return None
    return rows, F.struct("_shard_file", F.floor(F.col("_shard_row") / BLOCK).alias("block")), F.col("_shard_row")


def assign(docs: DataFrame, leaves: Sequence[Leaf], id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), more: Sequence[Leaf] | None = None, buckets: int = BUCKETS, in_order: bool = False) -> DataFrame:
    """id, ``carry``, size, text_crc32, law, shard, slot and, for the tree ``more``, grown_shard; in_order: slots in the order in which docs was written."""
    carried = dict.fromkeys([id_col, *carry])
    kept, names = [F.col(c) for c in carried], {c.lower() for c in [*carried, *MADE]}
    out = []
    for c in carried:
        name = c
        if c.lower() in MADE:
            while name.lower() in names:
                name = f"input_{name}"
            names.add(name.lower())
        out.append(F.col(c).alias(name))
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = placed(docs) if in_order else None
    source, bucket, place = order or (docs, F.pmod(F.xxhash64(F.col(id_col), text), F.lit(buckets)).cast("int"), F.xxhash64(F.col(id_col), text))
    rows = source.select(
        *kept, (F.octet_length(text) + 1).cast("long").alias("_shard_size"), F.crc32(text).alias("_shard_crc"), shard_of(F.col(id_col), leaves).alias("_shard_no"),
        (shard_of(F.col(id_col), more) if more else F.lit(None).cast("int")).alias("_shard_grown"), place.alias("_shard_place"), bucket.alias("_shard_bucket"),
    )
    keys = ["_shard_no", "_shard_bucket"]
    cells = common.written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_shard_n")))
    earlier = Window.partitionBy("_shard_no").orderBy("_shard_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, F.coalesce(F.sum("_shard_n").over(earlier), F.lit(0)).alias("_shard_offset"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_shard_place", id_col, "_shard_crc", "_shard_size"))
    return rows.join(cells, keys).withColumn("_shard_slot", F.col("_shard_offset") + number - 1).select(
        *out, F.col("_shard_size").alias("size"), F.col("_shard_crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("_shard_no").alias("shard"), F.col("_shard_slot").cast("long").alias("slot"), F.col("_shard_grown").alias("grown_shard"),
    )

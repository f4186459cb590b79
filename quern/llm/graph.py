"""Connected components of an edge table, kept distributed.

Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", SoCC 2014): the rounds needed grow with the logarithm of the longest chain, not its length.
Each round is written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, written

#: A hub's edges are dealt to so many tasks.
SALTS = 8


def _with_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u's neighbours. The join is salted, since a hub may have most edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("s", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "s"]).drop("s")


def components(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """From edges (u, v): (node, root) for every node of an edge; root is the component's least node."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), partitions)
    stamp = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
    mark = stamp(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        down = _with_min(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = down.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old, now = now, written(small, partitions)
        forget(old)
        before, mark = mark, stamp(now)
        if mark == before:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

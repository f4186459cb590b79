"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words and a weight schedule over training time t in [0, 1]: its rate at
equally spaced knots, straight between them, scaled so that it integrates to the target. A document's place
in its source's words is found with running sums; inverting the source's integrated schedule gives the time
at which that place is due, and the cumulative demand of all sources at that time is its training position,
in words from the start of the mix. Documents are sorted by range of position.

A source's documents are passed through in hash order, again from the start while its target asks for
more, and the pass that reaches the target ends there: taken words add up to the target to the word.

Running sums never put a source into one task: rows are dealt to ``buckets`` hash buckets a source, by id and
text, bucket totals are summed first, and the running sum is taken inside a bucket.

Defined cases: null text has size 0; null source is a source of its own, last in order; null and repeated ids
are told apart by their texts; rows that repeat entirely count each on their own, and as they are equal it
doesn't matter which comes first; an empty table gives an empty mix; further columns are carried by
``curriculum`` and ignored by ``plan``; internal names start with ``_mix_``, so they meet none of the input's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import common

WEIGHTS = (1, 2, 3)
#: Rates at equally spaced knots of training time, given to sources in turn: growing, even, falling.
SCHEDULES = ((0.4, 1.6), (1.0, 1.0), (1.6, 0.4))
CAP = 3
BUCKETS = 1024


def _repeating(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def _integrals(schedule: Sequence[float]) -> tuple[list[float], list[float]]:
    """The rates scaled to integrate to 1, and their integral up to each knot."""
    n = len(schedule) - 1
    parts = [(a + b) / 2 / n for a, b in zip(schedule, schedule[1:])]
    total = sum(parts)
    done = [sum(parts[:i]) / total for i in range(n + 1)]
    return [x / total for x in schedule], [*done[:-1], 1.0]


def due(share: Column, schedule: Sequence[float]) -> Column:
    """The time in [0, 1] at which the integrated schedule reaches a share of its whole."""
    rates, done = _integrals(schedule)
    n, out = len(rates) - 1, None
    for j in range(n):
        # within a stretch the integral is (b v + a v * v) / n, with v in [0, 1]
        a, b, rest = (rates[j + 1] - rates[j]) / 2, rates[j], F.greatest(F.lit(0.0), share - F.lit(done[j])) * n
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(b * b) + 4 * a * rest)) + F.lit(b)
        at = (F.least(F.lit(1.0), F.when(rest > 0, 2 * rest / root).otherwise(F.lit(0.0))) + j) / n
        out = at if out is None else F.when(share >= F.lit(done[j]), at).otherwise(out)
    return out


def reached(time: Column, schedule: Sequence[float]) -> Column:
    """The share of its whole that the integrated schedule has reached at a time."""
    rates, done = _integrals(schedule)
    n, out = len(rates) - 1, F.lit(0.0)
    for j in range(n):
        v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), time * n - j))
        out = out + (F.lit(rates[j]) * v + F.lit((rates[j + 1] - rates[j]) / 2) * v * v) / n
    return out


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, cap: int = CAP) -> DataFrame:
    """From (_mix_source, source_size): weight, schedule's number and target of every source, and all targets by schedule.

    Targets are min(cap * size, level * weight) at the level where they add up to all words. In order
    of cap * size / weight a source is capped exactly if the level left by those before it is above
    its own, so running sums replace the repeated resharing. One row per source is all that is sorted.
    """
    ranked = sizes.withColumn("_mix_rank", F.row_number().over(Window.orderBy(F.col("_mix_source").isNull(), "_mix_source")))
    ranked = ranked.withColumn("weight", _repeating([float(w) for w in weights], F.col("_mix_rank"))).withColumn("schedule", F.pmod(F.col("_mix_rank") - 1, F.lit(len(schedules))).cast("int"))
    ranked = ranked.withColumn("_mix_cap", cap * F.col("source_size"))
    by_level = Window.orderBy(F.col("_mix_cap") / F.col("weight"), "_mix_rank")
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("_mix_level", rest / rest_weight).withColumn("_mix_capped", F.col("_mix_cap") <= F.col("_mix_level") * F.col("weight"))
    # the first that is not capped gives the level of all the rest
    final = F.first(F.when(~F.col("_mix_capped"), F.col("_mix_level")), ignorenulls=True).over(everything)
    target = F.when(F.col("_mix_capped"), F.col("_mix_cap")).otherwise(final * F.col("weight")).cast("double")
    whole = level.select("_mix_source", "source_size", "weight", "schedule", target.alias("target"))
    every = Window.orderBy("_mix_source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return whole.withColumn("_mix_demand", F.array(*(F.sum(F.when(F.col("schedule") == k, F.col("target")).otherwise(0.0)).over(every) for k in range(len(schedules)))))


def _placed(docs: DataFrame, keep: Sequence[str], id_col: str, text_col: str, source_col: str, weights, schedules, cap, buckets) -> DataFrame:
    rows = docs.select(*keep, F.col(source_col).alias("_mix_source"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit("mix")).alias("_mix_hash"), common.n_words(F.col(text_col)).alias("_mix_size"))
    rows = rows.withColumn("_mix_bucket", F.pmod(F.col("_mix_hash"), F.lit(buckets)).cast("int")).withColumn("_mix_null", F.col("_mix_source").isNull()).withColumn("_mix_key", F.coalesce("_mix_source", F.lit("")))
    cells = rows.groupBy("_mix_key", "_mix_null", "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_cell"))
    cells = common.written(cells.withColumn("_mix_source", F.when(~F.col("_mix_null"), F.col("_mix_key"))))
    goals = targets(cells.groupBy("_mix_source").agg(F.sum("_mix_cell").alias("source_size")), weights, schedules, cap)
    goals = goals.withColumn("_mix_null", F.col("_mix_source").isNull()).withColumn("_mix_key", F.coalesce("_mix_source", F.lit(""))).drop("_mix_source")
    earlier = Window.partitionBy("_mix_key", "_mix_null").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_mix_key", "_mix_null", "_mix_bucket", F.coalesce(F.sum("_mix_cell").over(earlier), F.lit(0)).alias("_mix_offset")).join(goals, ["_mix_key", "_mix_null"])
    in_cell = Window.partitionBy("_mix_key", "_mix_null", "_mix_bucket").orderBy("_mix_hash", id_col, "_mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.drop("_mix_source").join(cells, ["_mix_key", "_mix_null", "_mix_bucket"])
    return rows.withColumn("_mix_start", F.col("_mix_offset") + F.sum("_mix_size").over(in_cell) - F.col("_mix_size"))


def _taken(copy: Column | int) -> Column:
    """Words that pass number ``copy`` takes of a document."""
    left = F.round("target").cast("long") - copy * F.col("source_size") - F.col("_mix_start")
    return F.greatest(F.lit(0), F.least(left, F.col("_mix_size"))).cast("long")


def _position(copy: Column | int, schedules: Sequence[Sequence[float]]) -> Column:
    """Where in the mix that pass takes it: the demand of all sources when its middle word is due."""
    share = F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("_mix_start") + _taken(copy) / 2) / F.greatest("target", F.lit(1.0)))
    time = F.coalesce(*(F.when(F.col("schedule") == k, due(share, x)) for k, x in enumerate(schedules)))
    return sum((F.get("_mix_demand", F.lit(k)) * reached(time, x) for k, x in enumerate(schedules)), F.lit(0.0))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, cap: int = CAP, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: size, its source's size and target, words taken over all passes, and the position of its
    first pass (null if nothing is taken), sorted by range of that position."""
    rows = _placed(docs, [id_col], id_col, text_col, source_col, weights, schedules, cap, buckets)
    taken = sum((_taken(j) for j in range(1, cap)), _taken(0))
    out = rows.select(id_col, F.col("_mix_size").alias("size"), F.col("source_size").cast("long"), "target", taken.alias("taken"), F.when(_taken(0) > 0, _position(0, schedules)).alias("first_position"))
    return out.repartitionByRange("first_position", id_col).sortWithinPartitions("first_position", id_col)


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, cap: int = CAP, buckets: int = BUCKETS, position: str | None = "mix_position") -> DataFrame:
    """The mix itself: whole documents, one row for each pass that takes at least half of the document, with the
    column ``position`` (none if None), sorted by range of it. Documents without a word have no training position and are left out."""
    # the input's columns travel in one struct, so that their names meet none of those made here
    packed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_mix_row"), F.col(id_col).alias("_mix_id"), F.col(text_col).alias("_mix_text"), F.col(source_col).alias("_mix_from"))
    rows = _placed(packed, ["_mix_row", "_mix_id"], "_mix_id", "_mix_text", "_mix_from", weights, schedules, cap, buckets)
    passes = F.filter(F.array(*(F.struct(_taken(j).alias("taken"), _position(j, schedules).alias("at")) for j in range(cap))), lambda x: (x["taken"] > 0) & (2 * x["taken"] >= F.col("_mix_size")))
    mixed = rows.select("_mix_row", "_mix_id", F.explode(passes).alias("_mix_pass")).select("_mix_row", "_mix_id", F.col("_mix_pass.at").alias("_mix_at"))
    ordered = mixed.repartitionByRange("_mix_at", "_mix_id").sortWithinPartitions("_mix_at", "_mix_id")
    return ordered.select("_mix_row.*", *([F.col("_mix_at").alias(position)] if position else []))

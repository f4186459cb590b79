"""Result comparison and scoring.

Rows are compared by canonical value: names don't matter at the top level, nested names do, numbers are
rounded to 12 digits and integral floats equal integers, booleans are no numbers. Rows of two DataFrames
are compared where they are, as counts of canonical rows; what needs a matching inside one task works on
lists that are bounded by a cap.
"""

from __future__ import annotations

import decimal
import json
import math
from collections import Counter
from collections.abc import Iterable, Sequence
from decimal import Decimal
from fractions import Fraction
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.policy import canonical_value

CAP, SURPLUS = 100_000, 2
# Outcomes, in order of precedence.
OUTCOMES = ("correct", "invalid", "exec_error", "row_count_exceeded", "empty", "order_only", "row_subset", "row_superset", "value_mismatch", "no_submission")

Row = dict[str, Any]


def value_key(x: Any) -> str:
    tag = "b" if isinstance(x, bool) else ""
    return tag + json.dumps(canonical_value(x), sort_keys=True, ensure_ascii=False)


def row_key(row: Row) -> tuple[str, ...]:
    """The values of a row as a sorted multiset."""
    return tuple(sorted(value_key(v) for v in row.values()))


def same_rows(gold: Sequence[Row], got: Sequence[Row], ordered: bool = False) -> bool:
    a, b = [row_key(r) for r in gold], [row_key(r) for r in got]
    return a == b if ordered else Counter(a) == Counter(b)


def _within(gold: tuple[str, ...], got: tuple[str, ...], surplus: float) -> bool:
    return len(got) - len(gold) <= surplus and not Counter(gold) - Counter(got)


def matches(gold: Sequence[Row], got: Sequence[Row], ordered: bool = False, surplus: float = SURPLUS) -> bool:
    """Every gold row lies in a predicted row of its own with at most ``surplus`` further columns."""
    if len(gold) != len(got):
        return False
    a, b = [row_key(r) for r in gold], [row_key(r) for r in got]
    if ordered:
        return all(_within(x, y, surplus) for x, y in zip(a, b, strict=True))
    # equal rows pair off only if none has a surplus: else a surplus row might need the exact one's place
    if Counter(a) == Counter(b):
        return True
    kinds_a, kinds_b = Counter(a), Counter(b)
    ways = {x: [y for y in kinds_b if _within(x, y, surplus)] for x in kinds_a}
    return _saturates(kinds_a, kinds_b, ways)


def _saturates(need: Counter, have: Counter, ways: dict) -> bool:
    """Can all needs be met, each kind only by kinds that suit it? Augmenting paths over kinds with counts."""
    use: dict[Any, Counter] = {y: Counter() for y in have}
    left = Counter(have)

    def place(x: Any, seen: set) -> bool:
        for y in ways[x]:
            if y in seen:
                continue
            seen.add(y)
            if left[y]:
                left[y] -= 1
                use[y][x] += 1
                return True
            for z in list(use[y]):
                if use[y][z] and place(z, seen):
                    use[y][z] -= 1
                    use[y][x] += 1
                    return True
        return False

    return all(place(x, set()) for x, n in need.items() for _ in range(n))


def row_f1(gold: Sequence[Row], got: Sequence[Row]) -> float:
    if not gold and not got:
        return 1.0
    if not gold or not got:
        return 0.0
    shared = sum((Counter(map(row_key, gold)) & Counter(map(row_key, got))).values())
    return round(2 * shared / (len(gold) + len(got)), 6)


def outcome(gold: Sequence[Row], got: Sequence[Row] | None, *, ordered: bool = False, invalid: bool = False, error: bool = False, exceeded: bool = False) -> str:
    if invalid:
        return "invalid"
    if error or got is None:
        return "exec_error"
    if exceeded:
        return "row_count_exceeded"
    if matches(gold, got, ordered):
        return "correct"
    if not got and gold:
        return "empty"
    a, b = Counter(map(row_key, gold)), Counter(map(row_key, got))
    if a == b:  # the rows are right, only their order can be wrong
        return "order_only" if ordered else "value_mismatch"
    if not b - a:
        return "row_subset"
    if not a - b:
        return "row_superset"
    return "value_mismatch"


def score(gold: Sequence[Row], got: Sequence[Row] | None, *, ordered: bool = False, **state: bool) -> dict[str, Any]:
    kind = outcome(gold, got, ordered=ordered, **state)
    return {"exc": int(kind == "correct"), "exf1": row_f1(gold, got) if got is not None and not any(state.values()) else 0.0 if not state.get("exceeded") else None, "outcome": kind}


# --- DataFrames ------------------------------------------------------------------------------------


def _canon(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return F.concat(F.lit("b"), c.cast("string"))
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        r = F.round(c.cast("double"), 12)
        return F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(r.cast("string"))
    if isinstance(t, T.StringType):
        return F.to_json(F.struct(c.alias("s")))
    if isinstance(t, T.StructType):
        return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f.name + ":"), F.coalesce(_canon(c.getField(f.name), f.dataType), F.lit("null"))) for f in sorted(t.fields, key=lambda f: f.name))), F.lit("}"))
    if isinstance(t, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(_canon(x, t.elementType), F.lit("null"))), ","), F.lit("]"))
    if isinstance(t, T.MapType):
        e = F.array_sort(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit(":"), F.coalesce(_canon(x["value"], t.valueType), F.lit("null")))))
        return F.concat(F.lit("{"), F.array_join(e, ","), F.lit("}"))
    return c.cast("string")


def keyed_rows(df: DataFrame) -> DataFrame:
    """(key): each row's values, canonical and sorted."""
    return df.select(F.array_join(F.array_sort(F.array(*(F.coalesce(_canon(F.col(f"`{f.name}`"), f.dataType), F.lit("null")) for f in df.schema.fields))), "\x1f").alias("key"))


def difference(gold: DataFrame, got: DataFrame) -> DataFrame:
    """(key, gold, got): canonical rows that the two have different counts of."""
    side = lambda df, n: keyed_rows(df).withColumn("side", F.lit(n))
    both = side(gold, 0).unionByName(side(got, 1))
    return both.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("gold"), F.count_if(F.col("side") == 1).alias("got")).where("gold <> got")


def equal_frames(gold: DataFrame, got: DataFrame) -> bool:
    """Equal as multisets of canonical rows, of any size."""
    return difference(gold, got).isEmpty()


def frame_f1(gold: DataFrame, got: DataFrame) -> float:
    side = lambda df, n: keyed_rows(df).withColumn("side", F.lit(n))
    c = side(gold, 0).unionByName(side(got, 1)).groupBy("key").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    shared, a, b = c.agg(F.sum(F.least("a", "b")), F.sum("a"), F.sum("b")).first()
    return 1.0 if not (a or b) else 0.0 if not a or not b else round(2 * shared / (a + b), 6)


# --- summaries -------------------------------------------------------------------------------------


def with_missing(scores: DataFrame, tasks: DataFrame, systems: DataFrame) -> DataFrame:
    """A zero row for every task that a system has no prediction for, so that the denominator stays."""
    every = tasks.select("db_id", "record_id").crossJoin(F.broadcast(systems.select("system_id").distinct()))  # systems are few: one row for each evaluated
    absent = every.join(scores, ["system_id", "db_id", "record_id"], "left_anti")
    zero = absent.select("system_id", "db_id", "record_id", F.lit(0).alias("exc"), F.lit(0.0).alias("exf1"), F.lit("no_submission").alias("outcome"))
    return scores.unionByName(zero, allowMissingColumns=True)


def summary(scores: DataFrame, by: Sequence[str] = ("system_id",)) -> DataFrame:
    """Means with their coverage; null metrics are left out of the mean and make it incomplete."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("exc"), 6).alias("exc"), F.round(F.avg("exf1"), 6).alias("exf1"), F.count("exf1").alias("exf1_n"), (F.count("exf1") == F.count(F.lit(1))).alias("complete"))


def slices(scores: DataFrame, axes: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes))).alias("s")
    return summary(scores.select("system_id", "exc", "exf1", pairs).select("system_id", "exc", "exf1", "s.*"), ["system_id", "axis", "value"])


def distribution(scores: DataFrame) -> DataFrame:
    """Count and share of each outcome, zeros kept."""
    counts = scores.groupBy("system_id").pivot("outcome", list(OUTCOMES)).count().na.fill(0)
    kinds = F.explode(F.array(*(F.struct(F.lit(o).alias("outcome"), F.col(o).alias("n")) for o in OUTCOMES))).alias("o")
    total = sum((F.col(o) for o in OUTCOMES), F.lit(0))
    return counts.select("system_id", total.alias("t"), kinds).select("system_id", "o.*", F.round(F.col("o.n") / F.col("t"), 6).alias("share"))


def _log_factorial(n: int) -> Decimal:
    """To over 30 decimal places: Stirling's series from 1,000 on, whose next term is below 1e-35."""
    if n < 1000:
        return Decimal(math.factorial(n)).ln()
    x, pi = Decimal(n), Decimal("3.14159265358979323846264338327950288419716939937510582097494459")
    series = sum(1 / (Decimal(c) * x**i) for c, i in ((12, 1), (-360, 3), (1260, 5), (-1680, 7), (1188, 9)))
    return x * x.ln() - x + (2 * pi * x).ln() / 2 + series


def mcnemar(wins: int, losses: int) -> float:
    """Exact two-sided p-value of a paired comparison, to a double's precision.

    2,048 pairs on, in time with their square root: the binomials below the largest are summed in units of 2^-256 of it until they vanish.
    """
    n, k = wins + losses, min(wins, losses)
    if n < 2048:
        tail = term = 1
        for i in range(k):
            term = term * (n - i) // (i + 1)
            tail += term
        return float(min(Fraction(1), Fraction(2 * tail, 1 << n)))
    tail = term = 1 << 256
    for i in range(k, 0, -1):
        term = term * i // (n - i + 1)
        if not term:
            break
        tail += term
    with decimal.localcontext(decimal.Context(prec=60, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        largest = (_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * Decimal(2).ln()).exp()
        return float(min(Decimal(1), 2 * largest * tail / (1 << 256)))


def paired(scores: DataFrame, reference: str) -> DataFrame:
    """Wins, losses, difference and p-value of each system against one of them, task by task."""
    ref = scores.where(F.col("system_id") == reference).select("db_id", "record_id", F.col("exc").alias("ref"))
    rows = scores.where(F.col("system_id") != reference).join(ref, ["db_id", "record_id"])
    counts = rows.groupBy("system_id").agg(F.count_if((F.col("exc") == 1) & (F.col("ref") == 0)).alias("wins"), F.count_if((F.col("exc") == 0) & (F.col("ref") == 1)).alias("losses"), F.round(F.avg(F.col("exc") - F.col("ref")), 6).alias("delta"))
    out = [(*r, mcnemar(r.wins, r.losses)) for r in counts.collect()]  # a row for each system
    return scores.sparkSession.createDataFrame(out, "system_id string, wins long, losses long, delta double, p_value double")


def vote(candidates: Sequence[dict[str, Any]]) -> dict[str, Any] | None:
    """The candidate of the largest group of equal results; ties by violations, emptiness and place. Each has rows, violations."""
    groups: list[list[int]] = []
    for i, c in enumerate(candidates):
        if c.get("rows") is None:
            continue
        home = next((g for g in groups if same_rows(candidates[g[0]]["rows"], c["rows"])), None)
        home.append(i) if home else groups.append([i])
    rank = lambda i: (candidates[i].get("violations", 0), not candidates[i]["rows"], i)
    if not groups:
        return None
    best = min(groups, key=lambda g: (-len(g), min(map(rank, g))))
    return {**candidates[min(best, key=rank)], "votes": len(best)}


# Names of probes, their further columns, and whether a sound metric accepts them.
PROBES = {"id_leak": (1, True), "double_helper": (2, True), "triple_surplus": (3, False), "full_doc_dump": (8, False), "empty_result": (None, False), "constant_scalar": (None, False)}
SWEEP = (0, 1, 2, 3, math.inf)


def probes(gold: Sequence[Row]) -> dict[str, list[Row]]:
    """Predictions that a sound metric treats in known ways; a constant is one row even where no row is asked for."""
    more = lambda n: [{**r, **{f"extra_{i}": f"x{i}" for i in range(n)}} for r in gold]
    nothing = {"empty_result": [], "constant_scalar": [{"c": 0}] * max(1, len(gold))}
    return {k: nothing[k] if n is None else more(n) for k, (n, _) in PROBES.items()}


def surplus_sweep(gold: Sequence[Row], levels: Iterable[float] = SWEEP, ordered: bool = False) -> list[dict[str, Any]]:
    """What each probe gets at each level of surplus, and whether that is right."""
    return [{"probe": k, "surplus": b, "passes": (p := matches(gold, rows, ordered, b)), "right": p == PROBES[k][1]} for k, rows in probes(gold).items() for b in levels]


def least_sound_surplus(golds: Iterable[tuple[Sequence[Row], bool]], levels: Iterable[float] = SWEEP) -> dict[str, Any]:
    """The least level at which every probe of every gold result (rows, ordered) is treated rightly, and how many are at each level."""
    levels, sound, n = list(levels), Counter(), 0
    for gold, ordered in golds:
        n += 1
        sweep = surplus_sweep(gold, levels, ordered)
        sound.update(b for b in levels if all(r["right"] for r in sweep if r["surplus"] == b))
    fit = [b for b in levels if n and sound[b] == n and b != math.inf]
    return {"surplus": min(fit, default=None), "agrees": bool(fit) and min(fit) == SURPLUS, "results": n, "sound": {b: sound[b] for b in levels}}


def self_scores(gold: Sequence[Row], ordered: bool = False) -> list[str]:
    """What is wrong with a gold result on its own: it must match itself fully, and have rows."""
    out = [] if matches(gold, gold, ordered) and row_f1(gold, gold) == 1.0 else ["does not match itself"]
    return out if gold else [*out, "empty"]


def same_named_rows(gold: Sequence[Row], got: Sequence[Row], ordered: bool = False) -> bool:
    """Equal with names: every row as its canonical form."""
    a, b = ([value_key(r) for r in rows] for rows in (gold, got))
    return a == b if ordered else Counter(a) == Counter(b)


class TooManyRows(ValueError):
    """A gold result over the cap: the comparison wasn't made, which says nothing about a prediction."""


def compared(gold: DataFrame, got: DataFrame, ordered: bool = False, cap: int = CAP) -> dict[str, Any]:
    """score() of two results, read no further than needed: a gold result over the cap is an error, and a prediction is read to one row more than the gold one has, which settles it."""
    rows = gold.limit(cap + 1).collect()
    if len(rows) > cap:
        raise TooManyRows(f"more than {cap} rows")
    have = got.limit(len(rows) + 1).collect()
    dicts = lambda rs: [r.asDict(recursive=True) for r in rs]
    return score(dicts(rows), dicts(have), ordered=ordered, **({"exceeded": True} if len(have) > len(rows) else {}))


# --- counterfactuals -------------------------------------------------------------------------------


def shadowed(df: DataFrame, n: int, id_col: str = "_id") -> DataFrame:
    """df and n documents of the same form whose values are out of every range that it has: true queries don't see them."""

    def moved(c: Column, t: T.DataType, salt: Column) -> Column:
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(moved(c.getField(f.name), f.dataType, salt).alias(f.name) for f in t.fields)))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: moved(x, t.elementType, salt))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, v: moved(v, t.valueType, salt))
        if isinstance(t, T.BooleanType):
            return ~c
        if isinstance(t, T.NumericType):
            far = F.lit(910_000_000) + salt
            return F.when(c.isNotNull(), (far + 0.5 if isinstance(t, T.FractionalType) else far).cast(t))
        if isinstance(t, T.StringType):
            return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}"), F.lit("1066-10-14")).otherwise(F.when(c.isNotNull(), F.concat(F.lit("shadow "), salt.cast("string"))))
        return c

    few = df.orderBy(id_col).limit(n).withColumn("__salt", F.xxhash64(id_col) % 10_000)
    shadows = few.select(*((F.concat(F.lit("shadow:"), F.col(id_col).cast("string")) if f.name == id_col and isinstance(f.dataType, T.StringType) else moved(F.col(f"`{f.name}`"), f.dataType, F.col("__salt"))).alias(f.name) for f in df.schema.fields))
    return df.unionByName(shadows)


def counterfactual(collections: dict[str, DataFrame], gold: Any, got: Any, n: int = 20, of: Sequence[str] | None = None) -> dict[str, bool | None]:
    """Is a prediction right for the right reason? gold and got: collections -> result.

    Shadows are added to the collections. If they change the gold result the test says nothing; else the prediction has to match as before.
    """
    grown = {k: shadowed(df, n) if of is None or k in of else df for k, df in collections.items()}
    before, after = gold(collections), gold(grown)
    kept = equal_frames(before, after)
    match = lambda world: equal_frames(before, got(world))
    was = match(collections)
    return {"gold_kept": kept, "matched": was, "flips": (was != match(grown)) if kept else None}


def entropy(counts: Sequence[int]) -> float:
    """Normalised to 1 for equal shares."""
    total, n = sum(counts), len(counts)
    if n < 2 or not total:
        return 0.0
    return -sum(c / total * math.log2(c / total) for c in counts if c) / math.log2(n)

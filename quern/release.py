"""Releases of records (a question and its pipeline): contracts, shares, duplicates, diversity, slots, selection and sanitising.

Records have the columns of a release file: record_id, db_id, nl_queries (canonical, colloquial), MQL, difficulty,
sql_infeasibility_class, shape_policy, schema_flex, world_signature, canonical_form_set (must_not_contain). A column that
a table lacks counts as null in all its rows.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import PipelineError
from quern.plans import policy
from quern.plans.parse import parse

# What a record may say of itself.
DIFFICULTIES = ("L0", "L1", "L2", "L3", "L4")
SHAPES = ("preserve", "reshape", "reduce")
INFEASIBILITY = ("feasible", "semantic", "performative", "structural_pipeline", "structural_schema_flex")
FLEX = ("none", "polymorphic", "attribute_bag", "schema_versioning", "dynamic_key", "derived_tag_array", "nested_event_stream", "missing_vs_present")
# Native structures in the order in which slots prefer them.
STRUCTURES = ("dynamic_key_object", "polymorphic_collection", "derived_tag_array", "nested_event_stream", "missing_vs_present")
# Databases of a full release, least and largest shares, and the records one skeleton may have in a database.
DATABASES, HARDEST, EASIEST, FLEXIBLE, STRUCTURAL, FAMILY = 11, 0.30, 0.05, 0.25, 0.20, 16
REQUIRED = ("record_id", "db_id", "MQL", "difficulty", "sql_infeasibility_class", "shape_policy", "world_signature")
NOT_ENGLISH = "[⺀-鿿　-ヿ＀-￯]"


def _field(records: DataFrame, name: str, kind: str = "string") -> Column:
    """A column or a field of one by its name, null if the table hasn't got it."""
    at: T.DataType = records.schema
    for part in name.split("."):
        if not isinstance(at, T.StructType) or part not in at.names:
            return F.lit(None).cast(kind)
        at = at[part].dataType
    return F.col(name)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("signature", "skeleton", "problem")]))
def _read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    def one(text: str | None) -> tuple[str | None, str | None, str | None]:
        if not (text or "").strip():
            return None, None, "empty"
        try:
            name, stages = parse(text)
        except PipelineError:
            return policy.signature(text), policy.signature(text), "unreadable"
        return policy.signature([name, stages]), policy.signature(policy.skeleton(policy.canonical_value(stages))), "forbidden" if policy.forbidden(stages, text) else None

    for batch in texts:
        yield pd.DataFrame([one(x) for x in batch], columns=["signature", "skeleton", "problem"])


def signed(records: DataFrame) -> DataFrame:
    """Records with ``signature`` and ``skeleton`` of the pipeline (null if blank), its ``problem``, and ``asked``: the question without case and outer or double space."""
    read = records.withColumn("__read", _read(_field(records, "MQL")))
    question = F.lower(F.regexp_replace(F.trim(_field(records, "nl_queries.canonical")), r"\s+", " "))
    return read.select(*records.columns, "__read.*", F.when(question != "", question).alias("asked"))


def contracts(records: DataFrame) -> DataFrame:
    """(db_id, record_id, problem): a row for each contract that a record breaks."""
    said = {n: _field(records, n) for n in ("difficulty", "sql_infeasibility_class", "shape_policy", "schema_flex")}
    canonical, colloquial = _field(records, "nl_queries.canonical"), _field(records, "nl_queries.colloquial")
    banned = F.coalesce(_field(records, "canonical_form_set.must_not_contain", "array<string>"), F.array().cast("array<string>"))
    structural = F.coalesce(said["sql_infeasibility_class"] == "structural_schema_flex", F.lit(False))
    among = lambda c, of: F.coalesce(c.isin(*of), F.lit(False))
    tests = {
        **{f"no {n}": _field(records, n).isNull() for n in REQUIRED},
        "question is blank": _blank(canonical) | _blank(colloquial),
        "question isn't English": F.coalesce(F.concat_ws(" ", canonical, colloquial).rlike(NOT_ENGLISH), F.lit(False)),
        "form allows forbidden operators": F.size(F.array_except(F.array(*map(F.lit, policy.FORBIDDEN)), banned)) > 0,
        "difficulty": ~among(said["difficulty"], DIFFICULTIES), "infeasibility": ~among(said["sql_infeasibility_class"], INFEASIBILITY), "shape": ~among(said["shape_policy"], SHAPES),
        "flex": said["schema_flex"].isNotNull() & ~among(said["schema_flex"], FLEX),
        "structural flex isn't hardest": structural & ~among(said["difficulty"], ("L4",)),
        "structural flex without flex": structural & (F.coalesce(said["schema_flex"], F.lit("none")) == "none"),
    }
    read = signed(records).withColumn("__said", F.concat(F.lit("pipeline is "), "problem"))
    found = F.array_compact(F.array(*(F.when(broken, F.lit(text)) for text, broken in tests.items()), F.col("__said")))
    return read.select(_field(records, "db_id").alias("db_id"), _field(records, "record_id").alias("record_id"), F.explode(found).alias("problem"))


def composition(records: DataFrame, databases: int | None = DATABASES) -> DataFrame:
    """One row: how many records and databases, the shares of difficulties and flexible schemas, and ``broken``: the bounds that don't hold. No record breaks "empty" alone."""
    share = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    hard, flex = _field(records, "difficulty"), F.coalesce(_field(records, "schema_flex"), F.lit("none"))
    db = _field(records, "db_id")
    row = records.agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(F.when(db != "", db)).alias("databases"), share(hard == "L4").alias("hardest"), share(hard == "L0").alias("easiest"),
        share(flex != "none").alias("flexible"), share(_field(records, "sql_infeasibility_class") == "structural_schema_flex").alias("structural"),
    )
    bounds = {"hardest": F.col("hardest") < HARDEST, "easiest": F.col("easiest") > EASIEST, "flexible": F.col("flexible") < FLEXIBLE, "structural": F.col("structural") < STRUCTURAL}
    if databases is not None:
        bounds = {"databases": F.col("databases") != databases, **bounds}
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in bounds.items())))
    rounded = [F.round(c, 3).alias(c) for c in ("hardest", "easiest", "flexible", "structural")]
    return row.withColumn("broken", F.when(F.col("records") == 0, F.array(F.lit("empty"))).otherwise(broken)).select("records", "databases", *rounded, F.array_join("broken", ",").alias("broken"))


def duplicates(records: DataFrame, family: int = FAMILY) -> DataFrame:
    """(db_id, kind, first, n): pipelines and questions that a database has twice or more, and skeletons of more than ``family`` records; first is the least record_id."""
    kinds = F.expr("array(struct('pipeline' as kind, signature as what, 1 as most), struct('question' as kind, asked as what, 1 as most), struct('skeleton' as kind, skeleton as what, %d as most))" % family)
    rows = signed(records).select("db_id", "record_id", F.explode(kinds).alias("k")).where("k.what is not null")
    counted = rows.groupBy("db_id", "k.kind", "k.what", "k.most").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return counted.where("n > most").select("db_id", "kind", "first", "n")


def diversity(records: DataFrame) -> DataFrame:
    """Per database: records, different pipelines, skeletons, questions and pairs of both, and the largest skeleton's records."""
    rows = signed(records).withColumn("__family", F.when(F.col("skeleton").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("db_id", "skeleton"))))
    pair = F.when(F.col("asked").isNotNull() & F.col("signature").isNotNull(), F.struct("asked", "signature"))
    return rows.groupBy("db_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("signature").alias("pipelines"), F.count_distinct("skeleton").alias("skeletons"),
        F.count_distinct("asked").alias("questions"), F.count_distinct(pair).alias("pairs"), F.coalesce(F.max("__family"), F.lit(0)).alias("largest_family"),
    )


def select_distinct(records: DataFrame, per_db: int) -> DataFrame:
    """Up to per_db records of each database by record_id: first those whose pipeline and question are both new, then those whose pipeline is.

    What is new depends on what was taken before, so a database goes through one task; it gets one row for each
    different pair of pipeline and question, without their texts.
    """
    keys = records.select("db_id", "record_id", F.xxhash64("MQL").alias("p"), F.xxhash64(_field(records, "nl_queries.canonical")).alias("q")).where(~_blank(F.col("MQL")))
    pairs = keys.groupBy("db_id", "p", "q").agg(F.min("record_id").alias("record_id"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        seen_p, seen_q, taken = set(), set(), []
        rows = rows.sort_values("record_id")
        for new_question in (True, False):
            for row in rows.itertuples():
                if len(taken) < per_db and row.p not in seen_p and not (new_question and row.q in seen_q):
                    seen_p.add(row.p)
                    seen_q.add(row.q)
                    taken.append(row.Index)
        return rows.loc[taken, ["db_id", "record_id"]]

    chosen = pairs.groupBy("db_id").applyInPandas(choose, records.select("db_id", "record_id").schema)
    return records.join(chosen, ["db_id", "record_id"], "left_semi")


def plan_slots(features: DataFrame, per_db: int, seed: int, most: int | None = None) -> DataFrame:
    """(slot, db_id, feature_id, structure, use): per_db slots for each database, databases taking turns.

    features: (db_id, feature_id, structure). No feature has its second use before all of its database have their first;
    within a use, structures with the fewest slots go first. Ties go by ``STRUCTURES``, then by SHA-256 of seed and names.
    The last numbering is one task over what is planned, per_db rows a database.
    """
    digest = lambda *parts: F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)
    known = features.select("db_id", "feature_id", "structure").where(F.col("structure").isin(*STRUCTURES))
    rank = F.array_position(F.array(*map(F.lit, STRUCTURES)), F.col("structure"))
    same, own = Window.partitionBy("db_id", "structure"), Window.partitionBy("db_id")
    placed = known.select("*", rank.alias("o"), digest("db_id", "feature_id").alias("h"), digest(F.lit("db"), "db_id").alias("d")).select(
        "*", F.row_number().over(same.orderBy("h", "feature_id")).alias("k"), F.count(F.lit(1)).over(same).alias("of"), F.count(F.lit(1)).over(own).alias("all")
    )
    # slots of a structure grow by one with each of its features, so the least-used-first order is a sort
    uses = placed.withColumn("use", F.explode(F.sequence(F.lit(1), F.ceil(F.lit(per_db) / F.col("all")).cast("int"))))
    turn = F.row_number().over(own.orderBy("use", (F.col("use") - 1) * F.col("of") + F.col("k"), "o", "h", "feature_id"))
    dealt = uses.withColumn("turn", turn).where(F.col("turn") <= per_db)
    slots = dealt.select(F.row_number().over(Window.orderBy("turn", "d", "db_id")).alias("slot"), "db_id", "feature_id", "structure", "use")
    return slots if most is None else slots.where(F.col("slot") <= most)


def public(records: DataFrame) -> DataFrame:
    """What systems under test may see of a record: its ids and the canonical question."""
    return records.select(*(c for c in ("db_id", "record_id") if c in records.columns), F.struct(_field(records, "nl_queries.canonical").alias("canonical")).alias("nl_queries"))


def without(df: DataFrame, private: Collection[str]) -> DataFrame:
    """Documents without the fields of these names, at any depth of structs and arrays of them."""

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            kept = [clean(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields if f.name not in private]
            return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(F.map_filter(c, lambda k, _: ~k.isin(*private)) if isinstance(t.keyType, T.StringType) else c, lambda _, v: clean(v, t.valueType))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in private))


def shared_models(solvers: Collection[str], panels: Mapping[str, Collection[str]]) -> dict[str, list[str]]:
    """Models that solve and also belong to a panel (construction, judges ...), by panel; names without case and outer space. Empty if all are disjoint."""
    plain = lambda names: {n.strip().lower() for n in names if n and n.strip()}
    return {panel: sorted(both) for panel, names in panels.items() if (both := plain(solvers) & plain(names))}

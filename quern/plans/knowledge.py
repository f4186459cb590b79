"""Queries over induction, sources, pipeline analysis and evaluation: each runs one of their operators on whole collections, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import evaluate, induce, release
from quern.sources import tables
from quern.sources.worlds import World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


_D = "WITH d AS (SELECT documents.*, l.doc_id IS NOT NULL AS labelled, q, t FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id) l USING (doc_id)), n AS (SELECT count(*) AS a, count(lang) AS lang, count(source) AS source, count(n_chars) AS chars, count(*) FILTER (WHERE labelled) AS m, count(q) AS q, count(t) AS t FROM d), p AS (SELECT unnest(['_id', 'doc_id', 'profile', 'profile.lang', 'profile.source', 'profile.n_chars', 'schema_state', 'schema_state.label', 'schema_state.text', 'label', 'label.quality', 'label.toxic']) AS path, unnest(['string', 'number', 'object', 'string', 'string', 'number', 'object', 'string', 'string', 'object', 'number', 'number']) AS kind, unnest([a, a, a, lang, source, chars, a, a, a, q, q, t]) AS n FROM n)"


@_query(f"{_D} SELECT path, kind, n, true AS dominant FROM p WHERE n > 0")
def ind_lattice(spark: SparkSession, sf: str) -> DataFrame:
    return induce.lattice(induce.walk(World(spark, sf)["doc_profiles"]))


@_query(f"{_D} SELECT path, round(n / (SELECT count(*) FROM documents), 6) AS present, kind AS kinds FROM p WHERE n > 0")
def ind_shape_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = World(spark, sf)["doc_profiles"]
    return induce.shape_profile(induce.walk(docs), docs.count()).select("path", "present", "kinds")


@_query("SELECT 'answers.items' AS path, min(n) AS least, max(n) AS most, round(avg(n), 6) AS average FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def ind_array_lengths(spark: SparkSession, sf: str) -> DataFrame:
    docs = World(spark, sf)["threads"]
    return induce.shape_profile(induce.walk(docs), 1).where("least is not null").select("path", "least", "most", "average")


@_query("WITH r AS (SELECT conv_id, count(DISTINCT role) AS n FROM conversations GROUP BY conv_id) SELECT 'turns_by_role' AS path, (SELECT count(DISTINCT role) FROM conversations) AS keys, sum(n)::BIGINT AS members, count(*) AS objects FROM r")
def ind_object_keys(spark: SparkSession, sf: str) -> DataFrame:
    return induce.object_keys(induce.walk(World(spark, sf)["threads"])).where("path = 'turns_by_role'").select("path", "keys", "members", F.col("objects"))


@_query("SELECT key, n FROM (SELECT role AS key, count(DISTINCT conv_id) AS n FROM conversations GROUP BY role) ORDER BY n DESC, key LIMIT 10")
def ind_frequent_keys(spark: SparkSession, sf: str) -> DataFrame:
    return induce.frequent_keys(induce.walk(World(spark, sf)["threads"])).where("path = 'turns_by_role'").select("key", "n")


@_query("""SELECT DISTINCT * FROM (SELECT replace(lower(n_name), '_', ' ') AS norm, 'nation' AS path, 'value' AS kind, n_name AS form FROM nation UNION ALL SELECT replace(lower(r_name), '_', ' '), 'region', 'value', r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
           UNION ALL SELECT 'nation:' || n_nationkey, '_id', 'value', 'nation:' || n_nationkey FROM nation UNION ALL SELECT lower(c_mktsegment), 'market.by_segment.<*>', 'key', c_mktsegment FROM customer)""")
def ind_value_index(spark: SparkSession, sf: str) -> DataFrame:
    nodes = induce.walk(World(spark, sf)["nation_markets"])
    return induce.value_index(nodes, "nation_markets", ["market.by_segment"]).select("norm", "path", "kind", "form")


@_query("SELECT path, example FROM (SELECT '_id' AS path, 'conv:' || conv_id AS example, row_number() OVER (ORDER BY 'conv:' || conv_id) AS r FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'conv_id', conv_id::VARCHAR, row_number() OVER (ORDER BY conv_id::VARCHAR) FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE r <= 2")
def ind_id_examples(spark: SparkSession, sf: str) -> DataFrame:
    return induce.id_examples(induce.walk(World(spark, sf)["threads"])).select("path", "example")


@_query("WITH k AS (SELECT strftime(o_orderdate, '%Y-%m') AS m FROM orders) SELECT 'cashflow.activity_by_month' AS path, count(DISTINCT m) AS keys, count(DISTINCT m) AS data_like, 0::BIGINT AS field_like FROM k")
def ind_dynamic_keys(spark: SparkSession, sf: str) -> DataFrame:
    nodes = induce.walk(World(spark, sf)["customer_ledgers"].select("_id", "cashflow"))
    return induce.object_keys(nodes).where(induce.RULES["data_dominated"]).select("path", "keys", "data_like", "field_like")


# --- sources -----------------------------------------------------------------------------------------
@_query("WITH o AS (SELECT 'part:' || p_partkey AS _id, row_number() OVER (ORDER BY 'part:' || p_partkey) - 1 AS n FROM part) SELECT _id FROM o WHERE n % ceil((SELECT count(*) FROM part) / 50.0)::BIGINT = 0")
def src_stride(spark: SparkSession, sf: str) -> DataFrame:
    return tables.stride(World(spark, sf)["part_catalog"].select("_id"), 50)


@_query("SELECT 'part:' || p_partkey AS _id FROM part ORDER BY _id LIMIT 20")
def src_front(spark: SparkSession, sf: str) -> DataFrame:
    return tables.front(World(spark, sf)["part_catalog"].select("_id"), 20)


@_query("SELECT 'customer_ledgers' AS name, count(*) AS documents FROM customer UNION ALL SELECT 'part_catalog', count(*) FROM part UNION ALL SELECT 'doc_profiles', count(*) FROM documents UNION ALL SELECT 'threads', count(DISTINCT conv_id) FROM conversations")
def src_counts(spark: SparkSession, sf: str) -> DataFrame:
    world = World(spark, sf)
    return spark.createDataFrame(tables.counted({k: world[k] for k in ("customer_ledgers", "part_catalog", "doc_profiles", "threads")}), "name string, documents long")


# --- evaluation ----------------------------------------------------------------------------------------
# Scores made from the tables: a system for each segment, a task for each customer's place in it.
_OUTCOME = "CASE WHEN c_acctbal > 6000 THEN 'correct' WHEN c_acctbal > 3000 THEN 'row_subset' WHEN c_acctbal > 0 THEN 'value_mismatch' ELSE 'row_count_exceeded' END"
_SCORES = f"WITH s AS (SELECT c_mktsegment AS system_id, 'db' || c_nationkey AS db_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)::INT AS record_id, (c_acctbal > 6000)::INT AS exc, CASE WHEN c_acctbal > 0 THEN (c_custkey % 5) / 4.0 END AS exf1, {_OUTCOME} AS outcome FROM customer)"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    return tables.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("system_id"), F.concat(F.lit("db"), "c_nationkey").alias("db_id"), nth.alias("record_id"), (F.col("c_acctbal") > 6000).cast("int").alias("exc"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey") % 5 / 4.0).alias("exf1"), F.expr(_OUTCOME).alias("outcome"))


@_query(f"{_SCORES} SELECT system_id, count(*) AS n, round(avg(exc), 6) AS exc, round(avg(exf1), 6) AS exf1, count(exf1) AS exf1_n, count(exf1) = count(*) AS complete FROM s GROUP BY system_id")
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.summary(_scores(spark, sf))


@_query(f"{_SCORES}, a AS (SELECT system_id, exc, exf1, unnest(['db_id', 'outcome']) AS axis, unnest([db_id, outcome]) AS value FROM s) SELECT system_id, axis, value, count(*) AS n, round(avg(exc), 6) AS exc, round(avg(exf1), 6) AS exf1, count(exf1) AS exf1_n, count(exf1) = count(*) AS complete FROM a GROUP BY ALL")
def eval_slices(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.slices(_scores(spark, sf), ["db_id", "outcome"])


@_query(f"{_SCORES}, o AS (SELECT unnest({list(evaluate.OUTCOMES)}) AS outcome), g AS (SELECT system_id, outcome, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT system_id, count(*) AS t FROM s GROUP BY ALL) SELECT system_id, outcome, coalesce(n, 0) AS n, round(coalesce(n, 0) / t, 6) AS share FROM t CROSS JOIN o LEFT JOIN g USING (system_id, outcome)")
def eval_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.distribution(_scores(spark, sf))


@_query(f"{_SCORES}, k AS (SELECT DISTINCT db_id, record_id FROM s), y AS (SELECT DISTINCT system_id FROM s) SELECT system_id, count(*) AS n, coalesce(sum(exc), 0)::BIGINT AS exc, count(*) FILTER (WHERE outcome IS NULL) AS absent FROM k CROSS JOIN y LEFT JOIN s USING (system_id, db_id, record_id) GROUP BY system_id")
def eval_missing(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scores(spark, sf)
    full = evaluate.with_missing(scores, scores.select("db_id", "record_id").distinct(), scores)
    return full.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.sum("exc").alias("exc"), F.count_if(F.col("outcome") == "no_submission").alias("absent"))


@_query(f"{_SCORES}, r AS (SELECT record_id, exc AS ref FROM s WHERE system_id = 'BUILDING') SELECT system_id, count(*) FILTER (WHERE exc = 1 AND ref = 0) AS wins, count(*) FILTER (WHERE exc = 0 AND ref = 1) AS losses, round(avg(exc - ref), 6) AS delta FROM s JOIN r USING (record_id) WHERE system_id <> 'BUILDING' GROUP BY system_id")
def eval_paired(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.paired(_scores(spark, sf).withColumn("db_id", F.lit("db")), "BUILDING").select("system_id", "wins", "losses", "delta")


@_query("WITH a AS (SELECT c_mktsegment AS s, c_nationkey AS n FROM customer), b AS (SELECT * FROM a WHERE n < 20), x AS (SELECT s, n, count(*) AS k FROM a GROUP BY ALL), y AS (SELECT s, n, count(*) AS k FROM b GROUP BY ALL) SELECT count(*) AS different, sum(x.k)::BIGINT AS gold, coalesce(sum(y.k), 0)::BIGINT AS got FROM x LEFT JOIN y USING (s, n) WHERE x.k <> coalesce(y.k, 0)")
def eval_difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "customer").select("c_mktsegment", "c_nationkey")
    found = evaluate.difference(rows, rows.where("c_nationkey < 20").select(F.col("c_nationkey").alias("x"), F.col("c_mktsegment").alias("y")))
    return found.agg(F.count(F.lit(1)).alias("different"), F.sum("gold").alias("gold"), F.coalesce(F.sum("got"), F.lit(0)).alias("got"))


@_query("WITH b AS (SELECT count(*) AS n FROM customer WHERE c_acctbal > 0) SELECT round(2 * n::DOUBLE / (n + (SELECT count(*) FROM customer)), 6) AS f1 FROM b")
def eval_row_f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "customer").select("c_custkey", "c_name")
    some = tables.table(spark, sf, "customer").where("c_acctbal > 0").select("c_name", "c_custkey")
    return spark.createDataFrame([(evaluate.frame_f1(rows, some),)], "f1 double")


_PIPELINE = "concat('db.t.aggregate([{$match: {a: ', cast(c_custkey % 90 as string), '}}', CASE WHEN c_mktsegment = 'BUILDING' THEN ', {$limit: 5}' ELSE '' END, '])')"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    said = ("concat('db', c_nationkey) as db_id", "c_custkey as record_id", "named_struct('canonical', concat('Question  ', c_custkey % 70), 'colloquial', c_mktsegment) as nl_queries", f"{_PIPELINE} as MQL", "concat('L', c_custkey % 6) as difficulty",
            "if(c_acctbal > 5000, 'structural_schema_flex', 'feasible') as sql_infeasibility_class", "if(c_acctbal > 0, 'dynamic_key', 'none') as schema_flex", "'preserve' as shape_policy", "'w' as world_signature")
    return tables.table(spark, sf, "customer").selectExpr(*said)


_RECORDS = "WITH r AS (SELECT 'db' || c_nationkey AS db_id, c_custkey AS id, c_custkey % 90 AS v, c_mktsegment = 'BUILDING' AS b, c_custkey % 70 AS q, c_custkey % 6 AS d, c_acctbal AS a FROM customer)"


@_query(f"{_RECORDS}, p AS (SELECT unnest(['form allows forbidden operators', 'difficulty', 'structural flex isn''t hardest']) AS problem, unnest([true, d = 5, a > 5000 AND d <> 4]) AS broken FROM r) SELECT problem, count(*) AS n FROM p WHERE broken GROUP BY problem")
def rel_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return release.contracts(_records(spark, sf)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_RECORDS}, s AS (SELECT count(*) AS records, count(DISTINCT db_id) AS databases, avg((d = 4)::INT) AS h, avg((d = 0)::INT) AS e, avg((a > 0)::INT) AS f, avg((a > 5000)::INT) AS t FROM r) SELECT records, databases, round(h, 3) AS hardest, round(e, 3) AS easiest, round(f, 3) AS flexible, round(t, 3) AS structural, concat_ws(',', CASE WHEN databases <> 11 THEN 'databases' END, CASE WHEN h < 0.3 THEN 'hardest' END, CASE WHEN e > 0.05 THEN 'easiest' END, CASE WHEN f < 0.25 THEN 'flexible' END, CASE WHEN t < 0.2 THEN 'structural' END) AS broken FROM s")
def rel_composition(spark: SparkSession, sf: str) -> DataFrame:
    return release.composition(_records(spark, sf))


@_query(f"{_RECORDS}, k AS (SELECT db_id, 'pipeline' AS kind, min(id) AS first, count(*) AS n FROM r GROUP BY db_id, v, b HAVING count(*) > 1 UNION ALL SELECT db_id, 'question', min(id), count(*) FROM r GROUP BY db_id, q HAVING count(*) > 1 UNION ALL SELECT db_id, 'skeleton', min(id), count(*) FROM r GROUP BY db_id, b HAVING count(*) > 16) SELECT * FROM k")
def rel_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return release.duplicates(_records(spark, sf))


@_query(f"{_RECORDS}, g AS (SELECT db_id, max(n) AS m FROM (SELECT db_id, count(*) AS n FROM r GROUP BY db_id, b) GROUP BY db_id) SELECT db_id, count(*) AS records, count(DISTINCT (v, b)) AS pipelines, count(DISTINCT b) AS skeletons, count(DISTINCT q) AS questions, count(DISTINCT (q, v, b)) AS pairs, any_value(m) AS largest_family FROM r JOIN g USING (db_id) GROUP BY db_id")
def rel_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return release.diversity(_records(spark, sf))


@_query(f"WITH f AS (SELECT p_brand AS db_id, p_partkey::VARCHAR AS feature_id, {list(release.STRUCTURES)}[p_size % 5 + 1] AS structure, p_size % 5 AS o FROM part), p AS (SELECT *, sha256('7:' || db_id || ':' || feature_id) AS h, sha256('7:db:' || db_id) AS d, count(*) OVER (PARTITION BY db_id, structure) AS same, count(*) OVER (PARTITION BY db_id) AS total FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY db_id, structure ORDER BY h) AS k FROM p), u AS (SELECT *, unnest(range(1, ceil(25 / total)::BIGINT + 1)) AS use FROM k), t AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY use, (use - 1) * same + k, o, h) AS turn FROM u) SELECT row_number() OVER (ORDER BY turn, d)::INT AS slot, db_id, feature_id, structure, use::INT AS use FROM t WHERE turn <= 25")
def rel_slots(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, release.STRUCTURES)), (F.col("p_size") % 5 + 1).cast("int"))
    features = tables.table(spark, sf, "part").select(F.col("p_brand").alias("db_id"), F.col("p_partkey").cast("string").alias("feature_id"), kinds.alias("structure"))
    return release.plan_slots(features, per_db=25, seed=7)

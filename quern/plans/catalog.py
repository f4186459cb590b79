"""The query catalogue over the document collections of ``quern.sources.worlds``: pipelines and their SQL over the flat tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quern.plans import patterns as P
from quern.plans.blueprints import BLUEPRINTS
from quern.plans.parse import render

CATALOG: dict[str, tuple[str, str]] = {}


def _add(name: str, collection: str, stages: list | str, sql: str) -> None:
    text = f"db.{collection}.aggregate({stages})" if isinstance(stages, str) else render(collection, stages)
    CATALOG[name] = (text, sql)


# --- free keys -------------------------------------------------------------------------------------
_MONTHS = "WITH m AS (SELECT o_custkey AS c, strftime(o_orderdate, '%Y-%m') AS k, count(*) AS n, sum(o_totalprice) AS total, max(o_totalprice) AS largest FROM orders GROUP BY ALL)"
_keys = partial(P.free_keys, "cashflow.activity_by_month")
_add("keys_present", "customer_ledgers", _keys("present", key="1997-05"), f"{_MONTHS} SELECT 'customer:' || c AS _id, count(*) AS n FROM m WHERE k = '1997-05' GROUP BY c")
_add("keys_over", "customer_ledgers", _keys("over", key="1997-05", metric="total", threshold=200000), f"{_MONTHS} SELECT 'customer:' || c AS _id, count(*) AS n FROM m WHERE k = '1997-05' AND round(total, 4) > 200000 GROUP BY c")
_add("keys_populated", "customer_ledgers", _keys("populated", least=10), f"{_MONTHS} SELECT 'customer:' || c AS _id, count(*) AS n FROM m GROUP BY c HAVING count(*) >= 10")
_add("keys_names", "customer_ledgers", _keys("names"), f"{_MONTHS} SELECT 'customer:' || c AS _id, count(*) AS n, min(k) AS first_key FROM m GROUP BY c")
_add("keys_any_over", "customer_ledgers", _keys("any_over", metric="largest", threshold=450000), f"{_MONTHS} SELECT 'customer:' || c AS _id, count(*) AS n FROM m WHERE largest > 450000 GROUP BY c")
_add("keys_counted", "customer_ledgers", _keys("counted"), f"{_MONTHS} SELECT n AS keys, count(*) AS documents FROM (SELECT c_custkey, count(k) AS n FROM customer LEFT JOIN m ON c = c_custkey GROUP BY c_custkey) GROUP BY n")

# --- kinds of document -----------------------------------------------------------------------------
_BOTH = "WITH p AS (SELECT 'customer:' || c_custkey AS _id, 'customer' AS kind, c_acctbal AS chosen, c_mktsegment AS label FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_acctbal, s_name FROM supplier)"
_money = {"customer": "$customer.balance", "supplier": "$supplier.account"}
_names = {"customer": "$customer.segment", "supplier": "$supplier.name"}
_add("kinds_dispatch", "trade_parties", P.kinds("entity_type", _money, "dispatch"), f"{_BOTH} SELECT _id, kind, chosen FROM p")
_add("kinds_only", "trade_parties", P.kinds("entity_type", _names, "only", wanted="supplier", default="other"), f"{_BOTH} SELECT _id, label AS chosen FROM p WHERE kind = 'supplier'")
_add("kinds_grouped", "trade_parties", P.kinds("entity_type", _money, "grouped"), f"{_BOTH} SELECT kind, count(*) AS documents, round(avg(chosen), 4) AS average FROM p GROUP BY kind")
_add("kinds_fields", "trade_parties", P.kinds("entity_type", {}, "fields"), f"{_BOTH} SELECT kind, field, count(*) AS documents FROM (SELECT kind, unnest(['_id', 'entity_type', kind, 'nation_id']) AS field FROM p) GROUP BY ALL")
_add("kinds_top", "trade_parties", P.kinds("entity_type", _money, "dispatch", limit=25), f"{_BOTH} SELECT _id, kind, chosen FROM p ORDER BY chosen, _id LIMIT 25")

# --- tags ------------------------------------------------------------------------------------------
_TAGS = """WITH t AS (SELECT 'part:' || p_partkey AS _id, unnest(list_distinct(string_split(lower(p_type), ' ') || [lower(p_brand), CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 35 THEN 'medium' ELSE 'large' END])) AS tag FROM part)"""
_ask = ["economy", "small", "brand#2"]
_in = "('economy', 'small', 'brand#2')"
_tags = partial(P.tag_sets, "tags", _ask)
_hits = f"SELECT _id, count(*) AS n FROM t WHERE tag IN {_in} GROUP BY _id"
_add("tags_any", "part_catalog", _tags("any"), f"{_TAGS} {_hits}")
_add("tags_all", "part_catalog", _tags("all"), f"{_TAGS} SELECT _id, count(*) AS n FROM t GROUP BY _id HAVING count(*) FILTER (WHERE tag IN {_in}) = 3")
_add("tags_at_least", "part_catalog", _tags("at_least", least=2), f"{_TAGS} {_hits} HAVING count(*) >= 2")
_add("tags_without", "part_catalog", _tags("without", without="economy"), f"{_TAGS} {_hits} HAVING count(*) FILTER (WHERE tag = 'economy') = 0")
_add("tags_classify", "part_catalog", _tags("classify"), f"{_TAGS} SELECT CASE WHEN n > 1 THEN 'several' WHEN n = 1 THEN 'one' ELSE 'none' END AS overlap, count(*) AS documents FROM (SELECT _id, count(*) FILTER (WHERE tag IN {_in}) AS n FROM t GROUP BY _id) GROUP BY 1")
_add("tags_counted", "part_catalog", _tags("counted"), f"{_TAGS} SELECT tag, count(*) AS documents FROM t GROUP BY tag")
_add("tags_sizes", "part_catalog", _tags("sizes"), f"{_TAGS} SELECT n AS tags, count(*) AS documents FROM (SELECT _id, count(*) AS n FROM t GROUP BY _id) GROUP BY n")

# --- events ----------------------------------------------------------------------------------------
_ev = partial(P.events, "events")
_count = "SELECT 'user:' || user_id AS _id, count(*) AS n FROM events WHERE {} GROUP BY user_id"
_add("events_of_kind", "user_timelines", _ev("of_kind", kind="purchase"), _count.format("event_type = 'purchase'"))
_add("events_since", "user_timelines", _ev("since", since="2024-01-15"), _count.format("strftime(ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-15'"))
_add("events_over", "user_timelines", _ev("over", metric="value", threshold=50), _count.format("value > 50"))
_add("events_kind_over", "user_timelines", _ev("kind_over", kind="click", metric="value", threshold=20.5), _count.format("event_type = 'click' AND value > 20.5"))
_add("events_at_least", "user_timelines", _ev("at_least", kind="error", least=3), _count.format("event_type = 'error'") + " HAVING count(*) >= 3")
_add("events_kinds_seen", "user_timelines", _ev("kinds_seen"), "SELECT 'user:' || user_id AS _id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
_add("events_by_kind", "user_timelines", _ev("by_kind", metric="value"), "SELECT event_type AS kind, count(*) AS events, max(value) AS largest FROM events GROUP BY event_type")

# --- presence --------------------------------------------------------------------------------------
_STATE = "WITH s AS (SELECT 'doc:' || doc_id AS _id, lang, CASE WHEN l.doc_id IS NULL THEN 'null' ELSE 'present' END AS state, CASE WHEN n_chars IS NULL THEN 'null' WHEN n_chars < 200 THEN 'empty' ELSE 'present' END AS text, q FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id))"
_add("presence_listed", "doc_profiles", P.presence("schema_state.text", "listed", states=["empty", "null", "missing"]), f"{_STATE} SELECT _id, text AS state FROM s WHERE text <> 'present'")
_add("presence_counted", "doc_profiles", P.presence("schema_state.label", "counted"), f"{_STATE} SELECT state, count(*) AS documents FROM s GROUP BY state")
_add("presence_by_context", "doc_profiles", P.presence("schema_state.label", "by_context", context="profile.lang"), f"{_STATE} SELECT state, lang AS context, count(*) AS documents FROM s GROUP BY ALL")
_add("presence_is_set", "doc_profiles", P.presence("label.quality", "is_set"), f"{_STATE} SELECT _id, q AS kept FROM s WHERE q IS NOT NULL")
_add("presence_missing_path", "doc_profiles", P.presence("schema_state.nowhere", "counted"), "SELECT 'missing' AS state, count(*) AS documents FROM documents")

# --- shapes of longer queries ----------------------------------------------------------------------
_add(
    "cashflow_matrix", "customer_ledgers",
    """[{$project: {segment: "$identity.segment", months: {$objectToArray: {$ifNull: ["$cashflow.activity_by_month", {}]}}}}, {$unwind: "$months"},
        {$group: {_id: {segment: "$segment", month: "$months.k"}, customers: {$sum: 1}, orders: {$sum: "$months.v.order_count"}, total: {$sum: "$months.v.total"}, largest: {$max: "$months.v.largest"}}},
        {$project: {_id: 0, segment: "$_id.segment", month: "$_id.month", customers: 1, orders: 1, total: {$round: ["$total", 2]}, largest: 1}}, {$sort: {segment: 1, month: 1}}]""",
    f"{_MONTHS} SELECT c_mktsegment AS segment, k AS month, count(*) AS customers, sum(n)::BIGINT AS orders, round_even(sum(round(total, 4)), 2) AS total, max(largest) AS largest FROM m JOIN customer ON c = c_custkey GROUP BY ALL",
)
_add(
    "status_buckets", "customer_ledgers",
    """[{$unwind: "$timeline.entries"}, {$match: {"timeline.entries.amount": {$gte: 1000}, "identity.segment": {$in: ["BUILDING", "MACHINERY"]}}},
        {$group: {_id: {status: "$timeline.entries.status", priority: "$timeline.entries.event_type"}, orders: {$sum: 1}, customers: {$addToSet: "$_id"}}},
        {$match: {orders: {$gte: 1}}}, {$project: {_id: 0, status: "$_id.status", priority: "$_id.priority", orders: 1, customers: {$size: "$customers"}}}, {$sort: {orders: -1, status: 1, priority: 1}}, {$limit: 50}]""",
    "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL ORDER BY orders DESC, status, priority LIMIT 50",
)
_add(
    "supplier_matrix", "part_catalog",
    """[{$project: {tags: 1, suppliers: {$objectToArray: "$supply.by_supplier"}}}, {$unwind: "$suppliers"}, {$unwind: "$tags"},
        {$group: {_id: {tag: "$tags", supplier: "$suppliers.k"}, parts: {$sum: 1}, quantity: {$sum: "$suppliers.v.quantity"}}},
        {$project: {_id: 0, tag: "$_id.tag", supplier: "$_id.supplier", parts: 1, quantity: 1}}, {$match: {parts: {$gt: 1}}}, {$sort: {quantity: -1, tag: 1, supplier: 1}}, {$limit: 100}]""",
    f"""{_TAGS}, s AS (SELECT 'part:' || l_partkey AS _id, l_suppkey::VARCHAR AS supplier, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
        SELECT tag, supplier, count(*) AS parts, sum(q) AS quantity FROM s JOIN t USING (_id) GROUP BY ALL HAVING count(*) > 1 ORDER BY quantity DESC, tag, supplier LIMIT 100""",
)
_add(
    "day_profile", "user_timelines",
    """[{$project: {days: {$objectToArray: "$activity_by_day"}}}, {$unwind: "$days"}, {$match: {"days.v.event_count": {$gte: 2}}},
        {$project: {_id: 1, day: "$days.k", n: "$days.v.event_count", total: {$round: ["$days.v.value_total", 2]}}}, {$sort: {n: -1, _id: 1, day: 1}}, {$limit: 100}]""",
    "SELECT 'user:' || user_id AS _id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round_even(sum(value), 2) AS total FROM events GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, _id, day LIMIT 100",
)
_add(
    "one_day_without_unwinding", "user_timelines",
    """[{$addFields: {day: "$activity_by_day.2024-01-03"}}, {$match: {"day.event_count": {$gt: 0}}}, {$project: {n: "$day.event_count"}}, {$sort: {_id: 1}}]""",
    "SELECT 'user:' || user_id AS _id, count(*) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-03' GROUP BY user_id",
)
_add(
    "segment_ratios", "nation_markets",
    """[{$project: {_id: 0, nation: 1, region: 1, segments: {$objectToArray: {$ifNull: ["$market.by_segment", {}]}}, suppliers: {$ifNull: ["$supply.suppliers", 0]}}}, {$unwind: "$segments"},
        {$project: {nation: 1, region: 1, segment: "$segments.k", customers: "$segments.v.customers", debt_share: {$round: [{$cond: [{$gt: ["$segments.v.customers", 0]}, {$divide: ["$segments.v.in_debt", "$segments.v.customers"]}, null]}, 6]},
                    per_supplier: {$round: [{$divide: ["$segments.v.customers", "$suppliers"]}, 6]}}}, {$sort: {nation: 1, segment: 1}}]""",
    """SELECT n_name AS nation, r_name AS region, c_mktsegment AS segment, count(*) AS customers, round_even(count(*) FILTER (WHERE c_acctbal < 0) / count(*)::DOUBLE, 6) AS debt_share, round_even(count(*)::DOUBLE / nullif(any_value(coalesce(n, 0)), 0), 6) AS per_supplier
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY ALL""",
)
_add(
    "thread_roles", "threads",
    """[{$unwind: "$answers.items"}, {$addFields: {long: {$cond: {if: {$gt: ["$answers.items.n_chars", 200]}, then: 1, else: 0}}}},
        {$group: {_id: "$answers.items.role", turns: {$sum: 1}, long_turns: {$sum: "$long"}, longest: {$max: "$answers.items.n_chars"}, threads: {$addToSet: "$conv_id"}}},
        {$project: {_id: 0, role: "$_id", turns: 1, long_turns: 1, longest: 1, threads: {$size: "$threads"}}}, {$sort: {role: 1}}]""",
    "SELECT role, count(*) AS turns, count(*) FILTER (WHERE length(text) > 200) AS long_turns, max(length(text)) AS longest, count(DISTINCT conv_id) AS threads FROM conversations GROUP BY role",
)
_add(
    "first_turns", "threads",
    """[{$unwind: {path: "$answers.items", includeArrayIndex: "at"}}, {$sort: {"answers.items.turn": 1}}, {$group: {_id: "$conv_id", opener: {$first: "$answers.items.role"}, closer: {$last: "$answers.items.role"}, turns: {$sum: 1}, last_at: {$max: "$at"}}},
        {$project: {_id: 0, conv_id: "$_id", opener: 1, closer: 1, turns: 1, last_at: 1}}, {$sort: {conv_id: 1}}]""",
    "SELECT conv_id, arg_min(role, turn) AS opener, arg_max(role, turn) AS closer, count(*) AS turns, count(*) - 1 AS last_at FROM conversations GROUP BY conv_id",
)
_add(
    "nested_inclusion", "customer_ledgers",
    """[{$project: {"identity.name": 1, "timeline.entries.order_key": 1}}, {$unwind: "$timeline.entries"}, {$project: {_id: 0, name: "$identity.name", order_key: "$timeline.entries.order_key"}}, {$sort: {order_key: 1}}]""",
    "SELECT c_name AS name, o_orderkey AS order_key FROM customer JOIN orders ON o_custkey = c_custkey",
)
_add(
    "reduce_and_slice", "customer_ledgers",
    """[{$project: {n: {$size: {$ifNull: ["$timeline.entries", []]}}, sum: {$round: [{$reduce: {input: {$ifNull: ["$timeline.entries", []]}, initialValue: 0.0, in: {$add: ["$$value", "$$this.amount"]}}}, 2]}, first: {$arrayElemAt: ["$timeline.entries.order_key", 0]}, last: {$arrayElemAt: ["$timeline.entries.order_key", -1]}, three: {$size: {$slice: [{$ifNull: ["$timeline.entries", []]}, 3]}}}}, {$match: {n: {$gt: 0}}}, {$sort: {_id: 1}}]""",
    "SELECT 'customer:' || o_custkey AS _id, count(*) AS n, round_even(sum(o_totalprice), 2) AS sum, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last, least(count(*), 3) AS three FROM orders GROUP BY o_custkey",
)
_add(
    "match_operators", "trade_parties",
    """[{$match: {$or: [{"customer.balance": {$gte: 9000, $lt: 9900}}, {"supplier.account": {$lte: 0}}], nation_id: {$nin: [3, 7]}, $nor: [{"customer.segment": "BUILDING"}], "customer.name": {$not: {$regex: "9$"}}}}, {$project: {nation_id: 1}}, {$sort: {_id: 1}}]""",
    """SELECT 'customer:' || c_custkey AS _id, c_nationkey AS nation_id FROM customer WHERE c_acctbal >= 9000 AND c_acctbal < 9900 AND c_nationkey NOT IN (3, 7) AND c_mktsegment <> 'BUILDING' AND NOT regexp_matches(c_name, '9$')
       UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier WHERE s_acctbal <= 0 AND s_nationkey NOT IN (3, 7)""",
)
_add("array_conditions", "customer_ledgers", """[{$match: {"identity.risk_tags": {$all: ["wealthy", "automotive"]}, "timeline.entries": {$elemMatch: {status: "F", amount: {$gt: 300000}}}}}, {$project: {name: "$identity.name"}}, {$sort: {_id: 1}}]""",
     "SELECT 'customer:' || c_custkey AS _id, c_name AS name FROM customer WHERE c_acctbal > 7500 AND c_mktsegment = 'AUTOMOBILE' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)")
_add("skip_and_limit", "customer_ledgers", """[{$sort: {"ledger.balance": -1, _id: 1}}, {$skip: 10}, {$limit: 20}, {$project: {balance: "$ledger.balance"}}]""", "SELECT 'customer:' || c_custkey AS _id, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, _id LIMIT 20 OFFSET 10")
_add("counted", "customer_ledgers", """[{$match: {"schema_state.entries": "present"}}, {$count: "n"}]""", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) HAVING count(*) > 0")
_add("global_group", "nation_markets", """[{$group: {_id: null, nations: {$sum: 1}, suppliers: {$sum: "$supply.suppliers"}}}, {$project: {_id: 0, nations: 1, suppliers: 1}}]""", "SELECT (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM supplier) AS suppliers")

# --- stages that the reference only recognises -------------------------------------------------------
_add("lookup_equal", "trade_parties", """[{$match: {entity_type: "supplier"}}, {$lookup: {from: "nation_markets", localField: "nation_id", foreignField: "nation_id", as: "home"}}, {$project: {region: {$arrayElemAt: ["$home.region", 0]}, n: {$size: "$home"}}}, {$sort: {_id: 1}}]""",
     "SELECT 'supplier:' || s_suppkey AS _id, r_name AS region, 1 AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_add("lookup_pipeline", "nation_markets", """[{$lookup: {from: "trade_parties", let: {n: "$nation_id"}, pipeline: [{$match: {$expr: {$and: [{$eq: ["$nation_id", "$$n"]}, {$eq: ["$entity_type", "customer"]}]}}}, {$group: {_id: "$customer.segment", n: {$sum: 1}}}, {$sort: {n: -1, _id: 1}}, {$limit: 2}], as: "top"}}, {$unwind: "$top"}, {$project: {_id: 0, nation: 1, segment: "$top._id", n: "$top.n"}}, {$sort: {nation: 1, n: -1}}]""",
     "SELECT nation, segment, n FROM (SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY nation ORDER BY n DESC, segment) <= 2")
_add("union_with", "doc_profiles", """[{$project: {_id: 1, kind: {$literal: "doc"}}}, {$unionWith: {coll: "threads", pipeline: [{$project: {_id: 1, kind: {$literal: "thread"}}}]}}, {$group: {_id: "$kind", n: {$sum: 1}}}, {$project: {_id: 0, kind: "$_id", n: 1}}, {$sort: {kind: 1}}]""",
     "SELECT 'doc' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'thread', count(DISTINCT conv_id) FROM conversations")
_add("facets", "trade_parties", """[{$facet: {kinds: [{$group: {_id: "$entity_type"}}], rich: [{$match: {"customer.balance": {$gt: 9000}}}, {$count: "n"}]}}, {$project: {kinds: {$size: "$kinds"}, rich: {$arrayElemAt: ["$rich.n", 0]}}}]""", "SELECT 2 AS kinds, (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS rich")
_add("buckets", "part_catalog", """[{$bucket: {groupBy: "$identity.price", boundaries: [0, 950, 1000, 1050], default: 9999, output: {parts: {$sum: 1}, largest: {$max: "$identity.size"}}}}, {$sort: {_id: 1}}]""",
     "SELECT CASE WHEN p_retailprice < 0 THEN 9999 WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1000 THEN 950 WHEN p_retailprice < 1050 THEN 1000 ELSE 9999 END AS _id, count(*) AS parts, max(p_size) AS largest FROM part GROUP BY 1")
_add("auto_buckets", "part_catalog", """[{$bucketAuto: {groupBy: "$part_id", buckets: 4}}, {$project: {_id: 0, low: "$_id.min", high: "$_id.max", count: 1}}, {$sort: {low: 1}}]""",
     "WITH b AS (SELECT p_partkey AS k, ntile(4) OVER (ORDER BY p_partkey) AS t FROM part), g AS (SELECT t, min(k) AS low, max(k) AS top, count(*) AS count FROM b GROUP BY t) SELECT low, coalesce(lead(low) OVER (ORDER BY t), top) AS high, count FROM g")
_add("sort_by_count", "customer_ledgers", """[{$sortByCount: "$identity.segment"}]""", "SELECT c_mktsegment AS _id, count(*) AS count FROM customer GROUP BY 1")
_add("window_fields", "customer_ledgers", """[{$setWindowFields: {partitionBy: "$identity.segment", sortBy: {"ledger.balance": -1}, output: {place: {$rank: {}}, three: {$sum: "$ledger.balance", window: {documents: [-2, 0]}}}}}, {$match: {place: {$lte: 3}}}, {$project: {place: 1, three: {$round: ["$three", 2]}}}, {$sort: {_id: 1}}]""",
     "SELECT _id, place, round_even(three, 2) AS three FROM (SELECT 'customer:' || c_custkey AS _id, rank() OVER w AS place, sum(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC ROWS 2 PRECEDING) AS three FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)) WHERE place <= 3")
_add("densified", "customer_ledgers", """[{$project: {_id: 0, tripled: {$multiply: ["$customer_id", 3]}}}, {$densify: {field: "tripled", range: {step: 1, bounds: "full"}}}, {$sort: {tripled: 1}}]""", "SELECT unnest(range(3 * min(c_custkey), 3 * max(c_custkey) + 1)) AS tripled FROM customer")
_add("filled", "nation_markets", """[{$project: {_id: 0, nation_id: 1, mark: {$cond: [{$eq: [{$mod: ["$nation_id", 5]}, 0]}, "$nation_id", null]}}}, {$fill: {sortBy: {nation_id: 1}, output: {mark: {method: "locf"}}}}, {$sort: {nation_id: 1}}]""", "SELECT n_nationkey AS nation_id, n_nationkey - n_nationkey % 5 AS mark FROM nation")
_add("graph_lookup", "customer_ledgers", """[{$graphLookup: {from: "customer_ledgers", startWith: "$customer_id", connectFromField: "identity.nation_id", connectToField: "customer_id", as: "reached", depthField: "hops"}}, {$project: {n: {$size: "$reached"}, hops: {$max: "$reached.hops"}}}, {$sort: {_id: 1}}]""",
     "WITH RECURSIVE r AS (SELECT c_custkey AS c, c_custkey AS k, 0 AS d, [c_custkey] AS seen FROM customer UNION ALL SELECT r.c, own.c_nationkey, d + 1, list_append(seen, own.c_nationkey) FROM r JOIN customer own ON own.c_custkey = k JOIN customer nxt ON nxt.c_custkey = own.c_nationkey WHERE NOT list_contains(seen, own.c_nationkey)) SELECT 'customer:' || c AS _id, count(*) AS n, max(d) AS hops FROM r GROUP BY c")


for _name, (_collection, _stages, _sql) in BLUEPRINTS.items():
    _add(_name, _collection, _stages, _sql)


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quern.operators.stages import aggregate
        from quern.sources.worlds import World

        return aggregate(World(spark, sf_dir), CATALOG[name][0])

    return run

"""Longer pipelines over the built collections, one for each question that the collections were made for, and their SQL over the flat tables."""

from __future__ import annotations

import re

BLUEPRINTS: dict[str, tuple[str, str, str]] = {}


_GROUPED = re.compile(r"\{'(\w+)': (.+?)(?:, '(\w+)': (.+?))?(?:, '(\w+)': (.+?))?\} AS _id")


def _add(name: str, collection: str, stages: str, sql: str) -> None:
    """A compound ``_id`` at the end is laid out as columns, in the stages and in the SQL."""
    if m := _GROUPED.search(sql):
        parts = [(k, v) for k, v in zip(m.groups()[::2], m.groups()[1::2], strict=True) if k]
        sql = sql[: m.start()] + ", ".join(f"{v} AS {k}" for k, v in parts) + sql[m.end() :]
        stages = stages.rstrip()[:-1] + ", {$addFields: {" + ", ".join(f'{k}: "$_id.{k}"' for k, _ in parts) + '}}, {$unset: "_id"}]'
    BLUEPRINTS[f"bp_{name}"] = (collection, stages, sql)


_O = "WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS st, replace(o_orderpriority, ' ', '_') AS pr, o_totalprice AS a, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate + INTERVAL 12 MONTH, '%Y-%m') AS due, c_mktsegment AS seg, c_nationkey AS nat FROM orders JOIN customer ON c_custkey = o_custkey)"
_L = "WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_quantity AS q, l_extendedprice AS x, l_discount AS d, l_returnflag AS f, strftime(l_shipdate, '%Y') AS y, strftime(l_shipdate, '%Y-%m-%d') AS day, o_orderstatus AS st, o_orderpriority AS pr, strftime(o_orderdate, '%Y') AS oy FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_S = "WITH l AS (SELECT l_suppkey AS s, l_quantity AS q, l_returnflag AS f, l_discount AS d, strftime(l_shipdate, '%Y') AS y, row_number() OVER (PARTITION BY l_suppkey, strftime(l_shipdate, '%Y') ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS nth FROM lineitem)"
_B = "WITH l AS (SELECT p_brand AS b, replace(p_type, ' ', '_') AS t, l_quantity AS q, l_returnflag AS f, strftime(l_shipdate, '%Y') AS y, row_number() OVER (PARTITION BY p_brand, l_returnflag, strftime(l_shipdate, '%Y') ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS nth FROM lineitem JOIN part ON p_partkey = l_partkey)"
_T = "WITH t AS (SELECT conv_id AS c, turn, role, length(text) AS n FROM conversations)"

# --- accounts ----------------------------------------------------------------------------------------
_add("monthly_account_cashflow_matrix", "account_books", """[{$project: {account: "$identity.account_id", month: {$objectToArray: "$cashflow.by_month"}}}, {$unwind: "$month"}, {$unwind: "$month.v.entries"}, {$group: {_id: {month: "$month.k", kind: "$month.v.entries.type"}, total: {$sum: "$month.v.entries.amount"}, entries: {$sum: 1}, accounts: {$addToSet: "$account"}}}, {$project: {_id: 0, month: "$_id.month", kind: "$_id.kind", total: {$round: ["$total", 2]}, entries: 1, accounts: {$size: "$accounts"}}}, {$sort: {month: 1, kind: 1}}, {$limit: 50}]""",
     f"{_O} SELECT m AS month, st AS kind, round_even(sum(a), 2) AS total, count(*) AS entries, count(DISTINCT c) AS accounts FROM o GROUP BY ALL ORDER BY month, kind LIMIT 50")
_add("loan_status_repayment_schedule", "account_books", """[{$match: {"credit.presence_state": "present"}}, {$project: {segment: "$identity.segment", due: {$objectToArray: {$ifNull: ["$schedule.by_due_month", {}]}}}}, {$unwind: "$due"}, {$group: {_id: {segment: "$segment", month: "$due.k"}, payments: {$sum: "$due.v.payments"}, largest: {$max: "$due.v.due"}}}, {$sort: {"_id.month": 1, "_id.segment": 1}}, {$limit: 40}]""",
     f"{_O}, d AS (SELECT seg, due, c, round(sum(a), 4) AS v, count(*) AS n FROM o WHERE st <> 'F' AND c IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY ALL) SELECT {{'segment': seg, 'month': due}} AS _id, sum(n)::BIGINT AS payments, max(v) AS largest FROM d GROUP BY seg, due ORDER BY due, seg LIMIT 40")
_add("disposition_role_card_network", "account_books", """[{$project: {roles: {$objectToArray: {$ifNull: ["$disposition.by_role", {}]}}}}, {$unwind: "$roles"}, {$unwind: "$roles.v.cards"}, {$project: {role: "$roles.k", status: "$roles.v.cards.status"}}, {$group: {_id: {role: "$role", status: "$status"}, cards: {$sum: 1}}}, {$sort: {cards: -1}}]""",
     f"{_O} SELECT {{'role': pr, 'status': st}} AS _id, count(*) AS cards FROM o GROUP BY pr, st")
_add("district_salary_frequency_segments", "account_books", """[{$project: {nation: "$identity.nation_id", segment: ["$identity.segment"], years: {$objectToArray: {$ifNull: ["$career.by_year", {}]}}}}, {$unwind: "$segment"}, {$unwind: "$years"}, {$group: {_id: {nation: "$nation", segment: "$segment"}, years: {$sum: 1}, orders: {$sum: "$years.v.orders"}, average: {$avg: "$years.v.orders"}}}, {$sort: {"_id.nation": 1}}]""",
     f"{_O}, y AS (SELECT nat, seg, c, y, count(*) AS n FROM o GROUP BY ALL) SELECT {{'nation': nat, 'segment': seg}} AS _id, count(*) AS years, sum(n)::BIGINT AS orders, avg(n) AS average FROM y GROUP BY nat, seg")
_add("counterparty_operation_symbol_matrix", "account_books", """[{$project: {operations: {$objectToArray: {$ifNull: ["$counterparty.by_operation", {}]}}}}, {$unwind: "$operations"}, {$group: {_id: "$operations.k", accounts: {$sum: 1}, operations: {$sum: "$operations.v.operations"}, largest: {$max: "$operations.v.amount"}}}, {$sort: {operations: -1, _id: 1}}, {$limit: 10}]""",
     f"{_O}, g AS (SELECT c, st || '::' || pr AS _id, count(*) AS n, round(sum(a), 4) AS v FROM o GROUP BY ALL) SELECT _id, count(*) AS accounts, sum(n)::BIGINT AS operations, max(v) AS largest FROM g GROUP BY _id ORDER BY operations DESC, _id LIMIT 10")
_add("actor_career_history_by_year", "account_books", """[{$addFields: {years: {$objectToArray: {$ifNull: ["$career.by_year", {}]}}}}, {$match: {$expr: {$gte: [{$size: "$years"}, 5]}}}, {$project: {years: 1}}, {$unwind: "$years"}, {$project: {year: "$years.k", orders: "$years.v.orders", open: "$years.v.open"}}, {$sort: {orders: -1, _id: 1, year: 1}}, {$limit: 60}]""",
     f"{_O}, y AS (SELECT c, y, count(*) AS n, count(*) FILTER (WHERE st = 'O') AS w, count(*) OVER (PARTITION BY c) AS years FROM o GROUP BY c, y) SELECT 'account:' || c AS _id, y AS year, n AS orders, w AS open FROM y WHERE years >= 5 ORDER BY orders DESC, _id, year LIMIT 60")
_add("student_club_budget_category_rollup", "account_books", """[{$project: {segment: "$identity.segment", operations: {$objectToArray: {$ifNull: ["$counterparty.by_operation", {}]}}}}, {$unwind: "$operations"}, {$group: {_id: {segment: "$segment", operation: "$operations.k"}, spent: {$sum: "$operations.v.amount"}, n: {$sum: "$operations.v.operations"}}}, {$project: {_id: 0, segment: "$_id.segment", operation: "$_id.operation", spent: {$round: ["$spent", 2]}, mean: {$round: [{$divide: ["$spent", "$n"]}, 2]}}}, {$sort: {segment: 1, operation: 1}}]""",
     f"{_O} SELECT seg AS segment, st || '::' || pr AS operation, round_even(sum(a), 2) AS spent, round_even(sum(a) / count(*), 2) AS mean FROM o GROUP BY ALL")
_add("community_user_reputation_activity_lattice", "account_books", """[{$project: {segment: "$identity.segment", years: {$objectToArray: {$ifNull: ["$career.by_year", {}]}}}}, {$unwind: "$years"}, {$project: {segment: 1, year: "$years.k", level: [{$cond: [{$gte: ["$years.v.orders", 3]}, "busy", "calm"]}]}}, {$unwind: "$level"}, {$group: {_id: {segment: "$segment", year: "$year", level: "$level"}, accounts: {$sum: 1}}}, {$sort: {"_id.year": 1, "_id.segment": 1, "_id.level": 1}}, {$limit: 30}]""",
     f"{_O}, y AS (SELECT c, seg, y, CASE WHEN count(*) >= 3 THEN 'busy' ELSE 'calm' END AS lv FROM o GROUP BY c, seg, y) SELECT {{'segment': seg, 'year': y, 'level': lv}} AS _id, count(*) AS accounts FROM y GROUP BY seg, y, lv ORDER BY y, seg, lv LIMIT 30")
_add("community_topic_status_year_buckets", "account_books", """[{$project: {months: {$objectToArray: {$ifNull: ["$cashflow.by_month", {}]}}}}, {$unwind: "$months"}, {$project: {year: {$substrCP: ["$months.k", 0, 4]}, entries: "$months.v.entries"}}, {$unwind: "$entries"}, {$project: {year: 1, status: "$entries.type", big: {$cond: [{$gt: ["$entries.amount", 200000]}, 1, 0]}}}, {$group: {_id: {year: "$year", status: "$status"}, topics: {$sum: 1}, big: {$sum: "$big"}}}, {$sort: {"_id.year": 1, "_id.status": 1}}, {$limit: 15}]""",
     f"{_O} SELECT {{'year': y, 'status': st}} AS _id, count(*) AS topics, count(*) FILTER (WHERE a > 200000) AS big FROM o GROUP BY y, st ORDER BY y, st LIMIT 15")
_add("student_club_member_participation_timeline", "customer_ledgers", """[{$unwind: "$timeline.entries"}, {$project: {_id: 0, member: "$identity.name", day: "$timeline.entries.event_time", order_key: "$timeline.entries.order_key", amount: "$timeline.entries.amount"}}, {$match: {amount: {$gt: 300000}}}, {$sort: {day: 1, order_key: 1}}]""",
     "SELECT c_name AS member, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS order_key, o_totalprice AS amount FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000")
_add("student_club_income_source_mix", "customer_ledgers", """[{$project: {states: {$objectToArray: {$ifNull: ["$ledger.by_status", {}]}}}}, {$unwind: "$states"}, {$group: {_id: "$states.k", customers: {$sum: 1}, orders: {$sum: "$states.v.order_count"}, largest: {$max: "$states.v.largest"}}}, {$project: {_id: 0, source: "$_id", customers: 1, orders: 1, largest: 1}}]""",
     f"{_O} SELECT st AS source, count(DISTINCT c) AS customers, count(*) AS orders, max(a) AS largest FROM o GROUP BY st")
_add("fuel_month_consumption_profile", "account_books", """[{$project: {segment: ["$identity.segment"], months: {$objectToArray: "$cashflow.by_month"}}}, {$unwind: "$segment"}, {$unwind: "$months"}, {$group: {_id: {month: "$months.k", segment: "$segment"}, customers: {$sum: 1}, entries: {$sum: "$months.v.entry_count"}}}, {$sort: {entries: -1, "_id.month": 1, "_id.segment": 1}}, {$limit: 36}]""",
     f"{_O} SELECT {{'month': m, 'segment': seg}} AS _id, count(DISTINCT c) AS customers, count(*) AS entries FROM o GROUP BY m, seg ORDER BY entries DESC, m, seg LIMIT 36")
_add("fuel_basket_category_dispatch", "customer_ledgers", """[{$unwind: "$timeline.entries"}, {$project: {entry: "$timeline.entries", segment: "$identity.segment"}}, {$addFields: {class: {$switch: {branches: [{case: {$gte: ["$entry.amount", 300000]}, then: "large"}, {case: {$gte: ["$entry.amount", 100000]}, then: "middle"}], default: "small"}}}}, {$addFields: {urgent: {$in: ["$entry.event_type", ["1-URGENT", "2-HIGH"]]}}}, {$match: {urgent: true}}, {$group: {_id: {class: "$class", segment: "$segment"}, n: {$sum: 1}}}, {$sort: {n: -1, "_id.class": 1, "_id.segment": 1}}, {$limit: 12}]""",
     "WITH x AS (SELECT c_mktsegment AS seg, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'middle' ELSE 'small' END AS cl FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) SELECT {'class': cl, 'segment': seg} AS _id, count(*) AS n FROM x GROUP BY cl, seg ORDER BY n DESC, cl, seg LIMIT 12")

# --- orders and their lines ---------------------------------------------------------------------------
_add("status_bucket_aggregation", "order_sheets", """[{$project: {race: 1, flags: {$objectToArray: "$results.by_flag"}}}, {$unwind: "$flags"}, {$project: {flag: "$flags.k", n: "$flags.v.count", quantity: "$flags.v.quantity_total"}}, {$match: {n: {$gte: 3}}}, {$sort: {quantity: -1, _id: 1, flag: 1}}, {$limit: 100}]""",
     f"{_L} SELECT 'order:' || k AS _id, f AS flag, count(*) AS n, round(sum(q), 4) AS quantity FROM l GROUP BY k, f HAVING count(*) >= 3 ORDER BY quantity DESC, _id, flag LIMIT 100")
_add("classification_outcome_filtering", "order_sheets", """[{$addFields: {returned: {$ifNull: ["$results.by_flag.R.entries", []]}}}, {$addFields: {heavy: {$filter: {input: "$returned", as: "e", cond: {$gte: ["$$e.quantity", 40]}}}}}, {$match: {$expr: {$gt: [{$size: "$heavy"}, 0]}}}, {$project: {n: {$size: "$heavy"}, all: {$size: "$returned"}}}, {$sort: {_id: 1}}]""",
     f"{_L} SELECT 'order:' || k AS _id, count(*) FILTER (WHERE q >= 40) AS n, count(*) AS all FROM l WHERE f = 'R' GROUP BY k HAVING count(*) FILTER (WHERE q >= 40) > 0")
_add("lap_running_order", "order_sheets", """[{$project: {laps: {$objectToArray: "$running.by_line"}}}, {$unwind: "$laps"}, {$unwind: "$laps.v.order"}, {$match: {"laps.v.order.quantity": {$gte: 45}}}, {$group: {_id: "$laps.k", entries: {$sum: 1}, suppliers: {$addToSet: "$laps.v.order.supplier"}}}, {$sort: {entries: -1, _id: 1}}, {$limit: 5}, {$project: {entries: 1, suppliers: {$size: "$suppliers"}}}]""",
     f"{_L} SELECT n::VARCHAR AS _id, count(*) AS entries, count(DISTINCT s) AS suppliers FROM l WHERE q >= 45 GROUP BY n ORDER BY entries DESC, _id LIMIT 5")
_add("lap_telemetry", "order_sheets", """[{$project: {year: "$race.year", laps: {$objectToArray: "$running.by_line"}}}, {$unwind: "$laps"}, {$project: {year: 1, lap: "$laps.k", lines: "$laps.v.lines", first: {$arrayElemAt: ["$laps.v.order.quantity", 0]}}}, {$match: {lines: {$gte: 2}}}, {$sort: {lines: -1, _id: 1, lap: 1}}, {$limit: 80}]""",
     f"{_L} SELECT 'order:' || k AS _id, oy AS year, n::VARCHAR AS lap, count(*) AS lines, min(q) AS first FROM l GROUP BY k, oy, n HAVING count(*) >= 2 ORDER BY lines DESC, _id, lap LIMIT 80")
_add("lap_telemetry_per_driver", "order_sheets", """[{$project: {best: "$standings.by_position.001.price", lines: {$objectToArray: "$standings.by_position"}}}, {$addFields: {near: {$filter: {input: "$lines", as: "p", cond: {$gte: ["$$p.v.price", 90000]}}}}}, {$match: {$expr: {$gte: [{$size: "$near"}, 2]}}}, {$project: {best: 1, near: {$size: "$near"}}}, {$sort: {_id: 1}}]""",
     f"{_L} SELECT 'order:' || k AS _id, max(x) AS best, count(*) FILTER (WHERE x >= 90000) AS near FROM l GROUP BY k HAVING count(*) FILTER (WHERE x >= 90000) >= 2")
_add("driver_pace_profile", "order_sheets", """[{$project: {lines: "$pace.lines", best: "$pace.best", mean: "$pace.mean"}}, {$match: {lines: {$gte: 8}}}, {$sort: {best: -1, _id: 1}}, {$limit: 50}]""",
     f"{_L} SELECT 'order:' || k AS _id, count(*) AS lines, max(x) AS best, round(avg(q), 4) AS mean FROM l GROUP BY k HAVING count(*) >= 8 ORDER BY best DESC, _id LIMIT 50")
_add("qualifying_elimination_window", "order_sheets", """[{$project: {places: {$objectToArray: {$ifNull: ["$standings.by_position", {}]}}}}, {$addFields: {out: {$size: {$filter: {input: "$places", as: "p", cond: {$and: [{$gt: ["$$p.k", "003"]}, {$lte: ["$$p.k", "006"]}]}}}}}}, {$match: {out: {$gte: 1}}}, {$project: {out: 1}}, {$sort: {out: -1, _id: 1}}, {$limit: 200}]""",
     f"{_L} SELECT 'order:' || k AS _id, least(count(*), 6) - 3 AS out FROM l GROUP BY k HAVING count(*) > 3 ORDER BY out DESC, _id LIMIT 200")
_add("driver_reference_lookup", "order_sheets", """[{$project: {priority: "$race.priority", customer: "$race.customer_id", status: "$race.status"}}, {$match: {status: "P"}}, {$sort: {_id: 1}}, {$limit: 100}]""",
     "SELECT 'order:' || o_orderkey AS _id, o_orderpriority AS priority, o_custkey AS customer, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'P' ORDER BY _id LIMIT 100")
_add("driver_constructor_circuit_profile_union", "trade_parties", """[{$addFields: {label: {$switch: {branches: [{case: {$eq: ["$entity_type", "customer"]}, then: "$customer.name"}, {case: {$eq: ["$entity_type", "supplier"]}, then: "$supplier.name"}], default: null}}}}, {$match: {nation_id: {$in: [1, 2, 3]}, label: {$ne: null}}}, {$project: {label: 1, entity_type: 1}}, {$sort: {label: 1}}, {$limit: 90}]""",
     "SELECT * FROM (SELECT 'customer:' || c_custkey AS _id, 'customer' AS entity_type, c_name AS label FROM customer WHERE c_nationkey IN (1, 2, 3) UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier WHERE s_nationkey IN (1, 2, 3)) ORDER BY label LIMIT 90")
_add("station_market_day_payment_rollup", "order_sheets", """[{$project: {year: ["$race.year"], flags: {$objectToArray: "$results.by_flag"}}}, {$unwind: "$year"}, {$unwind: "$flags"}, {$group: {_id: {year: "$year", flag: "$flags.k"}, orders: {$sum: 1}, lines: {$sum: "$flags.v.count"}, most: {$max: "$flags.v.count"}}}, {$project: {_id: 0, year: "$_id.year", flag: "$_id.flag", orders: 1, lines: 1, most: 1}}, {$sort: {year: 1, flag: 1}}, {$limit: 40}]""",
     f"{_L}, g AS (SELECT k, oy, f, count(*) AS n FROM l GROUP BY ALL) SELECT oy AS year, f AS flag, count(*) AS orders, sum(n)::BIGINT AS lines, max(n) AS most FROM g GROUP BY ALL ORDER BY year, flag LIMIT 40")
_add("product_day_station_bucket_matrix", "order_sheets", """[{$project: {flags: {$objectToArray: "$results.by_flag"}, priority: "$race.priority"}}, {$unwind: "$flags"}, {$project: {priority: 1, flag: "$flags.k", entries: "$flags.v.entries"}}, {$addFields: {band: [{$cond: [{$gte: [{$size: "$entries"}, 2]}, "several", "one"]}]}}, {$unwind: "$band"}, {$unwind: "$entries"}, {$group: {_id: {flag: "$flag", band: "$band"}, lines: {$sum: 1}, largest: {$max: "$entries.quantity"}}}, {$sort: {lines: -1, "_id.flag": 1, "_id.band": 1}}, {$limit: 6}]""",
     f"{_L}, g AS (SELECT k, f, count(*) AS n, max(q) AS m FROM l GROUP BY ALL) SELECT {{'flag': f, 'band': CASE WHEN n >= 2 THEN 'several' ELSE 'one' END}} AS _id, sum(n)::BIGINT AS lines, max(m) AS largest FROM g GROUP BY f, CASE WHEN n >= 2 THEN 'several' ELSE 'one' END ORDER BY lines DESC, 1 LIMIT 6")
_add("thrombosis_event_evidence_filter", "order_sheets", """[{$project: {returned: "$results.by_flag.R", pace: 1}}, {$match: {"returned.count": {$gte: 2}, "pace.least": {$lte: 3}}}, {$project: {n: "$returned.count", least: "$pace.least"}}, {$sort: {_id: 1}}]""",
     f"{_L} SELECT 'order:' || k AS _id, count(*) FILTER (WHERE f = 'R') AS n, min(q) AS least FROM l GROUP BY k HAVING count(*) FILTER (WHERE f = 'R') >= 2 AND min(q) <= 3")
_add("student_club_attendee_reimbursement_chain", "order_sheets", """[{$match: {"race.status": "F"}}, {$project: {priority: "$race.priority", places: {$objectToArray: "$standings.by_position"}}}, {$unwind: "$places"}, {$match: {"places.k": "001"}}, {$group: {_id: "$priority", orders: {$sum: 1}, best: {$max: "$places.v.price"}}}, {$project: {_id: 0, priority: "$_id", orders: 1, best: 1}}, {$sort: {priority: 1}}]""",
     f"{_L} SELECT pr AS priority, count(DISTINCT k) AS orders, max(x) AS best FROM l WHERE st = 'F' GROUP BY pr")

# --- seasons and leagues --------------------------------------------------------------------------------
_add("football_team_season_fixture_matrix", "supplier_seasons", """[{$project: {team: "$team.name", seasons: {$objectToArray: "$seasons.by_year"}}}, {$unwind: "$seasons"}, {$unwind: "$seasons.v.fixtures"}, {$group: {_id: {year: "$seasons.k", result: "$seasons.v.fixtures.result"}, fixtures: {$sum: 1}, most: {$max: "$seasons.v.fixtures.quantity"}}}, {$sort: {"_id.year": 1, "_id.result": 1}}, {$limit: 30}]""",
     f"{_S} SELECT {{'year': y, 'result': f}} AS _id, count(*) AS fixtures, max(q) AS most FROM l WHERE nth <= 80 GROUP BY y, f ORDER BY y, f LIMIT 30")
_add("football_lineup_rating_context", "supplier_seasons", """[{$project: {entries: {$ifNull: ["$attributes.entries", []]}}}, {$addFields: {strong: {$filter: {input: "$entries", as: "e", cond: {$gte: ["$$e.strength", 50]}}}}}, {$match: {$expr: {$gte: [{$size: "$strong"}, 3]}}}, {$project: {years: {$size: "$entries"}, strong: {$size: "$strong"}}}, {$sort: {_id: 1}}]""",
     f"{_S}, y AS (SELECT s, y, max(q) AS m FROM l GROUP BY ALL) SELECT 'supplier:' || s AS _id, count(*) AS years, count(*) FILTER (WHERE m >= 50) AS strong FROM y GROUP BY s HAVING count(*) FILTER (WHERE m >= 50) >= 3")
_add("football_player_attribute_timeline", "supplier_seasons", """[{$project: {names: ["$team.name"], entries: "$attributes.entries"}}, {$unwind: "$names"}, {$unwind: "$entries"}, {$group: {_id: "$entries.year", suppliers: {$sum: 1}, strength: {$max: "$entries.strength"}}}, {$sort: {_id: 1}}]""",
     f"{_S}, y AS (SELECT s, y, max(q) AS m FROM l GROUP BY ALL) SELECT y AS _id, count(*) AS suppliers, max(m) AS strength FROM y GROUP BY y")
_add("football_league_result_bucket_table", "region_leagues", """[{$project: {region: 1, tables: {$objectToArray: "$tables.by_year"}}}, {$unwind: "$tables"}, {$project: {_id: 0, region: 1, year: "$tables.k", first: {$arrayElemAt: ["$tables.v.rows.nation", 0]}, played: "$tables.v.played"}}, {$match: {played: {$gte: 50}}}, {$sort: {region: 1, year: 1}}, {$limit: 40}]""",
     """WITH g AS (SELECT nat, y, sum(n)::BIGINT AS n FROM (SELECT s_nationkey AS nat, strftime(l_shipdate, '%Y') AS y, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL UNION ALL SELECT c_nationkey, strftime(o_orderdate, '%Y'), count(*) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) GROUP BY ALL)
        SELECT r_name AS region, y AS year, arg_min(n_name, (-n, n_name)) AS first, sum(n)::BIGINT AS played FROM g JOIN nation ON n_nationkey = nat JOIN region ON r_regionkey = n_regionkey GROUP BY ALL HAVING sum(n) >= 50 ORDER BY region, year LIMIT 40""")
_add("community_tag_thread_matrix", "supplier_seasons", """[{$project: {nation: ["$team.nation_id"], years: {$objectToArray: "$seasons.by_year"}}}, {$unwind: "$nation"}, {$unwind: "$years"}, {$group: {_id: {nation: "$nation", year: "$years.k"}, played: {$sum: "$years.v.played"}, returned: {$sum: "$years.v.returned"}}}, {$sort: {"_id.year": 1, "_id.nation": 1}}, {$limit: 50}]""",
     f"{_S} SELECT {{'nation': s_nationkey, 'year': y}} AS _id, count(*) AS played, count(*) FILTER (WHERE f = 'R') AS returned FROM l JOIN supplier ON s_suppkey = s GROUP BY s_nationkey, y ORDER BY y, s_nationkey LIMIT 50")

# --- matrices, codes and panels ----------------------------------------------------------------------------
_add("hero_attribute_score_matrix", "brand_matrices", """[{$project: {brand: 1, types: {$objectToArray: "$matrix.by_type"}}}, {$unwind: "$types"}, {$project: {brand: 1, type: "$types.k", years: {$objectToArray: "$types.v.by_year"}}}, {$unwind: "$years"}, {$group: {_id: {brand: "$brand", type: "$type"}, years: {$sum: 1}, lines: {$sum: "$years.v.lines"}}}, {$sort: {"_id.brand": 1}}]""",
     f"{_B} SELECT {{'brand': b, 'type': t}} AS _id, count(DISTINCT y) AS years, count(*) AS lines FROM l GROUP BY b, t")
_add("hero_power_family_distribution", "brand_matrices", """[{$unwind: "$types"}, {$project: {brand: ["$brand"], type: "$types"}}, {$unwind: "$brand"}, {$group: {_id: "$type", brands: {$addToSet: "$brand"}}}, {$project: {brands: {$size: "$brands"}}}, {$sort: {_id: 1}}]""",
     "SELECT p_type AS _id, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_type")
_add("publisher_alignment_power_matrix", "brand_matrices", """[{$unwind: "$types"}, {$project: {brand: 1, type: "$types", codes: {$objectToArray: "$readings.by_code"}}}, {$unwind: "$codes"}, {$project: {brand: 1, type: 1, code: "$codes.k", years: {$objectToArray: "$codes.v.by_year"}}}, {$unwind: "$years"}, {$group: {_id: {type: "$type", code: "$code"}, cells: {$sum: 1}}}, {$sort: {cells: -1, "_id.type": 1, "_id.code": 1}}, {$limit: 25}]""",
     f"{_B}, g AS (SELECT DISTINCT b, f, y FROM l), t AS (SELECT DISTINCT p_brand AS b, p_type AS t FROM part) SELECT {{'type': t, 'code': f}} AS _id, count(*) AS cells FROM g JOIN t USING (b) GROUP BY t, f ORDER BY cells DESC, t, f LIMIT 25")
_add("power_alignment_hero_index", "brand_matrices", """[{$match: {parts: {$gt: 1}}}, {$project: {codes: {$objectToArray: "$readings.by_code"}}}, {$unwind: "$codes"}, {$project: {code: "$codes.k", years: {$objectToArray: "$codes.v.by_year"}}}, {$unwind: "$years"}, {$unwind: "$years.v.readings"}, {$group: {_id: {code: "$code", year: "$years.k"}, readings: {$sum: 1}, largest: {$max: "$years.v.readings.value"}}}, {$project: {_id: 0, code: "$_id.code", year: "$_id.year", readings: 1, largest: 1}}, {$sort: {code: 1, year: 1}}]""",
     f"{_B} SELECT f AS code, y AS year, count(*) AS readings, max(q) AS largest FROM l WHERE nth <= 40 AND b IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 1) GROUP BY f, y")
_add("lab_year_panel_code_matrix", "part_measures", """[{$project: {brand: ["$brand"], type: ["$type"], codes: {$objectToArray: "$codes"}}}, {$unwind: "$brand"}, {$unwind: "$type"}, {$project: {brand: 1, codes: 1}}, {$unwind: "$codes"}, {$group: {_id: {brand: "$brand", code: "$codes.k", bucket: "$codes.v.bucket"}, parts: {$sum: 1}}}, {$project: {_id: 0, brand: "$_id.brand", code: "$_id.code", bucket: "$_id.bucket", parts: 1}}, {$sort: {brand: 1, code: 1, bucket: 1}}]""",
     "WITH v AS (SELECT p_brand AS b, unnest(['size', 'price', 'name_length']) AS code, unnest([p_size::DOUBLE, p_retailprice, CASE WHEN p_size % 7 <> 0 THEN length(p_name)::DOUBLE END]) AS v FROM part) SELECT b AS brand, code, CASE WHEN v IS NULL THEN 'unknown' WHEN v < 10 THEN 'low' WHEN v < 100 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS parts FROM v GROUP BY ALL")
_add("measurement_code_year_distribution", "part_measures", """[{$project: {values: {$objectToArray: "$values"}}}, {$unwind: "$values"}, {$group: {_id: "$values.k", parts: {$sum: 1}, least: {$min: "$values.v"}, most: {$max: "$values.v"}}}, {$sort: {_id: 1}}]""",
     "WITH v AS (SELECT unnest(['size', 'price', 'name_length']) AS code, unnest([p_size::DOUBLE, p_retailprice, CASE WHEN p_size % 7 <> 0 THEN length(p_name)::DOUBLE END]) AS v FROM part) SELECT code AS _id, count(*) AS parts, min(v) AS least, max(v) AS most FROM v WHERE v IS NOT NULL GROUP BY code")
_add("presence_state_bucket_counts", "part_measures", """[{$addFields: {state: {$ifNull: ["$codes.name_length.presence_state", "missing"]}}}, {$group: {_id: {state: "$state", bucket: "$codes.name_length.bucket"}, parts: {$sum: 1}}}, {$project: {_id: 0, state: "$_id.state", bucket: "$_id.bucket", parts: 1}}, {$sort: {state: 1, bucket: 1}}]""",
     "SELECT CASE WHEN p_size % 7 = 0 THEN 'null' ELSE 'present' END AS state, CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN length(p_name) < 10 THEN 'low' WHEN length(p_name) < 100 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS parts FROM part GROUP BY ALL")
_add("diagnosis_risk_group_patient_matrix", "segment_panels", """[{$project: {segment: ["$segment"], states: {$objectToArray: "$credit.by_credit"}}}, {$unwind: "$segment"}, {$unwind: "$states"}, {$group: {_id: {segment: "$segment", state: "$states.k"}, accounts: {$sum: "$states.v.accounts"}}}, {$sort: {"_id.segment": 1, "_id.state": 1}}]""",
     "SELECT {'segment': c_mktsegment, 'state': CASE WHEN c_acctbal >= 0 THEN 'present' ELSE 'null' END} AS _id, count(*) AS accounts FROM customer GROUP BY c_mktsegment, CASE WHEN c_acctbal >= 0 THEN 'present' ELSE 'null' END")
_add("school_frpm_year_trend", "segment_panels", """[{$project: {segment: ["$segment"], years: {$objectToArray: "$years.by_year"}}}, {$unwind: "$segment"}, {$unwind: "$years"}, {$project: {_id: 0, segment: 1, year: "$years.k", accounts: "$years.v.accounts", mean: {$round: [{$divide: ["$years.v.orders", "$years.v.accounts"]}, 4]}}}, {$sort: {segment: 1, year: 1}}]""",
     f"{_O} SELECT seg AS segment, y AS year, count(DISTINCT c) AS accounts, round_even(count(*)::DOUBLE / count(DISTINCT c), 4) AS mean FROM o GROUP BY ALL")
_add("district_grade_span_equity_comparison", "nation_panels", """[{$project: {nation: ["$nation_id"], measures: {$objectToArray: "$measures"}}}, {$unwind: "$nation"}, {$unwind: "$measures"}, {$group: {_id: "$measures.k", nations: {$sum: 1}, most: {$max: "$measures.v"}}}, {$sort: {_id: 1}}]""",
     "WITH a AS (SELECT c_nationkey AS n, count(*)::DOUBLE AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS n, count(*)::DOUBLE AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1), m AS (SELECT 'customers' AS k, v FROM a UNION ALL SELECT 'suppliers', v FROM b UNION ALL SELECT 'per_supplier', round(a.v / b.v, 4) FROM a JOIN b USING (n)) SELECT k AS _id, count(*) AS nations, max(v) AS most FROM m GROUP BY k")
_add("county_sat_frpm_readiness_panel", "nation_panels", """[{$project: {totals: ["$totals"], nation_id: 1, measures: {$objectToArray: "$measures"}}}, {$unwind: "$totals"}, {$unwind: "$measures"}, {$project: {_id: 0, nation_id: 1, measure: "$measures.k", value: "$measures.v", balance: "$totals.balance"}}, {$sort: {nation_id: 1, measure: 1}}]""",
     "WITH a AS (SELECT c_nationkey AS n, count(*)::DOUBLE AS v, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS n, count(*)::DOUBLE AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1), m AS (SELECT n, 'customers' AS k, v FROM a UNION ALL SELECT n, 'suppliers', v FROM b UNION ALL SELECT n, 'per_supplier', round(a.v / b.v, 4) FROM a JOIN b USING (n)) SELECT n AS nation_id, k AS measure, m.v AS value, coalesce(bal, 0) AS balance FROM m LEFT JOIN a USING (n)")
_add("format_legality_status_matrix", "part_measures", """[{$project: {codes: {$objectToArray: "$codes"}}}, {$unwind: "$codes"}, {$group: {_id: {code: "$codes.k", state: "$codes.v.presence_state"}, parts: {$sum: 1}}}, {$sort: {parts: -1, "_id.code": 1, "_id.state": 1}}, {$limit: 5}]""",
     "WITH s AS (SELECT unnest(['size', 'price', 'name_length']) AS code, unnest(['present', 'present', CASE WHEN p_size % 7 = 0 THEN 'null' ELSE 'present' END]) AS state FROM part) SELECT {'code': code, 'state': state} AS _id, count(*) AS parts FROM s GROUP BY code, state ORDER BY parts DESC, code, state LIMIT 5")
_add("set_rarity_print_mix", "brand_matrices", """[{$project: {brand: 1, types: {$objectToArray: "$matrix.by_type"}}}, {$unwind: "$types"}, {$project: {_id: 0, brand: 1, type: "$types.k", lines: {$sum: {$map: {input: {$objectToArray: "$types.v.by_year"}, as: "y", in: "$$y.v.lines"}}}}}, {$sort: {lines: -1, brand: 1, type: 1}}, {$limit: 20}]""",
     f"{_B} SELECT b AS brand, t AS type, count(*) AS lines FROM l GROUP BY ALL ORDER BY lines DESC, brand, type LIMIT 20")

# --- threads ---------------------------------------------------------------------------------------------
_add("community_answer_vote_bucket_scan", "threads", """[{$unwind: "$answers.items"}, {$project: {item: "$answers.items"}}, {$addFields: {band: [{$cond: [{$gte: ["$item.n_chars", 100]}, "long", "short"]}]}}, {$unwind: "$band"}, {$group: {_id: {role: "$item.role", band: "$band"}, turns: {$sum: 1}, longest: {$max: "$item.n_chars"}}}, {$sort: {turns: -1, "_id.role": 1, "_id.band": 1}}, {$limit: 10}]""",
     f"{_T} SELECT {{'role': role, 'band': CASE WHEN n >= 100 THEN 'long' ELSE 'short' END}} AS _id, count(*) AS turns, max(n) AS longest FROM t GROUP BY role, CASE WHEN n >= 100 THEN 'long' ELSE 'short' END ORDER BY turns DESC, 1 LIMIT 10")
_add("ruling_timeline_by_year", "threads", """[{$project: {items: "$answers.items"}}, {$unwind: "$items"}, {$project: {turn: "$items.turn", role: "$items.role", n_chars: "$items.n_chars"}}, {$match: {turn: {$gte: 3}}}, {$sort: {turn: -1, _id: 1}}, {$limit: 60}]""",
     f"{_T} SELECT 'conv:' || c AS _id, turn, role, n AS n_chars FROM t WHERE turn >= 3 ORDER BY turn DESC, _id LIMIT 60")
_add("language_localization_coverage", "threads", """[{$project: {roles: {$objectToArray: "$turns_by_role"}}}, {$unwind: "$roles"}, {$group: {_id: "$roles.k", threads: {$sum: 1}, turns: {$sum: "$roles.v.turns"}, most: {$max: "$roles.v.turns"}}}, {$sort: {threads: -1, _id: 1}}, {$limit: 10}]""",
     f"{_T}, g AS (SELECT c, role, count(*) AS n FROM t GROUP BY ALL) SELECT role AS _id, count(*) AS threads, sum(n)::BIGINT AS turns, max(n) AS most FROM g GROUP BY role ORDER BY threads DESC, _id LIMIT 10")

# --- graphs ----------------------------------------------------------------------------------------------
_GRAPH = "WITH e AS (SELECT DISTINCT strftime(l_shipdate, '%Y') AS y, s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R' AND s_nationkey <> c_nationkey), u AS (SELECT y, a, b FROM e UNION SELECT y, b, a FROM e)"
_add("nested_array_filter", "trade_graph", """[{$project: {year: 1, nodes: {$objectToArray: "$neighbours"}}}, {$unwind: "$nodes"}, {$unwind: "$nodes.v"}, {$group: {_id: "$nodes.k", partners: {$addToSet: "$nodes.v"}, edges: {$sum: 1}}}, {$project: {partners: {$size: "$partners"}, edges: 1}}, {$sort: {edges: -1, _id: 1}}, {$limit: 20}]""",
     f"{_GRAPH} SELECT a::VARCHAR AS _id, count(DISTINCT b) AS partners, count(*) AS edges FROM u GROUP BY a ORDER BY edges DESC, _id LIMIT 20")
_add("array_object_dynamic_key_comparison", "trade_graph", """[{$unwind: "$year"}, {$project: {year: 1, nodes: {$objectToArray: "$neighbours"}}}, {$unwind: "$nodes"}, {$unwind: "$nodes.v"}, {$group: {_id: {year: "$year", node: "$nodes.k"}, degree: {$sum: 1}}}, {$project: {_id: 0, year: "$_id.year", node: "$_id.node", degree: 1}}, {$sort: {degree: -1, year: 1, node: 1}}, {$limit: 40}]""",
     f"{_GRAPH} SELECT y AS year, a::VARCHAR AS node, count(*) AS degree FROM u GROUP BY y, a ORDER BY degree DESC, year, node LIMIT 40")

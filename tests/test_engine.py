"""Stages and expressions on a few documents: missing, null, empty and present values of each kind."""

import pytest

from quern.errors import PipelineError
from quern.operators.stages import aggregate, run
from quern.plans import catalog, knowledge

SCHEMA = "_id string, entity_type string, tags array<string>, m map<string,struct<n:int,v:double>>, ev array<struct<event_type:string,event_time:string,amt:int>>, state string"
DOCS = [
    ("a:1", "driver", ["x", "y"], {"2014-01": (2, 1.5), "2014-02": (1, None)}, [("open", "2014-01-03", 5)], None),
    ("a:2", "circuit", [], {}, [], None),
    ("a:3", "other", None, None, None, "null"),
    ("a:4", "driver", None, {"2014-01": (None, None)}, [(None, None, None), ("close", "2014-02-01", 7)], "present"),
]


@pytest.fixture(scope="module")
def world(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    other = spark.createDataFrame([(1, "driver", "d"), (2, "circuit", "c"), (3, "driver", "e")], "_id int, kind string, name string")
    return {"docs": docs, "other": other}


def rows(world, text, collection="docs"):
    return [r.asDict(recursive=True) for r in aggregate(world, f"db.{collection}.aggregate({text})").collect()]


def ids(world, condition):
    return [r["_id"][2:] for r in rows(world, f"[{{$match: {condition}}}, {{$sort: {{_id: 1}}}}, {{$project: {{_id: 1}}}}]")]


@pytest.mark.parametrize(("condition", "want"), [
    ("{tags: 'x'}", "1"), ("{tags: null}", "34"), ("{tags: {$ne: null}}", "12"), ("{tags: {$size: 0}}", "2"), ("{tags: {$in: ['y', 'q']}}", "1"), ("{tags: {$nin: ['y']}}", "234"),
    ("{'ev.amt': {$gt: 5}}", "4"), ("{'ev.amt': {$gte: 5}}", "14"), ("{'ev.event_type': 'open'}", "1"), ("{'ev.event_type': {$ne: 'open'}}", "234"),
    ("{'m.2014-01.n': 2}", "1"), ("{'m.2014-01.n': null}", "234"), ("{'m.2014-01': {$exists: true}}", "14"), ("{state: {$exists: false}}", "12"),
    ("{nowhere: null}", "1234"), ("{nowhere: {$gt: 1}}", ""), ("{state: {$gt: 5}}", ""), ("{entity_type: {$regex: '^D', $options: 'i'}}", "14"), ("{entity_type: {$not: {$in: ['driver']}}}", "23"),
    ("{$or: [{state: 'null'}, {tags: 'y'}]}", "13"), ("{$nor: [{entity_type: 'driver'}]}", "23"), ("{ev: {$elemMatch: {event_type: 'close', amt: 7}}}", "4"),
    ("{$expr: {$gt: [{$size: {$ifNull: ['$ev', []]}}, 0]}}", "14"), ("{$expr: {$gte: ['$m.2014-01.n', 1]}}", "1"), ("{$expr: {$lt: ['$m.2014-01.n', 1]}}", "234"), ("{$expr: {$eq: ['$entity_type', 5]}}", ""),
    ("{}", "1234"),
])
def test_match(world, condition, want):
    assert "".join(ids(world, condition)) == want


@pytest.mark.parametrize(("expression", "want"), [
    ("{$size: {$ifNull: ['$tags', []]}}", [2, 0, 0, 0]),
    ("{$size: {$objectToArray: {$ifNull: ['$m', {}]}}}", [2, 0, 0, 1]),
    ("{$sortArray: {input: {$map: {input: {$objectToArray: '$m'}, as: 'kv', in: '$$kv.k'}}, sortBy: 1}}", [["2014-01", "2014-02"], [], [], ["2014-01"]]),
    ("{$size: {$filter: {input: {$objectToArray: '$m'}, as: 'kv', cond: {$gt: ['$$kv.v.n', 0]}}}}", [2, 0, 0, 0]),
    ("'$ev.amt'", [[5], [], None, [7]]),
    ("{$arrayElemAt: ['$tags', -1]}", ["y", None, None, None]),
    ("{$arrayElemAt: ['$tags', 9]}", [None] * 4),
    ("{$cond: [{$isArray: '$tags'}, 'list', 'none']}", ["list", "list", "none", "none"]),
    ("{$setIntersection: [{$ifNull: ['$tags', []]}, ['y', 'z']]}", [["y"], [], [], []]),
    ("{$setIsSubset: [['x'], {$ifNull: ['$tags', []]}]}", [True, False, False, False]),
    ("{$in: ['x', {$ifNull: ['$tags', []]}]}", [True, False, False, False]),
    ("{$switch: {branches: [{case: {$eq: ['$entity_type', 'driver']}, then: 1}], default: null}}", [1, None, None, 1]),
    ("{$ifNull: ['$state', 'missing']}", ["missing", "missing", "null", "present"]),
    ("{$reduce: {input: {$ifNull: ['$ev.amt', []]}, initialValue: 0, in: {$add: ['$$value', '$$this']}}}", [5, 0, 0, 7]),
    ("{$sum: '$ev.amt'}", [5, 0, 0, 7]),
    ("{$type: '$tags'}", ["array", "array", "missing", "missing"]),
    ("{$concat: ['$entity_type', '-', '$state']}", [None, None, "other-null", "driver-present"]),
    ("{$divide: [{$size: {$ifNull: ['$tags', []]}}, 0]}", [None] * 4),
    ("{$slice: [{$ifNull: ['$tags', []]}, -1]}", [["y"], [], [], []]),
    ("{$let: {vars: {t: '$entity_type'}, in: {$toUpper: '$$t'}}}", ["DRIVER", "CIRCUIT", "OTHER", "DRIVER"]),
    ("{$arrayToObject: [[{k: 'a', v: 1}, {k: 'a', v: 2}]]}", [{"a": 2}] * 4),
    ("{$and: ['$tags', {$not: ['$state']}]}", [True, True, False, False]),
    ("{$cmp: ['$m.2014-01.n', 1]}", [1, -1, -1, -1]),
])
def test_expressions(world, expression, want):
    assert [r["x"] for r in rows(world, f"[{{$sort: {{_id: 1}}}}, {{$project: {{x: {expression}}}}}, {{$sort: {{_id: 1}}}}]")] == want


def test_projections(world):
    one = lambda t: rows(world, f"[{{$match: {{_id: 'a:1'}}}}, {{$project: {t}}}]")[0]
    assert one("{entity_type: 1}") == {"_id": "a:1", "entity_type": "driver"}
    assert one("{_id: 0, kind: '$entity_type', 'ev.amt': 1}") == {"kind": "driver", "ev": [{"amt": 5}]}
    assert list(one("{tags: 0, 'ev.amt': 0}")) == ["_id", "entity_type", "m", "ev", "state"]
    assert one("{tags: 0, 'ev.amt': 0}")["ev"] == [{"event_type": "open", "event_time": "2014-01-03"}]
    assert one("{_id: 0, 'a.b': '$entity_type', 'a.c': {$literal: 1}}") == {"a": {"b": "driver", "c": 1}}
    assert rows(world, "[{$match: {_id: 'a:1'}}, {$addFields: {'m.new': {n: 7, v: 0.5}, 'ev.amt': 1}}, {$project: {_id: 0, k: {$size: {$objectToArray: '$m'}}, a: '$ev.amt'}}]") == [{"k": 3, "a": [1]}]
    assert "state" not in rows(world, "[{$unset: ['state']}]")[0]


def test_unwind(world):
    assert len(rows(world, "[{$unwind: '$tags'}]")) == 2
    assert len(rows(world, "[{$unwind: {path: '$tags', preserveNullAndEmptyArrays: true}}]")) == 5
    assert len(rows(world, "[{$unwind: '$entity_type'}]")) == 4
    assert rows(world, "[{$unwind: '$nowhere'}]") == []
    assert [r["i"] for r in rows(world, "[{$unwind: {path: '$ev', includeArrayIndex: 'i'}}, {$match: {_id: 'a:4'}}, {$sort: {i: 1}}]")] == [0, 1]


def test_groups(world):
    got = rows(world, "[{$group: {_id: '$entity_type', n: {$sum: 1}, s: {$sum: '$m.2014-01.n'}, a: {$avg: '$m.2014-01.n'}, t: {$addToSet: '$state'}}}, {$sort: {_id: 1}}]")
    assert got[1] == {"_id": "driver", "n": 2, "s": 2, "a": 2.0, "t": ["present"]} and got[0]["s"] == 0 and got[0]["a"] is None
    assert rows(world, "[{$match: {_id: 'q'}}, {$group: {_id: null, n: {$sum: 1}}}]") == [] == rows(world, "[{$match: {_id: 'q'}}, {$count: 'n'}]")
    got = rows(world, "[{$sort: {_id: -1}}, {$group: {_id: null, first: {$first: '$_id'}, all: {$push: '$_id'}}}]")
    assert got[0]["first"] == "a:4" and got[0]["all"] == ["a:4", "a:3", "a:2", "a:1"]


def test_joins(world):
    got = rows(world, "[{$lookup: {from: 'other', localField: 'entity_type', foreignField: 'kind', as: 'o'}}, {$sort: {_id: 1}}, {$project: {n: {$size: '$o'}}}]")
    assert [r["n"] for r in got] == [2, 1, 0, 2]
    got = rows(world, "[{$lookup: {from: 'other', let: {k: '$entity_type'}, pipeline: [{$match: {$expr: {$eq: ['$kind', '$$k']}}}, {$sort: {_id: -1}}, {$limit: 1}, {$project: {name: 1}}], as: 'o'}}, {$sort: {_id: 1}}, {$project: {o: '$o.name'}}]")
    assert [r["o"] for r in got] == [["e"], ["c"], [], ["e"]]
    chain = world["other"].sparkSession.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 9)], "_id int, next int")
    got = run(chain, [{"$graphLookup": {"from": "c", "startWith": "$next", "connectFromField": "next", "connectToField": "_id", "as": "all", "depthField": "d"}}, {"$project": {"n": {"$size": "$all"}}}, {"$sort": {"_id": 1}}], {"c": chain}).collect()
    assert [r.n for r in got] == [3, 3, 3, 0]


def test_rounding_and_dotted_windows(world):
    got = rows(world, "[{$match: {_id: 'a:1'}}, {$project: {a: {$round: [2.5]}, b: {$round: [3.5, 0]}, c: {$round: [-0.125, 2]}}}]")[0]
    assert (got["a"], got["b"], got["c"]) == (2.0, 4.0, -0.12)
    got = rows(world, "[{$setWindowFields: {sortBy: {_id: 1}, output: {'x.y': {$documentNumber: {}}, 'x.z': {$sum: 1, window: {documents: ['unbounded', 'current']}}}}}, {$sort: {_id: 1}}, {$project: {n: '$x.y', m: '$x.z'}}]")
    assert [(r["n"], r["m"]) for r in got] == [(i, i) for i in (1, 2, 3, 4)]


def test_errors(world):
    for text in ("[{$nope: 1}]", "[{$match: {a: {$nope: 1}}}]", "[{$project: {a: {$nope: 1}}}]", "[{$match: {}, $limit: 1}]", "[{$project: {a: '$$free'}}]"):
        with pytest.raises(PipelineError):
            rows(world, text)
    with pytest.raises(PipelineError):
        rows(world, "[]", "absent")


def test_catalogue_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    text = lambda r: "|".join("~" if x is None or x != x else repr(round(float(x), 6)) if isinstance(x, (int, float)) else str(x) for x in r)
    made = {name: (catalog.query(name), sql) for name, (_, sql) in catalog.CATALOG.items()} | {name: (q, knowledge.ORACLES[name]) for name, q in knowledge.QUERIES.items()}
    for name, (query, sql) in made.items():
        df = query(spark, sf)
        cols = sorted(df.columns)
        got = sorted(text(tuple(r)) for r in df.select(*cols).collect())
        want = db.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert got == sorted(map(text, want)), name


def test_catalogue_shows_stages_on_whole_tables(spark):
    customers, orders = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect() for t in ("customer", "orders"))
    made = {k: [r.asDict() for r in catalog.query(k)(spark, "/root/testdata/sf0.001").collect()] for k in ("nested_inclusion", "densified", "graph_lookup")}
    names, nation = {c.c_custkey: c.c_name for c in customers}, {c.c_custkey: c.c_nationkey for c in customers}
    assert sorted((r["order_key"], r["name"]) for r in made["nested_inclusion"]) == sorted((o.o_orderkey, names[o.o_custkey]) for o in orders if o.o_custkey in names)
    assert [r["tripled"] for r in made["densified"]] == list(range(3 * min(names), 3 * max(names) + 1))
    want = {}
    for c in names:
        seen, at = [], c
        while at in names and at not in seen:
            seen.append(at)
            at = nation[at]
        want[f"customer:{c}"] = (len(seen), len(seen) - 1)
    assert {r["_id"]: (r["n"], r["hops"]) for r in made["graph_lookup"]} == want and max(n for n, _ in want.values()) > 2

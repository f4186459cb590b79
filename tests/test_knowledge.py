"""Induction, gates, comparison and scoring."""

import json
import math
import signal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quern import evaluate as E
from quern import gates, induce
from quern.plans.parse import parse
from quern.sources import nest, tables
from quern.sources.worlds import World


@pytest.fixture(scope="module")
def docs(spark):
    months = {f"2014-{m:02d}": {"n": m, "label": "Big Deal"} for m in range(1, 13)}
    rows = [(f"d:{i}", {"by_month": dict(list(months.items())[: 3 + i % 9]), "note": "x" if i % 2 else None}, [{"event_type": "open", "amt": i}], ["red", "blue"][: i % 3]) for i in range(12)]
    return spark.createDataFrame(rows, "_id string, book struct<by_month:map<string,struct<n:int,label:string>>,note:string>, ev array<struct<event_type:string,amt:int>>, tags array<string>")


def test_induction(docs):
    index = induce.induce(docs, "c")
    assert index.dynamic == ["book.by_month"]
    assert {"book", "book.by_month", "book.by_month.<*>", "book.by_month.<*>.n", "ev", "ev.event_type", "tags"} <= index.paths
    assert index.dominant("book.by_month.<*>.n") == "number" and index.dominant("tags[]") == "string" and index.dominant("book") == "object"
    assert index.resolves("book.by_month.1999-01.label") and index.resolves("ev.amt") and not index.resolves("book.label") and not index.resolves("nope")
    assert "c.book: object" in index.card() and "book." not in index.card(mode="toplevel").replace("c.book", "")
    nodes = induce.walk(docs)
    values = induce.value_index(nodes, "c", index.dynamic)
    found = induce.witnesses(values, ["big deal", "2014-05", "BLUE", "absent"])
    assert {x["form"] for x in found["big deal"]} == {"Big Deal"} and found["2014-05"][0]["kind"] == "key" and found["BLUE"][0]["path"] == "tags[]" and not found["absent"]
    assert induce.literals("Which \"Big Deal\" in 2014-05 has USA for Anna Bell?") == {"hard": ["Big Deal", "2014-05", "USA"], "soft": ["Big Deal", "Anna Bell"]}
    report = induce.audit(docs)
    assert report["documents"] == 12 and report["depth"] == 4 and report["presence"]["book"] == 1.0 and report["rich"]


@pytest.fixture(scope="module")
def large(spark):
    """Arrays of over 8 and over 50 elements, with a value and a map in the last ones, and eight levels."""
    deep = "struct<b:struct<c:struct<d:struct<e:struct<f:struct<g:struct<h:int>>>>>>>"
    rows = [("d:1", [("v%d" % i, {"2014-01": i, "2014-02": i} if i == 59 else None, [1] * (i % 3)) for i in range(60)], (((((((1,),),),),),),)), ("d:2", [("last", None, [])], None), ("d:3", [], None), ("d:4", None, None)]
    return spark.createDataFrame(rows, f"_id string, ev array<struct<name:string,by_day:map<string,int>,own:array<int>>>, a {deep}")


def test_audit_of_all_levels_and_elements(large):
    report = induce.audit(large)
    assert report["arrays"]["ev"] == (0, 60, 61 / 3) and report["arrays"]["ev[].own"] == (0, 2, 60 / 61)
    assert report["depth"] == 8 and "ev[].by_day" in report["dynamic"] and report["presence"]["ev"] == 0.75
    free = large.select("_id", F.parse_json(F.lit("[" * 20 + "1" + "]" * 20)).alias("x"))
    assert induce.audit(free)["depth"] == 21
    assert not any(p.count(".") >= 7 for p in induce.induce(large, "c").types)


def test_values_of_all_elements(large):
    values = induce.value_index(induce.walk(large), "c", [])
    found = induce.witnesses(values, ["v7", "v8", "v59", "v60"])
    assert [len(found[x]) for x in ("v7", "v8", "v59", "v60")] == [1, 1, 1, 0]


def test_structure_gate(spark, docs):
    rows = [("d:1", {"2014-01": [("x", {"s": 1})]}, "Present"), ("d:2", {"2014-01": []}, "missing")]
    full = spark.createDataFrame(rows, "_id string, by_month map<string,array<struct<name:string,by_kind:map<string,int>>>>, state string")
    report = induce.audit(full)
    assert report["shapes"] == {"key_array_object": ["by_month.<*>[]", "by_month.<*>[].by_kind.<*>"], "array_object_key": ["by_month.<*>[].by_kind.<*>"]}
    assert report["states"] == {"present": 1, "missing": 1} and induce.gate(report) == []
    poor = induce.audit(docs)
    assert poor["rich"] and induce.gate(poor) == ["no path of shape key_array_object", "no path of shape array_object_key", "no presence states"]
    assert induce.gate(poor, report) == [] and len(induce.gate(induce.audit(full.select("_id", "state")))) == 3
    assert induce.gate(induce.audit(full.where("state = 'Present'"))) == ["no presence states"]


def test_gates(docs):
    index = induce.induce(docs, "c")
    _, good = parse("db.c.aggregate([{$addFields: {e: {$objectToArray: '$book.by_month'}}}, {$unwind: '$e'}, {$match: {'e.v.n': {$gt: 2}}}, {$group: {_id: '$e.k', n: {$sum: 1}}}, {$sort: {n: -1}}])")
    assert gates.path_gate("c", good, {"c": index}) == []
    _, bad = parse("db.c.aggregate([{$match: {'book.weeks': 1}}, {$group: {_id: '$ev.nope'}}, {$project: {a: '$tags'}}])")
    assert gates.path_gate("c", bad, {"c": index}) == ["stage 0: no path book.weeks", "stage 1: no path ev.nope", "stage 2: no path tags"]
    _, none = parse("db.c.aggregate([{$unwind: '$tags'}, {$match: {tags: 'green'}}, {$project: {tags: 1}}])")
    assert gates.first_empty(docs, none) == 2 and gates.first_empty(docs, good) is None
    assert gates.joinable(docs, "_id", docs, "_id") and not gates.joinable(docs, "_id", docs, "tags")
    stored = {"big deal": [{"form": "Big Deal"}]}
    assert gates.value_gate([{"$match": {"label": "big deal"}}], stored) and not gates.value_gate([{"$match": {"label": "Big Deal"}}], stored)


CASES = [
    ([{"a": 1}], [{"b": 1}], False, 1, 1.0, "correct"), ([{"a": 1}], [{"a": 1, "x": 2}], False, 1, 0.0, "correct"), ([{"a": 1}], [{"a": 1, "x": 2, "y": 3}], False, 1, 0.0, "correct"),
    ([{"a": 1}], [{"a": 1, "x": 2, "y": 3, "z": 4}], False, 0, 0.0, "value_mismatch"), ([{"a": 1}], [{"a": 1.0}], False, 1, 1.0, "correct"), ([{"a": 1}, {"a": 1}], [{"a": 1}], False, 0, 0.666667, "row_subset"),
    ([{"a": 1}, {"a": 2}], [{"a": 2}, {"a": 1}], True, 0, 1.0, "order_only"), ([{"a": {"x": 1}}], [{"a": {"y": 1}}], False, 0, 0.0, "value_mismatch"), ([], [], False, 1, 1.0, "correct"),
    ([{"a": True}], [{"a": 1}], False, 0, 0.0, "value_mismatch"), ([{"a": 1}], [], False, 0, 0.0, "empty"), ([{"a": 1}], [{"a": 1}, {"a": 2}], False, 0, 0.666667, "row_superset"),
]


@pytest.mark.parametrize(("gold", "got", "ordered", "exc", "f1", "kind"), CASES)
def test_scores(gold, got, ordered, exc, f1, kind):
    assert E.score(gold, got, ordered=ordered) == {"exc": exc, "exf1": f1, "outcome": kind}
    assert E.score(gold, gold, ordered=ordered)["exc"] == 1


def test_matching_needs_augmenting():
    gold = [{"a": 1}, {"a": 1, "b": 2}]
    assert E.matches(gold, [{"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 2}]) and E.matches(gold, [{"a": 1, "b": 2}, {"a": 1, "b": 9}]) and not E.matches(gold, [{"a": 1, "c": 3}, {"a": 1, "b": 9}])


def test_metric_sweep():
    gold = [{"a": i, "b": f"r{i}"} for i in range(4)]
    passes = {(r["probe"], r["surplus"]): r["passes"] for r in E.surplus_sweep(gold)}
    assert [passes["double_helper", b] for b in (0, 1, 2, 3, math.inf)] == [False, False, True, True, True]
    assert not passes["triple_surplus", 2] and passes["triple_surplus", 3] and passes["full_doc_dump", math.inf] and not passes["empty_result", math.inf] and not passes["constant_scalar", math.inf]
    assert not any(r["passes"] for r in E.surplus_sweep([]) if r["probe"] == "constant_scalar") and E.least_sound_surplus([(gold, False), (gold[:1], True)])["surplus"] == 2 == E.SURPLUS
    assert E.self_scores(gold) == [] and E.self_scores([]) == ["empty"] and E.same_named_rows(gold, gold[::-1]) and not E.same_named_rows([{"a": 1}], [{"b": 1}])
    assert E.outcome(gold, gold[::-1], ordered=True) == "order_only" and E.outcome(gold, [{**r, "more": i} for i, r in enumerate(gold[::-1])], ordered=True) == "value_mismatch"
    assert E.mcnemar(0, 0) == 1.0 and E.mcnemar(5, 0) == 0.0625 == E.mcnemar(0, 5) and E.entropy([1, 1, 1, 1]) == 1.0
    best = E.vote([{"rows": [{"a": 1}]}, {"rows": [{"b": 2}], "violations": 0}, {"rows": [{"c": 2}], "violations": 1}, {"rows": None}])
    assert best["votes"] == 2 and best["rows"] == [{"b": 2}]


def exact_p(wins, losses):
    n, tail, term = wins + losses, 1, 1
    for i in range(min(wins, losses)):
        term = term * (n - i) // (i + 1)
        tail += term
    return float(min(Fraction(1), Fraction(2 * tail, 1 << n)))


@pytest.fixture
def alarm():
    def late(*_):
        raise TimeoutError

    was = signal.signal(signal.SIGALRM, late)
    signal.alarm(30)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, was)


def test_paired_test_of_many_tasks(alarm):
    """As many wins and losses as 60 times sf0.1 has; one of them took over seven minutes when each binomial was made anew."""
    for wins, losses in ((40723, 42678), (38854, 44054), (41500, 41501), (41500, 41300), (1023, 1024), (1024, 1024), (1000, 1100), (999, 1201), (0, 1080), (7, 1100), (0, 5000), (20, 90)):
        assert E.mcnemar(wins, losses) == E.mcnemar(losses, wins) == exact_p(wins, losses), (wins, losses)
    n = 10**8
    for wins in (n // 2 - 5000, n // 2 - 20000):
        assert E.mcnemar(wins, n - wins) == pytest.approx(math.erfc((n - 2 * wins - 1) / math.sqrt(2 * n)), rel=1e-5)


def test_paired_over_many_rows(spark):
    rows = spark.range(60000).selectExpr("'d' as db_id", "id as record_id", "int(id % 2) as a", "int(id % 20 < 11) as b")
    scores = rows.selectExpr("db_id", "record_id", "stack(2, 'a', a, 'b', b) as (system_id, exc)")
    got = E.paired(scores, "a").first()
    want = [(i % 2, int(i % 20 < 11)) for i in range(60000)]
    wins, losses = want.count((0, 1)), want.count((1, 0))
    assert (got.system_id, got.wins, got.losses, got.delta) == ("b", wins, losses, 0.05) and got.p_value == exact_p(wins, losses)


def test_frames(spark):
    a = spark.createDataFrame([(1, "x", True), (1, "x", True), (2, None, False)], "a int, b string, c boolean")
    b = spark.createDataFrame([("x", True, 1.0), (None, False, 2.0), ("x", True, 1.0)], "q string, r boolean, s double")
    assert E.equal_frames(a, b) and E.frame_f1(a, b) == 1.0
    assert not E.equal_frames(a, b.limit(2)) and E.difference(a, b.where("q is null")).count() == 1
    scores = spark.createDataFrame([("s1", "d", 1, 1, 1.0, "correct"), ("s1", "d", 2, 0, None, "row_count_exceeded"), ("s2", "d", 1, 0, 0.5, "row_subset")], "system_id string, db_id string, record_id int, exc int, exf1 double, outcome string")
    tasks = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "db_id string, record_id int")
    full = E.with_missing(scores, tasks, scores)
    got = {r.system_id: r for r in E.summary(full).collect()}
    assert got["s1"].n == got["s2"].n == 3 and got["s1"].exc == 0.333333 and not got["s1"].complete
    shares = E.distribution(full).collect()
    assert len(shares) == 2 * len(E.OUTCOMES) and abs(sum(r.share for r in shares) - 2) < 1e-4
    assert E.paired(full, "s1").collect()[0].losses == 1
    assert E.slices(full, ["db_id", "outcome"]).where("axis = 'db_id'").count() == 2


def test_sources(spark, tmp_path):
    world = World(spark, "/root/testdata/sf0.001")
    parts = world["part_catalog"]
    assert len(world) == 16 and tables.exists(parts, "size(tags) > 2")
    rows, more = tables.bounded(parts, 10)
    assert len(rows) == 10 and more and tables.bounded(parts.limit(3), 3)[1] is False
    assert [r["_id"] for r in tables.preview(tables.front(parts, 2))] == ["part:0", "part:1"]
    every = sorted(r._id for r in parts.select("_id").collect())
    assert sorted(r._id for r in tables.stride(parts, 20).select("_id").collect()) == every[:: -(-len(every) // 20)]
    assert tables.find_one(parts, "part_id = 3", ["_id"]) == {"_id": "part:3"} and tables.find_one(parts, "part_id = -1") is None
    assert len(tables.snapshot({"p": parts}, 2)["p"]) == 2 and tables.digest(parts, 1)["values"] and tables.observed(parts, 1, 10) == {"rows": len(every), "shown": tables.observed(parts, 1, 10)["shown"], "cut": True}
    assert json.loads("{" + tables.to_yaml({"a": 1}).strip() + "}") == {"a": 1} and tables.to_yaml([{"b": ["x"]}]) == '-\n  "b":\n    - "x"\n' and tables.to_markdown([{"a": 1, "b": "x|y"}]).splitlines()[2] == "| 1 | x\\|y |"
    (tmp_path / "r.json").write_text(json.dumps([{"db_id": "d", "record_id": i, "k": {"$oid": f"o{i}"}} for i in range(4)]))
    assert [r.k for r in tables.extended(tables.release(spark, str(tmp_path / "r.json"), ["d"], [1, 2], 1)).collect()] == ["o1"]
    raw = tables.raw_documents(parts, 1, 20)[0]
    assert raw["truncated"] and len(raw["text"].encode()) <= 20
    for kind in ("json", "csv", "parquet"):
        tables.write(parts, str(tmp_path / kind), kind)
    assert tables.jsonl(spark, str(tmp_path / "json")).count() == tables.csv(spark, str(tmp_path / "csv")).count() == parts.count()
    assert tables.world_signature({"p": parts}) == tables.world_signature({"p": parts.repartition(3)}) != tables.world_signature({"p": parts.limit(5)})
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "g int, x string, y string")
    assert nest.adjacency(edges, "x", "y", ["g"], "adj").first().adj == {"a": ["b"], "b": ["a", "c"], "c": ["b"]}
    q = spark.createDataFrame([([5.0, 1.0, None, 3.0, 9.0],)], "v array<double>").select(nest.lower_quantile(F.col("v"), 0.5).alias("q"))
    assert q.first().q == 3.0

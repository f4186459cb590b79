import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.errors import ForbiddenOperator, PipelineError
from quern.plans import policy
from quern.plans.parse import parse, render
from quern.plans.rewrite import rewrite


def test_relaxed_notation():
    text = """// a comment
    db.things.aggregate( [ {$match: {'a.b': {"$gte": -1.5e1, $lt: 0x1F}, s: 'it\\'s [ok]', n: null,}}, /* more */ {$limit: +3,}, ] )"""
    assert parse(text) == ("things", [{"$match": {"a.b": {"$gte": -15.0, "$lt": 31}, "s": "it's [ok]", "n": None}}, {"$limit": 3}])


@pytest.mark.parametrize("text", ["", "db.x.find({})", "db.x.aggregate({})", "db.x.aggregate([", "db.x.aggregate([1])", "db.x.aggregate([{a b}])", "db.x.aggregate(['x])"])
def test_not_a_pipeline(text):
    with pytest.raises(PipelineError):
        parse(text)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=6), x, max_size=3), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=6), json_values, max_size=3), max_size=4))
def test_render_and_parse(stages):
    assert parse(render("c", stages)) == ("c", stages)


def test_forbidden():
    for text in ("db.c.aggregate([{$out: 'x'}])", "db.c.aggregate([{$facet: {a: [{$sample: {size: 1}}]}}])", "db.c.aggregate([{$project: {t: '$$NOW'}}])", "db.c.aggregate([{$addFields: {a: {$function: {}}}}])"):
        _, stages = parse(text)
        with pytest.raises(ForbiddenOperator):
            policy.check(stages, text)
        assert policy.feedback(text) == ["DISABLED"]
    assert policy.feedback(" ") == ["EMPTY"] and policy.feedback("x") == ["PARSE"] and policy.feedback("db.c.aggregate([{$match: {a: '$outer'}}])") == []


def test_analysis():
    _, a = parse("db.c.aggregate([{$lookup: {from: 'd', localField: 'x', foreignField: 'y', as: 'z'}}, {$project: {m: {$objectToArray: '$m'}}}, {$sort: {a: 1}}])")
    _, b = parse("db.c.aggregate([{$lookup: {from: 'e', localField: 'q', foreignField: 'r', as: 's'}}, {$project: {n: {$objectToArray: '$n'}}}, {$sort: {b: 1}}])")
    assert policy.signature(policy.skeleton(a)) == policy.signature(policy.skeleton(b)) and policy.signature(a) != policy.signature(b)
    assert policy.canonical_form(a)["must"] == ["$lookup"] and not policy.meets(b, policy.canonical_form(a)) and policy.meets(b[1:], policy.canonical_form(a)) == ["lacks $lookup"]
    assert policy.resistance(a) == "medium" and policy.resistance(a, verified=True) == "strong" and policy.resistance([*a, {"$project": {"x": {"$ifNull": ["$x", 0]}}}]) == "strong" and policy.resistance([{"$unwind": "$e"}, {"$group": {"_id": {"$ifNull": ["$a", 1]}}}]) == "weak" and policy.order_sensitive(a) and not policy.order_sensitive(a[:2])
    assert policy.depths(a) == {"join_depth": "1", "aggregation_depth": "shallow"} and policy.depths([{"$unionWith": "x"}, {"$bucket": {}}]) == {"join_depth": "1", "aggregation_depth": "medium"} and policy.depths([{"$lookup": {}}] * 4 + [{"$group": {}}]) == {"join_depth": "3+", "aggregation_depth": "deep"}
    assert policy.uses_feature(a, "dynamic_key_object", "own.m") == [] and policy.uses_feature(a, "nested_event_stream", "nowhere") == ["none of $filter", "no mention of nowhere"] and policy.synthetic_id([{"_id": "a::b"}]) and not policy.synthetic_id([{"_id": "a"}])
    assert policy.limit_missing("the top 5 of them", a) and not policy.limit_missing("the top 5", [{"$limit": 5}])
    assert policy.signature({"a": 1.0, "b": -0.0}) == policy.signature({"b": 0, "a": 1}) != policy.signature({"a": True, "b": 0})


def test_matches_move_before_unwinding():
    got = rewrite([{"$unwind": "$e"}, {"$sort": {"a": 1}}, {"$match": {"a": 1}}, {"$match": {"e.x": 2}}])
    assert got == [{"$match": {"a": 1}}, {"$unwind": "$e"}, {"$match": {"e.x": 2}}, {"$sort": {"a": 1}}]
    same = [{"$limit": 3}, {"$match": {"a": 1}}]
    assert rewrite(same) == same

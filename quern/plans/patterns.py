"""Questions to the five native structures, as stage lists.

Most ask the same: of how many elements of a document does something hold, and which documents have enough
of them? ``_asked`` answers that for any structure from a source of elements and a test; what is left are
questions about documents, which are matched or grouped as they are. All end in a total order.
"""

from __future__ import annotations

from typing import Any

from quern.errors import PipelineError

Stages = list[dict[str, Any]]
IT = "$$it"


def _entries(field: str) -> dict[str, Any]:
    return {"$objectToArray": {"$ifNull": [f"${field}", {}]}}


def _elements(field: str) -> dict[str, Any]:
    return {"$ifNull": [f"${field}", []]}


def _counting(source: Any, test: Any) -> dict[str, Any]:
    return {"$size": {"$filter": {"input": source, "as": "it", "cond": test}}}


def _ordered(order: dict[str, int], limit: int | None) -> Stages:
    return [{"$sort": order}, *([{"$limit": limit}] if limit else [])]


def _asked(n: Any, least: int, limit: int | None, **shown: Any) -> Stages:
    """Documents with a number n of at least ``least``, largest first."""
    return [{"$project": {"n": n, **shown}}, {"$match": {"n": {"$gte": least}}}, *_ordered({"n": -1, "_id": 1}, limit)]


def _tally(by: dict[str, Any], limit: int | None, order: dict[str, int] | None = None, **more: Any) -> Stages:
    """One row for each combination of ``by``: its number of documents, and more accumulators."""
    back = {k: f"$_id.{k}" for k in by}
    return [{"$group": {"_id": by, "documents": {"$sum": 1}, **more}}, {"$project": {"_id": 0, **back, "documents": 1, **dict.fromkeys(more, 1)}}, *_ordered(order or dict.fromkeys(by, 1), limit)]


def _pick(table: dict[str, Any], variant: str) -> Any:
    if variant not in table:
        raise PipelineError(f"no variant {variant}")
    return table[variant]()


def free_keys(field: str, variant: str, *, key: str = "", metric: str = "", threshold: float = 0, least: int = 1, limit: int | None = None, context: str = "") -> Stages:
    """Documents by the keys of a map: present, over, populated, names, any_over, counted, by_key; by_context."""
    one = {"$literal": 1}
    at = f"{field}.{key}"
    opened = [{"$project": {"context": f"${context}" if context else one, "entry": _entries(field)}}, {"$unwind": "$entry"}]
    return _pick({
        "present": lambda: [{"$match": {at: {"$exists": True}}}, *_asked(one, 1, limit)],
        "over": lambda: [{"$match": {f"{at}.{metric}": {"$gt": threshold}}}, *_asked(one, 1, limit)],
        "populated": lambda: _asked({"$size": _entries(field)}, least, limit),
        "any_over": lambda: _asked(_counting(_entries(field), {"$gt": [f"{IT}.v.{metric}", threshold]}), 1, limit),
        "names": lambda: [{"$project": {"own": _entries(field)}}, *_asked({"$size": "$own"}, 1, limit, first_key={"$arrayElemAt": ["$own.k", 0]})],
        "counted": lambda: _tally({"keys": {"$size": _entries(field)}}, limit),
        "by_key": lambda: [*opened, *_tally({"key": "$entry.k"}, limit, largest={"$max": f"$entry.v.{metric}"})],
        "by_context": lambda: [*opened, {"$match": {f"entry.v.{metric}": {"$gt": threshold}}}, *_tally({"context": "$context", "key": "$entry.k"}, limit)],
    }, variant)


def kinds(discriminator: str, labels: dict[str, Any], variant: str, *, default: Any = None, wanted: str = "", metric: Any = None, limit: int | None = None) -> Stages:
    """Documents of several kinds: a value by kind (dispatch), one kind (only), a count (grouped), field names (fields)."""
    kind = f"${discriminator}"
    chosen = {"$switch": {"branches": [{"case": {"$eq": [kind, k]}, "then": e} for k, e in labels.items()], "default": default}}
    return _pick({
        "dispatch": lambda: [{"$project": {"kind": kind, "chosen": chosen}}, *_ordered({"chosen": 1, "_id": 1}, limit)],
        "only": lambda: [{"$match": {discriminator: wanted}}, {"$project": {"chosen": chosen}}, *_ordered({"chosen": 1, "_id": 1}, limit)],
        "grouped": lambda: [*_tally({"kind": kind}, None, average={"$avg": metric or chosen}), {"$addFields": {"average": {"$round": ["$average", 4]}}}, *_ordered({"kind": 1}, limit)],
        "fields": lambda: [{"$project": {"kind": kind, "own": {"$objectToArray": "$$ROOT"}}}, {"$unwind": "$own"}, {"$match": {"own.v": {"$ne": None}}}, *_tally({"kind": "$kind", "field": "$own.k"}, limit)],
    }, variant)


def tag_sets(field: str, tags: list[str], variant: str, *, least: int = 1, without: str = "", limit: int | None = None) -> Stages:
    """Documents by their tags: any, all, at_least, without, classify, counted, sizes."""
    own = _elements(field)
    shared = {"$size": {"$setIntersection": [own, tags]}}
    return _pick({
        "any": lambda: _asked(shared, 1, limit),
        "at_least": lambda: _asked(shared, least, limit),
        "all": lambda: [{"$addFields": {"whole": {"$setIsSubset": [tags, own]}}}, {"$match": {"whole": True}}, *_asked({"$size": own}, 1, limit)],
        "without": lambda: [{"$match": {field: {"$nin": [without]}}}, *_asked(shared, 1, limit)],
        "classify": lambda: _tally({"overlap": {"$arrayElemAt": [["none", "one", "several"], {"$min": [shared, 2]}]}}, limit),
        "counted": lambda: [{"$unwind": f"${field}"}, *_tally({"tag": f"${field}"}, limit, {"documents": -1, "tag": 1})],
        "sizes": lambda: _tally({"tags": {"$size": own}}, limit),
    }, variant)


def events(field: str, variant: str, *, kind: str = "", since: str = "", metric: str = "", threshold: float = 0, least: int = 1, limit: int | None = None, context: str = "") -> Stages:
    """Documents by their events: of_kind, since, over, kind_over, timed, kind_timed, at_least, kinds_seen, by_kind, by_context."""
    is_kind, timed, over = {"$eq": [f"{IT}.event_type", kind]}, {"$ne": [f"{IT}.event_time", None]}, {"$gt": [f"{IT}.{metric}", threshold]}
    tests = {"of_kind": is_kind, "at_least": is_kind, "since": {"$gte": [f"{IT}.event_time", since]}, "over": over, "kind_over": {"$and": [is_kind, over]}, "timed": timed, "kind_timed": {"$and": [is_kind, timed]}}
    if variant in tests:
        return _asked(_counting(_elements(field), tests[variant]), least, limit)
    each = [{"$unwind": f"${field}"}]
    return _pick({
        "kinds_seen": lambda: [*each, {"$group": {"_id": "$_id", "kinds": {"$addToSet": f"${field}.event_type"}}}, *_asked({"$size": "$kinds"}, 1, limit)],
        "by_kind": lambda: [*each, {"$group": {"_id": f"${field}.event_type", "events": {"$sum": 1}, "largest": {"$max": f"${field}.{metric}"}}}, {"$project": {"_id": 0, "kind": "$_id", "events": 1, "largest": 1}}, *_ordered({"kind": 1}, limit)],
        "by_context": lambda: [*each, *_tally({"context": f"${context}", "kind": f"${field}.event_type"}, limit)],
    }, variant)


def presence(field: str, variant: str, *, states: list[str] | None = None, context: str = "", metric: str = "", limit: int | None = None) -> Stages:
    """Documents by an explicit state: listed, counted, by_context, is_set, measured."""
    state = {"$ifNull": [f"${field}", "missing"]}
    return _pick({
        "listed": lambda: [{"$project": {"state": state}}, {"$match": {"state": {"$in": states or ["missing", "null"]}}}, *_ordered({"state": 1, "_id": 1}, limit)],
        "counted": lambda: _tally({"state": state}, limit),
        "by_context": lambda: [{"$group": {"_id": {"presence": {"state": state}, "context": f"${context}"}, "documents": {"$sum": 1}}}, {"$project": {"_id": 0, "state": "$_id.presence.state", "context": "$_id.context", "documents": 1}}, *_ordered({"context": 1, "state": 1}, limit)],
        "is_set": lambda: [{"$match": {field: {"$exists": True, "$ne": None}}}, {"$project": {"kept": "$" + field}}, *_ordered({"_id": 1}, limit)],
        "measured": lambda: _tally({"state": state}, limit, least={"$min": f"${metric}"}, largest={"$max": f"${metric}"}),
    }, variant)

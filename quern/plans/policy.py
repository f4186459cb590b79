"""What a pipeline uses, what is forbidden, and what it looks like with names and values taken out."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

from quern.errors import ForbiddenOperator

Stages = list[dict[str, Any]]

# Operators that write, run code or draw at random, and the clock.
FORBIDDEN = ("$sample", "$rand", "$out", "$merge", "$function", "$$NOW")
# Operators without which a query of their kind can't be written.
STRUCTURAL = frozenset({"$lookup", "$setWindowFields", "$facet", "$graphLookup", "$unionWith"})
# Stages that make the order of the result part of it.
ORDERING = frozenset({"$sort", "$limit", "$skip", "$setWindowFields"})
# Evidence that a query needs nested documents.
STRONG = frozenset({"$objectToArray", "$switch", "$setIntersection", "$setIsSubset", "$setUnion"})
MEDIUM = frozenset({"$filter", "$map", "$reduce", "$type", "$exists", "$ifNull", "$cond"})
FLAT = frozenset({"$lookup", "$unwind", "$group"})


def walk(node: Any) -> Iterator[tuple[str, str]]:
    """("key" or "text", string) for every key and string value at any depth."""
    if isinstance(node, dict):
        for k, v in node.items():
            yield "key", k
            yield from walk(v)
    elif isinstance(node, list):
        for x in node:
            yield from walk(x)
    elif isinstance(node, str):
        yield "text", node


def operators(stages: Stages) -> set[str]:
    return {s for kind, s in walk(stages) if kind == "key" and s.startswith("$")}


def root_operators(stages: Stages) -> set[str]:
    return {k for s in stages for k in s if k.startswith("$")}


def forbidden(stages: Stages, text: str = "") -> set[str]:
    """Forbidden operators as keys, inside strings, or in the text as whole tokens."""
    strings = [s for _, s in walk(stages)] + [text]
    return {t for t in FORBIDDEN if any(re.search(rf"(?<![\w$]){re.escape(t)}(?!\w)", s) for s in strings)}


def check(stages: Stages, text: str = "") -> None:
    if found := forbidden(stages, text):
        raise ForbiddenOperator(f"not allowed: {', '.join(sorted(found))}")


def order_sensitive(stages: Stages) -> bool:
    return bool(root_operators(stages) & ORDERING)


def feedback(text: str) -> list[str]:
    """Codes for what is wrong with a pipeline before it runs: EMPTY, PARSE, DISABLED."""
    from quern.errors import PipelineError
    from quern.plans.parse import parse

    if not (text or "").strip():
        return ["EMPTY"]
    try:
        _, stages = parse(text)
    except PipelineError:
        return ["PARSE"]
    return ["DISABLED"] if forbidden(stages, text) else []


def canonical_form(stages: Stages, shape: str | None = None) -> dict[str, list[str]]:
    """What any equal query must have: its structural operators; with shape "preserve", no regrouping at the root."""
    banned = sorted(x for x in FORBIDDEN if x[1] != "$")
    return {"must": sorted(operators(stages) & STRUCTURAL), "must_not": banned, "root_must_not": ["$group", "$unwind"] if shape == "preserve" and not root_operators(stages) & {"$group", "$unwind"} else []}


def meets(stages: Stages, form: dict[str, list[str]]) -> list[str]:
    """Violations of a canonical form; empty if it holds."""
    used, root = operators(stages), root_operators(stages)
    return [f"lacks {x}" for x in form.get("must", ()) if x not in used] + [f"has {x}" for x in form.get("must_not", ()) if x in used] + [f"has {x} at the root" for x in form.get("root_must_not", ()) if x in root]


def skeleton(node: Any) -> Any:
    """The pipeline with field names, paths and values replaced; operators and shape stay."""
    if isinstance(node, dict):
        return {(k if k.startswith("$") else f"<{i}>"): skeleton(v) for i, (k, v) in enumerate(node.items())}
    if isinstance(node, list):
        return [skeleton(x) for x in node]
    if isinstance(node, str):
        return "$path" if node.startswith("$") else "text"
    return "null" if node is None else type(node).__name__


def canonical_value(x: Any) -> Any:
    """Integral floats as integers, others rounded to 12 digits, keys sorted; booleans stay apart from numbers."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        y = round(float(x), 12) if isinstance(x, float) else x
        return int(y) if y == y and abs(y) != float("inf") and y == int(y) else y
    if isinstance(x, dict):
        return {str(k): canonical_value(x[k]) for k in sorted(x, key=str)}
    if isinstance(x, (list, tuple)):
        return [canonical_value(y) for y in x]
    return str(x)


def signature(x: Any) -> str:
    return hashlib.sha256(json.dumps(canonical_value(x), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def resistance(stages: Stages, verified: bool = False) -> str:
    """How far the query is from flat SQL: strong, medium or weak. A strong operator needs a second sign: another one, a medium one, or verification."""
    used = operators(stages)
    strong, medium = used & STRONG, used & MEDIUM
    if {"$unwind", "$group"} <= used and not strong and "$filter" not in used:
        return "weak"
    signs = len(strong) + bool(medium) + verified
    return "strong" if strong and signs > 1 else "medium" if strong or medium else "weak"


def depths(stages: Stages) -> dict[str, Any]:
    """Joins among the stages, up to 3+, and how deep aggregation goes."""
    root = [k for s in stages for k in s]
    joins = sum(k in ("$lookup", "$graphLookup", "$unionWith") for k in root)
    groups = any(k in ("$group", "$bucket", "$bucketAuto", "$facet", "$setWindowFields") for k in root)
    return {"join_depth": "3+" if joins >= 3 else str(joins), "aggregation_depth": "shallow" if not groups else "medium" if len(stages) <= 4 else "deep"}


def synthetic_id(rows: list[dict[str, Any]], look: int = 5) -> bool:
    """Do the first rows show an ``_id`` put together from parts?"""
    return any("::" in str(r.get("_id", "")) for r in rows[:look])


#: Structure -> which operators show that a pipeline uses it: one of each set.
USES: dict[str, tuple[frozenset[str], ...]] = {
    "dynamic_key_object": (frozenset({"$objectToArray"}),), "polymorphic_collection": (frozenset({"$switch", "$cond", "$eq", "$in"}),), "derived_tag_array": (frozenset({"$setIntersection", "$setIsSubset", "$setUnion"}), frozenset({"$size", "$setIsSubset"})),
    "nested_event_stream": (frozenset({"$filter"}),), "missing_vs_present": (frozenset({"$exists", "$type", "$ifNull", "$cond"}),),
}


def uses_feature(stages: Stages, kind: str, path: str) -> list[str]:
    """What a pipeline lacks to show a native structure of a kind at a path; nothing if it does."""
    used, text = operators(stages), json.dumps(stages, ensure_ascii=False, default=str)
    out = [f"none of {', '.join(sorted(x))}" for x in USES[kind] if not used & x]
    named = any(re.search(rf"(?<![\w.]){re.escape(p)}(?![\w])", text) for p in (path, path.rsplit(".", 1)[-1]))
    return out if named else [*out, f"no mention of {path}"]


def limit_missing(question: str, stages: Stages) -> bool:
    """The question asks for so many rows and the pipeline bounds nothing."""
    return bool(re.search(r"\b(?:top|first|at most|last|only)\s+\d+\b", question, re.I)) and "$limit" not in operators(stages)

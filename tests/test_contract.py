"""Every row of the contract's table with an accepted and a refused value."""

import copy
import re

import pytest

from triagelake.plans import contract
from triagelake.plans.contract import LIMITS, violations

TEXTS = {contract.ALERT: "0" * 20, contract.PARTY: "Party-0123456789", contract.RULE: "R3", contract.ORDERING: "C1", contract.DIGEST: "a" * 64, contract.DAY: "2022-09-04"}


def example(path=""):
    """The smallest value that the table accepts at a path, with one item in every list and map."""
    bound = LIMITS[path] if path else contract.Bound("object")
    if bound.kind == "object":
        start = f"{path}." if path else ""
        return {p[len(start) :]: example(p) for p in LIMITS if p.startswith(start) and re.fullmatch(r"\w+", p[len(start) :])}
    if bound.kind == "map":
        return {"key": example(f"{path}.{{}}")}
    if bound.kind == "list":
        return [example(f"{path}[]") for _ in range(int(max(bound.least or 0, 1)))]
    if bound.kind == "text":
        return TEXTS[bound.pattern] if bound.pattern else "text"
    return {"flag": True, "whole": int(bound.least or 0), "number": float(bound.least or 0), "any": None}[bound.kind]


def places(value, path):
    """(parent, key) of the values at a path."""
    out = [(None, None, value)]
    for part in re.findall(r"\w+|\[\]|\{\}", path):
        nxt = []
        for _, _, v in out:
            keys = range(len(v)) if part == "[]" else list(v) if part == "{}" else [part]
            nxt += [(v, k, v[k]) for k in keys]
        out = nxt
    return [(p, k) for p, k, _ in out]


def bad_values(bound):
    wrong = {"object": [], "map": 3, "list": {}, "text": 5, "flag": 1, "whole": 1.5, "number": "1"}
    yield wrong[bound.kind]
    if not bound.may_be_null:
        yield None
    if bound.kind == "text":
        if bound.pattern:
            yield "no such"
        if bound.most:
            yield "x" * int(bound.most + 1)
            yield ""
    elif bound.kind in ("whole", "number"):
        step = 1 if bound.kind == "whole" else 0.01
        if bound.least is not None:
            yield bound.least - step
        if bound.most is not None:
            yield bound.most + step
        yield True


def test_the_smallest_artifact_is_accepted():
    assert violations(example()) == []


@pytest.mark.parametrize("path", [p for p, b in LIMITS.items() if b.kind != "any"])
def test_every_bound_refuses(path):
    bound = LIMITS[path]
    for bad in bad_values(bound):
        made = example()
        parent, key = places(made, path)[0]
        parent[key] = bad
        assert violations(made), (path, bad)
    made = example()
    parent, key = places(made, path)[0]
    if bound.kind == "list":
        item = parent[key][0]
        parent[key] = [copy.deepcopy(item) for _ in range(int(bound.most))]
        assert violations(made) == []
        parent[key].append(copy.deepcopy(item))
        assert violations(made)
    elif bound.kind == "map" and bound.most:
        item = parent[key]["key"]
        parent[key] = {str(k): copy.deepcopy(item) for k in range(int(bound.most) + 1)}
        assert violations(made)
    elif bound.kind == "object":
        parent[key]["more"] = 1
        assert any("not a published field" in v for v in violations(made))
    if isinstance(parent, dict) and not path.endswith("{}"):
        made = example()
        parent, key = places(made, path)[0]
        del parent[key]
        assert any("missing" in v for v in violations(made))
    if bound.may_be_null:
        made = example()
        parent, key = places(made, path)[0]
        parent[key] = None
        assert violations(made) == []


def test_published_bounds():
    most = {p: b.most for p, b in LIMITS.items() if b.kind == "list"}
    assert most["queue"] == 3000 and most["evidence.per_period"] == 12 and most["evidence.feature_importance.top"] == 15 and most["queue[].attempt_ids"] == 16 and most["rules"] == 8
    assert contract.limits(20)["evidence.rank_stability.pairs"].most == 20 and contract.limits(20)["queue"].most == 3000

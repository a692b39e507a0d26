"""Declared inputs: components, rules, vocabulary and gate policy from plain dictionaries or JSON files."""

from __future__ import annotations

import json
from dataclasses import fields, replace

from ..operators.constraints import FORMS, VIAS, Component, Rule
from ..operators.diffing import Policy
from ..operators.linking import Vocabulary


def component(spec: dict | str, named: dict[str, Component]) -> Component:
    """A component by name, or declared in place with ``where``, ``paths`` and ``names``."""
    if isinstance(spec, str):
        if spec not in named:
            raise ValueError(f"no component {spec}")
        return named[spec]
    unknown = set(spec) - {"where", "paths", "names"}
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    return Component(where={k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in spec.get("where", {}).items()}, paths=tuple(spec.get("paths", ())), names=tuple(spec.get("names", ())))


def rules(spec: dict) -> list[Rule]:
    """The rules of a declaration with ``components`` and ``rules``; what can't be judged is an error, never a silent pass."""
    named: dict[str, Component] = {}
    for name, one in spec.get("components", {}).items():
        named[name] = component(one, named)
    out: list[Rule] = []
    for one in spec.get("rules", ()):
        one = dict(one)
        if one.get("form") not in FORMS:
            raise ValueError(f"rule {one.get('id')}: unknown form {one.get('form')}")
        if one.get("via", "calls") not in VIAS:
            raise ValueError(f"rule {one.get('id')}: unknown via {one.get('via')}")
        if any(r.id == one.get("id") for r in out):
            raise ValueError(f"rule {one.get('id')} is there twice")
        for key in ("subject", "to"):
            if key in one:
                one[key] = component(one[key], named)
        for key in ("only", "owners", "steps"):
            if key in one:
                one[key] = tuple(component(x, named) for x in one[key])
        if "exempt" in one:
            one["exempt"] = tuple(one["exempt"])
        unknown = set(one) - {f.name for f in fields(Rule)}
        if unknown:
            raise ValueError(f"rule {one.get('id')}: unknown keys {sorted(unknown)}")
        out.append(Rule(**one))
    return out


def vocabulary(overlay: dict) -> Vocabulary:
    return replace(Vocabulary(), **overlay)


def policy(spec: dict) -> Policy:
    return Policy(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()})


def load(path: str) -> dict:
    """A declaration from a JSON file on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)

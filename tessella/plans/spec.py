"""Specifications: YAML that is checked as a whole before anything is read."""

from __future__ import annotations

import copy
from collections.abc import Iterator, Mapping
from decimal import Decimal, InvalidOperation
from pathlib import Path

import yaml

from ..errors import DataError, SpecError
from ..functions import predicates
from ..functions.values import NORMALIZERS
from ..operators.identity import POLICIES
from ..operators.keyed import listed
from ..operators.materiality import check_policy
from ..sources.artifacts import lookup, read_mapping
from ..sources.files import FORMATS, resolved
from ..sources.sql import check_config

CHECKS = ("record_coverage", "field_match", "control_total", "row_count", "aggregate_match")
NULLS = ("equal", "empty_is_null", "never_equal")


def load_spec(path: str | Path) -> dict:
    """The specification in a YAML file, validated."""
    try:
        content = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise SpecError(f"{path} can't be read: {e}") from None
    return validate_spec(content)


def _need(ok: object, message: str) -> None:
    if not ok:
        raise SpecError(message)


def _text(x: object) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _number(x: object, at: str, whole: bool = False) -> None:
    try:
        ok = not isinstance(x, bool) and Decimal(str(x)).is_finite() and Decimal(str(x)) >= 0 and (not whole or isinstance(x, int))
    except InvalidOperation:
        ok = False
    _need(ok, f"{at} must be a {'whole ' if whole else ''}number that is not negative")


def _names(x: object, at: str) -> list[str]:
    _need(_text(x) or isinstance(x, list) and x and all(map(_text, x)), f"{at} must be a field or a list of fields")
    return listed(x)


def _chain(x: object, at: str) -> None:
    _need(isinstance(x, list), f"{at} must be a list")
    for o in x:
        _need(o in NORMALIZERS, f"{at}: unknown normalizer {o!r}")


def _endpoint(e: object, at: str, sql: bool = True) -> list[str]:
    """Checks an endpoint; gives its key fields."""
    _need(isinstance(e, Mapping), f"{at} must be a mapping")
    _need(("file" in e) != ("sql" in e), f"{at} needs either file or sql")
    if "sql" in e:
        _need(sql, f"{at} must be a file")
        check_config(e["sql"], f"{at}.sql")
    else:
        _need(_text(e["file"]), f"{at}.file must be text")
    _need(e.get("format", "csv") in FORMATS, f"{at}.format must be one of {', '.join(FORMATS)}")
    _need(isinstance(e.get("delimiter", ","), str) and len(e.get("delimiter", ",")) == 1, f"{at}.delimiter must be one character")
    _chain(e.get("key_normalize", []), f"{at}.key_normalize")
    if e.get("filter") is not None:
        predicates.check(e["filter"], f"{at}.filter")
    _need("key" in e, f"{at}.key is missing")
    return _names(e["key"], f"{at}.key")


def _sides(x: object, at: str) -> None:
    _need(isinstance(x, Mapping) and x and set(x) <= {"source", "target"}, f"{at} must have source or target predicates")
    for side, p in x.items():
        predicates.check(p, f"{at}.{side}")


def check_id(check: Mapping, position: int) -> str:
    """A check's id; unnamed ones are numbered from 1."""
    return check.get("id", f"check-{position}")


def _check(c: object, at: str, scopes: Mapping, artifacts: Mapping) -> None:
    _need(isinstance(c, Mapping), f"{at} must be a mapping")
    kind = c.get("type")
    _need(kind in CHECKS, f"{at}.type must be one of {', '.join(CHECKS)}")
    _need("id" not in c or _text(c["id"]), f"{at}.id must be text")
    _need(c.get("severity", "error") in ("error", "warning"), f"{at}.severity must be error or warning")
    _need("scope" not in c or c["scope"] in scopes, f"{at}.scope {c.get('scope')!r} is not defined")
    if "when" in c:
        _sides(c["when"], f"{at}.when")
    if "materiality" in c:
        check_policy(c["materiality"], f"{at}.materiality")
    if kind in ("field_match", "control_total"):
        _need(_text(c.get("source")) and _text(c.get("target")), f"{at} needs source and target fields")
    if kind == "field_match":
        _chain(c.get("normalize", []), f"{at}.normalize")
        _need(c.get("null_semantics", "equal") in NULLS, f"{at}.null_semantics must be one of {', '.join(NULLS)}")
        for name in ("numeric_tolerance", "percentage_tolerance", "date_tolerance_days"):
            if name in c:
                _number(c[name], f"{at}.{name}")
        _number(c.get("max_mismatches", 0), f"{at}.max_mismatches", whole=True)
        _need(not ("map" in c and "map_ref" in c), f"{at} has both map and map_ref")
        if "map" in c:
            _need(isinstance(c["map"], Mapping) and not any(isinstance(k, bool) for k in c["map"]), f"{at}.map must be a mapping without boolean keys; quote them")
        if "map_ref" in c:
            ref = c["map_ref"]
            _need(isinstance(ref, Mapping) and set(ref) == {"artifact", "field"} and all(map(_text, ref.values())), f"{at}.map_ref needs artifact and field")
            _need(ref["artifact"] in artifacts, f"{at}.map_ref: artifact {ref['artifact']!r} is not defined")
    elif kind == "row_count":
        _number(c.get("tolerance", 0), f"{at}.tolerance", whole=True)
    elif kind in ("control_total", "aggregate_match"):
        _number(c.get("tolerance", 0), f"{at}.tolerance")
    if kind == "aggregate_match":
        operation = c.get("operation", "count")
        _need(operation in ("count", "distinct_count", "sum"), f"{at}.operation must be count, distinct_count or sum")
        by = c.get("group_by")
        _need(isinstance(by, Mapping) and set(by) == {"source", "target"}, f"{at}.group_by needs source and target")
        _need(len(_names(by["source"], f"{at}.group_by.source")) == len(_names(by["target"], f"{at}.group_by.target")), f"{at}.group_by: both sides need as many fields")
        _need(operation == "count" or _text(c.get("source")) and _text(c.get("target")), f"{at}: {operation} needs source and target fields")
        if c.get("percentage_tolerance") is not None:
            _number(c["percentage_tolerance"], f"{at}.percentage_tolerance")


def _checks(checks: object, at: str, scopes: object, artifacts: Mapping) -> None:
    scopes = scopes or {}
    _need(isinstance(scopes, Mapping), f"{at}: scopes must be a mapping")
    for name, s in scopes.items():
        _sides(s, f"scopes.{name}")
    _need(isinstance(checks, list) and checks, f"{at} must be a list that is not empty")
    seen = set()
    for i, c in enumerate(checks, 1):
        _check(c, f"{at}[{i}]", scopes, artifacts)
        _need(check_id(c, i) not in seen, f"{at}[{i}]: id {check_id(c, i)!r} stands twice")
        seen.add(check_id(c, i))


def _child(name: str, child: object, widths: tuple[int, int], artifacts: Mapping) -> None:
    at = f"children.{name}"
    _need(isinstance(child, Mapping), f"{at} must be a mapping")
    n = []
    for side, width in zip(("source", "target"), widths, strict=True):
        e = child.get(side)
        keys = _endpoint(e, f"{at}.{side}", sql=False)
        parents = _names(e.get("parent_key"), f"{at}.{side}.parent_key")
        _chain(e.get("parent_key_normalize", []), f"{at}.{side}.parent_key_normalize")
        _need(len(parents) == width, f"{at}.{side}.parent_key needs as many fields as the root's key")
        _need(set(parents) <= set(keys), f"{at}.{side}.parent_key must be part of the key")
        n.append(len(keys))
    _need(n[0] == n[1], f"{at}: both keys need as many fields")
    _need(child.get("duplicate_policy", "error") in ("error", "warning"), f"{at}.duplicate_policy must be error or warning")
    _checks(child.get("checks"), f"{at}.checks", child.get("scopes"), artifacts)


def validate_spec(spec: object) -> dict:
    """``spec``, or a SpecError that names the first thing wrong with it. Children are checked up front too."""
    _need(isinstance(spec, Mapping), "a specification must be a mapping")
    _need(spec.get("version") == 1 and not isinstance(spec.get("version"), bool), "version must be 1")
    head = spec.get("reconciliation")
    _need(isinstance(head, Mapping) and _text(head.get("name")), "reconciliation.name must be text")
    widths = tuple(len(_endpoint(spec.get(side), side)) for side in ("source", "target"))
    _need(widths[0] == widths[1], "both keys need as many fields")
    artifacts = spec.get("mapping_artifacts") or {}
    _need(isinstance(artifacts, Mapping) and all(isinstance(a, Mapping) and _text(a.get("file")) for a in artifacts.values()), "mapping_artifacts need a file each")
    _checks(spec.get("checks"), "checks", spec.get("scopes"), artifacts)
    if "object" in spec:
        _need(isinstance(spec["object"], Mapping) and _text(spec["object"].get("type", "x")), "object.type must be text")
    if "children" in spec:
        _need(isinstance(spec["children"], Mapping) and spec["children"], "children must be a mapping that is not empty")
        if "identity" in spec:
            widths = (len(listed(spec["source"]["key"])), len(listed(spec["target"]["key"])))
        for name, child in spec["children"].items():
            _child(name, child, widths, artifacts)
    if "identity" in spec:
        _identity(spec)
    if "exceptions" in spec:
        x = spec["exceptions"]
        _need(isinstance(x, Mapping) and _text(x.get("file")) and set(x) <= {"file", "expiry_policy"} and x.get("expiry_policy", "error") in ("error", "warning"), "exceptions need a file; expiry_policy is error or warning")
    if "materiality" in spec:
        m = spec["materiality"]
        _need(isinstance(m, Mapping) and set(m) <= {"default", "fields", "checks"}, "materiality has default, fields and checks")
        if "default" in m:
            check_policy(m["default"], "materiality.default")
        for part in ("fields", "checks"):
            _need(isinstance(m.get(part, {}), Mapping), f"materiality.{part} must be a mapping")
            for name, p in m.get(part, {}).items():
                check_policy(p, f"materiality.{part}.{name}")
    if "evidence" in spec:
        e = spec["evidence"]
        _need(isinstance(e, Mapping), "evidence must be a mapping")
        _number(e.get("detail_limit", 100), "evidence.detail_limit", whole=True)
        _need(isinstance(e.get("sensitive_fields", []), list) and all(map(_text, e.get("sensitive_fields", []))), "evidence.sensitive_fields must be a list of fields")
        _need(e.get("sensitive_value_mode", "mask") in ("mask", "hash", "omit"), "evidence.sensitive_value_mode must be mask, hash or omit")
        _need(e.get("key_mode", "plain") in ("plain", "hash"), "evidence.key_mode must be plain or hash")
    return dict(spec)


def _identity(spec: Mapping) -> None:
    i = spec["identity"]
    _need(isinstance(i, Mapping) and isinstance(i.get("crosswalk"), Mapping), "identity.crosswalk must be a mapping")
    walk = i["crosswalk"]
    _need(_text(walk.get("file")), "identity.crosswalk.file must be text")
    for side in ("source", "target"):
        n = len(_names(walk.get(f"{side}_key"), f"identity.crosswalk.{side}_key"))
        _need(n == len(listed(spec[side]["key"])), f"identity.crosswalk.{side}_key needs as many fields as the {side} key")
        _chain(walk.get(f"{side}_normalize", []), f"identity.crosswalk.{side}_normalize")
        for field, policy in ((i.get("aggregation") or {}).get(side) or {}).items():
            _need(policy in POLICIES, f"identity.aggregation.{side}.{field} must be one of {', '.join(POLICIES)}")


def every_check(spec: Mapping) -> Iterator[tuple[str, dict]]:
    """(id as in evidence, check) of root and child checks."""
    for i, c in enumerate(spec["checks"], 1):
        yield check_id(c, i), c
    for name, child in (spec.get("children") or {}).items():
        for i, c in enumerate(child["checks"], 1):
            yield f"child:{name}:{check_id(c, i)}", c


def with_maps(spec: Mapping, base: str | Path) -> tuple[dict, dict]:
    """``spec`` with every map_ref as an inline map, and the artifacts that were read."""
    out = copy.deepcopy(dict(spec))
    config = out.get("mapping_artifacts") or {}
    read = {name: read_mapping(resolved(a["file"], base), a.get("sha256")) for name, a in config.items()}
    for name, c in every_check(out):
        if "map_ref" in c:
            ref = c.pop("map_ref")
            c["map"] = lookup(read[ref["artifact"]], ref["field"], c["source"], c["target"], name)
    return out, read


def compared_fields(spec: Mapping, side: str) -> set[str]:
    """Fields of a side that root checks compare or group by; those of scopes and conditions do not count."""
    out = set()
    for c in spec["checks"]:
        if _text(c.get(side)):
            out.add(c[side])
        if "group_by" in c:
            out |= set(listed(c["group_by"][side]))
    return out


__all__ = ["DataError", "SpecError", "check_id", "compared_fields", "every_check", "load_spec", "validate_spec", "with_maps"]

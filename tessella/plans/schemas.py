"""JSON Schemas of specifications and evidence, built from the lists that the validator uses."""

from __future__ import annotations

from ..errors import SpecError
from ..functions.predicates import OPERATORS
from ..functions.values import NORMALIZERS
from ..operators.checks import OPERATIONS
from ..operators.identity import POLICIES
from ..sources.files import FORMATS
from .spec import CHECKS, NULLS

DIALECT = "https://json-schema.org/draft/2020-12/schema"
TEXT, TEXTS = {"type": "string", "minLength": 1}, {"oneOf": [{"type": "string", "minLength": 1}, {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 1}}]}
AMOUNT, COUNT = {"type": ["number", "string"]}, {"type": "integer", "minimum": 0}


def _object(required: list[str], closed: bool = False, **properties: dict) -> dict:
    return {"type": "object", "required": required, "properties": properties, "additionalProperties": not closed}


def _map(inner: dict) -> dict:
    return {"type": "object", "additionalProperties": inner}


def _definitions() -> dict:
    ref = lambda n: {"$ref": f"#/$defs/{n}"}
    chain = {"type": "array", "items": {"enum": list(NORMALIZERS)}}
    sides = _object([], closed=True, source=ref("predicate"), target=ref("predicate")) | {"minProperties": 1}
    limits = {k: AMOUNT for k in ("max_failures", "max_failure_percentage", "max_absolute_difference", "max_percentage_difference")}
    endpoint = _object(["key"], file=TEXT, sql=ref("sql"), key=TEXTS, format={"enum": list(FORMATS)}, delimiter={"type": "string", "minLength": 1, "maxLength": 1}, sheet=TEXT, key_normalize=chain, filter=ref("predicate"), parent_key=TEXTS, parent_key_normalize=chain)
    return {
        "predicate": _object([], closed=True, field=TEXT, op={"enum": list(OPERATORS)}, value={}, normalize=chain, all={"type": "array", "minItems": 1, "items": ref("predicate")}, any={"type": "array", "minItems": 1, "items": ref("predicate")}, **{"not": ref("predicate")}) | {"minProperties": 1},
        "sides": sides,
        "sql": _object(["connection", "query"], closed=True, connection=TEXT, query=TEXT, params={"type": "object"}, max_rows={"type": "integer", "minimum": 1}, timeout_seconds={"type": "number", "exclusiveMinimum": 0}, chunk_size={"type": "integer", "minimum": 1}),
        "endpoint": endpoint | {"oneOf": [{"required": ["file"]}, {"required": ["sql"]}]},
        "materiality": _object([], closed=True, severity={"enum": ["error", "warning"]}, critical={"type": "boolean"}, **limits),
        "check": _object(["type"], id=TEXT, type={"enum": list(CHECKS)}, severity={"enum": ["error", "warning"]}, scope=TEXT, when=ref("sides"), source=TEXT, target=TEXT, normalize=chain, map={"type": "object"}, map_ref=_object(["artifact", "field"], closed=True, artifact=TEXT, field=TEXT), numeric_tolerance=AMOUNT, percentage_tolerance=AMOUNT, date_tolerance_days=AMOUNT, tolerance=AMOUNT, null_semantics={"enum": list(NULLS)}, max_mismatches=COUNT, allow_unexpected={"type": "boolean"}, operation={"enum": list(OPERATIONS)}, group_by=_object(["source", "target"], closed=True, source=TEXTS, target=TEXTS), materiality=ref("materiality")),
        "child": _object(["source", "target", "checks"], source=ref("endpoint"), target=ref("endpoint"), checks={"type": "array", "minItems": 1, "items": ref("check")}, scopes=_map(ref("sides")), duplicate_policy={"enum": ["error", "warning"]}),
        "identity": _object(["crosswalk"], crosswalk=_object(["file", "source_key", "target_key"], file=TEXT, source_key=TEXTS, target_key=TEXTS, source_normalize=chain, target_normalize=chain), aggregation=_object([], closed=True, source=_map({"enum": list(POLICIES)}), target=_map({"enum": list(POLICIES)}))),
        "evidence": _object([], detail_limit=COUNT, sensitive_fields={"type": "array", "items": TEXT}, sensitive_value_mode={"enum": ["mask", "hash", "omit"]}, key_mode={"enum": ["plain", "hash"]}),
    }


def _parts() -> dict:
    ref = lambda n: {"$ref": f"#/$defs/{n}"}
    return {"scopes": _map(ref("sides")), "checks": {"type": "array", "minItems": 1, "items": ref("check")}, "identity": ref("identity"), "children": _map(ref("child")), "exceptions": _object(["file"], closed=True, file=TEXT, expiry_policy={"enum": ["error", "warning"]}), "materiality": _object([], closed=True, default=ref("materiality"), fields=_map(ref("materiality")), checks=_map(ref("materiality"))), "evidence": ref("evidence"), "mapping_artifacts": _map(_object(["file"], file=TEXT, sha256=TEXT))}


def schema(kind: str) -> dict:
    """SNK10: the schema of spec, evidence, pipeline, pipeline-evidence or evidence-diff."""
    ref = lambda n: {"$ref": f"#/$defs/{n}"}
    result = _object(["id", "type", "severity", "status", "metrics", "details", "details_truncated"], id=TEXT, type=TEXT, severity={"enum": ["error", "warning"]}, status={"enum": ["passed", "failed"]}, metrics={"type": "object"}, details={"type": "array", "items": {"type": "object"}}, details_truncated={"type": "boolean"})
    state = {"enum": ["passed", "failed"]}
    kinds = {
        "spec": lambda: _object(["version", "reconciliation", "source", "target", "checks"], version={"const": 1}, reconciliation=_object(["name"], name=TEXT, description={"type": "string"}), source=ref("endpoint"), target=ref("endpoint"), object={"type": "object"}, **_parts()) | {"$defs": _definitions()},
        "pipeline": lambda: _object(["version", "pipeline", "stages", "transitions"], version={"const": 1}, pipeline=_object(["name"], name=TEXT), stages={"type": "array", "minItems": 2, "items": _object(["id", "endpoint"], id=TEXT, label=TEXT, endpoint=ref("endpoint"))}, transitions={"type": "array", "minItems": 1, "items": _object(["id", "from", "to", "checks"], id=TEXT, to=TEXT, **{"from": TEXT}, **_parts())}, end_to_end=_object(["checks"], id=TEXT, **_parts()), evidence=ref("evidence"), mapping_artifacts=_parts()["mapping_artifacts"]) | {"$defs": _definitions()},
        "evidence": lambda: _object(["schema_version", "reconciliation", "status", "run", "inputs", "summary", "checks"], schema_version=TEXT, reconciliation=TEXT, status=state, run={"type": "object"}, inputs={"type": "object"}, selection={"type": "object"}, summary={"type": "object"}, checks={"type": "array", "items": result}),
        "pipeline-evidence": lambda: _object(["schema_version", "pipeline", "status", "run", "stages", "transitions", "first_divergence", "summary"], schema_version=TEXT, pipeline=TEXT, status=state, run={"type": "object"}, stages={"type": "array"}, transitions={"type": "array"}, first_divergence={"type": "array"}, summary={"type": "object"}),
        "evidence-diff": lambda: _object(["schema_version", "reconciliation", "baseline", "current", "compatibility", "summary", "check_transitions", "discrepancies"], schema_version=TEXT, reconciliation=TEXT, baseline={"type": "object"}, current={"type": "object"}, compatibility={"type": "object"}, summary={"type": "object"}, check_transitions={"type": "array"}, discrepancies=_object(["new", "resolved", "persistent", "changed"], **{k: {"type": "array"} for k in ("new", "resolved", "persistent", "changed")})),
    }
    if kind not in kinds:
        raise SpecError(f"there is no schema {kind!r}; known are {', '.join(kinds)}")
    return {"$schema": DIALECT, "title": f"tessella {kind}", **kinds[kind]()}


KINDS = ("spec", "evidence", "pipeline", "pipeline-evidence", "evidence-diff")

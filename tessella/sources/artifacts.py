"""YAML artifacts that specifications refer to: accepted exceptions and value mappings."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from pathlib import Path

import yaml

from ..errors import DataError, SpecError
from ..functions.hashing import canonical
from .files import fingerprint


def read_yaml(path: str | Path) -> object:
    try:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise DataError(f"{path} can't be read: {e}") from None


def read_exceptions(path: str | Path) -> list[dict]:
    """SRC13, G4: the entries of an exception artifact, each checked; equal entries are refused."""
    content = read_yaml(path)
    if not isinstance(content, Mapping) or content.get("version") != 1 or not isinstance(content.get("exceptions"), list):
        raise DataError(f"{path}: version 1 and a list of exceptions are needed")
    seen = set()
    for i, e in enumerate(content["exceptions"]):
        at = f"{path}: exceptions[{i}]"
        if not isinstance(e, Mapping):
            raise DataError(f"{at} must be a mapping")
        if extra := set(e) - {"check", "key", "group", "field", "reason_code", "reason", "owner", "reference", "expires"}:
            raise DataError(f"{at}: unknown {', '.join(sorted(extra))}")
        for name in ("check", "reason_code", "reason"):
            if not isinstance(e.get(name), str) or not e[name].strip():
                raise DataError(f"{at}.{name} must be text")
        if ("key" in e) == ("group" in e):
            raise DataError(f"{at} needs either key or group")
        if e.get("expires") is not None:
            try:
                date.fromisoformat(str(e["expires"]))
            except ValueError:
                raise DataError(f"{at}.expires must be an ISO date") from None
        ref = e.get("key", e.get("group"))
        print_ = canonical([e["check"], "key" in e, [str(x) for x in (ref if isinstance(ref, list) else [ref])], e.get("field")])
        if print_ in seen:
            raise DataError(f"{at} repeats an entry")
        seen.add(print_)
    return [dict(e) for e in content["exceptions"]]


def read_mapping(path: str | Path, pinned: str | None = None) -> dict:
    """SRC14: a mapping artifact of schema version 0.1; its bytes must have the pinned SHA-256."""
    if pinned is not None and fingerprint(str(path)) != str(pinned).lower():
        raise DataError(f"{path} does not have the SHA-256 that the specification pins")
    content = read_yaml(path)
    if not isinstance(content, Mapping) or str(content.get("schema_version")) != "0.1":
        raise DataError(f"{path}: schema_version must be 0.1")
    fields = (content.get("mapping") or {}).get("fields")
    if not isinstance(fields, list) or not isinstance(content.get("value_maps", {}), Mapping):
        raise DataError(f"{path}: mapping.fields and value_maps are needed")
    return dict(content)


def lookup(artifact: Mapping, field_id: str, source: str, target: str, at: str) -> dict[str, str]:
    """The value map of a mapping's field; it must be a lookup between exactly these fields."""
    found = [f for f in artifact["mapping"]["fields"] if isinstance(f, Mapping) and f.get("id") == field_id]
    if len(found) != 1:
        raise SpecError(f"{at}: the artifact has no field {field_id!r}")
    f = found[0]
    for side, name in (("source", source), ("target", target)):
        if (f.get(side) or {}).get("field") != name:
            raise SpecError(f"{at}: field {field_id!r} maps another {side} field than {name!r}")
    transform = f.get("transform") or {}
    table = (artifact.get("value_maps") or {}).get(transform.get("reference"))
    if transform.get("type") != "lookup" or not isinstance(table, Mapping):
        raise SpecError(f"{at}: field {field_id!r} is no lookup with a value map")
    return {str(k): str(v) for k, v in table.items()}

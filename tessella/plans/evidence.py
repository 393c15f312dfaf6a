"""What becomes of evidence: hiding what is sensitive, comparing two runs."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping
from pathlib import Path

from ..errors import DataError
from ..functions.hashing import digest, masked
from .spec import every_check

REQUIRED = ("schema_version", "reconciliation", "run", "summary", "checks")


def _masked_predicate(p: object, fields: set[str], mode: str) -> object:
    """A predicate with the literals of sensitive fields hidden."""
    if isinstance(p, list):
        return [_masked_predicate(x, fields, mode) for x in p]
    if not isinstance(p, Mapping):
        return p
    out = {k: _masked_predicate(v, fields, mode) if k in ("all", "any", "not") else v for k, v in p.items()}
    if out.get("field") in fields and "value" in out:
        out["value"] = [masked(v, mode) for v in out["value"]] if isinstance(out["value"], list) else masked(out["value"], mode)
    return out


def prepared(evidence: Mapping, spec: Mapping) -> dict:
    """V1: a copy that may be shown: sensitive values, totals, differences and filter literals hidden; keys, parents, groups and paths hashed if asked."""
    out, config = copy.deepcopy(dict(evidence)), spec.get("evidence") or {}
    fields, mode, keys = set(config.get("sensitive_fields", [])), config.get("sensitive_value_mode", "mask"), config.get("key_mode", "plain")
    out["privacy"] = {"sensitive_fields": sorted(fields), "sensitive_value_mode": mode, "key_mode": keys}
    for side in (out.get("selection") or {}).values():
        side["filter"] = _masked_predicate(side["filter"], fields, mode)
    specs = dict(every_check(spec))
    key = (lambda x: masked(x, "hash")) if keys == "hash" else (lambda x: x)

    def identity(info: Mapping) -> dict:
        return {**info, "source_keys": [key(k) for k in info["source_keys"]], "target_keys": [key(k) for k in info["target_keys"]]}

    for c in out["checks"]:
        s = specs.get(c["id"], {})
        hidden = {side for side in ("source", "target") if s.get(side) in fields}
        grouped = set().union(*([g] if isinstance(g, str) else g for g in (s.get("group_by") or {}).values())) & fields
        for d in (c["metrics"], *c["details"]):
            for side in hidden:
                for name in (f"{side}_total", f"{side}_value", side, f"normalized_{side}"):
                    if name in d and (d is not c["metrics"] or name.endswith("total")):
                        d[name] = masked(d[name], mode)
            if hidden:
                for name in ("absolute_difference", "percentage_difference"):
                    if name in d:
                        d[name] = masked(d[name], mode)
                if d is not c["metrics"]:
                    d["sensitive_values_redacted"] = True
            for name in ("key", "parent_key", "object_path"):
                if name in d:
                    d[name] = key(d[name])
            if "group" in d:
                d["group"] = masked(d["group"], mode) if grouped else key(d["group"])
            if isinstance(d.get("identity"), Mapping):
                d["identity"] = identity(d["identity"])
    for o in (out.get("hierarchy") or {}).get("failed_objects", []):
        o["key"], o["paths"] = key(o["key"]), [key(p) for p in o["paths"]]
    if "identity" in out:
        out["identity"]["components"] = [identity(c) for c in out["identity"]["components"]]
    if keys == "hash" and "exception_governance" in out:
        for part in ("used", "unused", "expired"):
            for e in out["exception_governance"][part]:
                e |= {k: key(e[k]) for k in ("key", "group") if k in e}
    return out


def located(detail: Mapping) -> dict:
    """What names a detail: its path, key, group and kind; of policy details, the entry."""
    found = {k: detail[k] for k in ("object_path", "key", "group", "difference") if k in detail}
    return found or {k: detail[k] for k in ("check", "field", "reason_code", "status") if k in detail}


def defects(evidence: Mapping) -> dict[str, dict]:
    """The details of a run by identity. One that repeats gets a number, so that none is lost."""
    out: dict[str, dict] = {}
    for c in evidence["checks"]:
        for d in c.get("details") or []:
            where = located(d)
            content = {k: v for k, v in d.items() if k != "sensitive_values_redacted"}
            name, n = digest({"check_id": c["id"], "locator": where, "type": c["type"]}), 1
            same = name
            while name in out:
                n += 1
                name = digest({"identity": same, "occurrence": n})
            out[name] = {"identity": name, "check_id": c["id"], "check_type": c["type"], "severity": c.get("severity"), "check_status": c.get("status"), "locator": where, "detail": content, "content_sha256": digest(content), "disposition": d.get("disposition")}
    return out


def read_evidence(path: str | Path) -> dict:
    try:
        content = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise DataError(f"{path} can't be read: {e}") from None
    if not isinstance(content, dict):
        raise DataError(f"{path} is no evidence")
    return content


def comparable(baseline: Mapping, current: Mapping) -> None:
    """Both must be evidence of schema version 1 of one reconciliation."""
    for name, e in (("baseline", baseline), ("current", current)):
        if missing := [k for k in REQUIRED if k not in e]:
            raise DataError(f"the {name} evidence has no {', '.join(missing)}")
        if str(e["schema_version"]).split(".")[0] != "1":
            raise DataError(f"the {name} evidence has schema version {e['schema_version']}; 1 is supported")
        if not isinstance(e["checks"], list):
            raise DataError(f"the {name} evidence has no list of checks")
    if baseline["reconciliation"] != current["reconciliation"]:
        raise DataError(f"{baseline['reconciliation']!r} and {current['reconciliation']!r} are different reconciliations")


def transition(before: Mapping | None, after: Mapping | None) -> str:
    """How a check's state changed between two runs."""
    if before is None or after is None:
        return "added" if before is None else "removed"
    a, b = before.get("status"), after.get("status")
    if (a, b) in (("passed", "failed"), ("failed", "passed")):
        return "regressed" if b == "failed" else "improved"
    return "unchanged" if a == b and before.get("severity") == after.get("severity") else "changed"


def compared_runs(baseline: Mapping, current: Mapping, names: tuple[str, str] = ("baseline.json", "current.json")) -> dict:
    """The difference of two bounded evidence documents. ``operators.diff`` does the same for whole difference sets."""
    comparable(baseline, current)
    before, after = ({c["id"]: c for c in e["checks"]} for e in (baseline, current))
    changes = []
    for i in sorted({*before, *after}):
        a, b = before.get(i), after.get(i)
        ma, mb = (a or {}).get("metrics") or {}, (b or {}).get("metrics") or {}
        changes.append({"id": i, "type": (b or a)["type"], "baseline_status": a and a.get("status"), "current_status": b and b.get("status"), "baseline_severity": a and a.get("severity"), "current_severity": b and b.get("severity"), "transition": transition(a, b), "metric_changes": {k: {"baseline": ma.get(k), "current": mb.get(k)} for k in sorted({*ma, *mb}) if ma.get(k) != mb.get(k)}})
    x, y = defects(baseline), defects(current)
    found: dict[str, list] = {"new": [y[k] for k in sorted(y.keys() - x.keys())], "resolved": [x[k] for k in sorted(x.keys() - y.keys())], "persistent": [], "changed": []}
    for k in sorted(x.keys() & y.keys()):
        if (x[k]["content_sha256"], x[k]["check_status"]) == (y[k]["content_sha256"], y[k]["check_status"]):
            found["persistent"].append(y[k])
        else:
            found["changed"].append({"identity": k, "check_id": y[k]["check_id"], "check_type": y[k]["check_type"], "locator": y[k]["locator"], "baseline": x[k], "current": y[k]})
    count = lambda t: sum(c["transition"] == t for c in changes)
    cut = [c["id"] for e in (baseline, current) for c in e["checks"] if c.get("details_truncated")]

    def ref(e: Mapping, name: str) -> dict:
        return {"path": Path(name).name, "run_id": e["run"].get("id"), "generated_at": e.get("generated_at"), "status": e.get("status"), "schema_version": e["schema_version"], "spec_version": e.get("spec_version"), "engine_version": e.get("engine_version"), "configuration_sha256": e.get("configuration_sha256"), "summary": e["summary"], "evidence_sha256": digest(e)}

    differs = lambda k: baseline.get(k) != current.get(k)
    return {
        "schema_version": "1.0",
        "reconciliation": current["reconciliation"],
        "baseline": ref(baseline, names[0]),
        "current": ref(current, names[1]),
        "compatibility": {"evidence_schema_changed": differs("schema_version"), "spec_version_changed": differs("spec_version"), "engine_version_changed": differs("engine_version"), "configuration_changed": differs("configuration_sha256")},
        "summary": {"baseline_status": baseline.get("status"), "current_status": current.get("status"), "baseline_checks_failed": baseline["summary"].get("checks_failed"), "current_checks_failed": current["summary"].get("checks_failed"), **{f"{k}_discrepancies": len(v) for k, v in found.items()}, "checks_regressed": count("regressed"), "checks_improved": count("improved"), "regression": bool(found["new"] or count("regressed")), "improvement": bool(found["resolved"] or count("improved"))},
        "check_transitions": changes,
        "discrepancies": found,
        "warnings": [f"details of {i} are cut off; the comparison covers what is kept" for i in sorted(set(cut))],
    }

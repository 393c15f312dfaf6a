"""Chains of stages: adjacent reconciliations, an optional one from end to end, and where things first go wrong."""

from __future__ import annotations

import copy
import time
import uuid
from collections.abc import Mapping
from datetime import UTC, date, datetime
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..errors import SpecError
from ..functions.hashing import digest
from ..operators.stages import first_divergence
from .evidence import located, prepared
from .run import input_of, read_endpoint, reconcile
from .spec import validate_spec

SHARED = ("scopes", "exceptions", "materiality", "children", "identity")


def load_chain(path: str | Path) -> dict:
    try:
        content = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise SpecError(f"{path} can't be read: {e}") from None
    return validate_chain(content)


def edge_spec(spec: Mapping, edge: Mapping, source: Mapping, target: Mapping) -> dict:
    """One transition as a specification of its own."""
    out = {"version": 1, "reconciliation": {"name": f"{spec['pipeline']['name']}: {edge['id']}"}, "source": dict(source), "target": dict(target), "checks": edge.get("checks")}
    for part in SHARED:
        if part in edge:
            out[part] = edge[part]
    for part in ("evidence", "mapping_artifacts"):
        if part in edge or part in spec:
            out[part] = edge.get(part, spec.get(part))
    return copy.deepcopy(out)


def validate_chain(spec: object) -> dict:
    """``spec``, or a SpecError; every transition is checked as the specification it becomes."""
    if not isinstance(spec, Mapping) or spec.get("version") != 1:
        raise SpecError("version must be 1")
    if not isinstance(spec.get("pipeline"), Mapping) or not spec["pipeline"].get("name"):
        raise SpecError("pipeline.name must be text")
    stages, edges = spec.get("stages"), spec.get("transitions")
    if not isinstance(stages, list) or len(stages) < 2 or any(not isinstance(s, Mapping) or not s.get("id") or not isinstance(s.get("endpoint"), Mapping) for s in stages):
        raise SpecError("stages must list two or more, each with id and endpoint")
    ids = [s["id"] for s in stages]
    if len(set(ids)) < len(ids):
        raise SpecError("stage ids must differ")
    if not isinstance(edges, list) or any(not isinstance(e, Mapping) or not e.get("id") for e in edges):
        raise SpecError("transitions must list mappings with an id")
    if len({e["id"] for e in edges}) < len(edges):
        raise SpecError("transition ids must differ")
    wanted = list(zip(ids, ids[1:], strict=False))
    got = [(e.get("from"), e.get("to")) for e in edges]
    if sorted(map(str, got)) != sorted(map(str, wanted)):
        raise SpecError("each adjacent pair of stages needs one transition, and there are no others")
    at = {s["id"]: s["endpoint"] for s in stages}
    for e in edges:
        validate_spec(edge_spec(spec, e, at[e["from"]], at[e["to"]]))
    if spec.get("end_to_end") is not None:
        validate_spec(edge_spec(spec, {"id": "end-to-end", **spec["end_to_end"]}, at[ids[0]], at[ids[-1]]))
    return dict(spec)


def selected(ids: list[str], first: str | None, last: str | None) -> list[str]:
    """L2: the stages from ``first`` to ``last``; two at least."""
    for s in (first, last):
        if s is not None and s not in ids:
            raise SpecError(f"there is no stage {s!r}")
    a, b = ids.index(first) if first else 0, ids.index(last) if last else len(ids) - 1
    if b <= a:
        raise SpecError("the last stage must come after the first")
    return ids[a : b + 1]


def reference(check: str, detail: Mapping) -> tuple | None:
    """check_id, ref_kind and ref of a detail as differences have them; None of one that names neither a key nor a group."""
    kind = next((k for k in ("key", "group") if k in detail), None)
    return kind and (check, kind, tuple(detail[kind]) if isinstance(detail[kind], list) else (detail[kind],))


def first_steps(spark: SparkSession, every: list[tuple[str, list[DataFrame]]], raw: Mapping[str, Mapping]) -> tuple[dict, dict]:
    """The first transition, by number, of each difference that evidence shows, and how many differences have which as
    their first: over all differences, whatever evidence shows of them.
    """
    numbers = {i: k for k, (i, _) in enumerate(every)}
    edges = [(i, reduce(DataFrame.unionByName, frames)) for i, frames in every if frames]
    if not edges:
        return {}, {}
    firsts = first_divergence(edges, ["check_id", "ref_kind", "ref"])
    totals = {numbers[r["first_transition"]]: r["count"] for r in firsts.groupBy("first_transition").count().collect()}
    shown = {reference(c["id"], d) for e in raw.values() for c in e["checks"] for d in c["details"]} - {None}
    if not shown:
        return {}, totals
    asked = spark.createDataFrame([(c, k, list(r)) for c, k, r in shown], "check_id string, ref_kind string, ref array<string>")
    rows = firsts.join(asked, ["check_id", "ref_kind", "ref"], "left_semi").collect()
    return {(r["check_id"], r["ref_kind"], tuple(r["ref"])): numbers[r["first_transition"]] for r in rows}, totals


def run_chain(spark: SparkSession, spec: Mapping, base: str | Path = ".", spec_path: str | Path | None = None, first: str | None = None, last: str | None = None, today: date | None = None, frames: Mapping[str, DataFrame] | None = None) -> dict:
    """L1: the evidence of a chain. Each selected stage is read once and kept for the transitions on both sides of it."""
    started, clock = datetime.now(UTC), time.perf_counter()
    validate_chain(spec)
    ids = [s["id"] for s in spec["stages"]]
    chosen = selected(ids, first, last)
    stages = {s["id"]: s for s in spec["stages"]}
    data = {i: ((frames or {})[i] if i in (frames or {}) else read_endpoint(spark, stages[i]["endpoint"], base)).persist() for i in chosen}
    try:

        every: list[tuple[str, list[DataFrame]]] = []  # all differences of each transition
        raw: dict[str, dict] = {}

        def one(edge: Mapping, a: str, b: str) -> dict:
            inner = edge_spec(spec, edge, stages[a]["endpoint"], stages[b]["endpoint"])
            every.append((edge["id"], []))
            raw[edge["id"]] = reconcile(spark, inner, base, spec_path, today, {"source": data[a], "target": data[b]}, every[-1][1])
            return {"id": edge["id"], "from": a, "to": b, **prepared(raw[edge["id"]], inner)}

        by_pair = {(e["from"], e["to"]): e for e in spec["transitions"]}
        edges = [one(by_pair[p], *p) for p in zip(chosen, chosen[1:], strict=False)]
        steps, totals = first_steps(spark, every, raw)
        whole = None
        if len(chosen) == len(ids) and spec.get("end_to_end") is not None:
            whole = one({"id": "end-to-end", **spec["end_to_end"]}, ids[0], ids[-1])
    finally:
        for frame in data.values():
            frame.unpersist()
    seen: dict[str, dict] = {}
    for step, e in enumerate(edges):
        for c in e["checks"]:
            if c["status"] != "failed":
                continue
            plain = next(x for x in raw[e["id"]]["checks"] if x["id"] == c["id"])["details"]
            for k, d in enumerate(c["details"] or [{}]):
                if d.get("disposition") == "accepted-exception":
                    continue
                where = located(d)
                first_step = steps.get(reference(c["id"], plain[k])) if k < len(plain) else None
                step_, at = (step, e) if first_step is None else (first_step, edges[first_step])
                business = digest({"field": None if where else c["id"], **{k: v for k, v in where.items() if k != "difference"}, "check": c["id"]})
                seen.setdefault(business, {"identity": business, "first_transition": at["id"], "transition_index": step_, "check_id": c["id"], "check_type": c["type"], "locator": where, "from_stage": at["from"], "to_stage": at["to"]})
    failed = [e for e in edges if e["status"] == "failed"]
    shown = [{"id": i, "label": stages[i].get("label"), "input": input_of(stages[i]["endpoint"], base) if i not in (frames or {}) else None, "status": "baseline" if k == 0 else edges[k - 1]["status"], "incoming_transition": None if k == 0 else edges[k - 1]["id"]} for k, i in enumerate(chosen)]
    out = {
        "schema_version": "1.0",
        "spec_version": 1,
        "pipeline": spec["pipeline"]["name"],
        "description": spec["pipeline"].get("description"),
        "status": "failed" if failed or whole and whole["status"] == "failed" else "passed",
        "configuration_sha256": digest(spec),
        "run": {"id": str(uuid.uuid4()), "started_at": started.isoformat(), "finished_at": datetime.now(UTC).isoformat(), "duration_ms": round((time.perf_counter() - clock) * 1000, 3), "backend": "spark", "from_stage": chosen[0], "to_stage": chosen[-1]},
        "stages": shown,
        "transitions": edges,
        "first_divergence": list(seen.values()),
        "summary": {"stages_total": len(chosen), "transitions_total": len(edges), "transitions_failed": len(failed), "transitions_passed": len(edges) - len(failed), "first_divergences": len(seen), "first_divergences_by_transition": {e["id"]: totals.get(k, 0) for k, e in enumerate(edges)}, "end_to_end_executed": whole is not None, "end_to_end_status": whole and whole["status"]},
    }
    return out | ({"end_to_end": whole} if whole else {})

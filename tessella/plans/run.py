"""A whole run: inputs, identity, root and child checks, exceptions, materiality, evidence."""

from __future__ import annotations

import platform
import time
import uuid
from collections.abc import Mapping
from datetime import UTC, date, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..errors import DataError
from ..functions.hashing import digest
from ..functions.predicates import columns_of, compiled
from ..functions.values import DEFAULT, key_part
from ..operators import governance, hierarchy, identity, materiality
from ..operators.checks import MISSING
from ..operators.keyed import Keyed, keyed, listed
from ..sources.artifacts import read_exceptions
from ..sources.files import fingerprint, read_file, resolved
from ..sources.sql import provenance, read_sql
from .spec import compared_fields, every_check, validate_spec, with_maps
from .flat import Result, flat, label

SCHEMA_VERSION = "1.0"
#: Checks whose single differences can be accepted.
EXCEPTABLE = ("record_coverage", "field_match", "aggregate_match")
IDENTITY, PARENT = "__identity", "__parent_identity"


def read_endpoint(spark: SparkSession, endpoint: Mapping, base: str | Path) -> DataFrame:
    """The frame of an endpoint; a SQL query runs once, whatever reads the frame."""
    return read_sql(spark, endpoint["sql"]).persist() if "sql" in endpoint else read_file(spark, endpoint, base)


def input_of(endpoint: Mapping, base: str | Path) -> dict:
    if "sql" in endpoint:
        return provenance(endpoint["sql"])
    return {"path": endpoint["file"], "sha256": fingerprint(resolved(endpoint["file"], base))}


class _Run:
    def __init__(self, spark: SparkSession, spec: Mapping, base: str | Path, today: date, frames: Mapping[str, DataFrame] | None) -> None:
        self.spark, self.base, self.today, self.given = spark, base, today, frames or {}
        self.original = spec
        self.spec, self.artifacts = with_maps(spec, base)
        self.limit = int((spec.get("evidence") or {}).get("detail_limit", 100))
        self.results: list[Result] = []
        self.summary: dict = {}
        self.inputs: dict = {}
        self.extra: dict = {}
        self.components: DataFrame | None = None
        self.root_name = (spec.get("object") or {}).get("type") or spec["reconciliation"]["name"].replace(" ", "_")

    def frame(self, name: str, endpoint: Mapping) -> DataFrame:
        self.inputs[name] = input_of(endpoint, self.base) if name not in self.given else {"path": None, "sha256": None}
        return self.given[name] if name in self.given else read_endpoint(self.spark, endpoint, self.base)

    def root(self) -> None:
        spec, raw, sides = self.spec, {}, {}
        for n in ("source", "target"):
            e, frame = spec[n], self.frame(n, spec[n])
            raw[n] = keyed(frame, e["key"], e.get("key_normalize"), n)
            # The filter stands below the keys, where it can reach the scan.
            kept = frame.where(compiled(e["filter"], columns_of(frame, n))) if e.get("filter") else frame
            sides[n] = keyed(kept, e["key"], e.get("key_normalize"), n)
        # Without a filter the checks' own count is that of all rows; with one, both are counted in one pass.
        counted = {n: self.rows_of(raw[n], spec[n].get("filter")) for n in raw if spec[n].get("filter") or "identity" in spec}
        self.own_roots = raw
        if "identity" in spec:
            sides = self.identified(sides)
        results, counts = flat(sides["source"], sides["target"], spec["checks"], spec.get("scopes"), self.limit)
        self.results += results
        self.summary |= counts
        every = {n: (counts[f"{n}_records"],) * 2 for n in raw} | counted
        self.extra["selection"] = {n: {"raw_records": every[n][0], "selected_records": every[n][1], "filter": spec[n].get("filter")} for n in raw}

    @staticmethod
    def rows_of(side: Keyed, predicate: Mapping | None) -> tuple[int, int]:
        """All rows, and those that a filter selects."""
        kept = compiled(predicate, side.column) if predicate else F.lit(True)
        return tuple(side.rows.agg(F.count(F.lit(1)), F.count_if(kept)).first())

    def identified(self, sides: Mapping[str, Keyed]) -> dict[str, Keyed]:
        """Both sides as one row a component of the crosswalk, keyed by the component's name."""
        walk = self.spec["identity"]["crosswalk"]
        cross = self.frame("identity_crosswalk", walk)
        links = identity.verified(identity.edges(cross, walk["source_key"], walk["target_key"], walk.get("source_normalize", DEFAULT), walk.get("target_normalize", DEFAULT))).persist()
        self.components = identity.components(links).persist()
        policies = self.spec["identity"].get("aggregation") or {}
        out, self.loose, self.unused, rows_in = {}, [], {}, {}
        for n, s in sides.items():
            member = identity.members(self.components, n)
            rows = identity.attached(s.rows, F.array(*s.keys), member, n).drop(*s.keys)
            loose = rows.where("unmapped").select("component", F.col("__key").alias("key")).distinct()
            self.loose.append((f"unmapped_{n}_identity", None, loose))
            self.unused[n] = identity.unused(member, s)
            merged = identity.without_conflicts(identity.merge(rows, listed(self.spec[n]["key"]), policies.get(n) or {}, compared_fields(self.spec, n)))
            frame = merged.drop("__members", "__ord").withColumnRenamed("component", IDENTITY)
            out[n] = keyed(frame, IDENTITY, DEFAULT, n).cached()
            rows_in[n] = s.rows.count()
        self.own_roots = out
        self.summary |= {"source_raw_records": rows_in["source"], "target_raw_records": rows_in["target"]}
        return out

    def child_sides(self, name: str, child: Mapping) -> dict[str, tuple[Keyed, list[str], list[str] | None, tuple[str, ...]]]:
        """Per side: all child rows, parent fields, their normalizers, key fields."""
        out = {}
        for n in ("source", "target"):
            e = child[n]
            frame, key, parents = self.frame(f"child:{name}:{n}", e), listed(e["key"]), listed(e["parent_key"])
            chain = e.get("parent_key_normalize", e.get("key_normalize"))
            if self.components is not None:
                rows = keyed(frame, key, e.get("key_normalize"), n)
                parent = F.array(*[key_part(rows.column(p), chain) for p in parents])
                found = identity.attached(rows.rows, parent, identity.members(self.components, n), n)
                loose = found.where("unmapped").select("component", F.col("__key").alias("key"))
                self.loose.append((f"unmapped_{n}_child_parent", name, loose))
                local = [k for k in key if k not in parents]
                parts = {f"__k{i + 1}": F.col(f"__k{key.index(k)}") for i, k in enumerate(local)}
                keys = [F.col("component").alias("__k0"), *[c.alias(k) for k, c in parts.items()]]
                other = [c for c in found.columns if not c.startswith("__k") and c not in ("component", "unmapped", "__key")]
                side = Keyed(found.select(*[F.col(f"`{c}`") for c in other], F.col("component").alias(PARENT), *keys), 1 + len(local), n)
                out[n] = (side, [PARENT], ["trim"], (PARENT, *local))
            else:
                out[n] = (keyed(frame, key, e.get("key_normalize"), n), parents, chain, tuple(key))
        return out

    def children(self) -> None:
        collections = {}
        for name, child in (self.spec.get("children") or {}).items():
            sides = self.child_sides(name, child)
            s, t = (sides[n][0].where(child[n].get("filter")) for n in ("source", "target"))
            results, counts = flat(s, t, child["checks"], child.get("scopes"), self.limit)
            policy = child.get("duplicate_policy", "error")
            at = [sides["source"][3].index(p) for p in sides["source"][1]]
            for r in results:
                r.id = f"child:{name}:{r.id}"
                r.metrics["collection"] = name
                if r.type == "key_integrity":
                    r.severity = policy
                for d in r.details:
                    d["collection"] = name
                    if "key" in d:
                        key = d["key"] if isinstance(d["key"], list) else [d["key"]]
                        d["parent_key"] = label([key[i] for i in at])
                        d["object_path"] = "/".join([self.root_name, *[key[i] for i in at], name, *key])
                r.parent_at = at
            results += [self.orphans(name, n, *sides[n]) for n in ("source", "target")]
            self.results += results
            failed = any(r.severity == "error" and not r.passed for r in results)
            collections[name] = {"status": "failed" if failed else "passed", **counts, "duplicate_policy": policy}
        if collections:
            self.extra["hierarchy"] = {"object_type": self.root_name, "collections": collections}

    def orphans(self, name: str, side: str, child: Keyed, parents: list[str], chain: list[str] | None, key: tuple[str, ...]) -> Result:
        found = hierarchy.orphans(child, parents, self.own_roots[side], chain)
        width = self.own_roots[side].width
        n = found.count()
        out = Result(f"child:{name}:{side}-parent-integrity", "parent_integrity", "error", not n, {"orphan_rows": n, "side": side, "collection": name}, failures=n)
        rows = found.orderBy(*child.keys).limit(self.limit).collect() if n else []
        for r in rows:
            own, parent = [r[k] for k in child.keys], [r[f"p{i}"] for i in range(width)]
            out.details.append({"key": label(own), "parent_key": label(parent), "difference": f"orphan_{side}_child", "collection": name, "object_path": "/".join([self.root_name, *parent, name, *own])})
        out.truncated = n > self.limit
        if n:
            out.parent = [f"p{i}" for i in range(width)]
            out.orphan_rows = found.select(F.array(*out.parent).alias("object"), F.array(*child.keys).alias("ref"))
        return out

    def identity_check(self) -> None:
        modes = {r["mode"]: r["n"] for r in self.components.groupBy("mode").agg(F.count(F.lit(1)).alias("n")).collect()}
        counted = [(kind, name, frame.count(), frame) for kind, name, frame in self.loose]
        per = lambda kind: sum(n for k, _, n, _ in counted if k == kind)
        child = sum(n for _, name, n, _ in counted if name)
        unused = {n: f.count() for n, f in self.unused.items()}
        metrics = {"components": sum(modes.values()), "one_to_one": modes.get(identity.ONE_TO_ONE, 0), "one_to_many": modes.get(identity.ONE_TO_MANY, 0), "many_to_one": modes.get(identity.MANY_TO_ONE, 0), "unmapped_source": per("unmapped_source_identity"), "unmapped_target": per("unmapped_target_identity"), "unmapped_child_parents": child, "unused_crosswalk_source": unused["source"], "unused_crosswalk_target": unused["target"]}
        failures = sum(n for _, _, n, _ in counted)
        out = Result("identity-crosswalk-integrity", "identity_integrity", "error", not failures, metrics, failures=failures)
        for kind, name, n, frame in counted:
            for r in frame.orderBy("key").limit(max(0, self.limit - len(out.details))).collect() if n else []:
                out.details.append({"difference": kind, "key": label(r["key"]), "identity": r["component"]} | ({"collection": name} if name else {}))
        for n, frame in self.unused.items():
            for r in frame.orderBy("key").limit(max(0, self.limit - len(out.details))).collect() if unused[n] else []:
                out.details.append({"difference": f"unused_crosswalk_{n}", "key": label(r["key"]), "severity": "warning"})
        out.truncated = failures + sum(unused.values()) > len(out.details)
        self.results.append(out)
        names = {d["key"][0] if isinstance(d.get("key"), list) else d.get("key") for r in self.results for d in r.details}
        shown = {r["component"]: self.component(r) for r in self.components.where(F.col("component").isin([x for x in names if x])).collect()} if names else {}
        for r in self.results:
            for d in r.details:
                k = d.get("key")
                if (found := shown.get(k[0] if isinstance(k, list) else k)) is not None:
                    d["identity"] = found
        self.summary |= {"identity_components": metrics["components"], "identity_unmapped_source": metrics["unmapped_source"], "identity_unmapped_target": metrics["unmapped_target"]}
        rows = self.components.orderBy("component").limit(self.limit).collect()
        self.extra["identity"] = {"crosswalk": self.inputs["identity_crosswalk"], "components": [self.component(r) for r in rows], "components_truncated": metrics["components"] > len(rows), "aggregation": self.spec["identity"].get("aggregation", {})}

    @staticmethod
    def component(r) -> dict:
        return {"id": r["component"], "mode": r["mode"], "source_keys": [label(k) for k in r["source_keys"]], "target_keys": [label(k) for k in r["target_keys"]]}

    def exceptions(self) -> None:
        path = resolved(self.spec["exceptions"]["file"], self.base)
        entries, severity = read_exceptions(path), self.spec["exceptions"].get("expiry_policy", "error")
        self.inputs["exceptions"] = {"path": Path(path).name, "sha256": fingerprint(path)}
        frame = governance.entries_frame(self.spark, entries)
        able = [r for r in self.results if r.type in EXCEPTABLE and r.failures and r.differences is not None]
        parts = [r.differences.select(F.lit(r.id).alias("check_id"), "ref_kind", "ref", "kind", F.lit(r.spec.get("source")).cast("string").alias("source_field"), F.lit(r.spec.get("target")).cast("string").alias("target_field"), "absolute_difference", "percentage_difference") for r in able]
        status = {}
        if parts:
            found = governance.matched(reduce(DataFrame.unionByName, parts), frame, self.today).persist()
            if clash := governance.ambiguous(found).limit(1).collect():
                raise DataError(f"several exceptions match {clash[0]['check_id']} {'|'.join(clash[0]['ref'])}")
            net = {r["check_id"]: r for r in governance.net(found).collect()}
            shown = self.spark.createDataFrame([(r.id, *self.ref(d)) for r in able for d in r.details], "check_id string, ref_kind string, ref array<string>, kind string")
            taken = {(r["check_id"], r["ref_kind"], tuple(r["ref"]), r["kind"]): r["entry"] for r in found.where("entry is not null").join(shown, ["check_id", "ref_kind", "ref", "kind"]).select("check_id", "ref_kind", "ref", "kind", "entry").collect()}
            for r in able:
                n = net[r.id]
                r.metrics |= {k: n[k] for k in ("gross_failures", "accepted_exceptions", "unaccepted_failures")}
                r.failures = n["unaccepted_failures"]
                r.passed = r.failures <= r.metrics.get("max_mismatches", 0) if r.type == "field_match" else not r.failures
                r.differences = found.where((F.col("check_id") == r.id) & F.col("entry").isNull()).select("ref_kind", "ref", "kind", "absolute_difference", "percentage_difference")
                rest = r.differences.agg(F.max("absolute_difference").alias("a"), F.max("percentage_difference").alias("p")).first()
                r.largest, r.largest_percentage = rest["a"], rest["p"]
                for d in r.details:
                    kind, ref, what = self.ref(d)
                    entry = taken.get((r.id, kind, tuple(ref), what))
                    if what == "unexpected_in_target" and r.metrics.get("allow_unexpected"):
                        continue
                    d["disposition"] = "unaccepted" if entry is None else "accepted-exception"
                    if entry is not None:
                        d["exception"] = self.entry(entries[entry], "used")
            status = {r["entry"]: r["status"] for r in governance.standing(frame, found, self.today).select("entry", "status").collect()}
            found.unpersist()
        else:
            none = frame.select("check_id", "ref_kind", "ref", F.lit(None).cast("int").alias("entry")).limit(0)
            status = {r["entry"]: r["status"] for r in governance.standing(frame, none, self.today).select("entry", "status").collect()}
        by = {s: [self.entry(e, s) for i, e in enumerate(entries) if status.get(i) == s] for s in ("used", "unused", "expired")}
        metrics = {"entries_total": len(entries), **{f"entries_{s}": len(x) for s, x in by.items()}, "expiry_policy": severity}
        self.results.append(Result("accepted-exceptions-policy", "exception_governance", severity, not by["expired"], metrics, [*by["expired"], *by["unused"]], failures=len(by["expired"])))
        self.summary |= {"accepted_exceptions": len(by["used"]), "unused_exceptions": len(by["unused"]), "expired_exceptions": len(by["expired"])}
        self.extra["exception_governance"] = {"version": 1, "expiry_policy": severity, "entries_total": len(entries), **by}

    @staticmethod
    def ref(detail: Mapping) -> tuple[str, list[str], str]:
        """Kind of reference, reference and kind of difference of a detail, as ``Result.differences`` has them."""
        kind = "key" if "key" in detail else "group"
        ref = detail[kind] if isinstance(detail[kind], list) else [detail[kind]]
        return kind, ref, detail.get("difference") or ("mismatch" if kind == "key" else "group")

    @staticmethod
    def entry(e: Mapping, status: str) -> dict:
        return {k: str(v) if k == "expires" else v for k, v in e.items() if v is not None} | {"status": status}

    def material(self) -> None:
        config, specs = self.spec["materiality"], dict(every_check(self.spec))
        evaluated = critical = 0
        for r in self.results:
            c = specs.get(r.id)
            policy = materiality.policy_for(r.id, (c or {}).get("source"), (c or {}).get("target"), (c or {}).get("materiality"), config, c is None)
            if not policy:
                continue
            evaluated += 1
            before = ("passed" if r.passed else "failed", r.severity)
            denominator = {"field_match": r.metrics.get("compared"), "aggregate_match": r.metrics.get("groups_compared"), "record_coverage": r.metrics.get("source_scope_records")}.get(r.type, 1)
            r.severity = "error" if policy.get("critical") else policy.get("severity", r.severity)
            r.passed, seen = materiality.gate(r.failures, denominator or 0, r.largest, r.largest_percentage, policy, r.passed)
            r.metrics["materiality"] = {"policy": policy, "observed": seen, "raw_status": before[0], "raw_severity": before[1], "status": "passed" if r.passed else "failed"}
            critical += bool(policy.get("critical") and not r.passed)
        self.summary |= {"materiality_checks": evaluated, "critical_failures": critical}
        self.extra["materiality"] = {"policy": config, "checks_evaluated": evaluated, "critical_failures": critical}

    def objects(self) -> None:
        """Roots with a failed error check of their own or of a child, from all differences."""
        parts = []
        for r in self.results:
            if r.severity != "error" or r.passed:
                continue
            child = r.id.split(":")[1] if r.id.startswith("child:") else None
            if r.type == "parent_integrity":
                frame = r.orphan_rows.select("object", F.concat_ws("/", F.lit(self.root_name), F.array_join("object", "/"), F.lit(child), F.array_join("ref", "/")).alias("path"))
            elif r.differences is not None and r.type != "aggregate_match":
                at = getattr(r, "parent_at", None)
                obj = F.col("ref") if child is None else F.array(*[F.get("ref", F.lit(i)) for i in at])
                frame = r.differences.select(obj.alias("object"), "ref")
                path = F.concat_ws("/", F.lit(self.root_name), F.array_join("object", "/")) if child is None else F.concat_ws("/", F.lit(self.root_name), F.array_join("object", "/"), F.lit(child), F.array_join("ref", "/"))
                frame = frame.select("object", path.alias("path"))
            else:
                continue
            parts.append(frame.withColumn("check_id", F.lit(r.id)))
        failed = 0
        rows = []
        if parts:
            rolled = hierarchy.roll_up(reduce(DataFrame.unionByName, parts)).persist()
            failed = rolled.count()
            rows = rolled.orderBy("object").limit(self.limit).collect()
            rolled.unpersist()
        evaluated = self.summary["source_records"]
        self.summary |= {"child_collections": len(self.extra["hierarchy"]["collections"]), "child_collections_failed": sum(c["status"] == "failed" for c in self.extra["hierarchy"]["collections"].values()), "objects_evaluated": evaluated, "objects_failed": failed, "objects_passed": max(0, evaluated - failed)}
        self.extra["hierarchy"]["failed_objects"] = [{"key": label(r["object"]), "status": "failed", "failed_checks": r["failed_checks"], "paths": r["paths"]} for r in rows]
        self.extra["hierarchy"]["failed_objects_truncated"] = failed > len(rows)


def reconcile(spark: SparkSession, spec: Mapping, base: str | Path = ".", spec_path: str | Path | None = None, today: date | None = None, frames: Mapping[str, DataFrame] | None = None, differences: list | None = None) -> dict:
    """Runs a specification and returns its evidence, with values as they are; ``evidence.prepared`` hides what is sensitive.

    frames: datasets given as frames instead of files, by ``source``, ``target``, ``identity_crosswalk`` or
    ``child:<name>:<side>``. today: the date that exceptions expire against, default today in UTC. differences: gets
    (check_id, ref_kind, ref) of all differences of each failed check that lists them, as frames.
    """
    started, clock = datetime.now(UTC), time.perf_counter()
    validate_spec(spec)
    run = _Run(spark, spec, base, today or started.date(), frames)
    run.root()
    run.children()
    if run.components is not None:
        run.identity_check()
    if "exceptions" in spec:
        run.exceptions()
    if spec.get("materiality"):
        run.material()
    if "hierarchy" in run.extra:
        run.objects()
    if differences is not None:
        differences += [r.differences.select(F.lit(r.id).alias("check_id"), "ref_kind", "ref") for r in run.results if not r.passed and r.differences is not None]
    errors = [r for r in run.results if r.severity == "error" and not r.passed]
    warnings = [r for r in run.results if r.severity == "warning" and not r.passed]
    if "materiality" in run.extra:
        run.extra["materiality"] |= {"error_failures": len(errors), "warning_failures": len(warnings)}
    for name in run.artifacts:
        path = resolved(spec["mapping_artifacts"][name]["file"], base)
        run.inputs[f"mapping:{name}"] = {"path": spec["mapping_artifacts"][name]["file"], "sha256": fingerprint(path)}
    if spec_path and Path(spec_path).exists():
        run.inputs["specification"] = {"path": Path(spec_path).name, "sha256": fingerprint(str(spec_path))}
    finished = datetime.now(UTC)
    return {
        "schema_version": SCHEMA_VERSION,
        "spec_version": 1,
        "engine_version": __version__,
        "configuration_sha256": digest(spec),
        "run": {"id": str(uuid.uuid4()), "started_at": started.isoformat(), "finished_at": finished.isoformat(), "duration_ms": round((time.perf_counter() - clock) * 1000, 3), "python_version": platform.python_version(), "platform": platform.platform(), "backend": "spark"},
        "reconciliation": spec["reconciliation"]["name"],
        "description": spec["reconciliation"].get("description"),
        "status": "failed" if errors else "passed",
        "generated_at": finished.isoformat(),
        "inputs": run.inputs,
        "summary": run.summary | {"checks_total": len(run.results), "checks_failed": len(errors), "warnings_failed": len(warnings)},
        "checks": [r.evidence() for r in run.results],
        **run.extra,
    }


__all__ = ["MISSING", "read_endpoint", "reconcile"]

"""Checks over two keyed datasets, in as few passes as they need.

All counts of rows and totals of a side are one aggregation; duplicates and every coverage check are one
full outer join of two aggregates; every field check is one join of matched rows; a grouped check is one
join of two groupings. Only checks that have differences to show run another job, for a sorted sample.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.compare import compared
from ..functions.predicates import compiled
from ..functions.values import decimal_text
from ..operators import checks as ops
from ..operators.keyed import Keyed, listed, pairs
from .spec import check_id


@dataclass
class Result:
    """A check as evidence has it, and the frame of all its differences.

    differences: ref_kind (key or group), ref (array of strings), kind, absolute_difference, percentage_difference.
    """

    id: str
    type: str
    severity: str
    passed: bool
    metrics: dict
    details: list[dict] = field(default_factory=list)
    truncated: bool = False
    differences: DataFrame | None = None
    failures: int = 0
    largest: object = None
    largest_percentage: object = None
    spec: Mapping = field(default_factory=dict)

    def evidence(self) -> dict:
        return {"id": self.id, "type": self.type, "severity": self.severity, "status": "passed" if self.passed else "failed", "metrics": self.metrics, "details": self.details, "details_truncated": self.truncated}


def label(parts: Sequence[str]) -> str | list[str]:
    """A key as evidence shows it."""
    return parts[0] if len(parts) == 1 else list(parts)


def flag_of(side: Keyed, scopes: Mapping, check: Mapping) -> Column | None:
    """Whether a row of this side is in the check's scope and condition; None if all are."""
    found = [p.get(side.side) for p in (scopes.get(check.get("scope")) or {}, check.get("when") or {})]
    columns = [compiled(p, side.column) for p in found if p]
    return None if not columns else columns[0] if len(columns) == 1 else columns[0] & columns[1]


def sample(frame: DataFrame, order: Sequence[str], limit: int) -> list:
    """The first rows in order: a top-k, no sort of the whole."""
    return frame.orderBy(*order).limit(limit).collect() if limit else []


def flat(source: Keyed, target: Keyed, checks: Sequence[Mapping], scopes: Mapping | None, limit: int) -> tuple[list[Result], dict]:
    """Results of the automatic key checks and of ``checks``, and counts. Both sides are filtered already."""
    scopes, named = scopes or {}, [(check_id(c, i), c) for i, c in enumerate(checks, 1)]
    flags: dict[str, str] = {}  # of each check that is not over all rows
    for side in (source, target):
        for i, (name, c) in enumerate(named):
            if flag_of(side, scopes, c) is not None:
                flags[name] = f"__f{i}"
    every = F.lit(True)
    source, target = (s.flagged({f: flag_of(s, scopes, dict(named)[n]) if flag_of(s, scopes, dict(named)[n]) is not None else every for n, f in flags.items()}) for s in (source, target))
    flag = lambda n: F.col(flags[n]) if n in flags else every

    def totals(side: Keyed) -> dict:
        out = [F.count(F.lit(1)).alias("rows")]
        for i, (n, c) in enumerate(named):
            out.append(F.count_if(flag(n)).alias(f"n{i}"))
            if c["type"] == "control_total":
                total, bad = ops.total(side.column(c[side.side]), flag(n))
                out += [total.alias(f"sum{i}"), bad.alias(f"bad{i}")]
        return side.rows.agg(*out).first().asDict()

    counts = {s.side: totals(s) for s in (source, target)}
    covering = [(i, n, c) for i, (n, c) in enumerate(named) if c["type"] == "record_coverage"]

    def keys(side: Keyed, p: str) -> DataFrame:
        inside = [F.bool_or(flag(n)).alias(f"{p}{i}") for i, n, _ in covering]
        return side.rows.groupBy(*side.keys).agg(F.count(F.lit(1)).alias(f"{p}n"), *inside)

    both = keys(source, "s").join(keys(target, "t"), source.keys, "full_outer")
    here = lambda c: F.coalesce(F.col(c), F.lit(False))
    sums = [F.coalesce(F.sum(F.col(f"{p}n") - 1), F.lit(0)).alias(f"{p}dup") for p in "st"]
    sums += [F.count_if(F.col("sn").isNotNull() & F.col("tn").isNotNull()).alias("matched"), F.count_if(F.col("tn").isNull()).alias("missing"), F.count_if(F.col("sn").isNull()).alias("unexpected")]
    for i, *_ in covering:
        s, t = here(f"s{i}"), here(f"t{i}")
        sums += [F.count_if(s & t).alias(f"m{i}"), F.count_if(s & ~t).alias(f"x{i}"), F.count_if(~s & t).alias(f"u{i}")]
    total = both.agg(*sums).first().asDict()
    unique = total["sdup"] == 0 and total["tdup"] == 0

    results = []
    for side, p in ((source, "s"), (target, "t")):
        extra = total[f"{p}dup"]
        shown = ops.key_integrity(side) if extra else None
        rows = sample(shown.select(*side.keys, F.explode(F.array_repeat(F.lit(1), F.col("extra_rows").cast("int"))).alias("one")), side.keys, limit) if extra else []
        results.append(Result(f"{side.side}-key-integrity", "key_integrity", "error", not extra, {"duplicate_keys": extra}, [{"key": label([r[k] for k in side.keys])} for r in rows], extra > limit, failures=extra))

    fields = [(i, n, c) for i, (n, c) in enumerate(named) if c["type"] == "field_match"]
    joined, field_counts = None, {}
    if fields:
        joined = pairs(source, target, [c["source"] for *_, c in fields], [c["target"] for *_, c in fields], unique)
        out = []
        for j, (i, n, c) in enumerate(fields):
            inside = F.col(f"sf_{flags[n]}") & F.col(f"tf_{flags[n]}") if n in flags else every
            x = compared(F.col(f"s_{j}"), F.col(f"t_{j}"), c)
            off = inside & ~x.equal
            out += [F.count_if(inside).alias(f"c{i}"), F.count_if(off).alias(f"x{i}"), F.max(F.when(off, x.difference.cast("double"))).alias(f"d{i}"), F.max(F.when(off, x.percentage.cast("double"))).alias(f"p{i}")]
        field_counts = joined.agg(F.count(F.lit(1)).alias("pairs"), *out).first().asDict()

    place = {n: j for j, (_, n, _) in enumerate(fields)}
    for i, (n, c) in enumerate(named):
        severity = c.get("severity", "error")
        scoped = {"source_scope_records": counts["source"][f"n{i}"], "target_scope_records": counts["target"][f"n{i}"]}
        fields_of = {"source_field": c.get("source"), "target_field": c.get("target")}
        if c["type"] == "record_coverage":
            missing, unexpected, allowed = total[f"x{i}"], total[f"u{i}"], bool(c.get("allow_unexpected", False))
            failures = missing + (0 if allowed else unexpected)
            metrics = {"matched": total[f"m{i}"], ops.MISSING: missing, ops.UNEXPECTED: unexpected, "allow_unexpected": allowed, **scoped}
            result = Result(n, c["type"], severity, not failures, metrics, failures=failures, spec=c)
            if missing + unexpected:
                diff = ops.coverage(source, target, flags.get(n))
                rows = sample(diff, ["difference", *source.keys], limit)
                result.details = [{"key": label([r[k] for k in source.keys]), "difference": r["difference"]} for r in rows]
                result.truncated = missing + unexpected > limit
                counted = diff.where(F.col("difference") == ops.MISSING) if allowed else diff
                result.differences = counted.select(F.lit("key").alias("ref_kind"), F.array(*source.keys).alias("ref"), F.col("difference").alias("kind"), F.lit(None).cast("double").alias("absolute_difference"), F.lit(None).cast("double").alias("percentage_difference"))
        elif c["type"] == "field_match":
            off, most = field_counts[f"x{i}"], int(c.get("max_mismatches", 0))
            metrics = {"compared": field_counts[f"c{i}"], "skipped_by_scope_or_when": field_counts["pairs"] - field_counts[f"c{i}"], "mismatches": off, "max_mismatches": most, **fields_of}
            result = Result(n, c["type"], severity, off <= most, metrics, failures=off, largest=field_counts[f"d{i}"], largest_percentage=field_counts[f"p{i}"], spec=c)
            if off:
                j = place[n]
                x = compared(F.col(f"s_{j}"), F.col(f"t_{j}"), c)
                inside = F.col(f"sf_{flags[n]}") & F.col(f"tf_{flags[n]}") if n in flags else every
                diff = joined.where(inside & ~x.equal).select(*source.keys, F.col(f"s_{j}").cast("string").alias("source"), F.col(f"t_{j}").cast("string").alias("target"), x.source.alias("normalized_source"), x.target.alias("normalized_target"), x.difference.cast("double").alias("absolute_difference"), x.percentage.cast("double").alias("percentage_difference"))
                rows = sample(diff, source.keys, limit)
                result.details = [{"key": label([r[k] for k in source.keys]), **{f: r[f] for f in ("source", "target", "normalized_source", "normalized_target")}} for r in rows]
                result.truncated = off > limit
                result.differences = diff.select(F.lit("key").alias("ref_kind"), F.array(*source.keys).alias("ref"), F.lit("mismatch").alias("kind"), "absolute_difference", "percentage_difference")
        elif c["type"] == "control_total":
            if bad := counts["source"][f"bad{i}"] + counts["target"][f"bad{i}"]:
                raise DataError(f"check {n}: {bad} values are no numbers")
            a, b = counts["source"][f"sum{i}"], counts["target"][f"sum{i}"]
            apart, tolerance = abs(a - b), type(a)(str(c.get("tolerance", 0)))
            metrics = {"source_total": decimal_text(a), "target_total": decimal_text(b), "absolute_difference": decimal_text(apart), "tolerance": decimal_text(tolerance), **fields_of, **scoped}
            result = Result(n, c["type"], severity, apart <= tolerance, metrics, failures=int(apart > tolerance), largest=apart, spec=c)
        elif c["type"] == "row_count":
            a, b = scoped.values()
            metrics = {"source_rows": a, "target_rows": b, "absolute_difference": abs(a - b), "tolerance": int(c.get("tolerance", 0))}
            result = Result(n, c["type"], severity, abs(a - b) <= metrics["tolerance"], metrics, failures=int(abs(a - b) > metrics["tolerance"]), largest=abs(a - b), spec=c)
        else:
            result = _grouped(source, target, n, c, severity, flags.get(n), fields_of | scoped, limit)
        results.append(result)
    selected = {"source_records": counts["source"]["rows"], "target_records": counts["target"]["rows"], "matched_records": total["matched"], ops.MISSING: total["missing"], ops.UNEXPECTED: total["unexpected"]}
    return results, selected


def _grouped(source: Keyed, target: Keyed, name: str, c: Mapping, severity: str, flag: str | None, extra: Mapping, limit: int) -> Result:
    groups = ops.aggregate_match(source, target, c, flag)
    by = [g for g in groups.columns if g.startswith("g") and g[1:].isdigit()]
    failed = ~F.col("passed")
    n = groups.agg(F.count(F.lit(1)).alias("all"), F.count_if(failed).alias("failed"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.max(F.when(failed, F.col("absolute_difference"))).alias("d"), F.max(F.when(failed, F.col("percentage_difference"))).alias("p")).first()
    if n["bad"]:
        raise DataError(f"check {name}: {n['bad']} values are no numbers")
    metrics = {"operation": c.get("operation", "count"), "groups_compared": n["all"], "groups_failed": n["failed"], "tolerance": str(c.get("tolerance", 0)), "percentage_tolerance": None if c.get("percentage_tolerance") is None else str(c["percentage_tolerance"]), "source_group_by": listed(c["group_by"]["source"]), "target_group_by": listed(c["group_by"]["target"]), **extra}
    out = Result(name, c["type"], severity, not n["failed"], metrics, failures=n["failed"], largest=n["d"], largest_percentage=n["p"], spec=c)
    if n["failed"]:
        off = groups.where(failed)
        shown = sample(off, by, limit)
        out.details = [{"group": label([r[g] for g in by]), **{v: decimal_text(r[v]) for v in ("source_value", "target_value", "absolute_difference")}, "percentage_difference": None if r["percentage_difference"] is None else repr(r["percentage_difference"])} for r in shown]
        out.truncated = n["failed"] > limit
        out.differences = off.select(F.lit("group").alias("ref_kind"), F.array(*by).alias("ref"), F.lit("group").alias("kind"), F.col("absolute_difference").cast("double").alias("absolute_difference"), "percentage_difference")
    return out

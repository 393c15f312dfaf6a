"""Materiality: which failures matter, decided on metrics over all differences."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError

LIMITS = ("max_failures", "max_failure_percentage", "max_absolute_difference", "max_percentage_difference")
KNOWN = {"severity", "critical", *LIMITS}


def check_policy(policy: object, at: str) -> None:
    """Raises SpecError unless ``policy`` is well formed."""
    if not isinstance(policy, Mapping):
        raise SpecError(f"{at} must be a mapping")
    if extra := set(policy) - KNOWN:
        raise SpecError(f"{at}: unknown {', '.join(sorted(extra))}")
    if policy.get("severity", "error") not in ("error", "warning"):
        raise SpecError(f"{at}.severity must be error or warning")
    if not isinstance(policy.get("critical", False), bool):
        raise SpecError(f"{at}.critical must be true or false")
    for limit in LIMITS:
        v = policy.get(limit, 0)
        if isinstance(v, bool) or not isinstance(v, (int, float, str)) or Decimal(str(v)) < 0:
            raise SpecError(f"{at}.{limit} must be a number that is not negative")


def policy_for(check_id: str, source_field: str | None, target_field: str | None, inline: Mapping | None, config: Mapping, automatic: bool) -> dict:
    """M1: default, source field, target field, check id, inline; later ones win. Automatic checks listen to their id alone."""
    by_id = (config.get("checks") or {}).get(check_id)
    if automatic:
        return dict(by_id or {})
    fields = config.get("fields") or {}
    layers = [config.get("default"), fields.get(source_field), fields.get(target_field), by_id, inline]
    return {k: v for layer in layers if layer for k, v in layer.items()}


def gate(failures: int, denominator: int, largest: object, largest_percentage: object, policy: Mapping, passed: bool) -> tuple[bool, dict]:
    """M2: whether the check passes under the policy, and what was observed. All limits have to hold."""
    share = Decimal(failures) * 100 / Decimal(denominator) if denominator else Decimal(0)
    seen = {"failures": failures, "denominator": denominator, "failure_percentage": str(share), "max_observed_absolute_difference": None if largest is None else str(largest), "max_observed_percentage_difference": None if largest_percentage is None else str(largest_percentage)}
    if policy.get("critical") and failures:
        return False, seen | {"critical_failure": True}
    observed = {"max_failures": failures, "max_failure_percentage": share, "max_absolute_difference": largest, "max_percentage_difference": largest_percentage}
    verdicts = []
    for limit in LIMITS:
        if limit in policy:
            value = observed[limit]
            if value is None and failures:
                seen[limit.removeprefix("max_") + "_not_evaluable"] = True
            verdicts.append(not failures if value is None else Decimal(str(value)) <= Decimal(str(policy[limit])))
    return (all(verdicts) if verdicts else passed), seen


def gated(metrics: DataFrame, policies: DataFrame) -> DataFrame:
    """``gate`` for many checks inside a plan.

    metrics: check_id, raw_status, failures, denominator, max_absolute, max_percentage; policies: check_id and
    the limits, null where unset. Gives ``metrics`` with ``status``.
    """
    m = metrics.join(policies, "check_id", "left")
    share = F.when(F.col("denominator") > 0, F.col("failures") * 100.0 / F.col("denominator")).otherwise(F.lit(0.0))
    none = F.col("failures") == 0
    tests = {"max_failures": F.col("failures"), "max_failure_percentage": share, "max_absolute_difference": F.col("max_absolute"), "max_percentage_difference": F.col("max_percentage")}
    ok = F.lit(True)
    for limit, value in tests.items():
        ok = ok & (F.col(limit).isNull() | F.coalesce(value <= F.col(limit), none))
    any_set = F.coalesce(*[F.col(x).cast("double") for x in tests]).isNotNull()
    passed = F.when(F.coalesce("critical", F.lit(False)) & ~none, F.lit(False)).when(any_set, ok).otherwise(F.col("raw_status") == "passed")
    return m.withColumn("status", F.when(passed, "passed").otherwise("failed")).drop(*tests, "critical")

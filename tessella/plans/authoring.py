"""From two datasets to a first specification."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import DataError, SpecError
from ..operators.profile import candidate_keys, key_score, plain_name, profiled
from ..sources.files import read_file

LEAST_SCORE = 0.7


def inspect(frame: DataFrame, name: str = "dataset", approximate: bool = False) -> dict:
    """Rows, columns and candidate keys of a dataset; an empty one is an error."""
    profile = profiled(frame, approximate).persist()
    rows = profile.orderBy("position").collect()
    if not rows or not rows[0]["rows"]:
        raise DataError(f"{name} has no rows")
    columns = [{"name": r["field"], "inferred_type": r["inferred_type"], "null_count": r["nulls"], "null_rate": r["null_rate"], "distinct_count": r["distinct"], "uniqueness": r["uniqueness"]} for r in rows]
    keys = [{"field": r["field"], "score": r["score"]} for r in candidate_keys(profile).collect()]
    profile.unpersist()
    return {"dataset": name, "rows": rows[0]["rows"], "columns": columns, "candidate_keys": keys}


def key_pair(source: Mapping, target: Mapping) -> tuple[str, str] | None:
    """The only pair of candidate keys with like names and a good score, if there is just one."""
    found = [(s["field"], t["field"]) for s in source["candidate_keys"] for t in target["candidate_keys"] if plain_name(s["field"]) == plain_name(t["field"]) and min(s["score"], t["score"]) >= LEAST_SCORE]
    return found[0] if len(found) == 1 else None


def field_pairs(source: Mapping, target: Mapping) -> list[dict]:
    """For each source column the target column of the same name, else the only one of a like name, else what to review."""
    names = [c["name"] for c in target["columns"]]
    out = []
    for c in source["columns"]:
        like = [n for n in names if plain_name(n) == plain_name(c["name"])]
        if c["name"] in names:
            out.append({"source": c["name"], "target": c["name"], "status": "suggested"})
        elif len(like) == 1:
            out.append({"source": c["name"], "target": like[0], "status": "suggested"})
        else:
            out.append({"source": c["name"], "target": None, "status": "review", "candidates": like})
    return out


def first_spec(spark: SparkSession, source: str, target: str, source_key: str | None = None, target_key: str | None = None, delimiter: str = ",", sheets: tuple[str | None, str | None] = (None, None), choose: Callable[[str, list[str]], str] | None = None) -> tuple[dict, list[str]]:
    """R2: a cautious specification of two files, and what is left to review.

    Keys that can't be told are refused, or chosen: choose gets the side and its candidates.
    """
    ends = [{"file": str(Path(f).resolve()), "delimiter": delimiter} | ({"sheet": s} if s else {}) for f, s in zip((source, target), sheets, strict=True)]
    a, b = (inspect(read_file(spark, e), e["file"]) for e in ends)
    for key, p, side in ((source_key, a, "source"), (target_key, b, "target")):
        if key and key not in [c["name"] for c in p["columns"]]:
            raise SpecError(f"{key!r} is no column of the {side}")
    if not (source_key and target_key):
        pair = key_pair(a, b)
        if pair is None and choose:
            pick = lambda side, p: choose(side, [k["field"] for k in p["candidate_keys"]])
            pair = (source_key or pick("source", a), target_key or pick("target", b))
        if pair is None:
            shown = lambda p: ", ".join(k["field"] for k in p["candidate_keys"]) or "none"
            raise SpecError(f"the business keys can't be told; candidates: source {shown(a)}; target {shown(b)}. Name them with --source-key and --target-key, or choose with --interactive.")
        source_key, target_key = source_key or pair[0], target_key or pair[1]
    checks, todo, used = [{"id": "coverage", "type": "record_coverage"}], [], {"coverage"}
    for p in field_pairs(a, b):
        if p["status"] == "review":
            todo.append(f"source field {p['source']!r} has no target" + (f"; candidates {', '.join(p['candidates'])}" if p["candidates"] else ""))
        elif (p["source"], p["target"]) != (source_key, target_key):
            name = stem = "field-" + (plain_name(p["source"]) or "column")
            n = 1
            while name in used:
                n += 1
                name = f"{stem}-{n}"
            used.add(name)
            checks.append({"id": name, "type": "field_match", "source": p["source"], "target": p["target"]})
    for e, k in zip(ends, (source_key, target_key), strict=True):
        e["key"] = k
    spec = {"version": 1, "reconciliation": {"name": f"{Path(source).stem} to {Path(target).stem}"}, "source": ends[0], "target": ends[1], "checks": checks, "evidence": {"detail_limit": 100}}
    return spec, todo


__all__ = ["field_pairs", "first_spec", "inspect", "key_pair", "key_score"]

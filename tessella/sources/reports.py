"""Evidence as files: JSON, Markdown, HTML without scripts, a workbook, CSV details, and a bundle of them all."""

from __future__ import annotations

import csv
import hashlib
import html
import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from .excel import write_workbook

CATEGORIES = {
    "missing": ("check_id", "key", "difference"),
    "unexpected": ("check_id", "key", "difference"),
    "field-mismatches": ("check_id", "key", "source", "target", "normalized_source", "normalized_target"),
    "aggregate-mismatches": ("check_id", "group", "source_value", "target_value", "absolute_difference", "percentage_difference"),
    "exceptions": ("check_id", "key", "group", "reason_code", "reason", "reference", "status"),
}


def write_text(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def write_json(content: object, path: str | Path) -> None:
    """SNK1."""
    write_text(path, json.dumps(content, indent=2, ensure_ascii=False, default=str) + "\n")


def shown(x: object) -> str:
    """A value in one line."""
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, default=str)


def tables(e: Mapping) -> list[tuple[str, Sequence[str], list[Sequence[object]]]]:
    """Title, header and rows of the tables that a report of any kind of evidence has."""
    out = [("Summary", ("Measure", "Value"), list(e["summary"].items()))]
    if "transitions" in e:  # a chain
        out.append(("Stages", ("Stage", "Status", "Incoming transition"), [(s["id"], s["status"], s["incoming_transition"]) for s in e["stages"]]))
        out.append(("Transitions", ("Transition", "From", "To", "Status", "Failed checks"), [(t["id"], t["from"], t["to"], t["status"], t["summary"]["checks_failed"]) for t in e["transitions"]]))
        out.append(("First divergence", ("Transition", "Check", "Where"), [(d["first_transition"], d["check_id"], d["locator"]) for d in e["first_divergence"]]))
    elif "discrepancies" in e:  # a comparison of runs
        out.append(("Checks", ("Check", "Before", "Now", "Transition"), [(c["id"], c["baseline_status"], c["current_status"], c["transition"]) for c in e["check_transitions"]]))
        for name, found in e["discrepancies"].items():
            out.append((f"{name.capitalize()} discrepancies", ("Check", "Where"), [(d["check_id"], d["locator"]) for d in found]))
    else:
        out.append(("Checks", ("Check", "Type", "Severity", "Status", "Metrics"), [(c["id"], c["type"], c["severity"], c["status"], c["metrics"]) for c in e["checks"]]))
        out.append(("Inputs", ("Input", "Path", "SHA-256"), [(k, v.get("path") or v.get("connection"), v.get("sha256") or v.get("query_sha256")) for k, v in e["inputs"].items()]))
        for o in [e["hierarchy"]] if "hierarchy" in e else []:
            out.append(("Failed objects", ("Object", "Checks", "Paths"), [(x["key"], x["failed_checks"], x["paths"]) for x in o["failed_objects"]]))
        for c in e["checks"]:
            if c["details"]:
                names = list(dict.fromkeys(k for d in c["details"] for k in d))
                out.append((f"Details of {c['id']}" + (" (cut off)" if c["details_truncated"] else ""), names, [[d.get(n) for n in names] for d in c["details"]]))
    return out


def title(e: Mapping) -> str:
    return str(e.get("pipeline") or e["reconciliation"])


def status(e: Mapping) -> str:
    return str(e.get("status") or ("regression" if e["summary"].get("regression") else "no regression"))


def markdown(e: Mapping) -> str:
    """SNK2, SNK7, SNK8."""
    cell = lambda x: shown(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ").replace("<", "&lt;")
    parts = [f"# {title(e)}", "", f"Status: **{status(e)}**"]
    for name, header, rows in tables(e):
        parts += ["", f"## {name}", ""]
        parts += [f"| {' | '.join(map(cell, header))} |", f"|{' --- |' * len(header)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows)] if rows else ["None."]
    return "\n".join(parts) + "\n"


def html_page(e: Mapping) -> str:
    """SNK3, SNK7, SNK8: one file that loads nothing."""
    parts = [f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{html.escape(title(e))}</title>", "<style>body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #bbb;padding:.3em .6em;text-align:left;vertical-align:top}</style></head><body>", f"<h1>{html.escape(title(e))}</h1><p>Status: <strong>{html.escape(status(e))}</strong></p>"]
    for name, header, rows in tables(e):
        parts.append(f"<h2>{html.escape(name)}</h2>")
        head = "".join(f"<th>{html.escape(str(h))}</th>" for h in header)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(shown(c))}</td>" for c in r) + "</tr>" for r in rows)
        parts.append(f"<table><tr>{head}</tr>{body}</table>" if rows else "<p>None.</p>")
    return "\n".join([*parts, "</body></html>"]) + "\n"


def details(e: Mapping) -> dict[str, list[dict]]:
    """The details of a run by category; accepted ones stand among the exceptions too."""
    out: dict[str, list[dict]] = {c: [] for c in CATEGORIES}
    for c in e["checks"]:
        for d in c["details"]:
            row = {"check_id": c["id"], **d}
            if d.get("difference") in ("missing_in_target", "unexpected_in_target"):
                out[d["difference"].removesuffix("_in_target")].append(row)
            elif c["type"] == "field_match":
                out["field-mismatches"].append(row)
            elif c["type"] == "aggregate_match":
                out["aggregate-mismatches"].append(row)
            if "exception" in d:
                out["exceptions"].append(row | d["exception"])
    return out


def safe(x: object) -> str:
    """A cell that no spreadsheet takes for a formula."""
    text = shown(x)
    return "'" + text if text[:1] in ("=", "+", "-", "@", "\t", "\r") and not text[1:].replace(".", "").isdigit() else text


def write_csv(path: str | Path, header: Sequence[str], rows: Iterable[Mapping]) -> None:
    """SNK5."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("w", encoding="utf-8", newline="") as handle:
        out = csv.writer(handle)
        out.writerow(header)
        out.writerows([safe(r.get(h)) for h in header] for r in rows)


def write_workbook_of(e: Mapping, path: str | Path) -> None:
    """SNK4: summary, checks, inputs and the five kinds of details."""
    t = {name: (header, rows) for name, header, rows in tables(e)[:3]}
    sheets = {name: [header, *[[shown(c) if not isinstance(c, (int, float)) else c for c in r] for r in rows]] for name, (header, rows) in t.items()}
    for name, rows in details(e).items():
        sheets[name] = [CATEGORIES[name], *[[shown(r.get(h)) for h in CATEGORIES[name]] for r in rows]]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    write_workbook(str(path), sheets)


def write_bundle(e: Mapping, folder: str | Path) -> dict:
    """SNK6: every form of the evidence, and a manifest with size and SHA-256 of each file."""
    folder = Path(folder)
    write_json(e, folder / "evidence.json")
    write_text(folder / "evidence.md", markdown(e))
    write_text(folder / "evidence.html", html_page(e))
    write_workbook_of(e, folder / "evidence.xlsx")
    for name, rows in details(e).items():
        write_csv(folder / "details" / f"{name}.csv", CATEGORIES[name], rows)
    files = {f.relative_to(folder).as_posix(): {"sha256": hashlib.sha256(f.read_bytes()).hexdigest(), "size_bytes": f.stat().st_size} for f in sorted(folder.rglob("*")) if f.is_file() and f.name != "manifest.json"}
    manifest = {"bundle_version": 1, "run_id": e["run"]["id"], **{k: e.get(k) for k in ("reconciliation", "status", "generated_at", "engine_version", "schema_version", "configuration_sha256", "inputs", "privacy")}, "files": files}
    write_json(manifest, folder / "manifest.json")
    return manifest

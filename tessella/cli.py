"""The command line. Exit codes: 0 passed, 1 a gate failed, 2 something is not valid."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from . import __version__
from .errors import SpecError, TessellaError
from .plans import authoring, chain, evidence, schemas
from .plans.run import reconcile
from .plans.spec import load_spec
from .sources import reports
from .sources.files import read_file


def session() -> SparkSession:
    """The session that spark-submit configured, or a local one."""
    return SparkSession.builder.appName("tessella").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description="Reconciles keyed datasets on Spark.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, help_: sub.add_parser(name, help=help_)
    add("validate", "check a specification").add_argument("spec")
    run = add("run", "run a specification")
    run.add_argument("spec")
    for flag, default in (("--evidence", "build/evidence.json"), ("--report", "build/evidence.md"), ("--bundle", None)):
        run.add_argument(flag, default=default)
    run.add_argument("--no-fail-on-diff", action="store_true")
    look = add("inspect", "profile a dataset")
    look.add_argument("file")
    look.add_argument("--sheet")
    look.add_argument("--delimiter", default=",")
    look.add_argument("--json", action="store_true")
    for name, help_ in (("init", "write a first specification for two files"), ("preflight", "write one and run it if nothing is left to review")):
        one = add(name, help_)
        one.add_argument("source")
        one.add_argument("target")
        for flag in ("--source-key", "--target-key", "--source-sheet", "--target-sheet"):
            one.add_argument(flag)
        one.add_argument("--delimiter", default=",")
        one.add_argument("--interactive", action="store_true", help="ask for keys that can't be told")
        one.add_argument("--force", action="store_true", help="overwrite files that are there")
        if name == "init":
            one.add_argument("--output", "-o", default="reconciliation.yaml")
        else:
            one.add_argument("--output-dir", default="build/preflight")
            one.add_argument("--fail-on-diff", action="store_true")
    pipe = add("pipeline", "run a chain of stages")
    pipe.add_argument("spec")
    for flag, default in (("--evidence", "build/pipeline-evidence.json"), ("--report", "build/pipeline-evidence.md"), ("--html", None), ("--from-stage", None), ("--to-stage", None)):
        pipe.add_argument(flag, default=default)
    pipe.add_argument("--no-fail-on-diff", action="store_true")
    diff = add("diff", "compare the evidence of two runs")
    diff.add_argument("baseline")
    diff.add_argument("current")
    for flag, default in (("--output", "build/evidence-diff.json"), ("--report", "build/evidence-diff.md"), ("--html", None)):
        diff.add_argument(flag, default=default)
    diff.add_argument("--no-fail-on-regression", action="store_true")
    kind = add("schema", "print a JSON schema")
    kind.add_argument("kind", choices=schemas.KINDS)
    kind.add_argument("--output", "-o", default="-")
    return p


def written(e: dict, a: argparse.Namespace, json_path: str) -> None:
    reports.write_json(e, json_path)
    reports.write_text(a.report, reports.markdown(e))
    if getattr(a, "html", None):
        reports.write_text(a.html, reports.html_page(e))


def run_spec(path: str, a: argparse.Namespace) -> bool:
    spec = load_spec(path)
    found = evidence.prepared(reconcile(session(), spec, Path(path).resolve().parent, path), spec)
    written(found, a, a.evidence)
    if getattr(a, "bundle", None):
        reports.write_bundle(found, a.bundle)
    print(f"{found['status']}: {found['summary']['checks_failed']} of {found['summary']['checks_total']} checks failed")
    return found["status"] == "passed"


def chosen(side: str, candidates: list[str]) -> str:
    """Asks until one of the candidates is named by its number."""
    if not candidates:
        raise SpecError(f"the {side} has no column that is never blank and always different")
    print(f"keys of the {side}:", *(f"{n}) {c}" for n, c in enumerate(candidates, 1)), sep="\n  ")
    while True:
        said = input(f"number of the {side}'s key: ").strip()
        if said.isascii() and said.isdigit() and 1 <= int(said) <= len(candidates):
            return candidates[int(said) - 1]


def first(a: argparse.Namespace, output: Path, *others: Path) -> list[str]:
    there = [str(p) for p in (output, *others) if p.exists()]
    if there and not a.force:
        raise SpecError(f"{', '.join(there)} would be overwritten; --force does it")
    spec, todo = authoring.first_spec(session(), a.source, a.target, a.source_key, a.target_key, a.delimiter, (a.source_sheet, a.target_sheet), chosen if a.interactive else None)
    text = yaml.safe_dump(spec, sort_keys=False, allow_unicode=True)
    reports.write_text(output, text + "".join(f"# TODO: {t}\n" for t in todo))
    print(f"wrote {output}" + (f"; {len(todo)} to review" if todo else ""))
    return todo


def command(a: argparse.Namespace) -> int:
    if a.command == "validate":
        load_spec(a.spec)
        print("valid")
    elif a.command == "run":
        return int(not run_spec(a.spec, a) and not a.no_fail_on_diff)
    elif a.command == "inspect":
        found = authoring.inspect(read_file(session(), {"file": str(Path(a.file).resolve()), "delimiter": a.delimiter, "sheet": a.sheet}), a.file)
        print(json.dumps(found, indent=2, ensure_ascii=False) if a.json else "\n".join([f"{found['rows']} rows", *(f"{c['name']}: {c['inferred_type']}, {c['null_count']} null, {c['distinct_count']} distinct" for c in found["columns"]), "candidate keys: " + (", ".join(k["field"] for k in found["candidate_keys"]) or "none")]))
    elif a.command == "init":
        first(a, Path(a.output))
    elif a.command == "preflight":
        folder = Path(a.output_dir)
        if first(a, folder / "reconciliation.yaml", folder / "evidence.json", folder / "evidence.md"):
            print("review the specification, then run it")
            return 0
        a.evidence, a.report = folder / "evidence.json", folder / "evidence.md"
        return int(not run_spec(str(folder / "reconciliation.yaml"), a) and a.fail_on_diff)
    elif a.command == "pipeline":
        found = chain.run_chain(session(), chain.load_chain(a.spec), Path(a.spec).resolve().parent, a.spec, a.from_stage, a.to_stage)
        written(found, a, a.evidence)
        print(f"{found['status']}: {found['summary']['transitions_failed']} of {found['summary']['transitions_total']} transitions failed")
        return int(found["status"] == "failed" and not a.no_fail_on_diff)
    elif a.command == "diff":
        found = evidence.compared_runs(evidence.read_evidence(a.baseline), evidence.read_evidence(a.current), (a.baseline, a.current))
        written(found, a, a.output)
        print("regression" if found["summary"]["regression"] else "no regression")
        return int(found["summary"]["regression"] and not a.no_fail_on_regression)
    else:
        text = json.dumps(schemas.schema(a.kind), indent=2) + "\n"
        sys.stdout.write(text) if a.output == "-" else reports.write_text(a.output, text)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return command(parser().parse_args(argv))
    except TessellaError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

"""Whole runs over small files."""

import copy
import json
import sqlite3
import zipfile
from datetime import date

import pytest
import yaml
from pyspark.sql import functions as F

from tessella.cli import main
from tessella.errors import DataError, SpecError
from tessella.plans import chain, evidence, schemas
from tessella.plans.authoring import first_spec, inspect
from tessella.plans.run import reconcile
from tessella.plans.spec import validate_spec
from tessella.sources import reports
from tessella.sources.excel import write_workbook
from tessella.sources.files import read_csv, read_excel

SPEC = {"version": 1, "reconciliation": {"name": "t"}, "source": {"file": "s.csv", "key": "ID"}, "target": {"file": "t.csv", "key": "ID"}, "checks": [{"id": "coverage", "type": "record_coverage"}]}


def run(spark, tmp_path, s, t, today=date(2026, 1, 1), files=None, **parts):
    (tmp_path / "s.csv").write_text(s)
    (tmp_path / "t.csv").write_text(t)
    for name, text in (files or {}).items():
        (tmp_path / name).write_text(text)
    spec = copy.deepcopy(SPEC)
    for k, v in parts.items():
        spec[k] = {**spec[k], **v} if k in ("source", "target") else v
    return reconcile(spark, spec, tmp_path, today=today)


def check(e, name):
    return next(c for c in e["checks"] if c["id"] == name)


def match(name="v", field="V", **more):
    return {"id": name, "type": "field_match", "source": field, "target": field, **more}


def test_keys_maps_and_tolerances(spark, tmp_path):
    e = run(spark, tmp_path, "ID,C,A\n001,DE,10.00\n002,US,5\n", "LEGACY,CC,A\n1,DEU,10.02\n2,USA,5\n", target={"key": "LEGACY"}, source={"key_normalize": ["trim", "strip_leading_zeros"]}, checks=[SPEC["checks"][0], {"id": "c", "type": "field_match", "source": "C", "target": "CC", "map": {"DE": "DEU", "US": "USA"}}, match("a", "A", numeric_tolerance=0.02)])
    assert e["status"] == "passed" and e["summary"]["matched_records"] == 2


def test_missing_and_mismatch_sorted_and_limited(spark, tmp_path):
    e = run(spark, tmp_path, "ID,V\n3,a\n1,a\n2,b\n4,c\n", "ID,V\n1,x\n2,y\n3,a\n", checks=[SPEC["checks"][0], match()], evidence={"detail_limit": 1})
    v = check(e, "v")
    assert check(e, "coverage")["details"] == [{"key": "4", "difference": "missing_in_target"}]
    assert v["metrics"]["mismatches"] == 2 and v["details_truncated"] and v["details"][0]["key"] == "1"


def test_duplicate_keys_compare_the_first_row(spark, tmp_path):
    e = run(spark, tmp_path, "ID,V\n1,a\n1,b\n", "ID,V\n1,a\n", checks=[match()])
    assert check(e, "source-key-integrity")["metrics"]["duplicate_keys"] == 1
    assert check(e, "v")["metrics"]["compared"] == 1 and check(e, "v")["status"] == "passed" and e["status"] == "failed"


def test_scope_when_and_dates(spark, tmp_path):
    active = {"field": "ACTIVE", "value": "Y"}
    e = run(spark, tmp_path, "ID,ACTIVE,D\n1,Y,2024-01-01\n2,Y,2024-01-05\n3,Y,\n4,N,2024-01-01\n", "ID,ACTIVE,D\n1,Y,2024-01-02\n2,Y,2024-01-05\n3,Y,\n4,N,2030-01-01\n", scopes={"active": {"source": active, "target": active}}, checks=[match("d", "D", scope="active", date_tolerance_days=1, when={"source": {"field": "D", "op": "not_null"}})])
    assert check(e, "d")["metrics"]["compared"] == 2 and check(e, "d")["metrics"]["skipped_by_scope_or_when"] == 2 and e["status"] == "passed"


def test_filter_counts_rows_before_and_after(spark, tmp_path):
    f = {"filter": {"field": "ACTIVE", "op": "in", "value": ["y"], "normalize": ["trim", "lowercase"]}}
    e = run(spark, tmp_path, "ID,ACTIVE\n1,Y\n2, y\n3,N\n", "ID,ACTIVE\n1,Y\n2,Y\n3,N\n", source=f, target=f)
    assert e["selection"]["source"]["raw_records"] == 3 and e["summary"]["source_records"] == 2 and e["status"] == "passed"


@pytest.mark.parametrize(("more", "passes"), [({"numeric_tolerance": 1}, True), ({"percentage_tolerance": 1}, True), ({"percentage_tolerance": "0.99"}, False), ({"numeric_tolerance": "0.5", "percentage_tolerance": 1}, True), ({}, False)])
def test_tolerances_are_inclusive(spark, tmp_path, more, passes):
    assert (run(spark, tmp_path, "ID,V\n1,100\n", "ID,V\n1,101\n", checks=[match(**more)])["status"] == "passed") is passes


@pytest.mark.parametrize(("rule", "source", "target", "passes"), [("equal", "", "", True), ("empty_is_null", " ", "", True), ("never_equal", "", "", False), ("never_equal", "a", "a", True)])
def test_null_rules(spark, tmp_path, rule, source, target, passes):
    e = run(spark, tmp_path, f'ID,V\n1,"{source}"\n', f'ID,V\n1,"{target}"\n', checks=[match(null_semantics=rule)])
    assert (e["status"] == "passed") is passes


def test_totals_groups_and_bad_numbers(spark, tmp_path):
    checks = [{"id": "sum", "type": "control_total", "source": "A", "target": "A", "tolerance": 5}, {"id": "rows", "type": "row_count"}, {"id": "g", "type": "aggregate_match", "operation": "sum", "source": "A", "target": "A", "group_by": {"source": "G", "target": "G"}}, {"id": "d", "type": "aggregate_match", "operation": "distinct_count", "source": "A", "target": "A", "group_by": {"source": ["G"], "target": ["G"]}}]
    e = run(spark, tmp_path, 'ID,G,A\n1,x,"1,000"\n2,y,\n', "ID,G,A\n1,x,1005\n2,y,0\n", checks=checks)
    assert check(e, "sum")["status"] == "passed" and check(e, "sum")["metrics"]["absolute_difference"] == "5"
    assert check(e, "g")["details"] == [{"group": "x", "source_value": "1000", "target_value": "1005", "absolute_difference": "5", "percentage_difference": "0.5"}]
    assert check(e, "d")["status"] == "passed"
    with pytest.raises(DataError, match="no numbers"):
        run(spark, tmp_path, "ID,A\n1,abc\n", "ID,A\n1,1\n", checks=checks[:1])


def test_blank_equals_zero_in_numbers(spark, tmp_path):
    assert run(spark, tmp_path, "ID,V\n1,\n", "ID,V\n1,0\n", checks=[match(numeric_tolerance=0)])["status"] == "passed"


def test_missing_column_is_an_error(spark, tmp_path):
    with pytest.raises(DataError, match="no column 'X'"):
        run(spark, tmp_path, "ID\n1\n", "ID\n1\n", checks=[match("x", "X")])


@pytest.mark.parametrize("text", ["A,A\n1,2\n", "A,a\n1,2\n", "A,\n1,2\n", "A,B\n1,2,3\n", "A,B\n1\n", 'A,B\n"1,2\n'])
def test_malformed_csv(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(Exception) as e:
        read_csv(spark, str(tmp_path / "x.csv")).collect()
    assert isinstance(e.value, DataError) or "MALFORMED" in str(e.value)


def test_csv_with_mark_delimiter_and_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿ID;NOTE;A\n1;"two\nlines ""q""";\n', encoding="utf-8")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), ";").collect()] == [("1", 'two\nlines "q"', "")]


def test_workbooks(spark, tmp_path):
    write_workbook(str(tmp_path / "x.xlsx"), {"one": [["ID", " A "], ["1", 2.5], ["2", None]], "two": [["B"], ["x"]]})
    frame = read_excel(spark, str(tmp_path / "x.xlsx"))
    assert frame.columns == ["ID", "A"] and [tuple(r) for r in frame.collect()] == [("1", "2.5"), ("2", None)]
    assert read_excel(spark, str(tmp_path / "x.xlsx"), "two").columns == ["B"]
    with pytest.raises(DataError):
        read_excel(spark, str(tmp_path / "x.xlsx"), "none")


CHILD = {"children": {"addresses": {"source": {"file": "sc.csv", "key": ["ID", "T"], "parent_key": "ID"}, "target": {"file": "tc.csv", "key": ["ID", "T"], "parent_key": "ID"}, "checks": [{"id": "coverage", "type": "record_coverage"}, match("city", "CITY")]}}, "object": {"type": "Customer"}}


def test_children_roll_up_to_objects(spark, tmp_path):
    files = {"sc.csv": "ID,T,CITY\n1,A,x\n1,B,y\n2,A,z\n", "tc.csv": "ID,T,CITY\n2,A,q\n1,A,x\n9,A,o\n"}
    e = run(spark, tmp_path, "ID\n1\n2\n3\n", "ID\n3\n2\n1\n", files=files, **CHILD)
    assert check(e, "child:addresses:city")["details"][0]["object_path"] == "Customer/2/addresses/2/A"
    assert check(e, "child:addresses:target-parent-integrity")["metrics"]["orphan_rows"] == 1
    assert {o["key"]: o["failed_checks"] for o in e["hierarchy"]["failed_objects"]}["1"] == ["child:addresses:coverage"]
    assert e["summary"]["objects_failed"] == 3 and e["summary"]["child_collections_failed"] == 1


WALK = {"identity": {"crosswalk": {"file": "x.csv", "source_key": "S", "target_key": "T"}, "aggregation": {"source": {"A": "sum"}, "target": {"A": "sum"}}}}


def test_identity_split_and_merge(spark, tmp_path):
    files = {"x.csv": "S,T\n1,A\n2,B\n2,C\n3,D\n4,D\n"}
    e = run(spark, tmp_path, "ID,N,A\n1,x,1\n2,y,10\n3,z,2\n4,z,3\n5,q,0\n", "ID,N,A\nA,x,1\nB,y,4\nC,y,6\nD,z,5\n", files=files, checks=[SPEC["checks"][0], match("a", "A", numeric_tolerance=0), match("n", "N")], **WALK)
    c = check(e, "identity-crosswalk-integrity")
    assert (c["metrics"]["one_to_one"], c["metrics"]["one_to_many"], c["metrics"]["many_to_one"], c["metrics"]["unmapped_source"]) == (1, 1, 1, 1)
    assert check(e, "a")["status"] == check(e, "n")["status"] == "passed" and c["status"] == "failed"
    assert check(e, "coverage")["details"][0]["key"].startswith("unmapped-source-")


def test_identity_refuses_many_to_many_and_conflicts(spark, tmp_path):
    with pytest.raises(DataError, match="N:N"):
        run(spark, tmp_path, "ID\n1\n", "ID\nA\n", files={"x.csv": "S,T\n1,A\n1,B\n2,A\n2,B\n"}, **WALK)
    with pytest.raises(DataError, match="differ"):
        run(spark, tmp_path, "ID,N\n1,x\n2,y\n", "ID,N\nA,x\n", files={"x.csv": "S,T\n1,A\n2,A\n"}, checks=[match("n", "N")], **WALK)


def entry(**more):
    return yaml.safe_dump({"version": 1, "exceptions": [{"check": "v", "key": "1", "field": "V", "reason_code": "r", "reason": "why", **more}]})


@pytest.mark.parametrize(("more", "status", "state"), [({"expires": "2026-01-01"}, "passed", "used"), ({"expires": "2025-12-31"}, "failed", "expired"), ({"key": "7"}, "failed", "unused"), ({"field": "W"}, "failed", "unused")])
def test_accepted_exceptions(spark, tmp_path, more, status, state):
    e = run(spark, tmp_path, "ID,V\n1,a\n2,b\n", "ID,V\n1,x\n2,b\n", files={"e.yaml": entry(**more)}, checks=[match()], exceptions={"file": "e.yaml"})
    assert e["status"] == status and len(e["exception_governance"][state]) == 1
    assert check(e, "v")["metrics"]["gross_failures"] == 1


@pytest.mark.parametrize(("policy", "passes"), [({"fields": {"V": {"max_failures": 1}}}, True), ({"fields": {"V": {"critical": True}}}, False), ({"default": {"max_failure_percentage": 40}}, False), ({"default": {"max_absolute_difference": 2}}, True), ({"default": {"max_percentage_difference": 1}}, False)])
def test_materiality(spark, tmp_path, policy, passes):
    e = run(spark, tmp_path, "ID,V\n1,10\n2,20\n", "ID,V\n1,11\n2,20\n", checks=[match(numeric_tolerance=0)], materiality=policy)
    assert (e["status"] == "passed") is passes and check(e, "v")["metrics"]["materiality"]["raw_status"] == "failed"


def test_materiality_spares_automatic_checks(spark, tmp_path):
    assert run(spark, tmp_path, "ID,V\n1,a\n1,a\n", "ID,V\n1,a\n", materiality={"default": {"max_failures": 9}})["status"] == "failed"


MAPPING = {"schema_version": "0.1", "mapping": {"fields": [{"id": "c", "source": {"field": "C"}, "target": {"field": "D"}, "transform": {"type": "lookup", "reference": "m"}}]}, "value_maps": {"m": {"DE": "DEU"}}}


def test_mapping_artifacts(spark, tmp_path):
    parts = {"files": {"m.yaml": yaml.safe_dump(MAPPING)}, "mapping_artifacts": {"a": {"file": "m.yaml"}}}
    c = {"id": "c", "type": "field_match", "source": "C", "target": "D", "map_ref": {"artifact": "a", "field": "c"}}
    assert run(spark, tmp_path, "ID,C\n1,DE\n", "ID,D\n1,DEU\n", checks=[c], **parts)["status"] == "passed"
    with pytest.raises(DataError, match="SHA-256"):
        run(spark, tmp_path, "ID,C\n1,DE\n", "ID,D\n1,DEU\n", checks=[c], files=parts["files"], mapping_artifacts={"a": {"file": "m.yaml", "sha256": "00"}})


def test_sqlite(spark, tmp_path, monkeypatch):
    db = sqlite3.connect(tmp_path / "x.db")
    db.executescript("create table c (ID text, V text, W text); insert into c values ('1', 'a', 'x'), ('2', 'b', 'y')")
    db.commit()
    (tmp_path / "t.csv").write_text("ID,V\n1,a\n")
    monkeypatch.setenv("TESSELLA_CONNECTION_OLD_ERP", f"sqlite:///{tmp_path}/x.db")
    spec = SPEC | {"source": {"key": "ID", "sql": {"connection": "old-erp", "query": "select * from c where W = :w", "params": {"w": "x"}}}, "checks": [match()]}
    e = reconcile(spark, spec, tmp_path)
    assert e["status"] == "passed" and str(tmp_path) not in json.dumps(e["inputs"])
    with pytest.raises(SpecError):
        validate_spec(spec | {"source": {"key": "ID", "sql": {"connection": "x", "query": "delete from c"}}})
    with pytest.raises(Exception, match="max_rows"):
        reconcile(spark, spec | {"source": {"key": "ID", "sql": {"connection": "old-erp", "query": "select * from c", "max_rows": 1}}}, tmp_path)


def stage(name):
    return {"id": name, "endpoint": {"file": f"{name}.csv", "key": "ID"}}


def test_chain_finds_the_first_divergence(spark, tmp_path):
    for name, text in (("a", "ID,V\n1,x\n2,y\n"), ("b", "ID,V\n1,x\n2,q\n"), ("c", "ID,V\n2,z\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    checks = [{"id": "coverage", "type": "record_coverage"}, match()]
    spec = {"version": 1, "pipeline": {"name": "p"}, "stages": [stage("a"), stage("b"), stage("c")], "transitions": [{"id": "ab", "from": "a", "to": "b", "checks": checks}, {"id": "bc", "from": "b", "to": "c", "checks": checks}]}
    e = chain.run_chain(spark, spec, tmp_path)
    assert {(d["first_transition"], d["check_id"]) for d in e["first_divergence"]} == {("ab", "v"), ("bc", "coverage")}
    assert chain.run_chain(spark, spec, tmp_path, first="b")["summary"]["transitions_total"] == 1
    with pytest.raises(SpecError):
        chain.run_chain(spark, spec, tmp_path, first="nowhere")


def test_comparison_of_runs(spark, tmp_path):
    a = run(spark, tmp_path, "ID,V\n1,a\n2,b\n3,c\n", "ID,V\n1,x\n2,y\n3,c\n", checks=[match()])
    b = run(spark, tmp_path, "ID,V\n1,a\n2,b\n3,c\n", "ID,V\n1,x\n2,b\n3,z\n", checks=[match()])
    d = evidence.compared_runs(a, b)
    assert [len(d["discrepancies"][k]) for k in ("new", "resolved", "persistent", "changed")] == [1, 1, 1, 0] and d["summary"]["regression"]
    with pytest.raises(DataError):
        evidence.compared_runs(a, b | {"reconciliation": "other"})


def test_privacy_and_bundle(spark, tmp_path):
    spec = SPEC | {"checks": [match("mail", "MAIL")], "evidence": {"sensitive_fields": ["MAIL"], "sensitive_value_mode": "hash", "key_mode": "hash"}}
    (tmp_path / "s.csv").write_text("ID,MAIL\nkey-77,me@x.org\n")
    (tmp_path / "t.csv").write_text("ID,MAIL\nkey-77,you@x.org\n")
    e = evidence.prepared(reconcile(spark, spec, tmp_path), spec)
    manifest = reports.write_bundle(e, tmp_path / "out")
    assert len(manifest["files"]) == 9
    for f in (tmp_path / "out").rglob("*"):
        if f.is_file():
            text = b"".join(zipfile.ZipFile(f).read(n) for n in zipfile.ZipFile(f).namelist()) if f.suffix == ".xlsx" else f.read_bytes()
            assert b"me@x.org" not in text and b"you@x.org" not in text and b"key-77" not in text, f
    assert "<script" not in reports.html_page(e)


def test_profile_and_first_spec(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CustomerId,Amount,Note,Odd\n1,1.5,,x\n2,2,,1\n")
    (tmp_path / "b.csv").write_text("customer_id,amount,note\n1,1.5,\n2,2,\n")
    p = inspect(read_csv(spark, str(tmp_path / "a.csv")))
    assert {c["name"]: c["inferred_type"] for c in p["columns"]} == {"CustomerId": "integer", "Amount": "number", "Note": "null", "Odd": "mixed"}
    spec, todo = first_spec(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert spec["source"]["key"] == "CustomerId" and len(todo) == 1 and "Odd" in todo[0]
    assert validate_spec(spec)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr("tessella.cli.session", lambda: spark)
    monkeypatch.chdir(tmp_path)
    (tmp_path / "s.csv").write_text("ID\n1\n2\n")
    (tmp_path / "t.csv").write_text("ID\n1\n")
    (tmp_path / "r.yaml").write_text(yaml.safe_dump(SPEC))
    assert main(["validate", "r.yaml"]) == 0 and main(["run", "r.yaml"]) == 1 and main(["run", "r.yaml", "--no-fail-on-diff"]) == 0
    assert main(["validate", "none.yaml"]) == 2 and main(["inspect", "s.csv", "--json"]) == 0
    assert main(["diff", "build/evidence.json", "build/evidence.json"]) == 0
    assert main(["init", "s.csv", "t.csv", "--source-key", "ID", "--target-key", "ID"]) == 0
    assert main(["preflight", "s.csv", "t.csv", "--source-key", "ID", "--target-key", "ID"]) == 0
    assert main(["schema", "spec"]) == 0
    assert all(schemas.schema(k)["type"] == "object" for k in schemas.KINDS)


@pytest.mark.parametrize(
    "change",
    [{"version": 2}, {"checks": []}, {"checks": [{"type": "nope"}]}, {"checks": [match(normalize=["x"])]}, {"checks": [match(scope="none")]}, {"checks": [match(), match()]}, {"source": {"file": "x", "sql": {}, "key": "ID"}}, {"target": {"file": "t.csv", "key": ["A", "B"]}}, {"checks": [match(map={True: "x"})]}, {"materiality": {"default": {"most": 1}}}, {"evidence": {"detail_limit": -1}}, {"children": {"c": {"source": {"file": "x", "key": "A", "parent_key": "B"}, "target": {"file": "x", "key": "A", "parent_key": "A"}, "checks": [match()]}}}],
)
def test_invalid_specs(change):
    with pytest.raises(SpecError):
        validate_spec({**copy.deepcopy(SPEC), **change})


def test_order_and_partitions_change_nothing(spark, tmp_path):
    rows = [(str(i), str(i % 7)) for i in range(50)]
    s = spark.createDataFrame(rows, "ID string, V string")
    t = spark.createDataFrame([(i, v if int(i) % 5 else "x") for i, v in rows[::-1]], "ID string, V string")
    spec = SPEC | {"checks": [match()]}
    (tmp_path / "s.csv").write_text("")
    a = reconcile(spark, spec, tmp_path, frames={"source": s, "target": t})
    b = reconcile(spark, spec, tmp_path, frames={"source": s.repartition(3), "target": t.repartition(5)})
    assert a["checks"] == b["checks"]


def test_chain_tells_the_first_of_all_differences(spark, tmp_path):
    rows = lambda f: "ID,V\n" + "".join(f"{i:04d},{f(i)}\n" for i in range(1000))
    for name, f in (("a", lambda i: "x"), ("b", lambda i: "y" if i < 990 else "x"), ("c", lambda i: "z" if i >= 600 else "y")):
        (tmp_path / f"{name}.csv").write_text(rows(f))
    ends = [{"id": n, "endpoint": {"file": f"{n}.csv", "key": "ID"}} for n in "abc"]
    spec = {"version": 1, "pipeline": {"name": "p"}, "stages": ends, "evidence": {"detail_limit": 10}, "transitions": [{"id": "ab", "from": "a", "to": "b", "checks": [match()]}, {"id": "bc", "from": "b", "to": "c", "checks": [match()]}]}
    e = chain.run_chain(spark, spec, tmp_path)
    assert {d["locator"]["key"]: d["first_transition"] for d in e["first_divergence"]} == {f"{i:04d}": "ab" for i in [*range(10), *range(600, 610)]}
    assert e["summary"]["first_divergences_by_transition"] == {"ab": 990, "bc": 10}


def test_percentages_of_any_size(spark):
    from tessella.functions.compare import within_percentage

    cases = [("10000000", "0.5", "0.00001", True), ("10000000", "1.5", "0.00001", False), ("1000000000000000", "1", "0.0001", True), ("9999999999999999999999999999", "1", "5", True), ("9999999999999999999999999999", "9999999999999999999999999999", "5", False), ("0", "0", "1", True), ("0", "1", "100", False), ("-50", "5", "10", True), ("-50", "5.0000000001", "10", False), ("3", "1", "33.3333333333", False), ("3", "1", "33.3333333334", True)]
    frame = spark.createDataFrame([(s, d) for s, d, *_ in cases], "s string, d string").coalesce(1)
    for k, (s, d, limit, wanted) in enumerate(cases):
        x = frame.where((F.col("s") == s) & (F.col("d") == d)).select(within_percentage(F.col("s").cast("decimal(38,10)"), F.col("d").cast("decimal(38,10)"), limit).alias("x")).first()
        assert x["x"] is wanted, k


def test_large_maps(spark):
    from tessella.functions.values import mapped

    table = {f"k{i}": f"v{i}" for i in range(3000)} | {"é": "accent"}
    frame = spark.createDataFrame([("k7",), ("k2999",), ("é",), ("other",), (None,)], "c string")
    assert [r["m"] for r in frame.select(mapped(F.col("c"), table).alias("m")).collect()] == ["v7", "v2999", "accent", "other", None]


def test_first_rows_are_those_of_the_first_file(spark, tmp_path):
    from tessella.operators.keyed import first_rows, keyed

    for n, text in (("b", "2"), ("a", "1"), ("c", "3")):
        (tmp_path / f"{n}.csv").write_text(f"ID,V\nx,{text}\nx,9\n")
    frame = spark.read.csv(str(tmp_path), header=True)
    assert [r["V"] for r in first_rows(keyed(frame, "ID")).rows.collect()] == ["1"]


def test_stream_compares_the_latest_row(spark, tmp_path):
    from tessella.streaming.continuous import reconcile_stream

    spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("2", "x", 1)], "ID string, V string, at int").write.parquet(str(tmp_path / "in"))
    target, found = spark.createDataFrame([("1", "new"), ("2", "y")], "ID string, V string"), []
    stream = spark.readStream.schema("ID string, V string, at int").parquet(str(tmp_path / "in"))
    query = reconcile_stream(stream, lambda: target, "ID", "ID", match(), lambda rows, n: found.extend(r["__k0"] for r in rows.collect()), str(tmp_path / "at"), "at")
    query.processAllAvailable()
    query.stop()
    assert found == ["2"]


def test_postgres_parameters_and_session():
    from tessella.sources import sql

    query = "select a::int, ':no', \":no\" /* :no */ from t where x = :x and y > :n and z = :b -- :no"
    assert sql.bound(query, {"x": "O'Neil", "n": -1.5, "b": None}) == "select a::int, ':no', \":no\" /* :no */ from t where x = 'O''Neil' and y > (-1.5) and z = NULL -- :no"
    assert sql.literal("a\\b") == "E'a\\\\b'" and sql.literal(True) == "TRUE"
    with pytest.raises(DataError):
        sql.bound("select :missing", {})
    options = sql.postgres_options("postgresql://me:p%40ss@db.example.org/x", "select 1", sql.DEFAULTS | {"timeout_seconds": 1.5})
    assert options["password"] == "p@ss" and "statement_timeout = 1500" in options["sessionInitStatement"] and "read_only = on" in options["sessionInitStatement"]


def test_init_does_not_overwrite_and_asks(spark, tmp_path, monkeypatch, capsys):
    from tessella.cli import main

    for n in "st":
        (tmp_path / f"{n}.csv").write_text("ORDERID,ALT\n1,a\n2,b\n")
        (tmp_path / f"{n}2.csv").write_text("A,B\n1,a\n2,b\n")
    args = ["init", str(tmp_path / "s.csv"), str(tmp_path / "t.csv"), "-o", str(tmp_path / "r.yaml")]
    assert main(args) == 0 and main(args) == 2 and main([*args, "--force"]) == 0 and "key: ORDERID" in (tmp_path / "r.yaml").read_text()
    said = iter(["x", "9", "2", "2"])
    monkeypatch.setattr("builtins.input", lambda _: next(said))
    args = ["init", str(tmp_path / "s2.csv"), str(tmp_path / "t2.csv"), "-o", str(tmp_path / "q.yaml")]
    assert main(args) == 2 and main([*args, "--interactive"]) == 0 and "key: B" in (tmp_path / "q.yaml").read_text()

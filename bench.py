"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed over its whole result. ``reconcile_<rows>`` is a whole run of
a specification with six checks over generated rows, identical on both sides. ``duckdb`` has the warm seconds of each
query's SQL in DuckDB on the same machine, tables and threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.plans import catalog
from tessella.plans.run import reconcile

QUERIES = ("coverage_summary", "coverage_details", "coverage_scoped", "key_integrity_dups", "field_mapped", "field_normalized", "field_numeric_tol", "field_pct_tol", "field_date_tol", "filter_nested", "control_total", "agg_sum", "agg_composite", "child_coverage", "child_orphans", "object_rollup", "identity_components", "identity_merge_split", "exceptions_net", "materiality_gate", "first_divergence", "run_diff", "profile_columns")
ROWS = (100_000, 1_000_000)


def fixture(spark: SparkSession, rows: int):
    """Six columns as a function of the row number."""
    n = F.col("id")
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (n % len(names)).cast("int"))
    return spark.range(rows).select(F.lpad(n.cast("string"), 10, "0").alias("ID"), pick("DE", "AT", "CH", "FR").alias("COUNTRY"), (1000 + n % 20).cast("string").alias("COMPANY_CODE"), (n % 100_000 / F.lit(100)).cast("decimal(18,2)").cast("string").alias("AMOUNT"), pick("Y", "Y", "N").alias("ACTIVE"), F.lit("2026-01-01").alias("LAST_CHANGED"))


SPEC = {
    "version": 1,
    "reconciliation": {"name": "scale"},
    "source": {"file": "generated.csv", "key": "ID"},
    "target": {"file": "generated.csv", "key": "ID"},
    "scopes": {"active": {"source": {"field": "ACTIVE", "value": "Y"}, "target": {"field": "ACTIVE", "value": "Y"}}},
    "checks": [
        {"id": "coverage", "type": "record_coverage"},
        {"id": "country", "type": "field_match", "source": "COUNTRY", "target": "COUNTRY"},
        {"id": "amount", "type": "field_match", "source": "AMOUNT", "target": "AMOUNT", "numeric_tolerance": "0.01", "scope": "active"},
        {"id": "total", "type": "control_total", "source": "AMOUNT", "target": "AMOUNT"},
        {"id": "rows", "type": "aggregate_match", "group_by": {"source": "COMPANY_CODE", "target": "COMPANY_CODE"}},
        {"id": "sums", "type": "aggregate_match", "operation": "sum", "source": "AMOUNT", "target": "AMOUNT", "group_by": {"source": "COMPANY_CODE", "target": "COMPANY_CODE"}},
    ],
    "evidence": {"detail_limit": 10},
}


def beside(sf: str, threads: int) -> dict[str, float]:
    """Warm seconds of the queries' SQL in DuckDB."""
    try:
        import duckdb
    except ModuleNotFoundError:
        return {}
    con, seconds = duckdb.connect(), {}
    con.execute(f"set threads = {threads}")
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in QUERIES:
        for _ in range(2):
            began = time.perf_counter()
            con.execute(f"create or replace temp table timed as {catalog.SQL[name]}")
            seconds[name] = round(time.perf_counter() - began, 3)
    return seconds


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        run()
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)

    for name in QUERIES:
        timed(name, lambda f=catalog.QUERIES[name]: f(spark, sf).write.format("noop").mode("overwrite").save())
    for rows in ROWS:
        at = Path(os.environ.get("BENCH_TMP", "/tmp")) / f"tessella-bench-{os.getpid()}-{rows}"
        fixture(spark, rows).write.parquet(str(at))

        def run(at: Path = at, rows: int = rows) -> None:
            side = spark.read.parquet(str(at))
            found = reconcile(spark, SPEC, frames={"source": side, "target": side})
            if found["status"] != "passed" or found["summary"]["matched_records"] != rows:
                sys.exit(f"the fixture did not pass: {found['summary']}")

        timed(f"reconcile_{rows}", run)
    print(json.dumps({"metric": "total seconds of warm queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf).name, "duckdb": beside(sf, int(cpus))}))


if __name__ == "__main__":
    main()

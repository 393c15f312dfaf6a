"""The catalogue of queries: every operator over datasets derived from the benchmark tables, with its SQL.

Both engines derive the same inputs from the same portable SQL.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import masked_column
from ..functions.predicates import columns_of, compiled
from ..operators import checks, diff, governance, hierarchy, identity, materiality, profile, stages
from ..operators.keyed import Keyed, key_array, keyed

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")
AMOUNT = "cast(o_totalprice as decimal(18,2))"
BALANCE = "cast(s_acctbal as decimal(18,2))"
CREDIT = "cast(c_acctbal as decimal(18,2))"
DRIFT = f"cast({CREDIT} - case when c_custkey % 31 = 0 then 10.00 else 0.00 end as decimal(18,2)) as amount from customer"

#: Source and target pairs of a migration with planted differences.
DATA = {
    "orders_old": f"select lpad(cast(o_orderkey as string), 10, '0') as order_id, o_custkey as cust_id, o_orderstatus as status, {AMOUNT} as amount, o_orderpriority as priority, o_orderdate as order_date from orders",
    "orders_new": f"""select cast(o_orderkey as string) as legacy_id, o_custkey as cust_id,
 case when o_orderkey % 67 = 5 then 'OPEN' when o_orderstatus = 'O' then 'OPEN' when o_orderstatus = 'F' then 'FILLED' else 'PARTIAL' end as status_code,
 cast({AMOUNT} + case when o_orderkey % 53 = 0 then 0.01 when o_orderkey % 59 = 0 then 5.00 else 0.00 end as decimal(18,2)) as amount,
 case when o_orderkey % 79 = 0 then null when o_orderkey % 83 = 0 then '' when o_orderkey % 61 = 0 then concat(' ', lower(o_orderpriority), ' ') else o_orderpriority end as priority,
 case when o_orderkey % 73 = 0 then o_orderdate + interval '10' day when o_orderkey % 71 = 0 then o_orderdate + interval '1' day else o_orderdate end as order_date
 from orders where o_orderkey % 101 <> 7
 union all select cast(o_orderkey + 10000000 as string), o_custkey, 'OPEN', {AMOUNT}, o_orderpriority, o_orderdate from orders where o_orderkey % 211 = 3""",
    "docs_old": "select cast(doc_id as string) as doc_id, lang, source, n_chars from documents",
    "docs_new": "select cast(doc_id as string) as doc_id, quality, toxic from labels",
    "root_old": "select cast(c_custkey as string) as cust_id, c_name as name, c_mktsegment as segment from customer",
    "root_new": "select cast(c_custkey as string) as bp_id, c_name as name, case when c_custkey % 41 = 0 then 'OTHER' else c_mktsegment end as segment from customer where c_custkey % 97 <> 5",
    "child_old": "select cast(o_custkey as string) as cust_id, cast(o_orderkey as string) as order_id, o_orderpriority as priority from orders",
    "child_new": "select cast(o_custkey as string) as bp_id, cast(o_orderkey as string) as order_id, case when o_orderkey % 89 = 0 then '9-CHANGED' else o_orderpriority end as priority from orders where o_orderkey % 101 <> 7",
    "supp_old": f"select cast(s_suppkey as string) as supp_id, cast(s_nationkey as string) as nation, {BALANCE} as balance from supplier",
    "walk": """select cast(s_suppkey as string) as source_id, concat('T', cast(s_suppkey as string), 'A') as target_id from supplier where s_suppkey % 10 = 0
 union all select cast(s_suppkey as string), concat('T', cast(s_suppkey as string), 'B') from supplier where s_suppkey % 10 = 0
 union all select cast(s_suppkey as string), concat('M', cast(cast(floor(s_suppkey / 10) as bigint) as string)) from supplier where s_suppkey % 10 in (1, 2)
 union all select cast(s_suppkey as string), concat('T', cast(s_suppkey as string)) from supplier where s_suppkey % 10 between 3 and 8
 union all select '99999999', 'T99999999'""",
    "supp_new": f"""select concat('T', cast(s_suppkey as string), 'A') as bp_id, cast(s_nationkey as string) as nation, cast({BALANCE} - 10.00 as decimal(18,2)) as balance from supplier where s_suppkey % 10 = 0
 union all select concat('T', cast(s_suppkey as string), 'B'), cast(s_nationkey as string), cast(10.00 as decimal(18,2)) from supplier where s_suppkey % 10 = 0
 union all select concat('M', cast(cast(floor(s_suppkey / 10) as bigint) as string)), max(cast(s_nationkey as string)), cast(sum({BALANCE}) as decimal(18,2)) from supplier where s_suppkey % 10 in (1, 2) group by cast(floor(s_suppkey / 10) as bigint)
 union all select concat('T', cast(s_suppkey as string)), cast(s_nationkey as string), cast({BALANCE} + case when s_suppkey % 7 = 0 then 1.00 else 0.00 end as decimal(18,2)) from supplier where s_suppkey % 10 between 3 and 8""",
    "stage_source": f"select cast(c_custkey as string) as id, c_mktsegment as segment, {CREDIT} as amount from customer",
    "stage_extract": f"select cast(c_custkey as string) as id, c_mktsegment as segment, {CREDIT} as amount from customer",
    "stage_transformed": f"select cast(c_custkey as string) as id, substr(c_mktsegment, 1, 3) as segment_code, {DRIFT}",
    "stage_target": f"select cast(c_custkey as string) as id, substr(c_mktsegment, 1, 3) as segment_code, {DRIFT} where c_custkey % 37 <> 0",
    "run_before": "select concat('amount:', cast(o_orderkey as string)) as identity, cast(1 as double) as content from orders where o_orderkey % 59 = 0",
    "run_after": "select concat('amount:', cast(o_orderkey as string)) as identity, cast(case when o_orderkey % 177 = 0 then 2 else 1 end as double) as content from orders where o_orderkey % 118 = 0 or o_orderkey % 177 = 0 or o_orderkey % 83 = 0",
    "entries": "select cast(o_orderkey as int) as entry, 'amount' as check_id, 'key' as ref_kind, cast(o_orderkey as string) as ref_key, case when o_orderkey % 118 = 0 then 'amount' end as field, cast(case when o_orderkey % 236 = 0 then '2020-01-01' else '2099-01-01' end as date) as expires from orders where o_orderkey % 118 = 0 or o_orderkey % 1000 = 1",
}
STATUS = {"O": "OPEN", "F": "FILLED", "P": "PARTIAL"}
CHAIN = ["trim", "strip_leading_zeros"]
TODAY = datetime.date(2026, 1, 1)


def data(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived datasets."""
    for t in TABLES:
        if t in DATA[name]:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(DATA[name])


def orders(spark: SparkSession, sf_dir: str) -> tuple[Keyed, Keyed]:
    return keyed(data(spark, sf_dir, "orders_old"), "order_id", CHAIN), keyed(data(spark, sf_dir, "orders_new"), "legacy_id", CHAIN, "target")


def sides(spark: SparkSession, sf_dir: str, a: str, key: str | list[str], b: str, target_key: str | list[str]) -> tuple[Keyed, Keyed]:
    return keyed(data(spark, sf_dir, a), key), keyed(data(spark, sf_dir, b), target_key, side="target")


def doubles(frame: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and timestamps left out of results by their queries."""
    return frame.withColumns({c: F.col(c).cast("double") for c, t in frame.dtypes if t.startswith("decimal")})


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str) -> Callable[[Query], Query]:
    """Files a query under its name with the SQL it must agree with; ``{x}`` in the SQL is dataset x."""
    for n, text in DATA.items():
        sql = sql.replace("{" + n + "}", f"({text})")
    SQL[name] = sql

    def put(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return put


def norm(c: str) -> str:
    return f"case when regexp_full_match(trim({c}), '-?[0-9]+') then regexp_replace(trim({c}), '^(-?)0+([0-9])', '\\1\\2') else trim({c}) end"


PAIR = f"with s as (select {norm('order_id')} as key, * from {{orders_old}}), t as (select {norm('legacy_id')} as key, * from {{orders_new}}), p as (select s.key as key, s.cust_id as cust_s, t.cust_id as cust_t, s.status as status_s, t.status_code as status_t, s.amount as amount_s, t.amount as amount_t, s.priority as priority_s, t.priority as priority_t, s.order_date as date_s, t.order_date as date_t from s join t on s.key = t.key) "


@register("coverage_summary", f"{PAIR} select count(*) filter (s.one = 1 and t.one = 1) as matched, count(*) filter (t.one is null) as missing_in_target, count(*) filter (s.one is null) as unexpected_in_target from (select distinct key, 1 as one from s) s full outer join (select distinct key, 1 as one from t) t on s.key = t.key")
def coverage_summary(spark, sf_dir):
    return checks.coverage_counts(*orders(spark, sf_dir))


@register("coverage_details", f"{PAIR} select key, 'missing_in_target' as difference from s where key not in (select key from t) union all select key, 'unexpected_in_target' from t where key not in (select key from s)")
def coverage_details(spark, sf_dir):
    return checks.coverage(*orders(spark, sf_dir)).withColumnRenamed("__k0", "key")


@register("coverage_scoped", f"{PAIR}, a as (select distinct key from s where status = 'O' and amount > 100000), b as (select distinct key from t where status_code = 'OPEN' and amount > 100000) select (select count(*) from a where key in (select key from b)) as matched, (select count(*) from a where key not in (select key from b)) as missing_in_target, (select count(*) from b where key not in (select key from a)) as unexpected_in_target")
def coverage_scoped(spark, sf_dir):
    s, t = orders(spark, sf_dir)
    big = {"field": "amount", "op": "gt", "value": 100000}
    s = s.flagged({"in": compiled({"all": [{"field": "status", "value": "O"}, big]}, s.column)})
    t = t.flagged({"in": compiled({"all": [{"field": "status_code", "value": "OPEN"}, big]}, t.column)})
    return checks.coverage_counts(s, t, "in")


@register("coverage_documents", "with s as {docs_old}, t as {docs_new} select doc_id as key, 'missing_in_target' as difference from s where doc_id not in (select doc_id from t) union all select doc_id, 'unexpected_in_target' from t where doc_id not in (select doc_id from s)")
def coverage_documents(spark, sf_dir):
    return checks.coverage(*sides(spark, sf_dir, "docs_old", "doc_id", "docs_new", "doc_id")).withColumnRenamed("__k0", "key")


@register("key_integrity_dups", "select cast(l_orderkey as string) as k0, cast(l_linenumber as string) as k1, count(*) - 1 as extra_rows from lineitem group by all having count(*) > 1")
def key_integrity_dups(spark, sf_dir):
    side = keyed(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return checks.key_integrity(side).withColumnsRenamed({"__k0": "k0", "__k1": "k1"})


@register("key_integrity_clean", "select cast(conv_id as string) as k0, cast(turn as string) as k1, count(*) - 1 as extra_rows from conversations group by all having count(*) > 1")
def key_integrity_clean(spark, sf_dir):
    side = keyed(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn"), ["conv_id", "turn"])
    return checks.key_integrity(side).withColumnsRenamed({"__k0": "k0", "__k1": "k1"})


def field(name: str, check: dict, columns: list[str], sql: str) -> None:
    """A field check whose result is its mismatches."""

    @register(name, f"{PAIR} {sql}")
    def query(spark, sf_dir):
        s, t = orders(spark, sf_dir)
        return checks.mismatches(s, t, check, unique=True).withColumnRenamed("__k0", "key").select("key", *columns)


VALUES, PLAIN = ["source", "target"], ["normalized_source", "normalized_target"]
DIFF = "cast(abs(amount_s - amount_t) as double)"
PERCENT = f"case when amount_s = amount_t then 0.0 when amount_s = 0 then null else {DIFF} / cast(abs(amount_s) as double) * 100 end"
field("field_exact", {"source": "status", "target": "status_code"}, VALUES, "select key, status_s as source, status_t as target from p where status_s <> status_t")
field("field_mapped", {"source": "status", "target": "status_code", "map": STATUS}, PLAIN, "select * from (select key, case status_s when 'O' then 'OPEN' when 'F' then 'FILLED' when 'P' then 'PARTIAL' else status_s end as normalized_source, status_t as normalized_target from p) where normalized_source <> normalized_target")
field("field_normalized", {"source": "priority", "target": "priority", "normalize": ["trim", "uppercase"]}, PLAIN, "select * from (select key, upper(trim(priority_s)) as normalized_source, upper(trim(priority_t)) as normalized_target from p) where normalized_source is distinct from normalized_target")
field("field_lowercase", {"source": "priority", "target": "priority", "normalize": ["lowercase", "trim", "empty_to_null"]}, PLAIN, "select * from (select key, nullif(trim(lower(priority_s)), '') as normalized_source, nullif(trim(lower(priority_t)), '') as normalized_target from p) where normalized_source is distinct from normalized_target")
field("field_numeric_tol", {"source": "amount", "target": "amount", "numeric_tolerance": "0.01"}, ["absolute_difference"], f"select key, {DIFF} as absolute_difference from p where abs(amount_s - amount_t) > 0.01")
field("field_pct_tol", {"source": "amount", "target": "amount", "percentage_tolerance": "0.01"}, ["absolute_difference", "percentage_difference"], f"select key, {DIFF} as absolute_difference, {PERCENT} as percentage_difference from p where abs(amount_s - amount_t) * 100 > 0.01 * abs(amount_s)")
field("field_both_tol", {"source": "amount", "target": "amount", "numeric_tolerance": 1, "percentage_tolerance": "0.01"}, ["absolute_difference", "percentage_difference"], f"select key, {DIFF} as absolute_difference, {PERCENT} as percentage_difference from p where abs(amount_s - amount_t) * 100 > 0.01 * abs(amount_s) and abs(amount_s - amount_t) > 1")
field("field_pct_small_limit", {"source": "amount", "target": "amount", "percentage_tolerance": "0.00001"}, ["absolute_difference"], f"select key, {DIFF} as absolute_difference from p where abs(amount_s - amount_t) * 100 > 0.00001 * abs(amount_s)")
field("field_date_tol", {"source": "order_date", "target": "order_date", "date_tolerance_days": 1}, ["absolute_difference"], "select key, abs(epoch(cast(date_s as timestamp)) - epoch(cast(date_t as timestamp))) / 86400.0 as absolute_difference from p where abs(epoch(cast(date_s as timestamp)) - epoch(cast(date_t as timestamp))) > 86400")
field("field_nulls_equal", {"source": "priority", "target": "priority"}, PLAIN, "select * from (select key, trim(priority_s) as normalized_source, trim(priority_t) as normalized_target from p) where normalized_source is distinct from normalized_target")
field("field_nulls_empty_is_null", {"source": "priority", "target": "priority", "null_semantics": "empty_is_null"}, PLAIN, "select * from (select key, nullif(trim(priority_s), '') as normalized_source, nullif(trim(priority_t), '') as normalized_target from p) where normalized_source is distinct from normalized_target")
field("field_nulls_never_equal", {"source": "priority", "target": "priority", "null_semantics": "never_equal"}, PLAIN, "select * from (select key, trim(priority_s) as normalized_source, trim(priority_t) as normalized_target from p) where normalized_source is distinct from normalized_target or coalesce(normalized_source, '') = '' or coalesce(normalized_target, '') = ''")


@register("field_pct_large_values", f"{PAIR} select key from p where abs(amount_s - amount_t) * 100 > 0.000001 * abs(cast(amount_s as decimal(18,2)) + 1000000000000000)")
def field_pct_large_values(spark, sf_dir):
    """Sixteen digits before the point, and a limit of a millionth of a per cent."""
    s, t = orders(spark, sf_dir)
    s, t = (Keyed(x.rows.withColumn("amount", x.rows["amount"].cast("decimal(18,2)") + F.lit("1000000000000000").cast("decimal(16,0)")), x.width, x.side, x.flags) for x in (s, t))
    return checks.mismatches(s, t, {"source": "amount", "target": "amount", "percentage_tolerance": "0.000001"}, unique=True).select(F.col("__k0").alias("key"))


@register("field_max_mismatches", f"{PAIR} select count(*) as compared, count(*) filter (abs(amount_s - amount_t) > 0.01) as mismatches, count(*) filter (abs(amount_s - amount_t) > 0.01) <= 300 as passed from p")
def field_max_mismatches(spark, sf_dir):
    s, t = orders(spark, sf_dir)
    both = checks.field_pairs(s, t, {"source": "amount", "target": "amount", "numeric_tolerance": "0.01"}, unique=True)
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("equal")).alias("mismatches")).withColumn("passed", F.col("mismatches") <= 300)


@register("field_conditional", f"{PAIR} select key, cast(amount_s as double) as source, cast(amount_t as double) as target from p where status_s = 'O' and status_t = 'OPEN' and amount_s <> amount_t")
def field_conditional(spark, sf_dir):
    s, t = orders(spark, sf_dir)
    s = s.flagged({"in": compiled({"field": "status", "value": "O"}, s.column)})
    t = t.flagged({"in": compiled({"field": "status_code", "value": "OPEN"}, t.column)})
    out = checks.mismatches(s, t, {"source": "amount", "target": "amount", "numeric_tolerance": 0}, "in", unique=True)
    return out.select(F.col("__k0").alias("key"), F.col("source").cast("double").alias("source"), F.col("target").cast("double").alias("target"))


def filtered(name: str, dataset: str, key: str, predicate: dict, where: str) -> None:
    """A predicate, as the keys it leaves."""

    @register(name, f"select {key} as key from {{{dataset}}} where {where}")
    def query(spark, sf_dir):
        frame = data(spark, sf_dir, dataset)
        return frame.where(compiled(predicate, columns_of(frame, dataset))).select(F.col(key).alias("key"))


for op, value, where in (
    ("eq", "O", "status = 'O'"),
    ("ne", "O", "status <> 'O'"),
    ("in", ["O", "P"], "status in ('O', 'P')"),
    ("not_in", ["O", "P"], "status not in ('O', 'P')"),
):
    filtered(f"filter_ops_{op}", "orders_old", "order_id", {"field": "status", "op": op, "value": value}, where)
filtered("filter_ops_contains", "orders_old", "order_id", {"field": "priority", "op": "contains", "value": "URG"}, "contains(priority, 'URG')")
filtered("filter_ops_starts_with", "orders_old", "order_id", {"field": "priority", "op": "starts_with", "value": "1-"}, "starts_with(priority, '1-')")
filtered("filter_ops_is_null", "orders_new", "legacy_id", {"field": "priority", "op": "is_null"}, "priority is null or trim(priority) = ''")
filtered("filter_ops_not_null", "orders_new", "legacy_id", {"field": "priority", "op": "not_null"}, "trim(priority) <> ''")
for op, sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    filtered(f"filter_ops_{op}", "orders_old", "order_id", {"field": "amount", "op": op, "value": 100000}, f"amount {sign} 100000")
filtered("filter_ops_date", "orders_old", "order_id", {"field": "order_date", "op": "lt", "value": "1996-06-01"}, "order_date < timestamp '1996-06-01'")
filtered("filter_nested", "orders_new", "legacy_id", {"any": [{"all": [{"field": "status_code", "value": "OPEN"}, {"not": {"field": "priority", "op": "in", "value": ["1-URGENT", "2-HIGH"]}}]}, {"field": "amount", "op": "lt", "value": 2000}]}, "(status_code = 'OPEN' and coalesce(trim(priority) not in ('1-URGENT', '2-HIGH'), true)) or amount < 2000")


@register("control_total", "select cast(a as double) as source_total, cast(b as double) as target_total, cast(abs(a - b) as double) as absolute_difference, 0 as bad from (select sum(amount) as a from {orders_old}), (select sum(amount) as b from {orders_new})")
def control_total(spark, sf_dir):
    return doubles(checks.control_total(*orders(spark, sf_dir), {"source": "amount", "target": "amount"}))


@register("row_count", "select a as source_rows, b as target_rows, abs(a - b) as absolute_difference from (select count(*) as a from {orders_old}), (select count(*) as b from {orders_new})")
def row_count(spark, sf_dir):
    return checks.row_count(*orders(spark, sf_dir))


def grouped(name: str, check: dict, by: list[str], value: str, passed: str) -> None:
    """A grouped check, as all its groups."""
    keys = ", ".join(f"coalesce(trim(cast({b} as varchar)), '') as g{i}" for i, b in enumerate(by))
    g = ", ".join(f"g{i}" for i in range(len(by)))
    sql = f"with s as (select {keys}, {value} as v from {{orders_old}} group by {', '.join(str(i + 1) for i in range(len(by)))}), t as (select {keys}, {value} as v from {{orders_new}} group by {', '.join(str(i + 1) for i in range(len(by)))}), b as (select {g}, coalesce(s.v, 0) as a, coalesce(t.v, 0) as b from s full outer join t using ({g})) select {g}, cast(a as double) as source_value, cast(b as double) as target_value, cast(abs(a - b) as double) as absolute_difference, case when a = b then 0.0 when a = 0 then null else cast(abs(a - b) as double) / cast(abs(a) as double) * 100 end as percentage_difference, {passed} as passed from b"

    @register(name, sql)
    def query(spark, sf_dir):
        return doubles(checks.aggregate_match(*orders(spark, sf_dir), {"group_by": {"source": by, "target": by}, **check}).drop("bad"))


MONEY = {"operation": "sum", "source": "amount", "target": "amount"}
grouped("agg_count", {"operation": "count"}, ["priority"], "count(*)", "a = b")
grouped("agg_distinct", {"operation": "distinct_count", "source": "cust_id", "target": "cust_id", "tolerance": 5}, ["priority"], "count(distinct cust_id)", "abs(a - b) <= 5")
grouped("agg_sum", {**MONEY, "tolerance": 100}, ["priority"], "sum(amount)", "abs(a - b) <= 100")
grouped("agg_composite", {**MONEY, "tolerance": "0.01"}, ["priority", "cust_id"], "sum(amount)", "abs(a - b) <= 0.01")
grouped("agg_pct", {**MONEY, "percentage_tolerance": "0.5"}, ["cust_id"], "sum(amount)", "abs(a - b) <= 0 or (a <> 0 and abs(a - b) * 100 <= 0.5 * abs(a))")

CHILD = "with s as {child_old}, t as {child_new}, r as {root_old}, q as {root_new} "


def children(spark, sf_dir):
    return sides(spark, sf_dir, "child_old", ["cust_id", "order_id"], "child_new", ["bp_id", "order_id"])


@register("child_coverage", f"{CHILD} select s.cust_id as parent, s.order_id as child, 'missing_in_target' as difference from s left join t on s.cust_id = t.bp_id and s.order_id = t.order_id where t.order_id is null")
def child_coverage(spark, sf_dir):
    return checks.coverage(*children(spark, sf_dir)).withColumnsRenamed({"__k0": "parent", "__k1": "child"})


@register("child_field", f"{CHILD} select s.cust_id as parent, s.order_id as child, s.priority as source, t.priority as target from s join t on s.cust_id = t.bp_id and s.order_id = t.order_id where s.priority <> t.priority")
def child_field(spark, sf_dir):
    return checks.mismatches(*children(spark, sf_dir), {"source": "priority", "target": "priority"}).select(F.col("__k0").alias("parent"), F.col("__k1").alias("child"), "source", "target")


@register("child_orphans", f"{CHILD} select bp_id as parent, order_id as child from t where bp_id not in (select bp_id from q)")
def child_orphans(spark, sf_dir):
    roots = keyed(data(spark, sf_dir, "root_new"), "bp_id", side="target")
    return hierarchy.orphans(children(spark, sf_dir)[1], "bp_id", roots).select(F.col("p0").alias("parent"), F.col("__k1").alias("child"))


ROLL = f"""{CHILD}, f as (
 select cust_id as object, 'coverage' as check_id, concat('Customer/', cust_id) as path from r where cust_id not in (select bp_id from q)
 union all select r.cust_id, 'segment', concat('Customer/', r.cust_id) from r join q on r.cust_id = q.bp_id where r.segment <> q.segment
 union all select s.cust_id, 'child:orders:coverage', concat('Customer/', s.cust_id, '/orders/', s.cust_id, '/', s.order_id) from s left join t on s.cust_id = t.bp_id and s.order_id = t.order_id where t.order_id is null
 union all select bp_id, 'child:orders:target-parent-integrity', concat('Customer/', bp_id, '/orders/', bp_id, '/', order_id) from t where bp_id not in (select bp_id from q))
 select object, array_to_string(list_sort(list(distinct check_id)), ',') as failed_checks, array_to_string(list_sort(list(distinct path)), ',') as paths from f group by object"""


@register("object_rollup", ROLL)
def object_rollup(spark, sf_dir):
    s, t = sides(spark, sf_dir, "root_old", "cust_id", "root_new", "bp_id")
    a, b = children(spark, sf_dir)
    own = lambda frame, check: frame.select(F.array("__k0").alias("object"), F.lit(check).alias("check_id"), hierarchy.object_path("Customer", ["__k0"], "", []).alias("path"))
    child = lambda frame, check: frame.select(F.array("__k0").alias("object"), F.lit(check).alias("check_id"), hierarchy.object_path("Customer", ["__k0"], "orders", ["__k0", "__k1"]).alias("path"))
    parts = [own(checks.coverage(s, t), "coverage"), own(checks.mismatches(s, t, {"source": "segment", "target": "segment"}), "segment"), child(checks.coverage(a, b), "child:orders:coverage"), child(hierarchy.orphans(b, "bp_id", t), "child:orders:target-parent-integrity")]
    every = parts[0].unionByName(parts[1]).withColumn("path", F.regexp_replace("path", "/$", "")).unionByName(parts[2]).unionByName(parts[3])
    rolled = hierarchy.roll_up(every)
    return rolled.select(F.get("object", F.lit(0)).alias("object"), F.array_join("failed_checks", ",").alias("failed_checks"), F.array_join("paths", ",").alias("paths"))


GRAPH = "with w as {walk}, d as (select *, count(*) over (partition by source_id) as ds, count(*) over (partition by target_id) as dt from w), c as (select case when ds > 1 then concat('s', source_id) else concat('t', target_id) end as hub, * from d), g as (select hub, case when count(distinct source_id) > 1 then 'N:1' when count(distinct target_id) > 1 then '1:N' else '1:1' end as mode, array_to_string(list_sort(list(distinct source_id)), '|') as source_keys, array_to_string(list_sort(list(distinct target_id)), '|') as target_keys from c group by hub) "


def crosswalk(spark, sf_dir):
    return identity.components(identity.edges(data(spark, sf_dir, "walk"), "source_id", "target_id"))


def joined_keys(c: str):
    return F.array_join(F.flatten(c), "|")


@register("identity_components", f"{GRAPH} select mode, source_keys, target_keys from g")
def identity_components(spark, sf_dir):
    return crosswalk(spark, sf_dir).select("mode", joined_keys("source_keys").alias("source_keys"), joined_keys("target_keys").alias("target_keys"))


@register("identity_faults", "select source_id as source, target_id as target, 'N:N component' as fault from (select *, count(*) over (partition by source_id) as ds, count(*) over (partition by target_id) as dt from (select distinct cast(o_custkey as string) as source_id, o_orderpriority as target_id from orders)) where ds > 1 and dt > 1")
def identity_faults(spark, sf_dir):
    links = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_custkey as string) as a", "o_orderpriority as b").distinct()
    return identity.faults(identity.edges(links, "a", "b")).select(F.get("s", F.lit(0)).alias("source"), F.get("t", F.lit(0)).alias("target"), "fault")


def merged(spark, sf_dir, side, dataset, key):
    rows = keyed(data(spark, sf_dir, dataset), key, side=side)
    found = identity.attached(rows.rows, key_array(1), identity.members(crosswalk(spark, sf_dir), side), side).drop("__k0")
    return identity.merge(found, [key], {"balance": "sum", "nation": "max"}, {"balance", "nation"})


@register("identity_merge_split", f"{GRAPH}, a as (select c.hub, max(o.nation) as nation, sum(o.balance) as balance, array_to_string(list_sort(list(distinct o.supp_id)), '|') as keys from {{supp_old}} o join (select distinct hub, source_id from c) c on o.supp_id = c.source_id group by c.hub), b as (select c.hub, max(o.nation) as nation, sum(o.balance) as balance, array_to_string(list_sort(list(distinct o.bp_id)), '|') as keys from {{supp_new}} o join (select distinct hub, target_id from c) c on o.bp_id = c.target_id group by c.hub) select a.keys as source_keys, b.keys as target_keys, a.nation as source_nation, b.nation as target_nation, cast(a.balance as double) as source_balance, cast(b.balance as double) as target_balance from a join b using (hub)")
def identity_merge_split(spark, sf_dir):
    a = merged(spark, sf_dir, "source", "supp_old", "supp_id").select("component", F.col("supp_id").alias("source_keys"), F.col("nation").alias("source_nation"), F.col("balance").cast("double").alias("source_balance"))
    b = merged(spark, sf_dir, "target", "supp_new", "bp_id").select("component", F.col("bp_id").alias("target_keys"), F.col("nation").alias("target_nation"), F.col("balance").cast("double").alias("target_balance"))
    return a.join(b, "component").drop("component")


@register("identity_unmapped", "select supp_id as key, 'unmapped_source_identity' as difference from {supp_old} where supp_id not in (select source_id from {walk})")
def identity_unmapped(spark, sf_dir):
    rows = keyed(data(spark, sf_dir, "supp_old"), "supp_id")
    found = identity.attached(rows.rows, key_array(1), identity.members(crosswalk(spark, sf_dir), "source"), "source")
    return found.where("unmapped").select(F.col("supp_id").alias("key"), F.lit("unmapped_source_identity").alias("difference"))


@register("identity_unused", "select distinct source_id as key from {walk} where source_id not in (select supp_id from {supp_old})")
def identity_unused(spark, sf_dir):
    member = identity.members(crosswalk(spark, sf_dir), "source")
    return identity.unused(member, keyed(data(spark, sf_dir, "supp_old"), "supp_id")).select(F.get("key", F.lit(0)).alias("key"))


ACCEPT = f"{PAIR}, e as {{entries}}, x as (select key from p where abs(amount_s - amount_t) > 0.01), m as (select x.key, e.entry from x left join (select * from e where expires >= date '2026-01-01') e on e.ref_key = x.key and (e.field is null or e.field = 'amount')) "


def accepted(spark, sf_dir):
    s, t = orders(spark, sf_dir)
    off = checks.mismatches(s, t, {"source": "amount", "target": "amount", "numeric_tolerance": "0.01"}, unique=True)
    off = off.select(F.lit("amount").alias("check_id"), F.lit("key").alias("ref_kind"), F.array("__k0").alias("ref"), F.lit("mismatch").alias("kind"), F.lit("amount").alias("source_field"), F.lit("amount").alias("target_field"))
    entries = data(spark, sf_dir, "entries").withColumn("ref", F.array("ref_key")).drop("ref_key")
    return entries, governance.matched(off, entries, TODAY)


@register("exceptions_net", f"{ACCEPT} select 'amount' as check_id, count(*) as gross_failures, count(entry) as accepted_exceptions, count(*) - count(entry) as unaccepted_failures from m")
def exceptions_net(spark, sf_dir):
    return governance.net(accepted(spark, sf_dir)[1])


@register("exceptions_unused", f"{ACCEPT} select entry, 'unused' as status from e where expires >= date '2026-01-01' and entry not in (select entry from m where entry is not null)")
def exceptions_unused(spark, sf_dir):
    return governance.standing(*accepted(spark, sf_dir), TODAY).where("status = 'unused'").select("entry", "status")


@register("exceptions_expired", f"{ACCEPT} select entry, 'expired' as status from e where expires < date '2026-01-01'")
def exceptions_expired(spark, sf_dir):
    return governance.standing(*accepted(spark, sf_dir), TODAY).where("status = 'expired'").select("entry", "status")


@register("materiality_gate", f"{PAIR}, m as (select 'amount' as check_id, count(*) filter (amount_s <> amount_t) as failures, count(*) as n, max(cast(abs(amount_s - amount_t) as double)) as most from p union all select 'status', count(*) filter (status_s <> substr(status_t, 1, 1)), count(*), null from p union all select 'priority', count(*) filter (priority_s is distinct from priority_t), count(*), null from p) select check_id, failures, n as denominator, case check_id when 'amount' then case when failures * 100.0 / n <= 5 and most <= 5 then 'passed' else 'failed' end when 'status' then case when failures > 0 then 'failed' else 'passed' end else case when failures <= 10 then 'passed' else 'failed' end end as status from m")
def materiality_gate(spark, sf_dir):
    s, t = orders(spark, sf_dir)
    found = [("amount", {"source": "amount", "target": "amount", "numeric_tolerance": 0}), ("status", {"source": "status", "target": "status_code", "map": STATUS}), ("priority", {"source": "priority", "target": "priority"})]
    rows = None
    for name, check in found:
        both = checks.field_pairs(s, t, check, unique=True)
        equal = F.col("source").eqNullSafe(F.col("target")) if name == "priority" else F.col("equal")
        m = both.agg(F.count_if(~equal).alias("failures"), F.count(F.lit(1)).alias("denominator"), F.max(F.when(~equal, F.col("absolute_difference"))).alias("max_absolute")).withColumns({"check_id": F.lit(name), "raw_status": F.when(F.col("failures") > 0, "failed").otherwise("passed"), "max_percentage": F.lit(None).cast("double")})
        rows = m if rows is None else rows.unionByName(m)
    policies = spark.createDataFrame([("amount", False, None, 5.0, 5.0, None), ("status", True, None, None, None, None), ("priority", False, 10, None, None, None)], "check_id string, critical boolean, max_failures bigint, max_failure_percentage double, max_absolute_difference double, max_percentage_difference double")
    return materiality.gated(rows, policies).select("check_id", "failures", "denominator", "status")


@register("first_divergence", "with a as {stage_extract}, b as {stage_transformed}, c as {stage_target}, x as (select a.id as key, 1 as step from a join b on a.id = b.id where a.amount <> b.amount union all select b.id, 2 from b where id not in (select id from c)) select key, case min(step) when 1 then 'extract-to-transformed' else 'transformed-to-target' end as first_transition, min(step) as transition_index, count(distinct step) as transitions from x group by key")
def first_divergence(spark, sf_dir):
    names = ("source", "extract", "transformed", "target")
    frames = {n: data(spark, sf_dir, f"stage_{n}") for n in names}
    edges = []
    for a, b in zip(names, names[1:], strict=False):
        s, t = keyed(frames[a], "id"), keyed(frames[b], "id", side="target")
        amount = checks.mismatches(s, t, {"source": "amount", "target": "amount", "numeric_tolerance": 0})
        edges.append((f"{a}-to-{b}", checks.coverage(s, t).select(F.col("__k0").alias("key")).unionByName(amount.select(F.col("__k0").alias("key")))))
    return stages.first_divergence(edges, ["key"])


@register("run_diff", "select coalesce(a.identity, b.identity) as identity, case when a.identity is null then 'new' when b.identity is null then 'resolved' when a.content = b.content then 'persistent' else 'changed' end as class from {run_before} a full outer join {run_after} b on a.identity = b.identity")
def run_diff(spark, sf_dir):
    return diff.classified(data(spark, sf_dir, "run_before"), data(spark, sf_dir, "run_after")).select("identity", "class")


@register("check_transitions", "with b as (select n_name as check_id, case when n_nationkey % 3 = 0 then 'failed' else 'passed' end as status from nation where n_nationkey % 7 <> 0), c as (select n_name as check_id, case when n_nationkey % 2 = 0 then 'failed' else 'passed' end as status from nation where n_nationkey % 5 <> 0) select coalesce(b.check_id, c.check_id) as check_id, b.status as baseline_status, c.status as current_status, case when b.status is null then 'added' when c.status is null then 'removed' when b.status = c.status then 'unchanged' when c.status = 'failed' then 'regressed' else 'improved' end as transition from b full outer join c on b.check_id = c.check_id")
def check_transitions(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    state = lambda by: F.when(F.col("n_nationkey") % by == 0, "failed").otherwise("passed").alias("status")
    b = n.where("n_nationkey % 7 <> 0").select(F.col("n_name").alias("check_id"), state(3), F.lit("error").alias("severity"))
    c = n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("check_id"), state(2), F.lit("error").alias("severity"))
    return diff.transitions(b, c)


PROFILE = {"legacy_id": "integer", "status_code": "string", "amount": "number", "priority": "string"}


@register("profile_columns", " union all ".join(f"select '{f}' as field, count(*) as rows, count(*) filter ({f} is null or trim(cast({f} as varchar)) = '') as nulls, cast(count(*) filter ({f} is null or trim(cast({f} as varchar)) = '') as double) / count(*) as null_rate, count(distinct nullif(cast({f} as varchar), '')) as \"distinct\", '{k}' as inferred_type from {{orders_new}}" for f, k in PROFILE.items()))
def profile_columns(spark, sf_dir):
    return profile.profiled(data(spark, sf_dir, "orders_new").select(*PROFILE)).select("field", "rows", "nulls", "null_rate", "distinct", "inferred_type")


@register("candidate_keys", "select 'c_custkey' as field, 0.9 as score where (select count(distinct c_custkey) = count(*) from customer) union all select 'c_name', 0.2 where (select count(distinct c_name) = count(*) from customer)")
def candidate_keys(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return profile.candidate_keys(profile.profiled(frame))


@register("privacy_hash", "select concat('sha256:', sha256(concat('\"', c_name, '\"'))) as name, '***' as segment from customer")
def privacy_hash(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return frame.select(masked_column(F.col("c_name"), "hash").alias("name"), masked_column(F.col("c_mktsegment"), "mask").alias("segment"))

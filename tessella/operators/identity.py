"""Identity graphs: crosswalks with splits and merges.

A legal component is a star: one source with many targets or one target with many sources. So there is no
iteration: the graph is legal if no edge has more than one edge at both ends, and the end with more than one
edge, else the target, names the component.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.hashing import component_id, digest_column
from ..functions.predicates import columns_of
from ..functions.values import DEFAULT, is_blank, key_part, number
from .keyed import Keyed, listed

POLICIES = ("first", "sum", "min", "max", "require_equal", "set")
ONE_TO_ONE, ONE_TO_MANY, MANY_TO_ONE = "1:1", "1:N", "N:1"


def edges(crosswalk: DataFrame, source_key: str | Sequence[str], target_key: str | Sequence[str], source_chain: Sequence[str] | None = DEFAULT, target_chain: Sequence[str] | None = DEFAULT) -> DataFrame:
    """``s`` and ``t``, arrays of key parts, and how often the edge stands in the crosswalk."""
    column = columns_of(crosswalk, "crosswalk")
    s = F.array(*[key_part(column(c), source_chain) for c in listed(source_key)])
    t = F.array(*[key_part(column(c), target_chain) for c in listed(target_key)])
    return crosswalk.select(s.alias("s"), t.alias("t")).groupBy("s", "t").agg(F.count(F.lit(1)).alias("times"))


def degrees(links: DataFrame) -> DataFrame:
    """``links`` with ``ds`` and ``dt``, the number of edges at either end."""
    ds = links.groupBy(F.col("s").alias("s_")).agg(F.count(F.lit(1)).alias("ds"))
    dt = links.groupBy(F.col("t").alias("t_")).agg(F.count(F.lit(1)).alias("dt"))
    return links.join(ds, F.col("s") == F.col("s_")).join(dt, F.col("t") == F.col("t_")).drop("s_", "t_")


def faults(links: DataFrame) -> DataFrame:
    """Edges that make a crosswalk unusable, with ``fault``: an empty key, a repeated edge or an N:N component."""
    empty = F.exists("s", lambda x: x == "") | F.exists("t", lambda x: x == "")
    kind = F.when(empty, "empty key").when(F.col("times") > 1, "repeated edge").when((F.col("ds") > 1) & (F.col("dt") > 1), "N:N component")
    return degrees(links).withColumn("fault", kind).where("fault is not null")


def verified(links: DataFrame) -> DataFrame:
    """``links``, or a DataError that shows a few of its faults."""
    if found := faults(links).orderBy("fault", "s", "t").limit(5).collect():
        raise DataError("the crosswalk is not usable: " + "; ".join(f"{r['fault']} {'|'.join(r['s'])} -> {'|'.join(r['t'])}" for r in found))
    return links


def components(links: DataFrame) -> DataFrame:
    """component, mode, source_keys, target_keys (sorted arrays of arrays) of a legal crosswalk: one groupBy."""
    d = degrees(links)
    many = F.col("ds") > 1
    hub = F.struct(many.alias("is_source"), F.when(many, F.col("s")).otherwise(F.col("t")).alias("key"))
    by = d.groupBy(hub.alias("hub")).agg(F.array_sort(F.collect_set("s")).alias("source_keys"), F.array_sort(F.collect_set("t")).alias("target_keys"))
    mode = F.when(F.size("source_keys") > 1, MANY_TO_ONE).when(F.size("target_keys") > 1, ONE_TO_MANY).otherwise(ONE_TO_ONE)
    label = lambda keys: F.transform(keys, lambda k: F.array_join(k, "\x1f"))
    return by.select(component_id(label("source_keys"), label("target_keys")).alias("component"), mode.alias("mode"), "source_keys", "target_keys")


def members(found: DataFrame, side: str) -> DataFrame:
    """component and ``key`` (array) of each key on one side."""
    return found.select("component", F.explode(f"{side}_keys").alias("key"))


def attached(rows: DataFrame, key: Column, member: DataFrame, side: str) -> DataFrame:
    """``rows`` with ``component`` and ``unmapped``; a key that no component has gets a name of its own on its side."""
    out = rows.withColumn("__key", key).join(member.withColumnsRenamed({"component": "__found", "key": "__member"}), F.col("__key") == F.col("__member"), "left")
    own = F.concat(F.lit(f"unmapped-{side}-"), F.substring(digest_column(F.struct(F.col("__key").alias("key"))), 1, 12))
    return out.withColumns({"component": F.coalesce("__found", own), "unmapped": F.col("__found").isNull()}).drop("__found", "__member")


def unused(member: DataFrame, side: Keyed) -> DataFrame:
    """Component and key of crosswalk keys that no row has."""
    seen = side.rows.select(F.array(*side.keys).alias("__seen")).distinct()
    return member.join(seen, F.col("key") == F.col("__seen"), "left_anti")


def merged_value(name: str, policy: str) -> Column:
    """One value of a component's rows. Blank values are passed over; all blank gives the empty string."""
    c = F.col(f"`{name}`")
    value = F.when(~is_blank(c), c.cast("string"))
    if policy == "sum":
        total = F.sum(F.when(~is_blank(c), number(c)))
        return F.coalesce(F.regexp_replace(F.regexp_replace(total.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.lit(""))
    if policy in ("min", "max"):
        return F.coalesce((F.min if policy == "min" else F.max)(value), F.lit(""))
    if policy == "first":
        return F.coalesce(F.min_by(value, F.when(value.isNotNull(), F.col("__ord"))), F.lit(""))
    if policy == "require_equal":
        return F.coalesce(F.min(value), F.lit(""))
    return F.array_join(F.array_sort(F.collect_set(value)), "|")


def merge(rows: DataFrame, key_fields: Sequence[str], policies: Mapping[str, str], compared_fields: set[str]) -> DataFrame:
    """One row a component, from rows with ``component`` and ``__ord``.

    A component of one row passes as it is. Fields that checks compare must agree unless a policy says
    otherwise (``conflicts`` names those that do not); other fields become the set of their values; key fields
    are joined by a pipe.
    """
    columns = [c for c in rows.columns if c not in ("component", "unmapped", "__ord", "__key")]
    out, equal = [], []
    for c in columns:
        if c in key_fields:
            many = F.array_join(F.array_sort(F.collect_set(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))), "|")
        else:
            policy = policies.get(c) or ("require_equal" if c in compared_fields else "set")
            many = merged_value(c, policy)
            if policy == "require_equal":
                equal.append(F.when(F.count_distinct(F.when(~is_blank(F.col(f"`{c}`")), F.col(f"`{c}`").cast("string"))) > 1, F.lit(c)))
        out.append(F.when(F.count(F.lit(1)) == 1, F.first(F.col(f"`{c}`").cast("string"))).otherwise(many).alias(c))
    conflicts = F.array_compact(F.array(*equal)) if equal else F.array().cast("array<string>")
    return rows.groupBy("component").agg(*out, F.count(F.lit(1)).alias("__members"), F.min("__ord").alias("__ord"), conflicts.alias("conflicts"))


def without_conflicts(merged: DataFrame) -> DataFrame:
    """``merged`` without its conflicts column, or a DataError that names a few."""
    if found := merged.where(F.size("conflicts") > 0).select("component", "conflicts").orderBy("component").limit(5).collect():
        raise DataError("values differ within a component: " + "; ".join(f"{r['component']}: {', '.join(r['conflicts'])}" for r in found))
    return merged.drop("conflicts")

"""Sharding by a k-d tree over the documents' metadata.

A node that has to make k leaves is split at the weighted quantile floor(k / 2) / k (the weighted median
for even k) of its widest dimension, until each leaf holds one shard: the target bytes are the sum of
all sizes over the number of shards. Dimensions are size, place in the order of doc_id, source and
language; their widths are compared as shares of the width in the whole table. A split point is found by
weighted histograms of 2 ** STEP bins that zoom into the bin with the quantile; all nodes of a level are
split by the same passes, over a written table of narrow rows. What reaches the driver is at most
shards * 2 ** STEP counts.

Ties: every coordinate is followed by hash bits of the row, so that documents that agree in a dimension
can be split anywhere. Rows that agree in doc_id, text and metadata are told apart by a running number.
Null text has no bytes; null source, language and doc_id are values of their own. Very long texts and empty ones are
rows like others. Other columns of the input, whatever their names, take no part. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import empty_safe_text, numbered, staged

SHARDS = 24
EXTRA_BYTES = 8
DIMENSIONS = ("x_size", "x_order", "x_source", "x_lang")
#: Bits of a coordinate's value and of the tie-break that follows it, and bits that one pass decides.
VALUE, TIE, STEP = 31, 31, 12
#: A split may miss its weight by this share of a shard, or by one row.
CLOSE = 0.0005
#: Rows that get their slots in one sort.
RUN = 50_000


def coordinates(docs: DataFrame) -> DataFrame:
    """``docs`` with text_crc32, size, d_source and d_lang of every row, in place of columns of these names."""
    has = set(docs.columns)
    col = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    t = empty_safe_text(docs)
    code = lambda c: F.coalesce(F.crc32(col(c).cast("binary")).cast("long") / 2, F.lit(0)).cast("long")
    return docs.withColumns({"text_crc32": F.crc32(t.cast("binary")).cast("long"), "size": (F.octet_length(t) + EXTRA_BYTES).cast("long"), "d_source": code("source"), "d_lang": code("lang")})


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text_crc32, size, copy and the four coordinates of every row."""
    rows = coordinates(docs).select("doc_id", "text_crc32", "size", "d_source", "d_lang")
    rows = staged(numbered(rows, ["doc_id", "text_crc32", "size", "d_source", "d_lang"]), "shard-rows")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first() if rows.schema["doc_id"].dataType.typeName() in ("long", "integer", "short") else (None, None)
    if low is None or high == low:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << VALUE))
    else:
        place = F.coalesce(((F.col("doc_id") - low) / F.lit(float(high - low)) * float((1 << VALUE) - 1)).cast("long"), F.lit(0).cast("long"))
    values = {"x_size": F.least(F.col("size"), F.lit((1 << VALUE) - 1)), "x_order": place, "x_source": F.col("d_source"), "x_lang": F.col("d_lang")}
    tie = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id", "text_crc32", "d_source", "d_lang", "copy"), F.lit(1 << TIE))
    return rows.select("doc_id", "text_crc32", "size", "copy", *[(F.shiftleft(values[d].cast("long"), TIE) + tie(k)).alias(d) for k, d in enumerate(DIMENSIONS)])


def chosen(node: Column, by_node: dict[int, Column], other: Column) -> Column:
    """The column of the row's node; at most one branch a shard."""
    out = None
    for k, c in by_node.items():
        out = F.when(node == k, c) if out is None else out.when(node == k, c)
    return other if out is None else out.otherwise(other)


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``narrow`` rows with ``shard``, from 0 to ``shards - 1``. Empty tables give no rows."""
    here = staged(narrow(docs).withColumn("node", F.lit(0)), "shard-points")
    total = here.agg(F.sum("size")).first()[0] or 0
    close = max(1.0, CLOSE * total / shards)
    nodes = {0: shards}  # first shard of a node: number of its shards
    whole = None
    while any(k > 1 for k in nodes.values()):
        ends = here.groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).collect()
        ends = {r["node"]: r for r in ends}
        whole = whole or {d: max(1, (max(r[f"max_{d}"] for r in ends.values()) >> TIE) - (min(r[f"min_{d}"] for r in ends.values()) >> TIE)) for d in DIMENSIONS} if ends else {}
        level, search = {}, {}  # level: node: dimension, first coordinate of the right part, node of the right part
        for node, k in nodes.items():
            if k > 1 and node in ends:
                r = ends[node]
                wide = max(DIMENSIONS, key=lambda d: ((r[f"max_{d}"] >> TIE) - (r[f"min_{d}"] >> TIE)) / whole[d])
                search[node] = [wide, r[f"min_{wide}"], r[f"max_{wide}"] + 1, r["w"] * (k // 2) / k]  # dimension, from, to, weight to the left
        while search:
            width = {node: max(1, -(-(to - at) >> STEP)) for node, (_, at, to, _) in search.items()}
            code = chosen(F.col("node"), {node: F.col(d) for node, (d, *_) in search.items()}, F.lit(None).cast("long"))
            bins = chosen(F.col("node"), {node: F.when((F.col("c") >= at) & (F.col("c") < to), F.floor((F.col("c") - at) / width[node])) for node, (_, at, to, _) in search.items()}, F.lit(None).cast("long"))
            hist = here.where(F.col("node").isin(list(search))).withColumn("c", code).select("node", "size", bins.cast("int").alias("bin")).where("bin is not null").groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
            found: dict[int, list] = {}
            for r in hist.collect():
                found.setdefault(r["node"], []).append((r["bin"], r["w"], r["n"]))
            for node in list(search):
                d, at, to, left = search[node]
                for b, w, n in sorted(found.get(node, [])):
                    if left < w:
                        whole_bin = n == 1 or width[node] == 1 or w <= 2 * close
                        cut = at + (b + (left > w / 2)) * width[node] if whole_bin else None
                        search[node] = [d, at + b * width[node], min(to, at + (b + 1) * width[node]), left]
                        break
                    left -= w
                else:
                    cut = to
                if cut is not None:
                    right = node + nodes[node] // 2
                    level[node] = (d, cut, right)
                    del search[node]
        if not ends:
            break
        nodes = {n: k for node, size in nodes.items() for n, k in ([(node, size // 2), (node + size // 2, size - size // 2)] if node in level else [(node, 1)])}
        here = staged(here.withColumn("node", chosen(F.col("node"), {k: F.when(F.col(d) >= at, right).otherwise(k) for k, (d, at, right) in level.items()}, F.col("node"))), "shard-level")
    own = [F.shiftright(d, TIE).alias(d) for d in ("x_source", "x_lang")]
    return here.select("doc_id", "text_crc32", "size", *own, "copy", F.col("node").cast("int").alias("shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """``slot``: 0, 1, ... in each shard. Shards are numbered in hashed runs, side by side."""
    n = rows.count()
    rows = rows.withColumn("__run", F.pmod(F.xxhash64("doc_id", "text_crc32", "x_source", "x_lang", "copy"), F.lit(max(1, -(-n // RUN)) if n > RUN else 16)))
    counts = rows.groupBy("shard", "__run").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select(F.col("shard").alias("__s"), F.col("__run").alias("__r"), (F.sum("__n").over(W.partitionBy("shard").orderBy("__run").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__first"))
    place = F.row_number().over(W.partitionBy("shard", "__run").orderBy("doc_id", "text_crc32", "x_source", "x_lang", "copy")) - 1
    rows = rows.withColumn("__place", place).join(first, (F.col("shard") == F.col("__s")) & (F.col("__run") == F.col("__r")))
    return rows.withColumn("slot", (F.col("__first") + F.col("__place")).cast("long")).drop("__run", "__s", "__r", "__first", "__place")


def shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, copy, shard and slot for every row of ``docs``."""
    return with_slots(staged(shard_rows(docs, shards), "shard-rows")).drop("x_source", "x_lang")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, in place of columns of these names if there are any."""
    docs = docs.drop("shard", "slot")
    names = ["doc_id", "text_crc32", "size", "x_source", "x_lang", "copy"]
    own = coordinates(docs).withColumnsRenamed({"d_source": "x_source", "d_lang": "x_lang"})
    own = own.select(*[F.col(c).alias(f"__own_{c}") for c in names[:-1]], F.struct(*docs.columns).alias("__row"))
    # Rows that agree in all of this are interchangeable, but for columns that sharding doesn't see.
    place = F.row_number().over(W.partitionBy(*[f"__own_{c}" for c in names[:-1]]).orderBy("__own_text_crc32")) - 1
    own = own.withColumn("__own_copy", place)
    placed = with_slots(staged(shard_rows(docs, shards), "shard-rows")).select(*names, "shard", "slot")
    same = F.lit(True)
    for c in names:
        same = same & (F.col(f"__own_{c}").eqNullSafe(F.col(c)) if c == "doc_id" else F.col(f"__own_{c}") == F.col(c))
    return own.join(placed, same).select("__row.*", "shard", "slot")

"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same real number of copies, target / size of the source.
The whole part is taken as it is. The fractions are rounded by pivotal steps: two documents exchange
mass (fraction times words) until one of them is whole, in the direction that chance decides, so that
each keeps its expected copies and the source keeps its words. Blocks of FAN_IN documents are folded
side by side; each leaves at most one fraction, and the fractions left over meet in the next level.
DataFrame functions only.

Rows: null text has size 0 and is never counted towards a target. Rows that agree in doc_id, source and
size are told apart by a running number, in the order of their texts' prints where the texts themselves are returned.
Null sources form one source, the last. Very long texts count like others. Other columns of the input, whatever their
names, take no part. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import SPACE, empty_safe_text, numbered, staged, uniform

#: Weights of the sources by code point, null last, repeating; targets stop at MOST times the source.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
FAN_IN = 128
SEED = 20_011
EDGE = 1e-12


def word_count(text: Column) -> Column:
    """Number of words of a text that is not null."""
    return F.size(F.array_remove(F.split(text, SPACE, -1), "")).cast("long")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target, n for each source of ``rows`` (source, size).

    The windows without a partition see one row per source. The level that fills all sources by weight,
    stopping each at ``most`` times its size, is the largest quotient of rest to weight when the
    sources are closed in the order of size to weight.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    by = by.withColumn("level", rest / open_)
    by = by.withColumn("target", F.least(F.col("cap"), F.col("w") * F.max("level").over(everything)))
    return by.select("source", "source_size", "target", "n")


def fold(items: Column, kind: str) -> Column:
    """Pivotal steps over an array of (id, p, s, u): those that became whole, and the one left over.

    ``s`` is over 0 and ``kind`` is the type of ``id``. ``u`` decides the direction of the step that brings the item in.
    """
    none = F.struct(F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("p"), F.lit(0.0).alias("s"))
    start = F.struct(none.alias("left"), F.array().cast(f"array<struct<id:{kind},up:boolean>>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        left, p, s = a["left"], a["left"]["p"], a["left"]["s"]
        up = F.least((1 - p) * s, x["p"] * x["s"])  # mass that may go from the new item to the one left over
        down = F.least(p * s, (1 - x["p"]) * x["s"])
        gives = x["u"] * (up + down) < down
        p1 = F.when(gives, p + up / s).otherwise(p - down / s)
        p2 = F.when(gives, x["p"] - up / x["s"]).otherwise(x["p"] + down / x["s"])
        whole1 = (p1 <= EDGE) | (p1 >= 1 - EDGE)
        whole2 = (p2 <= EDGE) | (p2 >= 1 - EDGE)
        item = lambda id_, q: F.struct(id_.alias("id"), (q > 0.5).alias("up"))
        empty = F.array().cast(f"array<struct<id:{kind},up:boolean>>")
        met = F.struct(
            F.when(whole1 & whole2, none).when(whole1, F.struct(x["id"].alias("id"), p2.alias("p"), x["s"].alias("s"))).otherwise(F.struct(left["id"].alias("id"), p1.alias("p"), s.alias("s"))).alias("left"),
            F.concat(a["done"], F.when(whole1, F.array(item(left["id"], p1))).otherwise(empty), F.when(whole2, F.array(item(x["id"], p2))).otherwise(empty)).alias("done"),
        )
        first = F.struct(F.struct(x["id"].alias("id"), x["p"].alias("p"), x["s"].alias("s")).alias("left"), a["done"].alias("done"))
        return F.when(left["id"].isNull(), first).otherwise(met)

    return F.aggregate(items, start, step)


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, copy, source_size, target, copies for every row of ``docs``.

    ``docs`` needs doc_id, source and text. Which copies a row gets depends on its values, the seed and
    the table, not on its place.
    """
    sized = docs.select("doc_id", "source", word_count(empty_safe_text(docs)).alias("size"))
    rows = staged(numbered(sized, ["doc_id", "source", "size"]), "mix-sizes")
    goal = staged(targets(rows, weights, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(rate + EDGE).cast("long")).withColumn("part", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    g = goal.withColumnRenamed("source", "source_")
    rows = rows.join(g, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    id_ = F.struct("doc_id", "copy", "size")
    kind = rows.select(id_.alias("id")).schema["id"].dataType.simpleString()
    open_ = rows.where((F.col("part") > EDGE) & (F.col("size") > 0))
    live = open_.select("source", "n", id_.alias("id"), F.col("part").alias("p"), F.col("size").cast("double").alias("s"))
    # Each level divides the number of blocks of the largest source by FAN_IN / 2, until it is one.
    largest, level, done = goal.agg(F.max("n")).first()[0] or 0, 0, None
    while True:
        blocks = F.ceil(F.col("n") / (FAN_IN / 2) ** (level + 1)).cast("long")
        live = live.withColumns({"block": F.pmod(F.xxhash64(F.lit(seed + level), "id"), F.greatest(blocks, F.lit(1))), "u": uniform("id", seed=seed + 100 + level)})
        items = F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "id").alias("k"), "id", "p", "s", "u")))
        folded = staged(live.groupBy("source", "block").agg(F.max("n").alias("n"), items.alias("items")).select("source", "n", fold(F.col("items"), kind).alias("f")), f"mix-level{level}")
        whole = folded.select("source", F.explode("f.done").alias("d")).select("source", F.col("d.id").alias("id"), F.col("d.up").alias("up"))
        done = whole if done is None else done.unionByName(whole)
        live = folded.where(F.col("f.left.id").isNotNull()).select("source", "n", F.col("f.left.id").alias("id"), F.col("f.left.p").alias("p"), F.col("f.left.s").alias("s"))
        level += 1
        if largest <= (FAN_IN / 2) ** level:
            break
    # At most one fraction a source is left: to the nearest, so that a source misses its target by half a document at most.
    last = live.select("source", "id", (F.col("p") >= 0.5).alias("up"))
    up = done.unionByName(last).where("up").select(F.col("source").alias("s_"), F.col("id.doc_id").alias("d_"), F.col("id.copy").alias("c_"), F.col("id.size").alias("z_"), "up")
    match = F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("copy") == F.col("c_")) & (F.col("size") == F.col("z_")) & F.col("source").eqNullSafe(F.col("s_"))
    out = rows.join(up, match, "left").withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("up").cast("long"), F.lit(0))).otherwise(F.lit(0)))
    return out.select("doc_id", "source", "size", "copy", "source_size", "target", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; all columns as they were."""
    got = copies(docs, **options)
    got = got.groupBy(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "size")]).agg(F.sum("copies").alias("__total"), F.count(F.lit(1)).alias("__rows")).where("__total > 0")
    got = got.withColumn("__key", F.xxhash64("__doc_id", "__source", "__size")).withColumnRenamed("__key", "__key_")
    keyed = docs.withColumn("__words", word_count(empty_safe_text(docs))).withColumn("__key", F.xxhash64("doc_id", "source", "__words"))
    same = (F.col("__key") == F.col("__key_")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    # Rows that agree share their copies evenly; the first of them take what does not divide.
    place = F.row_number().over(W.partitionBy("__key", "__doc_id", "__source", "__size").orderBy(F.md5(F.coalesce(keyed["text"].cast("string"), F.lit("")))))
    times = F.floor(F.col("__total") / F.col("__rows")) + F.when(place <= F.col("__total") % F.col("__rows"), 1).otherwise(0)
    joined = keyed.join(got, same).withColumn("__times", times.cast("int")).where("__times > 0")
    return joined.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)

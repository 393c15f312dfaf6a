"""Quality rules: thresholds from mergeable quantile sketches per language and source.

A sketch is a map from logarithmic bucket to count (relative error at most ``GAMMA - 1``). Sketches
merge by adding counts, so they are built with partial aggregation, give the same thresholds whatever
the partitioning, and the sketch of a language is the sum of its sources' sketches. DataFrame
functions only.

Thresholds are set on measures that nearly every text has some of, so that a group's quartiles have a width: the share
of marks among the characters of words, the repetition of words, and their mean length. A measure that is 0 for most
texts has no quartiles to speak of, and a constant would decide. As the noise of a mean falls with the root of the
number of words, a text of fewer words than its group's median has limits that are wider by that root.

Rows: null text counts as empty. Null language and null source are groups of their own. Repeated rows
are judged alike and all returned. Very long texts are measured whole. Other columns of the input, whatever their
names, are ignored by the measures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import BLANKS, SPACE, empty_safe_text, staged

#: Bucket ``b`` of a sketch holds values in ``(GAMMA ** (b - 1), GAMMA ** b]``.
GAMMA = 1.02
SYMBOLS = "#*$%&|<>"
#: Characters of words that are neither letters nor digits.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "¡¿«»‘’“”„…–—·、。「」『』《》【】（）！？，：；"


@dataclass(frozen=True)
class Fence:
    """Accept ``[q1 - reach * spread, q3 + reach * spread]`` where spread = max(q3 - q1, least).

    The reach grows by the root of (median words of the group / words of the text) for texts below that median.
    """

    measure: str
    reach: float
    least: float
    low: bool = False


#: Production parameters. ``least`` only guards groups in which all documents agree; it is far below the widths of others.
FENCES = (
    Fence("mark_ratio", 4.0, 0.001),
    Fence("repetition", 4.0, 0.002),
    Fence("mean_word", 4.0, 0.02, low=True),
)
#: Sketched for its median alone.
WORDS = "n_words"
QUARTILES = ("q1", "q2", "q3")
MIN_ROWS = 200
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the base measures of each row of ``docs``."""
    t = docs.select(*keep, empty_safe_text(docs).alias("__t"))
    t = t.withColumn("__w", F.array_remove(F.split("__t", SPACE, -1), ""))
    t = t.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("__w")
    t = t.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("__t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("__t") - F.length(F.translate("__t", MARKS, ""))).cast("long").alias("n_marks"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))).alias("__h"),
    )
    # Only a text with a repeated window pays for finding out where it is.
    t = t.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: (F.get("__s", j).getField("h") == x.getField("h")) & j.isNotNull()
    t = t.withColumn("__p", F.sort_array(F.transform(F.filter("__s", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x.getField("i"))))
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("words")),
        lambda a, p: F.struct(p.alias("last"), (a["words"] + F.least(F.lit(WINDOW), p - a["last"])).alias("words")),
        lambda a: a["words"],
    )
    t = t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    t = t.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return t.drop("__h", "__s", "__p")


def ratios() -> dict[str, Column]:
    """The measures that thresholds are set on."""
    least = lambda c, n: F.greatest(F.col(c), F.lit(n)).cast("double")
    return {
        "mark_ratio": F.col("n_marks") / least("word_chars", 1),
        "repetition": F.lit(1.0) - F.log(least("n_distinct", 1)) / F.log(least("n_words", 2)),
        "mean_word": F.col("word_chars") / least("n_words", 1),
    }


def bucket(x: Column) -> Column:
    """The sketch bucket of a value; 0 and below share the lowest."""
    return F.when(x > 0, F.ceil(F.log(x) / F.log(F.lit(GAMMA)))).otherwise(F.lit(-(1 << 20))).cast("int")


def value(b: Column) -> Column:
    """The middle of a bucket."""
    return F.when(b > -(1 << 20), F.lit(2.0) * F.pow(F.lit(GAMMA), b.cast("double")) / (1 + GAMMA)).otherwise(F.lit(0.0))


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per group, measure and bucket with its count; ``rows`` has the columns of ``ratios`` and n_words."""
    names = [*(f.measure for f in FENCES), WORDS]
    each = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in names])
    return rows.select(*by, F.explode(each).alias("m")).groupBy(*by, F.col("m.measure").alias("measure"), F.col("m.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows, lower quartile, median and upper quartile of each group and measure."""
    group = W.partitionBy(*by, "measure")
    run = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    s = sketch.withColumns({"upto": F.sum("n").over(run), "rows": F.sum("n").over(group)})
    at = lambda q: value(F.min(F.when(F.col("upto") >= F.col("rows") * q, F.col("bucket"))))
    return s.groupBy(*by, "measure").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source with ``<measure>_q1``, ``_q3`` and ``_reach``, and ``typical_words``.

    A group of fewer than MIN_ROWS rows takes its language's quartiles, a language of fewer takes those
    of all rows; both come from merged sketches.
    """
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(merged(sketch, ["lang"]), ["lang"]).select(F.col("lang").alias("lang_"), F.col("measure").alias("m_"), *[F.col(c).alias(f"lang_{c}") for c in ("rows", *QUARTILES)])
    all_ = quartiles(merged(sketch, []), []).select(F.col("measure").alias("all_m"), *[F.col(q).alias(f"all_{q}") for q in QUARTILES])
    t = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("measure") == F.col("m_"))).join(all_, F.col("measure") == F.col("all_m"))
    for q in QUARTILES:
        t = t.withColumn(q, F.when(F.col("rows") >= MIN_ROWS, F.col(q)).when(F.col("lang_rows") >= MIN_ROWS, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}")))
    limits = [F.max(F.when(F.col("measure") == WORDS, F.col("q2"))).alias("typical_words")]
    for f in FENCES:
        mine = F.col("measure") == f.measure
        limits += [F.max(F.when(mine, F.col(q))).alias(f"{f.measure}_{q}") for q in ("q1", "q3")]
        limits.append(F.max(F.when(mine, f.reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(f.least)))).alias(f"{f.measure}_reach"))
    return t.groupBy("lang", "source").agg(*limits)


def quality_rules(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: doc_id, lang, source), the measures, their limits (``<measure>_lo``, ``_hi``) and ``kept`` for every row.

    A row is kept if it passes the base rules and each measure lies within its group's limits. An empty
    table gives an empty result.
    """
    keep = keep or ["doc_id", "lang", "source"]
    rows = staged(measures(docs, keep).withColumns(ratios()), "quality")
    limits = thresholds(sketches(rows, ["lang", "source"])).withColumnsRenamed({"lang": "__of_lang", "source": "__of_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("__of_lang")) & F.col("source").eqNullSafe(F.col("__of_source")))
    wider = F.sqrt(F.greatest(F.lit(1.0), F.col("typical_words") / F.greatest(F.col("n_words"), F.lit(1)).cast("double")))
    joined = joined.withColumn("__wider", wider)
    inside = F.lit(True)
    for f in FENCES:
        m = f.measure
        lo = F.col(f"{m}_q1") - F.col(f"{m}_reach") * F.col("__wider") if f.low else F.lit(float("-inf"))
        joined = joined.withColumns({f"{m}_lo": lo, f"{m}_hi": F.col(f"{m}_q3") + F.col(f"{m}_reach") * F.col("__wider")})
        inside = inside & (F.col(m) >= F.col(f"{m}_lo")) & (F.col(m) <= F.col(f"{m}_hi"))
        joined = joined.drop(f"{m}_q1", f"{m}_q3", f"{m}_reach")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("__of_lang", "__of_source", "__wider")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rows are matched by doc_id, language, source and a hash of the text, so that rows which share a
    doc_id but not a text are each judged on their own.
    """
    print_ = F.xxhash64(empty_safe_text(docs))
    keyed = docs.withColumn("__print", print_)
    judged = quality_rules(keyed, ["doc_id", "lang", "source", "__print"]).where("kept")
    judged = judged.select(*[F.col(c).alias(f"__kept_{c}") for c in ("doc_id", "lang", "source", "__print")]).distinct()
    same = F.col("__print") == F.col("__kept___print")
    for c in ("doc_id", "lang", "source"):
        same = same & F.col(c).eqNullSafe(F.col(f"__kept_{c}"))
    return keyed.join(judged, same, "left_semi").select(*docs.columns)

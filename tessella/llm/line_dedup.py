"""Line dedup by a deletion-neighbourhood join, for an edit bound that grows with the line.

Lines that are not blank are compared over the whole corpus, in the order of doc_id and line number. A line goes
if an earlier line is equal, whatever its length. A line of MIN_CHARS characters or more also goes if an earlier
one of MIN_CHARS or more lies within as many insertions, deletions and substitutions as the shorter of the two
allows: one below 64 characters, two below 128, three below 256, four above, and never more than ``edits``. The
earlier line need not be kept itself.

1. Equal lines are one; only its first occurrence goes on, under a number of its own.
2. A line is cut into one piece more than it has edits. Without the pieces that the edits touch, two lines within
   the bound are equal: one piece at least is left, and it stands at a place that differs by no more than the
   edits before it. Pieces are as long as the line's length class says, and are counted from the left in the left
   half and from the right in the right half, so that lengths within a class agree on them. Each line emits the
   hash of what is left, at each place it can have.
3. Lines that meet are verified by their edit distance. Lines of keys where more than CROWD meet, the crowds, meet
   by what is rare in them instead. A line with more strings of GRAM characters than its bound that lie apart and
   that no other has is within the bound of none. The others take their rarest strings, in one order of all, until
   more than the bound lie apart; two lines within the bound share one of those, whole and in its place. Each line
   is tried with the earliest one that it meets by each, and only lines that are left with all earlier ones whose
   lengths before and after the string, letters and strings of their own allow it.

Counts of keys are aggregated and joined back, so a key that very many lines share is not gathered. Strings of lines
of crowds are counted in windows, whose rows are few numbers and spill. DataFrame functions only. Rows: null and empty texts have no lines to compare; blank lines are always kept and may repeat. Rows that share a
doc_id, or have none, are told apart by a 128-bit print of their texts, which also is their order; rows that share the
text too follow each other, and all but the first lose their lines. Very long texts and lines are compared whole. Other
columns keep their values, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import BLANKS, discard, empty_safe_text, numbered, sent_if_small, staged

#: Lines with fewer characters are compared for equality only.
MIN_CHARS = 32
#: Edits that the longest lines are allowed in the registered query.
MOST_EDITS = 4
#: Lines that meet in one key before the rest of them is cut again.
CROWD = 16
#: Letters that are counted in lines of a crowd. An edit changes two counts by one at most.
LETTERS = "etanoirshdluwgbfycmpvk "
#: Width of the length classes of lines.
STEP = 32
#: Characters of the strings by which lines of a crowd meet; lines are cut into stretches first, as places are found by counting characters.
GRAM, STRETCH = 8, 1024


def filled(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)) != ""


def print_of(docs: DataFrame) -> Column:
    """A 128-bit print of the text."""
    return F.unhex(F.md5(empty_safe_text(docs)))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, print, line_no, line of each line that is compared."""
    once = docs.select("doc_id", print_of(docs).alias("print"), F.split(empty_safe_text(docs), "\n", -1).alias("lines"))  # not for each line
    return once.select("doc_id", "print", F.posexplode("lines").alias("line_no", "line")).where(filled(F.col("line")))


def allowed(n: Column, edits: int) -> Column:
    """The edit bound of a pair whose shorter line has n characters."""
    return F.least(F.lit(edits), F.when(n < 64, 1).when(n < 128, 2).when(n < 256, 3).otherwise(4))


def places(k: int) -> list[tuple[bool, int, int]]:
    """(counted from the right, pieces before it, shift) of each piece that can be left after k edits."""
    left = [(False, i, d) for i in range((k + 2) // 2) for d in range(-i, i + 1)]
    return left + [(True, i, d) for i in range((k + 1) // 2) for d in range(-i, i + 1)]


def keys(rows: DataFrame, edits: int) -> DataFrame:
    """no, n and h, the hash of each piece that can be left of a line of ``rows`` (no, n, line), also as shorter lines of the
    class below see it. A line that repeats itself may have a key twice.

    The places are exploded first, so that one short expression cuts all pieces.
    """
    codes = lambda k, below: [4000 * below + 1000 * (k - 1) + 100 * right + 10 * i + d + 5 for right, i, d in places(k)]
    base = (F.col("n") - F.col("n") % STEP).cast("int")
    rows = rows.withColumns({"base": base, "k": allowed(base, edits), "k_below": allowed(base - STEP, edits)})
    rows = rows.withColumn("k_below", F.when((F.col("n") - F.col("k_below") < F.col("base")) & (F.col("base") >= 2 * STEP), F.col("k_below")).otherwise(0))
    each = F.array().cast("array<int>")
    for k in range(1, edits + 1):
        for below in range(k + 1):
            own = F.array(*[F.lit(c) for c in codes(k, 0) + (codes(below, 1) if below else [])])
            each = F.when((F.col("k") == k) & (F.col("k_below") == below), own).otherwise(each)
    rows = rows.select("no", "n", "line", "base", F.explode(each).alias("code"))
    rows = rows.withColumn("base", F.when(F.col("code") >= 4000, F.col("base") - STEP).otherwise(F.col("base")))
    part = lambda by, of: F.floor(F.col("code") / by).cast("int") % of
    rows = rows.withColumns({"size": F.floor(F.col("base") / (part(1000, 4) + 2)).cast("int"), "i": part(10, 10)})
    at = F.when(part(100, 10) == 1, F.col("n") - (F.col("i") + 1) * F.col("size")).otherwise(F.col("i") * F.col("size")) + F.col("code") % 10 - 4
    return rows.select("no", "n", F.xxhash64("base", F.floor(F.col("code") / 10) % 400, F.substring("line", at, F.col("size"))).alias("h"))


def grams(rows: DataFrame) -> DataFrame:
    """no, p and g, the place and the hash of each string of GRAM characters of the lines of ``rows`` (no, n, line)."""
    step = lambda most, by=1: F.explode(F.sequence(F.lit(0), most.cast("int"), F.lit(by)))
    rows = rows.select("no", "line", step(F.col("n") - GRAM, STRETCH).alias("from"))
    rows = rows.select("no", "from", F.substring("line", F.col("from") + 1, F.lit(STRETCH + GRAM - 1)).alias("line"))
    rows = rows.select("no", "from", "line", step(F.length("line") - GRAM).alias("p"))
    return rows.select("no", (F.col("from") + F.col("p")).alias("p"), F.xxhash64(F.substring("line", F.col("p") + 1, F.lit(GRAM))).alias("g"))


def apart(places_: Column) -> Column:
    """Of the places of strings, sorted, as many as lie apart from each other, up to one more than any bound."""
    got = F.aggregate(places_, F.array().cast("array<int>"), lambda got, p: F.when((F.size(got) == 0) | (p >= F.element_at(got, -1) + GRAM), F.concat(got, F.array(p))).otherwise(got))
    return F.slice(got, 1, MOST_EDITS + 1)


def rarest(rows: DataFrame, edits: int) -> DataFrame:
    """no, own, p and h of the rarest strings of each line of ``rows`` (no, n, line) that occur elsewhere.

    In one order of all strings, the rarest first, a line takes strings until its bound and one more lie apart from each
    other. No more edits than the bound can touch them all, so the line of a pair whose last one is rarer has one that the
    other line has too, and has among its own. Strings that occur once come first and meet nothing; own: places of those
    that lie apart.
    """
    each = grams(rows).withColumn("f", F.count(F.lit(1)).over(W.partitionBy("g"))).select("no", F.struct("f", "g", "p").alias("x"))
    each = each.groupBy("no").agg(F.sort_array(F.collect_list("x")).alias("xs")).join(rows.select(F.col("no").alias("r_"), allowed(F.col("n"), edits).alias("k")), F.col("no") == F.col("r_"))
    lone = F.array_sort(F.transform(F.filter("xs", lambda x: x["f"] == 1), lambda x: x["p"]))
    each = each.select("no", "k", F.filter("xs", lambda x: x["f"] > 1).alias("xs"), apart(lone).alias("own"))
    start = F.struct(F.col("own").alias("got"), F.lit(0).cast("bigint").alias("f"), F.lit(0).cast("bigint").alias("g"))
    more = lambda a, x: F.when((F.size(a["got"]) <= F.col("k")) & F.forall(a["got"], lambda p: F.abs(p - x["p"]) >= GRAM), F.struct(F.concat(a["got"], F.array(x["p"])).alias("got"), x["f"].alias("f"), x["g"].alias("g"))).otherwise(a)
    each = each.select("no", "k", "xs", "own", F.aggregate("xs", start, more).alias("last"))
    taken = lambda x: (F.size("last.got") <= F.col("k")) | (x["f"] < F.col("last.f")) | ((x["f"] == F.col("last.f")) & (x["g"] <= F.col("last.g")))
    return each.select("no", "own", F.explode(F.filter("xs", taken)).alias("x")).select("no", "own", F.col("x.p").alias("p"), F.col("x.g").alias("h"))


def least_edits(own: Column, other: Column, edits: int) -> Column:
    """How many edits are needed at least between lines with strings at ``own`` and at ``other`` that the other line lacks: each
    needs one, and two of them can need the same one only if they overlap, give or take what earlier edits shift them by.
    """
    at = lambda ps, side: F.transform(ps, lambda p: F.struct(p.alias("p"), F.lit(side).alias("side")))
    start = F.struct(F.lit(0).alias("n"), F.lit(-GRAM - edits).alias("p"), F.lit(0).alias("side"))
    free = lambda a, x: x["p"] >= a["p"] + GRAM + F.when(x["side"] == a["side"], 0).otherwise(edits)
    more = lambda a, x: F.when(free(a, x), F.struct((a["n"] + 1).alias("n"), x["p"].alias("p"), x["side"].alias("side"))).otherwise(a)
    return F.aggregate(F.array_sort(F.concat(at(own, 0), at(other, 1))), start, more)["n"]


def distinct_lines(docs: DataFrame) -> DataFrame:
    """no, ``at`` (doc_id, print, line_no) of the first occurrence, length n and line (of MIN_CHARS or more) of each distinct line."""
    by = lines(docs).groupBy(F.unhex(F.md5("line")).alias("same")).agg(F.min(F.struct("doc_id", "print", "line_no")).alias("at"), F.first("line").alias("line"))
    n = F.length("line")
    return by.select(F.monotonically_increasing_id().alias("no"), "at", n.alias("n"), F.when(n >= MIN_CHARS, F.col("line")).alias("line"))


def met(keyed: DataFrame, *more: Column) -> DataFrame:
    """``keyed`` of those that share ``h`` with another, ``m``, how many do, and ``more`` aggregates of ``h``."""
    counts = keyed.groupBy(F.col("h").alias("h_")).agg(F.count(F.lit(1)).alias("m"), *more).where("m > 1")
    return keyed.join(counts, F.col("h") == F.col("h_")).drop("h_")


def pairs_of(asking: DataFrame, all_: DataFrame, edits: int) -> DataFrame:
    """no, other of lines that share a key and whose lengths and letters are within the bound. In crowds, where lines have
    their place and their letters, other is an earlier line: a line asks for one, and is asked by all later ones.
    """
    counts = [c for c in all_.columns if c.startswith("has_")]
    more = [c for c in ("at", "p", "own") if c in all_.columns] if counts else []
    a = asking.select("no", "n", "h", *more, *counts)
    b = all_.select(F.col("no").alias("other"), F.col("n").alias("n_"), F.col("h").alias("h_"), *[F.col(c).alias(f"{c}_") for c in [*more, *counts]])
    most = allowed(F.least("n", "n_"), edits)
    meet = (F.col("h") == F.col("h_")) & (F.abs(F.col("n") - F.col("n_")) <= most)
    if counts:
        meet = meet & (F.col("at") > F.col("at_")) & (sum((F.abs(F.col(c) - F.col(f"{c}_")) for c in counts), F.lit(0)) <= 2 * most)
        if "own" in more:
            before, after = F.col("p") - F.col("p_"), (F.col("n") - F.col("p")) - (F.col("n_") - F.col("p_"))
            meet = meet & (F.abs(before) + F.abs(after) <= most) & (least_edits(F.col("own"), F.col("own_"), edits) <= most)
    else:
        meet = meet & (F.col("no") < F.col("other"))
    return a.join(b, meet).select("no", "other").distinct()


def neighbours(first: DataFrame, edits: int) -> DataFrame:
    """``at`` of the first occurrences that have an earlier line within the bound, and ``earlier``, that line's place.

    first: ``distinct_lines``, staged.
    """
    keyed = staged(keys(first.where(F.col("n") >= MIN_CHARS).select("no", "n", "line"), edits), "line-keys")
    ends = staged(met(keyed), "line-ends")
    discard(keyed)
    some = sent_if_small(staged(ends.select(F.col("no").alias("s_")).distinct(), "line-some"))
    first = staged(first.join(some, F.col("no") == F.col("s_"), "left_semi"), "line-candidates")
    a = first.select(F.col("no").alias("a_"), F.col("at").alias("at_a"), F.col("line").alias("line_a"))
    b = first.select(F.col("no").alias("b_"), F.col("at").alias("at_b"), F.col("line").alias("line_b"))

    def verified(pairs: DataFrame) -> DataFrame:
        """no, at and earlier of the later one of each pair (no, other) within the bound."""
        near = pairs.join(a, F.col("no") == F.col("a_")).join(b, F.col("other") == F.col("b_"))
        apart = F.levenshtein("line_a", "line_b", edits)
        near = near.where((apart >= 0) & (apart <= allowed(F.least(F.length("line_a"), F.length("line_b")), edits)))
        later = F.col("at_a") > F.col("at_b")
        return near.select(F.when(later, F.col("no")).otherwise(F.col("other")).alias("no"), F.greatest("at_a", "at_b").alias("at"), F.least("at_a", "at_b").alias("earlier"))

    # Crowds: lines meet by their rarest strings.
    hot = ends.where(F.col("m") > CROWD).select(F.col("no").alias("f_")).distinct()
    hot = first.join(hot, F.col("no") == F.col("f_"), "left_semi")
    letters = {f"has_{i}": F.length("line") - F.length(F.translate("line", c, "")) for i, c in enumerate(LETTERS)}
    hot = staged(hot.withColumns(letters), "line-hot")
    rare = rarest(hot.select("no", "n", "line").repartition("no"), edits).withColumnRenamed("no", "r_")
    hot = staged(hot.drop("line").join(rare, F.col("no") == F.col("r_")).drop("r_"), "line-rare")
    hot = staged(met(hot, F.min(F.struct("at", F.col("no").alias("least"))).alias("first")), "line-crowds")
    by_first = hot.select("no", F.col("first.least").alias("other")).where("no <> other").distinct()
    decided = staged(verified(by_first), "line-sure")
    open_ = hot.join(decided.select(F.col("no").alias("s_")).distinct(), F.col("no") == F.col("s_"), "left_anti")
    few = ends.where(F.col("m") <= CROWD)
    decided = decided.unionByName(staged(verified(pairs_of(few, few, edits)), "line-few"))
    found = decided.unionByName(verified(pairs_of(open_, hot, edits)))
    return found.groupBy("no").agg(F.min("at").alias("at"), F.min("earlier").alias("earlier")).select("at", "earlier")


def decisions(docs: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """First occurrences (at), and those of them that go (at, earlier)."""
    first = staged(distinct_lines(docs), "line-first")
    return first.select("at"), staged(neighbours(first, edits), "line-near")


def counted(docs: DataFrame, edits: int = 1) -> DataFrame:
    """doc_id, n_lines (all lines), n_compared, n_equal and n_near (lines that go) and n_kept of every row of ``docs``."""
    split = F.split(empty_safe_text(docs), "\n", -1)
    base = docs.select("doc_id", print_of(docs).alias("print"), F.size(split).cast("long").alias("n_lines"), F.size(F.filter(split, filled)).cast("long").alias("n_compared"))
    base = numbered(base, ["doc_id", "print", "n_lines", "n_compared"])
    first, near = decisions(docs, edits)
    each = first.select("at", F.lit(1).alias("one"), F.lit(0).alias("near")).unionByName(near.select("at", F.lit(0).alias("one"), F.lit(1).alias("near")))
    by = each.groupBy(F.col("at.doc_id").alias("d_"), F.col("at.print").alias("p_")).agg(F.sum("one").alias("firsts"), F.sum("near").alias("near"))
    out = base.join(by, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("print") == F.col("p_")), "left")
    own = lambda c: F.when(F.col("copy") == 0, F.coalesce(c, F.lit(0))).otherwise(0)
    out = out.withColumns({"n_near": own("near").cast("long"), "n_equal": (F.col("n_compared") - own("firsts")).cast("long")})
    return out.select("doc_id", "n_lines", "n_compared", "n_equal", "n_near", (F.col("n_lines") - F.col("n_equal") - F.col("n_near")).alias("n_kept"))


def cleaned(docs: DataFrame, edits: int = 1) -> DataFrame:
    """``docs`` with the lines that go taken out of the text; all other columns as they were. A null text stays null."""
    first, near = decisions(docs, edits)
    kept = first.join(near.select(F.col("at").alias("n_")), F.col("at") == F.col("n_"), "left_anti")
    kept = kept.groupBy(F.col("at.doc_id").alias("__d"), F.col("at.print").alias("__p")).agg(F.collect_list("at.line_no").alias("__nos"))
    keyed = docs.withColumn("__print", print_of(docs))
    keyed = keyed.withColumn("__copy", F.row_number().over(W.partitionBy("doc_id", "__print").orderBy("__print")))
    joined = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__print") == F.col("__p")), "left")
    nos = F.when(F.col("__copy") == 1, F.coalesce("__nos", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~filled(x) | F.array_contains(nos, i))
    return joined.withColumn("text", F.array_join(left, "\n")).select(*docs.columns)

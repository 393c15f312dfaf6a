"""N-gram Jaccard join with a token-group matrix, and the components of its links.

Documents are sets of hashed word shingles; equal sets are one class, named by its smallest doc_id. Two
sets of similarity 0.8 or more share l tokens among the first n - ceil(0.8 n) + l of either in any order of
all tokens, so only these are posted, with l half of n - ceil(0.8 n) + 1; a document that shares fewer posted
tokens with all others has no link. The order is by hash, with tokens that blocks of the corpus hold often
put last: that keeps shared passages out of the postings, and any set of such tokens is right.

1. Each posted token names a leader, the document whose posted tokens are shared most. Documents are
   verified against the leaders of their tokens; linked ones form groups, dealt out in parts of GROUP.
   What is linked with no leader joins the group of the one it shares most with.
2. The matrix has a row (token, group) for each posted token of a group's members, and the union of their
   whole sets. A document queries the groups with other components that its tokens lead to; a group is
   opened only if its union holds as many of the document's tokens as a link takes, and then each member is
   verified.

Every pair that shares a posted token is thus verified, bounded away, or already connected; no pairs
within a group are made. Similarities are exact but for equal 64-bit hashes of different shingles.

Rows: null and empty texts and texts without words have no shingles and no links. Rows that share a
doc_id count as one document, and so do repeated rows. A null doc_id is linked with nothing. Very long texts are read in
blocks and compared whole. Other columns of the input, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .tables import discard, small_batches, staged
from .words import SPACED, as_bytes, windows, words

SHINGLE = 5
#: Linked if PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Tokens that stretches of CHUNK tokens hold more than once, OFTEN times or more in all such stretches, are put last; at most FREQUENT of them.
CHUNK, OFTEN, FREQUENT = 1 << 20, 12, 1 << 20
GROUP, GROUP_TOKENS, SALTS = 256, 1 << 20, 64


def need(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens of a set of n that any linked set shares."""
    return (PERCENT * n + 99) // 100


def head(n: int) -> int:
    """Tokens that a linked set shares at least one of."""
    return n - need(n) + 1


def least_shared(n: int) -> int:
    """How many posted tokens sets of n and more have in common with any linked set of n and more."""
    return max(1, head(n) // 2)


def least_shared_column(n: Column) -> Column:
    """``least_shared`` of the smallest set that a set of n can be linked with."""
    m = F.ceil(n * PERCENT / 100).cast("int")
    return F.greatest(F.lit(1), F.floor((m - F.floor((PERCENT * m + 99) / 100) + 1) / 2))


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, w in words(texts, SPACED):
        every = windows(w.hashes, SHINGLE)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                s = np.sort(every[a : b - SHINGLE + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            else:
                yield windows(w.hashes[a:b], b - a) if b > a else np.empty(0, np.uint64)


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Sorted tokens that some stretch of the corpus holds often, the most frequent FREQUENT at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(t[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        kept, size = [], 0
        for batch in batches:
            for s in shingle_sets(as_bytes(batch.column("text"))):
                kept.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    found = docs.select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    rows = found.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().astype(np.int64).view(np.uint64))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set (a 128-bit print of the shingles) and posted tokens of every row.

    Tokens are posted once for equal sets in one task, so that a hot group of copies shrinks before it is dealt out.
    """
    small_batches(docs.sparkSession)
    last = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            n, prints, posted = [], [], []
            for s in shingle_sets(as_bytes(batch.column("text"))):
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                take = head(len(s)) + least_shared(len(s)) - 1 if len(s) and prints[-1] not in seen else 0
                seen.add(prints[-1])
                if take and len(last.value):
                    at = np.minimum(np.searchsorted(last.value, s), len(last.value) - 1)
                    often = last.value[at] == s
                    s = np.concatenate((s[~often][:take], s[often][:take])) if often.any() else s
                posted.append(s[:take])
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in posted]))).astype(np.int32)
            flat = np.concatenate([*posted, np.empty(0, np.uint64)]).view(np.int64)
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set", "posted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set binary, posted array<bigint>")


def whole_sets(docs: DataFrame) -> DataFrame:
    """doc_id and all tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(as_bytes(batch.column("text"))))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tokens array<bigint>")


def linked(a: Column, b: Column) -> Column:
    """Whether two token arrays are similar enough."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= PERCENT * (F.size(a) + F.size(b) - both)


def postings(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id, n, token of the posted tokens of each class that others post too, under the class's name.

    rows: doc_id, n_shingles, set, posted; copies: (u, v) from a document to the name of its class.
    """
    posts = rows.select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.explode("posted").alias("token"))
    shared = lambda p: p.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("token"))).where("df > 1").drop("df")
    posts = staged(shared(posts), "join-postings")
    # A doc_id whose rows have different sets keeps its own name beside those of its classes.
    again = rows.groupBy("doc_id").agg((F.min("set") < F.max("set")).alias("many")).where("many").select(F.col("doc_id").alias("a_"), "many")
    named = posts.join(copies.select(F.col("u").alias("u_"), "v").distinct(), F.col("doc_id") == F.col("u_"), "left").join(again, F.col("doc_id") == F.col("a_"), "left")
    names = F.array_distinct(F.array(F.coalesce("v", "doc_id"), F.when(F.col("many"), F.col("doc_id")).otherwise(F.coalesce("v", "doc_id"))))
    posts = staged(shared(named.select(F.explode(names).alias("doc_id"), "n", "token").distinct()), "join-named")
    for _ in range(2):
        enough = F.count(F.lit(1)).over(W.partitionBy("doc_id", "n")) >= least_shared_column(F.col("n"))
        posts = staged(shared(posts.withColumn("enough", enough).where("enough").drop("enough")), "join-enough")
    return posts


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v) links that connect what is linked; ``rows`` is ``described``."""
    rows = rows.where("n_shingles > 0 and doc_id is not null")
    classes = rows.groupBy("set").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("set").alias("set_"), "v")
    copies = staged(rows.join(classes, F.col("set") == F.col("set_")).where("doc_id <> v").select(F.col("doc_id").alias("u"), "v"), "join-copies")
    posts = postings(rows, copies)

    # Leaders, and groups of what is linked with them.
    share = F.count(F.lit(1)).over(W.partitionBy("doc_id")) / F.col("n")
    best = F.max(F.struct(F.round("share", 6).alias("share"), F.negative("n").alias("n"), "doc_id")).over(W.partitionBy("token"))
    led = posts.withColumn("share", share).withColumn("b", best).select(F.col("doc_id").alias("u"), F.col("b.doc_id").alias("v"), "n", F.negative("b.n").alias("n2"))
    pairs = staged(led.where("u <> v and 5 * least(n, n2) >= 4 * greatest(n, n2)").groupBy("u", "v").agg(F.count(F.lit(1)).alias("c")), "join-leaders")
    some = posts.select("doc_id").distinct().withColumnRenamed("doc_id", "id")
    sets = staged(whole_sets(docs.join(some, F.col("doc_id") == F.col("id"), "left_semi")), "join-sets")
    a = sets.select(F.col("doc_id").alias("u"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("tokens").alias("tb"))
    first = staged(pairs.select("u", "v").join(a, "u").join(b, "v").where(linked(F.col("ta"), F.col("tb"))).select("u", "v"), "join-links")
    found = components(first)

    # The matrix of groups, and the groups that documents of other components query. What is linked with nothing
    # yet goes to the group of the leader that it shares most with.
    near = pairs.groupBy(F.col("u").alias("n_")).agg(F.max(F.struct("c", "v")).alias("x")).join(found, F.col("x.v") == F.col("node"), "left").select("n_", F.coalesce("root", "x.v").alias("near"))
    placed = posts.join(found, F.col("doc_id") == F.col("node"), "left").join(near, F.col("doc_id") == F.col("n_"), "left")
    placed = placed.select("doc_id", "n", "token", F.coalesce("root", "doc_id").alias("root"), F.coalesce("root", "near", "doc_id").alias("gid"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select(F.col("token").alias("t_"))
    placed = staged(placed.join(mixed, F.col("token") == F.col("t_")).drop("t_"), "join-mixed")
    # Groups of more members or tokens than one part takes are few; their rows are salted, so that no task gets a group.
    sizes = placed.select("doc_id", "n", "gid").distinct().groupBy(F.col("gid").alias("g_")).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
    sizes = sizes.withColumn("parts", F.ceil(F.greatest(F.col("members") / GROUP, F.col("tokens") / GROUP_TOKENS))).where("parts > 1")
    sizes = sizes.select("g_", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "token"), F.lit(SALTS)).cast("int"))
    placed = placed.join(sizes, (F.col("gid") == F.col("g_")) & (F.col("salt") == F.col("salt_")), "left")
    placed = staged(placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1)))).drop("g_", "salt", "salt_", "parts"), "join-placed")
    one = F.when(F.min("doc_id") == F.max("doc_id"), F.max("doc_id"))
    matrix = placed.groupBy("token", "gid", "part").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("root").alias("r0"), one.alias("only"))
    alone = placed.groupBy(F.col("gid").alias("g_"), F.col("part").alias("p_")).agg((F.min("doc_id") == F.max("doc_id")).alias("alone"))
    q = placed.select(F.col("token").alias("t_"), F.col("root").alias("own"), F.col("doc_id").alias("q"), "n")
    ask = q.join(matrix, (F.col("t_") == F.col("token")) & (F.col("own") > F.col("r0"))).where("5 * n >= 4 * n0 and 4 * n <= 5 * n1")
    ask = ask.select("q", "gid", "part", "only").distinct()
    # What is known of a pair counts for its group only where the group has one member.
    ask = ask.join(alone, (F.col("gid") == F.col("g_")) & (F.col("part") == F.col("p_"))).select("q", "gid", "part", F.when(F.col("alone"), F.col("only")).alias("only")).distinct()
    known = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).select(F.col("u").alias("q_"), F.col("v").alias("only_"))
    ask = staged(ask.join(known, (F.col("q") == F.col("q_")) & (F.col("only") == F.col("only_")), "left_anti").select("q", "gid", "part"), "join-asked")
    asked = ask.select(F.col("gid").alias("g_"), F.col("part").alias("p_")).distinct()
    in_group = placed.select("doc_id", "gid", "part").distinct().join(asked, (F.col("gid") == F.col("g_")) & (F.col("part") == F.col("p_")), "left_semi")
    groups = in_group.join(sets.withColumnRenamed("doc_id", "d_"), F.col("doc_id") == F.col("d_")).groupBy("gid", "part").agg(F.collect_list(F.struct("doc_id", "tokens")).alias("members"), F.min(F.size("tokens")).alias("least"))
    groups = groups.withColumn("union", F.array_distinct(F.flatten("members.tokens")))
    queried = ask.join(sets.select(F.col("doc_id").alias("q_"), F.col("tokens").alias("tq")), F.col("q") == F.col("q_")).drop("q_").join(groups, ["gid", "part"])
    # A member of m tokens that is linked with n shares PERCENT / (100 + PERCENT) of n + m; m is PERCENT of n at least.
    bound, n = F.size(F.array_intersect("tq", "union")), F.size("tq")
    opened = queried.where(((100 + PERCENT) * bound >= PERCENT * (n + F.col("least"))) & (100 * bound >= PERCENT * n))
    second = opened.select(F.col("q").alias("u"), F.explode(F.filter("members", lambda m: (m["doc_id"] != F.col("q")) & linked(F.col("tq"), m["tokens"]))).alias("m")).select("u", F.col("m.doc_id").alias("v"))
    return staged(first.unionByName(second).unionByName(copies.select("u", "v")), "join-all-links")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    rows = staged(described(docs), "join-rows")
    every = staged(rows.select("doc_id", "n_shingles"), "join-sizes")
    found = components(links(docs, rows))
    discard(rows)
    return every.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their component, all columns as they were.

    Rows that share a doc_id are one document and stay together; a null doc_id stays.
    """
    gone = joined(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")

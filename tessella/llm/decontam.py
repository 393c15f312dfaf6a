"""Benchmark decontamination: a broadcast set of the benchmark's n-grams, and a scan of the documents.

An item's windows are its runs of ``WINDOW`` words; an item of fewer words is one window. Windows are counted, and the
benchmark is dealt into blocks of at most ``LIMIT`` windows (one item may be more). A block is broadcast as sorted
arrays of hashes, items and places, and the documents are scanned; where there are several blocks, one after the
other is sent, scanned with and dropped, so that a worker never holds more than one. A hash that is found is verified
against the item's words.

Rows: null and empty texts have no words and are never contaminated. An item without words has no window. Items that
repeat are all reported; a null item_id is never reported but its windows hit. An empty benchmark hits nothing, and
an empty table gives no rows. Very long texts are read in blocks. Rows that repeat, or share a doc_id, are judged one
by one. Other columns keep their values, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, small_batches, staged
from .words import ALNUM, as_bytes, windows, words

WINDOW = 13
#: A document with hits is contaminated if at least one word in RATIO is hit.
RATIO = 20
#: Windows in one broadcast block: 24 bytes each, and the items' words.
LIMIT = 1 << 20
_BITS = 20
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Block:
    """The windows of some items: sorted hashes, and for each the item and where its words are; words by one blank each."""

    def __init__(self, items: list[tuple[str | None, bytes]]) -> None:
        self.names = [i for i, _ in items]
        texts = [t for _, t in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        parts, at = [], 0
        for k, w in words(texts, ALNUM, places=True):
            for j in range(len(w.first) - 1):
                a, b = w.first[j], w.first[j + 1]
                if a == b:
                    continue
                text = texts[k + j].translate(_FOLD)
                parts.append(b" ".join(text[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)))
                size = int(min(WINDOW, b - a))
                length = w.ends[a:b] - w.starts[a:b]
                ends = at + np.cumsum(length + 1) - 1
                n = int(b - a) - size + 1
                found.setdefault(size, []).append((windows(w.hashes[a:b], size), np.full(n, k + j, np.int32), (ends - length)[:n], ends[size - 1 :]))
                at = int(ends[-1]) + 1
        self.text = b" ".join(parts)
        self.sizes = {}
        for size, rows in found.items():
            hashes, item, start, end = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.argsort(hashes, kind="stable")
            maybe = np.zeros(1 << _BITS, bool)
            maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.sizes[size] = (hashes[order], maybe, item[order], start[order], end[order])

    def hits(self, hashes: np.ndarray, each: Callable[[int, int], bytes]) -> Iterator[tuple[int, int, set[str | None]]]:
        """(first word, number of words, items) of every window of the document that an item has. each: a window's words."""
        for size, (known, maybe, item, start, end) in self.sizes.items():
            h = windows(hashes, size)
            at = np.flatnonzero(maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            first, last = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], side="right")
            for i, a, b in zip(at[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist(), strict=True):
                mine = each(i, size)
                if items := {self.names[item[x]] for x in range(a, b) if self.text[start[x] : end[x]] == mine}:
                    yield i, size, items


def blocks(benchmark: DataFrame, limit: int = LIMIT) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items of at most ``limit`` windows each time, or one item; fetched a partition at a time."""
    items, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).toLocalIterator():
        text = row["t"].encode()
        n = sum(len(w.hashes) for _, w in words([text], ALNUM))
        n = max(n - WINDOW + 1, int(n > 0))
        if items and size + n > limit:
            yield items
            items, size = [], 0
        if n:
            items.append((row["i"], text))
            size += n
    if items:
        yield items


def scanned(docs: DataFrame, block: Block | None, further: bool) -> DataFrame:
    """``docs`` with ``n_words``, ``hit`` and ``items``; further: it has them from other blocks, and they are added to."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    out = pa.schema([("n_words", pa.int64()), ("hit", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            n_words: list[int] = []
            hit = batch.column("hit").to_pylist() if further else [[] for _ in texts]
            items = batch.column("items").to_pylist() if further else [[] for _ in texts]
            for k, w in words(texts, ALNUM, places=True):
                for j in range(len(w.first) - 1):
                    a, b = int(w.first[j]), int(w.first[j + 1])
                    n_words.append(b - a)
                    if sent.value is None:
                        continue
                    text, starts, ends = texts[k + j], w.starts[a:b], w.ends[a:b]

                    def each(i: int, size: int, text: bytes = text, starts: np.ndarray = starts, ends: np.ndarray = ends) -> bytes:
                        return b" ".join(text[starts[x] : ends[x]] for x in range(i, i + size)).translate(_FOLD)

                    names = set()
                    for i, size, found in sent.value.hits(w.hashes[a:b], each):
                        hit[k + j] += (i, size)
                        names |= found
                    if names:
                        items[k + j] = sorted({*items[k + j], *(x for x in names if x is not None)})
            kept = [n for n in batch.schema.names if not (further and n in out.names)]
            extra = [pa.array(x, f.type) for x, f in zip((n_words, hit, items), out, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *extra], names=[*kept, *out.names])

    kept = [f for f in docs.schema if not (further and f.name in out.names)]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return docs.mapInArrow(run, kinds + "n_words bigint, hit array<bigint>, items array<string>")


def scan(docs: DataFrame, benchmark: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``n_words``, ``hit`` (first word and number of words, alternating) and ``items`` (sorted ids)."""
    small_batches(docs.sparkSession)
    found, waiting = None, None
    for items in blocks(benchmark, limit):
        if waiting is not None:
            before, found = found, staged(scanned(docs if found is None else found, waiting, found is not None), "decontaminated")
            if before is not None:
                discard(before)
        waiting = Block(items)
    return scanned(docs if found is None else found, waiting, found is not None)


def covered(hit: list[int]) -> list[tuple[int, int]]:
    """Joined runs of words from ``scan``'s hits."""
    runs: list[list[int]] = []
    for a, b in sorted((hit[i], hit[i] + hit[i + 1]) for i in range(0, len(hit), 2)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def judged(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """``keep`` (default: doc_id), n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    keep = ["doc_id"] if keep is None else keep
    need = list(dict.fromkeys([*keep, "text"]))
    found = scan(docs.select(*[F.col(c) for c in need]), benchmark, limit)
    order = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("hit") - 1, F.lit(0))), lambda i: i % 2 == 0), lambda i: F.struct(F.get("hit", i).alias("a"), (F.get("hit", i) + F.get("hit", i + 1)).alias("b"))))
    n_hit = F.aggregate(
        order,
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["to"], x["b"]).alias("to"), (acc["n"] + F.greatest(x["b"] - F.greatest(acc["to"], x["a"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )
    found = found.withColumn("n_hit", F.when(F.size("hit") > 0, n_hit).otherwise(F.lit(0)).cast("long"))
    return found.select(
        *keep,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (RATIO * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns) if c != "text"}
    found = judged(docs.withColumnsRenamed(names), benchmark, [names.get(c, c) for c in docs.columns])
    return found.where("not contaminated").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every hit run of words cut out of the text; all other columns as they were."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns) if c != "text"}
    found = scan(docs.withColumnsRenamed(names), benchmark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hit").to_pylist()
            texts = batch.column("text").to_pylist()
            for k, hit in enumerate(hits):
                if hit:
                    raw = texts[k].encode()
                    (_, w), = words([raw], ALNUM, places=True)
                    out, at = [], 0
                    for a, b in covered(hit):
                        out.append(raw[at : w.starts[a]])
                        at = int(w.ends[b - 1])
                    texts[k] = b"".join([*out, raw[at:]]).decode()
            kept = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names if n not in ("n_words", "hit", "items")]
            yield pa.RecordBatch.from_arrays(kept, names=[n for n in batch.schema.names if n not in ("n_words", "hit", "items")])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.withColumnsRenamed(names).schema)
    return found.mapInArrow(cut, kinds).withColumnsRenamed({v: k for k, v in names.items()})

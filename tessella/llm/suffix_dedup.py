"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that starts more than once in the corpus.

Suffixes of the whole corpus are dealt to buckets that can be sorted side by side: a string's anchor is its
GRAM bytes of least hash, so equal strings have equal anchors at equal places. Consecutive starts with one
anchor form a run.

1. Texts are named by a 128-bit print, and equal texts are one from here on: all their strings are repeated. An
   anchor that occurs at one place only of all distinct texts has no other repeated string and is dropped.
2. One run of each remaining content is cut into pieces of PIECE starts at fixed places from the anchor; a run
   that occurs more than once is a twin of itself. The bytes that all strings of a piece share (its core) are the
   bucket. A bucket of one piece without a twin has no repeat.
3. All other pieces, twins twice, are sorted as suffixes in two stages: those smaller than their successor directly,
   the rest induced by scanning the buckets of their first bytes; neighbours whose common prefix is LENGTH or
   more are repeated. Nothing else marks a string.
4. A bucket of more than FIT pieces, as at the edge of a passage that very many documents share, is split by the
   bytes around its core: its pieces are cut into smaller ones, whose cores are longer, until buckets fit. A
   piece of one start has the whole string as its core, so the last buckets hold one piece and its twin.

Rows: null counts as the empty text; texts under LENGTH bytes, the empty one among them, keep everything. Rows that
share a doc_id, or have none, are told apart by their texts; rows that repeat get the same result each. Very long
texts are read in overlapping parts. Other columns of the input, whatever their names, are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, empty_safe_text, small_batches, staged
from .words import _BASE, BLOCK, U, as_bytes, mix, powers
from .words import _VALUES as VALUES

LENGTH = 200
GRAM = 32
PLACES = LENGTH - GRAM + 1
#: Starts of a piece, at first and when a bucket of more than FIT pieces has to be split.
PIECE = 57
SPLITS = (8, 1)
FIT = 1000
#: Bytes of pieces that are sorted at once.
PACK = 1 << 18
_PLACE_BITS = 22
#: No byte of UTF-8.
END = 0xFF


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    h, step, base = VALUES[buf], 1, int(_BASE)
    while step < GRAM:
        h = h[:-step] * U(base) + h[step:]
        base = base * base % (1 << 64)
        step *= 2
    return mix(h)


def runs(buf: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs in a block of texts: hash of the anchor, print of the run, start, number of starts, anchor's place from the start.

    last: for each position the end of its text.
    """
    h = gram_hashes(buf)
    n = len(buf) - LENGTH + 1
    with np.errstate(over="ignore"):
        low = (h >> U(_PLACE_BITS) << U(_PLACE_BITS)) | np.arange(len(h), dtype=U)
        size = 1
        while size * 2 <= PLACES:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: n], low[PLACES - size : PLACES - size + n])
        valid = np.arange(n) + LENGTH <= last[:n]
        # A run ends where the anchor changes or the text does.
        turn = np.flatnonzero((low[1:] != low[:-1]) | (valid[1:] != valid[:-1])) + 1
        a = np.concatenate(([0], turn))
        b = np.concatenate((turn, [n]))
        keep = valid[a]
        a, b = a[keep], b[keep]
        place = (low[a] & U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        up, down = powers(len(buf) + 1)
        total = np.concatenate((np.zeros(1, U), np.cumsum(VALUES[buf] * up[: len(buf)], dtype=U)))
        print_ = mix((total[b + LENGTH - 1] - total[a]) * down[a] + (b - a).astype(U))
    return h[place], print_, a, b - a, place - a


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, end of the text at each position, first position of each text in the block, numbers of the texts); a long text comes in overlapping parts."""
    k = 0
    while k < len(texts):
        n = len(texts[k])
        if n > BLOCK:
            for at in range(0, n - LENGTH + 1, BLOCK):
                buf = np.frombuffer(texts[k][at : at + BLOCK + LENGTH - 1], np.uint8)
                yield buf, np.full(len(buf), len(buf)), np.array([-at]), np.array([k])
            k += 1
            continue
        to, size = k, 0
        while to < len(texts) and size + len(texts[to]) <= BLOCK:
            size += len(texts[to])
            to += 1
        buf = np.frombuffer(b"".join(texts[k:to]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[k:to]])
        if len(buf) >= LENGTH:
            yield buf, np.repeat(ends, [len(t) for t in texts[k:to]]), ends - [len(t) for t in texts[k:to]], np.arange(k, to)
        k = to


def named(docs: DataFrame) -> DataFrame:
    """text, and name, a 128-bit print of it, of every row."""
    text = empty_safe_text(docs)
    return docs.select(text.alias("text"), F.unhex(F.md5(text)).alias("name"))


def all_runs(texts: DataFrame) -> DataFrame:
    """name, h, rh, start, n, off, m: m equal runs of n starts that follow each other count as one row.

    A task gives the runs of equal texts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh = []
            for k, name in enumerate(batch.column("name").to_pylist()):
                if name not in seen:
                    seen.add(name)
                    fresh.append(k)
            names = batch.column("name").take(pa.array(fresh, pa.int64()))
            for buf, last, first, numbers in blocks(as_bytes(batch.column("text").take(pa.array(fresh, pa.int64())))):
                h, rh, a, n, off = runs(buf, last)
                if not len(a):
                    continue
                row = np.searchsorted(first, a, side="right") - 1 if len(first) > 1 else np.zeros(len(a), np.int64)
                same = np.concatenate(([False], (h[1:] == h[:-1]) & (rh[1:] == rh[:-1]) & (n[1:] == n[:-1]) & (row[1:] == row[:-1])))
                lead = np.flatnonzero(~same)
                m = np.diff(np.concatenate((lead, [len(a)])))
                columns = [pa.array(h[lead].view(np.int64)), pa.array(rh[lead].view(np.int64)), pa.array((a - first[row])[lead].astype(np.int32)), pa.array(n[lead].astype(np.int16)), pa.array(off[lead].astype(np.int16)), pa.array(m.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(numbers[row[lead]])), *columns], names=["name", "h", "rh", "start", "n", "off", "m"])

    return texts.select("name", "text").mapInArrow(run, "name binary, h bigint, rh bigint, start int, n smallint, off smallint, m int")


def print_of(data: bytes, place: int) -> bytes:
    return hashlib.blake2b(data + bytes([place]), digest_size=16).digest()


def parts(data: bytes, o0: int, o1: int, size: int) -> Iterator[tuple[bytes, bytes, int, int, bytes]]:
    """core, print, o0, o1 and bytes of the pieces of ``size`` starts in ``data``.

    The strings in it start o1, o1 - 1, ... o0 bytes before their anchor. Where a piece ends depends on these places
    only, so equal strings fall into pieces with equal cores.
    """
    for j in range(o0 // size, o1 // size + 1):
        a, b = max(o0, j * size), min(o1, j * size + size - 1)
        core_at = o1 - j * size
        core = data[core_at : core_at + LENGTH - size + 1]
        piece = data[o1 - b : o1 - a + LENGTH]
        yield print_of(core, j), print_of(piece, a), a, b, piece


def cut_pieces(reps: DataFrame) -> DataFrame:
    """Rows of ``reps`` (text, and runs as h, rh, start, n, off, twin) as pieces: h, rh, core, print, o0, o1, twin, bytes.

    Where a task cuts a piece again, it leaves out the bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text, each in zip(as_bytes(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                for r in each:
                    if r is None:
                        continue
                    at, to = r["start"], r["off"]  # the first start, and its anchor's place
                    data = text[at : at + r["n"] - 1 + LENGTH]
                    for core, print_, o0, o1, piece in parts(data, to - r["n"] + 1, to, PIECE):
                        for c, v in zip(out, (r["h"], r["rh"], core, print_, o0, o1, r["twin"], None if print_ in seen else piece), strict=True):
                            c.append(v)
                        seen.add(print_)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "rh", "core", "print", "o0", "o1", "twin", "bytes"])

    return reps.select("text", "runs").mapInArrow(run, "h bigint, rh bigint, core binary, print binary, o0 int, o1 int, twin boolean, bytes binary")


def split_pieces(pieces: DataFrame, size: int) -> DataFrame:
    """Pieces cut into pieces of ``size`` starts: core_, print_ and o1_ of the one that was cut, and those of the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core_", "print_", "o1_", "core", "print", "o0", "o1", "twin", "bytes"]
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for core, print_, o0, o1, piece in parts(r["bytes"], r["o0"], r["o1"], size):
                    rows.append((r["core"], r["print"], r["o1"], core, print_, o0, o1, r["twin"], piece))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pieces.select("core", "print", "o0", "o1", "twin", "bytes").mapInArrow(run, "core_ binary, print_ binary, o1_ int, core binary, print binary, o0 int, o1 int, twin boolean, bytes binary")


def stretches(buf: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the ``depth`` bytes from each position, with zeros after the end."""
    padded = np.concatenate((buf, np.zeros(depth, np.uint8)))
    up, down = powers(len(padded) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(VALUES[padded] * up[: len(padded)], dtype=U)))
    return mix((total[depth : depth + len(buf)] - total[: len(buf)]) * down[: len(buf)])


def words_of(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number that is greater if they are."""
    return np.ndarray(len(buf) - 7, ">u8", np.ascontiguousarray(buf), strides=(1,)).astype(U)


def suffix_order(buf: np.ndarray, depth: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes of ``buf``, sorted by their first ``depth`` bytes at least, in two stages.

    ``buf`` has to end with its greatest byte; ``whole`` is its ``stretches``. Suffixes smaller than their successor are sorted directly, a
    word of eight bytes at a time; each of the others follows from its successor's place.
    """
    n = len(buf)
    padded = np.concatenate((buf, np.zeros(depth + 16, np.uint8)))
    word = words_of(padded)
    # A suffix is smaller than its successor if the next byte that differs is greater; the end counts as less than all bytes.
    change = np.flatnonzero(buf[1:] != buf[:-1])
    smaller = np.zeros(n, bool)
    smaller[: change[-1] + 1 if len(change) else 0] = np.repeat(buf[change + 1] > buf[change], np.diff(change, prepend=-1))

    idx = np.flatnonzero(smaller)
    whole = stretches(buf, depth) if whole is None else whole
    group = np.zeros(len(idx), np.int64)
    open_ = np.arange(len(idx))
    for k in range(0, depth, 8):
        if not len(open_):
            break
        # Groups of equal stretches of ``depth`` bytes need no order; groups that agree in this word need no sorting.
        rows, g = idx[open_], group[open_]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        count = np.diff(np.concatenate((first, [len(g)])))
        same = whole[rows] == np.repeat(whole[rows[first]], count)
        live = np.repeat(~np.logical_and.reduceat(same, first), count)
        open_, rows, g = open_[live], rows[live], g[live]
        if not len(open_):
            break
        key = word[np.minimum(rows + k, n)]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        count = np.diff(np.concatenate((first, [len(g)])))
        apart = np.repeat(np.logical_or.reduceat(key != np.repeat(key[first], count), first), count)
        if not apart.any():
            continue
        part = open_[apart]
        order = np.lexsort((key[apart], g[apart])) if k else np.argsort(key)
        idx[part] = rows[apart][order]
        key, g = key[apart][order], g[apart]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])))
        first = np.flatnonzero(new)
        group[part] = part[first[np.cumsum(new) - 1]]
        tied = np.diff(np.concatenate((first, [len(part)]))) > 1
        open_ = np.sort(np.concatenate((open_[~apart], part[tied[np.cumsum(new) - 1]])))

    counts = np.bincount(buf, minlength=256)
    head = np.concatenate(([0], np.cumsum(counts)))
    direct = np.bincount(buf[idx], minlength=256)
    at_direct = np.concatenate(([0], np.cumsum(direct)))
    out = np.empty(n, np.int64)
    fill = head[:-1].copy()
    fill_to = head[1:]

    def induce(found: np.ndarray) -> np.ndarray:
        """Places the greater predecessors of sorted suffixes; returns those that fell into the bucket being scanned."""
        prev = found[found > 0] - 1
        prev = prev[~smaller[prev]]
        if not len(prev):
            return prev
        c = buf[prev]
        by = np.argsort(c, kind="stable")
        prev, c = prev[by], c[by]
        edge = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]))
        own = prev[:0]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            x = int(c[a])
            out[fill[x] : fill[x] + b - a] = prev[a:b]
            fill[x] += b - a
            if x == scanned:
                own = prev[a:b]
        return own

    # The last suffix is a single byte: the first of the greater ones in its bucket.
    x = int(buf[-1])
    out[fill[x]] = n - 1
    fill[x] += 1
    for scanned in range(256):
        if not counts[scanned]:
            continue
        wave = out[head[scanned] : fill[scanned]].copy()
        while len(wave):
            wave = induce(wave)
        mine = idx[at_direct[scanned] : at_direct[scanned + 1]]
        out[fill_to[scanned] - len(mine) : fill_to[scanned]] = mine
        induce(mine)
    return out


def equal_neighbours(buf: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, whole: np.ndarray) -> np.ndarray:
    """Whether the common prefix of neighbours is ``depth`` bytes or more; suffixes are at least that long."""
    live = np.flatnonzero(whole[a] == whole[b])
    word = words_of(buf)
    for k in [*range(0, depth - 7, 8), depth - 8]:
        live = live[word[a[live] + k] == word[b[live] + k]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def repeated(pieces: list[bytes], length: int = LENGTH) -> list[int]:
    """For each piece the bits of the starts whose string of ``length`` bytes starts elsewhere in the pieces too."""
    buf = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
    alike = stretches(buf, length)
    order = suffix_order(buf, length, alike)
    size = np.array([len(p) for p in pieces])
    first = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    owner = np.repeat(np.arange(len(pieces)), size + 1)
    whole = np.arange(len(buf)) + length <= (first + size)[owner]
    order = order[whole[order]]
    if len(order) < 2:
        return [0] * len(pieces)
    twin = equal_neighbours(buf, order[:-1], order[1:], length, alike)
    hit = np.zeros(len(buf), bool)
    hit[order[:-1][twin]] = True
    hit[order[1:][twin]] = True
    at = np.flatnonzero(hit)
    out = np.zeros(len(pieces), np.int64)
    np.bitwise_or.at(out, owner[at], np.left_shift(1, at - first[owner[at]]))
    return out.tolist()


def sorted_pieces(pieces: DataFrame) -> DataFrame:
    """core, print and ``mask`` (bit i: the string i bytes after the piece's start is repeated) of distinct pieces; twins count twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            masks = repeated([r["bytes"] for r in held] + [r["bytes"] for r in held if r["twin"]])[: len(held)]
            return pa.RecordBatch.from_arrays([pa.array([r["core"] for r in held], pa.binary()), pa.array([r["print"] for r in held], pa.binary()), pa.array(masks, pa.int64())], names=["core", "print", "mask"])

        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if size >= PACK and r["core"] != held[-1]["core"]:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"]) * (1 + r["twin"])
        if held:
            yield flush()

    return pieces.select("core", "print", "twin", "bytes").repartition("core").sortWithinPartitions("core").mapInArrow(run, "core binary, print binary, mask bigint")


def marked(pieces: DataFrame, splits: tuple[int, ...] = SPLITS) -> DataFrame:
    """core, print and mask of ``pieces`` (core, print, o0, o1, twin, bytes) that hold repeated strings; equal pieces are twins."""
    distinct = pieces.groupBy("core", "print").agg(((F.count(F.lit(1)) > 1) | F.max("twin")).alias("twin"))
    sizes = distinct.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.max("twin").alias("t")).where("k > 1 or t").select(F.col("core").alias("s_"), (F.col("k") > FIT).alias("large"))
    wanted = staged(distinct.join(sizes, F.col("core") == F.col("s_")).select(F.col("core").alias("c_"), F.col("print").alias("p_"), "twin", "large"), "suffix-buckets")
    given = pieces.where("bytes is not null").select("core", "print", "o0", "o1", "bytes")
    given = given.join(wanted, (F.col("core") == F.col("c_")) & (F.col("print") == F.col("p_"))).drop("c_", "p_").dropDuplicates(["core", "print"])
    found = sorted_pieces(given.where("not large"))
    if splits and not wanted.where("large").isEmpty():
        cut = staged(split_pieces(given.where("large"), splits[0]), "suffix-splits")
        below = marked(cut, splits[1:]).select(F.col("core").alias("c_"), F.col("print").alias("p_"), "mask")
        back = cut.join(below, (F.col("core") == F.col("c_")) & (F.col("print") == F.col("p_")))
        moved = F.expr("shiftleft(mask, o1_ - o1)")
        found = found.unionByName(back.select(F.col("core_").alias("core"), F.col("print_").alias("print"), moved.alias("mask")).groupBy("core", "print").agg(F.expr("bit_or(mask)").alias("mask")))
    return found.where("mask <> 0")


def removed(docs: DataFrame) -> DataFrame:
    """name, n_removed, n_spans, kept (the remaining bytes) of the distinct texts that lose bytes, but for texts that
    are in more than one row, which lose all of them; name is that of ``named``.
    """
    small_batches(docs.sparkSession)
    docs = named(docs)
    every = staged(all_runs(docs), "suffix-runs")
    # Equal texts that were read by several tasks give the same places.
    place = F.xxhash64("name", "start")
    anchors = every.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("m").alias("m")).where("a < b or m > 1").select(F.col("h").alias("h_"))
    twice = staged(every.join(anchors, F.col("h") == F.col("h_")).drop("h_"), "suffix-anchors")
    discard(every)
    twin = (F.min(place) < F.max(place)) | (F.max("m") > 1)
    classes = twice.groupBy("h", "rh").agg(twin.alias("twin"), F.min(F.struct("name", "start", "n", "off")).alias("rep"))
    reps = classes.select(F.col("rep.name").alias("n_"), F.struct("h", "rh", "rep.start", "rep.n", "rep.off", "twin").alias("run"))
    touched = twice.select(F.col("name").alias("n_")).distinct().withColumn("run", F.lit(None).cast(reps.schema["run"].dataType))
    asked = reps.unionByName(touched).groupBy("n_").agg(F.collect_list("run").alias("runs"))
    # Copies go in each task before they are dealt out by name.
    texts = staged(docs.dropDuplicates(["name"]).join(asked, F.col("name") == F.col("n_")).drop("n_"), "suffix-texts")
    pieces = staged(cut_pieces(texts.where("size(runs) > 0")), "suffix-pieces")
    masks = staged(marked(pieces), "suffix-masks").select(F.col("core").alias("c_"), F.col("print").alias("p_"), "mask")
    hits = pieces.drop("bytes").join(masks, (F.col("core") == F.col("c_")) & (F.col("print") == F.col("p_")))
    hits = hits.groupBy(F.col("h").alias("h_"), F.col("rh").alias("r_")).agg(F.collect_list(F.struct("o1", "mask")).alias("parts"))
    hits = staged(hits, "suffix-verdicts")
    discard(pieces)
    some = twice.join(hits, (F.col("h") == F.col("h_")) & (F.col("rh") == F.col("r_")))
    covers = some.groupBy(F.col("name").alias("n_")).agg(F.collect_set(F.struct("start", "off", "m", "n", "parts")).alias("covers"))
    found = texts.drop("runs").join(covers, F.col("name") == F.col("n_")).drop("n_")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, spans, kept = [], [], []
            for text, each in zip(as_bytes(batch.column("text")), batch.column("covers").to_pylist(), strict=True):
                step = np.zeros(len(text) + 1, np.int64)
                for r in each:
                    for part in r["parts"]:
                        at, mask = r["start"] + r["off"] - part["o1"], part["mask"]
                        while mask:
                            a = (mask & -mask).bit_length() - 1
                            b = a + ((mask >> a) + 1 & -((mask >> a) + 1)).bit_length() - 1  # the end of this run of ones
                            mask = mask >> b << b
                            for k in range(r["m"]):
                                step[at + k * r["n"] + a] += 1
                                step[at + k * r["n"] + b - 1 + LENGTH] -= 1
                covered = np.cumsum(step[:-1]) > 0
                gone.append(int(covered.sum()))
                spans.append(int((covered & ~np.concatenate(([False], covered[:-1]))).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~covered].tobytes())
            extra = [pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("name"), *extra], names=["name", "n_removed", "n_spans", "kept"])

    return found.mapInArrow(cut, "name binary, n_removed bigint, n_spans bigint, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    t = empty_safe_text(docs)
    base = docs.select("doc_id", F.unhex(F.md5(t)).alias("name"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t.cast("binary"), 256).alias("sha"))
    base = staged(base, "suffix-base")
    copied = base.groupBy(F.col("name").alias("m_")).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1).select("m_")
    cut = removed(docs).select(F.col("name").alias("n_"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    known = cut.join(copied, F.col("n_") == F.col("m_"), "full_outer").select(F.coalesce("n_", "m_").alias("n_"), F.col("m_").isNotNull().alias("all_"), "n_removed", "n_spans", "kept_sha256")
    out = base.join(known, F.col("name") == F.col("n_"), "left")
    gone = F.col("all_") & (F.col("n_bytes") >= LENGTH)
    count = lambda c, whole: F.when(gone, whole).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("doc_id", "n_bytes", count("n_removed", F.col("n_bytes")), count("n_spans", F.lit(1)), F.when(gone, none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))

"""LM scoring: the masked pseudo-likelihood of a document under a bidirectional window network.

Each token is masked in turn and predicted from SIDE words on both sides; a document's score is the sum of the
log-probabilities of its tokens.

1. Words are counted by their full 64-bit hash in a distributed table of the whole corpus. The HEAD most frequent ones
   are the network's vocabulary; all others are its word "other", of which each has a share by its count. Counts of
   the KNOWN most frequent words at most are broadcast, those of all others are joined to their tokens.
2. The network embeds the words of the window, and predicts a class of words (of like mass), then the word among the
   class's members, both by a softmax over what the window gives. It is trained in numpy: in each of ROUNDS rounds
   each task follows the gradient through every token of its own texts from common weights, and the tasks' changes are
   averaged by how often they met each weight.
3. The network forgets rare windows; the corpus doesn't. Windows whose hash is a multiple of ``memory`` (1: every window)
   are counted with the words they hold, all over the corpus, the token itself left out. With c other occurrences the
   prediction is ``(network * KAPPA + count among them) / (c + KAPPA)``. This is a distribution too. A text that repeats
   itself is recalled by its own other tokens. Each token in such a window is sent once, packed into
   12 bytes or so (fewer if a chunk of texts holds it twice), to the bucket of its window's hash. Two windows are taken as equal if the bucket and 48 further bits of
   their hashes agree, two words of a window if 24 bits do; a logarithm that is sent is rounded to 2 ** -17, and what memory
   adds to a row is summed from floats.

Rows: null and empty texts have no tokens, score 0 and mean null. Very long texts are read in blocks. Repeated rows are
texts of their own, and so know each other. Rows that share a doc_id, or have none, are scored one by one. Other
columns of the input, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import freed, small_batches, staged
from .words import SPACED, U, as_bytes, mix, words

SIDE = 2
HEAD, KNOWN = 1 << 13, 1 << 20
CLASSES = 64
WIDTH = 16
ROUNDS, BATCH, RATE = 1, 1 << 14, 0.08
#: Windows whose hash is a multiple of MEMORY are remembered if the caller doesn't say; the registered query remembers all.
MEMORY, KAPPA = 16, 1.0
#: Tokens that are counted, or scored, at once.
CHUNK, BLOCK = 1 << 20, 1 << 14
#: Of those, tokens whose classes are weighed at once.
PART = 1 << 11
#: Tokens, and rows, of a chunk of texts whose windows are sent together; tokens of a bucket of windows, about.
SENT, ROWS, BUCKET = 1 << 20, 1 << 16, 1 << 19
#: Bits of a window's hash that are sent besides its bucket, and of a word's; steps of a log-probability that is sent, and its end.
KEY_BITS, WORD_BITS, STEPS, LEAST = 48, 24, 1 << 17, -127.0
_TURN = U(0x9E3779B97F4A7C15)


def counted(docs: DataFrame) -> DataFrame:
    """w, n: how often each word occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

        kept, size = [], 0
        for batch in batches:
            for _, x in words(as_bytes(batch.column("text")), SPACED):
                kept.append(x.hashes)
                size += len(x.hashes)
                if size >= CHUNK:
                    yield flush()
                    kept, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def around(x: np.ndarray, first: np.ndarray, edge: int) -> np.ndarray:
    """Values of the SIDE tokens to the left and to the right of each token, in order; ``edge`` beyond its text."""
    n = len(x)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, 2 * SIDE), edge, x.dtype)
    for j, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -d), n - max(0, d)
        if a < b:
            same = text[a:b] == text[a + d : b + d]
            out[a:b, j][same] = x[a + d : b + d][same]
    return out


def window_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the words around each token; never 0."""
    h = np.zeros(len(hashes), U)
    for column in around(hashes, first, 0).T:
        h = mix(h * _TURN + column + U(1))
    return h | U(1) << U(63)


@dataclass
class Network:
    """Weights, and the vocabulary: known hashes in order, the number of each, and where each class starts.

    Word ``size`` stands for all others, and is a class of its own, the last; ``size + 1`` is the edge of a text.
    """

    known: np.ndarray
    number: np.ndarray
    starts: np.ndarray
    embed: np.ndarray  # a row for each word of a window
    hidden: np.ndarray  # from the window to the hidden units; the last row is the bias
    classes: np.ndarray  # from the hidden units to the classes; the last row is the bias
    members: np.ndarray  # from the hidden units to each word; the last column is the bias
    rest: np.ndarray  # hashes, in order, of further words whose counts are known
    share: np.ndarray  # the logarithm of their share of all other words

    @property
    def size(self) -> int:
        return len(self.known)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), self.size - 1)
        return np.where(self.known[at] == hashes, self.number[at], self.size)

    def class_of(self, word: np.ndarray) -> np.ndarray:
        return np.where(word == self.size, len(self.starts) - 1, np.searchsorted(self.starts, word, side="right") - 1)

    def forward(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the window's words put in, and the hidden units with a one for the bias."""
        x = self.embed.take(window, axis=0).reshape(len(window), -1)
        h = np.ones((len(window), WIDTH + 1), np.float32)
        np.tanh(x @ self.hidden[:-1] + self.hidden[-1], out=h[:, :-1])
        return x, h

    def by_class(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The order of the words by class, their classes in that order, and (class, first row, end) for each class."""
        c = self.class_of(word)
        order = np.argsort(c.astype(np.uint16), kind="stable")
        c = c[order]
        edges = np.flatnonzero(np.diff(c, prepend=-1)).tolist()
        return order, c, [(int(c[a]), a, b) for a, b in zip(edges, [*edges[1:], len(c)], strict=True)]

    def larger(self, runs: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(first row, end, first member, end) of the classes with more than one word."""
        for k, a, b in runs:
            if k < len(self.starts) - 1 and self.starts[k + 1] - self.starts[k] > 1:
                yield a, b, int(self.starts[k]), int(self.starts[k + 1])

    def log_probabilities(self, window: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of each word within its window."""
        order, c, runs = self.by_class(word)
        word = word[order]
        h = self.forward(window[order])[1]
        got = np.empty(len(word))
        for a in range(0, len(word), PART):
            got[a : a + PART] = log_softmax(h[a : a + PART], self.classes, c[a : a + PART])
        for a, b, first, end in self.larger(runs):
            got[a:b] += log_softmax(h[a:b], self.members[first:end].T, word[a:b] - first)
        out = np.empty(len(word))
        out[order] = got
        return out

    def shares(self, hashes: np.ndarray) -> np.ndarray:
        """The logarithm of the share of all other words; nan where the count isn't known here."""
        if not len(self.rest):
            return np.full(len(hashes), np.nan)
        at = np.minimum(np.searchsorted(self.rest, hashes), len(self.rest) - 1)
        return np.where(self.rest[at] == hashes, self.share[at], np.nan)


def log_softmax(h: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each row of ``h @ weights`` at one place."""
    z = product(h, weights)
    picked = z[np.arange(len(z)), at].astype(np.float64)
    np.exp(z, out=z)
    return picked - np.log(z @ np.ones(z.shape[1], np.float32))


def softmax(h: np.ndarray, weights: np.ndarray, scale: float) -> np.ndarray:
    """``scale`` times the softmax of each row of ``h @ weights``."""
    z = product(h, weights)
    np.exp(z, out=z)
    z *= (np.float32(scale) / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    return z


def product(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``h @ weights`` but for a number in each row. No unit of ``h`` is beyond 1, so small weights need no maximum taken off."""
    z = h @ weights
    if np.abs(weights).sum(0).max() > 60:
        z -= z.max(1, keepdims=True)
    return z


def untrained(hashes: np.ndarray, counts: np.ndarray, others: int, seed: int = 5) -> Network:
    """A network that predicts words by their counts, whatever the window. hashes: by falling count; the first HEAD are
    its vocabulary. others: how many tokens are of other words.
    """
    by = np.argsort(hashes[HEAD:])
    rest, share = hashes[HEAD:][by], np.log(counts[HEAD:][by] / max(1, others))
    hashes, counts = hashes[:HEAD], counts[:HEAD]
    r = np.random.Generator(np.random.PCG64(seed))
    v, total = len(hashes), max(1, int(counts.sum()))
    before = np.concatenate(([0], np.cumsum(counts)[:-1])) if v else np.zeros(0, np.int64)
    starts = np.append(np.unique(before * CLASSES // total, return_index=True)[1], v)
    mass = np.array([counts[a:b].sum() for a, b in zip(starts[:-1], starts[1:], strict=True)] + [max(others, 0.5)], np.float64)
    order = np.argsort(hashes)
    normal = lambda *shape: r.normal(0, 1, shape).astype(np.float32)
    members = np.zeros((v, WIDTH + 1), np.float32)
    members[:, -1] = np.log(counts)
    classes = np.zeros((WIDTH + 1, len(starts)), np.float32)
    classes[-1] = np.log(mass / mass.sum())
    hidden = normal(2 * SIDE * WIDTH + 1, WIDTH) / np.float32(np.sqrt(2 * SIDE * WIDTH))
    hidden[-1] = 0
    return Network(hashes[order], order, starts, normal(v + 2, WIDTH) * np.float32(0.3), hidden, classes, members, rest, share)


class Learner:
    """Follows the gradient through one task's tokens, and counts how often it has met each row of weights."""

    def __init__(self, net: Network) -> None:
        self.net = replace(net, embed=net.embed.copy(), hidden=net.hidden.copy(), classes=net.classes.copy(), members=net.members.copy())
        self.start = net
        self.seen = [np.full(x.shape, 1e-6, np.float32) for x in self.weights(net)]
        self.met = [np.zeros(len(x), np.float32) for x in self.weights(net)]

    @staticmethod
    def weights(net: Network) -> list[np.ndarray]:
        return [net.embed, net.hidden, net.classes, net.members]

    def move(self, which: int, rows: slice | np.ndarray, gradient: np.ndarray, times: np.ndarray | int) -> None:
        x, seen = self.weights(self.net)[which], self.seen[which]
        seen[rows] += gradient * gradient
        x[rows] -= RATE * gradient / np.sqrt(seen[rows])
        self.met[which][rows] += times

    def step(self, window: np.ndarray, word: np.ndarray) -> None:
        net, n = self.net, len(word)
        order, c, runs = net.by_class(word)
        window, word = window[order], word[order]
        x, h = net.forward(window)
        share = np.float32(1 / n)
        back, gradient = np.empty((n, WIDTH), np.float32), np.zeros_like(net.classes)
        for a in range(0, n, PART):
            part = h[a : a + PART]
            p = softmax(part, net.classes, share)
            p[np.arange(len(p)), c[a : a + PART]] -= share
            np.matmul(p, net.classes[:-1].T, out=back[a : a + PART])
            gradient += part.T @ p
        for a, b, first, end in net.larger(runs):
            q = softmax(h[a:b], net.members[first:end].T, share)
            q[np.arange(b - a), word[a:b] - first] -= share
            back[a:b] += q @ net.members[first:end, :-1]
            self.move(3, slice(first, end), q.T @ h[a:b], b - a)
        self.move(2, slice(None), gradient, n)
        back *= 1 - h[:, :-1] ** 2
        down = (back @ net.hidden[:-1].T).reshape(-1, WIDTH)
        self.move(1, slice(None), np.concatenate((x.T @ back, back.sum(0, keepdims=True))), n)
        flat = window.ravel()
        order = np.argsort(flat, kind="stable")
        edges = np.flatnonzero(np.diff(flat[order].astype(np.int64), prepend=-1))
        self.move(0, flat[order[edges]], np.add.reduceat(down.take(order, axis=0), edges), np.diff(np.append(edges, len(order))))

    def changes(self, rows: int = 1 << 10) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(which weights, first row, changes times how often each row was met, how often)."""
        for which, (new, old, met) in enumerate(zip(self.weights(self.net), self.weights(self.start), self.met, strict=True)):
            for a in range(0, len(new), rows):
                m = met[a : a + rows]
                if m.any():
                    yield which, a, ((new[a : a + rows] - old[a : a + rows]) * m[:, None]).astype(np.float32).tobytes(), m.tobytes()


def trained(docs: DataFrame, net: Network) -> Network:
    """The network after one more round over every token of all texts."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(sent.value)
        narrow = np.min_scalar_type(sent.value.size + 1)
        held, size = [], 0

        def learn() -> None:
            window, word = (np.concatenate(x) for x in zip(*held, strict=True))
            for a in range(0, len(word), BATCH):
                learner.step(window[a : a + BATCH], word[a : a + BATCH])

        for batch in batches:
            for _, w in words(as_bytes(batch.column("text")), SPACED):
                number = sent.value.numbers(w.hashes).astype(narrow)
                if len(number):
                    held.append((around(number, w.first, sent.value.size + 1), number))
                    size += len(number)
                if size >= 16 * BATCH:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        part = TaskContext.get().partitionId()
        for which, a, change, met in learner.changes():
            yield pa.RecordBatch.from_arrays([pa.array([which]), pa.array([a]), pa.array([part]), pa.array([change], pa.binary()), pa.array([met], pa.binary())], names=["which", "at", "part", "change", "met"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of rows that follow each other, one place in memory at a time."""

        def total() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]]), pa.array([change.tobytes()], pa.binary()), pa.array([met.tobytes()], pa.binary())], names=["which", "at", "change", "met"])

        place, change, met = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                more = (np.frombuffer(r["change"], np.float32).astype(np.float64), np.frombuffer(r["met"], np.float32).astype(np.float64))
                if place != (r["which"], r["at"]):
                    if place:
                        yield total()
                    place, (change, met) = (r["which"], r["at"]), more
                else:
                    change, met = change + more[0], met + more[1]
        if place:
            yield total()

    rows = docs.select("text").mapInArrow(run, "which bigint, at bigint, part bigint, change binary, met binary")
    rows = rows.repartition("which", "at").sortWithinPartitions("which", "at", "part").mapInArrow(add, "which bigint, at bigint, change binary, met binary")
    weights = [x.copy() for x in Learner.weights(net)]
    for r in rows.collect():
        met = np.frombuffer(r["met"], np.float64)
        change = np.frombuffer(r["change"], np.float64).reshape(len(met), -1)
        weights[r["which"]][r["at"] : r["at"] + len(met)] += (change / np.maximum(met, 1)[:, None]).astype(np.float32)
    sent.destroy()
    del rows
    freed(spark)
    return replace(net, embed=weights[0], hidden=weights[1], classes=weights[2], members=weights[3])


def model(docs: DataFrame) -> tuple[DataFrame, int, Network]:
    """The corpus's words (w, n), how many tokens are of words beyond the HEAD, and the trained network."""
    every = staged(counted(docs), "lm-words")
    # The least count that no more than KNOWN words reach.
    least, many, total = 1, 0, 0
    for n, c in sorted(every.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True):
        many, total = many + c, total + n * c
        least = n + 1 if many > KNOWN and least == 1 else least
    head = every.where(F.col("n") >= least).toArrow()
    hashes, counts = head.column("w").to_numpy().astype(np.int64).view(U), head.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((hashes, -counts))
    others = total - int(counts[order[:HEAD]].sum())
    net = untrained(hashes[order], counts[order], others)
    for _ in range(ROUNDS if total else 0):
        net = trained(docs, net)
    return every, others, net


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number: first bytes, second bytes and so on."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def numbers_of(data: memoryview, n: int, width: int) -> np.ndarray:
    """What ``planes`` took."""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def packed(keys: np.ndarray, word: np.ndarray, logs: np.ndarray, row: np.ndarray, open_: np.ndarray, unknown: np.ndarray, like: np.ndarray, like_row: np.ndarray) -> bytes:
    """Tokens of a bucket in the order of their texts. open_: the word's count isn't known yet, or the token is too unlikely
    for three bytes, so they go as a whole. like, like_row: the places of tokens that others equal, and the others' rows.
    """
    at = np.flatnonzero(open_)
    cost = np.where(open_, 0, np.maximum(np.rint(logs * -STEPS), 0))
    head = np.array([len(keys), len(at), len(like)], "<u8").tobytes()
    rows = planes(np.diff(row, prepend=0), 2)
    return b"".join((head, planes(keys, KEY_BITS // 8), planes(word, WORD_BITS // 8), planes(cost, 3), rows, planes(at, 4), planes(np.where(unknown[at], word[at], U(0)), 8), planes(like, 4), planes(like_row, 2), logs[at].astype("<f4").tobytes()))


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """keys, word, logs and row of each token, and the places, words (0: known) and logs of those that go as a whole."""
    n, m, more = (int(x) for x in np.frombuffer(data, "<u8", 3))
    view, at, got = memoryview(data), 24, []
    for many, width in ((n, KEY_BITS // 8), (n, WORD_BITS // 8), (n, 3), (n, 2), (m, 4), (m, 8), (more, 4), (more, 2)):
        got.append(numbers_of(view[at:], many, width))
        at += many * width
    like = got[6].astype(np.int64)
    keys, word, cost = (np.concatenate((x, x[like])) for x in got[:3])
    row = np.concatenate((np.cumsum(got[3]), got[7])).astype(np.int64)
    return keys, word, cost.astype(np.float64) / -STEPS, row, got[4].astype(np.int64), got[5], np.frombuffer(data, "<f4", m, at)


def first_of(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The place of the first token with the same window and the same word, of each token."""
    first = np.arange(len(keys))
    order = np.argsort(keys)
    many = np.diff(np.append(np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]])), len(keys)))
    again = np.repeat(many > 1, many)
    cell = np.repeat(np.arange(len(many), dtype=U), many)[again] << U(WORD_BITS) | word[order[again]] & U((1 << WORD_BITS) - 1)
    at = order[again]
    by = np.lexsort((at, cell))
    at, cell = at[by], cell[by]
    edges = np.flatnonzero(np.diff(cell, prepend=~cell[:1]))
    first[at] = np.repeat(at[edges], np.diff(np.append(edges, len(at))))
    return first


def occurrences(keys: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens have each token's window, and how many the window and the word."""
    n, c = np.ones((2, len(keys)), np.int64)
    order = np.argsort(keys)
    edges = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    many = np.diff(np.append(edges, len(keys)))
    again = np.repeat(many > 1, many)
    at = order[again]
    n[at] = np.repeat(many, many)[again]
    cell = np.repeat(np.arange(len(many), dtype=U), many)[again] << U(WORD_BITS) | word[at]
    order = np.argsort(cell)
    edges = np.flatnonzero(np.diff(cell[order], prepend=~cell[order[:1]]))
    many = np.diff(np.append(edges, len(cell)))
    c[at[order]] = np.repeat(many, many)
    return n, c


def mixed(p, n, c):
    """The log-probability of a token whose window occurs n times, c times with its word, where the network's is p."""
    return np.log((np.exp(p) * KAPPA + c - 1) / (n - 1 + KAPPA))


FIELDS = "to bigint, sender bigint, rid bigint, doc_id {}, n_tokens bigint, sure double, blob binary, late array<struct<rid:bigint,w:bigint,p:float,n:bigint,c:bigint>>"
LATE = pa.list_(pa.struct([(x, pa.float32() if x == "p" else pa.int64()) for x in ("rid", "w", "p", "n", "c")]))


def batch_of(kind: pa.DataType, to: np.ndarray, sender: int | np.ndarray, **more: object) -> pa.RecordBatch:
    """Rows of FIELDS; what isn't given is null."""
    kinds = {"to": pa.int64(), "sender": pa.int64(), "rid": pa.int64(), "doc_id": kind, "n_tokens": pa.int64(), "sure": pa.float64(), "blob": pa.binary(), "late": LATE}
    more |= {"to": to, "sender": np.broadcast_to(sender, len(to))}
    arrays = [x if isinstance(x := more.get(name), pa.Array) else pa.nulls(len(to), t) if x is None else pa.array(x, t) for name, t in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def tokens_of(rid: np.ndarray, w: np.ndarray, p: np.ndarray, n: np.ndarray, c: np.ndarray) -> pa.Array:
    """One list of late tokens."""
    late = pa.StructArray.from_arrays([pa.array(x) for x in (rid, w.view(np.int64), p, n, c)], ["rid", "w", "p", "n", "c"])
    return pa.ListArray.from_arrays(pa.array([0, len(rid)], pa.int32()), late).cast(LATE)


def read(docs: DataFrame, net: Network, buckets: int, memory: int) -> DataFrame:
    """FIELDS: rid, doc_id, n_tokens and sure, the network's log-probability of the tokens that don't go as a whole, of every
    row, to = -1 - its chunk; and packed tokens of a chunk (sender), to their bucket.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = sent.value
        narrow = np.min_scalar_type(model_.size + 1)
        chunk, rows, held, size = TaskContext.get().partitionId() << 20, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = [np.concatenate(x) for x in zip(*held, strict=True)]
            kept = tokens[0] % U(memory) == 0
            if memory > 1 and (alone := ~kept & tokens[4]).any():
                _, word, logs, row, _, unknown = (x[alone] for x in tokens)
                one = np.ones(len(row), np.int64)
                yield batch_of(doc_kind, np.array([-1 - chunk]), -1, late=tokens_of((chunk << 16) + row, np.where(unknown, word, U(0)), logs.astype(np.float32), one, one))
            keys, word, logs, row, open_, unknown = tokens if kept.all() else (x[kept] for x in tokens)
            keys = mix(keys)
            bucket = keys >> U(64 - bits) if bits else np.zeros(len(keys), U)
            first, place = first_of(keys, word), np.arange(len(keys))
            first = np.where(open_ | open_[first], place, first)
            own = first == place
            keys = keys >> U(max(0, 64 - bits - KEY_BITS)) & U((1 << KEY_BITS) - 1)
            other = np.flatnonzero(~own)
            other = other[np.argsort(bucket[other], kind="stable")]
            order = np.flatnonzero(own)
            order = order[np.argsort(bucket[order].astype(np.min_scalar_type(buckets)), kind="stable")]
            place = np.empty(len(first), np.int64)
            place[order] = np.arange(len(order))
            others = np.searchsorted(bucket[other], np.arange(buckets + 1, dtype=U))
            bucket = bucket[order].astype(np.int64)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            for many in range(0, len(edges), 64):
                to, blobs = [], []
                for a, b in zip(edges[many : many + 64], [*edges[1:], len(order)][many : many + 64], strict=True):
                    at = order[a:b]
                    to.append(bucket[a])
                    too = other[others[to[-1]] : others[to[-1] + 1]]
                    blobs.append(packed(keys[at], word[at], logs[at], row[at], open_[at], unknown[at], place[first[too]] - a, row[too]))
                yield batch_of(doc_kind, np.array(to), chunk, blob=blobs)

        for batch in batches:
            doc_kind, first = batch.column("doc_id").type, 0
            for _, w in words(as_bytes(batch.column("text")), SPACED):
                number = model_.numbers(w.hashes).astype(narrow)
                window = around(number, w.first, model_.size + 1)
                logs = np.concatenate([model_.log_probabilities(window[a : a + BLOCK], number[a : a + BLOCK]) for a in range(0, len(number), BLOCK)] or [np.zeros(0)])
                other = number == model_.size
                share = np.zeros(len(logs))
                share[other] = model_.shares(w.hashes[other])
                unknown = np.isnan(share)
                logs += np.where(unknown, 0, share)
                open_ = unknown | (logs < LEAST)
                counts = np.diff(w.first)
                if rows + len(counts) > ROWS or size > SENT:
                    if size:
                        yield from flush()
                    chunk, rows, held, size = chunk + 1, 0, [], 0
                if len(logs):
                    held.append((window_keys(w.hashes, w.first), w.hashes, logs, np.repeat(np.arange(rows, rows + len(counts)), counts), open_, unknown))
                    size += len(logs)
                sure = np.concatenate(([0.0], np.cumsum(np.where(open_, 0, logs))))
                rid = (chunk << 16) + np.arange(rows, rows + len(counts))
                yield batch_of(doc_kind, np.full(len(counts), -1 - chunk), -1, rid=rid, doc_id=batch.column("doc_id").slice(first, len(counts)), n_tokens=counts, sure=sure[w.first[1:]] - sure[w.first[:-1]])
                rows, first = rows + len(counts), first + len(counts)
        if size:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, FIELDS.format(kind))


def recalled(sent: DataFrame) -> DataFrame:
    """FIELDS of ``read`` after a look at each bucket: the rows, to their chunk; what memory adds to rows of a chunk, packed;
    and late tokens, those that went as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, added, size = [], [], 0
        part = TaskContext.get().partitionId()

        def decide() -> Iterator[pa.RecordBatch]:
            nonlocal size
            each = [unpacked(x) for _, x in held]
            lengths = [len(x[0]) for x in each]
            keys, word, logs, row = (np.concatenate([x[k] for x in each]) for k in range(4))
            rid = np.repeat(np.array([c << 16 for c, _ in held], np.int64), lengths) + row
            n, c = occurrences(keys, word)
            before = np.cumsum([0, *lengths[:-1]])
            late = np.concatenate([x[4] + b for x, b in zip(each, before, strict=True)])
            whole, p = (np.concatenate([x[k] for x in each]) for k in (5, 6))
            again = n > 1
            again[late] = False
            added.append((rid[again], mixed(logs[again], n[again], c[again]) - logs[again], c[again] > 1))
            size += int(again.sum())
            if len(late):
                yield batch_of(doc_kind, np.array([-1]), part, late=tokens_of(rid[late], whole, p, n[late], c[late]))

        def flush() -> Iterator[pa.RecordBatch]:
            rid, at = np.unique(np.concatenate([x[0] for x in added]), return_inverse=True)
            more = np.bincount(at, np.concatenate([x[1] for x in added]), len(rid))
            hits = np.bincount(at, np.concatenate([x[2] for x in added]), len(rid)).astype(np.int64)
            edges = np.flatnonzero(np.diff(rid >> 16, prepend=-1))
            ends = [*edges[1:], len(rid)]
            blobs = [np.array([b - a], "<u8").tobytes() + planes(np.diff(rid[a:b] & (ROWS - 1), prepend=0), 2) + planes(hits[a:b], 4) + more[a:b].astype("<f4").tobytes() for a, b in zip(edges, ends, strict=True)]
            yield batch_of(doc_kind, rid[edges] >> 16, part, blob=blobs)

        now = None
        for batch in batches:
            doc_kind = batch.column("doc_id").type
            to = batch.column("to").to_numpy()
            rows = np.flatnonzero(to < 0)
            if len(rows):
                got = {x: batch.column(x).take(pa.array(rows)) for x in ("rid", "doc_id", "n_tokens", "sure", "late")}
                got["late"] = got["late"].cast(LATE)
                yield batch_of(doc_kind, np.where(got["rid"].is_valid(), -1 - to[rows], -1), -1, **got)
            for k in np.flatnonzero(to >= 0).tolist():
                if to[k] != now and held:
                    yield from decide()
                    held.clear()
                    if size >= 2 * SENT:
                        yield from flush()
                        added.clear()
                        size = 0
                now = to[k]
                held.append((batch.column("sender")[k].as_py(), batch.column("blob")[k].as_py()))
        if held:
            yield from decide()
        if size:
            yield from flush()

    kind = sent.schema["doc_id"].dataType.simpleString()
    return sent.repartition("to").sortWithinPartitions("to", "sender").mapInArrow(run, FIELDS.format(kind))


def summed(got: DataFrame) -> DataFrame:
    """rid, doc_id, n_tokens, sure and hits of every row, with what memory adds to its chunk."""
    kind = got.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, more, hits, now = [], np.zeros(ROWS), np.zeros(ROWS, np.int64), None

        def done() -> Iterator[pa.RecordBatch]:
            for x in rows:
                at = x.column("rid").to_numpy() & (ROWS - 1)
                total = x.column("sure").to_numpy() + more[at]
                yield pa.RecordBatch.from_arrays([x.column("rid"), x.column("doc_id"), x.column("n_tokens"), pa.array(total), pa.array(hits[at])], names=["rid", "doc_id", "n_tokens", "sure", "hits"])

        for batch in batches:
            to = batch.column("to").to_numpy()
            edges = np.flatnonzero(np.diff(to, prepend=-1 if not len(to) else to[0] - 1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(to)], strict=True):
                if to[a] != now:
                    yield from done()
                    rows, now = [], to[a]
                    more[:], hits[:] = 0, 0
                each = batch.slice(a, b - a)
                sender = each.column("sender").to_numpy()
                if (sender < 0).any():
                    rows.append(each.filter(pa.array(sender < 0)))
                for blob in each.filter(pa.array(sender >= 0)).column("blob"):
                    data = blob.as_py()
                    n = int(np.frombuffer(data, "<u8", 1)[0])
                    at = np.cumsum(numbers_of(memoryview(data)[8:], n, 2)).astype(np.int64)
                    hits[at] += numbers_of(memoryview(data)[8 + 2 * n :], n, 4).astype(np.int64)
                    more[at] += np.frombuffer(data, "<f4", n, 8 + 6 * n)
        yield from done()

    rows = got.where("to >= 0").select("to", "sender", "rid", "doc_id", "n_tokens", "sure", "blob").repartition("to").sortWithinPartitions("to", "sender")
    return rows.mapInArrow(run, f"rid bigint, doc_id {kind}, n_tokens bigint, sure double, hits bigint")


def scores(docs: DataFrame, made: Callable[[DataFrame], tuple[DataFrame, int, Network]] = model, memory: int = MEMORY) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob and n_recalled (tokens that the corpus holds in the same window elsewhere,
    among the windows that are remembered) of every row of ``docs``.
    """
    small_batches(docs.sparkSession)
    every, others, net = made(docs)
    tokens = every.agg(F.sum("n")).first()[0] or 0
    got = staged(recalled(read(docs, net, 1 << max(0, (tokens // memory - 1) // BUCKET).bit_length(), memory)), "lm-read")
    late = got.select(F.explode("late").alias("x")).select("x.*")
    # Words whose counts are not in the network: their share of all beyond its vocabulary. Word 0: p is whole.
    by_word = every.select(F.col("w").alias("w_"), F.log(F.col("n") / F.lit(float(max(others, 1)))).alias("share"))
    p = F.col("p").cast("double") + F.coalesce("share", F.lit(0.0))
    chance = F.log((F.exp(p) * KAPPA + F.col("c") - 1) / (F.col("n") - 1 + KAPPA))
    late = late.join(by_word, F.col("w") == F.col("w_"), "left")
    late = late.select("rid", F.when(F.col("n") > 1, chance).otherwise(p).alias("p"), (F.col("c") > 1).cast("int").alias("hit"))
    by = late.groupBy(F.col("rid").alias("r_")).agg(F.sum("p").alias("more"), F.sum("hit").alias("late_hits"))
    out = summed(got).join(by, F.col("rid") == F.col("r_"), "left")
    total = F.round(F.col("sure") + F.coalesce("more", F.lit(0.0)), 6)
    hits = F.col("hits") + F.coalesce("late_hits", F.lit(0))
    return out.select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, F.round(total / F.col("n_tokens"), 6)).alias("mean_log_prob"), hits.cast("long").alias("n_recalled"))

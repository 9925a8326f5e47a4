"""Language-model scoring with a hashed, class-factored maximum-entropy model.

A token's probability is that of its class after the tokens before it, times its own within the class. The `COMMON`
most frequent words are clustered by the words around them; every other word has a class by its shape (how it ends, its
length, whether it is ASCII), so words never seen have one too.

A class is given by a softmax over sums of weights, one for the word before, the two before together, and, as skips, the
second and third before, each hashed into its table. All words are in these contexts under their own hash; in the
table of the word before, common words have rows of their own. The tables grow with the vocabulary that was counted, up
to `MAX_BITS` bits, since each task sends a table's worth of sums in each round. Within a cluster a word is given by a
second softmax, whose weights are for the classes of the word before and of the second before; rare words have the share
of their counts in their class (add `ALPHA`, with one more unknown word).

Everything is learnt from sums over all training documents: counts of words, of what stands around common words, and of
classes and common words in their contexts. The class weights begin at the contexts' (damped) logarithms of observed shares
and are corrected in `ROUNDS` rounds of gradient updates, each over the documents of one remainder of their text's hash:
tasks sum, for each row and class, how often the class came and how much of it was expected; only the sum over all
tasks moves the weights. The sums are of integers (expected shares to 14 bits), so the model does not depend on
how documents are dealt to tasks. The words' weights are found by gradient updates on the summed counts, which are all
that they depend on.

Counts are broadcast for the most frequent words only, `KNOWN` at most; other words' counts are joined.

Nulls and the like: null and empty texts are one end token; null doc_ids are training documents and are scored;
rows that repeat a doc_id are scored one by one; extra columns are ignored; an empty table gives no rows, and without
training documents the model has its initial weights and all counts are 0. A text is held whole by a task, at about 100
bytes a byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import kept
from .textcore import U64, Chunk, as_bytes, chunks, mix

ALPHA, COMMON, CLUSTERS, SHAPES, KNOWN = 0.1, 4096, 32, 16, 1 << 20
CLASSES = CLUSTERS + SHAPES
BINS = 128
#: Rounds of gradient updates, the largest table of features, and how the tables (the word before, the second, the third, the two before together) compare with it.
ROUNDS, MAX_BITS, SMALLER = 4, 13, (0, 1, 2, 0)
#: Damping of observed shares, how much of each table's the first weights have, and the step of the first round (less in each later one).
PRIOR, FIRST, STEP = 10.0, (0.6, 0.25, 0.15, 0.6), 0.8
#: Expected shares are summed in units of one in 2**14.
UNIT = 1 << 14
#: Tokens whose classes are weighed at a time, and whose expected classes are summed at a time; rows of a block of sums.
STRIP, BATCH, BLOCK = 1 << 11, 1 << 16, 512
#: Tokens of a row that are summed one by one with others' (see `add_rows`).
LONG = 32
END_HASH = 0x6C9E3C5A7F1B2D43
#: What stands before a document: as a code of a word, and as a class.
START, START_CLASS = COMMON, CLASSES
CONTEXTS = CLASSES + 1
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


#: Part of a word's shape, by its last byte: a letter, a full stop, a comma, or anything else.
ENDING = np.full(256, 12, dtype=np.int64)
ENDING[97:123] = ENDING[128:] = 0
ENDING[46], ENDING[44] = 4, 8


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each token of a chunk (an end after each document's words), and where documents begin."""
    c.words(lower=True)
    h = c.word_hashes()
    size = c.end - c.start
    wide = np.zeros(len(c.data) + 1, dtype=np.int32)
    np.cumsum(c.data >= 128, out=wide[1:])
    shape = ENDING[c.data[c.end - 1]] + (wide[c.end] > wide[c.start]) * 2 + (size > 7)
    n = c.last - c.first
    begin = c.first + np.arange(len(n))
    at = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    all_h, all_s = np.full(len(h) + len(n), END_HASH, dtype=U64), np.full(len(h) + len(n), SHAPES, dtype=np.int64)
    all_h[at], all_s[at] = h, shape
    return all_h, all_s, begin


@dataclass
class Words:
    """Counts of the most frequent words, found by their hash; the first COMMON by frequency have numbers."""

    h: np.ndarray
    count: np.ndarray
    number: np.ndarray
    least: int

    def __post_init__(self):
        by = np.argsort(self.h)
        self.h, self.count, self.number = self.h[by], self.count[by], self.number[by]
        self.bits = max(8, len(self.h).bit_length())
        self.starts = np.searchsorted(self.h, np.arange((1 << self.bits) + 1, dtype=U64)[:-1] << U64(64 - self.bits)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.h):
            return out
        left = np.arange(len(h))
        at = self.starts[(h >> U64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        while len(left):
            inside = at < len(self.h)
            left, at = left[inside], at[inside]
            there = self.h[at]
            same = there == h[left]
            out[left[same]] = at[same]
            on = there < h[left]
            left, at = left[on], at[on] + 1
        return out


@dataclass
class Model:
    words: Words | None
    clusters: np.ndarray  # of the common words
    tables: tuple[int, ...]  # rows of each table of features
    weights: np.ndarray
    bias: np.ndarray
    #: Logarithms of a common word's share of its class without context, what the classes of the word before and of the
    #: second before add, and of the sums that these are divided by (class, class before, second before).
    word: np.ndarray
    first: np.ndarray
    second: np.ndarray
    norm: np.ndarray

    def placed(self, h: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place in words, number (or -1), class and code of each token."""
        place = self.words.find(h)
        number = np.where(place >= 0, self.words.number[place], -1) if len(self.words.h) else np.full(len(h), -1)
        common = number >= 0
        kind = np.where(common, self.clusters[np.maximum(number, 0)], CLUSTERS + np.minimum(shape, SHAPES - 1))
        return place, number, kind, coded(number, h)

    def in_cluster(self, number: np.ndarray, kind: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of the chance of common words within their class, after the classes one and two before."""
        return (self.word[number] + self.first[one, number] + self.second[two, number] - self.norm[kind, one, two]) / np.log(10)


class Shared:
    """A model for tasks: its words, which are most of it, are sent once, and the rest each time that it has changed."""

    def __init__(self, spark: SparkSession, words: Words):
        self.context, self.words, self.rest = spark.sparkContext, spark.sparkContext.broadcast(words), []

    def of(self, model: Model) -> Callable[[], Model]:
        words, rest = self.words, self.context.broadcast(replace(model, words=None))
        self.rest.append(rest)
        return lambda: replace(rest.value, words=words.value)

    def done(self) -> None:
        """Nothing that has been sent is used any more, but for the words."""
        for x in self.rest:
            x.destroy()
        self.rest = []


def coded(number: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Common words by number, all others by hash."""
    return np.where(number >= 0, number.astype(U64), h | U64(1 << 63))


def before(ids: np.ndarray, begin: np.ndarray, start: int = START) -> list[np.ndarray]:
    """The first, second and third token before each one in its document."""
    out = []
    for d in (1, 2, 3):
        x = np.full(len(ids), start, dtype=ids.dtype)
        x[d:] = ids[:-d]
        for k in range(d):
            at = begin + k
            at = at[at < len(ids)]
            own = begin[np.searchsorted(begin, at, side="right") - 1] + k == at
            x[at[own]] = start
        out.append(x)
    return out


def table_sizes(vocabulary: int) -> tuple[int, ...]:
    bits = min(max(int(vocabulary).bit_length() - 4, 9), MAX_BITS)
    return tuple(1 << bits - less for less in SMALLER)


def features(prior: list[np.ndarray], tables: tuple[int, ...]) -> np.ndarray:
    """The rows of each token's features, in all tables put together."""
    one, two, three = prior
    # scrambled once: the second and third before are the first of earlier tokens
    a, b, c = mix(one), mix(two + U64(1 << 40)), mix(three + U64(2 << 40))
    size = tables[0]
    first = np.where(one < COMMON, one, U64(COMMON) + (a & U64(size - COMMON - 1))) if size == 2 * COMMON else a & U64(size - 1)
    rows, at = np.empty((len(one), len(tables)), dtype=np.int64), 0
    for j, (size, x) in enumerate(zip(tables, (first, b, c, mix(a * U64(3) + b)), strict=True)):
        rows[:, j] = (x & U64(size - 1)).astype(np.int64) + at
        at += size
    return rows


class Softmax:
    """Exponentials of the sums of weights of some tokens at a time, in buffers that stay in cache.

    Sums of weights are under 40 or so, so that float32 holds their exponentials.
    """

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias
        self.y, self.more = (np.empty((STRIP, weights.shape[1]), dtype=np.float32) for _ in range(2))

    def strips(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First token, sums of weights and their exponentials (which take the buffers of the next strip) of strips of tokens."""
        for a in range(0, len(rows), STRIP):
            part = rows[a : a + STRIP]
            y, more = self.y[: len(part)], self.more[: len(part)]
            # rows are within the table; mode only spares a copy
            np.take(self.weights, part[:, 0], axis=0, out=y, mode="clip")
            y += self.bias
            for j in range(1, part.shape[1]):
                y += np.take(self.weights, part[:, j], axis=0, out=more, mode="clip")
            yield a, y, np.exp(y, out=more)

    def chances(self, rows: np.ndarray) -> np.ndarray:
        """Chance of each class for each token."""
        out = np.empty((len(rows), self.weights.shape[1]), dtype=np.float32)
        for a, _, e in self.strips(rows):
            np.multiply(e, (1 / np.einsum("ij->i", e))[:, None], out=out[a : a + len(e)])
        return out

    def logs(self, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log10 of the chance of each token's own class."""
        out = np.empty(len(rows))
        for a, y, e in self.strips(rows):
            own = y[np.arange(len(y)), kind[a : a + len(y)]].astype(np.float64)
            out[a : a + len(y)] = (own - np.log(np.einsum("ij->i", e))) / np.log(10)
        return out


def add_rows(sums: np.ndarray, values: np.ndarray, rows: np.ndarray) -> None:
    """Adds values (a vector each) to the sums of their rows."""
    by = np.argsort(rows.astype(np.uint16) if len(sums) < 1 << 16 else rows, kind="stable")
    r = rows[by]
    cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    size = np.diff(np.r_[cut, len(r)])
    for i in np.flatnonzero(size > LONG).tolist():
        sums[r[cut[i]]] += values[by[cut[i] : cut[i] + size[i]]].sum(axis=0)
    # short ones together, the longest first: their first values, their second ones ...
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    first, less = cut[short], -size[short]
    total = values[by[first]]
    for j in range(1, LONG):
        n = int(np.searchsorted(less, -j))
        if not n:
            break
        total[:n] += values[by[first[:n] + j]]
    sums[r[first]] += total


class Expected:
    """How often each class is expected in each row, in units, of batches of tokens. Two classes share 64 bits until either could leave its half."""

    def __init__(self, model: Model):
        self.softmax = Softmax(model.weights, model.bias)
        self.pairs, self.sums = np.zeros((len(model.weights), CLASSES // 2), dtype=np.int64), np.zeros(model.weights.shape, dtype=np.int64)
        self.units, self.rows = np.empty((BATCH, CLASSES), dtype=np.int32), np.empty((BATCH, len(model.tables)), dtype=np.int64)
        self.held = self.tokens = 0

    def add(self, rows: np.ndarray) -> None:
        for a in range(0, len(rows), STRIP):
            part = rows[a : a + STRIP]
            if self.held + len(part) > BATCH:
                self._sum()
            at = slice(self.held, self.held + len(part))
            for _, _, e in self.softmax.strips(part):
                np.rint(np.multiply(e, (np.float32(UNIT) / np.einsum("ij->i", e))[:, None], out=e), out=e)
                self.units[at] = e
            self.rows[at] = part
            self.held += len(part)

    def _sum(self) -> None:
        if (self.tokens + self.held) * UNIT >= 1 << 32:
            self._flush()
        for j in range(self.rows.shape[1] if self.held else 0):
            add_rows(self.pairs, self.units[: self.held].view(np.int64), self.rows[: self.held, j])
        self.tokens += self.held
        self.held = 0

    def _flush(self) -> None:
        self.sums += self.pairs.view(np.uint32)
        self.pairs[:], self.tokens = 0, 0

    def total(self) -> np.ndarray:
        self._sum()
        self._flush()
        return self.sums


def first_weights(seen: np.ndarray, share: np.ndarray, tables: tuple[int, ...]) -> np.ndarray:
    """Weights from how often each class came in each row: damped logarithms of its share there over its share of all."""
    damped = (seen + PRIOR * share) / (seen.sum(axis=1, keepdims=True) + PRIOR)
    return np.log(damped / share) * np.repeat(FIRST, tables)[:, None]


def moved(weights: np.ndarray, sums: np.ndarray, seen: np.ndarray, done: int, rounds: int) -> np.ndarray:
    """Weights after a round: each goes along its gradient, by no more than its own count allows."""
    return weights + np.clip(STEP / (1 + 0.4 * done) * sums / UNIT / (seen / rounds + PRIOR), -1, 1)


def word_softmax(n1: np.ndarray, n2: np.ndarray, joint: np.ndarray, label: np.ndarray, rounds: int = 40, prior: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights of common words within their classes, by gradient updates.

    n1 and n2: how often each word came after each class of the word before and of the second before; joint: how often each
    class came after both. The gradient (came less expected) depends on no more than these.
    """
    total = n1.sum(axis=0)
    word = np.zeros(COMMON)
    first, second = np.zeros((CONTEXTS, COMMON)), np.zeros((CONTEXTS, COMMON))
    norm = np.zeros((CLASSES, CONTEXTS, CONTEXTS))
    for k in range(CLUSTERS):
        own = np.flatnonzero((label == k) & (total > 0))
        if not len(own):
            continue
        word[own] = np.log(total[own] / total[own].sum())
        a, b = np.zeros((CONTEXTS, len(own))), np.zeros((CONTEXTS, len(own)))
        one, two, n = n1[:, own], n2[:, own], joint[k]
        for r in range(rounds + 1):
            p = word[own] + a[:, None, :] + b[None, :, :]
            p -= p.max(axis=2, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=2, keepdims=True)
            if r < rounds:
                p *= n[:, :, None]
                e1, e2 = p.sum(axis=1), p.sum(axis=0)
                a += np.clip(0.5 * (one - e1 - prior * a) / (np.maximum(one, e1) + prior), -1, 1)
                b += np.clip(0.5 * (two - e2 - prior * b) / (np.maximum(two, e2) + prior), -1, 1)
        first[:, own], second[:, own] = a, b
        norm[k] = np.log(np.exp(word[own] + a[:, None, :] + b[None, :, :]).sum(axis=2))
    return word, first, second, norm


def _sums(parts: DataFrame) -> DataFrame:
    """block, salt, values (vectors of integers) -> their sums by block, first by salt too; a task holds one sum at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        made = lambda: _part(*key, total)
        for batch in batches:
            for block, salt, narrow, values in zip(*(batch.column(k).to_pylist() for k in ("block", "salt", "narrow", "values")), strict=True):
                values = np.frombuffer(values, dtype=np.int32 if narrow else np.int64)
                if key != (block, salt):
                    if key is not None:
                        yield made()
                    key, total = (block, salt), np.zeros(len(values), dtype=np.int64)
                total += values
        if key is not None:
            yield made()

    once = parts.repartition("block", "salt").sortWithinPartitions("block", "salt").mapInArrow(run, _PART)
    return once.withColumn("salt", F.lit(0)).repartition("block").sortWithinPartitions("block").mapInArrow(run, _PART)


_PART = "block int, salt int, narrow boolean, values binary"


def _part(block: int, salt: int, values: np.ndarray) -> pa.RecordBatch:
    """A block of sums, of 32 bits where they fit."""
    narrow = bool(np.abs(values).max(initial=0) < 2**31)
    data = values.astype(np.int32 if narrow else np.int64).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([narrow]), pa.array([data], pa.binary())], ["block", "salt", "narrow", "values"])


def _blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table in blocks, but for those that are empty; blocks of 64 tasks are summed first."""
    part = TaskContext.get().partitionId()
    for b in range(0, len(table), BLOCK):
        if table[b : b + BLOCK].any():
            yield _part(b // BLOCK, part // 64, table[b : b + BLOCK].ravel())


def _gathered(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sum of a table of a fixed size over all tasks; only the sum comes to the driver."""
    out = np.zeros((rows, width), dtype=np.int64)
    for r in _sums(parts).collect():
        values = np.frombuffer(r["values"], dtype=np.int32 if r["narrow"] else np.int64).reshape(-1, width)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(values)] = values
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task, put together every few million words, so that memory has a bound."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        h, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
        h, first, inv = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s[first].astype(np.int32)), pa.array(np.bincount(inv, n, len(h)).astype(np.int64))], ["h", "shape", "c"])

    for batch in batches:
        for c in chunks(as_bytes(batch.column("text"))):
            h, s, _ = tokens(c)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, s[first], n))
            size += len(u)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class _Cells:
    """Counts of cells of a table, put together every million."""

    def __init__(self, size: int):
        self.table, self.held, self.n = np.zeros(size, dtype=np.int64), [], 0

    def add(self, cells: np.ndarray) -> None:
        self.held.append(cells)
        self.n += len(cells)
        if self.n > 1 << 20:
            self.flush()

    def flush(self) -> np.ndarray:
        if self.held:
            self.table += np.bincount(np.concatenate(self.held), minlength=len(self.table))
            self.held, self.n = [], 0
        return self.table


def _surroundings(words_shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = words_shared.value
        cells = _Cells(COMMON * BINS)
        for batch in batches:
            for c in chunks(as_bytes(batch.column("text"))):
                h, _, begin = tokens(c)
                place = words.find(h)
                number = np.where(place >= 0, words.number[place], -1) if len(words.h) else np.full(len(h), -1)
                code = coded(number, h)
                a = np.flatnonzero(number >= 0)
                behind = mix(code + U64(77)) & U64(BINS - 1)
                for x in before(code, begin)[:2]:
                    cells.add(number[a] * BINS + (mix(x[a]) & U64(BINS - 1)).astype(np.int64))
                    b = np.flatnonzero(x < COMMON)
                    cells.add((x[b] * U64(BINS) + behind[b]).astype(np.int64))
        yield from _blocks(cells.flush().reshape(COMMON, BINS))

    return run


def clusters(table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """k-means of common words by the (square roots of) shares of what stands around them, weighted by count."""
    x = np.sqrt(table + 1e-9)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = np.log1p(counts)
    x = x - (x * w[:, None]).sum(axis=0) / max(w.sum(), 1e-9)
    centre = x[:: max(1, len(x) // CLUSTERS)][:CLUSTERS].copy()
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(15):
        label = (x @ centre.T * 2 - (centre**2).sum(axis=1)).argmax(axis=1)
        for k in range(len(centre)):
            if (at := label == k).any():
                centre[k] = (x[at] * w[at, None]).sum(axis=0) / max(w[at].sum(), 1e-9)
    return label


#: Rows of the table of observations behind those of the features: common words after a class, after a second class, and classes after both.
_MORE = (CONTEXTS * COMMON // CLASSES + 1, CONTEXTS * COMMON // CLASSES + 1, CONTEXTS * CONTEXTS)


def _observed(shared):
    """How often classes came in each row of features, and common words and classes after classes: one table, CLASSES wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        ends = np.cumsum([sum(model.tables), *_MORE]) * CLASSES
        cells = _Cells(int(ends[-1]))
        for batch in batches:
            for c in chunks(as_bytes(batch.column("text"))):
                h, shape, begin = tokens(c)
                _, number, kind, code = model.placed(h, shape)
                cells.add((features(before(code, begin), model.tables) * CLASSES + kind[:, None]).ravel())
                one, two, _ = before(kind, begin, START_CLASS)
                at = np.flatnonzero(number >= 0)
                cells.add(ends[0] + one[at] * COMMON + number[at])
                cells.add(ends[1] + two[at] * COMMON + number[at])
                cells.add(ends[2] + (one * CONTEXTS + two) * CLASSES + kind)
        yield from _blocks(cells.flush().reshape(-1, CLASSES))

    return run


def _residues(shared):
    """How often each class came in each row less how often it was expected, in units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        expected, came = Expected(model), _Cells(model.weights.size)
        for batch in batches:
            for c in chunks(as_bytes(batch.column("text"))):
                h, shape, begin = tokens(c)
                _, _, kind, code = model.placed(h, shape)
                rows = features(before(code, begin), model.tables)
                came.add((rows * CLASSES + kind[:, None]).ravel())
                expected.add(rows)
        yield from _blocks(came.flush().reshape(model.weights.shape) * UNIT - expected.total())

    return run


def _scored(shared, totals):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        every, kinds, per_class = totals
        words, softmax = model.words, Softmax(model.weights, model.bias)
        in_class = np.log10(words.count + ALPHA) if len(words.h) else np.zeros(0)
        for batch in batches:
            ids, tks, held = (batch.column(k) for k in ("did", "tk", "held_out"))
            for c in chunks(as_bytes(batch.column("text"))):
                h, shape, begin = tokens(c)
                place, number, kind, code = model.placed(h, shape)
                rows = features(before(code, begin), model.tables)
                chance = softmax.logs(rows, kind)
                found = place >= 0
                word = np.where(found, in_class[place] if len(in_class) else 0.0, 0.0 if words.least > 1 else np.log10(ALPHA))
                share = word - per_class[kind]
                one, two, _ = before(kind, begin, START_CLASS)
                common = np.flatnonzero(number >= 0)
                share[common] = model.in_cluster(number[common], kind[common], one[common], two[common])
                base = np.add.reduceat(word - np.log10(every + ALPHA * (kinds + 1)), begin)
                score = np.add.reduceat(share + chance, begin)
                known = np.add.reduceat(found.astype(np.int64), begin)
                n = np.diff(np.r_[begin, len(h)])
                # words whose counts have to be joined: once for each document, with how often
                rest = np.flatnonzero(~found) if words.least > 1 else np.zeros(0, dtype=np.int64)
                owner = np.searchsorted(begin, rest, side="right") - 1
                by = np.lexsort((h[rest], owner))
                rest, owner = rest[by], owner[by]
                new = np.ones(len(rest), dtype=bool)
                new[1:] = (h[rest][1:] != h[rest][:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.r_[at, len(rest)])
                cut = np.searchsorted(owner[at], np.arange(len(begin) + 1)).astype(np.int32)
                row = pa.array(c.rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), tks.take(row), held.take(row), pa.array(n), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(cut), pa.array(h[rest[at]].view(np.int64))), pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32)))],
                    ["did", "tk", "held_out", "n_tokens", "n_known", "base_score", "score", "rest", "times"],
                )

    return run


class LanguageModel:
    """The model of some training texts, and the counts that it rests on."""

    def __init__(self, texts: DataFrame, rounds: int = ROUNDS):
        spark: SparkSession = texts.sparkSession
        self.counts, _ = kept(texts.mapInArrow(_counted, "h long, shape int, c long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c")), "counts")
        # how many words have each count; the least count of which all fit in the broadcast
        high = self.counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(1 << 16).collect()
        least, size = 1, 0
        for r in high:
            size += r["n"]
            if size > KNOWN:
                least = r["c"] + 1
                break
        else:
            least = high[-1]["c"] if len(high) == 1 << 16 else 1
        table = self.counts.where(F.col("c") >= least).select("h", "shape", "c").toArrow()
        h, shape, count = (table.column(k).to_numpy() for k in ("h", "shape", "c"))
        h = h.view(U64)
        by = np.lexsort((h, -count))[:COMMON]
        number = np.full(len(h), -1, dtype=np.int64)
        number[by] = np.arange(len(by))
        self.words = Words(h, count.astype(np.float64), number, least)
        first = np.zeros(COMMON)
        first[: len(by)] = count[by]
        self.shared = Shared(spark, self.words)
        around = _gathered(texts.mapInArrow(_surroundings(self.shared.words), _PART), COMMON, BINS)
        label = clusters(around, first)
        # words and tokens of each class
        kind_n, kind_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in self.counts.groupBy(F.least("shape", F.lit(SHAPES - 1)).alias("shape")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            kind_n[CLUSTERS + r["shape"]], kind_v[CLUSTERS + r["shape"]] = r["n"], r["v"]
        self.tokens, self.kinds = float(kind_n.sum()), float(kind_v.sum())
        shapes = CLUSTERS + np.minimum(shape[by], SHAPES - 1)
        np.add.at(kind_n, shapes, -count[by])
        np.add.at(kind_v, shapes, -1)
        np.add.at(kind_n, label[: len(by)], count[by])
        np.add.at(kind_v, label[: len(by)], 1)
        self.per_class = np.log10(np.maximum(kind_n + ALPHA * (kind_v + (np.arange(CLASSES) >= CLUSTERS)), 1e-300))
        share = (kind_n + 1) / (kind_n + 1).sum()
        tables = table_sizes(int(self.kinds))
        none = np.zeros((CONTEXTS, COMMON))
        model = Model(self.words, label, tables, np.zeros((sum(tables), CLASSES), dtype=np.float32), np.log(share).astype(np.float32), np.zeros(COMMON), none, none, np.zeros((CLASSES, CONTEXTS, CONTEXTS)))
        seen, n1, n2, joint = np.split(_gathered(texts.mapInArrow(_observed(self.shared.of(model)), _PART), sum(tables) + sum(_MORE), CLASSES), np.cumsum([sum(tables), *_MORE])[:-1])
        n1, n2 = (n.ravel()[: CONTEXTS * COMMON].reshape(CONTEXTS, COMMON) for n in (n1, n2))
        model.word, model.first, model.second, model.norm = word_softmax(n1, n2, joint.reshape(CONTEXTS, CONTEXTS, CLASSES).transpose(2, 0, 1), label)
        weights = first_weights(seen, share, tables)
        #: Of each round, the mean residue of a cell, in absolute value, of those cells that have been seen: it falls while the model learns.
        self.residues = []
        for r in range(rounds):
            model.weights = weights.astype(np.float32)
            self.shared.done()
            own = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r)
            sums = _gathered(own.mapInArrow(_residues(self.shared.of(model)), _PART), sum(tables), CLASSES)
            self.residues.append(float(np.abs(sums).sum() / UNIT / max(seen.sum(), 1)))
            weights = moved(weights, sums, seen, r, rounds)
        self.shared.done()
        model.weights = weights.astype(np.float32)
        self.model = model

    def score(self, docs: DataFrame) -> DataFrame:
        """Scores of (doc_id, held_out, text)."""
        totals = (self.tokens, self.kinds, self.per_class)
        keyed = docs.select(F.col("doc_id").alias("did"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tk"), "held_out", "text")
        made = keyed.mapInArrow(_scored(self.shared.of(self.model), totals), "did long, tk long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<long>, times array<int>")
        if self.words.least > 1:
            made, _ = kept(made.withColumn("row", F.expr("uuid()")), "scored")
            rest = made.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.times").alias("times"))
            rare = self.counts.where(F.col("c") < self.words.least).select("h", "c")
            c = F.coalesce("c", F.lit(0))
            logs = F.col("times") * F.log10(c + F.lit(ALPHA))
            late = rest.join(rare, "h", "left").groupBy("row").agg(F.sum(logs).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"))
            made = made.join(late, "row", "left").withColumns({"base_score": F.col("base_score") + F.coalesce("more", F.lit(0.0)), "score": F.col("score") + F.coalesce("more", F.lit(0.0)), "n_known": F.col("n_known") + F.coalesce("found", F.lit(0))})
        return made.select(F.col("did").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(self.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def language_model(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return LanguageModel(own.where("NOT held_out").select("text")).score(own)

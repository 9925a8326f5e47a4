"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The items are few beside the corpus. They are taken in blocks of a bounded number of bytes; each block becomes one
generalised suffix automaton of its normalised words, which is broadcast (so its size has a bound too), and
documents stream through the automata of all blocks. For each word the automaton gives the longest run of words
that ends there and stands in some item; a run as long as a window (or as long as a whole item of fewer words)
hits its words. Runs of words that no item has, or that are shorter than any window, are skipped without stepping.

Nulls and the like: null and empty texts have no words, are never hit, and items without words match nothing; an
item_id of null is left out of items_sha256 and n_items, but its words still count as hits; items repeated under one
id count once; rows are judged one by one, so repeated documents and null ids are returned as they are; extra columns
are ignored; empty tables give no rows, or documents without hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh, kept, quoted
from .textcore import ALNUM, U64, Chunk, as_bytes, chunks, merged

WINDOW = 10
#: Bytes of item texts in one automaton, which takes about 110 times as much in a process; more items make more automata, not a larger one.
BLOCK_BYTES = 4 << 20
#: A document of which more than this share of words is hit goes as a whole, where texts are cleaned.
COVERAGE = 0.5
#: The column of hits that is joined to documents, where there are several blocks.
PARTS = "_hits_of_all_blocks"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class SuffixAutomaton:
    """All runs of words of some sequences. States know the sequences that their runs stand in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: dict[int, set[int]] = {}

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def add(self, words: list[int], name: int) -> None:
        last = 0
        for w in words:
            last = self._step(last, w)
            self.ends.setdefault(last, set()).add(name)

    def _divided(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _step(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._divided(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._divided(p, w, q)
        return new

    def finish(self) -> None:
        """Hands each state's sequences to the states of its shorter suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0 and s in self.ends:
                self.ends.setdefault(self.link[s], set()).update(self.ends[s])

    def step(self, state: int, have: int, w: int) -> tuple[int, int]:
        """The longest run that ends with w, after the longest so far."""
        while state and w not in self.next[state]:
            state = self.link[state]
            have = self.length[state]
        q = self.next[state].get(w)
        return (0, 0) if q is None else (q, have + 1)


class Items:
    """A block of items as an automaton, with what is needed to find windows by it."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int):
        self.window = window
        self.automaton, self.names = SuffixAutomaton(), []
        self.vocabulary: dict[bytes, int] = {}
        self.short: dict[tuple[int, int], set[int]] = {}
        shorts = []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall((text or b"").lower())]
            if words:
                self.automaton.add(words, len(self.names))
                if len(words) < window:
                    shorts.append((words, len(self.names)))
                self.names.append(item)
        self.automaton.finish()
        for words, name in shorts:
            state = 0
            for w in words:
                state = self.automaton.next[state][w]
            self.short.setdefault((state, len(words)), set()).add(name)
        self.short_lengths = sorted({n for _, n in self.short})
        self.least = min([window, *self.short_lengths])
        self.memo: dict[tuple[int, int], tuple[int, frozenset[int]]] = {}

    def _suffix(self, state: int, length: int) -> int:
        while self.automaton.length[self.automaton.link[state]] >= length:
            state = self.automaton.link[state]
        return state

    def found(self, state: int, have: int) -> tuple[int, frozenset[int]]:
        """The longest window that ends a run of `have` words, and the items of all that do."""
        have = min(have, self.automaton.length[state])
        key = (state, min(have, self.window))
        if key not in self.memo:
            longest, names = 0, set()
            for n in self.short_lengths:
                if n <= have and (got := self.short.get((self._suffix(state, n), n))):
                    longest, names = n, names | got
            if have >= self.window:
                longest, names = self.window, names | self.automaton.ends.get(self._suffix(state, self.window), set())
            self.memo[key] = longest, frozenset(names)
        return self.memo[key]

    def match(self, words: list[int]) -> tuple[list[int], list[int], set[int]]:
        """Starts and ends of windows in a run of known words, and their items."""
        start, end, names = [], [], set()
        state = have = 0
        step, least = self.automaton.step, self.least
        for i, w in enumerate(words, 1):
            state, have = step(state, have, w)
            if have >= least:
                n, got = self.found(state, have)
                if n:
                    start.append(i - n)
                    end.append(i)
                    names |= got
        return start, end, names


class Matcher:
    """Documents against some blocks of items."""

    def __init__(self, blocks: list[Items]):
        self.blocks = blocks
        known = sorted({w for b in blocks for w in b.vocabulary})
        self.bits = np.zeros(1 << max(16, (16 * len(known)).bit_length()), dtype=bool)
        self.mask = U64(len(self.bits) - 1)
        for c in chunks(known):
            c.words(ALNUM)
            self.bits[(c.word_hashes() & self.mask).astype(np.int64)] = True
        self.least = min((b.least for b in blocks), default=1)

    def documents(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[int], Chunk, int]]:
        """For each text, in order: its place, its number of words, starts and ends of hit words, item ids, its chunk and first word there."""
        for c in chunks(texts):
            c.words(ALNUM, lower=True)
            maybe = self.bits[(c.word_hashes() & self.mask).astype(np.int64)]
            data = c.data.tobytes()
            for at, lo, hi in zip(c.rows.tolist(), c.first.tolist(), c.last.tolist(), strict=True):
                edge = np.flatnonzero(np.diff(maybe[lo:hi], prepend=False, append=False))
                start, end, items = [], [], set()
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if b - a < self.least:
                        continue
                    words = [data[x:y] for x, y in zip(c.start[lo + a : lo + b].tolist(), c.end[lo + a : lo + b].tolist(), strict=True)]
                    for block in self.blocks:
                        s, e, names = block.match([block.vocabulary.get(w, -1) for w in words])
                        start += [a + x for x in s]
                        end += [a + x for x in e]
                        items |= {block.names[k] for k in names} - {None}
                first, last = merged(np.array(start, dtype=np.int64), np.array(end, dtype=np.int64))
                yield at, hi - lo, first, last, sorted(items), c, lo


    @staticmethod
    def cut(text: bytes, first: np.ndarray, last: np.ndarray, c: Chunk, lo: int, at: int) -> bytes:
        """The text without the words first to last."""
        base = c.lo[np.searchsorted(c.rows, at)]
        ends = [0, *(c.end[lo + last - 1] - base).tolist()]
        return b"".join(text[a:b] for a, b in zip(ends, [*(c.start[lo + first] - base).tolist(), len(text)], strict=True))


def _row(doc, words: int, first: np.ndarray, last: np.ndarray, items: list[int]) -> tuple:
    hit, named = int((last - first).sum()), sorted(map(str, items))
    return doc, words, hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), hit > 0


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
_PART = pa.schema([("did", pa.int64()), ("tk", pa.int64()), ("n_words", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
_CLEAN = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64())])


def _parts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            ids, tks = batch.column("did").to_pylist(), batch.column("tk").to_pylist()
            yield _batch([(ids[at], tks[at], n, first, last, items) for at, n, first, last, items, _, _ in matcher.documents(as_bytes(batch.column("text"))) if len(first)], _PART)

    return run


def blocks_of(items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Items]]:
    """Automata of at most block_bytes of texts each (or of one item); the driver holds one block at a time."""
    held, size = [], 0
    for r in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        text = bytes(r.text or b"")
        if held and size + len(text) > block_bytes:
            yield [Items(held, window)]
            held, size = [], 0
        held.append((r.item_id, text))
        size += len(text)
    yield [Items(held, window)]


def _with_parts(docs: DataFrame, blocks: Iterator[list[Items]]) -> DataFrame:
    """docs with PARTS: the hits of each block in the whole text, null where there are none. Rows of the same id and text share them."""
    did, key = fresh(docs, "did"), fresh(docs, "tk")
    own = docs.withColumns({did: F.coalesce("doc_id", F.lit(-(2**63))), key: F.coalesce(F.xxhash64("text"), F.lit(0))})
    found = None
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        hits = own.select(F.col(did).alias("did"), F.col(key).alias("tk"), "text").mapInArrow(_parts(shared), "did long, tk long, n_words long, first array<long>, last array<long>, items array<long>")
        part, _ = kept(hits.dropDuplicates(["did", "tk"]), "hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    parts = found.groupBy("did", "tk").agg(F.collect_list(F.struct("first", "last", "items")).alias(PARTS)).withColumnsRenamed({"did": did, "tk": key})
    return own.join(parts, [did, key], "left").select(*map(quoted, docs.columns), PARTS)


def _united(texts: list[bytes | None], parts: list[list[dict] | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[int], Chunk, int]]:
    """As Matcher.documents, from what several blocks have hit."""
    for c in chunks(texts):
        c.words(ALNUM, lower=True)
        for at, lo, hi in zip(c.rows.tolist(), c.first.tolist(), c.last.tolist(), strict=True):
            got = parts[at] or []
            first, last = merged(*(np.array([v for p in got for v in p[k]], dtype=np.int64) for k in ("first", "last")))
            yield at, hi - lo, first, last, sorted({i for p in got for i in p["items"]}), c, lo


def matching(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Callable]:
    """docs, and what gives a task its matcher of batches, which yields what Matcher.documents does for the hits of all items.

    Documents stream through one block's automaton; with more blocks, each one's hits on the whole texts are kept, united and joined as PARTS.
    """
    blocks = blocks_of(items, window, block_bytes)
    one, two = next(blocks), next(blocks, None)
    if two is not None:
        return _with_parts(docs, chain([one, two], blocks)), lambda: lambda batch: _united(as_bytes(batch.column("text")), batch.column(PARTS).to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast(one)

    def start() -> Callable:
        matcher = Matcher(shared.value)
        return lambda batch: matcher.documents(as_bytes(batch.column("text")))

    return docs, start


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of each document that windows of the items hit: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    matched, start = matching(docs.select("doc_id", "text"), items, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = start()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            yield _batch([_row(ids[at], n, first, last, names) for at, n, first, last, names, _, _ in match(batch)], _OUT)

    return matched.mapInArrow(run, OUT)


def without_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text without the spans of words that any item hits, n_words and n_hit (before)."""
    matched, start = matching(docs.select("doc_id", "text"), items, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = start()
        for batch in batches:
            ids, texts, rows = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), []
            for at, n, first, last, _, c, lo in match(batch):
                text = Matcher.cut(texts[at], first, last, c, lo, at) if len(first) else texts[at]
                rows.append((ids[at], None if text is None else text.decode(), n, int((last - first).sum())))
            yield _batch(rows, _CLEAN)

    return matched.mapInArrow(run, "doc_id long, text string, n_words long, n_hit long")

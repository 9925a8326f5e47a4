"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, in order of doc_id. It is cut into blocks, one for each stretch of windows
(of `window` words) that share their smallest k-gram of words; all blocks are indexed, under that k-gram and under a
fingerprint of their whole text, with the place where they stand first. A document is factored against the index: a
block that a smaller document has as a whole is matched at once; where only the k-gram is shared, each window of the
block is looked up. The parse goes through a document's matches from left to right: a factor (words at, length; words
of the source, from source_at) is taken as far as matches go on in its source; a window
that begins inside a factor and runs over its end is a match too, so the next factor may begin before the last one's end
and nothing is lost at factor boundaries. Of several sources a block has the smallest (doc_id, place) that has all of it,
a window that is looked up the smallest that has the window. All words of a factor, `window` at least, are duplicates.

A stretch that repeats a few words is one row of the index; its factor has the number of words after which it repeats
as its period (otherwise 0), and only the first period is that of the source.

Only k-grams, fingerprints and window hashes are shuffled, each aggregated before the shuffle; a passage with a
third of all documents is one row for each task in the index, and the joins back to it are such as AQE can split.
Equality is by 128 bits (window hash and the hash of its first words; k-gram and fingerprint).

Nulls and the like: a null or blank text has no words and loses none. A row with a null doc_id is returned, but
gives and loses nothing. Rows that repeat a doc_id are judged each by its own text; among themselves they are not
duplicates, since no doc_id is smaller; rows that repeat both share one set of matches, however many they are. Extra
columns are ignored. An empty table gives an empty result. A text is held whole by a task, at about 60 bytes a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop, kept
from .textcore import U64, WORDS_BASE, Chunk, Rolling, as_bytes, chunks, mix, regions

WINDOW, GRAM = 50, 20
OUT = "doc_id long, n_words long, n_removed long, n_factors long, kept_sha256 string"
FACTOR = "doc_id long, at long, length long, source long, source_at long, period long"


def text_key(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0)).alias("tk")


def _spans(c: Chunk, window: int, gram: int):
    c.words()
    roll = Rolling(c.word_hashes(), WORDS_BASE)
    grams = roll.grams(gram)
    cap = len(grams)
    at, a, b = regions(grams, window - gram + 1, np.minimum(c.first, cap), np.minimum(np.maximum(c.last - gram + 1, c.first), cap))
    return roll, grams, at, a, b


def index_blocks(window: int = WINDOW, gram: int = GRAM) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, tk, text) -> a row for each block: h, ctx, doc_id, tk, its first window, how many it has, and how many until it repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tks = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "tk"))
            for c in chunks(as_bytes(batch.column("text"))):
                roll, grams, at, a, b = _spans(c, window, gram)
                if not len(at):
                    continue
                full = np.flatnonzero(c.last > c.first)
                d = full[c.owner(a, c.first[full])]
                ctx = mix(roll.runs(a, b + window) ^ ((at - a).astype(U64) << U64(32)) ^ (b - a).astype(U64))
                h = grams[at]
                # blocks that follow each other and are the same, as in texts that repeat a few words, are one row
                new = np.ones(len(a), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]) | (d[1:] != d[:-1]) | (a[1:] != b[:-1] + 1)
                first = np.flatnonzero(new)
                own = (b - a + 1)[first]
                h, ctx, d, a, b = h[first], ctx[first], d[first], a[first], b[np.r_[first[1:] - 1, len(b) - 1]]
                row = c.rows[d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h.view(np.int64), ctx.view(np.int64), ids[row], tks[row], (a - c.first[d]).astype(np.int32), (b - a + 1).astype(np.int32), own.astype(np.int32))],
                    ["h", "ctx", "doc_id", "tk", "at", "n", "own"],
                )

    return run


def look_up_windows(window: int = WINDOW, gram: int = GRAM):
    """(doc_id, tk, text, blocks) -> a row for each window of the blocks: its hash, that of its first words, where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tks = (batch.column(k).to_numpy() for k in ("doc_id", "tk"))
            blocks = batch.column("blocks")
            for c in chunks(as_bytes(batch.column("text"))):
                c.words()
                roll = Rolling(c.word_hashes(), WORDS_BASE)
                part = blocks.slice(int(c.rows[0]), len(c.rows))
                flat = part.flatten()
                per = np.diff(part.offsets.to_numpy())
                at, n = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                at = at + np.repeat(c.first, per)
                row = np.repeat(np.arange(len(c.rows)), per)
                w = np.repeat(at - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                row = np.repeat(row, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (roll.runs(w, w + window).view(np.int64), roll.runs(w, w + gram).view(np.int64), ids[c.rows[row]], tks[c.rows[row]], (w - c.first[row]).astype(np.int32))],
                    ["wh", "chk", "doc_id", "tk", "at"],
                )

    return run


#: A run of matched windows, and the place in its source of the first of them.
MATCH = ("at", "n", "own", "source", "source_at")


def factors(matches: pa.Array | None, window: int = WINDOW) -> np.ndarray:
    """The factors of a document: rows of at, length, source, source_at and period, from left to right.

    `matches` are structs of MATCH. One goes on with the factor before it if both follow each other here and in the source.
    """
    if matches is None or not len(matches):
        return np.zeros((0, 5), dtype=np.int64)
    at, n, own, source, place = (matches.field(k).to_numpy().astype(np.int64) for k in range(len(MATCH)))
    by = np.lexsort((place, source, at))
    at, n, own, source, place = at[by], n[by], own[by], source[by], place[by]
    on = (at[1:] == at[:-1] + n[:-1]) & (source[1:] == source[:-1]) & (place[1:] - at[1:] == place[:-1] - at[:-1]) & (n == own)[1:] & (n == own)[:-1]
    first = np.flatnonzero(np.r_[True, ~on])
    last = np.r_[first[1:], len(at)] - 1
    return np.column_stack([at[first], at[last] + n[last] - at[first] + window - 1, source[first], place[first], np.where(n[first] > own[first], own[first], 0)])


def covered(found: np.ndarray, words: int) -> np.ndarray:
    """Which of a document's words no factor covers."""
    gone = np.zeros(words + 1, dtype=np.int32)
    np.add.at(gone, found[:, 0], 1)
    np.add.at(gone, found[:, 0] + found[:, 1], -1)
    return np.cumsum(gone)[:words] == 0


def matches_of(column: pa.ListArray, i: int) -> pa.Array | None:
    row = column[i]
    return row.values if row.is_valid else None


def _parsed(window: int, want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = [], batch.column("hits")
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True)):
                words = (text or b"").split()
                total, found = len(words), factors(matches_of(hits, i), window)
                if len(found):
                    words = [w for w, k in zip(words, covered(found, total).tolist(), strict=True) if k]
                removed, left = total - len(words), b" ".join(words)
                if want_text:
                    rows.append((doc, None if text is None else text.decode() if not removed else left.decode()))
                else:
                    rows.append((doc, total, removed, len(found), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * (2 if want_text else 5)
            kinds = [pa.int64(), pa.string()] if want_text else [pa.int64()] * 4 + [pa.string()]
            names = ["doc_id", "text"] if want_text else ["doc_id", "n_words", "n_removed", "n_factors", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(cols, kinds, strict=True)], names)

    return run


def _listed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, docs = batch.column("hits"), batch.column("doc_id").to_numpy()
            found = [factors(matches_of(hits, i), window) for i in range(batch.num_rows)]
            every = np.concatenate([np.zeros((0, 5), dtype=np.int64), *found])
            cols = [np.repeat(docs, [len(f) for f in found]), every[:, 0], every[:, 1], every[:, 2], every[:, 3], every[:, 4]]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["doc_id", "at", "length", "source", "source_at", "period"])

    return run


def duplicate_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The windows that smaller documents have, as runs of MATCH for each (doc_id, tk)."""
    spark = docs.sparkSession
    own = docs.select("doc_id", text_key(F.col("text")), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    place = lambda: [F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last")]
    blocks, blocks_at = kept(own.mapInArrow(index_blocks(window, gram), "h long, ctx long, doc_id long, tk long, at int, n int, own int"), "blocks")
    by_text, by_text_at = kept(blocks.groupBy("h", "ctx").agg(*place()), "by-text")
    by_gram = by_text.groupBy("h").agg(F.min("first.doc_id").alias("lo"), F.max("last").alias("hi"), F.count(F.lit(1)).alias("texts")).where("lo < hi").select("h", (F.col("texts") > 1).alias("several"))
    by_gram, by_gram_at = kept(by_gram, "by-gram")
    index, index_at = kept(by_text.join(by_gram, "h").where("several OR first.doc_id < last").select("h", "ctx", F.col("first.doc_id").alias("source"), F.col("first.at").alias("source_at"), "several"), "index")
    seen, seen_at = kept(blocks.join(index, ["h", "ctx"]).where("doc_id > source OR several").select("doc_id", "tk", *MATCH, (F.col("doc_id") > F.col("source")).alias("whole")), "seen")
    drop(spark, blocks_at, by_text_at, by_gram_at, index_at)
    # sets, not lists: rows that repeat a document bring the same blocks again
    open_blocks = seen.where("NOT whole").groupBy("doc_id", "tk").agg(F.collect_set(F.struct("at", "n")).alias("blocks"))
    windows, windows_at = kept(own.join(open_blocks, ["doc_id", "tk"]).select("doc_id", "tk", "text", "blocks").mapInArrow(look_up_windows(window, gram), "wh long, chk long, doc_id long, tk long, at int"), "windows")
    firsts, firsts_at = kept(windows.groupBy("wh", "chk").agg(*place()).where("first.doc_id < last").select("wh", "chk", F.col("first.doc_id").alias("source"), F.col("first.at").alias("source_at")), "firsts")
    met = windows.join(firsts, ["wh", "chk"]).where("doc_id > source").select("doc_id", "tk", "at", F.lit(1).alias("n"), F.lit(1).alias("own"), "source", "source_at")
    out, _ = kept(seen.where("whole").select("doc_id", "tk", *MATCH).unionByName(met), "duplicate-windows")
    drop(spark, seen_at, windows_at, firsts_at)
    return out


def matches(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tk and the set `hits` of MATCH, for each text with any."""
    return duplicate_windows(docs, window).groupBy("doc_id", "tk").agg(F.collect_set(F.struct(*MATCH)).alias("hits"))


def _joined(docs: DataFrame, window: int) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("tk", text_key(F.col("text"))).join(matches(docs, window), ["doc_id", "tk"], "left").select("doc_id", "text", "hits")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What each document keeps: doc_id, n_words, n_removed, n_factors, kept_sha256 (see the module)."""
    return _joined(docs, window).mapInArrow(_parsed(window, False), OUT)


def parse(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The factors of all documents: doc_id, at, length, source, source_at, period (see the module)."""
    return _joined(docs, window).where("hits IS NOT NULL").mapInArrow(_listed(window), FACTOR)


def without_duplicates(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and text without its duplicate spans; a text that loses nothing stays as it is, others have single spaces."""
    return _joined(docs, window).mapInArrow(_parsed(window, True), "doc_id long, text string")

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words, hashed into `2**BITS` places and weighted by the logarithm of their counts
(as a unit vector), and statistics of the whole text with the declared length, each with a latent vector: the
score is w0 + sum(w x) + the sum of <v, v'> x x' over all pairs, for which sum((sum v x)**2 - sum((v x)**2)) / 2 takes
linear time. Labels, lang, source and doc_id are not among the features.

It is trained on at most `TRAIN_ROWS` labelled documents, those of the smallest hash of doc_id among the ones allowed
(a documented bound: the model is small and gains little from more), one row of each, by adaptive gradient steps on the driver. Scoring
covers all documents, batch by batch in numpy, with the model broadcast (of a fixed size, about 5 MB).

Nulls and the like: a null or empty text has only statistics and gets a score; a null n_chars (or none) counts as 0; several
labels of a document count as their largest, null labels and labels without a document as none; without any label
the score is 0.5 for all; repeated rows and null doc_ids are scored like others (a null doc_id is not held out);
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import BYTE, BYTES_BASE, U64, Chunk, Rolling, as_bytes, chunks

BITS, RANK, TRAIN_ROWS, EPOCHS = 17, 8, 8000, 8
#: Few examples are gone over more often, until there are so many steps.
STEPS = 600
STATS = 16
OUT = "doc_id long, held_out boolean, score double, predicted int"


def _kind_masks() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    for i, members in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), b".,;:?'\"-()", b"!", b"|", b"#$%&*@^~_=+<>/\\{}[]"), 1):
        kinds[list(members)] = i
    return kinds


KIND = _kind_masks()


def features(c: Chunk, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed word and weight of each distinct word, and the statistics of each row."""
    c.words()
    roll = Rolling(BYTE[c.data], BYTES_BASE)
    words = (roll.runs(c.start, c.end) & U64((1 << BITS) - 1)).astype(np.int64)
    n = c.last - c.first
    rows = len(c.rows)
    key, count = np.unique(np.repeat(np.arange(rows), n) << BITS | words, return_counts=True)
    row, word = key >> BITS, key & ((1 << BITS) - 1)
    weight = 1 + np.log(count)
    weight /= np.sqrt(np.bincount(row, weight**2, minlength=rows))[row]
    size = np.maximum(c.hi - c.lo, 1)
    kinds = KIND[c.data]
    share = np.empty((rows, 8))
    for i in range(1, 9):
        at = np.flatnonzero(kinds == i)
        share[:, i - 1] = np.searchsorted(at, c.hi) - np.searchsorted(at, c.lo)
    lines = np.flatnonzero(c.data == 10)
    begin = np.sort(np.r_[c.lo, lines[:-1] + 1]) if len(lines) > rows else c.lo
    begin = np.unique(begin)
    owner = np.minimum(c.owner(begin, c.lo), rows - 1)
    end = np.r_[begin[1:] - 1, len(c.data) - 1]
    line = roll.runs(begin, np.maximum(end, begin))
    by = np.lexsort((line, owner))
    same = np.zeros(len(by), dtype=bool)
    same[1:] = (line[by][1:] == line[by][:-1]) & (owner[by][1:] == owner[by][:-1])
    repeated = np.bincount(owner[by], same * (end - begin)[by], minlength=rows)
    total = np.maximum(n, 1)
    stats = np.column_stack(
        [
            np.log1p(n), np.bincount(row, minlength=rows) / total, np.bincount(row, count == 1, minlength=rows) / total, np.maximum.reduceat(np.r_[count, 0], np.minimum(np.searchsorted(row, np.arange(rows)), len(count))) / total,
            size / total, repeated / size, np.bincount(owner, minlength=rows) / total, np.log1p(n_chars), *(np.sqrt(share / size[:, None])).T,
        ]
    )
    return row, word, weight, stats


@dataclass
class Machine:
    """Weights of hashed words, then of statistics; these are standardised by mean and spread."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4) / np.sqrt(STATS)

    def margins(self, row: np.ndarray, word: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> np.ndarray:
        rows, dense = len(stats), self.standard(stats)
        at = 1 << BITS
        y = self.w0 + dense @ self.w[at:] + np.bincount(row, weight * self.w[word], minlength=rows)
        for f in range(RANK):
            vx, vd = weight * self.v[word, f], dense * self.v[at:, f]
            s = np.bincount(row, vx, minlength=rows) + vd.sum(axis=1)
            y += 0.5 * (s**2 - np.bincount(row, vx**2, minlength=rows) - (vd**2).sum(axis=1))
        return y


def train(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """examples: words, weights and statistics of each document. Logistic loss, AdaGrad, small batches in a fixed shuffled order."""
    size = (1 << BITS) + STATS
    stats = np.array([e[2] for e in examples])
    r = np.random.default_rng(1)
    m = Machine(0.0, np.zeros(size, dtype=np.float32), r.normal(0, 0.02, (size, RANK)).astype(np.float32), stats.mean(axis=0), stats.std(axis=0) + 1e-6)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    m.w0 = float(np.log(share / (1 - share)))
    gw, gv, g0 = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32), 1e-2
    dense = m.standard(stats).astype(np.float32)
    tail = np.arange(1 << BITS, size)
    per_epoch = max(1, len(examples) // 32)
    epochs = max(epochs, -(-STEPS // per_epoch))
    for epoch in range(epochs):
        rate = 0.1 / (1 + 2.4 * epoch / epochs)
        for batch in np.array_split(r.permutation(len(examples)), per_epoch):
            idx = np.concatenate([np.r_[examples[i][0], tail] for i in batch])
            x = np.concatenate([np.r_[examples[i][1], dense[i]] for i in batch]).astype(np.float32)
            per = np.array([len(examples[i][0]) + STATS for i in batch])
            lo = np.r_[0, np.cumsum(per)[:-1]]
            vx = m.v[idx] * x[:, None]
            s = np.add.reduceat(vx, lo)
            y = m.w0 + np.add.reduceat(m.w[idx] * x, lo) + 0.5 * (s**2 - np.add.reduceat(vx**2, lo)).sum(axis=1)
            err = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[batch]
            each = np.repeat(err, per).astype(np.float32) * x / len(batch)
            uniq, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, each, minlength=len(uniq)) + 1e-6 * m.w[uniq]
            pull = each[:, None] * (np.repeat(s, per, axis=0) - vx)
            dv = np.column_stack([np.bincount(inv, pull[:, f], minlength=len(uniq)) for f in range(RANK)]) + 1e-5 * m.v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= 0.5 * rate * dv / np.sqrt(gv[uniq])
            g0 += err.mean() ** 2
            m.w0 -= rate * err.mean() / np.sqrt(g0)
    return m


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, chars = as_bytes(batch.column("text")), batch.column("n_chars").to_numpy(zero_copy_only=False)
        rows = []
        for c in chunks(texts):
            row, word, weight, stats = features(c, chars[c.rows])
            cut = np.searchsorted(row, np.arange(len(c.rows) + 1))
            rows += [(word[a:b].astype(np.int32).tobytes(), weight[a:b].astype(np.float32).tobytes(), s.tobytes()) for a, b, s in zip(cut[:-1], cut[1:], stats, strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(x, type=pa.binary()) for x in cols)], ["label", "words", "weights", "stats"])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine | None = shared.value
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            chars = batch.column("n_chars").to_numpy(zero_copy_only=False)
            for c in chunks(as_bytes(batch.column("text"))) if machine else ():
                y = machine.margins(*features(c, chars[c.rows]))
                score[c.rows] = 1 / (1 + np.exp(-np.clip(y, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _chars(docs: DataFrame) -> Column:
    given = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(0.0)
    return F.greatest(F.coalesce(given, F.lit(0.0)), F.lit(0.0)).alias("n_chars")


def fitted(docs: DataFrame, labels: DataFrame, target: str = "quality", train_rows: int = TRAIN_ROWS) -> Machine | None:
    """The machine, from at most train_rows labelled documents that are not held out; None without any."""
    known = labels.select("doc_id", F.col(target).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chars = _chars(docs)
    rows = docs.select("doc_id", "text", chars).join(F.broadcast(sample), "doc_id")
    # of rows that repeat a doc_id, the one of the smallest text hash
    one = rows.groupBy("doc_id", "label").agg(F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "n_chars")).alias("row")).select("label", "row.text", "row.n_chars")
    # at most train_rows rows of a few hundred words each come to the driver; sorted, so that reruns agree
    got = sorted(map(tuple, one.mapInArrow(_examples, "label int, words binary, weights binary, stats binary").collect()))
    if not got:
        return None
    examples = [(np.frombuffer(w, np.int32), np.frombuffer(x, np.float32), np.frombuffer(s)) for _, w, x, s in got]
    return train(examples, np.array([y for y, *_ in got], dtype=np.float64))


def quality(docs: DataFrame, labels: DataFrame, target: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every document."""
    machine = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, target, train_rows))
    chars = _chars(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", chars).mapInArrow(_scored(machine), OUT)

"""Stages of the corpus pipeline: documents in, documents out, with all their columns.

Where a stage changes a text, n_chars (if there is one) becomes the new text's length. Rows that repeat a doc_id are
treated alike; null doc_ids and null texts pass through every stage that does not ask for words. Extra columns of any name
come out as they went in; a table without n_chars is judged as if it were 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import COVERAGE, Matcher, matching
from .minhash_dedup import near_duplicates
from .mix_sources import mix_sized, sized
from .quality import features, fitted
from .substring_dedup import covered, factors, matches, matches_of, text_key
from .tables import fresh, quoted, table
from .textcore import as_bytes, chunks

THRESHOLD = 0.5


def _with_texts(batch: pa.RecordBatch, names: list[str], texts: list[bytes | None]) -> pa.RecordBatch:
    out = [batch.column(n) for n in names]
    out[names.index("text")] = pa.array([None if t is None else t.decode() for t in texts], type=pa.string())
    if "n_chars" in names:
        at = names.index("n_chars")
        size = [None if t is None else len(t.decode()) for t in texts]
        out[at] = pa.array([s if s is not None else n for s, n in zip(size, out[at].to_pylist(), strict=True)]).cast(out[at].type)
    return pa.RecordBatch.from_arrays(out, names)


def _all(docs: DataFrame, but: str = "") -> list[Column]:
    return [quoted(c) for c in docs.columns if c.lower() != but]


def _mapped(docs: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], like: DataFrame) -> DataFrame:
    """f over docs, to the columns of like. On the way columns have plain names, as mapInArrow looks for a dotted one inside another."""
    names, given = docs.columns, like.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, [f"c{i}" for i in range(len(given))])

    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(run, T.StructType([T.StructField(f"c{i}", x.dataType) for i, x in enumerate(given)])).toDF(*like.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (a score of THRESHOLD or more)."""
    shared = spark.sparkContext.broadcast(fitted(docs, table(spark, sf_dir, "labels")))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            chars = np.array([max(x or 0, 0) for x in batch.column("n_chars").to_pylist()] if "n_chars" in names else [0] * batch.num_rows, dtype=np.float64)
            for c in chunks(as_bytes(batch.column("text"))) if machine else ():
                good[c.rows] = 1 / (1 + np.exp(-np.clip(machine.margins(*features(c, chars[c.rows])), -500, 500))) >= THRESHOLD
            yield batch.select(names).filter(pa.array(good))

    return _mapped(docs, run, docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8 or more) the document of the smallest doc_id."""
    gone = near_duplicates(docs, 5, 80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_all(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what windows of 50 words share with smaller documents; a text that changes has single spaces."""
    hits, doc, key = fresh(docs, "hits"), fresh(docs, "doc"), fresh(docs, "key")
    found = matches(docs).withColumnsRenamed({"doc_id": doc, "tk": key, "hits": hits})
    joined = docs.join(found, (F.col("doc_id") == F.col(doc)) & (text_key(F.col("text")) == F.col(key)), "left").select(*_all(docs), hits)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, column = as_bytes(batch.column("text")), batch.column(hits)
            for i in range(batch.num_rows):
                if len(got := factors(matches_of(column, i))):
                    words = texts[i].split()
                    texts[i] = b" ".join(w for w, k in zip(words, covered(got, len(words)).tolist(), strict=True) if k)
            yield _with_texts(batch, names, texts)

    return _mapped(joined, run, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that benchmark items hit; documents that are hit in over COVERAGE of their words go."""
    names = docs.columns
    matched, start = matching(docs, table(spark, sf_dir, "benchmark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = start()
        for batch in batches:
            texts, stay = as_bytes(batch.column("text")), []
            for at, n, first, last, _, c, lo in match(batch):
                if len(first):
                    texts[at] = Matcher.cut(texts[at], first, last, c, lo, at)
                stay.append(int((last - first).sum()) <= COVERAGE * n)
            yield _with_texts(batch, names, texts).filter(pa.array(stay, type=pa.bool_()))

    return _mapped(matched, run, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (`copy` counts from 0, in place of any column of that name), by source."""
    key, copies, first, copy = fresh(docs, "key"), fresh(docs, "copies"), fresh(docs, "first"), fresh(docs, "copy")
    keys = ["doc_id", key, "source"]
    keyed = docs.withColumn(key, text_key(F.col("text")))
    taken = mix_sized(sized(keyed, key)).groupBy(*keys).agg(F.sum("copies").alias(copies))
    # rows that are the same come as often as all of them together
    a, b = keyed.alias("a"), taken.alias("b")
    both = a.join(b, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]).select("a.*", f"b.{copies}")
    rows = both.withColumn(first, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))).where((F.col(first) == 1) & (F.col(copies) > 0))
    other = [c for c in _all(docs, "copy")]
    return rows.select(*other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)).alias(copy)).withColumnRenamed(copy, "copy")

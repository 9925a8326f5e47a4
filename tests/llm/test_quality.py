import random

import numpy as np
from pyspark.sql import functions as F

from hopweave.llm.quality import RANK, STATS, Machine, fitted, quality

DATA = "/root/testdata/sf0.01"


def test_linear_time_identity():
    r = np.random.default_rng(0)
    size = (1 << 17) + STATS
    m = Machine(0.3, r.normal(size=size), r.normal(size=(size, RANK)), np.zeros(STATS), np.ones(STATS))
    word, weight, stats = np.array([5, 9, 70]), np.array([0.5, 0.2, 0.9]), r.normal(size=(1, STATS))
    idx, x = np.r_[word, np.arange(1 << 17, size)], np.r_[weight, m.standard(stats)[0]]
    want = 0.3 + x @ m.w[idx] + sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert abs(m.margins(np.zeros(3, dtype=int), word, weight, stats)[0] - want) < 1e-6


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([x.score for x in rows if x.quality == q] for q in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([x.predicted == x.quality for x in rows]) > 0.95
    other = quality(docs.selectExpr("doc_id", "text", "n_chars", "'x' AS lang", "'y' AS source"), labels)
    assert sorted(map(str, other.collect())) == sorted(map(str, got.collect()))


def test_odd_rows(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["a", "b", "|", "$$"] if i % 2 else ["x", "y", "z"]) for _ in range(i)), i, 7) for i in range(40)]
    rows += [(None, "x y", None, 1), (50, None, -3, 1), (50, "", None, 1), (51, "\n\n", 2, 1), (52, "z " * 300000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score long")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(3, None, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert [x.held_out for x in got if x.doc_id is None] == [False]
    assert {x.score for x in quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality(docs.limit(0), labels).collect() == []


def test_repeated_ids_train_as_one_row_each(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 120")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert {x.quality for x in labels.where("doc_id < 120").collect()} == {0, 1}
    many = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 5 == 0, 40).otherwise(7))))
    one, seven = fitted(docs, labels, train_rows=60), fitted(many, labels, train_rows=60)
    assert one.w0 == seven.w0 and np.array_equal(one.w, seven.w) and np.array_equal(one.v, seven.v)
    # texts that differ under one id: one of them, however the rows lie
    mixed = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" other"))))
    a, b = fitted(mixed.repartition(3), labels, train_rows=60), fitted(mixed.repartition(5, "text"), labels, train_rows=60)
    assert np.array_equal(a.w, b.w) and abs(a.w0 - one.w0) < 3

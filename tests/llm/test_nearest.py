import random

from pyspark.sql import functions as F

from hopweave.llm.nearest import nearest


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [float(r.choice([-3, -1, 0, 1, 2])) if i % 3 else r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None] + [1.0] * 4), (404, [float("nan")] * 6), (405, [float("inf")] + [1.0] * 5), (None, [9.0] * 6), (7, rows[7][1]), (20, rows[20][1]), (500, [1.0, 2.0]), (520, [1.0, 2.0]), (521, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS r", "2 AS score")
    kept = [(x.vec_id, x.embedding) for x in df.collect()]
    good = [(i, v) for i, v in kept if i is not None and v and all(x is not None and abs(x) < float("inf") for x in v) and any(v)]
    want = []
    for i in {i for i, _ in good if i % 20 == 0}:
        v = min(v for j, v in good if j == i)
        near = sorted((-dot(v, w), j) for j, w in good if j != i and len(w) == len(v))[:5]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(near, 1)]
    got = [tuple(x) for x in nearest(df, F.col("vec_id") % 20 == 0, 5, 6, 40).collect()]
    assert sorted(got) == sorted(want)


def test_empty(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


def test_very_large_and_small_vectors(spark):
    rows = [(0, [1e300, 1e300]), (20, [1e200, 1.0]), (40, [5e-324, 0.0]), (60, [1.0, 2.0]), (1, [1e-200, 3.0]), (2, [-1e300, 1e300]), (3, [7.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for i, v in rows:
        near = sorted((-dot(v, w), j) for j, w in rows if j != i and dot(v, w) == dot(v, w)) if i % 20 == 0 else []
        want += [(i, k, j, -s) for k, (s, j) in enumerate(near[:4], 1)]
    assert sorted(map(tuple, nearest(df, F.col("vec_id") % 20 == 0, 4).collect())) == sorted(want)


def test_rows_that_repeat_spread_and_count(spark):
    r = random.Random(6)
    rows = [(7, [1.0, 1.0])] * 900 + [(8, [r.gauss(0, 1), 0.5]) for _ in range(600)] + [(20, [1.0, 0.0]), (3, [9.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = nearest(df, F.col("vec_id") % 20 == 0, 5, 10, 100).collect()
    best = sorted((-dot((1.0, 0.0), v), i) for i, v in rows if i != 20)[:5]
    assert sorted((x.rank, x.vec_id, x.score) for x in got) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]

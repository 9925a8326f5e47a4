from collections import defaultdict
from fractions import Fraction

from hopweave.llm.mix_sources import mix


def goals(size, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(size.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest, by = total - sum(fixed.values()), sum(w[s] for s in free)
        share = {s: Fraction(w[s] * rest, by) for s in free}
        over = [s for s in free if share[s] > most * size[s]]
        if not over:
            return fixed | share
        fixed |= {s: Fraction(most * size[s]) for s in over}


def test_targets_and_copies(spark):
    rows = []
    for s, n in {"a": 300, "b": 40, "c": 500, "é": 5, None: 60, "z": 3, "zz": 200}.items():
        rows += [(len(rows) + i, s, " ".join(["w"] * (i * 7 % 23))) for i in range(n)]
    rows += [(None, "a", "x y"), (5000, "q", None), (5001, "q", " "), (5001, "q", " ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "9 AS size", "1 AS place").repartition(6)
    got = mix(df).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for x in got:
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert 0 <= x.copies <= 3 and x.taken == x.copies * x.size
    want = goals(size)
    for s in size:
        assert abs(target[s] - float(want[s])) < 1e-6
        assert abs(taken[s] - target[s]) <= 2 * 22
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(3)).collect()))


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []

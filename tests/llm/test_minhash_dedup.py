import random

import numpy as np
import pytest

from hopweave.llm import minhash_dedup
from hopweave.llm.components import components
from hopweave.llm.minhash_dedup import near_duplicates


def brute(rows, size, percent):
    def bag(t):
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()

    sets = [(d, bag(t)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d is not None and e is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abCdeé") for _ in range(r.randint(1, 5)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, 9)):
            ws = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                ws[r.randrange(len(ws))] = word()
            rows.append((len(rows) * 7 % 1009, r.choice([" ", "\n"]).join(ws)))
    base = [word() for _ in range(100)]
    for i in range(120):
        ws = list(base)
        for _ in range(r.randint(0, 6)):
            ws[r.randrange(len(ws))] = word()
        rows.append((2000 + i, " ".join(ws)))
    a, b = [" ".join(word() for _ in range(40)) for _ in range(2)]
    rows += [(3000 + i, a) for i in range(20)]
    rows += [(4000, None), (4001, ""), (4002, "A b"), (4003, "a B"), (4004, "a"), (None, a), (4005, b), (4005, a), (4006, b), (4007, "x " * 5000), (4008, "x x x")]
    return rows


@pytest.mark.parametrize("most", [2048, 8])
def test_against_brute_force(spark, most):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS c", "3 AS tree").repartition(4)
    assert sorted((tuple(x) for x in near_duplicates(df, 3, 85, most).collect()), key=str) == brute(rows, 3, 85)


def test_other_shingles_and_empty_table(spark):
    rows = corpus()[:90]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in near_duplicates(df, 5, 80).collect()), key=str) == brute(rows, 5, 80)
    assert near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200), (101, 102), (102, 100)]
    got = dict(components(spark.createDataFrame(path, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_orders_are_sorted_and_scanned(spark):
    r = np.random.default_rng(1)
    sig = r.integers(0, 2, (300, minhash_dedup.WIDTH), dtype=np.uint32)
    df = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sig)], "c long, sig binary")
    rows = df.repartition(3).mapInArrow(minhash_dedup._orders, "c long, tree int, path binary").repartitionByRange(5, "tree", "path", "c").sortWithinPartitions("tree", "path", "c")
    got = {}
    for x in rows.mapInArrow(minhash_dedup._neighbours, "c long, tree int, key long").collect():
        got.setdefault((x.tree, x.key), set()).add(x.c)
    got = {(t, frozenset(v)) for (t, _), v in got.items() if len(v) > 1}
    turn = lambda t, k: [(t * minhash_dedup.DEPTH + j) % minhash_dedup.WIDTH for j in range(k)]
    want = set()
    for t in range(minhash_dedup.TREES):
        by = {}
        for i in range(300):
            by.setdefault(tuple(sig[i, turn(t, 4)]), set()).add(i)
        want |= {(t, frozenset(v)) for v in by.values() if len(v) > 1}
    assert want <= got and all(len(v) == 2 and len({tuple(sig[i, turn(t, 3)]) for i in v}) == 1 for t, v in got - want)


def near_copies(n, seed, words=300):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        ws = list(base)
        ws[r.randrange(words)] = f"x{i}"
        rows.append((i, " ".join(ws)))
    return rows


def test_blocks_of_one_connected_group_are_none(spark, monkeypatch):
    sizes = []
    real = minhash_dedup.Forest._blocks
    monkeypatch.setattr(minhash_dedup.Forest, "_blocks", lambda *a: sizes.append((out := real(*a)).count()) or out)
    for n in (100, 200):
        got = near_duplicates(spark.createDataFrame(near_copies(n, 4), "doc_id long, text string"), 3, 85, 16).collect()
        assert {x.component_id for x in got} == {0}
    assert sizes == [0, 0]


def test_rows_that_repeat(spark):
    rows = near_copies(3, 5, 120) * 700 + [(None, "a b c d")] * 50
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows) and {(x.doc_id, x.component_id, x.kept) for x in got} == {(0, 0, True), (1, 0, False), (2, 0, False), (None, None, True)}

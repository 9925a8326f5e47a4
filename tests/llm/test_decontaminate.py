import hashlib
import random
import re

import pytest

from hopweave.llm.decontaminate import decontaminate, without_hits

WORD = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, n):
    windows = {}
    for i, t in items:
        ws = WORD.findall(lower(t))
        for w in [ws[k : k + n] for k in range(len(ws) - n + 1)] if len(ws) >= n else [ws] if ws else []:
            windows.setdefault(tuple(w), set()).add(i)
    out = []
    for d, t in docs:
        ws = WORD.findall(lower(t))
        hit, names = [False] * len(ws), set()
        for w, who in windows.items():
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit[k : k + len(w)] = [True] * len(w)
                    names |= who
        names = sorted(str(x) for x in names if x is not None)
        out.append((d, len(ws), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def tables():
    r = random.Random(2)
    words = lambda n: [r.choice(["a", "B", "c", "dé", "e1", "É"]) for _ in range(n)]
    items = [(i, " ".join(words(r.choice([2, 3, 4, 5, 6, 8])))) for i in range(12)] + [(50, None), (51, " -- "), (52, "zz"), (None, "q q q q"), (53, "q q q q"), (2, "x y")]
    docs = []
    for d in range(80):
        ws = words(r.randint(0, 25))
        if r.random() < 0.5:
            ws += (r.choice(items)[1] or "").split()
        docs.append((d, r.choice([" ", ", ", "-", "\x00", "\n"]).join(ws)))
    return docs + [(None, "zz"), (90, None), (90, "zz zz q q q q x y"), (91, "")], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_against_brute_force(spark, block_bytes):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "y").selectExpr("*", "1 AS items").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert sorted((tuple(x) for x in decontaminate(d, i, 5, block_bytes).collect()), key=str) == brute(docs, items, 5)


def test_text_without_hits_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "keep One two, THREE four. rest"), (2, "one two"), (3, None)], "doc_id long, text string")
    i = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert {x.doc_id: (x.text, x.n_hit) for x in without_hits(d, i, 4).collect()} == {1: ("keep . rest", 4), 2: ("one two", 0), 3: (None, 0)}
    assert decontaminate(d.limit(0), i).collect() == []
    assert [x.n_hit for x in decontaminate(d, i.limit(0)).collect()] == [0, 0, 0]


def test_blocks_are_cut_together(spark):
    ws = [f"w{k}" for k in range(40)]
    texts = [(1, " ".join(ws)), (2, "a b c " + " ".join(ws[5:15]) + " d e"), (3, "x y"), (None, " ".join(ws)), (1, " ".join(ws)), (4, None)]
    # overlapping items, and one that only a cut would bring together
    items = [(1, " ".join(ws[5:15])), (2, " ".join(ws[10:20])), (3, " ".join(["b", "c", "d", "e"]))]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    one, many = (sorted(map(str, without_hits(d, i, 4, b).collect())) for b in (1 << 20, 30))
    assert one == many and sum("n_hit=15" in x for x in many) == 3

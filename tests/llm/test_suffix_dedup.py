import hashlib
import random
from collections import Counter

import pytest

from hopweave.llm import suffix_dedup as suffix
from hopweave.llm.suffix_dedup import bucket_cover, lcp_intervals, suffix_dedup


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((d, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghé \n") for _ in range(n))
    shared = [text(n) for n in (30, 39, 40, 41, 60, 150, 400)]
    rows = []
    for d in range(150):
        t = text(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) - 20)
            t += s[a : a + r.randint(10, 200)] + text(r.randint(0, 20))
        rows.append((d, t))
    same = text(90)
    line = text(45)
    rows += [(200 + i, text(15) + line[: r.randint(30, 45)] + text(15)) for i in range(60)]
    rows += [(300 + i, same) for i in range(20)] + [(400, None), (401, ""), (None, same), (402, same), (402, same), (403, "x" * 500), (404, "x" * 41), (405, "ab" * 100), (406, "\0" * 45), (407, "\0" * 39 + "q")]
    return rows


@pytest.mark.parametrize("most", [4096, 6])
def test_against_brute_force(spark, most):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "text AS hits").repartition(5)
    got = sorted((tuple(x) for x in suffix_dedup(df, 40, 10, most).collect()), key=str)
    assert got == brute(rows, 40)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_intervals_and_cover():
    assert sorted(lcp_intervals([1, 3, 0])) == [(0, 0, 3), (1, 0, 2), (3, 1, 2)]
    lefts, rights = bucket_cover([2, 2, 0], [b"abXYZ12", b"abXYZ13", b"XYZ9"], 5)
    assert lefts.tolist() == [2, 2, 0] and rights.tolist() == [4, 4, 0]


def test_rows_that_repeat_are_one_member(spark, monkeypatch):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    line = text(60)
    rows = [(1, text(20) + line), (2, text(9) + line + text(9))] + [(3, line + text(30))] * 2000 + [(None, text(5) + line + "q")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sizes = []
    real = suffix.kept
    monkeypatch.setattr(suffix, "kept", lambda df, name, *by: sizes.append((name, *(k := real(df, name, *by)))) or k)
    monkeypatch.setattr(suffix, "drop", lambda *_: None)
    got = suffix_dedup(df, 40, 10).collect()
    members = next(df for name, df, _ in sizes if name == "members")
    assert members.count() == members.distinct().count() and max(x["count"] for x in members.groupBy("h").count().collect()) == 4
    assert sorted({(str(x.doc_id), x.n_removed) for x in got}) == [("1", 60), ("2", 60), ("3", 90), ("None", 66)] and len(got) == len(rows)


def test_few_tables_are_written(spark, monkeypatch):
    # each file that a task writes to a local folder makes its JVM fork three times
    rows = [(d, "abcdefgh" * 5 + chr(97 + d % 26) * d) for d in range(40)]
    written = []
    real = suffix.kept
    monkeypatch.setattr(suffix, "kept", lambda df, name, *by: written.append(name) or real(df, name, *by))
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 40, 10, 6).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 40) and "halves" in written
    assert not {"grams", "sizes"} & set(written)


def test_a_very_long_text(spark):
    r = random.Random(2)
    long = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=1_500_000))
    rows = [(1, long), (2, "x" + long[700_000:700_500]), (3, None)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1_500_000, 500, 1), 2: (501, 500, 1), 3: (0, 0, 0)}

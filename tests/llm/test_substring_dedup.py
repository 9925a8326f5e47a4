import hashlib
import random

from hopweave.llm.substring_dedup import matches, parse, substring_dedup, without_duplicates

W = 50


def brute(rows):
    """Each word covered by a window whose words also start in a smaller document."""
    firsts = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, ws in split:
        for i in range(len(ws) - W + 1):
            key = tuple(ws[i : i + W])
            if d is not None:
                firsts[key] = min(d, firsts.get(key, d))
    out = []
    for d, ws in split:
        gone = [False] * len(ws)
        for i in range(len(ws) - W + 1):
            if d is not None and firsts[tuple(ws[i : i + W])] < d:
                gone[i : i + W] = [True] * W
        left = [w for w, g in zip(ws, gone) if not g]
        out.append((d, len(ws), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 80, 200, 400)]
    rows = []
    for d in range(120):
        ws = text(r.randint(0, 90))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, max(0, len(s) - 50))
            ws += s[a : a + r.randint(45, 300)] + text(r.randint(0, 30))
        rows.append((d * 3 % 121, r.choice([" ", "\n", "\t ", "\x0b"]).join(ws)))
    same = " ".join(text(120))
    rows += [(200 + i, same) for i in range(30)] + [(300, None), (301, ""), (302, " \n"), (None, same), (303, same), (303, same), (304, "w " * 700), (305, "w " * 300), (306, "a b " * 60), (307, "a b " * 60)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "text AS hits", "0 AS tk").repartition(5)
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup(df).collect()), key=str)
    assert got == brute(rows)


def test_texts_and_empty_table(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, "x  y " + shared), (2, "p " + shared + " q\nz"), (3, None)], "doc_id long, text string")
    assert {x.doc_id: x.text for x in without_duplicates(df).collect()} == {1: "x  y " + shared, 2: "p q z", 3: None}
    assert substring_dedup(df.limit(0)).collect() == []


def copied_words(rows):
    """For each document, the words that some window covers which also starts in a smaller one."""
    first = {}
    split = {d: (t or "").split() for d, t in rows}
    for d, ws in split.items():
        for i in range(len(ws) - W + 1):
            first[tuple(ws[i : i + W])] = min(d, first.get(tuple(ws[i : i + W]), d))
    gone = {d: {k for i in range(len(ws) - W + 1) if first[tuple(ws[i : i + W])] < d for k in range(i, i + W)} for d, ws in split.items()}
    return split, gone


def test_factors_are_copies_and_cover_all(spark):
    r = random.Random(8)
    text = lambda n: [f"v{r.randrange(500)}" for _ in range(n)]
    shared = [text(n) for n in (50, 70, 130, 300)]
    rows = []
    for d in range(60):
        ws = text(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) - 50)
            ws += s[a : a + r.randint(45, 260)] + text(r.randint(0, 5))
        rows.append((d, " ".join(ws)))
    split, gone = copied_words(rows)
    got = sorted(tuple(x) for x in parse(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert len(got) > 50 and {d: {k for x in got if x[0] == d for k in range(x[1], x[1] + x[2])} for d in gone} == gone
    for d, at, length, source, place, period in got:
        assert source < d and length >= W and not period and split[d][at : at + length] == split[source][place : place + length]
    for (d, at, length, source, place, _), (e, there, _, other, from_, _) in zip(got, got[1:]):
        # each window of a document is in one factor; a factor ends where its source does not go on, or a smaller one begins
        assert d != e or there > at + length - W and (there > at + length - W + 1 or (other, from_ - there) != (source, place - at))


def test_periods(spark):
    rows = [(1, "w " * 300), (2, "w " * 700), (3, "a b " * 60), (4, "a b " * 60)]
    got = [tuple(x) for x in parse(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [x for x in got if x[0] < 4] == [(2, 0, 700, 1, 0, 1)]
    assert {k for x in got if x[0] == 4 for k in range(x[1], x[1] + x[2])} == set(range(120)) and any(x[5] == 2 for x in got)


def test_rows_that_repeat_share_their_matches(spark):
    shared, own = (" ".join(f"{c}{i}" for i in range(90)) for c in "st")
    rows = [(1, shared)] + [(2, f"x {shared}")] * 2000 + [(None, shared)] * 300 + [(3, f"{shared} {own}")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert [len(x.hits) for x in matches(df).collect()] == [len(x.hits) for x in matches(df.distinct()).collect()]
    got = substring_dedup(df).collect()
    assert len(got) == len(rows) and {(x.doc_id, x.n_removed) for x in got} == {(1, 0), (2, 90), (None, 0), (3, 90)}


def test_a_very_long_text(spark):
    r = random.Random(2)
    ws = [f"{r.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(ws)), (2, " ".join(ws[60_000:150_000])), (3, "z " + " ".join(ws[:50]))]
    got = {x.doc_id: x.n_removed for x in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 90_000, 3: 50}

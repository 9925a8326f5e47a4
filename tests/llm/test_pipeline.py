import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from hopweave.llm import decontaminate, stages
from hopweave.llm.quality import quality
from hopweave.llm.queries import ORACLES
from hopweave.llm.tables import kept, table

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_run(spark):
    docs = table(spark, DATA, "documents")
    labels = {x.doc_id: x.quality for x in table(spark, DATA, "labels").collect()}
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        seen.append({x.doc_id for x in now.collect()})
        assert stage is stages.mixed or now.columns == COLUMNS
    assert all(b <= a for a, b in zip(seen, seen[1:]))
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in seen[0] for d in good) >= 0.98 * len(good)
    assert sum(d in seen[0] for d, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())
    assert now.columns == [*COLUMNS, "copy"] and now.count() >= len(seen[-1])


def test_stages_on_odd_rows(spark):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    a, shared = text(80), text(60)
    item = [x.text for x in table(spark, DATA, "benchmark").collect() if len(x.text.split()) > 25][0]
    rows = [(1, a, "en", "s", 5), (2, a + " end", None, None, None), (3, None, "en", "s", 3), (4, "", "en", None, 0), (None, a, "en", "s", 1)]
    rows += [(5, text(30) + " " + shared + " " + text(30), "en", "t", 1), (6, text(30) + "\n" + shared + "\n" + text(31), "en", "t", 1), (7, text(90) + " " + item + " " + text(9), "de", "t", 1), (8, item, "de", "t", 1), (9, "x y", "en", "t", 2), (9, "x y", "en", "t", 2)]
    docs = frame(spark, rows)
    one = stages.one_of_each_group(spark, docs, DATA).collect()
    assert sorted(str(x.doc_id) for x in one) == ["1", "3", "4", "5", "6", "7", "8", "9", "9", "None"]
    cut = {x.doc_id: x for x in stages.without_repeats(spark, docs, DATA).collect()}
    assert cut[5].text == rows[5][1] and len(cut[6].text.split()) == 61 and cut[6].n_chars == len(cut[6].text)
    assert cut[3].text is None and cut[3].n_chars == 3 and cut[2].text == "end" and cut[None].text == a
    clean = {x.doc_id: x.text for x in stages.without_benchmark(spark, docs, DATA).collect()}
    assert 8 not in clean and item not in clean[7] and len(clean[7].split()) in range(99, 102) and clean[5] == rows[5][1] and clean[3] is None
    mixed = stages.mixed(spark, docs, DATA)
    assert mixed.columns == [*COLUMNS, "copy"] and all(0 <= x.copy < 6 for x in mixed.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).collect() == []


def test_coverage_counts_all_blocks_of_the_benchmark(spark, monkeypatch):
    ws = [f"w{k}" for k in range(100)]
    items = [" ".join(ws[0:30]), " ".join(ws[60:90])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1)
    monkeypatch.setattr(stages, "table", lambda *_: bench)
    rows = [(1, " ".join(ws), "en", "s", 5), (2, " ".join(ws[30:60] + ws[60:75]), "en", "s", 5), (3, None, "en", "s", 5)]
    got = []
    for size in (1 << 20, 50):
        monkeypatch.setattr(decontaminate.matching, "__defaults__", (decontaminate.WINDOW, size))
        got.append(sorted(map(tuple, stages.without_benchmark(spark, frame(spark, rows), DATA).collect())))
    assert got[0] == got[1] and [x[0] for x in got[1]] == [2, 3] and got[1][0][1] == " ".join(ws[30:60]) + " "


def plain_near_dedup(rows):
    shingles = {}
    for d, t, *_ in rows:
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        shingles[d] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    least = {d: d for d in shingles}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for d, a in shingles.items():
        for e, b in shingles.items():
            if e < d and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(d), find(e)))
                least[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def plain_repeats(rows):
    first = {}
    split = {d: (t or "").encode().split() for d, t, *_ in rows}
    for d, ws in split.items():
        for i in range(len(ws) - 49):
            first[tuple(ws[i : i + 50])] = min(d, first.get(tuple(ws[i : i + 50]), d))
    out = []
    for d, t, *rest in rows:
        ws = split[d]
        gone = {k for i in range(len(ws) - 49) if first[tuple(ws[i : i + 50])] < d for k in range(i, i + 50)}
        t = b" ".join(w for k, w in enumerate(ws) if k not in gone).decode() if gone else t
        out.append((d, t, *rest[:-1], len(t) if t is not None else rest[-1]))
    return out


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_decontaminate(rows, items):
    windows = set()
    for item in items:
        ws = WORD.findall(item.encode().lower())
        windows |= {tuple(ws[i : i + 10]) for i in range(max(1, len(ws) - 9))} if ws else set()
    sizes = {len(w) for w in windows}
    out = []
    for d, t, *rest in rows:
        text = (t or "").encode()
        at = list(WORD.finditer(text.lower()))
        ws = [m[0] for m in at]
        hit = sorted({k for n in sizes for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for k in range(i, i + n)})
        if 2 * len(hit) > len(ws):
            continue
        if hit:
            kept, end, runs = b"", 0, [k for k in hit if k - 1 not in set(hit)]
            for a in runs:
                b = a
                while b + 1 in set(hit):
                    b += 1
                kept, end = kept + text[end : at[a].start()], at[b].end()
            t = (kept + text[end:]).decode()
        out.append((d, t, *rest[:-1], len(t) if t is not None else rest[-1]))
    return out


def plain_mix(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=COLUMNS))
    taken = {d: t // s if s else 0 for d, s, t in con.execute(f"SELECT doc_id, size, taken FROM ({ORACLES['op2_mix_sources']})").fetchall()}
    return [(*r, k) for r in rows for k in range(taken[r[0]])]


def test_every_stage_against_a_plain_version(spark):
    docs = table(spark, DATA, "documents")
    items = [x.text for x in table(spark, DATA, "benchmark").collect()]
    good = {x.doc_id for x in quality(docs, table(spark, DATA, "labels")).where("predicted = 1").collect()}
    every = sorted(tuple(x) for x in docs.select(COLUMNS).collect())
    plain = [lambda rows: [r for r in rows if r[0] in good], plain_near_dedup, plain_repeats, lambda rows: plain_decontaminate(rows, items), plain_mix]
    now, rows = docs, every
    for (name, stage), own in zip(corpus_pipeline.STAGES, plain):
        now, _ = kept(stage(spark, now, DATA), "stage")
        before, rows = sorted(rows), own(rows)
        assert sorted(map(tuple, now.collect())) == sorted(rows), name
        assert sorted(rows) != before, name
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(rows)


def test_columns_of_any_name(spark):
    docs = table(spark, DATA, "documents").where("doc_id < 60").drop("n_chars")
    for name in ("copy", "_key", "_copies", "_first", "hits", "_hits", "_doc", "tk", "h", "component_id", "kept", "parts", "size", "a b.c"):
        docs = docs.withColumn(name, F.col("doc_id") * 3)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, DATA)
        names = [c for c in docs.columns if c != "copy"]
        assert [c for c in got.columns if c != "copy"] == names and got.columns.count("copy") == 1
        assert all(x["a b.c"] == 3 * x["doc_id"] == x["_hits"] for x in got.collect())


def test_very_long_texts(spark):
    r = random.Random(9)
    long = " ".join(str(r.randrange(10**6)) for _ in range(120_000))
    rows = [(1, long, "en", "s", 1), (2, long + " more", "en", "s", 1), (3, "z " + " ".join(long.split()[500:700]), "en", "t", 1)]
    docs = frame(spark, rows)
    assert [x.doc_id for x in stages.one_of_each_group(spark, docs, DATA).orderBy("doc_id").collect()] == [1, 3]
    assert {x.doc_id: len((x.text or "").split()) for x in stages.without_repeats(spark, docs, DATA).collect()} == {1: 120_000, 2: 1, 3: 1}
    assert stages.without_benchmark(spark, docs, DATA).count() == 3 and stages.good_quality(spark, docs, DATA).count() <= 3

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.llm import language_model as L
from hopweave.llm.textcore import Chunk

DATA = "/root/testdata/sf0.01"


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return low.encode().split() + [None]


def brute(rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held) if not h for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return [
        (d, h, len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)))
        for (d, t), h in zip(rows, held)
    ]


@pytest.mark.parametrize("known", [1 << 20, 500])
def test_counts_and_base(spark, monkeypatch, known):
    monkeypatch.setattr(L, "KNOWN", known)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("doc_id < 300")
    rows = [tuple(x) for x in docs.collect()] + [(None, "x Y"), (10**6, None), (10**6 + 1, ""), (5, "the the of zzqq")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS c").repartition(3)
    got = L.language_model(df).collect()
    key = lambda x: (str(x[0]), x[2], round(x[5], 4))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute(rows), key=key), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert g[6] < 0
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > 1.02 * sum(x.base_score for x in held) or known == 500


def test_chances_sum_to_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").select("text")
    lm = L.LanguageModel(docs)
    m = lm.model
    shape = np.array([r["shape"] for r in lm.counts.collect()])
    h = np.array([r["h"] for r in lm.counts.collect()], dtype=np.int64).view(np.uint64)
    place, number, kind, _ = m.placed(h, shape)
    assert (place >= 0).all() and (lm.words.find(h + np.uint64(1)) < 0).sum() > 0.99 * len(h)
    rare = number < 0
    total = np.bincount(kind[rare], 10 ** (np.log10(lm.words.count[place[rare]] + L.ALPHA) - lm.per_class[kind[rare]]), minlength=L.CLASSES)
    total[L.CLUSTERS :] += L.ALPHA * 10 ** -lm.per_class[L.CLUSTERS :]
    assert np.allclose(total[np.unique(kind[rare])], 1)
    at = np.flatnonzero(~rare)
    for one, two in ((3, 40), (L.START_CLASS, L.START_CLASS), (0, 31)):
        share = 10 ** m.in_cluster(number[at], kind[at], np.full(len(at), one), np.full(len(at), two))
        assert np.allclose(np.bincount(kind[at], share, minlength=L.CLUSTERS)[np.unique(kind[at])], 1)
    hashes, shapes, begin = L.tokens(Chunk([0], [b"the of and the end."]))
    rows = L.features(L.before(m.placed(hashes, shapes)[3], begin), m.tables)
    assert rows.shape == (6, 4) and np.allclose(L.Softmax(m.weights, m.bias).chances(rows).sum(axis=1), 1, atol=1e-5)


def test_residues_are_the_gradient():
    r = np.random.default_rng(0)
    rows = np.column_stack([r.integers(0, 5, 200) + 10 * j for j in range(4)])
    kind = r.integers(0, 48, 200)
    w, b = r.normal(0, 0.5, (40, 48)).astype(np.float32), np.zeros(48, np.float32)
    expected = L.Expected(L.Model(None, None, (10, 10, 10, 10), w, b, None, None, None, None))
    for a in (0, 70):
        expected.add(rows[a : a + 70 if not a else None])
    came = np.zeros(w.shape, dtype=np.int64)
    np.add.at(came, (rows, kind[:, None]), L.UNIT)
    sums = came - expected.total()

    def gain(x):
        y = (x[rows].sum(axis=1) + b).astype(np.float64)
        return (y[np.arange(200), kind] - np.log(np.exp(y).sum(axis=1))).sum()

    for i, k in ((0, 3), (13, 7), (24, 47), (31, 0)):
        up, down = w.astype(np.float64), w.astype(np.float64)
        up[i, k] += 1e-4
        down[i, k] -= 1e-4
        assert abs((gain(up) - gain(down)) / 2e-4 - sums[i, k] / L.UNIT) < 1e-2


def test_rows_are_added():
    r = np.random.default_rng(3)
    rows = np.sort(r.integers(0, 40, 900)) * r.integers(0, 3, 900)
    values = r.integers(0, 1000, (900, 3))
    sums = np.ones((80, 3), dtype=np.int64)
    L.add_rows(sums, values, rows)
    assert all((values[rows == x].sum(axis=0) + 1 == s).all() for x, s in enumerate(sums)) and (np.bincount(rows) > L.LONG).any()


def test_score_against_a_plain_sum(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    own = docs.select("doc_id", L.held_out(F.col("doc_id")).alias("held_out"), "text")
    lm = L.LanguageModel(own.where("NOT held_out").select("text"))
    m, count = lm.model, {int(h): c for h, c in zip(lm.words.h, lm.words.count)}
    got = {x.doc_id: x.score for x in lm.score(own).collect()}
    for d, text in [tuple(x) for x in docs.where("doc_id < 12").collect()]:
        h, shape, _ = L.tokens(Chunk([0], [(text or "").encode()]))
        number = [int(m.words.number[m.words.find(x[None])[0]]) if int(x) in count else -1 for x in h]
        code = [n if n >= 0 else int(x) | 1 << 63 for n, x in zip(number, h)]
        kind = [int(m.clusters[n]) if n >= 0 else L.CLUSTERS + min(int(s), L.SHAPES - 1) for n, s in zip(number, shape)]
        total = 0.0
        for t in range(len(h)):
            before = [np.array([code[t - k] if t >= k else L.START], dtype=np.uint64) for k in (1, 2, 3)]
            y = m.bias + sum(m.weights[row].astype(np.float64) for row in L.features(before, m.tables)[0])
            total += (y[kind[t]] - math.log(np.exp(y).sum())) / math.log(10)
            if number[t] >= 0:
                one, two = (kind[t - k] if t >= k else L.START_CLASS for k in (1, 2))
                peers = [n for n in set(m.words.number[m.words.number >= 0].tolist()) if m.clusters[n] == kind[t]]
                z = {n: m.word[n] + m.first[one, n] + m.second[two, n] for n in peers}
                total += (z[number[t]] - math.log(sum(map(math.exp, z.values())))) / math.log(10)
            else:
                total += math.log10(count.get(int(h[t]), 0) + L.ALPHA) - lm.per_class[kind[t]]
        assert abs(total - got[d]) < 1e-4 * max(1, abs(total)), d


def test_word_softmax_meets_its_counts():
    r = np.random.default_rng(2)
    label = np.zeros(L.COMMON, dtype=np.int64)
    own = r.dirichlet(np.ones(6), (L.CONTEXTS, L.CONTEXTS))
    times = np.zeros((L.CONTEXTS, L.CONTEXTS))
    times[:3, :3] = 400
    n1, n2, joint = np.zeros((L.CONTEXTS, L.COMMON)), np.zeros((L.CONTEXTS, L.COMMON)), np.zeros((L.CLASSES, L.CONTEXTS, L.CONTEXTS))
    cell = own * times[:, :, None]
    n1[:, :6], n2[:, :6], joint[0] = cell.sum(axis=1), cell.sum(axis=0), times
    word, first, second, norm = L.word_softmax(n1, n2, joint, label, rounds=200, prior=1e-3)
    p = np.exp(word[:6] + first[:, None, :6] + second[None, :, :6] - norm[0][:, :, None])
    assert np.allclose(p.sum(axis=2), 1) and np.allclose((p * times[:, :, None]).sum(axis=1)[:3], n1[:3, :6], atol=2) and np.allclose((p * times[:, :, None]).sum(axis=0)[:3], n2[:3, :6], atol=2)


def test_layout_and_rounds(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("doc_id < 400")
    rows = spark.createDataFrame(docs.collect() + [(5, "the the of zzqq")] * 40, "doc_id long, text string")
    scores = [sorted((x.doc_id, x.n_tokens, x.score) for x in L.language_model(rows.repartition(n, F.rand(n))).collect()) for n in (1, 4, 9)]
    for other in scores[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in scores[0]] and np.allclose([x[2] for x in other], [x[2] for x in scores[0]], rtol=1e-9)
    own = rows.select("doc_id", L.held_out(F.col("doc_id")).alias("held_out"), "text")
    held = [sum(x.score for x in L.LanguageModel(own.where("NOT held_out").select("text"), n).score(own).where("held_out").collect()) for n in (0, 4)]
    assert held[1] > held[0]


def test_tokens_before():
    ids, begin = np.array([1, 2, 3, 4, 5], dtype=np.uint64), np.array([0, 3])
    one, two, three = L.before(ids, begin)
    s = L.START
    assert one.tolist() == [s, 1, 2, s, 4] and two.tolist() == [s, s, 1, s, s] and three.tolist() == [s, s, s, s, s]


def test_empty(spark):
    assert L.language_model(spark.createDataFrame([], "doc_id long, text string")).collect() == []

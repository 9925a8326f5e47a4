import random
import re
import textwrap

from notices import NOTICES

from hopweave.llm.license_scan import FAMILIES, classifier, license_paragraphs, license_scan, scan_texts

DATA = "/root/testdata/sf0.01"
#: The announcements that the test tables hold.
KNOWN = {r"Licensed under CC BY-NC 4\.0\.": "cc-by-nc", r"Licensed under the Apache License, Version 2\.0\.": "apache-2.0", r"This work is licensed under the GNU General Public License, version 3\.": "gpl-3", r"Released under the MIT License\.": "mit", r"All rights reserved\.": "proprietary"}


def test_against_patterns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {x.doc_id: x.families for x in license_scan(docs).collect()}
    want = {x.doc_id: ",".join(sorted({f for p, f in KNOWN.items() if re.search(p, x.text)})) for x in docs.collect()}
    assert got == want and sum(map(bool, want.values())) > 10


def test_families_and_other_text():
    for name, sentences in FAMILIES.items():
        for s in sentences:
            assert [x[2] for x in scan_texts([b"zz yy\n" + s.upper().encode() + b"\nxx"])[1][0]] == [name], s
    other = [b"He got a driving licence and a copy of the public law.", b"The general version of the work is free.", b"license", b"under the of and", b"released under pressure", None, b"", b"\n\n"]
    assert not any(scan_texts(other)[1])
    assert 0.25 <= classifier().threshold <= 0.95


def test_odd_rows(spark):
    rows = [(1, "a\n\nReleased under the MIT License.\nb"), (1, "a\n\nReleased under the MIT License.\nb"), (None, "Licensed under CC BY 4.0."), (3, None), (4, " \n "), (5, "x " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start")
    assert sorted((str(x.doc_id), x.n_paragraphs, x.families) for x in license_scan(df).collect()) == [("1", 3, "mit"), ("1", 3, "mit"), ("3", 0, ""), ("4", 0, ""), ("5", 1, ""), ("None", 1, "cc-by")]
    assert sorted((str(x.doc_id), x.start, x.end) for x in license_paragraphs(df).collect()) == [("1", 3, 33), ("1", 3, 33), ("None", 0, 24)]
    assert license_scan(df.limit(0)).collect() == []


def test_wrapped_notices():
    head = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    notices = {"bsd": FAMILIES["bsd"][2], "cc0": FAMILIES["cc0"][1], "gpl-3": head + ", either version 3 of the License", "gpl-2": head + "; either version 2 of the License"}
    for name, text in notices.items():
        for width in (35, 60, 72):
            for mark in ("", "# ", " * "):
                lines = [mark + x for x in textwrap.wrap(text + ", or so.", width)]
                found = scan_texts(["\n".join(["int main;", "", *lines, "", "zz yy"]).encode()])[1][0]
                assert [x[2] for x in found] == [name], (name, width, mark, found)
    assert not scan_texts([b"permission is\n\nhereby granted\n\nfree of\n\ncharge"])[1][0]


def test_whole_notices_give_their_own_family():
    for name, text in NOTICES:
        for width, mark in ((60, ""), (72, " * "), (40, "# "), (10**4, "")):
            lines = (f"\n{mark}\n").join("\n".join(mark + x for x in textwrap.wrap(p, width)) for p in text.split("\n\n"))
            found = {x[2] for x in scan_texts([lines.encode()])[1][0]} - {"proprietary"}  # "All rights reserved." stands in the notice of bsd
            assert found == {name}, (name, width, found)


def test_error_rates_on_paragraphs_not_trained_on(spark):
    r = random.Random(77)
    words = [w for x in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 200").collect() for w in (x.text or "").split()]
    noise = lambda n: " ".join(r.choice(words) for _ in range(n))
    right = total = 0
    for name, sentences in FAMILIES.items():
        for s in sentences:
            for _ in range(10):
                kept = " ".join(w for w in s.split() if r.random() > 0.05) or s
                got = [x[2] for x in scan_texts([f"{noise(r.randint(0, 6))} {kept} {noise(r.randint(0, 6))}".encode()])[1][0]]
                total += 1
                right += got == [name]
    assert right >= 0.9 * total, right / total
    # lines of the corpus and shuffled words of notices are no licences
    terms = re.compile(r"licen|copyright|rights reserved|creative commons|gnu|cc by|cc0", re.I)
    lines = [x for d in spark.read.parquet(f"{DATA}/documents.parquet").collect() for x in (d.text or "").split("\n") if not terms.search(x)]
    every = [w for _, t in NOTICES for w in t.split()]
    lines += [" ".join(r.choice(every) for _ in range(25)) for _ in range(500)]
    wrong = sum(map(bool, scan_texts([x.encode() for x in lines])[1]))
    assert wrong <= 0.001 * len(lines), (wrong, len(lines))
    print("right", right / total, "wrong", wrong, "of", len(lines))

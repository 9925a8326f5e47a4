"""Suffix-array dedup: an enhanced suffix array in buckets, scanned as a common-prefix interval tree.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document too.
Any such string holds a smallest gram (of `gram` bytes), at the same offset wherever the string stands; so the
suffixes that begin at those grams, with what stands left of them, are all that the array needs. Buckets are the
grams; equal surroundings are counted before they are shuffled, and one of them stands for all. In each bucket
the suffixes are sorted, common prefixes of neighbours give the interval tree by a scan with a stack, and in each
interval the left sides, sorted too, are tested for diversity: a run of left sides with enough in common is a group
of maximal repeats with all its occurrences.

A bucket of more than `most` different surroundings is not given to one task: its strings are divided by how much
of them stands left of the gram, halving that range each round. A half keeps what shares the bytes that all its
strings have (hashed into a new bucket); what has all the bytes of the half in common is settled and one stays for
all. So no bucket is larger than `most`, none is cut off, and the number of rounds is bounded by log2(length).

Strings that stand in equal surroundings (`whole`), and those of divided buckets, are equal by 64-bit hashes, under a
gram's 64 bits; in ordinary buckets bytes are compared.

Nulls and the like: a null text counts as empty; a row with a null doc_id is treated like any other; repeated rows
are each other's copies, and share one set of hits; extra columns are ignored; an empty table gives an empty result. A
text is held whole by a task, at about 60 bytes a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, kept
from .textcore import BYTE, BYTES_BASE, U64, Rolling, as_bytes, chunks, merged, mix, regions, runs_of

LENGTH, GRAM, MOST = 400, 100, 4096
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
MEMBER = "h long, did long, tk long, at int, n int, off int, alone boolean, span binary"


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval of a suffix array, children before parents, by a scan with a stack."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcp, -1]):
        left = i
        while stack and stack[-1][0] > v:
            length, left = stack.pop()
            yield length, left, i
        if v >= 0 and (not stack or stack[-1][0] < v):
            stack.append((v, left))


def _common(strings: list[bytes], order: np.ndarray, width: int) -> np.ndarray:
    """Bytes that neighbours in the order have in common at their beginning."""
    size = np.fromiter((len(s) for s in strings), dtype=np.int64, count=len(strings))[order]
    grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)[order]
    differ = grid[1:] != grid[:-1]
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.minimum(at, np.minimum(size[1:], size[:-1]))


def repeat_groups(right: np.ndarray, rank: np.ndarray, left: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Maximal repeats of a bucket: (members, what each shares with its nearest to the left, what all share to the right).

    right: common prefixes of neighbouring suffixes; rank: each suffix's place among the sorted left sides;
    left: common left sides of neighbours there.
    """
    table = [left]
    while 2 << (len(table) - 1) <= len(left):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    reach = int(left.max(initial=0))
    for length, first, last in lcp_intervals(right.tolist()):
        if length + reach < need:
            continue
        members = first + np.argsort(rank[first : last + 1])
        r = rank[members]
        level = np.frexp((r[1:] - r[:-1]).astype(np.float64))[1] - 1
        if len(r) == 2:
            k = int(level[0])
            near = np.minimum(table[k][r[:1]], table[k][r[1:] - (1 << k)])
        else:
            near = np.array([min(table[k][a], table[k][b - (1 << k)]) for k, a, b in zip(level.tolist(), r[:-1].tolist(), r[1:].tolist(), strict=True)])
        enough = near + length >= need
        if enough.any():
            cut = np.flatnonzero(np.diff(enough, prepend=False, append=False))
            for a, b in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True):
                own = near[a:b]
                yield members[a : b + 1], np.maximum(np.r_[own[:1], own], np.r_[own, own[-1:]]), length


def bucket_cover(off: list[int], spans: list[bytes], need: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member of one bucket, how many bytes left and right of its gram's start are repeated (0 and 0: none)."""
    n = len(off)
    suffix = [s[o:] for s, o in zip(spans, off, strict=True)]
    before = [s[:o][::-1] for s, o in zip(spans, off, strict=True)]
    array = np.array(sorted(range(n), key=suffix.__getitem__))
    sides = np.array(sorted(range(n), key=before.__getitem__))
    place = np.empty(n, dtype=np.int64)
    place[sides] = np.arange(n)
    right = _common(suffix, array, max(map(len, suffix)))
    left = _common(before, sides, max(1, *map(len, before)))
    lefts, rights = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for members, shared, length in repeat_groups(right, place[array], left, need):
        who = array[members]
        lefts[who] = np.maximum(lefts[who], shared)
        rights[who] = np.maximum(rights[who], length)
    return lefts, rights


def _index(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tks = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("did", "tk"))
            for c in chunks(as_bytes(batch.column("text")), 1 << 17):
                roll = Rolling(BYTE[c.data], BYTES_BASE)
                grams = roll.grams(gram)
                cap = len(grams)
                at, a, b = regions(grams, length - gram + 1, np.minimum(c.lo, cap), np.minimum(np.maximum(c.hi - gram + 1, c.lo), cap))
                if not len(at):
                    continue
                d = c.owner(a, c.lo)
                ctx = mix(roll.runs(a, b + length) ^ ((at - a).astype(U64) << U64(32)) ^ (b - a).astype(U64))
                row = c.rows[d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (grams[at].view(np.int64), ctx.view(np.int64), ids[row], tks[row], (a - c.lo[d]).astype(np.int32), (b - a + 1).astype(np.int32), (at - a).astype(np.int32))],
                    ["h", "ctx", "did", "tk", "at", "n", "off"],
                )

    return run


_MEMBER = pa.schema([("h", pa.int64()), ("did", pa.int64()), ("tk", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("alone", pa.bool_()), ("span", pa.binary())])
_COVER = pa.schema([("did", pa.int64()), ("tk", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])


def _members(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for did, tk, text, blocks in zip(batch.column("did").to_pylist(), batch.column("tk").to_pylist(), as_bytes(batch.column("text")), batch.column("blocks").to_pylist(), strict=True):
                out += [(x["h"], did, tk, x["at"], x["n"], x["off"], x["alone"], text[x["at"] : x["at"] + x["n"] - 1 + length]) for x in blocks]
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*out, strict=True), _MEMBER, strict=True)], schema=_MEMBER)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*out, strict=True), _MEMBER, strict=True)], schema=_MEMBER)

    return run


def _scan(length: int, key: str):
    """Buckets, sorted by key -> what of their members is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs_of(batches, key):
            k = held.column(key).to_numpy()
            cut = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
            off, at, spans, alone = (held.column(x).to_pylist() for x in ("off", "at", "span", "alone"))
            who, start, end = [], [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a < 2 or not any(alone[a:b]):
                    continue
                lefts, rights = bucket_cover(off[a:b], spans[a:b], length)
                for i in np.flatnonzero(rights).tolist():
                    if alone[a + i]:
                        place = at[a + i] + off[a + i]
                        who.append(a + i)
                        start.append(place - int(lefts[i]))
                        end.append(place + int(rights[i]))
            if who:
                part = held.select(["did", "tk"]).take(pa.array(who)).combine_chunks()
                yield pa.RecordBatch.from_arrays([part.column(0).chunk(0), part.column(1).chunk(0), pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema=_COVER)

    return run


def _halved(length: int, gram: int):
    """Each row of a bucket -> its one or two rows in the halves of the bucket's range; key: what all strings of the half share; whole: all of its bytes."""
    names = [*_MEMBER.names, "key", "whole", "lo", "hi", "cs", "ce"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            at, n, off, spans, los, his = (batch.column(x).to_pylist() for x in ("at", "n", "off", "span", "lo", "hi"))
            for i, (a, m, o, s, lo, hi) in enumerate(zip(at, n, off, spans, los, his, strict=True)):
                mid = (lo + hi) // 2
                for x, y in ((lo, mid), (mid + 1, hi)):
                    low, high = max(x, o - m + 1), min(y, o)  # what of this range the member's strings have
                    if x > y or low > high:
                        continue
                    key = xxhash.xxh3_64_intdigest(s[o - x : o + length - y], x * 1000 + y)
                    whole = xxhash.xxh3_64_intdigest(s[o - high : o + length - low], low * 1000 + high)
                    rows.append((i, key - (key >> 63 << 64), whole - (whole >> 63 << 64), x, y, a + o - high, a + o - low + length))
            if rows:
                who, *more = zip(*rows, strict=True)
                base = batch.select(_MEMBER.names).take(pa.array(who))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*base.columns, *(pa.array(v, type=t) for v, t in zip(more, kinds, strict=True))], names)

    return run


def _hot_cover(hot: DataFrame, length: int, gram: int, most: int) -> list[DataFrame]:
    """Halves buckets of over `most` members until none is left; gives what is repeated in them."""
    found = []
    at = hot.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - gram))
    old = ""
    while True:
        rows, rows_at = kept(at.mapInArrow(_halved(length, gram), f"{MEMBER}, key long, whole long, lo int, hi int, cs int, ce int"), "halves")
        alike, alike_at = kept(rows.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("did", "tk", "at")).alias("one")), "alike")
        both = rows.join(alike, ["key", "whole"])
        found.append(kept(both.where("c > 1 AND alone").select("did", "tk", F.col("cs").alias("from"), F.col("ce").alias("to")), "settled")[0])
        one = both.where("one.did = did AND one.tk = tk AND one.at = at").withColumn("alone", F.expr("alone AND c = 1"))
        sizes = alike.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        left, left_at = kept(one.join(sizes, "key").select(*_MEMBER.names, "key", "lo", "hi", "members").where("lo < hi"), "left")
        small = left.where(F.col("members") <= most).repartition("key").sortWithinPartitions("key")
        found.append(kept(small.mapInArrow(_scan(length, "key"), "did long, tk long, from int, to int"), "scanned")[0])
        at = left.where(F.col("members") > most)
        more = not at.isEmpty()
        drop(hot.sparkSession, rows_at, alike_at, *([old] if old else []))
        old = left_at
        if not more:
            return found


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """did, tk, from, to: bytes of texts (keyed by doc_id, null as the smallest long, and a hash of the text) that are repeated."""
    spark = docs.sparkSession
    own = _keyed(docs).where(F.octet_length("text") >= length)
    blocks, blocks_at = kept(own.mapInArrow(_index(length, gram), "h long, ctx long, did long, tk long, at int, n int, off int"), "blocks")
    texts, texts_at = kept(blocks.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("did", "tk", "at")).alias("one"), F.max("n").alias("n"), F.max("off").alias("off")), "texts")
    grams = texts.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.sum("c").alias("all")).where("`all` > 1").select("h", "members")
    index, index_at = kept(texts.join(grams, "h"), "index")
    whole, whole_at = kept(blocks.join(index.where("c > 1").select("h", "ctx"), ["h", "ctx"]).select("did", "tk", F.col("at").alias("from"), F.expr(f"at + n - 1 + {length}").alias("to")), "whole")
    drop(spark, blocks_at, texts_at)
    wanted = index.where("members > 1").select("one.did", "one.tk", F.struct("h", "one.at", "n", "off", (F.col("c") == 1).alias("alone"), "members").alias("x"))
    wanted = wanted.groupBy("did", "tk").agg(F.collect_list("x").alias("blocks"))
    # one row of each text: a bucket has no more members than texts
    members, members_at = kept(own.dropDuplicates(["did", "tk"]).join(wanted, ["did", "tk"]).select("did", "tk", "text", "blocks").mapInArrow(_members(length), MEMBER), "members")
    large = index.where(F.col("members") > most).select("h").distinct()
    any_large = not large.isEmpty()
    usual = members.join(large, "h", "left_anti") if any_large else members
    found = [whole, usual.repartition("h").sortWithinPartitions("h").mapInArrow(_scan(length, "h"), "did long, tk long, from int, to int")]
    if any_large:
        found += _hot_cover(members.join(large, "h"), length, gram, most)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    out, _ = kept(out, "repeats")
    drop(spark, index_at, whole_at, members_at)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tk"), F.coalesce("text", F.lit("")).alias("text"))


def _kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, hits in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("hits"), strict=True):
            spans, left = 0, text
            if hits.is_valid and len(hits):
                start, end = merged(*(hits.values.field(k).to_numpy().astype(np.int64) for k in (0, 1)))
                spans = len(start)
                left = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True))
            rows.append((doc, len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """What each document keeps: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (see the module)."""
    hits = repeats(docs, length, gram, most).groupBy("did", "tk").agg(F.collect_set(F.struct("from", "to")).alias("hits"))
    return _keyed(docs).join(hits, ["did", "tk"], "left").select("doc_id", "text", "hits").mapInArrow(_kept_bytes, OUT)

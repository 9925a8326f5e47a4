"""MinHash near-dedup by an LSH forest.

A document's set is its distinct shingles (hashes of `size` words, lower-cased). Equal sets are one class. Each class
has `TREES * DEPTH` minhashes. Each tree of the forest is a sorted order of the classes, by their minhashes in a cyclic
order of its own; ranges of the orders are sorted by different tasks. A scan along an order measures the common prefix of
neighbours. Neighbours that share `DEPTH` minhashes are in a region with all that stand between them and share these;
where an order is thin, the nearest two are a region if they share `SHALLOW`. What has no such neighbour is left
out of the order at once. A region of more than `most` classes gives its neighbours in the order as candidates, which have
the longest prefixes in common, and goes deeper (half as much again or twice the prefix each time) until it isn't too
large; what deeper prefixes put asunder is then held against each other block by block, but for what is
in one component already, so that no region is capped or sampled.

In a region, intersections of the full sets are counted, by one matrix product of its shared shingles, and links are
those at `percent` or more; out come edges that span its components, not pairs. Regions with the same members in
several trees are done once. A link at 85 % is missed if none of 24 trees has it in a region: (1 - 0.85**4)**24, that
is 2e-8; at 80 %, 3e-6.

The blocks of a large region hold its classes outside the main component against all others. Rows and work for them are
the number of those times the number of blocks: none for one connected group, and quadratic only where thousands of
classes share a prefix and are not linked.

Nulls and the like: documents without words have an empty set and are linked with nothing; fewer words than a shingle
make one shingle of all; a null doc_id has no place among components: its component is null and it is kept; rows that
repeat a doc_id are one vertex, linked by any of their texts, and kept or not together; extra columns are ignored;
an empty table gives no rows. A text is held whole by a task, at about 40 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import drop, kept
from .textcore import U64, WORDS_BASE, Chunk, Rolling, as_bytes, chunks, mix, runs_of, stream

TREES, DEPTH, MOST = 24, 4, 2048
#: Minhashes of an order that it is sorted by, and the least that neighbours in a thin part have to share.
PATH, SHALLOW = 8, 3
WIDTH = TREES * DEPTH
_FLIP, _TIMES = stream(11, WIDTH), stream(12, WIDTH) | U64(1)


def shingles(c: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk's documents, sorted by document, and where each document's begin (one more at the end)."""
    c.words(lower=True)
    roll = Rolling(c.word_hashes(), WORDS_BASE)
    n = c.last - c.first
    per = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), per)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + c.first[row]
    length = np.minimum(n, size)[row]
    h = mix(roll.runs(at, at + length) + length.astype(U64))
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def minhashes(h: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """WIDTH minhashes of each set that begins at lo; none is empty."""
    out = np.empty((len(lo), WIDTH), dtype=np.uint32)
    for j in range(WIDTH):
        out[:, j] = np.minimum.reduceat((h ^ _FLIP[j]) * _TIMES[j], lo) >> U64(32)
    return out


def tree_keys(sig: np.ndarray, depth: int) -> np.ndarray:
    """For each tree, a hash of the first `depth` minhashes in its order."""
    out = np.empty((len(sig), TREES), dtype=np.int64)
    for t in range(TREES):
        h = np.full(len(sig), t + 1, dtype=U64)
        for d in range(depth):
            h = mix(h * U64(31) + sig[:, (t * DEPTH + d) % WIDTH])
        out[:, t] = h.view(np.int64)
    return out


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tks = batch.column("doc_id"), batch.column("tk")
            for c in chunks(as_bytes(batch.column("text"))):
                h, lo = shingles(c, size)
                n = np.diff(lo)
                some = n > 0
                s1, s2 = np.zeros(len(n), dtype=U64), np.zeros(len(n), dtype=U64)
                sig = np.zeros((len(n), WIDTH), dtype=np.uint32)
                if some.any():
                    s1[some], s2[some] = np.add.reduceat(mix(h), lo[:-1][some]), np.add.reduceat(mix(h ^ U64(0x5DEECE66D)), lo[:-1][some])
                    sig[some] = minhashes(h, lo[:-1][some])
                rows = pa.array(c.rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), tks.take(rows), pa.array(n), pa.array(mix(s1 + n.astype(U64)).view(np.int64)), pa.array(s2.view(np.int64)), pa.array([s.tobytes() if k else None for s, k in zip(sig, some, strict=True)], type=pa.binary())],
                    ["doc_id", "tk", "n", "c", "c2", "sig"],
                )

    return run


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures -> a row for each tree: the class and its path, the first minhashes of that tree's order."""
    turn = (np.arange(TREES)[:, None] * DEPTH + np.arange(PATH)) % WIDTH
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, WIDTH)
            path = pa.py_buffer(sig[:, turn].astype(">u4").tobytes())
            n = len(sig) * TREES
            paths = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * PATH), n, [None, path]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("c").to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(sig))), paths], ["c", "tree", "path"])


def common_prefix(tree: np.ndarray, path: np.ndarray) -> np.ndarray:
    """How many minhashes each row of an order shares with the next one."""
    return np.cumprod(path[1:] == path[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of the orders, sorted -> class, tree and region key of what shares a prefix with a neighbour, and the next class.

    The first and the last row of a range may have a neighbour in the next range: they stay, under the same key.
    """
    tree, path, c = np.zeros(0, dtype=np.int32), np.zeros((0, PATH), dtype=np.uint32), np.zeros(0, dtype=np.int64)
    before = DEPTH

    def scan(last: bool) -> pa.RecordBatch:
        shared = common_prefix(tree, path)
        near = np.maximum(np.r_[before, shared], np.r_[shared, DEPTH if last else 0])[: len(c) if last else len(c) - 1]
        row = np.flatnonzero(near >= DEPTH)
        key = (tree[row] + 1).astype(U64)
        for d in range(DEPTH):
            key = mix(key * U64(31) + path[row, d])
        two = np.flatnonzero((shared >= SHALLOW) & (shared < DEPTH))
        both = mix(mix(c[two].view(U64)) * U64(31) + c[two + 1].view(U64))
        out = [np.r_[c[row], c[two], c[two + 1]], np.r_[tree[row], tree[two], tree[two]], np.r_[key, both, both].view(np.int64)]
        none = np.r_[np.r_[shared, 0][row] < DEPTH, np.ones(2 * len(two), dtype=bool)]
        after = np.r_[np.r_[c[1:], 0][row], c[two], c[two]]
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in out), pa.array(after, mask=none)], ["c", "tree", "key", "after"])

    for batch in batches:
        if batch.num_rows:
            tree = np.r_[tree, batch.column("tree").to_numpy()]
            path = np.concatenate([path, np.frombuffer(b"".join(batch.column("path").to_pylist()), dtype=">u4").reshape(-1, PATH).astype(np.uint32)])
            c = np.r_[c, batch.column("c").to_numpy()]
            yield scan(False)
            if len(c) > 1:
                before = int(common_prefix(tree[-2:], path[-2:])[0])
            tree, path, c = tree[-1:], path[-1:], c[-1:]
    if len(c):
        yield scan(True)


def _keyed(depth: int):
    """Signatures -> keys at a depth of the row's own tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, WIDTH)
                tree = batch.column("tree").to_numpy()
                keys = tree_keys(sig, depth)[np.arange(len(sig)), tree]
                yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(tree, type=pa.int32()), pa.array(keys)], ["c", "tree", "key"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("c")
            for c in chunks(as_bytes(batch.column("text"))):
                h, lo = shingles(c, size)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c.rows)), pa.array([h[a:b].tobytes() for a, b in zip(lo[:-1], lo[1:], strict=True)], type=pa.binary())], ["c", "set"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sets (all with all of one list, or of one list with another), exactly."""
    every = left + (right or [])
    who = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, place, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    common = count > 1
    number = np.cumsum(common) - 1
    keep = common[place]
    who, place = who[keep], number[place[keep]]
    out = np.zeros((len(left), len(right) if right is not None else len(left)))
    by = np.argsort(place, kind="stable")
    who, place = who[by], place[by]
    width = max(64, min(4096, (1 << 24) // len(every)))
    for a in range(0, int(common.sum()), width):
        x, y = np.searchsorted(place, (a, a + width))
        m = np.zeros((len(every), width), dtype=np.float32)
        m[who[x:y], place[x:y] - a] = 1
        out += m[: len(left)] @ (m[len(left) :] if right is not None else m).T
    return out


def _spanning(linked: np.ndarray) -> np.ndarray:
    """The smallest place that each place is connected with."""
    label = np.arange(len(linked))
    np.fill_diagonal(linked, True)
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1)
        near = near[near]
        if (near == label).all():
            return label
        label = near


def _region_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs_of(batches, "region"):
            region = held.column("region").to_numpy()
            cut = np.r_[0, np.flatnonzero(region[1:] != region[:-1]) + 1, len(region)]
            c, sets = held.column("c").to_numpy(), [np.frombuffer(s, dtype=U64) for s in held.column("set").to_pylist()]
            side = held.column("side").to_pylist()
            u, v = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                n = np.array([len(s) for s in sets[a:b]])
                if side[a] == side[b - 1] and side[a]:  # a block without its other one
                    continue
                if side[a] != side[b - 1]:  # two blocks, one against the other
                    k = a + side[a:b].index(2)
                    both = intersections(sets[a:k], sets[k:b])
                    i, j = np.nonzero(100 * both >= percent * (n[: k - a, None] + n[None, k - a :] - both))
                    full = np.zeros((b - a, b - a), dtype=bool)
                    full[i, j + k - a] = full[j + k - a, i] = True
                elif b - a == 2:
                    both = len(np.intersect1d(sets[a], sets[a + 1], assume_unique=True))
                    full = np.full((2, 2), 100 * both >= percent * (n.sum() - both))
                else:
                    both = intersections(sets[a:b])
                    full = 100 * both >= percent * (n[:, None] + n[None, :] - both)
                label = _spanning(full)
                moved = np.flatnonzero(label != np.arange(b - a))
                u.append(c[a + moved])
                v.append(c[a + label[moved]])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return run


class Forest:
    """The classes of a corpus and the links between them."""

    def __init__(self, docs: DataFrame, size: int, percent: int, most: int):
        self.docs, self.size, self.percent, self.most = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tk"), "text"), size, percent, most
        self.signed, _ = kept(self.docs.mapInArrow(_signed(size), "doc_id long, tk long, n long, c long, c2 long, sig binary"), "signed")
        one = F.min(F.struct("doc_id", "tk")).alias("one")
        self.classes, _ = kept(self.signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "c", "c2").agg(one, F.any_value("sig").alias("sig")).select("n", "c", "c2", "one.doc_id", "one.tk", "sig"), "classes")

    def _grown(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """Regions of two members or more, the same members once: (members of the small ones, members of the others)."""
        rows, rows_at = kept(rows, "rows")
        regions = rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("c")).alias("x"), F.min("c").alias("a"), F.max("c").alias("b")).where("k > 1")
        once = regions.groupBy("k", "x", "a", "b").agg(F.min(F.struct("tree", "key")).alias("r")).select("k", "r.tree", "r.key")
        once, once_at = kept(once, "regions")
        members, members_at = kept(rows.join(once, ["tree", "key"]), "members")
        return members.where(F.col("k") <= self.most), members.where(F.col("k") > self.most), [rows_at, once_at, members_at]

    def _linked(self, members: DataFrame) -> DataFrame:
        """members: region, side, c -> edges that span what is linked in each region."""
        wanted = members.select("c").distinct().join(self.classes.select("c", "doc_id", "tk"), "c")
        sets, sets_at = kept(self.docs.join(wanted, ["doc_id", "tk"]).select("c", "text").mapInArrow(_sets(self.size), "c long, set binary").dropDuplicates(["c"]), "sets")
        rows = members.join(sets, "c").select("region", "side", "c", "set").repartition("region").sortWithinPartitions("region", "side", "c")
        links, _ = kept(rows.mapInArrow(_region_links(self.percent), "u long, v long").distinct(), "region-links")
        drop(self.docs.sparkSession, sets_at)
        return links

    def links(self) -> DataFrame:
        """Edges between classes (by c) with the components of all links."""
        spark = self.docs.sparkSession
        region = F.xxhash64("tree", "key", "depth").alias("region")
        signed = self.classes.select("c", "sig")
        orders = signed.mapInArrow(_orders, "c long, tree int, path binary").repartitionByRange("tree", "path", "c").sortWithinPartitions("tree", "path", "c")
        small, large, used = self._grown(orders.mapInArrow(_neighbours, "c long, tree int, key long, after long"))
        parts = [small.select("c", "tree", "key", F.lit(DEPTH).alias("depth"))]
        # neighbours in the order of a large region
        pairs = large.where("after IS NOT NULL").select(F.least("c", "after").alias("a"), F.greatest("c", "after").alias("b")).distinct()
        parts.append(pairs.select(F.explode(F.array("a", "b")).alias("c"), F.lit(-1).alias("tree"), F.xxhash64("a", "b").alias("key"), F.lit(DEPTH).alias("depth")))
        hot, depth, first = large, DEPTH, large.select("tree", "key", "c", "k")
        while depth < WIDTH and not hot.isEmpty():
            depth = depth + depth // 2 if depth < PATH else min(2 * depth, WIDTH)
            small, hot, more = self._grown(hot.select("c", "tree").join(signed, "c").mapInArrow(_keyed(depth), "c long, tree int, key long"))
            parts.append(small.select("c", "tree", "key", F.lit(depth).alias("depth")))
            used += more
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        links = self._linked(found.select(region, F.lit(0).alias("side"), "c"))
        if depth > DEPTH:
            links = links.unionByName(self._linked(self._blocks(first, links)))
        drop(spark, *used)
        return links

    def _blocks(self, large: DataFrame, links: DataFrame) -> DataFrame:
        """Large regions as pairs of blocks of at most about `most` members, but for pairs within the region's main component.

        Blocks of the main component meet those of the rest only; a region without a rest has none. Sides are 1 and 2, or 0 in a block of its own.
        """
        joined = large.join(components(links).select(F.col("u").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))
        joined, _ = kept(joined, "large")
        main = joined.groupBy("tree", "key", "k", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("tree", "key", "k").agg(F.max(F.struct("m", "component")).alias("main"))
        main = main.where("main.m < k").select("tree", "key", "main.component", F.ceil(F.col("main.m") * 4 / self.most).cast("int").alias("first"), F.ceil((F.col("k") - F.col("main.m")) * 4 / self.most).cast("int").alias("rest"))
        dealt = joined.join(main.withColumnRenamed("component", "main"), ["tree", "key"]).withColumn("in_main", F.col("component") == F.col("main"))
        # a block's number: those of the main component first
        block = F.expr("IF(in_main, CAST(pmod(xxhash64(c), first) AS INT), first + CAST(pmod(xxhash64(c), rest) AS INT))")
        dealt = dealt.select("tree", "key", "c", block.alias("me"), F.explode(F.expr("IF(in_main, sequence(first, first + rest - 1), sequence(0, first + rest - 1))")).alias("other"))
        lower, upper = F.least("me", "other"), F.greatest("me", "other")
        side = F.when(F.col("me") == F.col("other"), 0).when(F.col("me") < F.col("other"), 1).otherwise(2)
        return dealt.select(F.xxhash64("tree", "key", lower, upper).alias("region"), side.alias("side"), "c")

    def components(self) -> DataFrame:
        """doc_id, component of each document that isn't the smallest of its component, by document."""
        names = self.classes.select("c", "doc_id")
        links = self.links()
        between = links.join(names.selectExpr("c AS u", "doc_id AS x"), "u").join(names.selectExpr("c AS v", "doc_id AS y"), "v").selectExpr("x AS u", "y AS v")
        own = self.signed.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "c", "c2")
        copies = own.join(self.classes.select("n", "c", "c2", F.col("doc_id").alias("v")), ["n", "c", "c2"]).where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
        return components(between.unionByName(copies)).withColumnRenamed("u", "doc_id")


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (see the module)."""
    forest = Forest(docs, size, percent, most)
    found = forest.components()
    rows = forest.signed.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id").alias("component_id")
    return rows.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Vectorised text primitives shared by the corpus operators.

Texts are handled as UTF-8 bytes in chunks of whole documents, so that numpy works on arrays that stay in
cache whatever the size of a partition. Hashes are polynomial, taken from prefix sums modulo 2**64 with odd
multipliers: any substring's hash then costs one subtraction and one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
U64 = np.uint64
#: Bytes that end a word: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word made of digits, letters and whatever is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one (a public finaliser of the splitmix family)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 0x1000003)) * U64(0x9E3779B97F4A7C15))


BYTE = stream(7, 256) | U64(1)


class Base:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, dtype=U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


BYTES_BASE, WORDS_BASE = Base(0x5851F42D4C957F2D), Base(0xD1342543DE82EF95)


class Rolling:
    """Hashes of any run of units, from prefix sums."""

    def __init__(self, units: np.ndarray, base: Base):
        up, self.down = base.upto(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, dtype=U64)
        np.cumsum(units * up[:-1], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hash of units i to i + k, for each i."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, dtype=U64)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


class Chunk:
    """Some whole documents: `rows` are their places in the batch; lo and hi their bytes in `data`."""

    def __init__(self, rows: list[int], texts: list[bytes]):
        self.rows = np.array(rows, dtype=np.int64)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.lo = np.cumsum(size + 1) - size - 1
        self.hi = self.lo + size

    def words(self, inside: np.ndarray | None = None, lower: bool = False) -> None:
        """Sets data (lower-cased if asked), start and end of each word, and first and last word of each document."""
        if lower:
            self.data = LOWER[self.data]
        word = ~SPACE[self.data] if inside is None else inside[self.data]
        if inside is not None:
            word[self.hi] = False  # the separator
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.lo)
        self.last = np.searchsorted(self.start, self.hi)

    def word_hashes(self) -> np.ndarray:
        return Rolling(BYTE[self.data], BYTES_BASE).runs(self.start, self.end)

    def owner(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The document (0, 1 ... in this chunk) of each unit `at`, where documents begin at `starts`."""
        return np.searchsorted(starts, at, side="right") - 1


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole documents in order, null as empty; a document over the limit makes a chunk of its own."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > limit:
            yield Chunk(rows, held)
            rows, held, size = [], [], 0
        rows.append(i)
        held.append(t)
        size += len(t) + 1
    if held:
        yield Chunk(rows, held)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint, not touching ones."""
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    cut = np.flatnonzero(start[1:] > end[:-1]) + 1
    return start[np.r_[0, cut]], end[np.r_[cut - 1, len(end) - 1]]


def regions(grams: np.ndarray, width: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splits the runs of `width` grams into stretches whose smallest gram is the same one.

    Gives, for each stretch, the place of that gram and the first and last start of its runs. Equal runs have
    their smallest gram at the same offset, so what repeats anywhere repeats between stretches with equal grams.
    """
    n = len(grams)
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return none, none, none
    low = ((grams >> U64(32)) << U64(32)) | np.arange(n, dtype=U64)
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: n - width + 1], low[width - have :][: n - width + 1])
    whole = np.zeros(n + 2, dtype=np.int32)
    some = hi - lo >= width
    np.add.at(whole, lo[some], 1)
    np.add.at(whole, hi[some] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(whole)[: len(low)] > 0)
    if not len(at):
        return none, none, none
    place = (low[at] & U64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    a, b = np.r_[0, cut], np.r_[cut - 1, len(at) - 1]
    return place[a], at[a], at[b]


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of equal `key` from batches that are sorted by it; several whole groups at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1])
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(cut):
            last = int(cut[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)

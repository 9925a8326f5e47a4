"""Query graphs: edges between labels, a distance bound, and the order in which they are joined."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

FORWARD, BACKWARD = 1, 2


@dataclass(frozen=True)
class Pattern:
    """Each label is one query vertex; types say whether an edge brings in a vertex (FORWARD) or only filters (BACKWARD)."""

    edges: tuple[tuple[int, int], ...]
    delta: int
    types: tuple[int, ...] = ()

    @staticmethod
    def of(edges: Iterable[tuple[int, int]], delta: int) -> Pattern:
        """Distinct label pairs in a derived order."""
        if delta < 0:
            raise ValueError("delta must not be negative")
        order = join_order(list(dict.fromkeys(edges)))
        return Pattern(tuple(e for e, _ in order), delta, tuple(t for _, t in order))

    @staticmethod
    def from_label_pairs(lines: Iterable[str], delta: int, delim: str = ",") -> Pattern:
        """Lines `left, right[, type]`; without types in all lines, the order is derived."""
        rows = [r for r in _rows(lines, delim) if len(r) >= 2]
        if rows and all(len(r) > 2 for r in rows):
            kinds = {(r[0], r[1]): r[2] for r in rows}
            return Pattern(tuple(kinds), delta, tuple(kinds.values()))
        return Pattern.of([(r[0], r[1]) for r in rows], delta)

    @staticmethod
    def from_indexed_edges(lines: Iterable[str], delta: int, delim: str = ",") -> Pattern:
        """Lines `left index, left label, right index, right label`; shorter ones are skipped."""
        return Pattern.of([(r[1], r[3]) for r in _rows(lines, delim) if len(r) >= 4], delta)

    @property
    def labels(self) -> tuple[int, ...]:
        return tuple(sorted({v for e in self.edges for v in e}))

    def incident(self, label: int) -> int:
        """How many edge ends a label has."""
        return sum((i == label) + (j == label) for i, j in self.edges)

    def shared(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int] | None:
        """Which ends (0 or 1) of two edges are the same label; None if none is."""
        return next(((x, y) for x in (0, 1) for y in (0, 1) if a[x] == b[y]), None)

    def neighbours(self, label: int) -> set[int]:
        return {j if i == label else i for i, j in self.edges if label in (i, j)} - {label}


def _rows(lines: Iterable[str], delim: str) -> list[list[int]]:
    out = []
    for line in lines:
        line = line.strip()
        if line.startswith("*"):
            break
        if line and not line.startswith("#"):
            out.append([int(x) for x in line.split(delim) if x.strip()])
    return out


def join_order(edges: list[tuple[int, int]]) -> list[tuple[tuple[int, int], int]]:
    """Edges that reach a new label from one already reached are FORWARD, in depth-first order; others BACKWARD, as soon as both ends are there."""
    left, seen, order = list(edges), set(), []

    def settle() -> None:
        for e in [e for e in left if e[0] in seen and e[1] in seen]:
            left.remove(e)
            order.append((e, BACKWARD))

    def visit(v: int) -> None:
        seen.add(v)
        settle()
        while (e := next((e for e in left if e[0] == v and e[1] not in seen), None)) is not None:
            left.remove(e)
            order.append((e, FORWARD))
            visit(e[1])

    starts = sorted({i for i, _ in edges} - {j for _, j in edges}) or sorted({i for i, _ in edges})[:1]
    while left:
        root = next((s for s in starts if s not in seen), None)
        if root is None or (seen and not any(root in e and (e[0] in seen or e[1] in seen) for e in left)):
            e = next((e for e in left if e[0] in seen or e[1] in seen), None)
            if e is None:
                root = root if root is not None else left[0][0]
            else:
                left.remove(e)
                order.append((e, FORWARD))
                visit(e[1] if e[0] in seen else e[0])
                continue
        visit(root)
    return order

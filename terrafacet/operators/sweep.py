"""What objects share inside one tile, by a sweep over slabs.

A tile is cut into vertical slabs at every vertex, at every crossing of edges and
where an edge meets the tile's lower or upper side. Inside a slab no edges cross,
so a walk upwards over them, with the parity of each part, says where all
objects are. Candidates for crossings are found in the order of the edges' left ends. All
slabs of a tile are walked at once, in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np

#: Heights are multiples of it, some micrometres on the ground: what differs by rounding alone falls together.
GRID = 2.0**-36


def side(edges: np.ndarray, x: np.ndarray | float, y: float) -> np.ndarray:
    """As tiles.side, in the same order of operations."""
    return (edges[..., 2] - edges[..., 0]) * (y - edges[..., 1]) - (edges[..., 3] - edges[..., 1]) * (x - edges[..., 0])


def runs_right(edges: np.ndarray, x: np.ndarray | float, y: float) -> np.ndarray:
    """As tiles.runs_right."""
    at = side(edges, x, y)
    return ((edges[..., 1] > y) != (edges[..., 3] > y)) & (at != 0) & ((at > 0) == (edges[..., 3] > edges[..., 1]))


def meetings(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges (rows x1, y1, x2, y2) whose boxes meet, by a sweep along x."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    order = np.argsort(low[:, 0], kind="stable")
    past = np.searchsorted(low[order, 0], high[order, 0], "right")
    many = past - np.arange(len(order)) - 1
    a = np.repeat(np.arange(len(order)), many)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
    a, b = order[a], order[b]
    meet = (low[a, 1] <= high[b, 1]) & (low[b, 1] <= high[a, 1])
    return a[meet], b[meet]


def crossings(edges: np.ndarray) -> np.ndarray:
    """x of the places where two edges meet in one point."""
    a, b = (edges[k] for k in meetings(edges))
    ax, ay, bx, by = a[:, 2] - a[:, 0], a[:, 3] - a[:, 1], b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    cross = ax * by - ay * bx
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((b[:, 0] - a[:, 0]) * by - (b[:, 1] - a[:, 1]) * bx) / cross
        u = ((b[:, 0] - a[:, 0]) * ay - (b[:, 1] - a[:, 1]) * ax) / cross
    hit = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return a[hit, 0] + t[hit] * ax[hit]


@dataclass
class Trapezoids:
    """From x0 to x1, between low0 and high0 at x0, low1 and high1 at x1."""

    x0: np.ndarray
    x1: np.ndarray
    low0: np.ndarray
    low1: np.ndarray
    high0: np.ndarray
    high1: np.ndarray


def heights(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Height of each edge at its x, an end's own height at the ends: the same number wherever it is asked for."""
    at = edges[:, 1] + (x - edges[:, 0]) * ((edges[:, 3] - edges[:, 1]) / (edges[:, 2] - edges[:, 0]))
    at = np.where(x == edges[:, 0], edges[:, 1], np.where(x == edges[:, 2], edges[:, 3], at))
    return np.clip(at, np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3]))


@dataclass
class Walk:
    """The events of all slabs of a tile, from below: heights at both ends, and of every object how many of its parts hold the place above."""

    left: np.ndarray
    right: np.ndarray
    slab: np.ndarray
    h0: np.ndarray
    h1: np.ndarray
    counts: list[np.ndarray]

    def runs(self, held: np.ndarray) -> Trapezoids:
        """The places above the events that are `held`, of one above another as one. What is flat after rounding is nothing."""
        held = held.copy()
        held[np.flatnonzero(np.diff(self.slab, append=-1))] = False  # above the tile
        before = np.concatenate([[False], held[:-1]])
        begins, ends = np.flatnonzero(held & ~before), np.flatnonzero(~held & before)
        at = self.slab[begins]
        low0, low1, high0, high1 = self.h0[begins], self.h1[begins], self.h0[ends], self.h1[ends]
        thick = (high0 > low0) | (high1 > low1)
        found = (self.left[at], self.right[at], low0, low1, np.maximum(high0, low0), np.maximum(high1, low1))
        return Trapezoids(*(v[thick] for v in found))


def walk(edges: np.ndarray, owner: np.ndarray, part: np.ndarray, corner: tuple[np.ndarray, np.ndarray], owners: int, tile: tuple[float, float, float, float]) -> Walk:
    """All slabs of a tile (x0, y0, x9, y9) with objects 0 to owners - 1.

    `owner` says whose edge it is, `part` numbers the parts of all from 0;
    `corner` gives owner and part of those that hold the tile's lower left corner.
    A part is even-odd. Heights are rounded to GRID.
    """
    x0, y0, x9, y9 = tile
    parts = 1 + max(part.max(initial=-1), corner[1].max(initial=-1))
    owner_of, base = np.full(parts, -1), np.zeros(parts, np.int64)
    owner_of[part], owner_of[corner[1]], base[corner[1]] = owner, corner[0], 1

    inner = edges[(np.minimum(edges[:, 1], edges[:, 3]) <= y9) & (np.maximum(edges[:, 1], edges[:, 3]) >= y0)]
    cuts = [np.array([x0, x9]), inner[:, 0], inner[:, 2], crossings(inner)]
    for y in (y0, y9):
        e = edges[(edges[:, 1] > y) != (edges[:, 3] > y)]
        cuts.append(e[:, 0] + (y - e[:, 1]) * ((e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])))
    x = np.unique(np.concatenate(cuts))
    x = x[(x >= x0) & (x <= x9)]
    left, right = x[:-1], x[1:]
    middle, n = (left + right) / 2, len(left)

    # which parts hold the place just above the tile's lower side, slab by slab
    inside = np.repeat(base[None, :], n, axis=0)
    for k in np.flatnonzero(runs_right(edges, x0, y0)):
        inside[:, part[k]] ^= ~runs_right(edges[k], middle, y0)

    # an event is an edge over a slab inside the tile; the tile's lower side comes first in each slab, its upper side last
    low, high = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    slanted = np.flatnonzero(low < high)
    begin, past = np.searchsorted(left, low[slanted], "left"), np.searchsorted(right, high[slanted], "right")
    many = np.maximum(past - begin, 0)
    edge = np.repeat(slanted, many)
    slab = np.repeat(begin, many) + np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many)
    at = heights(edges[edge], middle[slab])
    keep = (at > y0) & (at < y9)
    edge, slab, at = edge[keep], slab[keep], at[keep]
    sides = [np.concatenate([np.full(n, y0), np.clip(heights(edges[edge], ends[slab]), y0, y9), np.full(n, y9)]) for ends in (left, right)]
    at = np.concatenate([np.full(n, y0), at, np.full(n, y9)])
    edge = np.concatenate([np.full(n, -1), edge, np.full(n, -1)])
    slab = np.concatenate([np.arange(n), slab, np.arange(n)])
    order = np.lexsort((at, slab))
    slab, edge = slab[order], edge[order]
    h0, h1 = (np.round(h[order] / GRID) * GRID for h in sides)
    ground = np.flatnonzero(np.diff(slab, prepend=-1))

    # step: +1 where an edge leads into its part, -1 where it leads out
    step, is_edge = np.zeros(len(slab), np.int64), np.flatnonzero(edge >= 0)
    key = slab[is_edge] * max(parts, 1) + part[edge[is_edge]]
    by_key = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[by_key], prepend=-1))
    rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    mine = is_edge[by_key]
    step[mine] = 1 - 2 * ((inside[slab[mine], part[edge[mine]]] + rank) % 2)

    # of every object, the number of its parts that hold the place above an event
    counts = []
    for who in range(owners):
        total = np.cumsum(np.where((edge >= 0) & (owner_of[part[edge]] == who), step, 0)) if len(part) else np.zeros(len(slab), np.int64)
        start = inside[:, owner_of == who].sum(axis=1) - total[ground]
        counts.append(total + start[slab])
    return Walk(left, right, slab, h0, h1, counts)


def orientation(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact sign of the turn from a over b to c (rows x, y): doubles where their error can't change it, fractions elsewhere."""
    one, two = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]), (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    found = one - two
    for k in np.flatnonzero(np.abs(found) <= 1e-15 * (np.abs(one) + np.abs(two))):
        (ax, ay), (bx, by), (cx, cy) = ([Fraction(float(v)) for v in p[k]] for p in (a, b, c))
        found[k] = float(np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)))
    return np.sign(found)


def contacts(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, along): pairs of edges that have a point in common, decided exactly; `along`: they lie on one line."""
    a, b = meetings(edges)
    ends = [(edges[k, :2], edges[k, 2:]) for k in (a, b)]
    (a1, a2), (b1, b2) = ends
    sides = [orientation(a1, a2, b1), orientation(a1, a2, b2), orientation(b1, b2, a1), orientation(b1, b2, a2)]
    hit = (sides[0] * sides[1] <= 0) & (sides[2] * sides[3] <= 0)
    return a[hit], b[hit], (sides[0] == 0)[hit] & (sides[1] == 0)[hit]

"""Exact nearest neighbour among the points of one task (a small vectorised helper)."""

from __future__ import annotations

import numpy as np

#: Points of a leaf, and numbers that one step of a search holds at once.
LEAF, STEP = 16, 1 << 21
#: Points and queries whose products are held at once.
TILE_POINTS, TILE_QUERIES = 1_024, 256


def box_gap_squared(low_a, high_a, low_b, high_b):
    """Squared gap between axis-parallel boxes (0 where they touch); broadcasts."""
    gap = np.maximum(0.0, np.maximum(low_b - high_a, low_a - high_b))
    return np.einsum("...d,...d->...", gap, gap)


def principal_axes(points: np.ndarray) -> np.ndarray:
    """Orthogonal axes along which the points spread most and least: boxes of a tilted sheet are flat along them."""
    if len(points) < 2:
        return np.eye(points.shape[1])
    return np.linalg.eigh(np.cov(points, rowvar=False).reshape(points.shape[1], -1))[1]


def improve_by_products(points: np.ndarray, queries: np.ndarray, best: np.ndarray, nearest: np.ndarray | None = None) -> None:
    """Lower ``best`` (squared distances of the queries so far) to their nearest of ``points``, whose index goes into ``nearest``.

    Products in single precision bound every pair from below; pairs whose bound is under the best so far are measured. Where
    these are many, as among points closer together than single precision tells, products in double precision decide.
    Copies among the points are all measured.
    """
    held, size = np.einsum("pd,pd->p", points, points), np.einsum("qd,qd->q", queries, queries)

    def factors(kind, points, held, queries, size):
        # More than what rounding may add to a bound, as a share of the squared lengths.
        slack = (points.shape[1] + 8) * float(np.finfo(kind).eps)
        left = np.column_stack([-2 * queries, np.ones(len(queries))]).astype(kind)
        right = np.ascontiguousarray(np.column_stack([points, held * (1 - slack)]).T.astype(kind))
        return left, right, size * (1 - slack)

    def below(bound, near, own):
        limit = np.nextafter((best[near] - own).astype(bound.dtype), bound.dtype.type(np.inf))
        return np.flatnonzero(bound < limit[:, None])

    kind = np.float32 if max(held.max(initial=0.0), size.max(initial=0.0)) < 1e30 else np.float64
    left, right, own = factors(kind, points, held, queries, size)

    def measure(row: np.ndarray, at: np.ndarray) -> None:
        apart = queries[row] - points[at]
        squares = np.einsum("qd,qd->q", apart, apart)
        # The nearest of a query last, so that it is what stays.
        order = np.argsort(-squares, kind="stable")
        order = order[squares[order] < best[row[order]]]
        best[row[order]] = squares[order]
        if nearest is not None:
            nearest[row[order]] = at[order]

    for low in range(0, len(queries), TILE_QUERIES):
        part = slice(low, low + TILE_QUERIES)
        for start in range(0, len(points), TILE_POINTS):
            bound = left[part] @ right[:, start:start + TILE_POINTS]
            first = bound.argmin(axis=1)
            near = np.flatnonzero(bound[np.arange(len(bound)), first] + own[part] < best[part])
            if not len(near):
                continue
            bound, first = (bound[near], first[near]) if len(near) < len(bound) else (bound, first)
            near += low
            measure(near, start + first)
            pair = below(bound, near, own[near])
            if kind == np.float32 and len(pair) > 4 * len(near) + bound.size // 64:
                tile = slice(start, start + bound.shape[1])
                a, b, sharper = factors(np.float64, points[tile], held[tile], queries[near], size[near])
                bound = a @ b
                measure(near, start + bound.argmin(axis=1))
                pair = below(bound, near, sharper)
            measure(near[pair // bound.shape[1]], start + pair % bound.shape[1])


class PointSet:
    """Points in a balanced tree of boxes along their principal axes; all queries walk it together, level by level.

    The turned coordinates only rule boxes out (with a hair to spare); distances come from the points as they are.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n, self.depth = len(points), max(0, int(np.ceil(np.log2(max(1, len(points)) / leaf))))
        self.size = n
        if not n:
            return
        self.axes = principal_axes(points)
        turned, order = points @ self.axes, np.arange(n)
        # Along the axis a node is cut on: the last point of its left child and the first of its right one.
        cut_on, below, above = [], [], []
        for level in range(self.depth):
            edges = np.arange((1 << level) + 1) * n // (1 << level)
            low, high = np.minimum.reduceat(turned, edges[:-1]), np.maximum.reduceat(turned, edges[:-1])
            node = np.repeat(np.arange(1 << level), np.diff(edges))
            widest = np.argmax(high - low, axis=1)
            by = np.lexsort((turned[np.arange(n), widest[node]], node))
            turned, order = turned[by], order[by]
            middle = np.arange(1, 2 << level, 2) * n // (2 << level)
            cut_on.append(widest)
            below.append(turned[middle - 1, widest])
            above.append(turned[middle, widest])
        self.cut_on, self.below, self.above = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (cut_on, below, above))
        edges = np.arange((1 << self.depth) + 1) * n // (1 << self.depth)
        low, high = [np.minimum.reduceat(turned, edges[:-1])], [np.maximum.reduceat(turned, edges[:-1])]
        for _ in range(self.depth):
            low.append(np.minimum(low[-1][::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][::2], high[-1][1::2]))
        self.low, self.high = np.concatenate(low[::-1]), np.concatenate(high[::-1])
        # Leaves are filled up to one size with their last point.
        at = np.minimum(edges[:-1, None] + np.arange(int(np.diff(edges).max())), edges[1:, None] - 1)
        self.leaves = points[order][at]

    @classmethod
    def of_parts(cls, parts: dict) -> "PointSet":
        made = cls.__new__(cls)
        vars(made).update(parts)
        return made

    def nearest(self, queries: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
        """Distance of every query to its nearest point; ``bound`` is an already known distance."""
        best = np.full(len(queries), np.inf) if bound is None else bound.astype(float) ** 2
        if not self.size:
            return np.sqrt(best)
        turned = queries @ self.axes
        # What rounding may add to a squared gap of these coordinates.
        spare = 1e-14 * (np.einsum("qd,qd->q", queries, queries) + float((self.leaves * self.leaves).sum(axis=-1).max()))
        for start in range(0, len(queries), 8192):
            self._search(queries, turned, spare, best, np.arange(start, min(start + 8192, len(queries))))
        return np.sqrt(best)

    def _gaps(self, turned: np.ndarray, node: np.ndarray) -> np.ndarray:
        return box_gap_squared(turned, turned, self.low[node], self.high[node])

    def _improve(self, queries: np.ndarray, best: np.ndarray, rows: np.ndarray, leaf: np.ndarray) -> None:
        step = max(1, STEP // (self.leaves.shape[1] * self.leaves.shape[2]))
        for a in range(0, len(rows), step):
            row = rows[a:a + step]
            apart = self.leaves[leaf[a:a + step]] - queries[row][:, None, :]
            np.minimum.at(best, row, np.einsum("qpd,qpd->qp", apart, apart).min(axis=1))

    def _search(self, queries: np.ndarray, turned: np.ndarray, spare: np.ndarray, best: np.ndarray, rows: np.ndarray) -> None:
        first, own, at = (1 << self.depth) - 1, turned[rows], np.arange(len(rows))
        node, off = np.zeros(len(rows), dtype=np.int64), np.empty((self.depth, len(rows)))
        for level in range(self.depth):  # the leaf one gets to by taking the nearer side of each cut
            value = own[at, self.cut_on[node]]
            left, right = self.above[node] - value, value - self.below[node]
            off[level] = np.maximum(0.0, np.maximum(left, right))
            node = 2 * node + 1 + (right > left)
        self._improve(queries, best, rows, node - first)
        # Beside the way down: what lies beyond a cut that is nearer than the nearest point so far.
        level, at = np.nonzero(off * off <= best[rows] + spare[rows])
        beside = (((node[at] + 1) >> (self.depth - 1 - level)) ^ 1) - 1
        self._walk(queries, turned, spare, best, rows[at], beside)

    def _walk(self, queries, turned, spare, best, rows, node) -> None:
        """Down from the boxes ``node`` to the leaves that may hold a nearer point; the nearest of them first, then twice as many each time."""
        first = (1 << self.depth) - 1
        gap = self._gaps(turned[rows], node)
        near = gap <= best[rows] + spare[rows]
        rows, node, gap = rows[near], node[near], gap[near]
        while (inner := node < first).any():
            if len(rows) > STEP // 8 and rows.min() < rows.max():
                # Too many boxes at once: one half of the queries after the other.
                half = rows <= np.median(rows)
                half = half if not half.all() else rows < rows.max()
                for part in (half, ~half):
                    self._walk(queries, turned, spare, best, rows[part], node[part])
                return
            down = np.concatenate([2 * node[inner] + 1, 2 * node[inner] + 2])
            of = np.concatenate([rows[inner], rows[inner]])
            apart = self._gaps(turned[of], down)
            near = apart <= best[of] + spare[of]
            rows, node, gap = (np.concatenate([x[~inner], y[near]]) for x, y in ((rows, of), (node, down), (gap, apart)))
        order = np.lexsort((gap, rows))
        rows, node, gap = rows[order], node[order], gap[order]
        taken = 1
        while len(rows):
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
            now = place < taken
            self._improve(queries, best, rows[now], node[now] - ((1 << self.depth) - 1))
            left = ~now & (gap <= best[rows] + spare[rows])
            rows, node, gap, taken = rows[left], node[left], gap[left], 2 * taken


class SplitTree:
    """Balanced splits of a sample along its principal axes: points go to cells, and cells near a point are found."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        inner = (1 << depth) - 1
        self.axis = np.zeros(inner, dtype=np.int32)
        self.cut = np.full(inner, np.inf)
        self.turn = principal_axes(sample)
        members = {0: sample @ self.turn}
        for node in range(inner):
            points = members.pop(node)
            if len(points):
                axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
                values = points[:, axis]
                cut = float(np.median(values))
                if cut == values.min():  # ties: cut above them, so that both sides hold points
                    above = values[values > cut]
                    cut = float(above.min()) if len(above) else -np.inf
                self.axis[node], self.cut[node] = axis, cut
                left = values < cut
            else:
                left = np.zeros(0, dtype=bool)
            members[2 * node + 1], members[2 * node + 2] = points[left], points[~left]

    def cell(self, points: np.ndarray) -> np.ndarray:
        points = points @ self.turn
        node = np.zeros(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            right = points[rows, self.axis[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def boxes(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes of all nodes from those of the cells, along ``turn`` (an empty cell has low = inf, high = -inf)."""
        inner = (1 << self.depth) - 1
        all_low = np.vstack([np.full((inner, low.shape[1]), np.inf), low])
        all_high = np.vstack([np.full((inner, high.shape[1]), -np.inf), high])
        for node in range(inner - 1, -1, -1):
            all_low[node] = np.minimum(all_low[2 * node + 1], all_low[2 * node + 2])
            all_high[node] = np.maximum(all_high[2 * node + 1], all_high[2 * node + 2])
        return all_low, all_high

    def _limit(self, turned: np.ndarray, reach: np.ndarray, boxes) -> np.ndarray:
        """Squared reach; turned coordinates are rounded, so a hair more."""
        held = boxes[0][0], boxes[1][0]
        size = np.einsum("qd,qd->q", turned, turned) + float(np.square(held).sum() if np.isfinite(held).all() else 0.0)
        return reach * reach * (1 + 1e-12) + 1e-14 * size

    def alone(self, points: np.ndarray, reach: np.ndarray, boxes) -> np.ndarray:
        """Whether ``reach`` ends before every cut on the way to a point's cell, so that no other cell is within it."""
        points = points @ self.turn
        limit = self._limit(points, reach, boxes)
        node, rows, nearest = np.zeros(len(points), dtype=np.int64), np.arange(len(points)), np.full(len(points), np.inf)
        for _ in range(self.depth):
            value, cut = points[rows, self.axis[node]], self.cut[node]
            np.minimum(nearest, np.abs(value - cut), out=nearest)
            node = 2 * node + 1 + (value >= cut)
        return nearest * nearest >= limit

    def cells_within(self, points: np.ndarray, reach: np.ndarray, boxes) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, cell) whose box is nearer than ``reach``, found level by level."""
        low, high = boxes
        row, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        points = points @ self.turn
        limit = self._limit(points, reach, boxes)
        for _ in range(self.depth):
            row, node = np.concatenate([row, row]), np.concatenate([2 * node + 1, 2 * node + 2])
            near = box_gap_squared(points[row], points[row], low[node], high[node]) < limit[row]
            row, node = row[near], node[near]
        return row, node - ((1 << self.depth) - 1)

"""Strategies and partitions computed on the driver, over domains of a declared size."""

from __future__ import annotations

import math

import numpy as np

from tallyveil.operators.workload import Dense, Matrix, Product, Ranges, Scaled, Sparse, Union, split


def quad_tree(shape: tuple[int, int]) -> Ranges:
    """Boxes of a midpoint quad tree, root first. Of an odd width, the lower half splits one column later."""
    low, high, open_ = [], [], [((0, 0), (shape[0] - 1, shape[1] - 1))]
    while open_:
        (r0, c0), (r1, c1) = open_.pop(0)
        low.append((r0, c0))
        high.append((r1, c1))
        rows, cols = r1 - r0 + 1, c1 - c0 + 1
        if rows * cols == 1:
            continue
        tops = [(r0, r1)] if rows == 1 else [(r0, r0 + rows // 2 - 1), (r0 + rows // 2, r1)]
        for k, (a, b) in enumerate(tops):
            mid = c0 + cols // 2 + (k if cols % 2 and cols > 1 else 0)
            for c, d in [(c0, c1)] if cols == 1 else [(c0, mid - 1), (mid, c1)]:
                open_.append(((a, c), (b, d)))
    return Ranges(shape, low, high)


# Grids


def boxes(shape: tuple[int, int], side: int, origin: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """The corners of a grid's cells of the given side, those at the far edges clipped."""
    at = np.stack(np.meshgrid(*[np.arange(0, n, side) for n in shape], indexing="ij"), -1).reshape(-1, 2)
    return at + origin, np.minimum(at + side, shape) - 1 + np.array(origin)


def side_for(shape: tuple[int, int], per_side: float) -> int:
    """The side of cells of which about per_side lie along each attribute of a square of the same area."""
    return max(1, math.floor(math.sqrt(shape[0] * shape[1]) / per_side))


def grid_side(shape: tuple[int, int], total: float, eps: float, c: float = 10.0, adaptive: bool = False) -> int:
    """For a public total N: sqrt(N eps / c) cells a side; the first level of an adaptive grid has a quarter, ten at least."""
    per_side = math.sqrt(max(1e-9, total * eps / c))
    return side_for(shape, max(10, math.floor(per_side / 4)) if adaptive else per_side)


def uniform_grid(shape: tuple[int, int], total: float, eps: float, c: float = 10.0, adaptive: bool = False, side: int | None = None) -> Ranges:
    return Ranges(shape, *boxes(shape, side or grid_side(shape, total, eps, c, adaptive)))


def adaptive_cells(first: Ranges, counts: np.ndarray, eps: float, c: float = 5.0) -> Ranges:
    """Each first-level cell split by its noisy count n into sqrt(n eps / c) cells a side, one at least."""
    low, high = [], []
    for a, b, n in zip(first.low, first.high, counts, strict=True):
        own = tuple(int(k) for k in b - a + 1)
        corners = boxes(own, side_for(own, max(1, math.floor(math.sqrt(max(0.0, n * eps / c))))), tuple(a))
        low.append(corners[0])
        high.append(corners[1])
    return Ranges(first.shape, np.concatenate(low), np.concatenate(high))


# A tree weighted for a workload


def root_weight(error: float, gain: float, spread: float) -> tuple[float, float]:
    """(t, error): the share t of the sensitivity that a node's children get, its own query the rest, and the error then.

    The children's strategy K, scaled to sensitivity 1, has error E = tr(W K^-1 W'), and v = K^-1 1 gives gain m = |W v|^2
    and spread k = 1'v. By the rank-one update of the inverse, with u = (1 - t) / t, the error is
    (1 + u)^2 (E + (E k - m) u^2) / (1 + k u^2). Its derivative vanishes where
    (E k - m) k u^4 + 2 (E k - m) u^2 - m u + E = 0, so the best u is 0 or a positive root.
    """
    rest = max(0.0, error * spread - gain)
    roots = np.roots([rest * spread, 0, 2 * rest, -gain, error])
    value = lambda u: (1 + u) ** 2 * (error + rest * u * u) / (1 + spread * u * u)
    u = min([0.0, *(float(r.real) for r in roots if abs(r.imag) < 1e-9 * (1 + abs(r)) and r.real > 0)], key=value)
    return 1 / (1 + u), value(u)


def greedy_tree(workload: Matrix, branching: int = 2) -> Matrix:
    """A tree of intervals with the weights that serve a workload best, chosen from the leaves up; sensitivity 1.

    Adjacent cells that the workload treats alike are one leaf. Level by level, nodes are (first leaf, leaves); upwards,
    each keeps its error and v = K^-1 1 over its leaves (see root_weight); downwards, each node's share is multiplied out.
    """
    g = workload.gram()
    first = np.flatnonzero(np.concatenate(([True], (g[:, 1:] != g[:, :-1]).any(0))))
    ends, g = np.append(first[1:], workload.n), g[np.ix_(first, first)]
    levels = [[(0, len(first))]]
    children: list[list[range]] = []
    while any(size > 1 for _, size in levels[-1]):
        below, own = [], []
        for at, size in levels[-1]:
            starts = split(size, branching) if size > 1 else np.zeros(0, int)
            own.append(range(len(below), len(below) + len(starts)))
            below += [(at + int(a), int(n)) for a, n in zip(starts, np.diff(starts, append=size), strict=True)]
        levels.append(below)
        children.append(own)
    children.append([range(0)] * len(levels[-1]))
    v, share, error = np.ones(len(first)), [], []
    for nodes, kids in zip(reversed(levels), reversed(children), strict=True):
        own_share, own_error = [], []
        for (at, size), k in zip(nodes, kids, strict=True):
            if not k:
                own_share.append(0.0)
                own_error.append(float(g[at, at]))
                continue
            here = slice(at, at + size)
            spread = float(v[here].sum())
            t, e = root_weight(sum(error[0][j] for j in k), float(v[here] @ g[here, here] @ v[here]), spread)
            v[here] /= t * t + (1 - t) ** 2 * spread
            own_share.append(t)
            own_error.append(e)
        share.insert(0, own_share)
        error.insert(0, own_error)
    low, high, weight, passed = [], [], [], [1.0]
    for nodes, kids, t in zip(levels, children, share, strict=True):
        below = []
        for (at, size), k, own, given in zip(nodes, kids, t, passed, strict=True):
            if given * (1 - own) > 0:
                low.append(first[at])
                high.append(ends[at + size - 1] - 1)
                weight.append(given * (1 - own))
            below += [given * own] * len(k)
        passed = below
    return Product(Scaled(np.array(weight)), Ranges((workload.n,), np.array(low), np.array(high)))


def with_intervals(query: Matrix, width: int) -> Matrix:
    """A query, and sums of `width` cells each, in order, of the cells that it leaves out; the last may be shorter."""
    rows = complement(query, width)
    return Union([(query, 1.0), (rows, 1.0)]) if rows.m else query


def complement(query: Matrix, width: int | None = None) -> Sparse:
    """Sums of the cells that no query touches, `width` in each, or all in one."""
    free = np.flatnonzero(query.absolute().transposed(np.ones(query.m)) == 0)
    group = np.arange(len(free)) // (width or max(1, len(free)))
    return Sparse(int(group[-1]) + 1 if len(free) else 0, query.n, group, free, np.ones(len(free)))


def first_query(a: Matrix) -> Dense:
    """The first row with an entry that is not 0."""
    touched = np.flatnonzero(a.absolute().times(np.ones(a.n)) > 0)
    if not len(touched):
        raise ValueError("every query is empty")
    return a.row(int(touched[0]))


# Partitions that depend on (noisy) data


def cluster_sorted(counts: np.ndarray, eps: float) -> np.ndarray:
    """Part of each cell by greedy clustering of the sorted noisy counts: a cluster closes where adding the next count
    costs at least as much as the best cluster that could start there."""
    order = np.argsort(counts, kind="stable")
    x, n, t = counts[order].astype(float), len(counts), 2 / eps**2
    s, ss = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(x * x)))

    def cost(i: int, j: int) -> float:
        k = j - i
        return float(ss[j] - ss[i] - (s[j] - s[i]) ** 2 / k + t / k)

    def best_from(j: int) -> float:
        best = math.inf
        for end in range(j + 1, n + 1):
            k = end - j
            gap = (x[j] - (s[end] - s[j]) / k) ** 2
            best = min(best, gap + t / k**2)
            if gap >= best:
                break
        return best

    part, first, k, last = np.zeros(n, np.int64), 0, 0, cost(0, 1) if n else 0.0
    for j in range(1, n):
        now = cost(first, j + 1)
        if now >= last + best_from(j):
            first, k, now = j, k + 1, cost(j, j + 1)
        part[order[j]] = k
        last = now
    return part


def cluster_runs(counts: np.ndarray, size: int = 4) -> np.ndarray:
    """Part of each cell: runs of `size` in the order of the counts."""
    part = np.empty(len(counts), np.int64)
    part[np.argsort(counts, kind="stable")] = np.arange(len(counts)) // size
    return part


def interval_partition(counts: np.ndarray, eps: float, ratio: float = 0.25, seed: int | None = None, doubling: bool = True) -> np.ndarray:
    """Part of each cell: the cheapest cover by intervals of power-of-two lengths (or all lengths), each charged its noisy
    deviation from its mean and the noise that measuring it will cost."""
    n, first, second = len(counts), eps * ratio, eps * (1 - ratio)
    rng, x = np.random.default_rng(seed), counts.astype(float)
    lengths = [1 << k for k in range(n.bit_length()) if 1 << k <= n] if doubling else list(range(1, n + 1))
    best, back = np.full(n + 1, math.inf), np.zeros(n + 1, np.int64)
    best[0] = 0
    for end in range(1, n + 1):
        for k in lengths:
            if k > end:
                break
            b = x[end - k : end]
            noise = 0.0 if k == 1 else rng.laplace(0, (2 - 1 / k - 1 / n) / first)
            c = best[end - k] + max(1 / second, np.abs(b - b.mean()).sum() + 1 / second + noise)
            if c < best[end] or doubling and c == best[end]:
                best[end], back[end] = c, k
    ends, at = [], n
    while at:
        ends.append(at)
        at -= back[at]
    part = np.zeros(n, np.int64)
    for number, end in enumerate(reversed(ends)):
        part[end - back[end] : end] = number
    return part


def noisy_means(counts: np.ndarray, part: np.ndarray, eps: float, seed: int | None = None) -> np.ndarray:
    """Each cell's share of its part's noisy sum."""
    sums = np.bincount(part, counts) + np.random.default_rng(seed).laplace(0, 1 / eps, int(part.max()) + 1)
    return (sums / np.bincount(part))[part]


def same_columns(a: np.ndarray) -> np.ndarray:
    """Part of each cell: cells that every query treats alike, numbered by first appearance; exact."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(c.tobytes(), len(seen)) for c in np.ascontiguousarray(a.T)])

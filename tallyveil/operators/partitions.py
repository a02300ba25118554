"""Partitions as arrays (the part of each cell), for domains of a declared size, and the matrices that belong to them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from tallyveil.operators.strategy import boxes, grid_side
from tallyveil.operators.workload import Ranges, Sparse


def canonical(part: Sequence[int] | np.ndarray) -> np.ndarray:
    """Parts renumbered by first appearance."""
    _, first, own = np.unique(np.asarray(part), return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[own]


def numbered(part: Sequence[int] | np.ndarray) -> np.ndarray:
    """Parts renumbered in the order of their ids."""
    return np.unique(np.asarray(part), return_inverse=True)[1].reshape(-1)


def statistics(part: Sequence[int] | np.ndarray) -> dict[str, np.ndarray]:
    """The ids, with each one's first cell and size."""
    ids, first, size = np.unique(np.asarray(part), return_index=True, return_counts=True)
    return {"id": ids, "first": first, "size": size}


def reduction(part: np.ndarray) -> Sparse:
    """Sums each part's cells."""
    own = numbered(part)
    return Sparse(int(own.max()) + 1, len(own), own, np.arange(len(own)), np.ones(len(own)))


def expansion(part: np.ndarray) -> Sparse:
    """Spreads each part's value evenly over its cells; reduction @ expansion is the identity."""
    own = numbered(part)
    return Sparse(len(own), int(own.max()) + 1, np.arange(len(own)), own, 1.0 / np.bincount(own)[own])


def projection(part: np.ndarray, which: int) -> Sparse:
    """Selects the cells of one part, in order."""
    cells = np.flatnonzero(np.asarray(part) == which)
    return Sparse(len(cells), len(part), np.arange(len(cells)), cells, np.ones(len(cells)))


def mixed_radix(digits: Sequence[np.ndarray], sizes: Sequence[int]) -> np.ndarray:
    """One number for each tuple of digits below the sizes: the pairing of part ids."""
    out = np.zeros_like(np.asarray(digits[0], np.int64))
    for d, n in zip(digits, sizes, strict=True):
        out = out * n + d
    return out


def combine(*parts: np.ndarray) -> np.ndarray:
    """The product partition of the partitions of several attributes, over their flattened product domain."""
    own = [numbered(p) for p in parts]
    grids = np.meshgrid(*own, indexing="ij")
    return mixed_radix([g.reshape(-1) for g in grids], [int(p.max()) + 1 for p in own])


def of_clusters(clusters: Sequence[tuple[int, int]], rank: Sequence[int] | None = None) -> np.ndarray:
    """The part of each cell from half-open runs of places; rank gives the place of each cell, else cells are in place."""
    n = max(end for _, end in clusters)
    at = np.empty(n, np.int64)
    for k, (a, b) in enumerate(clusters):
        at[a:b] = k
    return at if rank is None else at[np.asarray(rank)]


def box_shapes(part: np.ndarray, shape: tuple[int, int]) -> dict[int, tuple[int, int]] | None:
    """The sides of each part, if all of them are rectangles; else None."""
    grid, out = np.asarray(part).reshape(shape), {}
    for k in np.unique(grid):
        i, j = np.nonzero(grid == k)
        out[int(k)] = (int(i.max() - i.min()) + 1, int(j.max() - j.min()) + 1)
        if math.prod(out[int(k)]) != len(i):
            return None
    return out


def blocks(shape: tuple[int, ...], block: tuple[int, ...]) -> np.ndarray:
    """A regular grid; the block must divide the domain."""
    if any(n % b for n, b in zip(shape, block, strict=True)):
        raise ValueError("the block must divide the domain")
    return combine(*[np.arange(n) // b for n, b in zip(shape, block, strict=True)])


def striped(shape: tuple[int, ...], dim: int) -> np.ndarray:
    """Cells that share all coordinates but one are a part."""
    return combine(*[np.zeros(n, int) if i == dim else np.arange(n) for i, n in enumerate(shape)])


def of_marginal(shape: tuple[int, ...], dim: int) -> np.ndarray:
    """Cells that share one coordinate are a part."""
    return combine(*[np.arange(n) if i == dim else np.zeros(n, int) for i, n in enumerate(shape)])


def of_boxes(ranges: Ranges) -> np.ndarray:
    """The part of each cell where boxes cover the domain without overlap."""
    cover = ranges.transposed(np.ones(ranges.m))
    if not (cover == 1).all():
        raise ValueError("the boxes must cover each cell once")
    return np.rint(ranges.transposed(np.arange(ranges.m, dtype=float))).astype(np.int64)


def uniform_grid(shape: tuple[int, int], total: float, eps: float, c: float = 10.0, adaptive: bool = False) -> np.ndarray:
    """The cells of the uniform grid as a partition."""
    return of_boxes(Ranges(shape, *boxes(shape, grid_side(shape, total, eps, c, adaptive))))

"""Published algorithms as compositions of operators: select a strategy, measure it, infer the vector.

Each takes a protected vector and its share of the budget and returns an estimate of the vector. Strategies are applied and
inverted by products, so that a domain's size, and not its square, bounds the driver's work.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from tallyveil.operators import bayes, inference, partitions, strategy
from tallyveil.operators.workload import Haar, Identity, Kronecker, Matrix, Product, Total, Union, block_diagonal, hb_tree, k_way_marginals
from tallyveil.operators.workload import Hierarchy as Tree
from tallyveil.plans.kernel import Protected, exact


def measured_by(x: Protected, m: Matrix, eps) -> np.ndarray:
    """One strategy, least squares."""
    return inference.least_squares([(m, x.laplace(m, eps), 1.0)])


def identity(x: Protected, eps, workload: Matrix | None = None) -> np.ndarray:
    """workload: cells that it treats alike are measured as one."""
    if workload is None:
        return x.laplace(Identity(x.n), eps)
    part = strategy.same_columns(workload.numpy())
    return partitions.expansion(part).times(x.reduce_by_partition(part).laplace(Identity(int(part.max()) + 1), eps))


def uniform(x: Protected, eps) -> np.ndarray:
    return np.full(x.n, x.laplace(Total(x.n), eps)[0] / x.n)


def noisy_total(x: Protected, eps) -> float:
    """The number of rows for the plans that need one; at least 1, as sizes and weights divide by it."""
    return max(1.0, float(x.laplace(Total(x.n), eps)[0]))


def privelet(x: Protected, eps, shape: tuple[int, ...] | None = None) -> np.ndarray:
    """A wavelet along each attribute; every size is a power of two."""
    return measured_by(x, Kronecker([Haar(n) for n in shape or (x.n,)]), eps)


def h2(x: Protected, eps, shape: tuple[int, ...] | None = None) -> np.ndarray:
    return measured_by(x, Tree(shape or (x.n,), 2), eps)


def hb(x: Protected, eps, shape: tuple[int, ...] | None = None) -> np.ndarray:
    return measured_by(x, hb_tree(shape or (x.n,)), eps)


def greedy_h(x: Protected, workload: Matrix, eps) -> np.ndarray:
    return measured_by(x, strategy.greedy_tree(workload), eps)


def quad_tree(x: Protected, shape: tuple[int, int], eps) -> np.ndarray:
    return measured_by(x, strategy.quad_tree(shape), eps)


def uniform_grid(x: Protected, shape: tuple[int, int], total: float, eps) -> np.ndarray:
    return measured_by(x, strategy.uniform_grid(shape, total, float(eps)), eps)


def adaptive_grid(x: Protected, shape: tuple[int, int], total: float, eps, alpha: str = "0.5") -> np.ndarray:
    """Two levels of cells; both are measured by one matrix each, not cell by cell."""
    first_eps = exact(eps) * exact(alpha)
    rest = exact(eps) - first_eps
    first = strategy.uniform_grid(shape, total, float(first_eps), adaptive=True)
    y1 = x.laplace(first, first_eps)
    second = strategy.adaptive_cells(first, y1, float(rest))
    y2 = x.laplace(second, rest)
    return inference.least_squares([(first, y1, 1 / float(first_eps)), (second, y2, 1 / float(rest))])


def marginals(x: Protected, shape: tuple[int, ...], eps) -> np.ndarray:
    """All one-way marginals."""
    return measured_by(x, k_way_marginals(shape, 1), eps)


def marginals_smart(x: Protected, shape: tuple[int, ...], workload: Matrix, eps, small: int = 50, ratio: str = "0.25", seed: int | None = None) -> np.ndarray:
    """Each attribute's marginal for an equal share: cell by cell where it is small, else by a data-aware partition."""
    each, measured = exact(eps) / len(shape), []
    for i, n in enumerate(shape):
        part = partitions.of_marginal(shape, i)
        own, lift = x.reduce_by_partition(part), partitions.reduction(part)
        if n < small:
            measured.append((lift, own.laplace(Identity(n), each), inference_scale(Identity(n), each)))
        else:
            m, y, scale = _dawa(own, Product(workload, partitions.expansion(part)), each, ratio, seed)
            measured.append((Product(m, lift), y, scale))
    return inference.least_squares(measured)


def inference_scale(m: Matrix, eps) -> float:
    """The standard deviation of a strategy's noise."""
    return math.sqrt(2) * m.sensitivity() / float(eps)


def striped_hb(x: Protected, shape: tuple[int, ...], dim: int, eps) -> np.ndarray:
    """A tree along one attribute for every combination of the others: one measurement, for stripes are disjoint."""
    return measured_by(x, Kronecker([hb_tree((n,)) if i == dim else Identity(n) for i, n in enumerate(shape)]), eps)


def striped_hb_apart(x: Protected, shape: tuple[int, ...], dim: int, eps) -> np.ndarray:
    """The same, stripe by stripe: each stripe is a protected vector of its own, charged in parallel."""
    part, measured = partitions.striped(shape, dim), []
    for k, stripe in enumerate(x.split_by_partition(part)):
        m = hb_tree((stripe.n,))
        measured.append((Product(m, partitions.projection(part, k)), stripe.laplace(m, eps), inference_scale(m, eps)))
    return inference.least_squares(measured)


def ahp(x: Protected, eps, ratio: str = "0.35", eta: float = 0.35, clusters=None) -> np.ndarray:
    """Noisy counts, small ones cut, clustered; clusters measured anew and spread evenly. clusters: another clustering."""
    first = exact(eps) * exact(ratio)
    noisy = x.laplace(Identity(x.n), first)
    cut = eta * np.log(x.n) / float(first)
    part = (clusters or (lambda v: strategy.cluster_sorted(v, float(first))))(np.where(noisy <= cut, 0, noisy))
    sums = x.reduce_by_partition(part).laplace(Identity(int(part.max()) + 1), exact(eps) - first)
    return partitions.expansion(part).times(sums)


#: Parameters (ratio, eta) of adaptive clustering by the product of rows and budget, between which they are interpolated.
AHP_BY_SIGNAL = ((1e2, 0.85, 0.35), (1e4, 0.7, 0.35), (1e6, 0.5, 0.35))


def ahp_adaptive(x: Protected, total: float, eps, table=AHP_BY_SIGNAL) -> np.ndarray:
    at = np.log([t[0] for t in table])
    signal = math.log(max(1e-9, total * float(eps)))
    ratio, eta = (float(np.interp(signal, at, [t[k] for t in table])) for k in (1, 2))
    return ahp(x, eps, f"{ratio:.6f}", eta)


def _dawa(x: Protected, workload: Matrix, eps, ratio: str, seed: int | None) -> tuple[Matrix, np.ndarray, float]:
    """A data-aware partition for a share of the budget, a greedy tree over its parts for the rest: the queries over the
    vector's own cells, their answers and noise. The partition is charged what it spends, ratio * eps."""
    first = exact(eps) * exact(ratio)
    part = x.mapping(first, lambda v: strategy.interval_partition(v, float(eps), float(exact(ratio)), seed))
    tree = strategy.greedy_tree(Product(workload, partitions.expansion(part)))
    y = x.reduce_by_partition(part).laplace(tree, exact(eps) - first)
    return Product(tree, partitions.reduction(part)), y, inference_scale(tree, exact(eps) - first)


def dawa(x: Protected, workload: Matrix, eps, ratio: str = "0.25", seed: int | None = None) -> np.ndarray:
    return inference.least_squares([_dawa(x, workload, eps, ratio, seed)])


def hilbert_order(side: int) -> np.ndarray:
    """The place of each cell of a square grid, row by row, on the Hilbert curve; side: a power of two.

    The curve of twice the side is four curves of the side before: the first turned over its diagonal, two as they are, the
    last turned over the other diagonal.
    """
    place = np.zeros((1, 1), np.int64)
    while len(place) < side:
        n = place.size
        place = np.block([[place.T, place + n], [np.flip(place.T) + 3 * n, place + 2 * n]])
    return place.reshape(-1)


def dawa_2d(x: Protected, shape: tuple[int, int], workload: Matrix, eps, ratio: str = "0.25", seed: int | None = None) -> np.ndarray:
    """DAWA along the Hilbert curve of the smallest square of a power of two that holds the domain, its other cells left out."""
    side = 1 << (max(shape) - 1).bit_length()
    place = hilbert_order(side).reshape(side, side)[: shape[0], : shape[1]].reshape(-1)
    order = np.argsort(place)
    curve = x.group(order.tolist())
    unroll = partitions.Sparse(x.n, x.n, order, np.arange(x.n), np.ones(x.n))
    return unroll.times(dawa(curve, Product(workload, unroll), eps, ratio, seed))


def dawa_striped(x: Protected, shape: tuple[int, ...], dim: int, workload: Matrix, eps, ratio: str = "0.25", seed: int | None = None) -> np.ndarray:
    """DAWA along one attribute for every combination of the others.

    Stripes are disjoint, so their partitions are one partition, found in one pass, and their trees one measurement of a
    block-diagonal strategy, whose sensitivity is a stripe's.
    """
    first = exact(eps) * exact(ratio)
    stripe = partitions.striped(shape, dim)
    cells = [np.flatnonzero(stripe == k) for k in range(int(stripe.max()) + 1)]

    def find(v: np.ndarray) -> np.ndarray:
        part, done = np.empty(len(v), np.int64), 0
        for k, own in enumerate(cells):
            p = strategy.interval_partition(v[own], float(eps), float(exact(ratio)), None if seed is None else seed + k)
            part[own] = p + done
            done += int(p.max()) + 1
        return part

    part = x.mapping(first, find)
    spread = Product(workload, partitions.expansion(part)).numpy()
    groups = [np.unique(part[own]) for own in cells]
    trees = block_diagonal([strategy.greedy_tree(strategy.Dense(spread[:, g])) for g in groups])
    y = x.reduce_by_partition(part).laplace(trees, exact(eps) - first)
    return inference.least_squares([(Product(trees, partitions.reduction(part)), y, 1.0)])


def dawa_striped_product(x: Protected, shape: tuple[int, ...], dim: int, factors: list[list[Matrix]], eps, ratio: str = "0.25", seed: int | None = None) -> np.ndarray:
    """The same for a union of Kronecker products: along a stripe, each acts as its own factor of the stripe's attribute, so
    one small workload serves all stripes and the large one is never multiplied out."""
    own = Union([(f[dim], math.sqrt(math.prod(float(np.linalg.norm(g.numpy()) ** 2) / g.n for i, g in enumerate(f) if i != dim))) for f in factors])
    n_stripes = math.prod(shape) // shape[dim]
    part = partitions.striped(shape, dim)
    order = np.argsort(part, kind="stable")
    lift = partitions.Sparse(x.n, x.n, np.arange(x.n), order, np.ones(x.n))
    first = exact(eps) * exact(ratio)
    found: list[np.ndarray] = []

    def find(v: np.ndarray) -> np.ndarray:
        out, done = np.empty(len(v), np.int64), 0
        for k, stripe in enumerate(lift.times(v).reshape(n_stripes, -1)):
            p = strategy.interval_partition(stripe, float(eps), float(exact(ratio)), None if seed is None else seed + k)
            found.append(p)
            out[order[k * shape[dim] : (k + 1) * shape[dim]]] = p + done
            done += int(p.max()) + 1
        return out

    part = x.mapping(first, find)
    trees = block_diagonal([strategy.greedy_tree(Product(own, partitions.expansion(p))) for p in found])
    y = x.reduce_by_partition(part).laplace(trees, exact(eps) - first)
    return inference.least_squares([(Product(trees, partitions.reduction(part)), y, 1.0)])


def mwem(x: Protected, workload: Matrix, total: float, eps, rounds: int = 10, ratio: str = "0.5", history: bool = True, least: bool = False, intervals: bool = False, mechanism: str = "exponential") -> np.ndarray:
    """Measures the worst-answered query each round. least: nonnegative least squares with the total instead of weights;
    intervals: with it, sums of 2, 4, 8.. of the cells that the query leaves out, for no further budget."""
    each = exact(eps) / rounds
    pick, ask = each * exact(ratio), each * (1 - exact(ratio))
    estimate, seen, chosen = np.full(x.n, total / x.n), [], []
    for k in range(rounds):
        q = x.worst_approximated(workload, estimate, chosen, pick, mechanism)
        chosen.append(q)
        m: Matrix = workload.row(q)
        if intervals:
            m = strategy.with_intervals(m, min(2 << k, x.n))
        seen.append((m, x.laplace(m, ask), inference_scale(m, ask)))
        if least:
            known = (Total(x.n), np.array([total]), 1e-3 * seen[0][2])
            estimate = inference.nonnegative([*seen, known], 500, l1=1e-6, l2=1e-6, start=estimate)
        else:
            estimate = inference.multiplicative_weights(seen if history else seen[-1:], total, start=estimate)
    return estimate


def bayes_least_squares(relation: Protected, eps, theta: float = 4.0) -> np.ndarray:
    """A private Bayesian network for half of the budget names the marginals, which are measured for the rest."""
    half = exact(eps) / 2
    shape = relation.shape
    network = relation.selected(half, lambda r, seed: bayes.network(r, float(half), theta, seed))
    return measured_by(relation.vectorize(), bayes.measurements(network, shape), half)


def budget_of(eps: float, rounds: int) -> Fraction:
    return exact(eps) / rounds

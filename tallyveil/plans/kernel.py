"""The privacy kernel: a tree of protected views whose budget is charged before data are read.

Budgets are exact fractions, so equal splits never overshoot. Children of a split compose in parallel: they are charged the
largest of their budgets, not the sum.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.operators import measure, vectors
from tallyveil.operators.workload import Matrix, frame
from tallyveil.sources.relation import Relation, _size


class BudgetExceeded(RuntimeError):
    pass


def exact(eps: float | str | Fraction) -> Fraction:
    return eps if isinstance(eps, Fraction) else Fraction(str(eps))


@dataclass
class Node:
    parent: Node | None
    stability: int | Fraction = 1
    split: bool = False
    budget: Fraction | None = None
    spent: Fraction = field(default_factory=Fraction)

    def request(self, eps: Fraction, child: Node | None = None) -> None:
        """Charges this node and its ancestors, or raises and charges nothing."""
        if self.split and child is not None:
            eps = max(Fraction(0), child.spent + eps - self.spent)
        if self.parent is None:
            if self.spent + eps > self.budget:
                raise BudgetExceeded(f"{float(self.spent)} of {float(self.budget)} is spent; {float(eps)} more is too much")
        else:
            self.parent.request(self.stability * eps, self)
        self.spent += eps


class Protected:
    """A handle on protected data: transformations are free and lazy, measurements and selections are charged."""

    def __init__(self, node: Node, data: Relation | DataFrame, n: int | None = None, seed: Callable[[], str] | None = None):
        self._node, self._data, self.n = node, data, n
        self._seed = seed or (lambda: secrets.token_hex(16))

    @classmethod
    def over(cls, relation: Relation, budget: float | str = 1, seed: str | None = None) -> Protected:
        """seed: for tests only; each measurement mixes in its number."""
        count = iter(range(1 << 62))
        return cls(Node(None, budget=exact(budget)), relation, seed=(lambda: f"{seed}/{next(count)}") if seed else None)

    def _child(self, data: Relation | DataFrame, n: int | None = None, node: Node | None = None) -> Protected:
        return Protected(node or Node(self._node), data, n, self._seed)

    @property
    def shape(self) -> tuple[int, ...]:
        """Of a relation, its declared domain."""
        return self._data.shape

    @property
    def spent(self) -> float:
        return float(self._node.spent)

    def where(self, text: str) -> Protected:
        return self._child(self._data.where(text))

    def project(self, *names: str) -> Protected:
        return self._child(self._data.project(*names))

    def vectorize(self, weight: str | None = None, reduced: tuple[int, ...] | None = None, bounds: tuple[float, float] | None = None) -> Protected:
        """bounds: of the weight, which is clipped to them; one row moves a weighted sum by up to the larger of them, so each
        measurement of the vector is charged that many times its budget."""
        if (weight is None) != (bounds is None):
            raise ValueError("a weight needs declared bounds, and bounds need a weight")
        node = Node(self._node, max(abs(exact(str(b))) for b in bounds)) if bounds else None
        return self._child(self._data.vectorize(weight, reduced, bounds), _size(reduced or self._data.shape), node)

    def keep(self) -> Protected:
        """The same vector, computed once for all measurements of it."""
        return self._child(self._data.persist(), self.n, self._node)

    def reshape(self, shape: tuple[int, ...]) -> Protected:
        """The same cells under other coordinates, which operators take as an argument."""
        if _size(shape) != self.n:
            raise ValueError(f"{shape} has not {self.n} cells")
        return self

    def group(self, cells: list[int]) -> Protected:
        """The listed cells, renumbered in their order."""
        own = frame(self._data.sparkSession, cell=np.array(cells, np.int64), place=np.arange(len(cells)))
        return self._child(self._data.join(F.broadcast(own), "cell").select(F.col("place").alias("cell"), "value"), len(cells))

    def reduce_by_partition(self, part: np.ndarray) -> Protected:
        parts = _frame(self._data, part)
        return self._child(vectors.reduce_by(self._data, parts), int(part.max()) + 1)

    def split_by_partition(self, part: np.ndarray) -> list[Protected]:
        """One handle a part, under a node of parallel composition. Plans that treat parts alike use vectors.split_by."""
        split = Node(self._node, split=True)
        rows = vectors.split_by(self._data, _frame(self._data, part))
        sizes = np.bincount(part)
        return [self._child(rows.where(F.col("part") == k).select(F.col("local").alias("cell"), "value"), int(s), Node(split)) for k, s in enumerate(sizes)]

    def laplace(self, m: Matrix, eps: float | str | Fraction) -> np.ndarray:
        """The noisy answers, in the order of the queries. Only noisy rows leave the executors."""
        self._node.request(exact(eps))
        rows = measure.laplace(m, self._data, float(eps), self._seed()).toArrow()
        return rows.column("value").to_numpy()[np.argsort(rows.column("query").to_numpy())]

    def worst_approximated(self, m: Matrix, estimate: np.ndarray, measured: list[int], eps: float | str | Fraction, mechanism: str = "exponential") -> int:
        self._node.request(exact(eps))
        guess = frame(self._data.sparkSession, cell=np.arange(len(estimate)), value=np.asarray(estimate, float))
        return measure.worst_approximated(m, self._data, guess, measured, float(eps), self._seed(), mechanism).first()[0]

    def mapping(self, eps: float | str | Fraction, find: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """A private partition: find sees the true vector and must itself spend no more than eps."""
        self._node.request(exact(eps))
        rows = self._data.toArrow()
        return find(rows.column("value").to_numpy()[np.argsort(rows.column("cell").to_numpy())].astype(float))

    def selected(self, eps: float | str | Fraction, choose: Callable[[Relation, str], object]) -> object:
        """A private choice on a relation: choose gets it with a seed and must itself spend no more than eps."""
        self._node.request(exact(eps))
        return choose(self._data, self._seed())


def _frame(x: DataFrame, part: np.ndarray) -> DataFrame:
    return frame(x.sparkSession, cell=np.arange(len(part)), part=np.asarray(part, np.int64))

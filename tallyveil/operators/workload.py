"""Query matrices. Each is applied to vectors without being written out, on the driver (times, transposed) and as a plan.

apply(x) returns (query, value). Query ids rise in the order of the matrix's rows and lie below span; they may leave gaps.
Vectors are histograms over declared domains, so the running windows below run over a domain's cells, never over the
table's rows; over large domains they run in blocks.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells beyond which running sums are taken in blocks of their square root.
ONE_TASK_CELLS = 65_536


def frame(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """A small DataFrame from arrays."""
    return spark.createDataFrame(pa.table({k: np.ascontiguousarray(v) for k, v in columns.items()}))


def running_sum(x: DataFrame, key: str, n: int, by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """x with value replaced by its running sum along key (0 to n - 1), separately for each combination of by."""
    order = F.col(key).desc() if descending else F.col(key)
    if by or n <= ONE_TASK_CELLS:
        return x.withColumn("value", F.sum("value").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    block = F.expr(f"{key} div {math.isqrt(n)}")
    dealt = x.withColumn("k_block", block)
    order_of_blocks = F.col("k_block").desc() if descending else F.col("k_block")
    before = Window.orderBy(order_of_blocks).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("k_block").agg(F.sum("value").alias("whole")).select("k_block", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("k_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("value", F.sum("value").over(inside)).join(F.broadcast(sums), "k_block")
    return out.withColumn("value", F.col("value") + F.col("first")).drop("k_block", "first")


class Matrix:
    """A linear query set: m queries over n cells."""

    n: int

    @property
    def m(self) -> int:
        raise NotImplementedError

    @property
    def span(self) -> int:
        """A bound above every query id."""
        return self.m

    # on the driver

    def times(self, x: np.ndarray) -> np.ndarray:
        """The answers on a vector, or on each column of a 2-D array."""
        return self.numpy() @ x

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return self.numpy().T @ y

    def numpy(self) -> np.ndarray:
        return self.times(np.eye(self.n))

    def absolute(self) -> Matrix:
        """Of each entry its absolute value."""
        return Dense(np.abs(self.numpy()))

    def squared(self) -> Matrix:
        """Of each entry its square."""
        return Dense(self.numpy() ** 2)

    def sensitivity(self) -> float:
        return float(self.absolute().transposed(np.ones(self.m)).max())

    def gram(self) -> np.ndarray:
        return self.transposed(self.numpy())

    def row(self, k: int) -> Dense:
        unit = np.zeros(self.m)
        unit[k] = 1
        return Dense(self.transposed(unit)[None])

    def total(self) -> float:
        return float(self.times(np.ones(self.n)).sum())

    def diagonal(self) -> np.ndarray:
        return np.diag(self.numpy())

    def trace(self) -> float:
        return float(self.diagonal().sum())

    def inverse(self) -> Matrix:
        return Dense(np.linalg.inv(self.numpy()))

    def pseudo_inverse(self) -> Matrix:
        return Dense(np.linalg.pinv(self.numpy()))

    def transpose(self) -> Matrix:
        return Transposed(self)

    def __add__(self, other: Matrix) -> Matrix:
        return Sum([self, other])

    def __sub__(self, other: Matrix) -> Matrix:
        return Sum([self, Weighted(other, -1.0)])

    def __mul__(self, c: float) -> Matrix:
        return Weighted(self, c)

    __rmul__ = __mul__

    def __matmul__(self, other: Matrix) -> Matrix:
        return Product(self, other)

    # as a plan

    def entries(self, spark: SparkSession) -> DataFrame:
        a = self.numpy()
        q, c = np.nonzero(a)
        return frame(spark, query=q, b=c, w=a[q, c])

    def along(self, parts: DataFrame) -> DataFrame:
        """(head, b, rest, value) to (head, query, rest, value): the queries over b, for each head and rest."""
        return parts.join(self.entries(parts.sparkSession), "b").groupBy("head", "query", "rest").agg(F.sum(F.col("w") * F.col("value")).alias("value"))

    def apply(self, x: DataFrame) -> DataFrame:
        nought = F.lit(0).cast("long")
        return self.along(x.select(nought.alias("head"), F.col("cell").alias("b"), nought.alias("rest"), "value")).select("query", "value")


@dataclass
class Dense(Matrix):
    a: np.ndarray

    def __post_init__(self) -> None:
        self.a = np.atleast_2d(np.asarray(self.a, float))
        self.n = self.a.shape[1]

    @property
    def m(self) -> int:
        return len(self.a)

    def numpy(self) -> np.ndarray:
        return self.a


def as_matrix(a: Matrix | np.ndarray) -> Matrix:
    return a if isinstance(a, Matrix) else Dense(a)


@dataclass
class Identity(Matrix):
    n: int

    @property
    def m(self) -> int:
        return self.n

    def times(self, x: np.ndarray) -> np.ndarray:
        return x

    transposed = times

    def absolute(self) -> Matrix:
        return self

    squared = inverse = pseudo_inverse = absolute

    def sensitivity(self) -> float:
        return 1.0

    def along(self, parts: DataFrame) -> DataFrame:
        return parts.withColumnRenamed("b", "query")


@dataclass
class Ones(Matrix):
    """m times the total."""

    rows: int
    n: int

    @property
    def m(self) -> int:
        return self.rows

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.repeat(x.sum(0, keepdims=True), self.rows, 0)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return np.repeat(y.sum(0, keepdims=True), self.n, 0)

    def absolute(self) -> Matrix:
        return self

    squared = absolute

    def pseudo_inverse(self) -> Matrix:
        return Weighted(Ones(self.n, self.rows), 1 / (self.n * self.rows))

    def along(self, parts: DataFrame) -> DataFrame:
        whole = parts.groupBy("head", "rest").agg(F.sum("value").alias("value"))
        return whole.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.rows - 1).cast("long"))).alias("query"), "rest", "value")


def Total(n: int) -> Ones:  # noqa: N802
    return Ones(1, n)


def identity_total(n: int, weight: float = 1.0) -> Union:
    """The cells, and the total with a weight."""
    return Union([(Identity(n), 1.0), (Total(n), weight)])


@dataclass
class Prefix(Matrix):
    n: int

    @property
    def m(self) -> int:
        return self.n

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, 0)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return np.cumsum(y[::-1], 0)[::-1]

    def absolute(self) -> Matrix:
        return self

    squared = absolute

    def gram(self) -> np.ndarray:
        k = np.arange(self.n)
        return (self.n - np.maximum(k[:, None], k)).astype(float)

    def along(self, parts: DataFrame) -> DataFrame:
        return running_sum(parts, "b", self.n, ("head", "rest")).withColumnRenamed("b", "query")

    def apply(self, x: DataFrame) -> DataFrame:
        return running_sum(x.select("cell", "value"), "cell", self.n).select(F.col("cell").alias("query"), "value")


@dataclass
class Suffix(Matrix):
    n: int

    @property
    def m(self) -> int:
        return self.n

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.cumsum(x[::-1], 0)[::-1]

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return np.cumsum(y, 0)

    def absolute(self) -> Matrix:
        return self

    squared = absolute

    def along(self, parts: DataFrame) -> DataFrame:
        return running_sum(parts, "b", self.n, ("head", "rest"), descending=True).withColumnRenamed("b", "query")

    def apply(self, x: DataFrame) -> DataFrame:
        return running_sum(x.select("cell", "value"), "cell", self.n, descending=True).select(F.col("cell").alias("query"), "value")


@dataclass
class WidthK(Matrix):
    """Every window of `width` cells: differences of the running sum."""

    n: int
    width: int

    @property
    def m(self) -> int:
        return self.n - self.width + 1

    def times(self, x: np.ndarray) -> np.ndarray:
        s = np.concatenate([np.zeros_like(x[:1], dtype=float), np.cumsum(x, 0)])
        return s[self.width :] - s[: -self.width]

    def transposed(self, y: np.ndarray) -> np.ndarray:
        s = np.concatenate([np.zeros_like(y[:1], dtype=float), np.cumsum(y, 0), np.repeat(y.sum(0, keepdims=True), self.width - 1, 0)])
        return s[1:] - s[np.maximum(0, np.arange(1, self.n + 1) - self.width)]

    def absolute(self) -> Matrix:
        return self

    squared = absolute

    def along(self, parts: DataFrame) -> DataFrame:
        w = Window.partitionBy("head", "rest").orderBy("b").rowsBetween(-(self.width - 1), 0)
        rows = parts.select("head", (F.col("b") - (self.width - 1)).alias("query"), "rest", F.sum("value").over(w).alias("value"))
        return rows.where(F.col("query") >= 0)


def width_k_ranges(n: int, widths: list[int]) -> Union:
    return Union([(WidthK(n, k), 1.0) for k in widths])


def moments(n: int, k: int = 3) -> Dense:
    """The sums of cell ** j, for j = 1 to k."""
    return Dense(np.arange(n, dtype=float) ** np.arange(1, k + 1)[:, None])


@dataclass
class Ranges(Matrix):
    """Boxes with inclusive corners: differences of a summed-area table at 2**d corners, by equi-joins."""

    shape: tuple[int, ...]
    low: np.ndarray
    high: np.ndarray

    def __post_init__(self) -> None:
        self.n, d = math.prod(self.shape), len(self.shape)
        self.low, self.high = (np.asarray(x, np.int64).reshape(-1, d) for x in (self.low, self.high))

    @property
    def m(self) -> int:
        return len(self.low)

    def _corners(self) -> list[tuple[float, np.ndarray]]:
        """Sign and place in the summed-area table, whose cells are one off, of each corner of every box."""
        place = lambda pick: [np.where(p, self.low[:, i], self.high[:, i] + 1) for i, p in enumerate(pick)]
        return [(float((-1) ** sum(pick)), np.ravel_multi_index(place(pick), [s + 1 for s in self.shape])) for pick in itertools.product((0, 1), repeat=len(self.shape))]

    def times(self, x: np.ndarray) -> np.ndarray:
        table = x.reshape(*self.shape, -1)
        for i in range(len(self.shape)):
            table = np.cumsum(table, i)
        table = np.pad(table, [(1, 0)] * len(self.shape) + [(0, 0)]).reshape(math.prod(s + 1 for s in self.shape), -1)
        return sum(sign * table[at] for sign, at in self._corners()).reshape(self.m, *x.shape[1:])

    def transposed(self, y: np.ndarray) -> np.ndarray:
        table = np.zeros((math.prod(s + 1 for s in self.shape), math.prod(y.shape[1:])))
        for sign, at in self._corners():
            np.add.at(table, at, sign * y.reshape(self.m, -1))
        table = table.reshape(*[s + 1 for s in self.shape], -1)
        for i in range(len(self.shape)):
            table = np.flip(np.cumsum(np.flip(table, i), i), i)
        return table[(slice(1, None),) * len(self.shape)].reshape(self.n, *y.shape[1:])

    def absolute(self) -> Matrix:
        return self

    squared = absolute

    def unproject(self, shape: tuple[int, ...], dims: tuple[int, ...]) -> Ranges:
        """The same boxes over a domain of more attributes, whole in all but dims."""
        low, high = np.zeros((self.m, len(shape)), np.int64), np.repeat(np.array(shape)[None] - 1, self.m, 0)
        low[:, list(dims)], high[:, list(dims)] = self.low, self.high
        return Ranges(shape, low, high)

    def apply(self, x: DataFrame) -> DataFrame:
        from tallyveil.operators.vectors import coordinates

        table, d = coordinates(x, self.shape), len(self.shape)
        for i, n in enumerate(self.shape):
            table = running_sum(table, f"b{i}", n, tuple(f"b{j}" for j in range(d) if j != i))
        q, cell, w = [], [], []
        for pick in itertools.product((0, 1), repeat=d):
            at = np.stack([self.low[:, i] - 1 if p else self.high[:, i] for i, p in enumerate(pick)])
            inside = np.flatnonzero((at >= 0).all(0))
            q.append(inside)
            cell.append(np.ravel_multi_index(at[:, inside], self.shape))
            w.append(np.full(len(inside), float((-1) ** sum(pick))))
        corners = frame(x.sparkSession, query=np.concatenate(q), cell=np.concatenate(cell), w=np.concatenate(w))
        return corners.join(table.select("cell", "value"), "cell").groupBy("query").agg(F.sum(F.col("w") * F.col("value")).alias("value"))

    def along(self, parts: DataFrame) -> DataFrame:
        if len(self.shape) > 1:
            return super().along(parts)
        table = running_sum(parts, "b", self.n, ("head", "rest"))
        q = np.arange(self.m)
        inner = np.flatnonzero(self.low[:, 0] > 0)
        corners = frame(parts.sparkSession, query=np.concatenate([q, inner]), b=np.concatenate([self.high[:, 0], self.low[inner, 0] - 1]), w=np.concatenate([np.ones(self.m), -np.ones(len(inner))]))
        return table.join(corners, "b").groupBy("head", "query", "rest").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def all_ranges(n: int) -> Ranges:
    low, high = np.triu_indices(n)
    return Ranges((n,), low, high)


def random_ranges(shape: tuple[int, ...], size: int, seed: int = 9001, sides: list[tuple[int, ...]] | None = None) -> Ranges:
    """Random boxes; of the given sides where there are any, each chosen as often as chance will."""
    rng = np.random.default_rng(seed)
    if sides:
        own = np.array(sides)[rng.integers(0, len(sides), size)]
        low = rng.integers(0, np.array(shape) - own + 1)
        return Ranges(tuple(shape), low, low + own - 1)
    ends = [[np.sort(rng.integers(0, n, 2)) for n in shape] for _ in range(size)]
    return Ranges(tuple(shape), [[e[0] for e in row] for row in ends], [[e[1] for e in row] for row in ends])


@dataclass
class Haar(Matrix):
    """Unnormalised wavelet: the total, then from coarse to fine each block's left half minus its right half. n: a power of two."""

    n: int

    def __post_init__(self) -> None:
        if self.n < 1 or self.n & (self.n - 1):
            raise ValueError(f"a wavelet needs a power of two of cells, not {self.n}")

    @property
    def m(self) -> int:
        return self.n

    def times(self, x: np.ndarray) -> np.ndarray:
        out, sums = [], np.asarray(x, float)
        while len(sums) > 1:
            out.append(sums[::2] - sums[1::2])
            sums = sums[::2] + sums[1::2]
        return np.concatenate([sums, *reversed(out)])

    def transposed(self, y: np.ndarray) -> np.ndarray:
        """The adjoint: each level's value to its left half, less it to its right one."""
        out, size = np.asarray(y[:1], float), 1
        while size < self.n:
            level = y[size : 2 * size]
            out = np.stack([out + level, out - level], 1).reshape(2 * size, *y.shape[1:])
            size *= 2
        return out

    def absolute(self) -> Matrix:
        return Union([(Total(self.n), 1.0), *((Blocks(self.n, self.n >> k), 1.0) for k in range(self.n.bit_length() - 1))])

    squared = absolute

    def sensitivity(self) -> float:
        return float(self.n.bit_length())

    def inverse(self) -> Matrix:
        """Its rows are orthogonal, so the inverse is the adjoint with columns over their squared lengths."""
        return Transposed(self) @ Scaled(1 / self.squared().times(np.ones(self.n)))

    pseudo_inverse = inverse

    def along(self, parts: DataFrame) -> DataFrame:
        levels = self.n.bit_length() - 1
        rows = parts.select("head", "b", "rest", "value", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
        size = F.expr(f"cast({self.n} / power(2, level - 1) as bigint)")
        block = F.when(F.col("level") == 0, 0).otherwise(F.expr("cast(power(2, level - 1) as bigint)") + F.floor(F.col("b") / size))
        sign = F.when((F.col("level") == 0) | (F.col("b") % size < size / 2), F.col("value")).otherwise(-F.col("value"))
        return rows.groupBy("head", block.cast("long").alias("query"), "rest").agg(F.sum(sign).alias("value"))


@dataclass
class Blocks(Matrix):
    """Sums of blocks of `size` adjacent cells; the last block may be shorter."""

    n: int
    size: int

    @property
    def m(self) -> int:
        return -(-self.n // self.size)

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, np.arange(0, self.n, self.size), 0)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return np.repeat(y, self.size, 0)[: self.n]

    def absolute(self) -> Matrix:
        return self

    squared = absolute

    def along(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("head", F.expr(f"b div {self.size}").alias("query"), "rest").agg(F.sum("value").alias("value"))


@dataclass
class Scaled(Matrix):
    """A diagonal."""

    d: np.ndarray

    def __post_init__(self) -> None:
        self.n = len(self.d)

    @property
    def m(self) -> int:
        return self.n

    def times(self, x: np.ndarray) -> np.ndarray:
        return (self.d * x.T).T

    transposed = times

    def absolute(self) -> Matrix:
        return Scaled(np.abs(self.d))

    def squared(self) -> Matrix:
        return Scaled(self.d**2)

    def entries(self, spark: SparkSession) -> DataFrame:
        return frame(spark, query=np.arange(self.n), b=np.arange(self.n), w=np.asarray(self.d, float))


@dataclass
class Sparse(Matrix):
    """Given by its entries: row, column, weight."""

    rows: int
    n: int
    q: np.ndarray
    c: np.ndarray
    w: np.ndarray

    @property
    def m(self) -> int:
        return self.rows

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, *x.shape[1:]))
        np.add.at(out, self.q, (self.w * x[self.c].T).T)
        return out

    def transposed(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, *y.shape[1:]))
        np.add.at(out, self.c, (self.w * y[self.q].T).T)
        return out

    def absolute(self) -> Matrix:
        return Sparse(self.rows, self.n, self.q, self.c, np.abs(self.w))

    def squared(self) -> Matrix:
        return Sparse(self.rows, self.n, self.q, self.c, self.w**2)

    def entries(self, spark: SparkSession) -> DataFrame:
        return frame(spark, query=self.q, b=self.c, w=self.w)


def sparse(m: Matrix, q: int = 0, c: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a matrix, its rows and columns moved on."""
    a = m.numpy()
    i, j = np.nonzero(a)
    return i + q, j + c, a[i, j]


def block_diagonal(parts: list[Matrix]) -> Sparse:
    """Each matrix on its own run of cells, with its own queries."""
    rows, cells, own = 0, 0, []
    for p in parts:
        own.append(sparse(p, rows, cells))
        rows, cells = rows + p.m, cells + p.n
    return Sparse(rows, cells, *(np.concatenate(x) for x in zip(*own, strict=True)))


def split(length: int, branching: int) -> np.ndarray:
    """Where the parts of an interval begin: as even as whole cells allow, each of a cell at least."""
    b = min(branching, length)
    return -(-length * np.arange(b) // b)


@dataclass
class Hierarchy(Matrix):
    """A tree of boxes: each is split into `branching` parts along every attribute until boxes are cells.

    Boxes of one level are the product of each attribute's parts, so a level is a block sum along each attribute. A query's
    id is its level times n, plus its box's first cell; cells come last.
    """

    shape: tuple[int, ...]
    branching: int = 2
    root: bool = True

    def __post_init__(self) -> None:
        self.n = math.prod(self.shape)

    @cached_property
    def levels(self) -> list[list[np.ndarray]]:
        """The starts of each attribute's parts at each level of boxes larger than a cell."""
        now, out = [np.zeros(1, np.int64) for _ in self.shape], []
        while any(len(s) < n for s, n in zip(now, self.shape, strict=True)):
            out.append(now)
            now = [np.concatenate([at + split(size, self.branching) for at, size in zip(s, np.diff(s, append=n), strict=True)]) for s, n in zip(now, self.shape, strict=True)]
        return out if self.root else out[1:]

    @cached_property
    def _larger(self) -> list[np.ndarray]:
        """Of each level, which boxes are larger than a cell: a box may reach that size before others do."""
        out = []
        for level in self.levels:
            size = np.ones(1, np.int64)
            for s, n in zip(level, self.shape, strict=True):
                size = np.outer(size, np.diff(s, append=n)).reshape(-1)
            out.append(size > 1)
        return out

    @property
    def m(self) -> int:
        return sum(int(k.sum()) for k in self._larger) + self.n

    @property
    def span(self) -> int:
        return (len(self.levels) + 1) * self.n

    def times(self, x: np.ndarray) -> np.ndarray:
        out = []
        for level, larger in zip(self.levels, self._larger, strict=True):
            sums = x.reshape(*self.shape, -1)
            for i, s in enumerate(level):
                sums = np.add.reduceat(sums, s, i)
            out.append(sums.reshape(len(larger), *x.shape[1:])[larger])
        return np.concatenate([*out, x])

    def transposed(self, y: np.ndarray) -> np.ndarray:
        at, out = self.m - self.n, np.array(y[self.m - self.n :], float)
        for level, larger in zip(reversed(self.levels), reversed(self._larger), strict=True):
            own = np.zeros((len(larger), *y.shape[1:]))
            own[larger] = y[at - int(larger.sum()) : at]
            at -= int(larger.sum())
            own = own.reshape(*map(len, level), -1)
            for i, s in enumerate(level):
                own = np.repeat(own, np.diff(s, append=self.shape[i]), i)
            out += own.reshape(self.n, *y.shape[1:])
        return out

    def absolute(self) -> Matrix:
        return self

    squared = absolute

    def apply(self, x: DataFrame) -> DataFrame:
        nought = F.lit(0).cast("long")
        return self.along(x.select(nought.alias("head"), F.col("cell").alias("b"), nought.alias("rest"), "value")).select("query", "value")

    def along(self, parts: DataFrame) -> DataFrame:
        """Each cell finds its box level by level: the part of an offset r in an interval of length l is r * b div l."""
        strides = [math.prod(self.shape[i + 1 :]) for i in range(len(self.shape))]
        at = [F.expr(f"(b div {s}) % {n}") for s, n in zip(strides, self.shape, strict=True)]
        rows = parts.select("*", F.array(*at).alias("at"), *[F.struct(F.lit(0).cast("long").alias("low"), F.lit(n).cast("long").alias("size")).alias(f"d{i}") for i, n in enumerate(self.shape)])
        boxes, depth = [], len(self.levels) + (not self.root)
        for k in range(depth):
            if k or self.root:
                low = sum((F.col(f"d{i}.low") * s for i, s in enumerate(strides)), F.lit(0).cast("long"))
                size = math.prod([F.col(f"d{i}.size") for i in range(len(self.shape))], start=F.lit(1).cast("long"))
                name = f"box{k}"
                rows = rows.withColumn(name, F.when(size > 1, F.lit((k - (not self.root)) * self.n) + low))
                boxes.append(F.col(name))
            for i in range(len(self.shape)):
                low, size = F.col(f"d{i}.low"), F.col(f"d{i}.size")
                b = F.least(F.lit(self.branching).cast("long"), size)
                part = F.floor((F.col("at")[i] - low) * b / size)  # exact: both are far below 2 ** 53
                start = lambda j: F.ceil(size * j / b)  # noqa: B023, E731
                rows = rows.withColumn(f"d{i}", F.struct((low + start(part)).alias("low"), (start(part + 1) - start(part)).alias("size")))
        cells = F.lit(len(self.levels) * self.n) + F.col("b")
        rows = rows.select("head", "rest", "value", F.explode(F.array_compact(F.array(*boxes, cells))).alias("query"))
        return rows.groupBy("head", "query", "rest").agg(F.sum("value").alias("value"))


def Tree(n: int, branching: int = 2, root: bool = True) -> Hierarchy:  # noqa: N802
    return Hierarchy((n,), branching, root)


def best_branching(n: int) -> int:
    """The branching of least variance for ranges: (b-1) h^3 - 2 (b+1) h^2 / 3, its last term in whole numbers, at height h."""
    cost = {}
    for b in range(2, max(3, n + 1)):
        h = 0
        while b**h < n:
            h += 1
        cost[b] = (b - 1) * h**3 - 2 * (b + 1) * h**2 // 3
        if h <= 1:
            break  # a larger branching only adds to a tree of one level
    return min(cost, key=lambda b: (cost[b], b))


def hb_tree(shape: tuple[int, ...]) -> Hierarchy:
    return Hierarchy(shape, best_branching(math.prod(shape)), root=False)


@dataclass
class Weighted(Matrix):
    base: Matrix
    c: float

    def __post_init__(self) -> None:
        if isinstance(self.base, Weighted):
            self.base, self.c = self.base.base, self.base.c * self.c
        self.n = self.base.n

    @property
    def m(self) -> int:
        return self.base.m

    @property
    def span(self) -> int:
        return self.base.span

    def times(self, x: np.ndarray) -> np.ndarray:
        return self.c * self.base.times(x)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return self.c * self.base.transposed(y)

    def absolute(self) -> Matrix:
        return Weighted(self.base.absolute(), abs(self.c))

    def squared(self) -> Matrix:
        return Weighted(self.base.squared(), self.c**2)

    def inverse(self) -> Matrix:
        return Weighted(self.base.inverse(), 1 / self.c)

    def pseudo_inverse(self) -> Matrix:
        return Weighted(self.base.pseudo_inverse(), 1 / self.c if self.c else 0.0)

    def along(self, parts: DataFrame) -> DataFrame:
        return self.base.along(parts).withColumn("value", F.col("value") * self.c)

    def apply(self, x: DataFrame) -> DataFrame:
        return self.base.apply(x).withColumn("value", F.col("value") * self.c)


@dataclass
class Transposed(Matrix):
    base: Matrix

    def __post_init__(self) -> None:
        self.n = self.base.m

    @property
    def m(self) -> int:
        return self.base.n

    def times(self, x: np.ndarray) -> np.ndarray:
        return self.base.transposed(x)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return self.base.times(y)

    def absolute(self) -> Matrix:
        return Transposed(self.base.absolute())


@dataclass
class Product(Matrix):
    """left @ right, applied one after the other."""

    left: Matrix
    right: Matrix

    def __post_init__(self) -> None:
        self.n = self.right.n

    @property
    def m(self) -> int:
        return self.left.m

    @property
    def span(self) -> int:
        return self.left.span

    def times(self, x: np.ndarray) -> np.ndarray:
        return self.left.times(self.right.times(x))

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return self.right.transposed(self.left.transposed(y))

    def absolute(self) -> Matrix:
        one = isinstance(self.left, Scaled | Identity) or isinstance(self.right, Scaled | Identity)
        return Product(self.left.absolute(), self.right.absolute()) if one else super().absolute()

    def inverse(self) -> Matrix:
        return Product(self.right.inverse(), self.left.inverse())

    def apply(self, x: DataFrame) -> DataFrame:
        if self.right.span != self.right.m:
            return super().apply(x)
        return self.left.apply(self.right.apply(x).withColumnRenamed("query", "cell"))


@dataclass
class Sum(Matrix):
    """Entry by entry; the matrices have one shape."""

    parts: list[Matrix]

    def __post_init__(self) -> None:
        self.n = self.parts[0].n
        if len({(p.m, p.n, p.span) for p in self.parts}) > 1:
            raise ValueError("matrices of a sum must have one shape")

    @property
    def m(self) -> int:
        return self.parts[0].m

    @property
    def span(self) -> int:
        return self.parts[0].span

    def times(self, x: np.ndarray) -> np.ndarray:
        return sum(p.times(x) for p in self.parts)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return sum(p.transposed(y) for p in self.parts)

    def apply(self, x: DataFrame) -> DataFrame:
        out = self.parts[0].apply(x)
        for p in self.parts[1:]:
            out = out.unionByName(p.apply(x))
        return out.groupBy("query").agg(F.sum("value").alias("value"))


@dataclass
class Beside(Matrix):
    """Column blocks: each matrix answers on its own run of cells, and answers are added."""

    parts: list[Matrix]

    def __post_init__(self) -> None:
        self.n = sum(p.n for p in self.parts)
        self.ends = np.cumsum([p.n for p in self.parts])

    @property
    def m(self) -> int:
        return self.parts[0].m

    def times(self, x: np.ndarray) -> np.ndarray:
        return sum(p.times(x[e - p.n : e]) for p, e in zip(self.parts, self.ends, strict=True))

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return np.concatenate([p.transposed(y) for p in self.parts])

    def apply(self, x: DataFrame) -> DataFrame:
        out = None
        for p, e in zip(self.parts, self.ends, strict=True):
            first = int(e) - p.n
            one = p.apply(x.where((F.col("cell") >= first) & (F.col("cell") < int(e))).select((F.col("cell") - first).alias("cell"), "value"))
            out = one if out is None else out.unionByName(one)
        return out.groupBy("query").agg(F.sum("value").alias("value"))


@dataclass
class Kronecker(Matrix):
    """A product of per-attribute matrices, applied attribute by attribute and never written out."""

    factors: list[Matrix]

    def __post_init__(self) -> None:
        self.n = math.prod(f.n for f in self.factors)

    @property
    def m(self) -> int:
        return math.prod(f.m for f in self.factors)

    @property
    def span(self) -> int:
        return math.prod(f.span for f in self.factors)

    @staticmethod
    def _each(x: np.ndarray, sizes: list[int], steps: list) -> np.ndarray:
        y = x.reshape(*sizes, -1)
        for i, step in enumerate(steps):
            y = np.moveaxis(y, i, 0)
            rest = y.shape[1:]
            y = np.moveaxis(step(y.reshape(len(y), -1)).reshape(-1, *rest), 0, i)
        return y.reshape(-1, *x.shape[1:])

    def times(self, x: np.ndarray) -> np.ndarray:
        return self._each(x, [f.n for f in self.factors], [f.times for f in self.factors])

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return self._each(y, [f.m for f in self.factors], [f.transposed for f in self.factors])

    def absolute(self) -> Matrix:
        return Kronecker([f.absolute() for f in self.factors])

    def squared(self) -> Matrix:
        return Kronecker([f.squared() for f in self.factors])

    def sensitivity(self) -> float:
        return float(math.prod(f.sensitivity() for f in self.factors))

    def inverse(self) -> Matrix:
        return Kronecker([f.inverse() for f in self.factors])

    def pseudo_inverse(self) -> Matrix:
        return Kronecker([f.pseudo_inverse() for f in self.factors])

    def diagonal(self) -> np.ndarray:
        out = np.ones(1)
        for f in self.factors:
            out = np.kron(out, f.diagonal())
        return out

    def trace(self) -> float:
        return float(math.prod(f.trace() for f in self.factors))

    def gram(self) -> np.ndarray:
        out = np.ones((1, 1))
        for f in self.factors:
            out = np.kron(out, f.gram())
        return out

    def apply(self, x: DataFrame) -> DataFrame:
        rows, tail = x.select("cell", "value"), self.n
        for f in self.factors:
            # leading attribute of what is left: cell = (head, b, rest), head already queries
            tail //= f.n
            parts = rows.select(F.expr(f"cell div {f.n * tail}").alias("head"), F.expr(f"(cell div {tail}) % {f.n}").alias("b"), F.expr(f"cell % {tail}").alias("rest"), "value")
            rows = f.along(parts).select(((F.col("head") * f.span + F.col("query")) * tail + F.col("rest")).alias("cell"), "value")
        return rows.withColumnRenamed("cell", "query")


@dataclass
class Union(Matrix):
    """Queries of several matrices one after the other, each with a weight."""

    parts: list[tuple[Matrix, float]]

    def __post_init__(self) -> None:
        self.n = self.parts[0][0].n

    @property
    def m(self) -> int:
        return sum(p.m for p, _ in self.parts)

    @property
    def span(self) -> int:
        return sum(p.span for p, _ in self.parts)

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([w * p.times(x) for p, w in self.parts])

    def transposed(self, y: np.ndarray) -> np.ndarray:
        ends = np.cumsum([p.m for p, _ in self.parts])
        return sum(w * p.transposed(y[e - p.m : e]) for (p, w), e in zip(self.parts, ends, strict=True))

    def absolute(self) -> Matrix:
        return Union([(p.absolute(), abs(w)) for p, w in self.parts])

    def squared(self) -> Matrix:
        return Union([(p.squared(), w * w) for p, w in self.parts])

    def gram(self) -> np.ndarray:
        return sum(w * w * p.gram() for p, w in self.parts)

    def apply(self, x: DataFrame) -> DataFrame:
        out, first = None, 0
        for p, w in self.parts:
            answers = F.col("value") if w == 1 else F.col("value") * w
            one = p.apply(x).select((F.col("query") + first).alias("query"), answers.alias("value"))
            out = one if out is None else out.unionByName(one)
            first += p.span
        return out


@dataclass
class Gram(Matrix):
    """A query set of which only the Gram matrix is known: enough for errors and strategies, not for answers."""

    g: np.ndarray

    def __post_init__(self) -> None:
        self.n = len(self.g)

    @property
    def m(self) -> int:
        return self.n

    def gram(self) -> np.ndarray:
        return self.g

    def numpy(self) -> np.ndarray:
        raise ValueError("the queries are not known, only their Gram matrix")


@dataclass
class NormK(Matrix):
    """Every sum of k distinct cells; over a vector, by k - 1 joins of rising cells. Meant for small domains."""

    n: int
    k: int

    def subsets(self) -> np.ndarray:
        return np.array(list(itertools.combinations(range(self.n), self.k)), np.int64).reshape(-1, self.k)

    @property
    def m(self) -> int:
        return math.comb(self.n, self.k)

    def times(self, x: np.ndarray) -> np.ndarray:
        return x[self.subsets()].sum(1)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        out, own = np.zeros((self.n, *y.shape[1:])), self.subsets()
        for j in range(self.k):
            np.add.at(out, own[:, j], y)
        return out

    def absolute(self) -> Matrix:
        return self

    squared = absolute

    def gram(self) -> np.ndarray:
        once, twice = math.comb(self.n - 1, self.k - 1), math.comb(self.n - 2, self.k - 2) if self.k > 1 else 0
        return np.full((self.n, self.n), float(twice)) + np.eye(self.n) * (once - twice)

    def entries(self, spark: SparkSession) -> DataFrame:
        own = self.subsets()
        return frame(spark, query=np.repeat(np.arange(len(own)), self.k), b=own.reshape(-1), w=np.ones(own.size))


def all_norm_k(n: int, ks: list[int]) -> Union:
    return Union([(NormK(n, k), 1.0) for k in ks])


def disjuncts(factors: list[Matrix]) -> Matrix:
    """Queries of one attribute each, joined by "or": the total less what no attribute's query holds for. Entries are 0 or 1."""
    return Kronecker([Ones(f.m, f.n) for f in factors]) - Kronecker([Ones(f.m, f.n) - f for f in factors])


# Marginals. A key is a bit mask whose highest bit is the first attribute; set bits are the attributes that are kept.


def kept(key: int, d: int) -> tuple[int, ...]:
    return tuple(i for i in range(d) if key >> (d - 1 - i) & 1)


def key_of(attributes: tuple[int, ...], d: int) -> int:
    return sum(1 << (d - 1 - i) for i in attributes)


def marginal(shape: tuple[int, ...], key: int) -> Kronecker:
    own = kept(key, len(shape))
    return Kronecker([Identity(n) if i in own else Total(n) for i, n in enumerate(shape)])


def weighted_marginals(shape: tuple[int, ...], weights: dict[int, float]) -> Union:
    """The marginals of the given keys with their weights."""
    return Union([(marginal(shape, k), w) for k, w in sorted(weights.items()) if w])


def k_way_marginals(shape: tuple[int, ...], k: int) -> Union:
    return weighted_marginals(shape, {key_of(c, len(shape)): 1.0 for c in itertools.combinations(range(len(shape)), k)})


@dataclass
class MarginalsGram:
    """Sums over keys of weight * (identity on the kept attributes, all ones on the others): the Gram matrices of marginals.

    They are closed under products: key a times key b is key a & b, times the sizes of the attributes that neither keeps.
    """

    shape: tuple[int, ...]
    weights: np.ndarray

    @classmethod
    def of(cls, shape: tuple[int, ...], weights: dict[int, float]) -> MarginalsGram:
        out = np.zeros(1 << len(shape))
        for k, w in weights.items():
            out[k] += w * w
        return cls(shape, out)

    def _lost(self, key: int) -> float:
        return float(math.prod(n for i, n in enumerate(self.shape) if i not in kept(key, len(self.shape))))

    def product_matrix(self) -> np.ndarray:
        """The matrix that takes another's weights to those of this one times it; upper triangular."""
        size = len(self.weights)
        out = np.zeros((size, size))
        for a, w in enumerate(self.weights):
            for b in range(size) if w else ():
                out[a & b, b] += w * self._lost(a | b)
        return out

    def __matmul__(self, other: MarginalsGram) -> MarginalsGram:
        return MarginalsGram(self.shape, self.product_matrix() @ other.weights)

    def inverse(self) -> MarginalsGram:
        """Of full rank if the finest key has weight; else a generalised inverse g with a @ g @ a = a, by least squares."""
        unit = np.zeros(len(self.weights))
        unit[-1] = 1
        a = self.product_matrix()
        if self.weights[-1]:
            return MarginalsGram(self.shape, np.linalg.solve(a, unit))
        return MarginalsGram(self.shape, np.linalg.lstsq(a @ a, self.weights, rcond=None)[0])

    def trace(self) -> float:
        return float(self.weights.sum() * math.prod(self.shape))

    def numpy(self) -> np.ndarray:
        n = math.prod(self.shape)
        out = np.zeros((n, n))
        for key, w in enumerate(self.weights):
            own, part = kept(key, len(self.shape)), np.ones((1, 1))
            for i, size in enumerate(self.shape):
                part = np.kron(part, np.eye(size) if i in own else np.ones((size, size)))
            out += w * part
        return out


def approximating_marginals(shape: tuple[int, ...], gram: np.ndarray) -> dict[int, float]:
    """Weights of the marginals whose Gram matrix is nearest to the given one among those that are symmetric in each
    attribute's values: each entry's mean over the pairs of cells that agree on exactly the same attributes."""
    d, cells = len(shape), np.array(list(itertools.product(*map(range, shape))))
    same = (cells[:, None] == cells[None]) @ (1 << np.arange(d)[::-1])
    mean = np.array([gram[same == k].mean() if (same == k).any() else 0.0 for k in range(1 << d)])
    # a pair that agrees on k is counted by each key within k
    square = np.array([[1.0 if a & k == a else 0.0 for a in range(1 << d)] for k in range(1 << d)])
    return {k: math.sqrt(w) for k, w in enumerate(np.maximum(0, np.linalg.solve(square, mean))) if w > 1e-12}


def sum_of_kroneckers(m: Matrix) -> list[tuple[float, list[Matrix]]]:
    """A union, sum, weighted or plain Kronecker product as a list of weights and factors."""
    if isinstance(m, Weighted):
        return [(m.c * c, f) for c, f in sum_of_kroneckers(m.base)]
    if isinstance(m, Sum):
        return [x for p in m.parts for x in sum_of_kroneckers(p)]
    if isinstance(m, Union):
        return [(w * c, f) for p, w in m.parts for c, f in sum_of_kroneckers(p)]
    return [(1.0, m.factors if isinstance(m, Kronecker) else [m])]


def marginals(sparse: DataFrame, keys: list[tuple[int, ...]], d: int) -> DataFrame:
    """(b0.., value) of several marginals by grouping sets; a rolled-up attribute is -1."""
    names = [f"b{i}" for i in range(d)]
    rows = sparse.groupingSets([[F.col(f"b{i}") for i in k] for k in keys], *names).agg(F.sum("value").alias("value"))
    return rows.select(*[F.coalesce(F.col(c), F.lit(-1)).cast("int").alias(c) for c in names], "value")

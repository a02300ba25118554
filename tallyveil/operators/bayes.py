"""Private Bayesian networks: which attributes depend on which, and synthetic rows drawn from them.

A network is a list of (attribute, parents); each parent is (attribute, level), level l meaning that 2 ** l adjacent bins are
taken as one. Tables reach the driver only as noisy numbers, of a size that the bound limits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions import noise
from tallyveil.functions.binning import Attribute
from tallyveil.operators.workload import Kronecker, Matrix, Sparse, Total, Union
from tallyveil.sources.relation import Relation

Parents = tuple[tuple[int, int], ...]
Network = list[tuple[int, Parents]]


def bins(a: Attribute, level: int) -> int:
    return -(-a.bins // (1 << level))


def _cells(attributes: tuple[Attribute, ...], parents: Parents) -> int:
    return math.prod(bins(attributes[i], level) for i, level in parents)


def levels(a: Attribute) -> int:
    """How often an attribute can be halved and still tell two values apart; recoded ones have no order and are not."""
    return 0 if a.recode else max(0, (a.bins - 1).bit_length() - 1)


def maximal_parents(attributes: tuple[Attribute, ...], known: list[int], cells: float) -> Iterator[Parents]:
    """The sets of known attributes, each at a level, whose tables have at most so many cells and which no finer or larger
    set within the limit contains."""
    choices = [[*range(levels(attributes[i]) + 1), None] for i in known]
    fits = {}
    for pick in itertools.product(*choices):
        own = tuple((i, level) for i, level in zip(known, pick, strict=True) if level is not None)
        fits[pick] = _cells(attributes, own) <= cells
    for pick, fit in fits.items():
        if not fit:
            continue
        finer = [(*pick[:k], choices[k][choices[k].index(c) - 1], *pick[k + 1 :]) for k, c in enumerate(pick) if choices[k].index(c)]
        if not any(fits[p] for p in finer):
            yield tuple((i, level) for i, level in zip(known, pick, strict=True) if level is not None)


def _part(attributes: tuple[Attribute, ...], parents: Parents) -> Column:
    out = F.lit(0).cast("long")
    for i, level in parents:
        out = out * bins(attributes[i], level) + F.expr(f"b{i} div {1 << level}")
    return out


def scores(relation: Relation, candidates: list[tuple[int, Parents]]) -> DataFrame:
    """(query, distance, information) of each candidate: the sum of |p(x, parents) - p(x) p(parents)|, and the mutual
    information in bits. One pass over the relation's histogram; each candidate's table has at most as many cells as it."""
    own = relation.attributes
    told = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("query"), F.col(f"b{x}").cast("long").alias("x"), _part(own, parents).alias("p")) for k, (x, parents) in enumerate(candidates)])).alias("c")
    cells = relation.sparse().select(told, F.col("value").cast("double").alias("value"))
    joint = cells.groupBy("c.query", "c.x", "c.p").agg(F.sum("value").alias("n"))
    of_x, of_p = joint.groupBy("query", "x").agg(F.sum("n").alias("n_x")), joint.groupBy("query", "p").agg(F.sum("n").alias("n_p"))
    whole = joint.groupBy("query").agg(F.sum("n").alias("n_all"))
    known = joint.join(of_x, ["query", "x"]).join(of_p, ["query", "p"]).join(F.broadcast(whole), "query")
    product = F.col("n_x") * F.col("n_p") / F.col("n_all") / F.col("n_all")
    seen = F.col("n") / F.col("n_all")
    # cells that no row is in add the rest of the products
    found = known.groupBy("query").agg(F.sum(F.abs(seen - product)).alias("gap"), F.sum(product).alias("held"), F.sum(seen * F.log2(seen / product)).alias("information"))
    return found.select("query", (F.col("gap") + 1 - F.col("held")).alias("distance"), "information")


def network(relation: Relation, eps: float, theta: float, seed: str, rows: float | None = None) -> Network:
    """Grown attribute by attribute: the next one and its parents are chosen by the exponential mechanism on the distance,
    whose sensitivity is 6 / rows. Tables are kept to eps * rows / (4 * attributes * theta) cells. rows: a public count;
    without one, a count with noise for a twentieth of eps."""
    own, d = relation.attributes, len(relation.attributes)
    if rows is None:
        count = relation.frame.agg(F.count("*").alias("n")).select((F.col("n") + noise.laplace(f"{seed}/rows", F.lit(0), 20 / eps)).alias("n"))
        rows, eps = max(1.0, float(count.first()["n"])), 0.95 * eps
    cells = max(1.0, eps * rows / (4 * d * theta))
    start = int(np.random.default_rng(int.from_bytes(seed.encode()[:8].ljust(8), "little")).integers(d))
    known, out = [start], [(start, ())]
    each = eps / max(1, d - 1)
    while len(known) < d:
        candidates = [(x, parents) for x in range(d) if x not in known for parents in maximal_parents(own, known, cells / own[x].bins)]
        candidates = candidates or [(x, ()) for x in range(d) if x not in known]
        told = scores(relation, candidates)
        pick = told.agg(F.max_by("query", each * rows / 12 * F.col("distance") + noise.gumbel(f"{seed}/{len(known)}", F.col("query")))).first()[0]
        out.append(candidates[pick])
        known.append(candidates[pick][0])
    return out


def naive(attributes: tuple[Attribute, ...], root: int = 0) -> Network:
    """Every attribute depends on one alone."""
    return [(root, ()), *((i, ((root, 0),)) for i in range(len(attributes)) if i != root)]


def measurements(net: Network, shape: tuple[int, ...]) -> Matrix:
    """The marginals of each attribute with its parents, as queries on the histogram."""
    parts = []
    for x, parents in net:
        own = dict(parents) | {x: 0}
        parts.append((Kronecker([_halved(n, own[i]) if i in own else Total(n) for i, n in enumerate(shape)]), 1.0))
    return Union(parts)


def _halved(n: int, level: int) -> Sparse:
    cells = np.arange(n)
    return Sparse(-(-n // (1 << level)), n, cells >> level, cells, np.ones(n))


def noisy_tables(relation: Relation, net: Network, eps: float | None, seed: str) -> list[np.ndarray]:
    """Each attribute's shares given its parents, (parents' cells, bins): counts with Laplace noise of scale 2 d / eps, cut
    at 0, scaled to 1; where nothing is left, even. eps None: without noise, for tests."""
    own, out = relation.attributes, []
    sparse = relation.sparse()
    for k, (x, parents) in enumerate(net):
        rows = sparse.groupBy(_part(own, parents).alias("p"), F.col(f"b{x}").cast("long").alias("x")).agg(F.sum("value").cast("double").alias("n"))
        n_p, n_x = _cells(own, parents), own[x].bins
        grid = relation.frame.sparkSession.range(n_p * n_x).select(F.expr(f"id div {n_x}").alias("p"), F.expr(f"id % {n_x}").alias("x"), F.col("id"))
        full = grid.join(rows, ["p", "x"], "left").select("id", F.coalesce("n", F.lit(0.0)).alias("n"))
        if eps is not None:
            full = full.select("id", (F.col("n") + noise.laplace(f"{seed}/{k}", F.col("id"), 2 * len(net) / eps)).alias("n"))
        told = full.toArrow()
        table = np.maximum(0, told.column("n").to_numpy()[np.argsort(told.column("id").to_numpy())]).reshape(n_p, n_x)
        whole = table.sum(1, keepdims=True)
        out.append(np.where(whole > 0, table / np.where(whole > 0, whole, 1), 1 / n_x))
    return out


def synthesize(relation: Relation, net: Network, tables: list[np.ndarray], rows: int, seed: str) -> DataFrame:
    """(id, b0..): rows drawn attribute by attribute, each given its parents' values. A table's running shares go to the
    tasks as one array per parents' cell, of a size that the bound limits."""
    spark, own = relation.frame.sparkSession, relation.attributes
    out = spark.range(rows)
    for (x, parents), table in zip(net, tables, strict=True):
        upto = np.cumsum(table, 1)[:, :-1]
        known = spark.createDataFrame([(p, row.tolist()) for p, row in enumerate(upto)], "p long, upto array<double>")
        drawn = out.withColumn("p", _part(own, parents)).withColumn("u", noise.uniform(f"{seed}/{x}", F.col("id")))
        drawn = drawn.join(F.broadcast(known), "p")
        out = drawn.withColumn(f"b{x}", F.size(F.filter("upto", lambda e: e <= F.col("u"))).cast("int")).drop("p", "u", "upto")
    return out.select("id", *[f"b{i}" for i in range(len(own))])
